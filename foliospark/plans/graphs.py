"""Graph queries and their SQL, on all trade between nations, on all pairs of customer and supplier, and on a gazetteer of terms in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import graph as G
from foliospark.sources import table

TERMS = ("the", "and", "licensed under", "apache license", "version 2", "de la", "der die", "tion", "inand", "que", "moron", "idiot", "trash", "worthless", "license", "token", "licensed under the apache license", "MIT", "A")


def _trade(spark, d):
    """All pairs of different nations with order lines between customer and supplier."""
    c, s, o, li = (table(spark, d, t) for t in ("customer", "supplier", "orders", "lineitem"))
    pairs = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = pairs.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    return pairs.groupBy(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _edges(spark, d):
    return _trade(spark, d).select("u", "v")


def _orders_graph(spark, d):
    """Every pair of a customer and a supplier with an order line between them; it grows with the tables."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")).distinct()


def trade_edges(spark, d):
    """The graph itself."""
    return _trade(spark, d)


def graph_degree(spark, d):
    """Degree and degree centrality of every node."""
    return G.degrees(_orders_graph(spark, d))


def graph_density(spark, d):
    """Nodes, edges and density."""
    return G.density(_orders_graph(spark, d))


def graph_components(spark, d):
    """Components of the graph of all customers and suppliers: the least node of each node's component."""
    return G.components(_orders_graph(spark, d))


def graph_modularity(spark, d):
    """Modularity of the partition of customers and suppliers by region."""
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    places = c.select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").alias("k")).unionByName(s.select((F.col("s_suppkey") * 2 + 1).alias("node"), F.col("s_nationkey").alias("k")))
    return G.modularity(_orders_graph(spark, d), places.join(n, F.col("k") == F.col("n_nationkey")).select("node", F.col("n_regionkey").alias("community")))


def graph_closeness(spark, d):
    """Closeness of every node."""
    return G.path_centralities(_edges(spark, d)).select("node", "closeness")


def betweenness(spark, d):
    """Betweenness of every node."""
    return G.path_centralities(_edges(spark, d)).select("node", "betweenness")


def louvain_communities(spark, d):
    """Communities by local moving."""
    return G.louvain(_edges(spark, d))


def subgraph_1hop(spark, d):
    """Relations of one hop around the nations of region 1."""
    e = _trade(spark, d).select((F.col("u") * 100 + F.col("v")).alias("relation_id"), "u", "v")
    return G.subgraph(e, table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("node")))


def top_centralities(spark, d):
    """The ten nodes of highest degree centrality."""
    return graph_degree(spark, d).orderBy(F.desc("centrality"), "node").limit(10)


def entity_type(spark, d):
    """Entity types of part and nation names with made-up words."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ("winter 1963", "ERA5", "SWG method", "jet stream", "cold spell", "IPCC", "Europe", "x"))), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("name"))
    return names.select("name", G.entity_type(F.col("name")).alias("entity_type"))


def _occurrences(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    entities = spark.createDataFrame([(t, t) for t in TERMS], "entity string, alias string")
    return G.occurrences(docs, entities)


def alias_occurrences(spark, d):
    """Documents in which each gazetteer entry occurs."""
    return _occurrences(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence_edges(spark, d):
    """Pairs of gazetteer entries that share documents, with confidence."""
    return G.cooccurrences(_occurrences(spark, d))


def graph_merge_upsert(spark, d):
    """Merge of changed and new nations into the nation table."""
    old = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = old.where("n_nationkey % 3 = 0").select("n_nationkey", F.concat("n_name", F.lit("*")).alias("n_name")).unionByName(old.where("n_nationkey < 5").select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"))
    return G.upsert(old, new, "n_nationkey")


def graphml_lines(spark, d):
    """GraphML lines of the nations."""
    return G.graphml_nodes(table(spark, d, "nation").select(F.concat("n_name", F.lit(' & "co"')).alias("name"), F.when(F.col("n_regionkey") > 0, "Nation").alias("kind"), F.array("n_nationkey", "n_regionkey").alias("pages")))


def cypher_lines(spark, d):
    """Cypher lines of the nations' regions."""
    kinds = F.element_at(F.array(F.lit("LOCATED_IN"), F.lit("NEAR")), (F.col("n_nationkey") % 2 + 1).cast("int"))
    return G.cypher_edges(table(spark, d, "nation").select(F.concat("n_name", F.lit("'s\nland")).alias("source"), F.concat(F.lit("R\\"), "n_regionkey").alias("target"), kinds.alias("type")))


_T = f"""t AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
b AS (SELECT u, v FROM t UNION ALL SELECT v, u FROM t), dg AS (SELECT u AS node, count(*) AS degree FROM b GROUP BY 1)"""
_E = """t AS (SELECT DISTINCT o_custkey * 2 AS u, l_suppkey * 2 + 1 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT u, v FROM t UNION ALL SELECT v, u FROM t), dg AS (SELECT u AS node, count(*) AS degree FROM b GROUP BY 1)"""
_DEG = "SELECT node, degree, round(degree / ((SELECT count(*) FROM dg) - 1), 8) AS centrality FROM dg"
_BFS = """bfs AS (SELECT DISTINCT u AS s, u AS x, 0 AS dist FROM b UNION SELECT s, b.v, dist + 1 FROM bfs JOIN b ON b.u = bfs.x WHERE dist < 24),
ds AS (SELECT s, x, min(dist) AS dist FROM bfs GROUP BY ALL)"""
_NORM = "trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"
#: Gazetteer entries `e` of a text: acronyms as they stand, others as a part of the normalised text.
FOUND = "CASE WHEN length(e) <= 5 AND upper(e) = e THEN regexp_matches(text, '(^|[^A-Za-z0-9])' || e || '([^A-Za-z0-9]|$)') ELSE contains(nt, ne) END"
GAZETTEER = f"(SELECT e, {_NORM.format(x='e')} AS ne FROM (SELECT unnest({list(TERMS)}) AS e))"
_OCC = f"""oc AS (SELECT doc_id AS chunk_id, e AS entity FROM (SELECT doc_id, text, {_NORM.format(x='text')} AS nt FROM documents), {GAZETTEER} WHERE {FOUND})"""

QUERIES = {
    f.__name__: f
    for f in (trade_edges, graph_degree, graph_density, graph_components, graph_modularity, graph_closeness, betweenness, louvain_communities, subgraph_1hop, top_centralities, entity_type, alias_occurrences,
              cooccurrence_edges, graph_merge_upsert, graphml_lines, cypher_lines)
}

ORACLE_SQL = {
    "trade_edges": f"WITH {_T} SELECT * FROM t",
    "graph_degree": f"WITH {_E} {_DEG}",
    "top_centralities": f"WITH {_E} {_DEG} ORDER BY centrality DESC, node LIMIT 10",
    "graph_density": f"WITH {_E} SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 8) AS density FROM (SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM t) AS edges)",
    "graph_components": f"""WITH RECURSIVE {_E}, r AS (SELECT DISTINCT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "graph_modularity": f"""WITH {_E}, p AS (SELECT node, n_regionkey AS c FROM (SELECT c_custkey * 2 AS node, c_nationkey AS k FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey FROM supplier) JOIN nation ON n_nationkey = k),
      i AS (SELECT a.c, count(*) AS l FROM t JOIN p a ON a.node = u JOIN p z ON z.node = v WHERE a.c = z.c GROUP BY 1),
      k AS (SELECT c, sum(degree) AS d FROM dg JOIN p USING (node) GROUP BY 1), m AS (SELECT count(*) AS m FROM t) SELECT count(*) AS communities, round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 8) AS modularity FROM k LEFT JOIN i USING (c), m""",
    "graph_closeness": f"WITH RECURSIVE {_T}, {_BFS} SELECT s AS node, round((count(*) - 1) / sum(dist) * (count(*) - 1) / ((SELECT count(*) FROM dg) - 1), 8) AS closeness FROM ds GROUP BY s",
    "betweenness": f"""WITH RECURSIVE {_T}, {_BFS}, sg AS (SELECT DISTINCT u AS s, u AS x, 0 AS l, 1.0::DOUBLE AS sigma FROM b UNION ALL
        SELECT s, x, l, sum(sigma) AS sigma FROM (SELECT sg.s, b.v AS x, sg.l + 1 AS l, sg.sigma FROM sg JOIN b ON b.u = sg.x JOIN ds ON ds.s = sg.s AND ds.x = b.v AND ds.dist = sg.l + 1) GROUP BY s, x, l),
      pr AS (SELECT a.s, a.x AS v, c.x AS t, a.sigma * z.sigma / c.sigma AS f FROM sg a JOIN sg c ON c.s = a.s JOIN sg z ON z.s = c.x AND z.x = a.x WHERE a.l + z.l = c.l AND a.x <> a.s AND a.x <> c.x)
      SELECT node, round(coalesce(sum(f), 0) / ((SELECT count(*) FROM dg) - 1) / ((SELECT count(*) FROM dg) - 2), 8)::DOUBLE AS betweenness FROM dg LEFT JOIN pr ON pr.v = node GROUP BY node""",
    "subgraph_1hop": f"""WITH {_T}, o AS (SELECT u * 100 + v AS relation_id, u AS n, v AS o FROM t UNION ALL SELECT u * 100 + v, v, u FROM t),
      f AS (SELECT * FROM o JOIN dg ON dg.node = n WHERE n IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY degree DESC, relation_id, n LIMIT 60) SELECT DISTINCT relation_id, least(n, o) AS u, greatest(n, o) AS v FROM f""",
    "entity_type": "SELECT name, CASE " + " ".join("WHEN " + " OR ".join(f"contains(k, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in G.TYPES) + f""" ELSE 'Concept' END AS entity_type FROM (SELECT name, {_NORM.format(x='name')} AS k FROM
      (SELECT p_name || ' ' || ['winter 1963', 'ERA5', 'SWG method', 'jet stream', 'cold spell', 'IPCC', 'Europe', 'x'][p_partkey % 8 + 1] AS name FROM part))""",
    "alias_occurrences": f"WITH {_OCC} SELECT entity, count(*) AS n FROM oc GROUP BY 1",
    "cooccurrence_edges": f"""WITH {_OCC}, fq AS (SELECT entity, count(*) AS f FROM oc GROUP BY 1), tp AS (SELECT * FROM (SELECT chunk_id, entity, row_number() OVER (PARTITION BY chunk_id ORDER BY f DESC, entity) AS nth FROM oc JOIN fq USING (entity)) WHERE nth <= 10),
      pr AS (SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM tp x JOIN tp y ON x.chunk_id = y.chunk_id AND x.entity < y.entity GROUP BY ALL ORDER BY n DESC, a, b LIMIT 300)
      SELECT rank, a, b, n, round(least(0.9, 0.45 + 0.08 * ln(1 + n)), 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (ORDER BY n DESC, a, b)::INTEGER AS rank FROM pr) WHERE n >= 2""",
    "graph_merge_upsert": """SELECT CASE WHEN k = 1 THEN n_nationkey ELSE n_nationkey + 100 END::INTEGER AS n_nationkey, CASE WHEN k = 1 AND n_nationkey % 3 = 0 THEN n_name || '*' ELSE n_name END AS n_name FROM nation, (VALUES (1), (2)) x(k) WHERE k = 1 OR n_nationkey < 5""",
    "graphml_lines": """SELECT '<node id="' || replace(replace(replace(n_name || ' & "co"', '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '"><data key="entity_type">' || CASE WHEN n_regionkey > 0 THEN 'Nation' ELSE '' END || '</data><data key="pages">' || n_nationkey || '|' || n_regionkey || '</data></node>' AS line FROM nation""",
    "cypher_lines": """SELECT 'MATCH (a {name: ''' || n_name || '\\''s land''}), (b {name: ''R\\\\' || n_regionkey || '''}) MERGE (a)-[:' || CASE WHEN n_nationkey % 2 = 0 THEN 'LOCATED_IN' ELSE 'ASSOCIATED_WITH' END || ']->(b);' AS line FROM nation""",
}
