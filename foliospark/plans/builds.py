"""Queries of graph builds, layout checks and representations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import graph as G
from foliospark.operators import layout as L
from foliospark.operators import vectors as V
from foliospark.plans import graphs, structures
from foliospark.sources import table


def _nations(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def canonical_catalogue(spark, d):
    """Canonical name of every key: short forms of nations with their names, then regions, nations in other spelling, and brands as first mentioned."""
    n, r, p = (table(spark, d, t) for t in ("nation", "region", "part"))
    acronyms = n.select(F.col("n_nationkey").alias("pos"), F.substring("n_name", 1, 3).alias("acronym"), F.col("n_name").alias("expanded"), F.col("n_regionkey").alias("page"))
    said = r.select(F.col("r_regionkey").cast("long").alias("pos"), F.initcap("r_name").alias("value")).unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("pos"), F.lower("n_name").alias("value")))
    said = said.unionByName(p.select((F.col("p_partkey") + 1000).cast("long").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("value")))
    return G.catalogue(acronyms, said)[1]


def graph_nodes(spark, d):
    """Ends of the relations between nations and regions, and gazetteer entries that occur in documents."""
    rel = _nations(spark, d).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return G.node_set(rel, graphs._occurrences(spark, d))


def relation_counts(spark, d):
    """Orders by priority and by status, counted as relations by type and method."""
    return G.relation_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("method")))


def graph_rollup(spark, d):
    """Sizes, density, components, modularity and the ten central nodes of the trade between nations, its communities being regions."""
    part = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    r = G.rollup(graphs._edges(spark, d), part)
    return r.withColumn("sizes", F.array_join("sizes", ",")).withColumn("top_centrality", F.array_join("top_centrality", ","))


def _relations(spark, d):
    return _nations(spark, d).select(F.concat(F.lit("r"), "n_nationkey").alias("relation_id"), F.col("n_name").alias("source"), F.concat(F.lit("R&"), "r_name").alias("target"), F.lit("LOCATED_IN").alias("type"), (F.col("n_nationkey") % 3 == 0).cast("int").alias("confidence"))


def _graph_nodes(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("it's "), "n_name").alias("label"), F.lit("Location").alias("kind"), F.array("n_regionkey").alias("pages"))


def graphml_file(spark, d):
    """The lines of a GraphML file of nations and their regions, with the part that each belongs to."""
    return G.graphml(_graph_nodes(spark, d), _relations(spark, d))


def cypher_file(spark, d):
    """The lines of a Cypher script of nations and their regions, with the part that each belongs to."""
    return G.cypher(_graph_nodes(spark, d), _relations(spark, d))


def multiline_blocks(spark, d):
    """Whether each document's text holds several lines."""
    return table(spark, d, "documents").select("doc_id", L.is_multiline(F.col("text")).alias("multiline"))


def double_columns(spark, d):
    """The check of columns on every page of derived blocks."""
    blocks = structures._blocks(spark, d)
    ordered = L.reading_order(L.naive_order(blocks), L.layouts(blocks))
    return L.double_column_check(ordered, structures.WIDTH)


def layout_samples(spark, d):
    """A witness document of each range of numbers, by layouts and switches made from the number."""
    k = F.col("doc_id")
    layout = F.element_at(F.array(*map(F.lit, ("single_column", "double_column", "mixed_layout", "figure_or_sparse"))), (F.floor(k / 50) % 4 + 1).cast("int"))
    pages = table(spark, d, "documents").select(k.alias("page"), layout.alias("layout"), (k % 11).alias("switches_naive"), F.when(k % 5 == 0, F.concat("text", F.lit(" doi.org doi.org doi.org doi.org"))).otherwise(F.col("text")).alias("text"))
    ranges = spark.createDataFrame([("a", 0, 49), ("b", 30, 120), ("c", 150, 199), ("d", 160, 160), ("e", -5, -1)], "label string, first int, last int")
    return L.layout_samples(pages, ranges)


def embedding_run(spark, d):
    """Three representations of all documents measured for the benchmark passages; the time is left out of the result, which is otherwise the same on every run but for its twentieth of the score."""
    from foliospark.plans.retrieval import _relevance

    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.run_embeddings(docs, items, _relevance(spark, d)).drop("encoding_seconds")


def embedding_score(spark, d):
    """The weighted score of a representation on measures made from order lines."""
    li = table(spark, d, "lineitem")
    avg = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    m = li.groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("method")).agg(avg("l_discount", "f1_at_k"), avg("l_tax", "map"), avg("l_discount", "mrr"), avg("l_tax", "ndcg_at_k"), F.count(F.lit(1)).cast("double").alias("encoding_seconds"))
    return V.selection(m).select("method", "selection_score", "winner")


def plot_points(spark, d):
    """Two components of every vector, the document of its number, and whether it is among the nearest to the first vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return V.plot_payload(v, table(spark, d, "documents").select("doc_id", "text"), v.where("doc_id = 0").first()["embedding"])


QUERIES = {
    f.__name__: f
    for f in (canonical_catalogue, graph_nodes, relation_counts, graph_rollup, graphml_file, cypher_file, multiline_blocks, double_columns, layout_samples, embedding_run, embedding_score, plot_points)
}

_N = graphs._NORM
_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
_SCALE = "CASE WHEN max(x) OVER () = min(x) OVER () THEN 1.0 ELSE (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END"

ORACLE_SQL = {
    "canonical_catalogue": f"""WITH f AS (SELECT n_nationkey, substr(n_name, 1, 3) AS short, unnest([substr(n_name, 1, 3), n_name]) AS form, unnest([0, 1]) AS i FROM nation),
      a AS (SELECT {_N.format(x='form')} AS key, arg_max(short, n_nationkey * 2 + i) AS name FROM f GROUP BY 1),
      s AS (SELECT r_regionkey AS pos, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS value FROM region UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation UNION ALL SELECT p_partkey + 1000, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END FROM part),
      m AS (SELECT {_N.format(x='value')} AS key, arg_min(value, pos) AS name FROM s GROUP BY 1)
      SELECT key, name FROM a UNION ALL SELECT key, name FROM m WHERE key NOT IN (SELECT key FROM a)""",
    "graph_nodes": f"WITH {graphs._OCC} SELECT n_name AS name FROM nation UNION SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT entity FROM oc",
    "relation_counts": "SELECT 'type' AS field, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'method', o_orderstatus, count(*) FROM orders GROUP BY ALL",
    "graph_rollup": f"""WITH RECURSIVE {graphs._T}, r AS (SELECT DISTINCT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen), cp AS (SELECT node, min(seen) AS c FROM r GROUP BY 1), sz AS (SELECT c, count(*) AS n FROM cp GROUP BY 1),
      p AS (SELECT n_nationkey AS node, n_regionkey AS c FROM nation), i AS (SELECT a.c, count(*) AS l FROM t JOIN p a ON a.node = u JOIN p z ON z.node = v WHERE a.c = z.c GROUP BY 1), k AS (SELECT c, sum(degree) AS d FROM dg JOIN p USING (node) GROUP BY 1), m AS (SELECT count(*) AS m FROM t),
      g AS (SELECT count(*) AS communities, round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 8) AS modularity FROM k LEFT JOIN i USING (c), m), x AS (SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM t) AS edges)
      SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 8) AS density, (SELECT count(*) FROM sz) AS components, (SELECT string_agg(n::VARCHAR, ',' ORDER BY n DESC) FROM sz) AS sizes, communities, modularity,
        (SELECT string_agg(node::VARCHAR, ',' ORDER BY degree DESC, node) FROM (SELECT * FROM dg ORDER BY degree DESC, node LIMIT 10)) AS top_centrality FROM x, g""",
    "graphml_file": f"""SELECT 0 AS part, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<key id="entity_type" for="node" attr.name="entity_type" attr.type="string"/>' || chr(10) || '<key id="pages" for="node" attr.name="pages" attr.type="string"/>' || chr(10) ||
        '<key id="type" for="edge" attr.name="type" attr.type="string"/>' || chr(10) || '<key id="confidence" for="edge" attr.name="confidence" attr.type="string"/>' || chr(10) || '<graph edgedefault="directed">' AS line
      UNION ALL SELECT 1, '<node id="' || {_ESC('n_name')} || '"><data key="entity_type">Location</data><data key="pages">' || n_regionkey || '</data></node>' FROM nation
      UNION ALL SELECT 2, '<edge id="r' || n_nationkey || '" source="' || {_ESC('n_name')} || '" target="R&amp;' || {_ESC('r_name')} || '"><data key="type">LOCATED_IN</data><data key="confidence">' || (n_nationkey % 3 = 0)::INT || '</data></edge>' FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 3, '</graph>' || chr(10) || '</graphml>'""",
    "cypher_file": """SELECT 0 AS part, 'CREATE CONSTRAINT entity_name IF NOT EXISTS FOR (e:Entity) REQUIRE e.name IS UNIQUE;' AS line
      UNION ALL SELECT 1, 'MERGE (n:Entity {name: ''' || n_name || '''}) SET n.label = ''it\\''s ' || n_name || ''', n.entity_type = ''Location'';' FROM nation
      UNION ALL SELECT 2, 'MATCH (a {name: ''' || n_name || '''}), (b {name: ''R&' || r_name || '''}) MERGE (a)-[:LOCATED_IN]->(b);' FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "multiline_blocks": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_full_match(trim(x), '[0-9]{1,4}'))) > 1 AS multiline FROM documents",
    "layout_samples": """WITH p AS (SELECT doc_id AS page, ['single_column', 'double_column', 'mixed_layout', 'figure_or_sparse'][(doc_id // 50 % 4 + 1)::INT] AS layout, doc_id % 11 AS sw, CASE WHEN doc_id % 5 = 0 THEN text || ' doi.org doi.org doi.org doi.org' ELSE text END AS t FROM documents),
      r AS (SELECT * FROM (VALUES ('a', 0, 49), ('b', 30, 120), ('c', 150, 199), ('d', 160, 160), ('e', -5, -1)) v(label, lo, hi)),
      j AS (SELECT label, page, layout IN ('double_column', 'mixed_layout') AS two, layout <> 'figure_or_sparse' AS real, (length(t) - length(replace(t, 'doi.org', ''))) / 7 < 4 AS prose, sw, length(t) AS size FROM p JOIN r ON page BETWEEN lo AND hi)
      SELECT label, page, two AS two_columns FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY two DESC, real DESC, prose DESC, CASE WHEN two THEN sw ELSE 0 END DESC, size DESC, page) AS n FROM j) WHERE n = 1""",
    "embedding_score": f"""WITH m AS (SELECT l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS method, round(avg(l_discount::DOUBLE), 6) AS f, round(avg(l_tax::DOUBLE), 6) AS t, count(*)::DOUBLE AS x FROM lineitem GROUP BY 1),
      s AS (SELECT method, f, round(0.3 * f + 0.25 * t + 0.2 * f + 0.2 * t + 0.05 * (1 - {_SCALE}), 6)::DOUBLE AS selection_score FROM m) SELECT method, selection_score, row_number() OVER (ORDER BY selection_score DESC, f DESC, method) = 1 AS winner FROM s""",
}
