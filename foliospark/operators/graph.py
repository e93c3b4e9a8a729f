"""Entity graph: occurrences, relations, and analytics of the simple undirected graph of an edge table (u, v).

Analytics that need paths hold the graph in memory of each task and spread the sources over tasks; they
refuse graphs of more than MOST_EDGES edges. The others are joins and aggregates of any size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import normalize_text
from foliospark.operators.components import connected_components

MOST_EDGES = 200_000
# Parts of a normalised name, in order of precedence, and the entity type they tell.
TYPES = [
    ("Location", ("france", "europe", "siberia", "greenland", "azores", "iceland")), ("Period", ("1963", "january", "february", "winter")), ("Dataset", ("cmip", "era5", "dataset")),
    ("Method", ("swg", "method", "adjustment", "boosting", "sampling", "generator")), ("AtmosphericPattern", ("nao", "blocking", "jet", "circulation", "vortex", "amplification")),
    ("ClimateEvent", ("cold", "warming", "spell", "wave", "event")), ("Organization", ("wmo", "noaa", "ipcc", "ecmwf")),
]
# Relation types that have a name of their own; all others are associations.
RELATIONS = ("ASSOCIATED_WITH", "CO_OCCURS_WITH", "INFLUENCES", "CAUSES", "USES", "LOCATED_IN", "OCCURRED_DURING", "AFFECTS")


def entity_type(name: Column) -> Column:
    low, out = normalize_text(name), None
    for kind, words in TYPES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Concept")


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (u < v) without loops."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): centrality is degree over the other nodes."""
    d = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.try_divide(F.col("degree"), F.col("n") - 1), 8).alias("centrality"))  # n is one row


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density."""
    d = both_ways(edges).agg(F.count_distinct("u").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    return d.select("nodes", "edges", F.round(F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 8).alias("density"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component."""
    return connected_components(edges).withColumnRenamed("root", "component")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: modularity of partition (node, community) over simple edges: sum of inner share less squared degree share."""
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    named = edges.join(partition.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(partition.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    inner = named.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    d = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("k")).join(partition, "node").groupBy("community").agg(F.sum("k").alias("d"))
    per = d.join(inner, "community", "left").crossJoin(F.broadcast(m))
    part = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return per.agg(F.count(F.lit(1)).alias("communities"), F.round(F.sum(part), 8).alias("modularity"))


def _adjacency(edges: DataFrame) -> dict:
    rows = edges.limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"path analytics take at most {MOST_EDGES} edges")
    out: dict = {}
    for r in rows:
        out.setdefault(r["u"], []).append(r["v"])
        out.setdefault(r["v"], []).append(r["u"])
    return {k: sorted(v) for k, v in out.items()}


def path_centralities(edges: DataFrame) -> DataFrame:
    """(node, closeness, betweenness): closeness scaled by the share of nodes reached, betweenness by shortest-path counts over pairs.

    Every task takes some sources and walks the whole graph from each, breadth first; dependencies are added
    up by node.
    """
    spark, near = edges.sparkSession, _adjacency(edges)
    n = len(near)
    sources = spark.createDataFrame([(x,) for x in sorted(near)], edges.select(F.col("u").alias("node")).schema)
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, close, between = [], [], []
            for s in batch.column(0).to_pylist():
                distance, paths, before, order = {s: 0}, {s: 1.0}, {s: []}, []
                queue = deque([s])
                while queue:
                    x = queue.popleft()
                    order.append(x)
                    for y in near[x]:
                        if y not in distance:
                            distance[y], paths[y], before[y] = distance[x] + 1, 0.0, []
                            queue.append(y)
                        if distance[y] == distance[x] + 1:
                            paths[y] += paths[x]
                            before[y].append(x)
                share = dict.fromkeys(order, 0.0)
                for y in reversed(order):
                    for x in before[y]:
                        share[x] += paths[x] / paths[y] * (1 + share[y])
                total, reached = sum(distance.values()), len(order) - 1
                nodes += order
                close += [reached / total * reached / (n - 1) if x == s and total else 0.0 for x in order]
                between += [0.0 if x == s else share[x] for x in order]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field(0).type), pa.array(close, pa.float64()), pa.array(between, pa.float64())], names=["node", "c", "b"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    parts = sources.repartition(8).mapInArrow(run, StructType([StructField("node", kind), StructField("c", DoubleType()), StructField("b", DoubleType())]))
    pairs = float(max(1, (n - 1) * (n - 2)))
    return parts.groupBy("node").agg(F.round(F.sum("c"), 8).alias("closeness"), F.round(F.sum("b") / pairs, 8).alias("betweenness"))


def louvain(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community): local moving by modularity gain on graphs of at most MOST_EDGES edges, then merging, repeated while it gains.

    Nodes move in order and ties go to the least community, so the result is one for one graph.
    """
    near = _adjacency(edges)
    weights = {u: dict.fromkeys(vs, 1.0) for u, vs in near.items()}
    loops = dict.fromkeys(weights, 0.0)
    member = {u: u for u in weights}
    total = sum(sum(w.values()) for w in weights.values()) / 2 or 1.0
    for _ in range(rounds):
        community = {u: u for u in weights}
        degree = {u: sum(w.values()) + 2 * loops[u] for u, w in weights.items()}
        volume, moved, any_move = dict(degree), True, False
        while moved:
            moved = False
            for u in sorted(weights):
                links: dict = {}
                for v, w in weights[u].items():
                    links[community[v]] = links.get(community[v], 0.0) + w
                old = community[u]
                volume[old] -= degree[u]
                gain = lambda c: links.get(c, 0.0) - degree[u] * volume[c] / (2 * total)  # noqa: B023, E731
                best = max(sorted({*links, old}), key=lambda c: (round(gain(c), 12), c == old))
                community[u] = best
                volume[best] += degree[u]
                if best != old:
                    moved = any_move = True
        if not any_move:
            break
        least: dict = {}
        for u in sorted(weights):
            least.setdefault(community[u], u)
        member = {x: least[community[c]] for x, c in member.items()}
        merged: dict = {c: {} for c in least.values()}
        inner = dict.fromkeys(merged, 0.0)
        for u, ws in weights.items():
            a = least[community[u]]
            inner[a] += loops[u]
            for v, w in ws.items():
                b = least[community[v]]
                if a == b:
                    inner[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        weights, loops = merged, inner
    smallest: dict = {}
    for x in sorted(member):
        smallest.setdefault(member[x], x)
    spark = edges.sparkSession
    from pyspark.sql.types import StructField, StructType

    kind = edges.schema["u"].dataType
    return spark.createDataFrame([(x, smallest[c]) for x, c in sorted(member.items())], StructType([StructField("node", kind), StructField("community", kind)]))


def subgraph(edges: DataFrame, names: DataFrame | None = None, limit: int = 60) -> DataFrame:
    """Relations (relation_id, u, v) of one hop around names (node; all nodes if None): the first `limit` oriented rows by falling degree of the start and id, each relation once."""
    oriented = edges.select("relation_id", F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select("relation_id", F.col("v").alias("n"), F.col("u").alias("o")))
    degree = oriented.groupBy("n").agg(F.count(F.lit(1)).alias("degree"))
    if names is not None:
        oriented = oriented.join(names.select(F.col("node").alias("n")).distinct(), "n", "left_semi")
    first = oriented.join(degree, "n").orderBy(F.desc("degree"), "relation_id", "n").limit(limit)
    return first.select("relation_id", F.least("n", "o").alias("u"), F.greatest("n", "o").alias("v")).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merge by key: all new rows, and the old rows whose key is not new. Of several new rows of one key the greatest by all columns stays."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in new.columns])
    latest = new.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return latest.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


ALIASES = 200_000  # aliases of one pass over the chunks
ACRONYM = 5  # characters up to which an upper-case alias is an acronym


def is_acronym(alias: str) -> bool:
    return len(alias) <= ACRONYM and alias.upper() == alias


def occurrences(chunks: DataFrame, entities: DataFrame, block: int = ALIASES) -> DataFrame:
    """(chunk_id, entity): entities (entity, alias) that occur in chunks (chunk_id, text).

    An acronym occurs where it stands in the text as written, without a letter or digit beside it; any other
    alias where its normalised form is part of the normalised text. A pattern automaton over at most `block`
    aliases reads every text once, whatever their number and length. An alias without a normalised form, a
    null one too, occurs nowhere.
    """
    named = entities.where("entity is not null and alias is not null").select("entity", "alias", normalize_text(F.col("alias")).alias("plain")).distinct()
    n, out = max(1, -(-named.count() // block)), None
    kinds = [chunks.schema["chunk_id"], entities.schema["entity"]]
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(normalize_text(F.col("text")), F.lit("")).alias("plain"))
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField("chunk_id", kinds[0].dataType), StructField("entity", kinds[1].dataType)])
    for k in range(n):
        rows = [tuple(r) for r in (named.where(F.pmod(F.xxhash64("alias"), F.lit(n)) == k) if n > 1 else named).collect()]

        def run(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            exact, plain = {}, {}
            for entity, alias, normal in rows:
                if is_acronym(alias):
                    exact.setdefault(alias, set()).add(entity)
                elif normal:
                    plain.setdefault(normal, set()).add(entity)
            machines = []
            for table in (exact, plain):
                machine = ahocorasick.Automaton()
                for word, owners in table.items():
                    machine.add_word(word, (len(word), owners))
                if table:
                    machine.make_automaton()
                machines.append(machine if table else None)
            beside = lambda c: c.isascii() and c.isalnum()
            for batch in batches:
                at, found = [], []
                for i, (text, normal) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    here: set = set()
                    if machines[0] is not None:
                        for end, (size, owners) in machines[0].iter(text):
                            if not beside(text[end - size] if end >= size else "") and not beside(text[end + 1 : end + 2]):
                                here |= owners
                    if machines[1] is not None:
                        for _, (_, owners) in machines[1].iter(normal):
                            here |= owners
                    at += [i] * len(here)
                    found += sorted(here, key=str)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, _arrow(kinds[1].dataType))], names=["chunk_id", "entity"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def catalogue(acronyms: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities (name, label, entity_type, aliases, pages), aliases (key, name)).

    acronyms (pos, acronym, expanded, page): the acronym names the entity, and of one key or one acronym the last row
    counts. mentions (pos, value): names of questions' entities and relations' ends; one whose normalised key is
    known is that entity, any other names itself, as first written.
    """
    forms = acronyms.select("acronym", F.posexplode(F.array("acronym", "expanded")).alias("nth", "alias"), "pos").where("alias is not null")
    known = forms.groupBy(normalize_text(F.col("alias")).alias("key")).agg(F.max_by("acronym", F.struct("pos", "nth")).alias("name"))
    said = mentions.where("value is not null").groupBy(normalize_text(F.col("value")).alias("key")).agg(F.min_by("value", "pos").alias("value"))
    new = said.join(known, "key", "left_anti").select("key", F.col("value").alias("name"))
    aliases = known.unionByName(new)
    last = acronyms.groupBy("acronym").agg(F.max_by(F.struct("expanded", "page"), "pos").alias("x"))
    short = last.select(F.col("acronym").alias("name"), F.col("x.expanded").alias("label"), entity_type(F.concat_ws(" ", "acronym", "x.expanded")).alias("entity_type"), F.array("acronym", "x.expanded").alias("aliases"), F.array_compact(F.array("x.page")).alias("pages"))
    plain = new.join(short.select("name"), "name", "left_anti").groupBy("name").agg(F.lit(1).alias("_"))
    plain = plain.select("name", F.col("name").alias("label"), entity_type(F.col("name")).alias("entity_type"), F.array("name").alias("aliases"), F.array().cast("array<int>").alias("pages"))
    return short.select("name", "label", "entity_type", "aliases", F.col("pages").cast("array<int>")).unionByName(plain), aliases


def node_set(relations: DataFrame, occurrence: DataFrame) -> DataFrame:
    """(name): ends of relations (source, target), and entities that occur."""
    return relations.select(F.col("source").alias("name")).union(relations.select("target")).union(occurrence.select("entity")).where("name is not null").distinct()


def relation_counts(relations: DataFrame) -> DataFrame:
    """(field, value, n) of relations (type, method)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("type", "method")])).alias("p")
    return relations.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def rollup(edges: DataFrame, partition: DataFrame, centralities: list[str] | None = None) -> DataFrame:
    """One row: nodes, edges, density, components, sizes (falling), communities, modularity, and the ten nodes of highest degree centrality.

    edges are simple (u, v), partition is (node, community). With names among ('closeness', 'betweenness') their ten
    highest are added, on graphs that path analytics take.
    """
    sizes = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.agg(F.count(F.lit(1)).alias("components"), F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 1000).alias("sizes"))
    out = density(edges).crossJoin(parts).crossJoin(modularity(edges, partition))  # one row each

    def ten(frame: DataFrame, value: str) -> DataFrame:
        best = frame.orderBy(F.desc(value), "node").limit(10)
        return best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), "node"))), lambda x: x["node"]).alias(f"top_{value}"))

    out = out.crossJoin(ten(degrees(edges), "centrality"))
    for name in centralities or []:
        out = out.crossJoin(ten(path_centralities(edges), name))
    return out


def graphml(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, line) of a whole GraphML file of nodes (name, kind, pages) and relations (relation_id, source, target, type, confidence); parts in order make the file."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    keys = [("node", "entity_type"), ("node", "pages"), ("edge", "type"), ("edge", "confidence")]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{name}" for="{kind}" attr.name="{name}" attr.type="string"/>' for kind, name in keys), '<graph edgedefault="directed">']
    frame = lambda part, lines: spark.createDataFrame([(part, "\n".join(lines))], "part int, line string")
    edge = F.concat(F.lit('<edge id="'), esc(F.col("relation_id")), F.lit('" source="'), esc(F.col("source")), F.lit('" target="'), esc(F.col("target")), F.lit('"><data key="type">'), esc(F.col("type")), F.lit('</data><data key="confidence">'), esc(F.col("confidence")), F.lit("</data></edge>"))
    return frame(0, head).union(graphml_nodes(nodes).select(F.lit(1), "line")).union(relations.select(F.lit(2), edge)).union(frame(3, ["</graph>", "</graphml>"]))


def cypher(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, line) of a whole Cypher script: the constraint, a MERGE per node (name, label, kind), and one per relation (source, target, type)."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit(" ")), F.lit("'"))
    first = nodes.sparkSession.createDataFrame([(0, "CREATE CONSTRAINT entity_name IF NOT EXISTS FOR (e:Entity) REQUIRE e.name IS UNIQUE;")], "part int, line string")
    node = F.concat(F.lit("MERGE (n:Entity {name: "), q(F.col("name")), F.lit("}) SET n.label = "), q(F.col("label")), F.lit(", n.entity_type = "), q(F.col("kind")), F.lit(";"))
    return first.union(nodes.select(F.lit(1), node)).union(cypher_edges(relations).select(F.lit(2), "line"))


def cooccurrences(occurrence: DataFrame, per_chunk: int = 10, most: int = 300, least: int = 2) -> DataFrame:
    """(rank, a, b, n, confidence): pairs of the most frequent entities of each chunk, of the `most` first pairs those seen `least` times."""
    total = occurrence.groupBy("entity").agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("f"), "entity")
    top = occurrence.join(total, "entity").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_chunk)  # bounds the pairs of a chunk
    sets = top.groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity")).alias("e"))
    pairs = sets.select(F.explode("e").alias("a"), "e").select("a", F.explode(F.filter("e", lambda x: x > F.col("a"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b").limit(most)
    ranked = counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "a", "b")))  # at most `most` rows
    return ranked.where(F.col("n") >= least).select("rank", "a", "b", "n", F.round(F.least(F.lit(0.9), 0.45 + 0.08 * F.log1p("n")), 6).alias("confidence"))


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """GraphML node lines of nodes (name, kind, pages array): lists joined by a bar, nulls empty."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), "|")
    return nodes.select(F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('"><data key="entity_type">'), esc(F.col("kind")), F.lit('</data><data key="pages">'), F.coalesce(pages, F.lit("")), F.lit("</data></node>")).alias("line"))


def cypher_edges(relations: DataFrame) -> DataFrame:
    """Cypher lines of relations (source, target, type): strings escaped, unknown types as associations."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit(" ")), F.lit("'"))
    kind = F.when(F.col("type").isin(*RELATIONS), F.col("type")).otherwise("ASSOCIATED_WITH")
    return relations.select(F.concat(F.lit("MATCH (a {name: "), q(F.col("source")), F.lit("}), (b {name: "), q(F.col("target")), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);")).alias("line"))
