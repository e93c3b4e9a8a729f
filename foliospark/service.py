"""The library as a service: artifacts built once, then batches of questions answered by one declared plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import chunking, graph, records, retrieval, routing, scoring, vectors
from foliospark.scratch import stage
from foliospark.sources import exports


#: What evaluations leave behind: tables with a column `winner`, but for routing and sync, which have one row.
REPORTS = ("chunking", "embeddings", "retrieval", "routing", "sync")


class Service:
    """Chunks (doc_id, text), entities (entity, alias) and relations (relation_id, u, v) with a table of values (state, action, q).

    Every method returns a DataFrame; a single question is a batch of one row. reports are tables by names of REPORTS.
    """

    def __init__(self, chunks: DataFrame, entities: DataFrame, relations: DataFrame, q_table: DataFrame, reports: dict[str, DataFrame] | None = None) -> None:
        self.chunks, self.entities, self.relations, self.q_table = chunks, entities, relations, q_table
        self.initial, self.reports = q_table, dict(reports or {})
        if not set(self.reports) <= set(REPORTS):
            raise ValueError(f"reports are {REPORTS}")

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def health(self) -> DataFrame:
        """One row of counts."""
        parts = [f.agg(F.count(F.lit(1)).alias(n)) for n, f in (("chunks", self.chunks), ("entities", self.entities), ("relations", self.relations), ("q_values", self.q_table))]
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)  # one row each
        return out

    def report(self, name: str) -> DataFrame:
        """A report of an evaluation; an error if that has not run."""
        if name not in self.reports:
            raise ValueError(f"no report on {name}")
        return self.reports[name]

    def chunking(self) -> DataFrame:
        return self.report("chunking")

    def embeddings(self) -> DataFrame:
        return self.report("embeddings")

    def evaluate(self, questions: DataFrame, evidence: DataFrame, path: str | None = None) -> None:
        """Run all chunkings and representations over the chunks for questions (query_id, text) with evidence (query_id, doc_id), compare vectors, BM25 and their fusion, and keep the reports."""
        self.reports["chunking"] = chunking.run_chunking(self.chunks, questions, evidence)
        self.reports["embeddings"] = vectors.run_embeddings(self.chunks, questions, evidence, path)
        self.reports["retrieval"] = self.compare(questions, evidence)

    def compare(self, questions: DataFrame, evidence: DataFrame) -> DataFrame:
        """(method, measures at five, winner) of the two whole rankings; the best by F1, then MAP, then name, wins."""
        spark, rows = self.spark, []
        dense = vectors.text_scorers(self.chunks, questions, "word")
        for method, scorers in (("bm25", retrieval.bm25_scorers(self.chunks, questions)), ("vector", dense)):
            m = retrieval.macro(retrieval.ir_metrics(retrieval.relevant_ranks(spark, scorers, questions, evidence), 5)).first()
            rows.append((method, *(float(m[c]) for c in ("f1_at_k", "map", "mrr", "ndcg_at_k"))))
        best = max(rows, key=lambda r: (r[1], r[2], r[0] == "bm25"))
        return spark.createDataFrame([(*r, r is best) for r in rows], "method string, f1_at_k double, map double, mrr double, ndcg_at_k double, winner boolean")

    def vectorial(self) -> DataFrame:
        """One row: the winners of the evaluations that have run (null otherwise), the number of chunks and the dimension of the winning representation."""
        out = self.chunks.agg(F.count(F.lit(1)).alias("chunks"))
        for name in ("chunking", "embeddings", "retrieval"):
            won = F.lit(None).cast("string").alias(f"{name}_winner")
            size = [F.lit(None).cast("int").alias("dimension")] if name == "embeddings" else []
            if name not in self.reports:
                out = out.select("*", won, *size)
                continue
            if size and "dimension" in self.reports[name].columns:
                size = [F.min("dimension").cast("int").alias("dimension")]
            out = out.crossJoin(self.reports[name].where("winner").agg(F.min("method").alias(f"{name}_winner"), *size))  # one row each
        return out

    def plot(self, query: str | None = None, k: int = 5) -> DataFrame:
        """(doc_id, x, y, excerpt, nearest): two components of the chunks' vectors of hashed words, the k nearest to a query marked."""
        v = chunking.encoded(self.chunks.select("doc_id", "text")).select("doc_id", "embedding")
        asked = None if query is None else [float(x) for x in chunking._sentence_vectors([query])[0]]  # noqa: SLF001
        return vectors.plot_payload(v, self.chunks, asked, k)

    def graph(self) -> DataFrame:
        """(kind, id, u, v, degree): nodes with their degrees, then relations."""
        nodes = graph.both_ways(self.relations).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
        none = F.lit(None).cast("string")
        out = nodes.select(F.lit("node").alias("kind"), F.col("u").cast("string").alias("id"), none.alias("u"), none.alias("v"), "degree")
        return out.unionByName(self.relations.select(F.lit("relation").alias("kind"), *[F.col(a).cast("string").alias(b) for a, b in (("relation_id", "id"), ("u", "u"), ("v", "v"))], F.lit(None).cast("long").alias("degree")))

    def graph_status(self) -> DataFrame:
        """One row of distinct counts of the stored graph; connected is whether there is one."""
        nodes = graph.both_ways(self.relations).agg(F.countDistinct("u").alias("nodes"))
        kept = self.relations.agg(F.countDistinct("relation_id").alias("relations"))
        named = self.entities.agg(F.countDistinct("entity").alias("entities"), F.countDistinct("alias").alias("aliases"))
        return nodes.crossJoin(kept).crossJoin(named).withColumn("connected", F.col("nodes") > 0)  # one row each

    def evaluation(self) -> DataFrame:
        """(report, row): every row of every report as JSON."""
        out = self.spark.createDataFrame([], "report string, row string")
        for name in sorted(self.reports):
            out = out.unionByName(self.reports[name].select(F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("row")))
        return out

    def retrieve(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Hits of questions (query_id, text) by vectors (hashed words and pairs), by BM25, and by the fusion of both whole rankings, side by side."""
        spark = self.chunks.sparkSession
        lexical = retrieval.bm25_scorers(self.chunks, questions)
        dense = vectors.text_scorers(self.chunks, questions, "word")
        parts = [(retrieval.ranked(scoring.top(spark, x, k), k), name) for x, name in ((dense, "vector"), (lexical, "bm25"))]
        parts.append((retrieval.hybrid(spark, dense, lexical, k), "hybrid_rrf"))
        out = None
        for ranking, method in parts:
            hits = records.chunk_result(ranking, self.chunks, method)
            out = hits if out is None else out.unionByName(hits)
        return out

    def subgraph(self, names: DataFrame | None = None) -> DataFrame:
        return graph.subgraph(self.relations, names)

    def graph_metrics(self) -> DataFrame:
        return graph.density(graph.simple(self.relations))

    def communities(self) -> DataFrame:
        return graph.louvain(graph.simple(self.relations))

    def policy(self) -> DataFrame:
        return routing.greedy(self.q_table)

    def answer(self, questions: DataFrame, predicted: F.Column | None = None) -> DataFrame:
        """Route, retrieve and answer questions (question_id, question): action, confidences, relations found and the answer."""
        vocabulary = scoring.word_counts(self.chunks.select(F.lower("text").alias("terms")), "token").select("term").where(F.length("term") >= 3)
        aliases = [r["alias"] for r in self.entities.select("alias").distinct().collect()]
        f = routing.with_features(questions, vocabulary, aliases, F.lit("semantic") if predicted is None else predicted)
        f = f.join(self.policy(), "state", "left").withColumn("action", F.coalesce("action", F.lit("abstain")))
        f = stage(f, "routed")  # read by every block of questions
        asked = f.where(F.col("action").isin("use_vector", "use_hybrid")).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
        hits = retrieval.share_of_best(retrieval.bm25(self.chunks, asked, 1)).join(self.chunks.select("doc_id", F.substring("text", 1, records.EXCERPT).alias("excerpt")), "doc_id")
        named = records.entity_names(questions, self.entities).select("question_id", F.explode("names").alias("name"))
        ends = graph.both_ways(self.relations).groupBy("u").agg(F.count(F.lit(1)).alias("k"))
        found = named.join(ends, F.col("name") == F.col("u").cast("string")).groupBy("question_id").agg(F.least(F.lit(60), F.sum("k")).alias("relations"))
        f = f.join(hits.select(F.col("query_id").alias("question_id"), "doc_id", "share", "excerpt"), "question_id", "left").join(found, "question_id", "left")
        context = routing.context_confidence(F.col("action"), F.col("share"), F.col("relations"))
        place = F.array_position(F.array(*map(F.lit, routing.ACTIONS)), F.col("action"))
        values = self.q_table.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "q"))), lambda x: x["q"]).alias("q_values"))
        f = f.drop("q").join(values, "state", "left").withColumn("context_confidence", F.round(context, 6))
        text = routing.answer(F.col("action"), F.col("estimated_type"), F.lit(0.0), F.lit(None).cast("string"), F.col("context_confidence"), F.col("excerpt"))
        sure = routing.final_confidence(F.coalesce("q_values", F.array(*[F.lit(0.0)] * 4)), F.col("action"), F.col("context_confidence"))
        return f.select("question_id", "state", "action", "doc_id", F.coalesce("relations", F.lit(0)).cast("long").alias("relations"), "context_confidence", sure.alias("confidence"), text.alias("answer"))

    def feedback(self, events: DataFrame) -> None:
        """Fold feedback (event_id, ts, state, action, reward) into the table of values."""
        from foliospark.streaming.feedback import merge

        self.q_table = merge(self.q_table.withColumn("n", F.lit(0).cast("long")), events).select("state", "action", "q")

    def reset(self) -> None:
        self.q_table = self.initial

    def history(self, asked: DataFrame, most: int = 50) -> DataFrame:
        """The latest questions (question_id, asked_at), newest first."""
        return asked.orderBy(F.desc("asked_at"), F.desc("question_id")).limit(most)

    def save(self, path: str) -> None:
        for name in ("chunks", "entities", "relations", "q_table"):
            exports.build(self.spark, f"{path}/{name}", lambda n=name: getattr(self, n), force=True)
        for name, report in self.reports.items():
            exports.build(self.spark, f"{path}/reports/{name}", lambda r=report: r, force=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Service:
        reports = {n: spark.read.parquet(f"{path}/reports/{n}") for n in REPORTS if exports.exists(spark, f"{path}/reports/{n}")}
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("chunks", "entities", "relations", "q_table")), reports)
