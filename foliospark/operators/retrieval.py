"""Ranking and its evaluation: postings, BM25, exact vector search, rank fusion, information-retrieval metrics.

Scores are rounded to six digits and ties go to the smaller id, so every ranking has one order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import TOKEN, tokens  # noqa: F401
from foliospark.operators import scoring as S
from foliospark.operators.scoring import QUERY_BLOCK
from foliospark.scratch import discard, stage

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Stands for a frequency weight of zero, that a shared term of no weight still be one.
LEAST_IDF = 1e-30


def ranked(scores: DataFrame, k: int | None, query: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds rank by falling score, then id; keeps the first k of each query."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(doc))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25_terms(docs: DataFrame, queries: DataFrame) -> tuple[S.TextTerms, np.ndarray]:
    """(terms, idf): the questions' words that docs hold, the frequent ones first, with their BM25 weights, and their inverse frequencies."""
    texts = docs.select(F.lower("text").alias("terms"))
    words = stage(S.word_counts(texts, "token"), "frequencies")
    n, total = docs.count(), words.agg(F.sum("total")).first()[0] or 0
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    low = words.agg(F.avg(raw) * EPSILON).first()[0]
    said = queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    found = words.join(said, "term", "left_semi").select("term", "df", raw.alias("idf")).toPandas().sort_values(["df", "term"], ascending=[False, True])  # the questions' words
    discard(words)
    idf = np.where(found["idf"] < 0, low, found["idf"]).astype(float)
    idf = np.where(idf == 0, LEAST_IDF, idf)
    length = float(total / n if n else 1.0) or 1.0

    def weigh(row: np.ndarray, place: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return idf[place] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[row] / length))

    return S.TextTerms("token", found["term"].tolist(), max(1, len(found)), weigh), idf


def bm25_scorers(docs: DataFrame, queries: DataFrame, terms: S.TextTerms | None = None) -> list[S.Scorer]:
    """BM25 of docs (doc_id, text) for queries (query_id, text); see bm25(). terms are those of bm25_terms()."""
    lower = lambda f, i: f.select(i, F.lower("text").alias("terms"))
    return S.sparse_scorers(lower(docs, "doc_id"), lower(queries, "query_id"), terms or bm25_terms(docs, queries)[0], lambda q, place, count, sizes: count.astype(float))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, few: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25 over docs (doc_id, text) for queries (query_id, text).

    Document frequencies of all terms are aggregated with map-side combination. Blocks of questions travel with
    the tasks, which score their rows and keep the best k of each question, so what is shuffled is questions x
    k x tasks. A negative inverse frequency becomes a quarter of the mean over the vocabulary. More than `few`
    questions are answered by S.sparse_top() from texts that are cut once, unless a frequency's weight is negative.
    """
    terms, idf = bm25_terms(docs, queries)
    if queries.count() <= few or not len(idf) or idf.min() < 0:
        return ranked(S.top(docs.sparkSession, bm25_scorers(docs, queries, terms), k), k)
    rows = stage(S.placed(docs.select("doc_id", F.lower("text").alias("terms")), terms), "placed")
    return ranked(S.sparse_top(rows, queries.select("query_id", F.lower("text").alias("terms")), terms, k), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): exact inner products of all vectors (doc_id, embedding) with queries (query_id, embedding).

    Queries are taken in blocks of `block`, each one pass over the vectors: every task multiplies its rows by
    the block and keeps its own best k of each query, then the best k over all tasks are ranked.
    """
    return ranked(S.top(vectors.sparkSession, S.dense_scorers(vectors.select("doc_id", "embedding"), queries, block), k), k)


def hybrid(spark, first: list[S.Scorer], second: list[S.Scorer], k: int = 5, constant: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rank): rank fusion of two whole rankings of the same rows for the same questions.

    A row past rank constant + 2k of both rankings scores less than the k first of either, so only rows up to
    there are candidates; their exact rank in the other ranking is counted over all rows.
    """
    deep = constant + 2 * k
    tops = [stage(ranked(S.top(spark, x, deep), deep), "top") for x in (first, second)]
    every = []
    for own, other, scorers in ((tops[0], tops[1], first), (tops[1], tops[0], second)):
        lacking = other.join(own, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id")
        wanted = lacking.toPandas()  # at most questions x deep
        known = dict(list(wanted.groupby("query_id")["doc_id"].apply(lambda x: np.sort(x.to_numpy(np.int64))).items()))

        def chosen(ids: np.ndarray, batch: pa.RecordBatch, known: dict = known) -> np.ndarray:
            d = batch.column(0).to_numpy(zero_copy_only=False)
            return np.array([np.isin(d, known[i]) if i in known else np.zeros(len(d), dtype=bool) for i in ids.tolist()]).reshape(len(ids), len(d))

        few = [s._replace(rows=s.rows.join(F.broadcast(lacking.select("doc_id").distinct()), "doc_id", "left_semi")) for s in scorers]
        scored = S.ranks(spark, scorers, stage(S.pairs(spark, few, chosen), "lacking")) if len(wanted) else own.limit(0)
        every.append(own.select("query_id", "doc_id", "rank").unionByName(scored.select("query_id", "doc_id", "rank")))
    return fuse(every, k, constant)


def relevant_ranks(spark, scorers: list[S.Scorer], queries: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, score, relevant, total_relevant): every relevant row (query_id, doc_id) of held with its rank among all rows.

    That is all that ir_metrics() needs of a whole ranking. A question without a relevant row that scores has one
    row that is not relevant. The relevant pairs of all questions travel with the tasks.
    """
    of: dict = {}
    for r in held.select("query_id", "doc_id").distinct().collect():  # as many as are judged relevant
        of.setdefault(r["query_id"], []).append(r["doc_id"])
    known = {q: np.sort(np.array(d, np.int64)) for q, d in of.items()}

    def chosen(ids: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        d = batch.column(0).to_numpy(zero_copy_only=False)
        return np.array([np.isin(d, known[i]) if i in known else np.zeros(len(d), dtype=bool) for i in ids.tolist()]).reshape(len(ids), len(d))

    named = spark.createDataFrame([(i,) for i in sorted({i for d in of.values() for i in d})], "doc_id long")
    own = [s._replace(rows=s.rows.join(F.broadcast(named), "doc_id", "left_semi")) for s in scorers]  # rows that are relevant to some question
    found = S.ranks(spark, scorers, S.pairs(spark, own, chosen)).withColumn("relevant", F.lit(True))
    totals = spark.createDataFrame([(q, len(d)) for q, d in of.items()], "query_id long, n long")
    every = queries.select("query_id").join(found, "query_id", "left").join(totals, "query_id", "left")
    return every.select("query_id", "doc_id", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "score", F.coalesce("relevant", F.lit(False)).alias("relevant"), F.coalesce("n", F.lit(0)).alias("total_relevant"))


def fuse(rankings: list[DataFrame], k: int | None = 5, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank): (query_id, doc_id, score, rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for other in rankings[1:]:
        every = every.unionByName(other.select("query_id", "doc_id", "rank"))
    scores = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"))
    return ranked(scores, k)


def share_of_best(ranking: DataFrame) -> DataFrame:
    """Adds `share`: the score over the query's best, or over one where no score is positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return ranking.withColumn("share", F.round(F.col("score") / F.when(top > 0, top).otherwise(1.0), 6))


def ir_metrics(ranking: DataFrame, k: int = 5) -> DataFrame:
    """Per query: precision, recall, ap, rr and ndcg of ranking (query_id, rank, relevant, total_relevant).

    Precision divides by k, recall by the relevant total (one at least), ap by the hits of the whole ranking;
    the ideal gain has min(k, total) hits, so gain over it may exceed one where hits outnumber the total.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    running = ranking.withColumn("hits", F.sum(rel).over(by_rank))
    top = F.col("rank") <= k
    per = running.groupBy("query_id").agg(
        F.sum(F.when(top, rel).otherwise(0)).alias("top_hits"),
        F.sum(rel).alias("all_hits"),
        F.sum(F.when(rel == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.min(F.when(rel == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top & (rel == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.max("total_relevant").alias("total"),
    )
    return metrics_of(per, k)


def metrics_of(per: DataFrame, k: int = 5) -> DataFrame:
    """The metrics of ir_metrics() from its sums per query (query_id, top_hits, all_hits, precisions, first, dcg, total)."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.col("total"))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.select(
        "query_id",
        F.round(F.col("top_hits") / k, 6).alias("precision_at_k"),
        F.round(F.col("top_hits") / F.greatest(F.lit(1), F.col("total")), 6).alias("recall_at_k"),
        F.round(F.col("precisions") / F.greatest(F.lit(1), F.col("all_hits")), 6).alias("ap"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg_at_k"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """Means over queries; F1 is that of the mean precision and recall."""
    p, r = F.avg("precision_at_k"), F.avg("recall_at_k")
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(p, 6).alias("precision_at_k"), F.round(r, 6).alias("recall_at_k"),
        F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1_at_k"),
        F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg_at_k"), 6).alias("ndcg_at_k"),
    )


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays, zero for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
