"""Retrieval queries and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliospark.functions.text import TOKEN, tokens
from foliospark.operators import retrieval as R
from foliospark.operators import scoring as S
from foliospark.operators import vectors as V
from foliospark.plans.vectorial import HASHED_SCORES
from foliospark.sources import table




def _bm25(spark, d, k):
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(docs, items, k)


def bm25_topk(spark, d):
    """Top five documents of every benchmark passage by BM25."""
    return R.share_of_best(_bm25(spark, d, 5)).select(F.col("query_id").alias("item_id"), "doc_id", "rank", "score", "share")


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def dense_topk(spark, d):
    """Top five vectors of every query vector (ids divisible by 100) by exact inner product."""
    v, q = _vectors(spark, d)
    return R.dense(v, q, 5)


def _same_label(spark, d):
    """The scorers of vectors for query vectors, and the choice of pairs of one label."""
    v, q = _vectors(spark, d)
    of = {r["query_id"]: r["query_label"] for r in q.select("query_id", "query_label").collect()}  # as many as the questions

    def same(ids, batch):
        labels = batch.column(2).to_numpy(zero_copy_only=False)
        return np.array([labels == of[i] for i in ids.tolist()]).reshape(len(ids), batch.num_rows)

    return S.dense_scorers(v, q), same


def _dense_metrics(spark, d):
    v, q = _vectors(spark, d)
    totals = v.groupBy(F.col("label").alias("query_label")).agg(F.count(F.lit(1)).alias("total"))
    sums = S.labelled_sums(v, q.withColumnRenamed("query_label", "label"), 5)
    return R.metrics_of(sums.join(q.select("query_id", "query_label"), "query_id").join(totals, "query_label"), 5)


def ir_metrics_dense(spark, d):
    """Per-query metrics at five of the whole dense ranking; vectors of the query's label are relevant."""
    return _dense_metrics(spark, d)


def _relevance(spark, d):
    """(query_id, doc_id): documents that hold a passage. Candidates share the passage's rarest token; then the text decides."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    inner = F.expr("slice(t, 2, greatest(0, size(t) - 2))")  # a token at a passage's edge may be part of a longer one
    asked = items.select("query_id", "passage", tokens(F.col("passage")).alias("t")).select("query_id", "passage", F.explode_outer(F.array_distinct(inner)).alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    anchor = asked.join(df, "term", "left").groupBy("query_id", "passage").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    near = anchor.join(held, "term").join(docs, "doc_id").where(F.contains("text", "passage"))
    return near.select("query_id", "doc_id").distinct()


def _relevant_bm25(spark, d):
    """Every document that holds a passage with its rank among all documents; a passage that none holds has one row that is not relevant."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.relevant_ranks(spark, R.bm25_scorers(docs, items), items, _relevance(spark, d))


def ir_metrics_bm25(spark, d):
    """Per-passage metrics at five of the whole BM25 ranking; documents that hold the passage are relevant."""
    return R.ir_metrics(_relevant_bm25(spark, d), 5).withColumnRenamed("query_id", "item_id")


def rrf_topk(spark, d):
    """Reciprocal rank fusion of the whole vector ranking (hashed words and pairs) and the whole BM25 ranking of documents for passages."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fused = R.hybrid(spark, V.text_scorers(docs, items, "word"), R.bm25_scorers(docs, items), 5)
    return R.share_of_best(fused).withColumnRenamed("query_id", "item_id")


def retrieval_winner(spark, d):
    """Macro metrics of the dense and the BM25 ranking side by side, the better by (F1, NDCG) marked."""
    a = R.macro(_dense_metrics(spark, d)).withColumn("method", F.lit("dense"))
    b = R.macro(R.ir_metrics(_relevant_bm25(spark, d), 5)).withColumn("method", F.lit("bm25"))
    both = a.unionByName(b)
    best = both.agg(F.max_by("method", F.struct("f1_at_k", "ndcg_at_k", "method")).alias("best"))
    return both.crossJoin(F.broadcast(best)).withColumn("winner", F.col("method") == F.col("best")).drop("best")  # one row


def positive_similarity(spark, d):
    """Mean over query vectors of the best inner product with another vector of the same label."""
    scorers, same = _same_label(spark, d)

    def other(ids, batch):
        return same(ids, batch) & (batch.column(0).to_numpy(zero_copy_only=False)[None, :] != ids[:, None])

    r = S.stats(spark, scorers, other)
    return r.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("best"), 6).alias("positive_similarity"))


def _bm25_sql(name: str, query: str, depth: int) -> str:
    return f"""
{name}_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM ({query})) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, doc_id, round(sum(qtf * (CASE WHEN raw < 0 THEN low ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN idf USING (term) JOIN {name}_qt USING (term), tot, low GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_s) WHERE rank <= {depth})"""


_BM25_BASE = f"""
tk AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS toks FROM documents),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk),
ex AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tk),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM ex GROUP BY ALL),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
low AS (SELECT 0.25 * avg(raw) AS low FROM idf)"""
_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_SHARE = "round(score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END, 6) AS share"
_DENSE = """
q AS (SELECT vec_id AS query_id, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT query_id, vec_id AS doc_id, label, ql, round(list_inner_product(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds) WHERE rank <= {depth})"""


def _metrics(source: str, name: str) -> str:
    return f"""
{name}_h AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM {source}),
{name} AS (SELECT query_id, round(sum(CASE WHEN rank <= 5 THEN relevant::INT ELSE 0 END) / 5.0, 6)::DOUBLE AS precision_at_k,
  round(sum(CASE WHEN rank <= 5 THEN relevant::INT ELSE 0 END)::DOUBLE / greatest(1, max(total_relevant)), 6) AS recall_at_k,
  round(sum(CASE WHEN relevant THEN hits::DOUBLE / rank ELSE 0 END) / greatest(1, sum(relevant::INT)), 6) AS ap,
  round(coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0), 6)::DOUBLE AS rr,
  round(sum(CASE WHEN relevant AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, 1 + least(5, greatest(1, max(total_relevant)))), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_k
  FROM {name}_h GROUP BY query_id)"""


_DREL = "drel AS (SELECT query_id, doc_id, rank, score, label = ql AS relevant, total_relevant FROM dr JOIN (SELECT label AS ql, count(*) AS total_relevant FROM embeddings GROUP BY label) USING (ql))"
_BREL = """held AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
brel AS (SELECT r.query_id, r.doc_id, rank, held.doc_id IS NOT NULL AS relevant, coalesce(n, 0) AS total_relevant
  FROM br r LEFT JOIN held ON held.query_id = r.query_id AND held.doc_id = r.doc_id LEFT JOIN (SELECT query_id, count(*) AS n FROM held GROUP BY 1) t ON t.query_id = r.query_id)"""
_MACRO = """SELECT '{m}' AS method, count(*) AS n_queries, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k,
  round(coalesce(2 * avg(precision_at_k) * avg(recall_at_k) / nullif(avg(precision_at_k) + avg(recall_at_k), 0), 0), 6) AS f1_at_k,
  round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k FROM {t}"""

QUERIES = {f.__name__: f for f in (bm25_topk, dense_topk, rrf_topk, ir_metrics_dense, ir_metrics_bm25, retrieval_winner, positive_similarity)}

ORACLE_SQL = {
    "bm25_topk": f"WITH {_BM25_BASE}, {_bm25_sql('br', _ITEMS, 5)} SELECT query_id AS item_id, doc_id, rank, score, {_SHARE} FROM br",
    "dense_topk": f"WITH {_DENSE.format(depth=5)} SELECT query_id, doc_id, score, rank FROM dr",
    "rrf_topk": f"""WITH {_BM25_BASE}, {_bm25_sql('a', _ITEMS, 1 << 30)}, {HASHED_SCORES},
      b AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hs),
      f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b) GROUP BY ALL),
      r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f) WHERE rank <= 5)
      SELECT query_id AS item_id, doc_id, score, rank, {_SHARE} FROM r""",
    "ir_metrics_dense": f"WITH {_DENSE.format(depth=1 << 30)}, {_DREL}, {_metrics('drel', 'm')} SELECT * FROM m",
    "ir_metrics_bm25": f"WITH {_BM25_BASE}, {_bm25_sql('br', _ITEMS, 1 << 30)}, {_BREL}, {_metrics('brel', 'm')} SELECT query_id AS item_id, * EXCLUDE (query_id) FROM m",
    "retrieval_winner": f"""WITH {_BM25_BASE}, {_bm25_sql('br', _ITEMS, 1 << 30)}, {_BREL}, {_metrics('brel', 'mb')}, {_DENSE.format(depth=1 << 30)}, {_DREL}, {_metrics('drel', 'md')},
      u AS ({_MACRO.format(m='dense', t='md')} UNION ALL {_MACRO.format(m='bm25', t='mb')})
      SELECT *, method = (SELECT method FROM u ORDER BY f1_at_k DESC, ndcg_at_k DESC, method DESC LIMIT 1) AS winner FROM u""",
    "positive_similarity": f"""WITH {_DENSE.format(depth=1 << 30)}, b AS (SELECT query_id, max(score) AS best FROM dr WHERE label = ql AND query_id <> doc_id GROUP BY 1)
      SELECT count(*) AS n_queries, round(avg(best), 6) AS positive_similarity FROM b""",
}
