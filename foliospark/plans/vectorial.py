"""Vector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import vectors as V
from foliospark.sources import table


def _sides(spark, d):
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _named(ranking):
    return ranking.withColumnRenamed("query_id", "item_id")


def tfidf_word_topk(spark, d):
    """Top five documents of every passage by TF-IDF of words and word pairs."""
    docs, q = _sides(spark, d)
    return _named(V.text_topk(docs, q, "word", 5, most=25_000))


def char_ngram_topk(spark, d):
    """Top five documents of every passage by TF-IDF of character grams within words."""
    docs, q = _sides(spark, d)
    return _named(V.text_topk(docs, q, "char", 5, most=30_000))


def hashing_topk(spark, d):
    """Top five documents of every passage by hashed counts of words and word pairs, without idf."""
    docs, q = _sides(spark, d)
    return _named(V.text_topk(docs, q, "word", 5))


def inter_similarity_exact(spark, d):
    """Mean inner product over all pairs of vectors."""
    return V.pair_mean(table(spark, d, "embeddings"), [])


def intra_similarity_exact(spark, d):
    """Mean inner product over the pairs of each label."""
    return V.pair_mean(table(spark, d, "embeddings"), ["label"])


def hybrid_score(spark, d):
    """Weighted mix, 0.85 and 0.15, of the cosines of two parts of the vectors, for each query vector's best five by the mix."""
    v = table(spark, d, "embeddings").select("vec_id", F.concat(V.scaled(V.normalized(F.slice("embedding", 1, 48)), 0.85**0.5), V.scaled(V.normalized(F.slice("embedding", 49, 16)), 0.15**0.5)).alias("embedding"))
    from foliospark.operators.retrieval import dense

    return dense(v.withColumnRenamed("vec_id", "doc_id"), v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5)


def pca_2d(spark, d):
    """Two principal components of every vector."""
    out, _ = V.pca(table(spark, d, "embeddings"))
    return out.select("vec_id", F.round(F.col("pc")[0], 6).alias("x"), F.round(F.col("pc")[1], 6).alias("y"))


def kmeans_clusters(spark, d):
    """Cluster of every vector."""
    return V.kmeans(table(spark, d, "embeddings")).select("vec_id", "cluster")


def svd_lsa(spark, d):
    """Sixteen latent dimensions of every vector; the first two shown, by absolute value."""
    out, _ = V.svd(table(spark, d, "embeddings"))
    return out.select("vec_id", F.round(F.abs(F.col("latent")[0]), 5).alias("a"), F.round(F.abs(F.col("latent")[1]), 5).alias("b"))


_W = f"regexp_extract_all(strip_accents(lower(text)), '{V.WORD}')"
_WG = "list_concat(w, list_transform(w[:-2], lambda x, i: x || ' ' || w[i + 1]))"
_CG = "flatten(list_transform(range(3, 6), lambda n: flatten(list_transform(list_filter(list_transform(w, lambda x: ' ' || x || ' '), lambda p: length(p) >= n), lambda p: list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n))))))"
_HG = f"list_transform({_WG}, lambda g: (('0x' || substr(md5(g), 1, 8))::BIGINT % 8192)::VARCHAR)"


def _sparse(grams: str, idf: bool, most: int | None = None) -> str:
    weight = "(1 + ln(tf)) * idf" if idf else "tf::DOUBLE"
    terms = "JOIN idf USING (term)" if idf else ""
    limit = f"ORDER BY total DESC, term LIMIT {most}" if most else ""
    return f"""WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({grams}) AS term FROM (SELECT doc_id, {_W} AS w FROM documents)) GROUP BY ALL),
      q AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({grams}) AS term FROM (SELECT item_id, {_W} AS w FROM benchmark)) GROUP BY ALL),
      idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM d GROUP BY term HAVING count(*) >= 2 {limit})),
      dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term, {weight} AS w FROM d {terms})),
      qw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS qw FROM (SELECT item_id, term, {weight} AS w FROM q {terms})),
      s AS (SELECT item_id, doc_id, round(sum(w * qw), 6) AS score FROM dw JOIN qw USING (term) GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""


#: Common table expressions up to `hs`: cosines of hashed counts of all documents and passages that share a place.
HASHED_SCORES = _sparse(_HG, False).removeprefix("WITH ").rsplit("SELECT * FROM (SELECT *", 1)[0].rstrip().replace("d AS (SELECT doc_id", "hd AS (SELECT doc_id", 1).replace("FROM d ", "FROM hd ").replace("\n      s AS (", "\n      hs AS (").replace("q AS (SELECT item_id, term, count", "hq AS (SELECT item_id, term, count", 1).replace("FROM q ", "FROM hq ").replace("idf AS (", "hidf AS (").replace("FROM d GROUP", "FROM hd GROUP")

_PAIR = """SELECT {k} n, round((a - b) / (n * (n - 1)), 6) AS mean_similarity FROM (SELECT {k} max(n) AS n, sum(s * s) AS a, sum(ss) AS b FROM (SELECT {k} dim, sum(x) AS s, sum(x * x) AS ss, count(*) AS n
  FROM (SELECT {k} generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY ALL)"""
_COS = "list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))"

QUERIES = {f.__name__: f for f in (tfidf_word_topk, char_ngram_topk, hashing_topk, inter_similarity_exact, intra_similarity_exact, hybrid_score, pca_2d, kmeans_clusters, svd_lsa)}

ORACLE_SQL = {
    "tfidf_word_topk": _sparse(_WG, True, 25_000),
    "char_ngram_topk": _sparse(_CG, True, 30_000),
    "hashing_topk": _sparse(_HG, False),
    "inter_similarity_exact": _PAIR.format(k=""),
    "intra_similarity_exact": _PAIR.format(k="label,"),
    "hybrid_score": f"""WITH v AS (SELECT vec_id, embedding[1:48]::DOUBLE[] AS a, embedding[49:64]::DOUBLE[] AS b FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(0.85 * {_COS.format(a='q.a', b='v.a')} + 0.15 * {_COS.format(a='q.b', b='v.b')}, 6)::DOUBLE AS score FROM v AS q, v WHERE q.vec_id % 100 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 5""",
}
