"""Vector representations: TF-IDF over word and character grams, hashing, exact pair means, projections and clusters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import ACCENTED, PLAIN
from foliospark.functions.text import PLAIN_WORD as WORD
from foliospark.operators import scoring as S
from foliospark.operators.retrieval import ranked
from foliospark.scratch import discard, stage

BUCKETS = 8192


def plain_words(text: Column) -> Column:
    """Lower-case words of two characters or more, accents off."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(WORD), F.lit(0))


def word_grams(text: Column) -> Column:
    """Words and pairs of neighbours."""
    return F.transform(F.array(plain_words(text)), lambda w: F.concat(w, F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))))[0]


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character grams of `low` to `high` within words padded by one blank on each side; a padded word as short as a gram gives it once."""
    padded = F.transform(plain_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        return F.flatten(F.transform(F.filter(padded, lambda p: F.length(p) >= n), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substr(p, i, F.lit(n)))))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def hashed_grams(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """docs with `tf` in place of the text: the vector that HashingTF makes of its char_grams(), staged; none are made of a null text."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    terms, kept = S.TextTerms("char", None, size), [c for c in docs.columns if c != text]
    out = StructType([docs.schema[c] for c in kept] + [StructField("tf", VectorUDT.sqlType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, place, count, _ = terms.counts(batch.column(0))
                n, ends = batch.num_rows, pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), count.astype(float))]
                tf = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], tf], names=[*kept, "tf"])

    staged = stage(docs.select(F.lower(text).alias(text), *kept).mapInArrow(run, out), "grams")
    read = StructType([docs.schema[c] for c in kept] + [StructField("tf", VectorUDT())])
    return docs.sparkSession.read.schema(read).parquet(staged._scratch_path)  # noqa: SLF001


def vocabulary(docs: DataFrame, least_df: int = 2, most: int | None = None) -> tuple[list[str], list[float]]:
    """(terms, idf) of docs (doc_id, terms): ln((1 + n) / (1 + df)) + 1 for terms of least_df documents or more, of which the `most` frequent stay."""
    df = S.frequencies(docs).where(F.col("df") >= least_df)
    if most is not None:
        df = df.orderBy(F.desc("total"), "term").limit(most)
    n = docs.count()
    found = df.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).toPandas()  # the vocabulary, bounded by `most`
    return found["term"].tolist(), found["idf"].tolist()


def text_vocabulary(texts: DataFrame, kind: str, least_df: int = 2, most: int = 30_000) -> tuple[list[str], list[float]]:
    """vocabulary() of texts (text, lower case) for `word` or `char`, exact, without a row for every pair or gram of a text.

    Words are counted first. The totals of grams follow from them, and a pair is no more frequent than its words; so all
    that could be among the `most` frequent is found and then counted itself.
    """
    words = stage(S.word_counts(texts, kind), "words")
    try:
        return _chosen(texts, kind, words, least_df, most)
    finally:
        discard(words)


def _chosen(texts: DataFrame, kind: str, words: DataFrame, least_df: int, most: int) -> tuple[list[str], list[float]]:
    n = texts.count()
    last = lambda f: (lambda r: r["x"] if r["n"] == most else least_df)(f.orderBy(F.desc("total")).limit(most).agg(F.min("total").alias("x"), F.count(F.lit(1)).alias("n")).first())
    if kind == "char":
        grams = words.select(F.explode(char_grams(F.col("term"))).alias("term"), "df", "total").groupBy("term").agg(F.max("df").alias("df"), F.sum("total").alias("total"))
        bar = last(grams.where(F.col("df") >= least_df))
        names = [r["term"] for r in grams.where(F.col("total") >= bar).select("term").collect()]  # `most` and those that tie with the last
    else:
        often = words.where(F.col("df") >= least_df)
        bar = last(often)
        single = sorted(r["term"] for r in often.where(F.col("total") >= bar).select("term").collect())
        pairs, more = S.frequent_pairs(texts, single, bar)
        bar = max(bar, last(often.select("total").unionByName(pairs.where(F.col("df") >= least_df).select("total"))))
        maybe = pairs.where(F.col("total") + F.col("others") * (more - 1) >= bar).select("a", "b").collect()  # about as many
        names = single + [f"{single[r['a']]} {single[r['b']]}" for r in maybe]
    counted = [(r["total"], names[r["place"]], r["df"]) for r in S.known_counts(texts, S.TextTerms(kind, names, max(1, len(names)))).collect()]
    kept = sorted((c for c in counted if c[2] >= least_df), key=lambda c: (-c[0], c[1]))[:most]
    return [c[1] for c in kept], [float(np.log((1 + n) / (1 + c[2])) + 1) for c in kept]


def text_scorers(docs: DataFrame, queries: DataFrame, kind: str, terms: list[str] | None = None, idf: list[float] | None = None) -> list[S.Scorer]:
    """Cosines of docs (doc_id, text) and queries (query_id, text) by `word` or `char` terms with their idf, or by hashed counts of words and pairs."""
    d, q = docs.select("doc_id", F.lower("text").alias("terms")), queries.select("query_id", F.lower("text").alias("terms"))
    table = np.array([*(idf or []), 0.0])

    def weigh(row: np.ndarray, place: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return S.by_length((1 + np.log(count)) * table[place] if terms is not None else count.astype(float), row, len(sizes))

    return S.sparse_scorers(d, q, S.TextTerms(kind, terms, BUCKETS if terms is None else max(1, len(terms)), weigh), weigh)


def text_topk(docs: DataFrame, queries: DataFrame, kind: str, k: int = 5, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k by text_scorers(), with a vocabulary of `most` terms, or hashed without."""
    learned = text_vocabulary(docs.select(F.lower("text").alias("text")), kind, 2, most) if most else ()
    return ranked(S.top(docs.sparkSession, text_scorers(docs, queries, kind, *learned), k), k)


def sparse_scorers(docs: DataFrame, queries: DataFrame, grams: Column, idf: bool = True, least_df: int = 2, most: int | None = 30_000, hashed: int | None = None) -> list[S.Scorer]:
    """Cosines of TF-IDF vectors (or of plain counts in `hashed` places) of docs (doc_id, text) and queries (query_id, text)."""
    d, q = docs.select("doc_id", grams.alias("terms")), queries.select("query_id", grams.alias("terms"))
    if idf:
        names, values = vocabulary(d, least_df, most)
        table = np.array(values + [0.0])

        def weigh(row: np.ndarray, place: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return S.by_length((1 + np.log(count)) * table[place], row, len(sizes))

        return S.sparse_scorers(d, q, S.Terms(pa.array(names, pa.string()), max(1, len(names)), weigh), weigh)

    def plain(row: np.ndarray, place: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return S.by_length(count.astype(float), row, len(sizes))

    return S.sparse_scorers(d, q, S.Terms(None, hashed or BUCKETS, plain), plain)


class Encoder(NamedTuple):
    """A fitted representation: its kind, and the terms and inverse document frequencies it learned (none for hashing)."""

    kind: str
    terms: list[str]
    idf: list[float]

    def grams(self, text: Column) -> Column:
        return char_grams(text) if self.kind == "tfidf_char" else word_grams(text)

    def scorers(self, docs: DataFrame, queries: DataFrame) -> list[S.Scorer]:
        """Cosines of docs (doc_id, text) with new queries (query_id, text), both encoded as fitted."""
        hashed = self.kind == "hashing"
        return text_scorers(docs, queries, "char" if self.kind == "tfidf_char" else "word", None if hashed else self.terms, self.idf)


#: Representations and the size of their vocabularies.
KINDS = {"tfidf_word": 25_000, "tfidf_char": 30_000, "hashing": 0}


def fit_encoder(docs: DataFrame, kind: str) -> Encoder:
    """One of KINDS fitted to docs (doc_id, text)."""
    if kind == "hashing":
        return Encoder(kind, [], [])
    return Encoder(kind, *text_vocabulary(docs.select(F.lower("text").alias("text")), "char" if kind == "tfidf_char" else "word", 2, KINDS[kind]))


def save_encoder(spark, encoder: Encoder, path: str) -> None:
    rows = [(i, t, v) for i, (t, v) in enumerate(zip(encoder.terms, encoder.idf, strict=True))]
    spark.createDataFrame(rows, "place int, term string, idf double").write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.createDataFrame([(encoder.kind,)], "kind string").write.mode("overwrite").parquet(f"{path}/kind")


def load_encoder(spark, path: str) -> Encoder:
    rows = spark.read.parquet(f"{path}/vocabulary").orderBy("place").collect()
    return Encoder(spark.read.parquet(f"{path}/kind").first()["kind"], [r["term"] for r in rows], [r["idf"] for r in rows])


#: Fixed weights of a representation's measures in its score.
SELECTION = {"f1_at_k": 0.30, "map": 0.25, "mrr": 0.20, "ndcg_at_k": 0.20}
SPEED = 0.05


def selection(measures: DataFrame) -> DataFrame:
    """measures (method, the keys of SELECTION, encoding_seconds) with selection_score and winner, which ties give to the higher F1, then the first name."""
    from foliospark.operators.chunking import min_max

    total = sum((w * F.col(c) for c, w in SELECTION.items()), F.lit(0.0)) + SPEED * min_max("encoding_seconds", True)
    m = measures.withColumn("selection_score", F.round(total, 6))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("selection_score"), F.desc("f1_at_k"), "method"))  # one row per method
    return m.withColumn("winner", best == 1)


def run_embeddings(chunks: DataFrame, questions: DataFrame, held: DataFrame, path: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """One row per representation of chunks (doc_id, text): its measures at five for questions (query_id, text) with relevant pairs held, its score and the winner, which is saved at path if given."""
    import time

    from foliospark.operators import retrieval as R

    spark, rows, fitted = chunks.sparkSession, [], {}
    for kind in kinds or list(KINDS):
        began = time.perf_counter()
        fitted[kind] = fit_encoder(chunks, kind)
        took = time.perf_counter() - began
        m = R.macro(R.ir_metrics(R.relevant_ranks(spark, fitted[kind].scorers(chunks, questions), questions, held), 5)).first()
        rows.append((kind, len(fitted[kind].terms) or BUCKETS, m["n_queries"], m["precision_at_k"], m["recall_at_k"], m["f1_at_k"], m["map"], m["mrr"], m["ndcg_at_k"], took))
    out = selection(spark.createDataFrame(rows, "method string, dimension int, n_queries long, precision_at_k double, recall_at_k double, f1_at_k double, map double, mrr double, ndcg_at_k double, encoding_seconds double"))
    if path is not None:
        save_encoder(spark, fitted[out.where("winner").first()["method"]], path)
    return out


def plot_payload(vectors: DataFrame, texts: DataFrame, query: list[float] | None = None, nearest: int = 5) -> DataFrame:
    """(doc_id, x, y, excerpt, nearest): two principal components of vectors (doc_id, embedding), 180 characters of texts (doc_id, text), and whether the row is among the nearest to a query vector."""
    from foliospark.operators.retrieval import dense

    out, _ = pca(vectors.select("doc_id", "embedding"), keep=["doc_id"])
    out = out.join(texts.select("doc_id", F.substring("text", 1, 180).alias("excerpt")), "doc_id", "left")
    near = F.lit(False)
    if query is not None:
        spark = vectors.sparkSession
        hits = dense(vectors, spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<double>"), nearest).select("doc_id", F.lit(True).alias("near"))
        out, near = out.join(F.broadcast(hits), "doc_id", "left"), F.coalesce("near", F.lit(False))  # a few rows
    return out.select("doc_id", F.round(F.col("pc")[0], 6).alias("x"), F.round(F.col("pc")[1], 6).alias("y"), "excerpt", near.alias("nearest"))


def sparse_topk(docs: DataFrame, queries: DataFrame, grams: Column, k: int = 5, idf: bool = True, least_df: int = 2, most: int | None = 30_000, hashed: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k by sparse_scorers()."""
    return ranked(S.top(docs.sparkSession, sparse_scorers(docs, queries, grams, idf, least_df, most, hashed), k), k)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v at length one; a zero vector stays."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))[0]


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def pair_mean(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean_similarity): the mean inner product of all pairs, in one pass: (|sum|^2 - sum of |v|^2) / (n (n - 1))."""
    dims = vectors.select(*by, F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    per = dims.groupBy(*by, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("a"), F.sum("ss").alias("b"))
    return out.select(*by, "n", F.round(F.try_divide(F.col("a") - F.col("b"), F.col("n") * (F.col("n") - 1)), 6).alias("mean_similarity"))


def _vectors(frame: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return frame.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of embeddings, in one pass; tasks send their sums, which eight tasks add up for the driver."""
    schema, names = "n long, s array<double>, g array<double>", ["n", "s", "g"]

    def rows(n: int, s: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([x.reshape(-1)], pa.list_(pa.float64())) for x in (s, g))], names=names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(0), np.zeros(0)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                v = _matrix(whole.slice(at, 512).column(0))
                n, s, g = n + len(v), v.sum(axis=0) + (s if n else 0.0), v.T @ v + (g if n else 0.0)
        yield from rows(n, s, g)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(0), np.zeros(0)
        for batch in batches:
            for i in range(batch.num_rows):
                m, x, y = (batch.column(c)[i] for c in range(3))
                x, y = (z.values.to_numpy(zero_copy_only=False) for z in (x, y))
                n, s, g = n + m.as_py(), x + (s if n else 0.0), y + (g if n else 0.0)
        yield from rows(n, s, g)

    found = vectors.select("embedding").mapInArrow(own, schema).repartition(8).mapInArrow(added, schema).collect()
    n, s, g = sum(r["n"] for r in found), sum(np.array(r["s"]) for r in found), sum(np.array(r["g"]) for r in found)
    return n, s, g.reshape(len(s), len(s))


def pca(vectors: DataFrame, k: int = 2, keep: list[str] | None = None) -> tuple[DataFrame, list[float]]:
    """(vectors with `pc`, or of their columns those to keep, explained shares): centred principal components, each signed so that its largest loading is positive."""
    n, total, outer = _moments(vectors)
    mean = total / n
    values, axes = np.linalg.eigh((outer - n * np.outer(mean, mean)) / max(1, n - 1))
    load = axes[:, ::-1][:, :k]
    load = load * np.sign(load[np.argmax(np.abs(load), axis=0), range(k)])
    keep = vectors.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                pc = (_matrix(batch.column(0)) - mean) @ load
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(pc), pa.list_(pa.float64()))], names=[*keep, "pc"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    out = vectors.select(F.col("embedding").alias("_v"), *keep).mapInArrow(run, StructType([*(vectors.schema[c] for c in keep), StructField("pc", ArrayType(DoubleType()))]))
    return out, (values[::-1][:k] / values.sum()).tolist()


def kmeans(vectors: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """vectors with `cluster`; k is by default the root of half the rows, from 2 to 8."""
    import math

    from pyspark.ml.clustering import KMeans

    if k is None:
        k = min(8, max(2, round(math.sqrt(vectors.count() / 2))))
    v = _vectors(vectors)
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster", maxIter=20).fit(v).transform(v).drop("v")


def svd(vectors: DataFrame, k: int = 16) -> tuple[DataFrame, list[float]]:
    """(vectors with `latent`, at length one, and the singular values) by a truncated singular value decomposition."""
    from pyspark.mllib.linalg import Vectors as Old
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = vectors.select("embedding").rdd.map(lambda r: Old.dense([float(x) for x in r[0]]))
    found = RowMatrix(rows).computeSVD(k)
    basis = found.V.toArray().tolist()
    latent = F.transform(F.array(*[F.array(*[F.lit(basis[i][j]) for i in range(len(basis))]) for j in range(k)]), lambda b: dot(F.col("embedding"), b))
    return vectors.withColumn("latent", normalized(latent)), found.s.toArray().tolist()
