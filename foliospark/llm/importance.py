"""Quality selection by importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models count hashed word 1- and 2-grams in BUCKETS places: of all texts (raw), and of texts
labelled good (target). A text's log importance weight is the sum over its n-grams of the log ratio of
target to raw. The sample without replacement in proportion to the weights is the k texts of highest
log weight plus Gumbel noise, k being `share` of the rows; the noise is a hash of the id, so a run repeats.
The query takes the share that the labels give: that of labelled ids which are good and not toxic.

The raw model counts every text. The target model counts at most TARGETS labelled texts, those of the least
id hashes, whose ids are broadcast. The driver holds BUCKETS rows of counts. The k-th key is found exactly
by radix selection: four rounds that count 16 bits each, at most 65,536 rows to the driver a round, without
a global sort.

Edge cases. A null or wordless text has weight 0. A null id takes its noise from the text's first word, if
any. Repeated rows share their noise and are each drawn or not; ties at the cut go to rows in task order.
Without labelled texts the models agree on nothing but smoothing and the noise decides. An empty table
gives no rows. Extra columns are ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import words as W
from foliospark.scratch import stage
from foliospark.sources import table

BUCKETS = 1 << 16
TARGETS = 20_000
SHARE = 0.9  # of resample() where the caller names none
_PAIR = np.uint64(0x9FB21C651E98DF25)


def grams(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all 1-grams, then all 2-grams; the text of each; number of n-grams per text)."""
    w = W.scan(column)
    h, sizes = w.hashes, np.diff(w.bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    pair = W.mix(h[:-1] * _PAIR + h[1:])
    inner = text[:-1] == text[1:]
    at = np.concatenate([h, pair[inner]]) % np.uint64(buckets)
    return at.astype(np.int64), np.concatenate([text, text[:-1][inner]]), sizes + np.maximum(sizes - 1, 0)


def gumbel(seeds: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise, one number per 64-bit seed."""
    u = (W.mix(seeds * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / float(1 << 53)))


def sortable(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the given doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def fit(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, most: int = TARGETS) -> np.ndarray:
    """Log ratio of target to raw for each bucket; docs (doc_id, text), targets (doc_id)."""
    picked = targets.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct().orderBy(F.xxhash64("target_id"), "target_id").limit(most)
    marked = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in (x for b in batches for x in W.pieces(b, 0)):
            at, text, _ = grams(batch.column(0), buckets)
            raw += np.bincount(at, minlength=buckets)
            good += np.bincount(at[batch.column(1).to_numpy(zero_copy_only=False)[text]], minlength=buckets)
        rows = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(raw[rows]), pa.array(good[rows])], names=["bucket", "raw", "good"])

    got = marked.mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.ones(buckets), np.ones(buckets)
    raw[got["bucket"].to_numpy()] += got["raw"].to_numpy()
    good[got["bucket"].to_numpy()] += got["good"].to_numpy()
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(uid, doc_id, n_grams, log_weight, key) for every row of docs (doc_id, text); key orders log_weight plus noise."""
    schema = "uid long, doc_id long, n_grams long, log_weight double, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in (x for b in batches for x in W.pieces(b, 1)):
            at, text, n = grams(batch.column(1), len(ratio))
            weight = np.bincount(text, ratio[at], len(n))
            ids = batch.column(0)
            first = np.zeros(len(n), np.uint64)
            w = W.scan(batch.column(1))
            some = np.diff(w.bounds) > 0
            first[some] = w.hashes[w.bounds[:-1][some]]
            seeds = np.where(ids.is_null().to_numpy(zero_copy_only=False), first, ids.fill_null(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(n))), ids, pa.array(n), pa.array(weight), pa.array(sortable(weight + gumbel(seeds)))], names=[x.split()[0] for x in schema.split(", ")])
            uid += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def radix_cut(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(value, r): exactly k - r rows have column above value, and at least r rows, r >= 1, have it equal. For 1 <= k <= rows."""
    shifted = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned(shifted, shift)
        here = rows if shift == 48 else rows.where(F.shiftrightunsigned(shifted, shift + 16) == prefix)
        counts = here.groupBy(part.bitwiseAND(F.lit(0xFFFF)).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65,536
        for p, n in sorted(((r["p"], r["n"]) for r in counts), reverse=True):
            if n >= left:
                prefix = prefix << 16 | p
                break
            left -= n
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value, left


def resample(docs: DataFrame, targets: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_grams, log_weight and kept for every row of docs; kept holds for ceil(share x rows) of them."""
    docs = docs.select("doc_id", "text")
    rows = stage(weigh(docs, fit(docs, targets)), "importance")
    n = rows.count()
    k = min(n, math.ceil(share * n))
    if k == 0:
        kept = F.lit(False)
    else:
        cut, ties = radix_cut(rows, "key", k)
        last, _ = radix_cut(rows.where(F.col("key") == cut).withColumn("back", -F.col("uid") - 1), "back", ties)
        kept = (F.col("key") > cut) | ((F.col("key") == cut) & (-F.col("uid") - 1 >= last))
    return rows.select("doc_id", "n_grams", "log_weight", kept.alias("kept"))


def good_share(labels: DataFrame) -> float:
    """The share of labelled ids of good quality that are not toxic, as a sample size for resample(); 1 without labels."""
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    got = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("q = 1 and t = 0")).alias("good")).first()
    return got["good"] / got["n"] if got["n"] else 1.0


def op2_importance(spark, sf_dir: str) -> DataFrame:
    """As large a share of all documents as the labels call good and not toxic, drawn toward those."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select("doc_id")
    return resample(docs, good, good_share(labels))
