"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are one group. A group whose share of bytes, tokens or rows exceeds 1/ATOMS is an item
of its own; all other groups fall into ATOMS atoms by their hash, so the driver packs at most 4 x ATOMS
items whatever the input. Items go, largest first, to the shard where the dot product of the item with the
residual capacities is highest, among the shards whose capacities of bytes, tokens and rows all hold it; where
none does, among those that stay within SLACK of equal bytes, to the one that goes least over its tokens and
rows. So bytes keep the law. A group larger than a shard's capacity cannot stay whole: its rows are dealt over pieces of about an eighth of a shard. Slots are
numbered within (input partition, shard) and offset by the counts of the partitions before, so no task
sees a whole shard.

Edge cases. A null text is empty: size 8, no tokens, checksum 0, one group with the empty text. A null id
is kept. Repeated rows are each placed. Ties between shards fall to the lower number. An empty table gives
no rows. Extra columns are ignored, whatever their names. Very long texts are weighed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.scratch import stage
from foliospark.sources import table

ATOMS = 4096
SLACK = 0.0005  # a shard may pass equal shares by so much; 23 of them leave the last one short by 1.2 % at most


def place(items: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """The shard of each item; items are rows of non-negative shares of the totals (bytes first)."""
    spare = slack / shards
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1, initial=0.0))):
        item = items[i]
        after = left + spare - item
        fits = (after >= 0).all(axis=1)
        if fits.any():
            k = int(np.argmax(np.where(fits, left @ item, -np.inf)))
        elif (after[:, 0] >= 0).any():
            k = int(np.argmax(np.where(after[:, 0] >= 0, after[:, 1:].min(axis=1), -np.inf)))
        else:
            k = int(np.argmax(left[:, 0]))
        out[i] = k
        left[k] -= item
    return out


def shard(docs: DataFrame, shards: int = 24, atoms: int = ATOMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, tokens, shard, slot for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        F.spark_partition_id().alias("pid"),
    )
    base = stage(narrow, "shard-base")
    groups = stage(base.groupBy("h1", "h2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")), "shard-groups")
    total = groups.agg(*[F.sum(c).alias(c) for c in "btr"]).first()
    total = [max(int(total[c] or 0), 1) for c in "btr"]
    share = F.greatest(*[F.col(c) / t for c, t in zip("btr", total, strict=True)])
    big = groups.where(share > 1 / atoms).withColumn("pieces", F.when(share > 1 / shards, F.ceil(share * 8 * shards)).otherwise(1).cast("int"))
    big_rows = big.select("h1", "h2", "b", "t", "r", "pieces").collect()  # at most 3 x atoms
    small = groups.where(share <= 1 / atoms).groupBy(F.pmod("h1", F.lit(atoms)).cast("int").alias("atom")).agg(*[F.sum(c).alias(c) for c in "btr"])
    small_rows = small.collect()  # at most atoms
    pieces = spark.createDataFrame([(x["h1"], x["h2"], x["pieces"]) for x in big_rows], "h1 long, h2 long, pieces int")
    dealt = base.join(F.broadcast(pieces), ["h1", "h2"], "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", "pid"), F.col("pieces"))).otherwise(0).cast("int"))
    split = [(x["h1"], x["h2"]) for x in big_rows if x["pieces"] > 1]
    items = [(("atom", x["atom"]), (x["b"], x["t"], x["r"])) for x in small_rows]
    items += [((x["h1"], x["h2"], 0), (x["b"], x["t"], x["r"])) for x in big_rows if x["pieces"] == 1]
    if split:
        parts = dealt.where("pieces > 1").groupBy("h1", "h2", "piece").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
        items += [((x["h1"], x["h2"], x["piece"]), (x["b"], x["t"], x["r"])) for x in parts.collect()]  # at most 3 x 8 x shards + 3 x shards
    items.sort(key=lambda x: (x[0][0] == "atom", *map(str, x[0])))
    of = place(np.array([x[1] for x in items], float).reshape(-1, 3) / np.array(total, float), shards)
    own = spark.createDataFrame([(*k, int(s)) for (k, _), s in zip(items, of, strict=True) if k[0] != "atom"], "h1 long, h2 long, piece int, own int")
    atom = spark.createDataFrame([(k[1], int(s)) for (k, _), s in zip(items, of, strict=True) if k[0] == "atom"], "atom int, shared int")
    placed = (
        dealt.join(F.broadcast(own), ["h1", "h2", "piece"], "left")
        .withColumn("atom", F.pmod("h1", F.lit(atoms)).cast("int"))
        .join(F.broadcast(atom), "atom", "left")
        .select("doc_id", "size", "text_crc32", "tokens", "pid", F.coalesce("own", "shared").alias("shard"))
    )
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    here = Window.partitionBy("pid", "shard").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(here) - 1)
    out = numbered.join(offsets, ["pid", "shard"]).select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
    return out.withColumnRenamed("doc_id", id_col)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law of near-equal bytes."""
    docs = table(spark, sf_dir, "documents")
    return shard(docs, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
