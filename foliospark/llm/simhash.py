"""SimHash near-duplicate classes: pigeonhole blocks, a join on blocks, and Hamming verification.

A fingerprint of 64 bits is cut into B blocks. Two fingerprints within D differing bits differ in at most
D blocks, so they agree on all bits of some B - D blocks; every choice of B - D blocks is one join key.
B grows with the number of distinct fingerprints so that a key is about as wide as that number in bits;
every choice of B finds every link. Work is on distinct fingerprints: copies cost nothing. Fingerprints
that share a key are searched by breadth-first passes that emit a spanning forest of the true links, not
all pairs. A key that more than HOT fingerprints share is cut into chunks and every pair of chunks is one
task's work, so memory is bounded by two chunks and no link is lost.

At four differing bits a fingerprint of 64 bits joins texts of a similarity of about 0.95 and more. The
similarity of 0.8 is about ten bits apart, where every choice of blocks is too narrow to tell texts apart, so
keep_one() adds blocks of minima and lets whole shingle sets decide; see similar_classes().

Edge cases. Null or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the
whole word sequence is the one shingle. Repeated rows stay repeated rows. A null id keeps its row; the
class id is the least non-null id of the class, or null if it has none. An empty table gives no rows.
Other columns are ignored, whatever their names. Very long texts are hashed whole. Ties: of equal fingerprints
the least id names the class; in keep_one() of rows with the least id the one of least text hash stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import mix
from foliospark.operators.components import connected_components
from foliospark.scratch import discard, stage
from foliospark.sources import table

HOT = 20_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text: bit j is set if over half of the shingle hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)], dtype=np.uint64)
    m = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    whole = m // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long; one row per row of docs."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return picked.mapInArrow(run, "doc_id long, fp long").withColumnRenamed("doc_id", id_col)


def blocks_for(distinct: int, distance: int) -> int:
    """Blocks such that the bits of a key (blocks - distance of them) are at least log2 of the fingerprints."""
    wanted = max(1, distinct - 1).bit_length()
    blocks = distance + 1
    while blocks < distance + 6 and (64 // blocks) * (blocks - distance) < wanted:
        blocks += 1
    return blocks


def _block_masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(each, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fps (distinct, uint64) within distance bits."""
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            here = frontier.pop()
            near = np.bitwise_count(rest ^ here) <= distance
            if near.any():
                hits = rest[near]
                out += [(int(here), int(h)) for h in hits]
                frontier += list(hits)
                rest = rest[~near]
    return out


def _forest_of_runs(distance: int):
    """Over rows sorted by the group columns (all but the last), emit each group's forest; a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for c in cols[:-1]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            held = tuple(c[starts[-1] :] for c in cols)
            found: list[tuple[int, int]] = []
            fps = cols[-1].view(np.uint64)
            for k in np.flatnonzero(np.diff(starts) > 1):
                found += near_forest(fps[starts[k] : starts[k + 1]], distance)
            if found:
                yield edges_of(found)
        if held is not None and len(held[0]) > 1:
            found = near_forest(held[-1].view(np.uint64), distance)
            if found:
                yield edges_of(found)

    return run


def links(distinct: DataFrame, distance: int = 4, hot: int = HOT) -> DataFrame:
    """(u, v): links whose closure is that of all links between the distinct fingerprints (column fp)."""
    masks = _block_masks(blocks_for(distinct.count(), distance), distance)
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("b")
    ).select("b.part", "b.key", "fp")
    sizes = stage(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot")
    any_hot = sizes.limit(1).count() > 0
    cold = keyed.join(sizes.select("part", "key"), ["part", "key"], "left_anti") if any_hot else keyed
    run = _forest_of_runs(distance)
    out = cold.repartition("part", "key").sortWithinPartitions("part", "key").select("part", "key", "fp").mapInArrow(run, "u long, v long")
    if any_hot:
        cut = keyed.join(sizes, ["part", "key"]).withColumn("s", F.ceil(F.col("n") / hot).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        pairs = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        pairs = pairs.select("part", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
        out = out.union(pairs.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j").mapInArrow(run, "u long, v long"))
    return out


def near_classes(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, class_fp) for each row of distinct fingerprints: the least fingerprint, signed, of its class."""
    roots = connected_components(links(distinct.select("fp"), distance))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(*distinct.columns, F.coalesce("root", "fp").alias("class_fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fp, class_fp, component_id."""
    fps = stage(fingerprints(docs, shingle, id_col, text_col), "simhash")
    classed = near_classes(stage(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprints"), distance)
    least = classed.groupBy("class_fp").agg(F.min("least_id").alias("component_id"))
    return fps.join(classed.join(least, "class_fp").select("fp", "class_fp", "component_id"), "fp").select(id_col, "fp", "class_fp", "component_id")


HASHES = 192  # minima of a sketch
ROWS = 8  # minima of a block: HASHES / ROWS blocks
MARK = 32  # words of 64 bits of a parity mark
_FACTORS = (np.random.default_rng(88).integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending; one fixed hash for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)] or [digest(joined, 42)], dtype=np.uint64).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of a set of shingle hashes: bit j is set if over half of them set it."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.int64)[0])


def sketch_blocks(hashes: np.ndarray) -> np.ndarray:
    """One key per block of ROWS minima. Two sets of Jaccard similarity s share a given block with probability s ** ROWS."""
    least = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(hashes), 512):  # bounds what is held, whatever the length
        np.minimum(least, (hashes[at : at + 512, None].view(np.uint64) * _FACTORS).min(axis=0), out=least)
    key = np.arange(HASHES // ROWS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + least[k::ROWS])
    return key.view(np.int64)


def parity_mark(hashes: np.ndarray) -> np.ndarray:
    """MARK words whose bit j is the parity of the hashes that fall on j. Two marks differ in no more bits than their sets in hashes."""
    at = (hashes.view(np.uint64) % np.uint64(64 * MARK)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * MARK) & 1, bitorder="little").view(np.int64)


def block_recall(similarity: float) -> float:
    """The probability that two sets of the similarity share a block."""
    return 1 - (1 - similarity**ROWS) ** (HASHES // ROWS)


def _each_text(texts: DataFrame, schema: str, make) -> DataFrame:
    """texts (node, text) with make(text)'s columns, a few hundred rows at a time."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                made = list(zip(*(make(t.as_py()) for t in batch.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(made, fields, strict=True))], names=["node", *(n for n, _ in fields)])

    return texts.select("node", "text").mapInArrow(run, f"node long, {schema}")


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, size, mark, blocks) of texts (node, text)."""

    def make(text: str | None) -> tuple:
        h = shingle_hashes(text, shingle)
        return set_fingerprint(h), len(h), parity_mark(h).tobytes(), sketch_blocks(h)

    return _each_text(texts, "fp long, size int, mark binary, blocks array<long>", make)


def similar_enough(size_u: np.ndarray, size_v: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes with so many common members have the Jaccard similarity."""
    return common * (1 + similarity) >= (size_u + size_v) * similarity - 1e-6


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v, ...) whose whole shingle sets have the similarity."""
    nodes = stage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "nodes")
    some = texts.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = stage(_each_text(some, "hashes binary", lambda t: (shingle_hashes(t, shingle).tobytes(),)), "sets")
    both = pairs.join(sets.toDF("u", "hu"), "u").join(sets.toDF("v", "hv"), "v")
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hu, hv = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            good = []
            for a, b in zip(hu, hv, strict=True):
                x, y = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(similar_enough(len(x), len(y), common, similarity)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:-2]], names=names)

    out = stage(both.select(*names, "hu", "hv").mapInArrow(run, pairs.schema), "verified")
    discard(nodes, sets)
    return out


def _sure(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v, ...), those that parity marks and sizes do not rule out; no pair of the similarity is lost."""
    both = pairs.join(marks.toDF("u", "nu", "mu"), "u").join(marks.toDF("v", "nv", "mv"), "v")
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, mu, nv, mv = batch.columns[-4:]
            u, v = (np.frombuffer(b"".join(m.to_pylist()), np.uint64).reshape(-1, MARK) for m in (mu, mv))
            apart = np.bitwise_count(u ^ v).sum(axis=1)
            able = possible(nu.to_numpy().astype(float), nv.to_numpy().astype(float), apart, similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(able)) for c in batch.columns[:-4]], names=names)

    return both.select(*names, "nu", "mu", "nv", "mv").mapInArrow(run, pairs.schema)


def possible(nu: np.ndarray, nv: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, whose marks differ in `apart` bits, may have the similarity."""
    return (apart * (1 + similarity) <= (nu + nv) * (1 - similarity) + 1e-6) & (np.minimum(nu, nv) >= similarity * np.maximum(nu, nv) - 1e-6)


def _rest_of_blocks(similarity: float):
    """Over rows (key, ..., node, root, size, mark) sorted by all but the last four, the pairs of each group that have two roots and may have the similarity."""

    def pairs_of(node: np.ndarray, root: np.ndarray, size: np.ndarray, mark: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(size, kind="stable")
        node, root, size, mark = node[order], root[order], size[order], mark[order]
        for i in range(len(node) - 1):
            to = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right"))  # larger ones are no match
            apart = np.bitwise_count(mark[i + 1 : to] ^ mark[i]).sum(axis=1)
            ok = possible(size[i], size[i + 1 : to], apart, similarity) & (root[i + 1 : to] != root[i])
            for j in np.flatnonzero(ok) + i + 1:
                a, b = (i, j) if node[i] < node[j] else (j, i)
                yield int(node[a]), int(node[b]), int(root[a]), int(root[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        names = ["u", "v", "ru", "rv"]

        def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]), np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint64).reshape(-1, MARK)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            change = np.zeros(len(cols[0]), dtype=bool)
            change[0] = True
            for c in cols[:-4]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            held = [c[starts[-1] :] for c in cols]
            found: list[tuple] = []
            for k in np.flatnonzero(np.diff(starts) > 1):
                found += pairs_of(*(c[starts[k] : starts[k + 1]] for c in cols[-4:]))
            yield from emit(found)
        if held is not None and len(held[0]) > 1:
            yield from emit(list(pairs_of(*held[-4:])))

    return run


def _renamed(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) with the roots that links (u, v) join made one; staged."""
    joined = connected_components(links.select("u", "v")).select(F.col("node").alias("root"), F.col("root").alias("least"))
    out = stage(roots.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "classes")
    discard(roots)
    return out


def similar_classes(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, hot: int = HOT) -> DataFrame:
    """(node, root) for every node of texts (node, text): root is one node of its class.

    texts may repeat a node with its text. A class is the closure of the pairs found whose sets of shingles
    have the similarity (Jaccard), which the whole sets decide. Pairs are sought in three passes:

    1. pigeonhole blocks of 64-bit fingerprints, a spanning forest of those within `distance` bits;
    2. blocks of minima: of each shared block, every node with the node of least hash;
    3. of blocks that still hold two classes, all pairs of different classes, but those that parity marks
       rule out, which is done within the task, so that pairs leave it only if they are nearly similar. A block
       of over `hot` nodes is cut into chunks, and every pair of chunks is one task's work.

    A pair of similarity s shares a block of minima with probability block_recall(s): over 0.98 at 0.8 and
    over 0.9999 at 0.9. Keys are sent with the node only; a text sends as many as there are blocks, whatever
    its length and however many texts there are.
    """
    found = stage(_sketches(texts, shingle).groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "size", "mark", "blocks")]), "sketches")
    marks = found.select("node", "size", "mark")
    roots = stage(found.select("node", F.col("node").alias("root")), "classes")

    fps = stage(found.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = links(fps.select("fp"), distance)
    of = lambda name: fps.select(F.col("fp").alias(f"f{name}"), F.col("node").alias(name))
    pairs = near.toDF("fu", "fv").join(of("u"), "fu").join(of("v"), "fv").select("u", "v")
    own = found.join(fps.withColumnRenamed("node", "v"), "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    first = _verified(stage(_sure(pairs.union(own).distinct(), marks, similarity), "pairs"), texts, shingle, similarity)
    roots = _renamed(roots, first)

    keyed = found.select("node", F.posexplode("blocks").alias("block", "key"))
    heads = keyed.groupBy("block", "key").agg(F.min_by("node", F.xxhash64("node", "block")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(keyed.join(heads, ["block", "key"]), "shared")
    class_of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    pairs = shared.where("node <> head").select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct()
    pairs = pairs.join(class_of("u"), "u").join(class_of("v"), "v").where("ru <> rv").select("u", "v", "ru", "rv")
    second = _verified(stage(_sure(pairs, marks, similarity), "pairs"), texts, shingle, similarity)
    roots = _renamed(roots, second.select(F.col("ru").alias("u"), F.col("rv").alias("v")))

    open_ = shared.join(roots, "node").groupBy("block", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2")
    left = shared.select("block", "key", "node").join(open_.select("block", "key", "n"), ["block", "key"]).join(roots, "node").join(marks, "node")
    chunks = F.ceil(F.col("n") / hot).cast("int")
    left = left.withColumn("s", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("s")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    left = left.select("block", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "root", "size", "mark")
    groups = ["block", "key", "i", "j"]
    pairs = left.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_rest_of_blocks(similarity), "u long, v long, ru long, rv long").distinct()
    third = _verified(stage(pairs, "pairs"), texts, shingle, similarity)
    roots = _renamed(roots, third.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    discard(found, fps, shared, first, second, third)
    return roots


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each class the row with the least doc_id (a null id only where no other is).

    Texts are near-duplicates if the Jaccard similarity of their sets of word shingles is the given one or
    more; a class is the closure of that, as similar_classes() finds it. No other texts are joined, but for
    chance equality of 64-bit hashes. Where several rows of the class share the least doc_id, the one with the
    least text hash stays, and of equal ones any one. All columns of docs are returned, and no others,
    whatever their names.
    """
    taken = {c.lower() for c in docs.columns}
    name = lambda base: next(x for x in (base + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken)
    kid, kfp, krow = name("__fs_id"), name("__fs_fp"), name("__fs_row")
    text = docs["text"].cast("string")
    fps = stage(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("fp")), "texts")
    rows = fps.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    per_id = stage(rows.groupBy("doc_id").agg(F.sum("n").alias("n")), "ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("b")
    distinct = stage(fps.groupBy("fp").agg(first), "distinct")
    classes = similar_classes(docs.select(F.xxhash64(text).alias("node"), text.alias("text")), shingle, similarity)
    best = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("class_fp")).agg(F.min("b").alias("b"))
    best = stage(best.select(F.col("b.doc_id").alias(kid), F.col("b.fp").alias(kfp)), "keepers")
    twice = per_id.where("n > 1").select(F.col("doc_id").alias(kid))
    one = best.join(twice, best[kid].eqNullSafe(twice[kid]), "left_anti")
    several = stage(best.join(twice, best[kid].eqNullSafe(twice[kid]), "left_semi"), "several")
    plain = docs.join(one, docs["doc_id"].cast("long").eqNullSafe(one[kid]), "left_semi")
    if several.limit(1).count() == 0:
        return plain
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(krow), docs["doc_id"].cast("long").alias("rid"), F.xxhash64(text).alias("rfp"))
    marked = packed.join(several, packed["rid"].eqNullSafe(several[kid]) & (packed["rfp"] == several[kfp]), "left_semi")
    single = marked.groupBy("rid", "rfp").agg(F.first(krow).alias(krow)).select(f"{krow}.*")
    return plain.unionByName(single)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all of documents: 4-word shingles, 4 bits."""
    docs = table(spark, sf_dir, "documents")
    out = near_duplicates(docs, shingle=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
