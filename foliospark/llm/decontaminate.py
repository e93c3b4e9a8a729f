"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (runs of letters and digits, case folded). An item of W words is
found in a document if some stretch of the document is within floor(TOLERANCE x W) word edits of it. The
CGK random walk reads a sequence with a pointer that a random bit per (step, symbol) moves or holds; the
3W symbols read turn edit distance into Hamming distance. Each repetition samples a few of the 3W places
as a key, and windows of W words that share a key with an item of W words are verified by dynamic
programming, which alone decides. The repetitions are as many as reach RECALL on items drawn at random under the
largest number of random edits in running text, measured before the search; should MOST_WALKS not reach it, every
window that passes the next test is verified.

A window is embedded only if enough of its word pairs occur in items of its size: an edit spoils at most
two pairs, so a window within d edits keeps W - 1 - 2d of them. The test loses no window. Items of under SHORT
words allow no edit; their windows are found by equality of all their words.

Items are broadcast in blocks of about BLOCK different texts; each block is one pass over the documents, and its
results are a table before the next begins.

Edge cases. A null or empty text has no words and matches nothing; a null or wordless item is not searched.
Equal items are searched once and each reported. Repeated rows are each judged. An empty table on either side gives no
matches. Null ids are kept. Extra columns pass through drop_contaminated() whatever their names. Very long
texts are searched whole; a stretch never spans two documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import words as W
from foliospark.scratch import stage
from foliospark.sources import table

TOLERANCE = 0.2
RECALL = 0.99
SHORT = 5  # TOLERANCE x fewer words is under one edit
BLOCK = 20_000
PLACES = 3  # sampled places of a key
PER_WALK = 4  # keys of one walk
MOST_WALKS = 64
PAD = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x2545F4914F6CDD1D)
_BITS = 22


class Group(NamedTuple):
    """Items of one size: their words (items x size), ids, and the lossless least number of pairs."""

    size: int
    rows: np.ndarray
    ids: list
    edits: int
    pairs: int


class Index(NamedTuple):
    groups: list[Group]
    pairs: np.ndarray  # sorted hashes of all word pairs of items
    member: np.ndarray  # pairs x groups, packed bits
    filter: np.ndarray  # coarse bitmap of pairs
    walks: int  # 0: every window that passes the test on pairs is verified
    own: list[np.ndarray]  # each group's items' pairs
    tables: list[list[np.ndarray]]  # each group's items' keys by walk
    short: list[Group]  # items that allow no edit


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return W.mix(h[..., :-1] * _PAIR + h[..., 1:])


def embed(rows: np.ndarray, walk: int) -> np.ndarray:
    """CGK: 3 x width symbols read from each row (n x width) by the given walk."""
    n, width = rows.shape
    padded = np.concatenate([rows, np.full((n, 1), PAD)], axis=1)
    at, every, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, 3 * width), np.uint64)
    for step in range(3 * width):
        out[:, step] = symbol = padded[every, at]
        move = (W.mix(symbol ^ np.uint64((walk * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)).astype(np.int64)
        at = np.minimum(at + move, width)
    return out


def keys(rows: np.ndarray, walk: int) -> np.ndarray:
    """n x PER_WALK sampled keys of one walk."""
    read = embed(rows, walk)
    rng = np.random.default_rng(10_007 * rows.shape[1] + walk)
    out = np.empty((len(rows), PER_WALK), np.uint64)
    for k in range(PER_WALK):
        places = rng.integers(0, read.shape[1], PLACES)
        key = np.full(len(rows), k + 1, np.uint64)
        for p in places:
            key = W.mix(key * _PAIR + read[:, p] + np.uint64(p))
        out[:, k] = key
    return out


def _perturbed(row: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The window of a running text at an edited copy of row: where the copy is shorter, other words follow."""
    out = list(row)
    for _ in range(edits):
        kind, at = rng.integers(0, 3), int(rng.integers(0, len(out) + 1))
        if kind == 0:
            out.insert(at, rng.integers(1, 1 << 63))
        elif out and at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.integers(1, 1 << 63)]
    return np.array([*out, *rng.integers(1, 1 << 63, len(row))], dtype=np.uint64)[: len(row)]


def walks_for(groups: list[Group], recall: float = RECALL, trials: int = 1800, most: int = MOST_WALKS) -> int:
    """The least number of walks by which at least recall of `trials` perturbed items, drawn at random, meet their item in a key; 0 if `most` do not reach it."""
    rng, pending = np.random.default_rng(11), []
    drawn = np.bincount(rng.choice(len(groups), trials, p=np.array([len(g.rows) for g in groups]) / sum(len(g.rows) for g in groups)), minlength=len(groups))
    for g, n in zip(groups, drawn, strict=True):
        if n:
            rows = g.rows[rng.integers(0, len(g.rows), n)]
            pending.append((rows, np.stack([_perturbed(r, g.edits, rng) for r in rows])))
    missed = trials
    for walk in range(most + 1):
        if trials - missed >= recall * trials:
            return max(1, walk)
        if walk == most:
            break
        for i, (a, b) in enumerate(pending):
            if len(a):
                met = (keys(a, walk) == keys(b, walk)).any(axis=1)
                missed -= int(met.sum())
                pending[i] = (a[~met], b[~met])
    return 0


def build(ids: list, texts: list, tolerance: float = TOLERANCE, most: int = MOST_WALKS) -> Index | None:
    """The index of one block of items, or None if no item has a word."""
    scanned = W.scan(pa.array(texts, pa.string()), alnum=True)
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(scanned.bounds)):
        if n:
            by_size.setdefault(int(n), []).append(i)
    groups, short = [], []
    for n, members in sorted(by_size.items()):
        rows = np.stack([scanned.hashes[scanned.bounds[i] : scanned.bounds[i] + n] for i in members])
        edits = int(tolerance * n)
        pairs = n - 1 - 2 * edits
        (groups if n >= SHORT and pairs > 0 else short).append(Group(n, rows, [ids[i] for i in members], edits, pairs))
    if any(g.edits for g in short):
        raise ValueError("the tolerance leaves an item no word pair to be found by")
    if not groups and not short:
        return None
    each = [np.unique(pair_hashes(g.rows)) for g in groups]
    pairs = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
    member = np.zeros((len(pairs), len(groups)), dtype=bool)
    for k, own in enumerate(each):
        member[np.searchsorted(pairs, own), k] = True
    coarse = np.zeros(1 << _BITS, dtype=bool)
    coarse[(pairs >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    walks = walks_for(groups, most=most) if groups else 1
    return Index(groups, pairs, member, coarse, walks, [pair_hashes(g.rows) for g in groups], [[keys(g.rows, x) for x in range(walks)] for g in groups], short)


def _sequences(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        out = W.mix(out * _PAIR + h[k : k + len(out)])
    return out


def _short_found(index: Index, w: W.Words) -> list[tuple[int, object, int, int]]:
    """Items of few words, by equality."""
    out = set()
    for g in index.short:
        wanted = np.array([_sequences(r, g.size)[0] for r in g.rows], np.uint64)
        order = np.argsort(wanted, kind="stable")
        ranked, here = wanted[order], _sequences(w.hashes, g.size)
        hit = np.flatnonzero(ranked[np.minimum(np.searchsorted(ranked, here), len(ranked) - 1)] == here)
        row = np.searchsorted(w.bounds, hit, "right") - 1
        inside = hit + g.size <= w.bounds[row + 1]
        for at, r in zip(hit[inside].tolist(), row[inside].tolist(), strict=True):
            for k in order[np.searchsorted(ranked, here[at], "left") : np.searchsorted(ranked, here[at], "right")].tolist():
                out.add((r, g.ids[k], 0, g.size))
    return list(out)


def edit_distance_in(item: np.ndarray, text: np.ndarray) -> int:
    """The least word edit distance of item to any stretch of text."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, symbol in enumerate(item, 1):
        now = np.empty_like(row)
        now[0] = k
        now[1:] = np.minimum(row[:-1] + (text != symbol), row[1:] + 1)
        row = np.minimum.accumulate(now - steps) + steps
    return int(row.min())


def _starts(found: np.ndarray, width: int, least: int) -> np.ndarray:
    """Starts of windows of width words that hold at least `least` of the sorted pair places found."""
    if len(found) < least:
        return found[:0]
    first, last = found[: len(found) - least + 1], found[least - 1 :]
    ok = last - first <= width - 2
    lo, hi = last[ok] - (width - 2), first[ok]
    if not len(lo):
        return lo
    runs = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1])
    begin = lo[runs]
    end = np.maximum.reduceat(hi, np.flatnonzero(runs))
    sizes = end - begin + 1
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def search(index: Index, texts: pa.Array) -> list[tuple[int, object, int, int]]:
    """(row, item id, edits, item words) of every item found in every text of the column."""
    w = W.scan(texts, alnum=True)
    found = _short_found(index, w)
    if len(w.hashes) < 2 or not index.groups:
        return sorted(found, key=lambda x: (x[0], str(x[1])))
    gap = 2 * max(g.size for g in index.groups) + 2
    pair = pair_hashes(w.hashes)
    hit = np.flatnonzero(index.filter[(pair >> np.uint64(64 - _BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(index.pairs, pair[hit]), len(index.pairs) - 1)
    real = index.pairs[k] == pair[hit]
    hit, k = hit[real], k[real]
    doc = np.searchsorted(w.bounds, hit, "right") - 1
    inside = hit + 1 < w.bounds[doc + 1]  # no pair spans two texts
    hit, k, doc = hit[inside], k[inside], doc[inside]
    spread = hit + doc * gap  # windows never reach the next text
    up, down = W.powers(len(w.hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * up[: len(w.hashes)])])
    out = found
    for g_at, g in enumerate(index.groups):
        mine = index.member[k, g_at]
        starts = _starts(spread[mine], g.size, g.pairs)
        if not len(starts):
            continue
        near = spread[np.minimum(np.searchsorted(spread, starts), len(spread) - 1)]
        rows = doc[np.searchsorted(spread, near)]
        starts = starts - rows * gap
        lo, hi = w.bounds[rows], w.bounds[rows + 1]
        ok = (starts < hi) & (starts + g.size > lo)
        starts, rows, lo, hi = np.maximum(starts[ok], lo[ok]), rows[ok], lo[ok], hi[ok]
        if not len(starts):
            continue
        stops = np.minimum(starts + g.size, hi)
        content = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
        _, first, same = np.unique(content, return_index=True, return_inverse=True)  # equal windows are embedded once
        where = starts[first, None] + np.arange(g.size)
        windows = np.where(where < stops[first, None], w.hashes[np.minimum(where, len(w.hashes) - 1)], PAD)
        met = np.full((len(first), len(g.rows)), index.walks == 0)
        for walk in range(index.walks):
            theirs, ours = index.tables[g_at][walk], keys(windows, walk)
            for c in range(PER_WALK):
                order = np.argsort(theirs[:, c], kind="stable")
                ranked = theirs[order, c]
                a, b = np.searchsorted(ranked, ours[:, c], "left"), np.searchsorted(ranked, ours[:, c], "right")
                for x in np.flatnonzero(b > a):
                    met[x, order[a[x] : b[x]]] = True
        at, which = np.nonzero(met[same])
        done: dict[tuple[int, int], list[list[int]]] = {}
        for row, i, start in sorted(zip(rows[at].tolist(), which.tolist(), starts[at].tolist(), strict=True)):
            at = done.get((row, i))
            if at and start <= at[-1][1] + g.size:
                at[-1][1] = start
            else:
                done.setdefault((row, i), []).append([start, start])
        for (row, i), stretches in done.items():
            ends = w.bounds[row], w.bounds[row + 1]
            edits = g.edits + 1
            for a, b in stretches:
                text = w.hashes[max(ends[0], a - g.edits) : min(ends[1], b + g.size + g.edits)]
                if np.isin(index.own[g_at][i], pair_hashes(text)).sum() >= g.pairs:  # fewer pairs cannot be within the edits
                    edits = min(edits, edit_distance_in(g.rows[i], text))
            if edits <= g.edits:
                out.append((row, g.ids[i], edits, g.size))
    return sorted(out, key=lambda x: (x[0], str(x[1])))


def _blocks(items: DataFrame, block: int) -> Iterator[Index]:
    """An index for each block of items (text hash, text); a block is about `block` rows on the driver."""
    n = -(-items.count() // block)
    for b in range(n):
        rows = (items.where(F.pmod(F.xxhash64(F.lit(1), "t"), F.lit(n)) == b) if n > 1 else items).collect()
        found = build([r["i"] for r in rows], [r["t"] for r in rows])
        if found is not None:
            yield found


def _different(items: DataFrame) -> DataFrame:
    """(i, t): each different item text and its hash."""
    text = F.col("text").cast("string")
    return items.where(text.isNotNull()).select(F.xxhash64(text).alias("i"), text.alias("t")).groupBy("i").agg(F.first("t").alias("t"))


def contaminations(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, edits, item_words): one row for each row of docs and item found in it."""
    schema = "doc_id long, item long, edits int, item_words int"
    names = [x.split()[0] for x in schema.split(", ")]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts: list[DataFrame] = []
    for index in _blocks(_different(items), block):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in (x for b in batches for x in W.pieces(b, 1)):
                found = search(index, batch.column(1))
                rows = pa.array([x[0] for x in found], pa.int64())
                rest = [pa.array([x[k] for x in found], kind) for k, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *rest], names=names)

        if parts:  # one block's index at a time
            parts[-1] = stage(parts[-1], "contaminations")
        parts.append(picked.mapInArrow(run, schema))
    out = functools.reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    owners = items.where("text is not null").select(F.xxhash64(F.col("text").cast("string")).alias("item"), F.col("item_id").cast("long").alias("item_id"))
    return out.join(owners, "item").select("doc_id", "item_id", "edits", "item_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item is found, with the columns of docs."""
    place, kept, first = docs.columns.index("text"), docs, True
    for index in _blocks(_different(items), block):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in (x for b in batches for x in W.pieces(b, place)):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in search(index, batch.column(place).cast(pa.string()))]] = False
                yield batch.filter(pa.array(clean))

        kept = (kept if first else stage(kept, "clean")).mapInArrow(run, docs.schema)
        first = False
    return kept


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document: doc_id, item_id, edits, item_words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminations(docs, items)
