"""Scores of a whole table for blocks of questions: top ranks, exact ranks of chosen pairs, and means, in one pass each.

A block of questions is bounded (QUERY_BLOCK) and travels with the task; the table is read where it lies and is
never joined to the questions, so no pair of a question and a row leaves a task unless it is asked for. A
score is a matrix of questions by rows, rounded to six digits; -inf marks rows that share nothing with a
question and have no rank. Ties go to the smaller id.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import ACCENTED, PLAIN, PLAIN_WORD, TOKEN
from foliospark.scratch import discard, stage

QUERY_BLOCK = 2048
CELLS = 1 << 22  # questions x rows scored at once


class Scorer(NamedTuple):
    """rows: doc_id first, then what score() reads of a batch; ids: the block's questions."""

    rows: DataFrame
    ids: np.ndarray
    score: Callable[[pa.RecordBatch], np.ndarray]


def _slices(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[pa.RecordBatch]:
    most = max(1, min(512, CELLS // max(1, questions)))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _union(spark, parts: list[DataFrame], schema: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


class _Best:
    """The best k rows of each of n questions so far: q, d, v (question, id, score), and `bar`, the k-th best score of each."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.bar = n, k, np.full(n, -np.inf)
        self.q, self.d, self.v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        q, d, v = np.concatenate([self.q, at]), np.concatenate([self.d, ids]), np.concatenate([self.v, scores])
        order = np.lexsort((d, -v, q))
        q, d, v = q[order], d[order], v[order]
        first = np.searchsorted(q, np.arange(self.n))
        nth = np.arange(len(q)) - first[q]
        self.q, self.d, self.v, nth = (c[nth < self.k] for c in (q, d, v, nth))
        full = nth == self.k - 1
        self.bar[self.q[full]] = self.v[full]


def top(spark, scorers: list[Scorer], k: int) -> DataFrame:
    """(query_id, doc_id, score): every task's best k of each question."""
    schema, names = "query_id long, doc_id long, score double", ["query_id", "doc_id", "score"]
    parts = []
    for s in scorers:

        def run(batches: Iterator[pa.RecordBatch], s: tuple = (s.ids, s.score)) -> Iterator[pa.RecordBatch]:
            ids, score = s
            best = _Best(len(ids), k)
            for batch in _slices(batches, len(ids)):
                x = score(batch)
                at, row = np.nonzero((x >= best.bar[:, None]) & (x > -np.inf))
                best.add(at, _ids(batch)[row], x[at, row])
            if len(best.q):
                yield _rows(names, ids[best.q], best.d, best.v + 0.0)

        parts.append(s.rows.mapInArrow(run, schema))
    return _union(spark, parts, schema)


def pairs(spark, scorers: list[Scorer], chosen: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(query_id, doc_id, score) of the pairs for which chosen(question ids, batch) holds and that have a score."""
    schema, names = "query_id long, doc_id long, score double", ["query_id", "doc_id", "score"]
    parts = []
    for s in scorers:

        def run(batches: Iterator[pa.RecordBatch], s: tuple = (s.ids, s.score)) -> Iterator[pa.RecordBatch]:
            ids, score = s
            for batch in _slices(batches, len(ids)):
                x = score(batch)
                q, row = np.nonzero(chosen(ids, batch) & (x > -np.inf))
                yield _rows(names, ids[q], _ids(batch)[row], x[q, row] + 0.0)

        parts.append(s.rows.mapInArrow(run, schema))
    return _union(spark, parts, schema)


def stats(spark, scorers: list[Scorer], chosen: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(query_id, n, mean, best) over the chosen pairs of each question that has any."""
    schema, names = "query_id long, n long, total double, best double", ["query_id", "n", "total", "best"]
    parts = []
    for s in scorers:

        def run(batches: Iterator[pa.RecordBatch], s: tuple = (s.ids, s.score)) -> Iterator[pa.RecordBatch]:
            ids, score = s
            n, total, best = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), -np.inf)
            for batch in _slices(batches, len(ids)):
                x = score(batch)
                ok = chosen(ids, batch) & (x > -np.inf)
                n += ok.sum(axis=1)
                total += np.where(ok, x, 0.0).sum(axis=1)
                best = np.maximum(best, np.where(ok, x, -np.inf).max(axis=1, initial=-np.inf))
            some = n > 0
            yield _rows(names, ids[some], n[some], total[some], best[some])

        parts.append(s.rows.mapInArrow(run, schema))
    out = _union(spark, parts, schema).groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.max("best").alias("best"))
    return out.select("query_id", "n", (F.col("t") / F.col("n")).alias("mean"), "best")


def ranks(spark, scorers: list[Scorer], candidates: DataFrame) -> DataFrame:
    """candidates (query_id, doc_id, score) with their rank over the whole table: one more than the rows that are better.

    The candidates of a block of questions travel with the tasks, each of which counts what is better among its rows.
    """
    schema, names = "query_id long, doc_id long, score double, better long", ["query_id", "doc_id", "score", "better"]
    parts = []
    wanted = candidates.select("query_id", "doc_id", "score").toPandas().sort_values(["query_id", "score", "doc_id"])
    for s in scorers:
        own = wanted[wanted["query_id"].isin(s.ids)]
        cq, cd, cs = own["query_id"].to_numpy(np.int64), own["doc_id"].to_numpy(np.int64), own["score"].to_numpy(float)

        def run(batches: Iterator[pa.RecordBatch], s: tuple = (s.ids, s.score), c: tuple = (cq, cd, cs)) -> Iterator[pa.RecordBatch]:
            (ids, score), (cq, cd, cs) = s, c
            better = np.zeros(len(cq), np.int64)
            spans = [(np.searchsorted(cq, i, "left"), np.searchsorted(cq, i, "right")) for i in ids]
            for batch in _slices(batches, len(ids)):
                x, d = score(batch), _ids(batch)
                for k, (a, b) in enumerate(spans):
                    if a == b:
                        continue
                    ranked = np.sort(x[k])
                    lo, hi = np.searchsorted(ranked, cs[a:b], "left"), np.searchsorted(ranked, cs[a:b], "right")
                    better[a:b] += len(ranked) - hi
                    for j in np.flatnonzero(hi > lo) + a:  # ties
                        better[j] += int(((x[k] == cs[j]) & (d < cd[j])).sum())
            if len(cq):
                yield _rows(names, cq, cd, cs, better)

        parts.append(s.rows.mapInArrow(run, schema))
    out = _union(spark, parts, schema).groupBy("query_id", "doc_id", "score").agg(F.sum("better").alias("better"))
    return out.select("query_id", "doc_id", "score", (F.col("better") + 1).cast("int").alias("rank"))


class _Labelled:
    """A block of questions of one label: its relevant rows in order of rank, and how many rows of the table come before each."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.q, self.seen, self.x = k, [], [], [], []
        self.order: list | None = None

    def add(self, phase: int, ids: np.ndarray, v: np.ndarray) -> None:
        if phase == 0:
            self.ids.append(ids)
            self.q.append(v)
            return
        x = np.round(np.concatenate(self.q) @ v.T, 6)
        if phase == 1:
            self.seen.append(ids)
            self.x.append(x)
            return
        self._sort()
        after = np.searchsorted(self.known, ids, "right")  # among rows of one score the smaller id is better
        for (scores, keys, before), row in zip(self.order, -x, strict=True):
            at = np.searchsorted(scores, row)
            tie = scores[np.minimum(at, len(scores) - 1)] == row
            np.add.at(before, np.searchsorted(keys, at * (len(self.known) + 1) + np.where(tie, after, 0)), 1)

    def _sort(self) -> None:
        if self.order is not None:
            return
        ids, x = np.concatenate(self.seen), -np.concatenate(self.x, axis=1)
        place = np.argsort(ids, kind="stable")
        self.known, self.order = ids[place], []
        for row in x[:, place]:
            by = np.argsort(row, kind="stable")
            scores, at = np.unique(row[by], return_inverse=True)
            self.order.append((scores, at * (len(ids) + 1) + by, np.zeros(len(ids) + 1, np.int64)))
        self.seen, self.x = [], []

    def sums(self) -> pa.RecordBatch:
        rows = []
        for i, (_, keys, before) in zip(np.concatenate(self.ids).tolist(), self.order or [], strict=bool(self.order)):
            rank = np.cumsum(before)[: len(keys)] + 1
            top = rank[rank <= self.k]
            rows.append((i, len(top), len(rank), float((np.arange(1, len(rank) + 1) / rank).sum()), int(rank[0]), float((1 / np.log2(top + 1)).sum())))
        return pa.RecordBatch.from_pylist([dict(zip(_SUMS, r, strict=True)) for r in rows], schema=pa.schema(zip(_SUMS, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)))


_SUMS = ("query_id", "top_hits", "all_hits", "precisions", "first", "dcg")


def labelled_sums(vectors: DataFrame, queries: DataFrame, k: int, block: int = 128) -> DataFrame:
    """(query_id, top_hits, all_hits, precisions, first, dcg) of the whole ranking of vectors (doc_id, embedding, label) for each of queries (query_id, embedding, label), rows of its label being relevant.

    That is every question against every row, by nature the square of the table. Questions go in blocks of one label to
    the tasks, each of which reads the rows of the label, then all rows as they come: it holds questions x relevant
    rows of one block, the driver nothing. A question without a row of its label is left out.
    """
    nth = F.row_number().over(Window.partitionBy("label").orderBy("query_id"))
    asked = queries.where("label is not null and embedding is not null").select(F.col("query_id").cast("long").alias("id"), "embedding", "label", F.floor((nth - 1) / block).alias("part"))
    asked = asked.withColumn("block", F.struct("label", "part"))
    rows = vectors.where("embedding is not null").select(F.col("doc_id").cast("long").alias("id"), "embedding", "label")
    blocks = asked.select("block").distinct()  # a row of every `block` questions
    own = rows.join(F.broadcast(blocks), F.col("label") == F.col("block.label"))
    every = functools.reduce(DataFrame.unionByName, [f.select("block", F.lit(p).alias("phase"), "id", "embedding") for p, f in enumerate((asked, own, rows.crossJoin(F.broadcast(blocks))))])
    tasks = 3 * vectors.sparkSession.sparkContext.defaultParallelism
    dealt = every.select(F.to_json("block").alias("block"), "phase", "id", F.col("embedding").cast("array<float>").alias("embedding")).repartition(tasks, "block").sortWithinPartitions("block", "phase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            names, phases = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
            code = names.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(phases) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if (its := names.dictionary[int(code[a])].as_py()) != name:
                    if held is not None:
                        yield held.sums()
                    name, held = its, _Labelled(k)
                for at in range(a, b, 4096):
                    part = batch.slice(at, min(4096, b - at))
                    v = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(float)
                    held.add(int(phases[a]), part.column(2).to_numpy(zero_copy_only=False), v)
        if held is not None:
            yield held.sums()

    return dealt.mapInArrow(run, "query_id long, top_hits long, all_hits long, precisions double, first long, dcg double").where("all_hits > 0")


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """The queries' rows, about `block` at a time."""
    n = max(1, -(-queries.count() // block))
    for b in range(n):
        rows = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else queries).collect()
        if rows:
            yield rows


def dense_scorers(vectors: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> list[Scorer]:
    """Inner products of vectors (doc_id, embedding, ...) with queries (query_id, embedding)."""
    rows = vectors.withColumn("doc_id", F.col("doc_id").cast("long")).where("embedding is not null")
    rows = rows.select("doc_id", "embedding", *[c for c in rows.columns if c not in ("doc_id", "embedding")])
    out = []
    for found in _blocks(queries.select(F.col("query_id").cast("long"), "embedding"), block):
        q = np.array([r[1] for r in found], float)

        def score(batch: pa.RecordBatch, q: np.ndarray = q) -> np.ndarray:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            return np.round(q @ v.T, 6)

        out.append(Scorer(rows, np.array([r[0] for r in found], np.int64), score))
    return out


class Terms(NamedTuple):
    """How a text's terms become places and weights: names of places (or a number of hashed places) and the weight of (row, place, count, terms in the row)."""

    names: pa.Array | None
    size: int
    weigh: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    def places(self, terms: pa.Array) -> np.ndarray:
        """The place of each term, -1 for none."""
        if self.names is not None:
            return pc.fill_null(pc.index_in(terms, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        known = terms.dictionary_encode()
        table = np.array([bucket(t, self.size) for t in known.dictionary.to_pylist()] or [0])
        return table[known.indices.to_numpy(zero_copy_only=False)]


@functools.lru_cache(maxsize=1 << 18)
def bucket(term: str, size: int) -> int:
    """A place by a checksum any engine can compute."""
    return int.from_bytes(hashlib.md5(term.encode(), usedforsecurity=False).digest()[:4]) % size


_ACCENT, _PLAIN = re.compile(f"[{ACCENTED}]"), dict(zip(ACCENTED, PLAIN, strict=True))
_PATTERNS = {"token": re.compile(TOKEN), "word": re.compile(PLAIN_WORD), "char": re.compile(PLAIN_WORD)}


def text_words(texts: pa.Array, kind: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a column of lower-case texts, one after another, and how many each text has; accents are off but for tokens."""
    pattern, found = _PATTERNS[kind], []
    for t in texts.to_pylist():
        if kind != "token" and t and not t.isascii():
            t = _ACCENT.sub(lambda m: _PLAIN[m[0]], t)
        found.append(pattern.findall(t) if t else [])
    return pa.array(itertools.chain.from_iterable(found), pa.string()).dictionary_encode(), np.array([len(x) for x in found], np.int64)


def grams_in(word: str, low: int = 3, high: int = 5) -> list[str]:
    """Character grams of a word padded by one blank on each side."""
    p = f" {word} "
    return [p[i : i + n] for n in range(low, high + 1) for i in range(len(p) - n + 1)]


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 of 32 bits, unsigned; by it pyspark.ml's HashingTF places terms."""
    h, n = seed, len(data) & ~3
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
        if i < n:
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


class HashedPlaces:
    """The places that HashingTF gives terms, in place of a table of names."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.known: dict[str, int] = {}

    def get(self, term: str) -> int:
        if (at := self.known.get(term)) is None:
            h = murmur3(term.encode())
            if len(self.known) > 1 << 18:
                self.known.clear()
            at = self.known[term] = (h - (1 << 32) if h >> 31 else h) % self.size
        return at


class TextTerms:
    """Terms() of texts in place of lists of terms: the texts come to the task in lower case and are cut there, so no term is written out by itself.

    kind: `token`, `word` (words and pairs of neighbours) or `char` (grams of words); names are none for hashed places of `word` (by bucket()) and of `char` (those of HashingTF).
    """

    def __init__(self, kind: str, names: list[str] | None, size: int, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        self.kind, self.size, self.weigh = kind, size, weigh
        self.hashed = names is None
        names = names or []
        if kind == "char":
            self.place = HashedPlaces(size) if self.hashed else {g: i for i, g in enumerate(names)}
            self.held: dict[str, np.ndarray] = {}
        elif not self.hashed:
            words = sorted({w for n in names for w in n.split(" ")})
            at = {w: i for i, w in enumerate(words)}
            self.words, self.single = pa.array(words, pa.string()), np.full(len(words) + 1, -1)  # the last is for words that are unknown
            pairs = []
            for i, n in enumerate(names):
                first, _, second = n.partition(" ")
                if second:
                    pairs.append((at[first] * len(words) + at[second], i))
                else:
                    self.single[at[first]] = i
            self.pairs, self.paired = pa.array([k for k, _ in pairs], pa.int64()), np.array([i for _, i in pairs] + [-1])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count) of the known terms, ordered, and the number of words of each text."""
        words, sizes = text_words(texts, self.kind)
        code, row = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        if self.kind == "char":
            return (*self._grams(words.dictionary.to_pylist(), code, row, len(sizes)), sizes)
        if self.hashed:
            names = words.dictionary.to_pylist()
            place = np.array([bucket(w, self.size) for w in names] or [0])[code]
            near = np.flatnonzero(row[:-1] == row[1:])
            keys, at = np.unique(code[near] * max(1, len(names)) + code[near + 1], return_inverse=True)
            pair = np.array([bucket(f"{names[k // len(names)]} {names[k % len(names)]}", self.size) for k in keys.tolist()] or [0])[at]
        else:
            known = pc.fill_null(pc.index_in(words.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            w = known[code] if len(known) else code
            place = self.single[w]
            near = np.flatnonzero((row[:-1] == row[1:]) & (w[:-1] >= 0) & (w[1:] >= 0)) if len(self.pairs) else np.zeros(0, np.int64)
            pair = self.paired[pc.fill_null(pc.index_in(pa.array(w[near] * len(self.words) + w[near + 1]), value_set=self.pairs), -1).to_numpy(zero_copy_only=False)]
        key = np.concatenate([row, row[near]]) * self.size + np.concatenate([place, pair])
        key, count = np.unique(key[np.concatenate([place, pair]) >= 0], return_counts=True)
        return key // self.size, key % self.size, count, sizes

    def _grams(self, names: list[str], code: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.held) > 1 << 17:
            self.held.clear()
        lists = []
        for w in names:
            if (own := self.held.get(w)) is None:
                own = self.held[w] = np.array([i for g in grams_in(w) if (i := self.place.get(g)) is not None], np.int32)
            lists.append(own)
        length = np.array([len(x) for x in lists] or [0])
        flat, first = np.concatenate(lists) if lists else np.zeros(0, np.int32), np.cumsum(length) - length
        key, times = np.unique(row * max(1, len(names)) + code, return_counts=True)
        r, c = key // max(1, len(names)), key % max(1, len(names))
        out, step = [], 32
        for a in range(0, n, step):  # a few rows at a time, as their counts are held for all places
            lo, hi = np.searchsorted(r, (a, a + step))
            held = length[c[lo:hi]]
            at = np.repeat(first[c[lo:hi]] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            count = np.bincount(np.repeat(r[lo:hi] - a, held) * self.size + flat[at], np.repeat(times[lo:hi], held), step * self.size)
            cell = np.flatnonzero(count)
            out.append((cell // self.size + a, cell % self.size, count[cell].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def counts_of(terms: Terms | TextTerms, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the known terms of a column of term lists (or of texts), and the number of terms of each row."""
    if isinstance(terms, TextTerms):
        return terms.counts(lists)
    lists = lists.cast(pa.large_list(pa.string())) if not pa.types.is_large_list(lists.type) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    place = terms.places(lists.flatten())
    row = np.repeat(np.arange(len(sizes)), sizes)
    known = place >= 0
    key, count = np.unique(row[known] * terms.size + place[known], return_counts=True)
    return key // terms.size, key % terms.size, count, sizes


def by_length(w: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Weights at length one in each row."""
    norm = np.sqrt(np.bincount(row, w * w, n))
    return w / np.where(norm > 0, norm, 1.0)[row]


def sparse_scorers(docs: DataFrame, queries: DataFrame, terms: Terms | TextTerms, query_weight: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], block: int = QUERY_BLOCK) -> list[Scorer]:
    """Sums over shared places of the weights of docs (doc_id, terms array) and queries (query_id, terms array); with TextTerms the terms are lower-case texts."""
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "terms"), []
    for found in _blocks(queries.select(F.col("query_id").cast("long"), "terms"), block):
        q, place, count, sizes = counts_of(terms, pa.array([r[1] for r in found], pa.string()) if isinstance(terms, TextTerms) else pa.array([r[1] or [] for r in found], pa.list_(pa.string())))
        weight = query_weight(q, place, count, sizes)
        order = np.argsort(place, kind="stable")
        q, place, weight = q[order], place[order], weight[order]
        begin = np.searchsorted(place, np.arange(terms.size + 1))

        def score(batch: pa.RecordBatch, index: tuple = (begin, q, weight, len(found), terms)) -> np.ndarray:
            begin, q, weight, m, terms = index
            n = batch.num_rows
            row, place, count, sizes = counts_of(terms, batch.column(1))
            w = terms.weigh(row, place, count, sizes)
            held = begin[place + 1] - begin[place]
            some = np.flatnonzero(held)
            row, w, held, first = row[some], w[some], held[some], begin[place[some]]
            at = np.repeat(first - (np.cumsum(held) - held), held) + np.arange(held.sum())
            cell = q[at] * n + np.repeat(row, held)
            x = np.bincount(cell, np.repeat(w, held) * weight[at], m * n)
            x = np.where(np.bincount(cell, minlength=m * n) > 0, np.round(x, 6), -np.inf)
            return x.reshape(m, n)

        out.append(Scorer(rows, np.array([r[0] for r in found], np.int64), score))
    return out


PASS = 8192  # questions of one pass of sparse_top()
OFTEN = 512  # places whose weights are a dense matrix
MARGIN = 1e-4  # more than single precision loses of a sum of positive weights, relative


def placed(docs: DataFrame, terms: TextTerms) -> DataFrame:
    """(doc_id, words, place, count) of docs (doc_id, terms lower-case text): each text cut once, as lists of its known places, ascending, and their counts."""
    schema = "doc_id long, words int, place array<int>, count array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            row, place, count, sizes = terms.counts(batch.column(1))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *lists], names=["doc_id", "words", "place", "count"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "terms").mapInArrow(run, schema)


class _Asked:
    """A few of a pass's questions: the counts of their places as a dense matrix of the first places and as an index of the others."""

    def __init__(self, q: np.ndarray, place: np.ndarray, count: np.ndarray, n: int, size: int, often: int, k: int) -> None:
        self.n, self.best = n, _Best(n, k)
        self.first = np.searchsorted(q, np.arange(n + 1))
        self.place, self.count = place, count
        head = place < often
        self.head = np.zeros((n, often), np.float32)
        self.head[q[head], place[head]] = count[head]
        order = np.flatnonzero(~head)
        order = order[np.argsort(place[order], kind="stable")]
        self.q, self.weight = q[order], count[order].astype(np.float32)
        self.begin = np.searchsorted(place[order], np.arange(size + 1)).astype(np.int32)

    def meet(self, ids: np.ndarray, head: np.ndarray, row: np.ndarray, place: np.ndarray, w: np.ndarray, rest: np.ndarray, size: int) -> None:
        """Adds the best of rows with the weights w at (row, place), ordered; head holds the first places, rest tells where the others are."""
        n = len(ids)
        x = self.head @ head.T
        row_, place_ = row[rest], place[rest]
        held = self.begin[place_ + 1] - self.begin[place_]
        some = np.flatnonzero(held)
        held = held[some]
        at = np.repeat(self.begin[place_[some]] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        np.add.at(x.reshape(-1), self.q[at] * n + np.repeat(row_[some], held), np.repeat(w[rest[some]].astype(np.float32), held) * self.weight[at])
        k = self.best.k
        low = x.max(axis=1) if k == 1 else np.partition(x, n - k, axis=1)[:, n - k] if n >= k else np.zeros(self.n, np.float32)
        cut = np.maximum(np.maximum(low, self.best.bar) * (1 - MARGIN) - 2e-6, 0.0)
        near = np.flatnonzero(x.max(axis=1) >= cut)
        a, b = np.nonzero((x[near] >= cut[near, None]) & (x[near] > 0))
        keys = row * size + place
        for i in range(0, len(a), 16_384):  # those near the best in double precision
            q, r = near[a[i : i + 16_384]], b[i : i + 16_384]
            many = self.first[q + 1] - self.first[q]
            pair = np.repeat(np.arange(len(q)), many)
            own = np.repeat(self.first[q] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            key = r[pair] * size + self.place[own]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            v = np.round(np.bincount(pair, np.where(keys[found] == key, w[found] * self.count[own], 0.0), len(q)), 6)
            good = v >= self.best.bar[q]
            self.best.add(q[good], ids[r[good]], v[good])


def _once(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Of rows (id first) that are alike but for their ids the k smallest."""
    if batch.num_rows <= k:
        return batch
    lists = [(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))) for c in (batch.column(2), batch.column(3))]
    words, seen, keep = batch.column(1).to_numpy(zero_copy_only=False), {}, []
    for i in np.argsort(_ids(batch), kind="stable").tolist():
        key = (int(words[i]), *(v[(ends[i - 1] if i else 0) : ends[i]].tobytes() for v, ends in lists))
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= k:
            keep.append(i)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(sorted(keep)))


def sparse_top(rows: DataFrame, queries: DataFrame, terms: TextTerms, k: int, block: int = PASS, often: int = OFTEN) -> DataFrame:
    """As top() of sparse_scorers(), for many questions: rows are placed(), staged; weights of rows are positive, those of questions (query_id, terms lower-case text) their counts.

    Questions are taken in passes of `block`. Rows are met by a product of matrices in single precision over the first
    `often` places, which should be the frequent ones, and by an index over the others; those whose score is near the k
    best of a question are scored again in double precision, so the result is exact. Every question meets every row:
    the work grows with their product, memory does not.
    """
    schema, names = "query_id long, doc_id long, score double", ["query_id", "doc_id", "score"]
    size, weigh, often, parts = terms.size, terms.weigh, min(often, terms.size), []
    for asked in _blocks(queries.select(F.col("query_id").cast("long"), "terms"), block):
        q, place, count, _ = terms.counts(pa.array([r[1] for r in asked], pa.string()))
        held = (np.array([r[0] for r in asked], np.int64), q.astype(np.int32), place.astype(np.int32), count.astype(np.int32))

        def run(batches: Iterator[pa.RecordBatch], held: tuple = held) -> Iterator[pa.RecordBatch]:
            ids, q, place, count = held
            cuts = range(0, len(ids), QUERY_BLOCK)
            few = []
            for a in cuts:
                lo, hi = np.searchsorted(q, (a, a + QUERY_BLOCK))
                few.append(_Asked(q[lo:hi] - a, place[lo:hi].astype(np.int64), count[lo:hi].astype(float), min(QUERY_BLOCK, len(ids) - a), size, often, k))
            for whole in _slices(batches, 1):
                batch = _once(whole, k)
                sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                row, at = np.repeat(np.arange(len(sizes)), sizes), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(at):
                    continue
                w = weigh(row, at, batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
                first = at < often
                head = np.zeros((len(sizes), often), np.float32)
                head[row[first], at[first]] = w[first]
                for x in few:
                    x.meet(_ids(batch), head, row, at, w, np.flatnonzero(~first), size)
            for a, x in zip(cuts, few, strict=True):
                if len(x.best.q):
                    yield _rows(names, ids[a + x.best.q], x.best.d, x.best.v + 0.0)

        parts.append(rows.mapInArrow(run, schema))
    return _union(rows.sparkSession, parts, schema)


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, total) over docs (doc_id, terms array): in how many rows a term occurs, and how often."""
    schema, names = "term string, df long, total long", ["term", "df", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            known = lists.flatten().dictionary_encode()
            place, n = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(known.dictionary))
            once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + place) % n
            yield pa.RecordBatch.from_arrays([known.dictionary.cast(pa.string()), pa.array(np.bincount(once, minlength=len(known.dictionary))), pa.array(np.bincount(place, minlength=len(known.dictionary)))], names=names)

    return docs.select("terms").mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 2048, most: int = 1 << 22) -> Iterator[pa.Array]:
    """The first column in slices of at most so many rows, and bytes where several rows have them."""
    for batch in batches:
        at, column = 0, batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        while at < len(column):
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))))
            yield column.slice(at, stop - at)
            at = stop


def word_counts(texts: DataFrame, kind: str) -> DataFrame:
    """(term, df, total) of the words of texts (text, lower case), without pairs or grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _texts(batches):
            words, sizes = text_words(column, kind)
            code, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
            once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + code) % n
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(once, minlength=len(words.dictionary))), pa.array(np.bincount(code, minlength=len(words.dictionary)))], names=["term", "df", "total"])

    return texts.mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def known_counts(texts: DataFrame, terms: TextTerms) -> DataFrame:
    """(place, df, total) of known terms over texts (text, lower case)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(terms.size, np.int64), np.zeros(terms.size, np.int64)
        for column in _texts(batches):
            _, place, count, _ = terms.counts(column)
            df += np.bincount(place, minlength=terms.size)
            total += np.bincount(place, count, terms.size).astype(np.int64)
        some = np.flatnonzero(df)
        yield _rows(["place", "df", "total"], some, df[some], total[some])

    return texts.mapInArrow(run, "place long, df long, total long").groupBy("place").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def frequent_pairs(texts: DataFrame, words: list[str], least: int, unit: int = 1 << 22) -> tuple[DataFrame, int]:
    """(a, b, df, total, units) of pairs of neighbours among `words`, by units of about so many words: what the units that hold a pair `more` times or oftener count of it, and how many they are; and `more`.

    A pair of `least` occurrences or more is among them, as it cannot be under `more` in all units.
    """
    if not words:
        return texts.sparkSession.createDataFrame([], "a long, b long, df long, total long, units long"), 1
    value_set, w = pa.array(words, pa.string()), len(words)
    asked = texts.sparkSession.sparkContext.defaultParallelism

    def counted(more: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, once, seen = [], [], 0

            def unit_done() -> pa.RecordBatch:
                key, total = np.unique(np.concatenate(keys), return_counts=True)
                single, df = np.unique(np.concatenate(once), return_counts=True)  # the same pairs in the same order
                often = total >= more
                return _rows(["a", "b", "df", "total", "units"], np.append(key[often] // w, -1), np.append(single[often] % w, -1), np.append(df[often], 0), np.append(total[often], 0), np.ones(often.sum() + 1, np.int64))

            for column in _texts(batches):
                found, sizes = text_words(column, "word")
                known = pc.fill_null(pc.index_in(found.dictionary, value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                code, row = (known[found.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)), np.repeat(np.arange(len(sizes)), sizes)
                near = np.flatnonzero((row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0))
                key, r = code[near] * w + code[near + 1], row[near]
                order = np.lexsort((r, key))
                key, r = key[order], r[order]
                keys.append(key)
                once.append(key[np.append(True, (np.diff(key) != 0) | (np.diff(r) != 0))[: len(key)]])
                seen += len(code)
                if seen >= unit:
                    yield unit_done()
                    keys, once, seen = [], [], 0
            if keys:
                yield unit_done()

        return stage(texts.mapInArrow(run, "a long, b long, df long, total long, units long").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("df", "total", "units")]), "pairs")

    more = max(1, least // (4 * asked))
    while True:
        out = counted(more)
        units = out.where("a < 0").agg(F.sum("units")).first()[0] or 0
        if units * (more - 1) < least:
            return out.where("a >= 0").withColumn("others", F.lit(units) - F.col("units")), more
        discard(out)
        more = 1 + (least - 1) // (2 * units)
