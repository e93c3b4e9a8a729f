"""A hidden Markov language model over word classes, trained by Baum-Welch over all training rows.

A text is its words (A-Z folded) and one end. A word is known by a 64-bit hash and falls in one of at most
CLASSES classes by that hash (fewer for a small vocabulary, so that most classes hold several words), so
the emission table is bounded whatever the vocabulary; within its class a word has its smoothed share. The model's probability of a text is that of its class sequence, by the
scaled forward recursion over the whole text, times the shares of its words.

Training makes ROUNDS passes over all training rows. Every task sums expected counts and sends at most
CLASSES rows; Spark adds them up and the driver holds one table of CLASSES x STATES. Work is done by segments
of SEGMENT tokens, so that long texts are as quick as short ones; the forward and backward vectors are carried
over the cuts, so counts and scores are those of whole texts.

Word counts never leave the cluster: the words of the highest counts (at most FREQUENT of them) are
broadcast, and the other words of a text, each once with its number, are joined to the count table, which also
keeps common words out of the join. Two words of one hash would count as one; among V words that is expected V^2 / 2^65 times.

Edge cases. A null or blank text is the end alone. A row with a null id is a training row, as its
checksum is none. Repeated rows count and are scored each. Without training rows the counts are zero and
all states are alike. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import words as W
from foliospark.scratch import stage
from foliospark.sources import table

STATES = 6
CLASSES = 1 << 16
ROUNDS = 3
SEGMENT = 2048
FREQUENT = 1 << 18
END = np.uint64(0xA24BAED4963EE407)
STAY = 0.98
LN10 = float(np.log(10))


class Model(NamedTuple):
    """start: states; move: states x states; emit: classes x states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def with_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after every text, and the bounds of the texts."""
    w = W.scan(column)
    sizes = np.diff(w.bounds) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], END, np.uint64)
    inner = np.ones(bounds[-1], dtype=bool)
    inner[bounds[1:] - 1] = False
    out[inner] = w.hashes
    return out, bounds


def classes_for(words: int) -> int:
    """A power of two up to CLASSES and a quarter of the words, so that most classes hold several."""
    return min(CLASSES, max(256, 1 << max(0, words // 4).bit_length() - 1 if words >= 4 else 256))


def classes_of(h: np.ndarray, classes: int) -> np.ndarray:
    """Classes by the low bits of the hash; `classes` is a power of two."""
    return (h % np.uint64(classes)).astype(np.int64)


def _by_step(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short: their order and begins, and how many are longer than each step."""
    order = np.argsort(-size, kind="stable")
    ranked = size[order]
    alive = np.searchsorted(-ranked, -np.arange(ranked[0] if len(ranked) else 0), "left")
    return order, begin[order], alive


def log_likelihood(model: Model, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each class sequence, by the scaled forward recursion."""
    order, begin, alive = _by_step(bounds[:-1], np.diff(bounds))
    total = np.zeros(len(order))
    a = np.zeros((0, len(model.start)))
    for t, n in enumerate(alive):
        e = model.emit[tokens[begin[:n] + t]]
        a = (model.start * e) if t == 0 else (a[:n] @ model.move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


class Sums(NamedTuple):
    """Expected counts; log is the natural log-likelihood of what was added."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: np.ndarray


def no_sums(model: Model) -> Sums:
    return Sums(np.zeros_like(model.start, dtype=float), np.zeros_like(model.move, dtype=float), np.zeros(model.emit.shape), np.zeros(1))


def _carried(model: Model, tokens: np.ndarray, begin: np.ndarray, size: np.ndarray, nth: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state shares before each segment, backward vector at each segment's last token) for segments in text order.

    Every segment but a text's first becomes the matrix of its tokens, states x states, by one forward pass from
    each state; chaining those along a text gives the exact vectors at the cuts. Ends of texts have backward ones.
    """
    k, n = len(model.start), len(begin)
    before, after = np.zeros((n, k)), np.ones((n, k))
    inner = np.flatnonzero(~last)  # a text's last segment sends nothing on
    order, first, alive = _by_step(begin[inner], size[inner])
    head = nth[inner][order] == 0
    a = np.where(head[:, None, None], model.start, np.eye(k))  # of a head, all rows are alike
    logs = np.zeros((len(inner), k))
    for t, m in enumerate(alive):
        step = a[:m] @ model.move
        if t == 0:
            step[head] = a[head]
        step *= model.emit[tokens[first[:m] + t]][:, None, :]
        scale = step.sum(axis=2)
        a[:m] = step / scale[:, :, None]
        logs[:m] += np.log(scale)
    matrix = np.empty_like(a)
    matrix[order] = a * np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None]
    row = dict(zip(inner.tolist(), range(len(inner)), strict=True))
    for i in inner.tolist():
        m = matrix[row[i]]
        v = m[0] if nth[i] == 0 else before[i] @ m
        before[i + 1] = v / v.sum()
    for i in inner[::-1].tolist():
        if not last[i + 1]:
            v = matrix[row[i + 1]] @ after[i + 1]
        else:
            v = _backward(model, tokens[begin[i + 1] : begin[i + 1] + size[i + 1]])
        after[i] = v / (before[i + 1] @ v)
    return before, after


def _backward(model: Model, tokens: np.ndarray) -> np.ndarray:
    """The backward vector, up to its scale, before the given tokens of one text's end."""
    v = np.ones(len(model.start))
    for x in tokens[::-1]:
        v = model.move @ (model.emit[x] * v)
        v /= v.max()
    return v


def expect(model: Model, tokens: np.ndarray, bounds: np.ndarray, sums: Sums, segment: int = SEGMENT) -> None:
    """Add the expected counts of the class sequences to sums.

    The unit of work is a segment of a sequence; the vectors at both of its cuts are those of the whole
    sequence, so the counts are those of forward and backward passes over it uncut.
    """
    sizes = np.diff(bounds)
    cuts = -(-sizes // segment)
    owner = np.repeat(np.arange(len(sizes)), cuts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = bounds[:-1][owner] + nth * segment
    size, last = np.minimum(segment, bounds[1:][owner] - begin), nth == cuts[owner] - 1
    before, after = _carried(model, tokens, begin, size, nth, last)
    order, begin, alive = _by_step(begin, size)
    first, before, after = nth[order] == 0, before[order].astype(np.float32), after[order].astype(np.float32)
    at = np.concatenate([[0], np.cumsum(alive)])
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    post = np.empty((at[-1], len(model.start)), np.float32)
    scales = np.empty(at[-1], np.float32)
    laid = np.empty(at[-1], np.int64)
    for t, n in enumerate(alive):
        seen = laid[at[t] : at[t + 1]]
        seen[:] = tokens[begin[:n] + t]
        a = emit[seen]
        a *= np.where(first[:, None], model.start.astype(np.float32), before @ move) if t == 0 else post[at[t - 1] : at[t - 1] + n] @ move
        scale = a.sum(axis=1)
        a /= scale[:, None]
        post[at[t] : at[t + 1]], scales[at[t] : at[t + 1]] = a, scale
    sums.log[0] += float(np.log(scales.astype(float)).sum())
    toward = np.zeros((0, len(model.start)), np.float32)
    joint = np.zeros(model.move.shape)
    for t in range(len(alive) - 1, -1, -1):
        n, m = alive[t], len(toward)
        ahead = after[:n].copy()
        if m:
            joint += post[at[t] : at[t] + m].T @ toward
            ahead[:m] = toward @ back
        toward = emit[laid[at[t] : at[t + 1]]] * ahead / scales[at[t] : at[t + 1], None]
        post[at[t] : at[t + 1]] *= ahead
    if len(alive):
        joint += before[~first].T @ toward[~first]
        sums.start[:] += post[: at[1]][first].sum(axis=0)
    sums.move[:] += joint * model.move
    for k in range(len(model.start)):
        sums.emit[:, k] += np.bincount(laid, post[:, k], len(model.emit))


def initial(share: np.ndarray, states: int, seed: int = 5) -> Model:
    """States that stay, each with the class shares unevenly weighted, so that texts alike fall to one state."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(0.7 * rng.standard_normal((len(share), states)))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def maximise(sums: Sums, share: np.ndarray, doubt: float) -> Model:
    """The next model; each state's emissions are its expected counts, mixed by `doubt` with the smoothed class shares."""
    emit = (1 - doubt) * sums.emit / np.maximum(sums.emit.sum(axis=0), 1e-9) + doubt * share[:, None]
    move = sums.move + 1.0
    start = sums.start + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _train_pass(training: DataFrame, model: Model) -> Sums:
    states, classes = len(model.start), len(model.emit)
    names = [f"s{k}" for k in range(states)]
    schema = "row int, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = no_sums(model), False
        for batch in (x for b in batches for x in W.pieces(b, 0)):
            h, bounds = with_ends(batch.column(0))
            expect(model, classes_of(h, classes), bounds, sums)
            some = True
        if some:
            rest = np.zeros((1, states))
            rest[0, 0] = sums.log[0]
            table = np.concatenate([sums.emit, sums.move, sums.start[None], rest])
            rows = np.flatnonzero(table.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(table[rows, k]) for k in range(states))], names=["row", *names])

    added = training.select("text").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    table = np.zeros((classes + states + 2, states))
    table[added["row"].to_numpy()] = added[names].to_numpy()
    return Sums(table[classes + states], table[classes : classes + states], table[:classes], table[classes + states + 1, :1])


def word_counts(training: DataFrame) -> DataFrame:
    """(h, c): how often each word, the end included, occurs in the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in W.pieces(b, 0, 32 << 20)):
            h, _ = with_ends(batch.column(0))
            words, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])

    return training.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of all words above the lowest count level that leaves at most `most` of them."""
    level = F.floor(F.log2("c") * 16).cast("int")
    per = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    lowest, total = None, 0
    for lv, n in per:
        total += n
        if total > most:
            break
        lowest = lv
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(level >= lowest).toPandas()  # at most `most` rows
    h, c = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def score(docs: DataFrame, held_out: F.Column, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Rows where held_out is true take no part in training. Scores are log10.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = stage(word_counts(training), "word-counts")
    classes = classes_for(counts.count())
    kind = F.pmod(F.col("h"), F.lit(classes)).cast("int")
    per_class = stage(counts.groupBy(kind.alias("k")).agg(F.sum("c").alias("kc"), F.count(F.lit(1)).alias("kv")), "class-counts")
    got = per_class.toPandas()  # at most CLASSES rows
    tokens_of, words_of = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    tokens_of[got["k"].to_numpy()], words_of[got["k"].to_numpy()] = got["kc"].to_numpy(), got["kv"].to_numpy()
    n, v = int(tokens_of.sum()), int(words_of.sum())
    share = (tokens_of + words_of + 1) / (n + v + classes)
    doubt = (v + 1) / (n + v + 1)  # the part that adding one to every count gives away
    model = initial(share, states)
    for _ in range(rounds):
        model = maximise(_train_pass(training, model), share, doubt)
    common, common_counts = _frequent(counts, frequent)
    common_class = classes_of(common, classes)
    base_of = np.log10((common_counts + 1) / (n + v + 1))
    own_of = np.log10((common_counts + 1) / (tokens_of + words_of + 1)[common_class])
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, chain double, rest array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in (x for b in batches for x in W.pieces(b, 2, 24 << 20)):
            h, bounds = with_ends(batch.column(2))
            chain = log_likelihood(model, classes_of(h, classes), bounds) / LN10
            at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
            hit = common[at] == h if len(common) else np.zeros(len(h), dtype=bool)
            sums = [np.add.reduceat(np.where(hit, table[at], 0.0) if len(common) else np.zeros(len(h)), bounds[:-1]) for table in (base_of, own_of)]
            known = np.add.reduceat(hit.astype(np.int64), bounds[:-1])
            m = batch.num_rows
            left, text = h[~hit].view(np.int64), np.repeat(np.arange(m), np.diff(bounds) - known)
            order = np.lexsort((left, text))
            left, text = left[order], text[order]
            new = np.ones(len(left), dtype=bool)
            new[1:] = (left[1:] != left[:-1]) | (text[1:] != text[:-1])
            places = np.flatnonzero(new)
            times = np.diff(np.append(places, len(left))).astype(np.int32)
            left, ends = left[places], np.searchsorted(text[places], np.arange(m + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + m)), batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(known), *map(pa.array, sums), pa.array(chain), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (left, times))],
                names=[x.split()[0] for x in schema.split(", ")],
            )
            uid += m

    scored = stage(rows.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, schema), "scored")
    rare = scored.where(F.size("rest") > 0).select("uid", F.inline(F.arrays_zip(F.col("rest").alias("h"), F.col("times").alias("times"))))
    c1 = F.coalesce("c", F.lit(0)) + 1
    valued = (
        rare.join(counts, "h", "left")
        .withColumn("k", kind)
        .join(F.broadcast(per_class), "k", "left")  # at most CLASSES rows
        .select(
            "uid",
            (F.col("times") * F.log10(c1 / F.lit(float(n + v + 1)))).alias("b"),
            (F.col("times") * F.log10(c1 / (F.coalesce("kc", F.lit(0)) + F.coalesce("kv", F.lit(0)) + 1))).alias("o"),
            F.when(c1 > 1, F.col("times")).otherwise(0).alias("w"),
        )
        .groupBy("uid").agg(F.sum("b").alias("b"), F.sum("o").alias("o"), F.sum("w").alias("w"))
    )
    zero = F.lit(0.0)
    return (
        scored.drop("rest", "times").join(valued, "uid", "left")
        .select(
            F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("w", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("chain") + F.col("own") + F.coalesce("o", zero)).alias("score"),
        )
    )


def op5_hmm(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose checksum's remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
