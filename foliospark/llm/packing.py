"""Packing examples into sequences by vector bin packing with the dot-product heuristic.

An example is a list of parts, each a text and whether its tokens bear loss; an end id closes it. Examples
are cut at most where they exceed a sequence: pieces that reach a limit alone fill a sequence, and the
remainders are packed. A sequence is opened and takes, again and again, the remainder that fits and whose
(tokens, segments, loss-bearing tokens) vector, in shares of the limits, has the largest dot product with
what the sequence has left. Packing is within blocks of BLOCK remainders of one input partition: no
shuffle, memory bounded by a block, and one part-filled sequence a block at most besides those that no
remainder fits.

Edge cases. A null or empty text has only the end id. A null id is kept; each row is its own example, so
repeated rows and ids do not meet. Ties take the larger, then the earlier remainder. An empty table gives
no pieces. Extra columns are ignored, whatever their names. A very long text is cut, never shortened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import tokens as T
from foliospark.sources import table

BLOCK = 8192
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, loss_tokens long"


class Limits(NamedTuple):
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


def cut(bears: np.ndarray, limits: Limits) -> list[int]:
    """Ends of the pieces of an example, each as long as the token and the loss limit allow; bears is the running loss count."""
    n, ends, here = len(bears), [], 0
    while here < n:
        seen = bears[here - 1] if here else 0
        to = min(n, here + limits.tokens, int(np.searchsorted(bears, seen + limits.loss, "right")))
        ends.append(to)
        here = to
    return ends


def fill(sizes: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(bin, offset, segment) of every remainder and the number of bins, by the dot-product heuristic."""
    n = len(sizes)
    share = np.stack([sizes / limits.tokens, np.full(n, 1 / limits.segments), loss / limits.loss])
    order = np.argsort(-sizes, kind="stable")
    share, size, bear = share[:, order], sizes[order], loss[order]
    of, at, seg, bins = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    alive = np.arange(n)
    while len(alive):
        left, lossy, count, used, gone = limits.tokens, limits.loss, limits.segments, 0, []
        s, sz, br = share[:, alive], size[alive], bear[alive]
        free = np.ones(len(alive), dtype=bool)
        while count:
            lo = int(np.searchsorted(-sz, -left))  # sizes fall: the first that fits
            open_ = free[lo:] & (br[lo:] <= lossy)
            if not open_.any():
                break
            dots = s[0, lo:] * (left / limits.tokens) + s[1, lo:] * (count / limits.segments) + s[2, lo:] * (lossy / limits.loss)
            k = lo + int(np.argmax(np.where(open_, dots, -1.0)))
            free[k] = False
            i = order[alive[k]]
            of[i], at[i], seg[i] = bins, used, limits.segments - count
            used, left, lossy, count = used + int(sz[k]), left - int(sz[k]), lossy - int(br[k]), count - 1
            gone.append(k)
        alive = np.delete(alive, gone)
        bins += 1
    return of, at, seg, bins


def pack(examples: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """One row per piece of examples (doc_id, parts: array of struct<text, loss>).

    start and length are in the example's ids, offset, segment and sequence_id tell its place; sequence_id
    is unique, its upper bits being the task. A sequence holds limits.tokens ids at most.
    """
    path = path or T.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = T.encoder(path), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        made = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in OUT.split(", ")])

        def flush() -> pa.RecordBatch:
            nonlocal made
            of, at, seg, bins = fill(np.array([x[2] for x in held], np.int64), np.array([x[5] for x in held], np.int64), limits)
            out = [(*x[:5], task + made + int(b), int(o), int(g), x[5]) for x, b, o, g in zip(held, of, at, seg, strict=True)]
            made += bins
            held.clear()
            return rows(out)

        for batch in batches:
            whole: list[tuple] = []
            for doc_id, parts in zip(batch.column(0), batch.column(1), strict=True):
                ids, loss = [], []
                for part in parts.as_py() or []:
                    got = encoder.encode((part or {}).get("text") or "")
                    ids += got
                    loss.append((len(got), bool((part or {}).get("loss"))))
                ids = np.array([*ids, T.END], dtype="<u4")
                bears = np.cumsum(np.concatenate([np.full(n, f, np.int64) for n, f in loss] + [np.ones(1, np.int64)]))
                here = 0
                for to in cut(bears, limits):
                    lost = int(bears[to - 1] - (bears[here - 1] if here else 0))
                    piece = (doc_id.as_py(), here, to - here, zlib.crc32(ids[here:to].tobytes()), len(ids), lost)
                    if to - here == limits.tokens or to < len(ids):
                        whole.append((*piece[:5], task + made, 0, 0, lost))
                        made += 1
                    else:
                        held.append(piece)
                    here = to
                if len(held) >= BLOCK:
                    yield flush()
                if len(whole) >= BLOCK:
                    yield rows(whole)
                    whole = []
            if whole:
                yield rows(whole)
        if held:
            yield flush()

    return examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("parts").cast("array<struct<text:string,loss:boolean>>").alias("parts")).mapInArrow(run, OUT)


def documents_as_examples(docs: DataFrame) -> DataFrame:
    """Every row one example whose ids all bear loss."""
    return docs.select("doc_id", F.array(F.struct(F.col("text").cast("string").alias("text"), F.lit(True).alias("loss"))).alias("parts"))


def conversations_as_examples(turns: DataFrame) -> DataFrame:
    """Every conversation one example, turns in order; the assistant's turns bear loss. A conversation must fit a task's memory."""
    part = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("role") == "assistant").alias("loss"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("t"))
    return grouped.select(F.col("conv_id").alias("doc_id"), F.expr("transform(t, x -> struct(x.text as text, coalesce(x.loss, false) as loss))").alias("parts"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; one row per piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(documents_as_examples(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
