"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

A text's vector holds its folded letters' 2- and 3-grams, words parted by one blank, hashed into BUCKETS
places, as log(1 + count) times inverse document frequency, at length 1. Every language has a few centroids
from spherical k-means, so that a language of several styles is not one blurred mean. A text takes the
language of the centroid of highest cosine; it is rejected if that cosine is under the language's threshold,
the QUANTILE of its own training rows' cosines.

Fitting takes at most SAMPLE labelled rows, evenly from all languages: those of the least hashes of id and
text, equal rows counting once. Their vectors are made on the executors; the driver holds at most SAMPLE x BUCKETS numbers. Predictions are made
for every whole text, map-side, without a shuffle.

Edge cases. A null text, or one without a letter, is `und` at score 0. A null language is not learned from;
the checksum of a null id is none, and its row is learned from. Repeated rows are each judged. Ties go to
the first language in order, then the first centroid. With no labelled row every text is `und`. An empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import words as W
from foliospark.sources import table

BUCKETS = 4096
SAMPLE = 4000
PER_LANGUAGE = 800
CENTROIDS = 3
QUANTILE = 0.01
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # of each centroid's language


def gram_counts(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """rows x buckets: how often each hashed 2- and 3-gram occurs in each text."""
    raw, at = W.text_buffer(column)
    out = np.zeros(len(column) * buckets, np.float32)
    if not len(raw):
        return out.reshape(len(column), buckets)
    for here in range(0, len(raw), W.PIECE):
        x = raw[here : here + W.PIECE + 2]
        solid, folded = W.letters(x)
        b = np.where(solid, folded, 32).astype(np.uint32)
        row = np.searchsorted(at, np.arange(here, here + len(x)), "right") - 1
        two = (b[:-1] != 32) | (b[1:] != 32)
        two &= row[:-1] == row[1:]
        codes = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) >> np.uint32(7)
        n = min(W.PIECE, len(x) - 1)
        keep = two[:n]
        out += np.bincount(row[:n][keep] * buckets + codes[:n][keep] % np.uint32(buckets), minlength=len(out)).astype(np.float32)
        if len(x) > 2:
            n = min(W.PIECE, len(x) - 2)
            three = (two[:-1] & two[1:] & (row[:-2] == row[2:]))[:n]
            codes = (codes[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)) >> np.uint32(9)
            out += np.bincount(row[:n][three] * buckets + codes[:n][three] % np.uint32(buckets), minlength=len(out)).astype(np.float32)
    return out.reshape(len(column), buckets)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _chunks(column: pa.Array, rows: int = 128) -> Iterator[tuple[int, pa.Array]]:
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids of unit vectors: farthest-first starts, then spherical k-means."""
    chosen = [_unit(v.mean(axis=0, keepdims=True))[0]]
    for _ in range(1, min(k, len(v))):
        chosen.append(v[int(np.argmin(np.max(v @ np.array(chosen).T, axis=1)))])
    c = np.array(chosen)
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        c = np.array([_unit(v[near == j].sum(axis=0, keepdims=True))[0] if (near == j).any() else c[j] for j in range(len(c))])
    return c


def fit(rows: list[tuple[str, np.ndarray]], centroids: int = CENTROIDS, quantile: float = QUANTILE) -> Model:
    """The model of (language, gram counts) rows."""
    if not rows:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), np.zeros(0))
    counts = np.stack([c for _, c in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    v, names, found, least = vectors(counts, idf), [], [], []
    for lang in sorted({x for x, _ in rows}):
        own = v[[x == lang for x, _ in rows]]
        c = cluster(own, centroids)
        low = float(np.quantile(np.max(own @ c.T, axis=1), quantile))
        names += [lang] * len(c)
        found.append(c)
        least += [low] * len(c)
    return Model(names, np.concatenate(found).astype(np.float32), idf, np.array(least))


def learn(labelled: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """The model of labelled rows (id, lang, text), of which at most `sample`, evenly by language, are read.

    A row is a candidate if the hash of its id and text is under its language's share, which lets about a quarter
    more rows through than wanted; equal rows are one candidate, so neither null ids nor one repeated row can fill
    the sample. Of the candidates the driver keeps the least hashes. No window sees a whole language.
    """
    spark = labelled.sparkSession
    known = labelled.where("lang is not null and text is not null")
    sizes = sorted(((r["n"], r["lang"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()), key=lambda x: x[1])
    each = max(1, min(per_language, sample // max(1, len(sizes))))
    shares = spark.createDataFrame([(lang, min(1 << 30, ((each * 5 // 4 + 32) << 30) // n + 1)) for n, lang in sizes], "picked_lang string, most long")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    rows = known.join(F.broadcast(shares), F.col("lang") == F.col("picked_lang")).where(place < F.col("most")).select("lang", "text", place.alias("place")).dropDuplicates(["lang", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_letter(batch.column(1))))
            for at, texts in _chunks(batch.column(1)):
                counts = gram_counts(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "place", "counts"])

    got = rows.mapInArrow(run, "lang string, place long, counts binary").collect()  # about 1.25 x sample rows, by the shares
    kept: dict[str, list[np.ndarray]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["place"], r["counts"])):
        own = kept.setdefault(r["lang"], [])
        if len(own) < each:
            own.append(np.frombuffer(r["counts"], np.float32))
    return fit([(lang, c) for lang, own in kept.items() for c in own])


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of each text of a column."""
    lettered = has_letter(column)
    names, scores, rejected = [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), dtype=bool)
    if not model.languages:
        return names, scores, rejected
    for at, texts in _chunks(column):
        cosines = vectors(gram_counts(texts), model.idf) @ model.centroids.T
        best = np.argmax(cosines, axis=1)
        for i, k in enumerate(best):
            if lettered[at + i]:
                names[at + i] = model.languages[k]
                scores[at + i] = min(1.0, max(0.0, float(cosines[i, k])))
                rejected[at + i] = cosines[i, k] < model.least[k]
    return names, scores, rejected


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, rejected for every row of docs."""
    schema = "id long, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in W.pieces(b, 1)):
            names, scores, rejected = predict(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled rows whose checksum's remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.where(~held).select(F.col("doc_id").alias("id"), "lang", "text"))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
