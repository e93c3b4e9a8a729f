"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, hmm, html_text, importance, langid, packing, pii, quality_rules, sharding, simhash

CLASH = ["fp", "key", "h1", "pid", "shard", "uid", "w", "piece", "n", "size", "lang", "c", "l", "_id", "n_words"]
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, LONG),
    (6, "same same text of some words that is here again and again for you"),
    (6, "same same text of some words that is here again and again for you"),
    (7, "same same text of some words that is here again and again for you"),
    (None, "a row without an id but with quite some words in it to keep it"),
    (None, None),
    (8, "é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i if c != "lang" else "en"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_quality_rules(docs, none):
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 6, 7}
    assert not {2, 3, 4, 8} & {r["doc_id"] for r in kept.collect()}
    assert quality_rules.keep(none).count() == 0
    odd = docs.withColumn("__fs_text", F.lit("x")).withColumn("__fs_rejected_by", F.lit(None).cast("string")).withColumn("a.b", F.lit(1))
    assert quality_rules.keep(odd).columns == odd.columns and quality_rules.keep(odd).count() == kept.count()
    assert quality_rules.judge(odd).columns == [*odd.columns, "__fs_rejected_by_"]


def test_importance(spark, docs, none):
    good = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    out = importance.resample(docs, good, 0.5).collect()
    assert len(out) == len(ROWS) and sum(r["kept"] for r in out) == 6
    assert importance.resample(none, good).count() == 0
    assert importance.resample(docs, good.where("false"), 1.0).where("kept").count() == len(ROWS)


def test_sharding(docs, none):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len(ROWS)
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard(none, 4).count() == 0


def test_pii(docs, none):
    out = pii.find(docs).collect()
    assert len(out) == len(ROWS) and {r["base_sha256"] for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert pii.redact(docs).columns == docs.columns
    assert sorted(str(r["text"]) for r in pii.redact(docs).collect()) == sorted(str(t) for _, t in ROWS)
    assert pii.find(none).count() == pii.redact(none).count() == 0


def test_pii_on_edges(spark):
    mail = "write to a.b@example.org or to c.d (at) example (dot) org now"
    rows = [(1, mail), (1, mail), (2, None), (None, mail), (3, "10.0.0.1 " * 40_000), (4, "4111 1111 1111 1111 4111 1111 1111 1111")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = sorted(pii.find(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    same = "email:9:24,email:31:57"
    assert [r["spans"] for r in out if r["doc_id"] in (1, None)] == [same] * 3
    assert next(r for r in out if r["doc_id"] == 3)["n_ip"] == 40_000
    assert next(r for r in out if r["doc_id"] == 2)["spans"] == ""
    red = pii.redact(df)
    assert red.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in red.collect()}
    assert texts[1] == texts[None] == "write to <EMAIL> or to <EMAIL> now" and texts[2] is None and texts[3] == "<IP> " * 40_000


def test_hmm(docs, none):
    out = hmm.score(docs, F.col("doc_id") == 1, rounds=1).collect()
    assert len(out) == len(ROWS)
    blank = {r["doc_id"]: r for r in out if r["doc_id"] in (2, 3, 4)}
    assert {(r["n_tokens"], r["n_known"]) for r in blank.values()} == {(1, 1)}
    assert next(r for r in out if r["doc_id"] == 1)["held_out"] is True
    assert hmm.score(none, F.lit(False), rounds=1).count() == 0
    assert hmm.score(docs, F.lit(True), rounds=1).count() == len(ROWS)


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>only a paragraph, of some length, here</p>"), (3, "u", "<p>" + LONG), (3, "u", "<<>< <p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {(r["page_id"], r["n_chars"]): r["text"] for r in html_text.main_text(pages).collect()}
    assert out[(1, 0)] == out[(2, 0)] == "" and out[(3, len(LONG))] == LONG
    assert html_text.main_text(pages.where("false")).count() == 0


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    classes = {(r["doc_id"], r["component_id"]) for r in out}
    assert {(2, 2), (3, 2), (4, 2), (None, 2), (6, 6), (7, 6)} <= classes
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "5", "6", "8", "None"])
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
    odd = docs.withColumn("__fs_id", F.lit(1)).withColumn("__fs_row", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("node", F.lit(2))
    again = simhash.keep_one(odd)
    assert again.columns == odd.columns and sorted(str(r["doc_id"]) for r in again.collect()) == sorted(["1", "2", "5", "6", "8", "None"])


def test_langid(spark, docs, none):
    labelled = spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "fr", "le chat et le chien"), (3, None, "x"), (4, "fr", None), (5, "en", "123")], "id long, lang string, text string")
    model = langid.learn(labelled)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert out[1]["lang_pred"] == "en" and out[2]["lang_pred"] == out[3]["lang_pred"] == out[4]["lang_pred"] == "und"
    assert langid.identify(docs, model).count() == len(ROWS) and langid.identify(none, model).count() == 0
    empty = langid.learn(labelled.where("false"))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_packing(docs, none):
    out = packing.pack(packing.documents_as_examples(docs)).collect()
    assert sum(r["length"] for r in out if r["start"] == 0 and r["doc_id"] in (2, 3)) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert packing.pack(packing.documents_as_examples(none)).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "quick brown FOX jumps over the lazy dog"), (1, "quick brown FOX jumps over the lazy dog"), (2, None), (3, ""), (None, "some words that is here again and again")], "item_id long, text string")
    out = decontaminate.contaminations(docs, items).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in out) == [("1", "1"), ("1", "1"), ("6", "None"), ("6", "None"), ("7", "None")]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontaminate.contaminations(none, items).count() == 0
    assert decontaminate.contaminations(docs, items.where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, items.where("false")).count() == len(ROWS)


def test_pipeline_stages(spark, data_dir, docs, none):
    """Every stage on nulls, repeats, clashing columns and no rows at all."""
    import corpus_pipeline

    for frame in (docs, none):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, frame, data_dir)
            assert out.columns == frame.columns
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, data_dir).count() >= frame.count()
