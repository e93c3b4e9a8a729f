"""Text and cleaning queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import cleaning as C
from foliospark.sources import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _language(spark, d):
    t = F.col("text")
    counted = _docs(spark, d).select("doc_id", "lang", "text", T.signals(t, T.FRENCH).alias("fr"), T.signals(t, T.ENGLISH).alias("en"))
    return counted.withColumn("l", T.language(F.col("fr"), F.col("en"), F.col("text")))


def language_detect(spark, d):
    """Detected language and confidence of every document by counted function words."""
    return _language(spark, d).select("doc_id", F.col("fr").cast("long").alias("fr"), F.col("en").cast("long").alias("en"), F.col("l.lang").alias("detected"), F.col("l.confidence").alias("confidence"))


def language_confusion(spark, d):
    """Documents by true and detected language."""
    return _language(spark, d).groupBy("lang", F.col("l.lang").alias("detected")).agg(F.count(F.lit(1)).alias("n"))


def tokens_vocab(spark, d):
    """Vocabulary of tokens of three characters or more with document frequency."""
    toks = F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")
    return _docs(spark, d).select(toks).where(F.length("term") >= 3).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def word_freq(spark, d):
    """Frequencies of words of two letters or more."""
    return C.word_frequencies(_docs(spark, d))


def inline_hyphen_freq(spark, d):
    """Frequencies of words joined by an inline hyphen."""
    return C.hyphen_frequencies(_docs(spark, d))


def running_lines(spark, d):
    """Lines that occur in four documents or more."""
    return C.running_lines(C.lines(_docs(spark, d)))


def unicode_normalise(spark, d):
    """Checksum and length of every text after Unicode cleaning."""
    t = T.normalize_unicode(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n"))


def unicode_nfc(spark, d):
    """Checksum of every text, with some letters decomposed, after composition."""
    from foliospark.functions.python import nfc

    loose = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return _docs(spark, d).select("doc_id", F.md5(nfc(loose).cast("binary")).alias("digest"))


def normalize_text(spark, d):
    """Checksum and length of every text in key form."""
    t = T.normalize_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n"))


def page_number_lines(spark, d):
    """Lines that are page numbers among labels built from orders."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("Page "), k)).when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.lit("xiv")).when(k % 5 == 3, F.concat(F.lit("p. "), k % 100)).otherwise(F.concat(k, F.lit(" was cold")))
    return o.select(line.alias("line")).groupBy(T.is_page_number(F.col("line")).alias("is_number")).agg(F.count(F.lit(1)).alias("n"))


def paragraph_merge(spark, d):
    """Lines folded into paragraphs: a line continues one that ends in a comma or a letter."""
    joins = F.col("prev").rlike("[,a-z]$")
    out = C.fold_lines(C.lines(_docs(spark, d)), joins)
    return out.select("doc_id", "first_pos", "n_lines", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def caption_sessions(spark, d):
    """Captions sessionised from markers; every fifth line opens one here, as the texts have none."""
    line = F.when(F.col("pos") % 5 == 2, F.concat(F.lit("Fig. S"), F.col("pos"), F.lit(". "), F.col("line"))).otherwise(F.col("line"))
    out = C.captions(C.lines(_docs(spark, d)).withColumn("line", line))
    return out.select("doc_id", "first_pos", F.length("caption").cast("long").alias("n_chars"), F.md5(F.col("caption").cast("binary")).alias("digest"))


def hyphen_repair(spark, d):
    """Halves of frequent long words put together again, or kept apart, by the two frequency tables."""
    docs = _docs(spark, d)
    words = C.word_frequencies(docs)
    halves = words.where((F.length("word") >= 8) & (F.col("n") >= 20)).select(F.col("word").alias("id"), F.expr("substr(word, 1, 4)").alias("head"), F.expr("substr(word, 5)").alias("tail"))
    return C.repair_hyphens(halves, words, C.hyphen_frequencies(docs)).select(F.col("id").alias("word"), "repaired", "kept_hyphen")


STEMS, RESTS = ("ertion", "by", "th", "xqz", "The"), ("ha", "nc", "nding", "foo", "of")


def boundary_lookahead(spark, d):
    """Words cut at page ends joined over up to three following pages: every fourth document ends in a fragment, some begin with continuations, every thirtieth is missing."""
    docs, k = _docs(spark, d), F.col("doc_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % 5 + 1).cast("int"))
    lines = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    text = F.when(k % 4 == 0, F.concat(lines, F.lit(" "), pick(STEMS, k), F.lit("- "))).when((k % 4 == 1) & (k % 3 > 0), F.concat(F.lit("Figure 2\n\nqqq\n\n"), pick(RESTS, k - 1), F.lit(" et\n\n"), lines)).otherwise(lines)
    pages = docs.where(k % 30 != 17).select(F.floor(k / 206).cast("int").alias("doc"), (k % 206).cast("int").alias("page"), text.alias("text"))
    out = C.boundary_repairs(pages, C.word_frequencies(docs), C.hyphen_frequencies(docs))
    return out.withColumn("skipped_pages", F.array_join("skipped_pages", ",")).withColumn("left_context", F.md5(F.col("left_context").cast("binary"))).withColumn("right_context", F.md5(F.col("right_context").cast("binary")))


TERMS = ("the", "tion", "de", "que", "licen")


def term_counts(spark, d):
    """Case-insensitive occurrences of fixed terms in every document."""
    return _docs(spark, d).select("doc_id", *[T.occurrences(F.col("text"), t).alias(f"n_{t}") for t in TERMS])


def exact_duplicates(spark, d):
    """Documents of 200 characters or more that repeat an earlier one, with the first's id."""
    w = Window.partitionBy("digest")
    docs = _docs(spark, d).where(F.length("text") >= 200).select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.withColumn("first_id", F.min("doc_id").over(w)).where("doc_id > first_id").select("doc_id", "first_id")


def stats_grouping_sets(spark, d):
    """Documents and characters by language, by source, by both and in all."""
    sets = table(spark, d, "documents").groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source")
    return sets.agg(F.grouping("lang").cast("int").alias("g_lang"), F.grouping("source").cast("int").alias("g_source"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def coverage_check(spark, d):
    """Of the expected id range: present, missing, duplicated, without label."""
    docs, labels = _docs(spark, d), table(spark, d, "labels").select("doc_id").distinct()
    bounds = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("present"), (F.count("doc_id") - F.count_distinct("doc_id")).alias("duplicates"))
    unset = docs.join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    out = bounds.crossJoin(F.broadcast(unset))  # one row each
    return out.select("present", "duplicates", (F.col("hi") - F.col("lo") + 1 - F.col("present") + F.col("duplicates")).alias("missing"), "unlabelled", ((F.col("duplicates") == 0) & (F.col("hi") - F.col("lo") + 1 == F.col("present"))).alias("ok"))


def cleaning_check(spark, d):
    """Per language: texts that are empty, that still have a running line, or a broken hyphen."""
    docs = _docs(spark, d)
    hit = C.line_keys(docs).join(C.running_keys(docs), "line_key", "left_semi").select("doc_id").distinct().withColumn("residual", F.lit(1))
    marked = docs.join(hit, "doc_id", "left")
    return marked.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") == 0).alias("empty"), F.count("residual").alias("residual_lines"), F.count_if(F.col("text").rlike(f"[{T.LETTERS}]-\n[{T.LETTERS}]")).alias("broken_hyphens")
    )


def sentence_stats(spark, d):
    """Sentences of twenty characters or more: number and total length in every document, cut at stops before capitals."""
    s = T.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.lit(0)).cast("long").alias("n_chars"))


def _duck(column: str = "text") -> str:
    q = "'" * 2
    out = f"translate({column}, '{T.DASHES}{T.SINGLE_QUOTES}{T.DOUBLE_QUOTES}{T.SPACES}{T.INVISIBLE}', '{'-' * len(T.DASHES)}{q * len(T.SINGLE_QUOTES)}{chr(34) * len(T.DOUBLE_QUOTES)}{' ' * len(T.SPACES)}')"
    for a, b in T.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


_SIGNAL = "len(list_filter(regexp_extract_all(translate(lower(text), 'éèêà', 'eeea'), '[" + T.LETTERS + "'']+'), lambda w: list_contains([{words}], w)))"
_FR, _EN = (_SIGNAL.format(words=", ".join(f"'{w}'" for w in words)) for words in (T.FRENCH, T.ENGLISH))
_LANG = f"""lg AS (SELECT doc_id, lang, fr, en,
  CASE WHEN blank THEN 'unknown' WHEN fr + en < 5 OR fr = en THEN 'en' WHEN fr > en THEN 'fr' ELSE 'en' END AS detected,
  CASE WHEN blank OR fr + en < 5 THEN 0.0::DOUBLE WHEN fr = en THEN 0.5::DOUBLE ELSE round(greatest(fr, en)::DOUBLE / (fr + en), 3) END AS confidence
  FROM (SELECT doc_id, lang, {_FR} AS fr, {_EN} AS en, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')) = '', true) AS blank FROM documents))"""
_KEY = f"trim(regexp_replace(regexp_replace(lower({_duck('line')}), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))"
_LINES = "ln AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_RUN = f"rl AS (SELECT line_key, count(*) AS pages FROM (SELECT DISTINCT doc_id, {_KEY} AS line_key FROM ln) WHERE length(line_key) >= 3 GROUP BY 1 HAVING count(*) >= 4)"
_WORDS = f"wf AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS word FROM documents) GROUP BY 1)"
_HYPH = f"hf AS (SELECT compound, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.INLINE_HYPHEN}')) AS compound FROM documents) GROUP BY 1)"

QUERIES = {
    f.__name__: f
    for f in (language_detect, language_confusion, tokens_vocab, word_freq, inline_hyphen_freq, running_lines, unicode_normalise, unicode_nfc, normalize_text, page_number_lines, paragraph_merge, caption_sessions,
              hyphen_repair, boundary_lookahead, term_counts, exact_duplicates, stats_grouping_sets, coverage_check, cleaning_check, sentence_stats)
}

ORACLE_SQL = {
    "language_detect": f"WITH {_LANG} SELECT doc_id, fr, en, detected, confidence FROM lg",
    "language_confusion": f"WITH {_LANG} SELECT lang, detected, count(*) AS n FROM lg GROUP BY ALL",
    "tokens_vocab": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}'))) AS term FROM documents) WHERE length(term) >= 3 GROUP BY 1",
    "word_freq": f"WITH {_WORDS} SELECT * FROM wf",
    "inline_hyphen_freq": f"WITH {_HYPH} SELECT * FROM hf",
    "running_lines": f"WITH {_LINES}, {_RUN} SELECT * FROM rl",
    "unicode_normalise": f"SELECT doc_id, md5({_duck()}) AS digest, length({_duck()})::BIGINT AS n FROM documents",
    "unicode_nfc": "SELECT doc_id, md5(text) AS digest FROM documents",
    "normalize_text": "SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)",
    "page_number_lines": """SELECT regexp_full_match(trim(line), '[0-9]{1,4}') OR regexp_full_match(lower(trim(line)), '[ivxlcdm]{1,8}') OR regexp_full_match(lower(trim(line)), '(page|p\\.)\\s*[0-9]{1,4}') AS is_number, count(*) AS n
      FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'Page ' || o_orderkey WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN 'xiv' WHEN 3 THEN 'p. ' || o_orderkey % 100 ELSE o_orderkey || ' was cold' END AS line FROM orders) GROUP BY 1""",
    "paragraph_merge": f"""WITH {_LINES}, m AS (SELECT *, coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), '[,a-z]$'), false) AS j FROM ln),
      g AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m),
      t AS (SELECT doc_id, min(pos)::INTEGER AS first_pos, count(*) AS n_lines, string_agg(line, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, island)
      SELECT doc_id, first_pos, n_lines, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM t""",
    "caption_sessions": f"""WITH {_LINES}, c AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 2 THEN 'Fig. S' || pos || '. ' || line ELSE line END AS line FROM ln),
      g AS (SELECT *, sum(regexp_matches(line, '{C.CAPTION}')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c),
      t AS (SELECT doc_id, min(pos)::INTEGER AS first_pos, string_agg(line, ' ' ORDER BY pos) AS caption FROM g WHERE island > 0 GROUP BY doc_id, island)
      SELECT doc_id, first_pos, length(caption)::BIGINT AS n_chars, md5(caption) AS digest FROM t WHERE len(string_split_regex(trim(caption), '\\s+')) >= 12""",
    "hyphen_repair": f"""WITH {_WORDS}, {_HYPH} SELECT w.word, CASE WHEN coalesce(h.n, 0) > coalesce(j.n, 0) THEN w.word[1:4] || '-' || w.word[5:] ELSE w.word END AS repaired, coalesce(h.n, 0) > coalesce(j.n, 0) AS kept_hyphen
      FROM wf w LEFT JOIN wf j ON j.word = w.word LEFT JOIN hf h ON h.compound = w.word[1:4] || '-' || w.word[5:] WHERE length(w.word) >= 8 AND w.n >= 20""",
    "boundary_lookahead": f"""WITH {_WORDS}, {_HYPH}, d AS (SELECT doc_id AS k, (doc_id // 206)::INT AS doc, (doc_id % 206)::INT AS page, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents WHERE doc_id % 30 <> 17),
      p AS (SELECT doc, page, CASE WHEN k % 4 = 0 THEN t || ' ' || {list(STEMS)}[k % 5 + 1] || '-' WHEN k % 4 = 1 AND k % 3 > 0 THEN 'Figure 2' || chr(10) || chr(10) || 'qqq' || chr(10) || chr(10) || {list(RESTS)}[(k - 1) % 5 + 1] || ' et' || chr(10) || chr(10) || t ELSE t END AS t FROM d),
      l AS (SELECT doc, page AS l, regexp_extract(t, '([{T.LETTERS}]{{2,}})-$', 1) AS stem, right(t, 90) AS lc FROM p WHERE regexp_matches(t, '[{T.LETTERS}]{{2,}}-$')),
      c AS (SELECT * FROM (SELECT doc, page, generate_subscripts(s, 1) AS i, trim(unnest(s)) AS x FROM (SELECT doc, page, string_split(t, chr(10) || chr(10)) AS s FROM p)) WHERE regexp_matches(x, '^[a-zà-öø-ÿ]')),
      o AS (SELECT l.*, page AS r, count(*) OVER (PARTITION BY l.doc, l ORDER BY page) = page - l AS whole FROM l JOIN p ON p.doc = l.doc AND p.page BETWEEN l + 1 AND l + 3),
      f AS (SELECT doc, l, max(r) AS last, min(r) FILTER (EXISTS (SELECT 1 FROM c WHERE c.doc = o.doc AND c.page = r)) AS r FROM o WHERE whole GROUP BY ALL),
      m AS (SELECT l.*, f.last, f.r, i, regexp_extract(x, '^([a-zà-öø-ÿ]+)', 1) AS rest, x[1:90] AS rc FROM l LEFT JOIN f USING (doc, l) LEFT JOIN c ON c.doc = l.doc AND c.page = f.r),
      n AS (SELECT m.*, coalesce(wf.n, 0) AS j, coalesce(hf.n, 0) AS h FROM m LEFT JOIN wf ON wf.word = lower(stem || rest) LEFT JOIN hf ON hf.compound = lower(stem || '-' || rest)),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, l ORDER BY j + h = 0, i) AS nth FROM n) WHERE nth = 1),
      e AS (SELECT b.*, lower(stem) IN (SELECT word FROM wf WHERE n >= 3) AND lower(rest) IN (SELECT word FROM wf WHERE n >= 3) AS members FROM b),
      y AS (SELECT *, CASE WHEN rest IS NULL THEN 'no continuation' WHEN j >= h AND j > 0 THEN 'joined' WHEN h > 0 THEN 'compound' WHEN members THEN 'compound, not attested' ELSE 'joined, not attested' END AS reason, CASE WHEN rest IS NULL THEN coalesce(last, l) ELSE r - 1 END AS til FROM e),
      z AS (SELECT *, (CASE WHEN rest IS NULL THEN 0 WHEN j >= h AND j >= 5 THEN 1 WHEN j + h > 0 THEN 0.9 ELSE 0.75 END)::DOUBLE AS confidence FROM y)
      SELECT doc, l AS left_page, r AS right_page, stem || '-' AS left_fragment, rest AS right_fragment, CASE WHEN rest IS NOT NULL THEN stem || CASE WHEN starts_with(reason, 'compound') THEN '-' ELSE '' END || rest END AS repaired, confidence, reason,
        confidence < 0.9 AS review, array_to_string(range(l + 1, til + 1), ',') AS skipped_pages, CASE WHEN rest IS NOT NULL THEN j END AS n_joined, CASE WHEN rest IS NOT NULL THEN h END AS n_hyphenated, md5(lc) AS left_context, md5(rc) AS right_context FROM z""",
    "term_counts": "SELECT doc_id, " + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})::BIGINT AS n_{t}" for t in TERMS) + " FROM documents",
    "exact_duplicates": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE length(text) >= 200) WHERE doc_id > first_id",
    "stats_grouping_sets": "SELECT lang, source, grouping(lang)::INTEGER AS g_lang, grouping(source)::INTEGER AS g_source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())",
    "coverage_check": """SELECT present, duplicates, hi - lo + 1 - present + duplicates AS missing, unlabelled, duplicates = 0 AND hi - lo + 1 = present AS ok FROM
      (SELECT min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS present, count(doc_id) - count(DISTINCT doc_id) AS duplicates, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents)""",
    "cleaning_check": f"""WITH {_LINES}, {_RUN}, r AS (SELECT DISTINCT doc_id FROM ln WHERE {_KEY} IN (SELECT line_key FROM rl))
      SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(text) = 0) AS empty, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM r)) AS residual_lines,
      count(*) FILTER (WHERE regexp_matches(text, '[{T.LETTERS}]-\\n[{T.LETTERS}]')) AS broken_hyphens FROM documents GROUP BY 1""",
    "sentence_stats": """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
      c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.!?])\\s+([A-ZÀ-ÖØ-Þ0-9])', '\\1' || chr(30) || '\\2', 'g'), '([.!?])\\s+([A-ZÀ-ÖØ-Þ0-9])', '\\1' || chr(30) || '\\2', 'g') AS t FROM f),
      s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(30)), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM c)
      SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_chars FROM s""",
}
