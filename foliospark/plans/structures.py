"""Structure, layout and page queries and their SQL. Page and block tables are derived from documents by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import html_blocks as H
from foliospark.operators import layout as L
from foliospark.operators import records as P
from foliospark.operators import structure as S
from foliospark.sources import table

WIDTH, HEIGHT = 595.0, 842.0


def _pages(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.floor(F.col("doc_id") / 206).cast("int").alias("doc"), (F.col("doc_id") % 206 + 1).cast("int").alias("page"), "text")


def _toc(spark, d):
    p = _pages(spark, d).where("doc_id % 7 = 0")
    return p.select("doc", "page", (F.col("doc_id") % 3 + 1).cast("int").alias("level"), F.concat(F.lit("T"), F.col("doc_id")).alias("title"))


def zone_range_join(spark, d):
    """Zone of every page."""
    return S.with_zone(_pages(spark, d)).select("doc_id", "page", "zone")


def pagination(spark, d):
    """Thesis numbers of pages whose printed number agrees, nearly agrees, is foreign or is missing."""
    p = _pages(spark, d)
    k = F.col("doc_id") % 5
    printed = F.when(k == 0, F.lit(None)).when(k == 1, F.col("page") - 15).when(k == 2, F.col("page") - 14).when(k == 3, F.col("page") + 40).otherwise(F.lit(7)).cast("int")
    return p.withColumn("printed", printed).withColumn("r", S.pagination(F.col("page"), F.col("printed"))).select("doc_id", "page", "printed", F.col("r.number").alias("number"), F.col("r.warning").alias("warning"))


def printed_number(spark, d):
    """Last lone number among the lines of texts that end in one."""
    text = F.concat_ws("\n", F.lit("12"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 1500).cast("string")))
    return _pages(spark, d).select("doc_id", S.printed_number(text).alias("printed"))


def heading_detect(spark, d):
    """Numbered headings made of the first words of every document."""
    first = F.substring_index("text", " ", 3)
    line = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("doc_id") % 9, F.lit("."), F.col("doc_id") % 5, F.lit(" "), first)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("3 "), first, F.lit(" . . . . 17"))).otherwise(first)
    h = _pages(spark, d).select("doc_id", S.heading(F.regexp_replace(line, "\n", " ")).alias("h")).where("h is not null")
    return h.select("doc_id", F.col("h.number").alias("number"), F.col("h.title").alias("title"))


def asof_section(spark, d):
    """For every other event of a user, the latest purchase at or before it."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    marks = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    out = S.as_of(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), marks, "user_id", "ts", ["purchase_id"])
    return out.select("user_id", "event_id", "purchase_id")


def section_carry_forward(spark, d):
    """Sections carried forward over the pages of a chapter."""
    p = _pages(spark, d).select("page", "doc_id", F.concat_ws("-", "doc", F.floor(F.col("page") / 30)).alias("chapter"), F.when(F.col("doc_id") % 11 == 3, F.concat(F.lit("S"), F.col("doc_id"))).alias("own_section"))
    return S.carry_forward(p).select("doc_id", "section", "inherited")


def toc_lead_end(spark, d):
    """End page of every entry of the tables of contents."""
    return S.section_ends(_toc(spark, d), 206).select("doc", "page", "title", "page_end")


def reference_split(spark, d):
    """Pages in reference ranges: from pages with a bibliography heading to the next entry."""
    p = _pages(spark, d)
    return S.reference_ranges(p, p.where("doc_id % 23 = 5").select("doc", "page"), _toc(spark, d)).select("doc", "page", "start", "end")


def _articles(spark, d):
    k, rows = F.col("doc_id"), F.split("text", "\n")
    listed = F.when(k % 46 == 5, F.concat(F.lit("References:\n\n"), F.array_join(rows, "\n\n"))).when(k % 23 == 5, F.concat_ws("\n\n", F.array_join(F.slice(rows, 1, 2), "\n\n"), F.lit("BIBLIOGRAPHY"), F.array_join(F.slice(rows, 3, 1000000), "\n\n")))
    clean = F.coalesce(listed, F.array_join(rows, "\n\n"))
    blank, keep = F.lit(None).cast("string"), k % 5 != 3
    return _pages(spark, d).select(
        "doc_id", "doc", "page", F.lit("d").alias("document_id"), F.lit("f").alias("source_file"), F.lit("s").alias("source_sha256"), (F.col("page") - 15).alias("thesis_page"), blank.alias("chapter_number"), F.concat(F.lit("C"), F.floor(F.col("page") / 30)).alias("chapter_title"),
        keep.alias("keep_for_rag"), F.when(~keep, "left out").alias("exclusion_reason"), F.lit("single_column").alias("extraction_mode"), F.replace(clean, F.lit("\n\n"), F.lit("\n")).alias("raw_text"), clean.alias("clean_text"), F.length(clean).alias("clean_char_count"),
        F.lit(0).alias("estimated_word_count"), F.array().cast("array<string>").alias("warnings"),
    )


def reference_moved(spark, d):
    """Reference lists taken out of pages: every 23rd page has one, in its middle or at its top, up to the next entry of the contents."""
    lists = P.move_references(_articles(spark, d), S.contents(_toc(spark, d)))[1]
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return lists.select("doc", "page", "thesis_page", "chapter_title", "article", "section", "partial_page", digest("raw_text"), digest("clean_text"), "clean_char_count", "exclusion_reason")


def reference_kept(spark, d):
    """The pages after their reference lists are taken out."""
    r = P.move_references(_articles(spark, d), S.contents(_toc(spark, d)))[0]
    return r.select("doc_id", "keep_for_rag", "exclusion_reason", "extraction_mode", "clean_char_count", F.md5(F.col("clean_text").cast("binary")).alias("clean_text"), F.array_join("warnings", ",").alias("warnings"))


def inclusion_policy(spark, d):
    """Keep or leave out every page, and why; every 17th page is blank here."""
    text = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("text"))
    p = S.with_zone(_pages(spark, d)).withColumn("r", S.inclusion(F.col("zone"), F.length(F.trim(text))))
    return p.select("doc_id", "zone", F.col("r.keep").alias("keep"), F.col("r.reason").alias("reason"))


def content_type(spark, d):
    """Content type of every page by zone, made-up titles and text."""
    k = F.col("doc_id") % 8
    title = F.when(k == 0, "Introduction").when(k == 1, "Main Results").when(k == 2, "Data and methods").when(k == 3, "Discussion").when(k == 4, "Conclusions")
    text = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("Figure 3 "), "text")).when(F.col("doc_id") % 13 == 1, F.concat(F.lit("Table A.1 "), "text")).otherwise(F.col("text"))
    layout = F.when(F.col("doc_id") % 10 == 9, "figure_or_sparse").otherwise("single_column")
    return S.with_zone(_pages(spark, d)).select("doc_id", S.content_type(F.col("zone"), title, text, layout).alias("content_type"))


def _blocks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    full, y = (F.col("pos") % 7 == 6) & (F.col("page") % 2 == 0), F.when(F.col("pos") == 0, 20.0).otherwise(100.0 + 20.0 * (F.floor(F.col("pos") / 2) % 34))
    wide = F.col("page") % 3 == 0
    x0 = F.when(full | wide, 46.0).when(F.col("pos") % 2 == 0, 46.0).otherwise(307.0)
    x1 = F.when(full, 548.0).when(wide, 500.0).when(F.col("pos") % 2 == 0, 287.0).otherwise(548.0)
    return L.classified(rows.select("page", "pos", x0.alias("x0"), y.alias("y0"), x1.alias("x1"), (y + 12.0).alias("y1"), "text"), WIDTH, HEIGHT)


def layout_classify(spark, d):
    """Layout of every page of derived blocks."""
    return L.layouts(_blocks(spark, d))


def reading_order(spark, d):
    """Reading order of all blocks."""
    b = _blocks(spark, d)
    return L.reading_order(b, L.layouts(b)).select("page", "pos", "band", "col", "nth")


def column_alternations(spark, d):
    """Left-right switches of the reading order and of the naive order."""
    b = _blocks(spark, d)
    r = L.naive_order(L.reading_order(b, L.layouts(b)))
    return L.alternations(r, "nth").join(L.alternations(r, "naive").withColumnRenamed("switches", "naive_switches"), "page")


def paragraph_groups(spark, d):
    """Paragraphs of blocks: number of groups per page."""
    b = _blocks(spark, d)
    r = L.paragraphs(L.reading_order(b, L.layouts(b)), WIDTH)
    return r.groupBy("page").agg(F.max("group").cast("long").alias("groups"), F.count(F.lit(1)).alias("blocks"))


def html_blocks(spark, d):
    """Headings and paragraphs of every web page."""
    return H.blocks(table(spark, d, "pages")).select("page_id", "pos", "kind", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))


def page_identity(spark, d):
    """Title, host and checksum of every web page."""
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.host(F.col("url")).alias("host"), F.upper(F.sha2("html", 256)).alias("sha256"))


_P = "p AS (SELECT doc_id, (doc_id // 206)::INTEGER AS doc, (doc_id % 206 + 1)::INTEGER AS page, text FROM documents)"
_TOC = "toc AS (SELECT doc, page, (doc_id % 3 + 1)::INTEGER AS level, 'T' || doc_id AS title FROM p WHERE doc_id % 7 = 0)"
_Z = f"""z AS (SELECT p.*, coalesce(zone, 'front_matter') AS zone FROM p LEFT JOIN (VALUES {', '.join(map(str, S.ZONES))}) v(lo, hi, zone) ON page BETWEEN lo AND hi)"""
_TITLE = "CASE doc_id % 8 WHEN 0 THEN 'introduction' WHEN 1 THEN 'main results' WHEN 2 THEN 'data and methods' WHEN 3 THEN 'discussion' WHEN 4 THEN 'conclusions' ELSE '' END"
_CT = " ".join("WHEN " + " OR ".join(f"contains(title, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in S.TITLE_WORDS)
_BL = """b0 AS (SELECT doc_id AS page, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
b1 AS (SELECT page, pos, text, (pos % 7 = 6 AND page % 2 = 0) AS f, page % 3 = 0 AS wide, (CASE WHEN pos = 0 THEN 20 ELSE 100 + 20 * ((pos // 2) % 34) END)::DOUBLE AS y0 FROM b0),
b2 AS (SELECT page, pos, text, y0, y0 + 12 AS y1, (CASE WHEN f OR wide OR pos % 2 = 0 THEN 46 ELSE 307 END)::DOUBLE AS x0, (CASE WHEN f THEN 548 WHEN wide THEN 500 WHEN pos % 2 = 0 THEN 287 ELSE 548 END)::DOUBLE AS x1 FROM b1),
bl AS (SELECT *, CASE WHEN length(text) <= 220 AND y1 <= 0.11 * 842 THEN 'header' WHEN length(text) <= 220 AND y0 >= 0.88 * 842 THEN 'footer' ELSE 'body' END AS band,
  CASE WHEN x1 <= 297.5 + 0.04 * 595 THEN 'left' WHEN x0 >= 297.5 - 0.04 * 595 THEN 'right' ELSE 'full' END AS col FROM b2),
ly0 AS (SELECT page, sum(length(trim(text))) AS chars, count(*) AS n, median(length(trim(text))) AS mid, count(*) FILTER (WHERE band = 'body' AND col = 'left') AS l, count(*) FILTER (WHERE band = 'body' AND col = 'right') AS r,
  count(*) FILTER (WHERE band = 'body' AND col = 'full') AS f, coalesce(sum(length(trim(text))) FILTER (WHERE band = 'body' AND col <> 'full'), 0) AS inside, coalesce(sum(length(trim(text))) FILTER (WHERE band = 'body'), 0) AS bc FROM bl GROUP BY page),
ly AS (SELECT page, CASE WHEN chars < 30 OR (n >= 20 AND mid < 25) THEN 'figure_or_sparse' WHEN l >= 2 AND r >= 2 AND inside >= 0.55 * bc AND f > 0 THEN 'mixed_layout' WHEN l >= 2 AND r >= 2 AND inside >= 0.55 * bc THEN 'double_column' ELSE 'single_column' END AS layout FROM ly0)"""
_RO = """st AS (SELECT a.page, a.pos, count(b.pos) AS stretch FROM bl a LEFT JOIN bl b ON a.page = b.page AND b.col = 'full' AND b.band = 'body' AND b.y1 <= (a.y0 + a.y1) / 2 GROUP BY ALL),
ro AS (SELECT bl.*, layout, row_number() OVER (PARTITION BY page ORDER BY CASE band WHEN 'header' THEN 0 WHEN 'body' THEN 1 ELSE 2 END,
  CASE WHEN layout IN ('double_column', 'mixed_layout') AND band = 'body' THEN stretch ELSE 0 END, CASE WHEN layout IN ('double_column', 'mixed_layout') AND band = 'body' THEN CASE col WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END ELSE 0 END,
  round(y0, 1), x0, pos)::INTEGER AS nth, row_number() OVER (PARTITION BY page ORDER BY round(y0, 1), x0, pos)::INTEGER AS naive FROM bl JOIN ly USING (page) JOIN st USING (page, pos))"""
_ALT = "SELECT page, count(*) FILTER (WHERE p IS NOT NULL AND p <> col) AS s FROM (SELECT page, col, lag(col) OVER (PARTITION BY page ORDER BY {o}) AS p FROM ro WHERE band = 'body' AND col <> 'full') GROUP BY page"
_ART = f"""{_P}, {_TOC}, pg AS (SELECT *, string_split(text, chr(10)) AS l, chr(10) || chr(10) AS br, doc_id % 5 <> 3 AS keep FROM p),
ar AS (SELECT doc_id, doc, page, keep, page - 15 AS thesis_page, 'C' || page // 30 AS chapter_title, CASE WHEN doc_id % 46 = 5 THEN list_prepend('References:', l) WHEN doc_id % 23 = 5 THEN l[1:2] || ['BIBLIOGRAPHY'] || CASE WHEN len(l) > 2 THEN l[3:] ELSE [''] END ELSE l END AS l FROM pg),
hd AS (SELECT doc, page AS s, CASE WHEN doc_id % 46 = 5 THEN 0 ELSE list_position(l, 'BIBLIOGRAPHY') - 1 END AS place, l FROM ar WHERE keep AND doc_id % 23 = 5),
sp AS (SELECT hd.doc, s, place, l[place + 1] AS title, (SELECT chapter_title FROM ar WHERE ar.doc = hd.doc AND ar.page = s) AS ch, coalesce((SELECT min(page) - 1 FROM toc WHERE toc.doc = hd.doc AND toc.page > s), s) AS e,
  (SELECT arg_max(title, page) FROM toc WHERE toc.doc = hd.doc AND level > 1 AND toc.page <= s) AS article FROM hd),
cv AS (SELECT ar.*, sp.s, sp.title, sp.ch, sp.article, CASE WHEN sp.s = page THEN sp.place ELSE 0 END AS cut FROM ar JOIN (SELECT doc, page AS pp, min(s) AS s FROM ar JOIN sp USING (doc) WHERE page BETWEEN s AND e GROUP BY ALL) x ON x.doc = ar.doc AND x.pp = ar.page JOIN sp ON sp.doc = ar.doc AND sp.s = x.s WHERE keep),
mv AS (SELECT *, trim(array_to_string(l[1:cut], chr(10) || chr(10)), ' ' || chr(10)) AS head, trim(array_to_string(l[cut + 1:], chr(10) || chr(10)), ' ' || chr(10)) AS tail, array_to_string(l, chr(10)) AS raw FROM cv),
mo AS (SELECT * FROM mv WHERE tail <> '')"""
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
_TITLE_OF = _PLAIN.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")

QUERIES = {
    f.__name__: f
    for f in (zone_range_join, pagination, printed_number, heading_detect, asof_section, section_carry_forward, toc_lead_end, reference_split, reference_moved, reference_kept, inclusion_policy, content_type, layout_classify, reading_order,
              column_alternations, paragraph_groups, html_blocks, page_identity)
}

ORACLE_SQL = {
    "zone_range_join": f"WITH {_P}, {_Z} SELECT doc_id, page, zone FROM z",
    "pagination": f"""WITH {_P}, q AS (SELECT doc_id, page, (CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN page - 15 WHEN 2 THEN page - 14 WHEN 3 THEN page + 40 ELSE 7 END)::INTEGER AS printed, CASE WHEN page >= 16 THEN page - 15 END AS rule FROM p)
      SELECT doc_id, page, printed, (CASE WHEN printed IS NULL THEN rule WHEN rule IS NULL THEN NULL WHEN abs(printed - rule) <= 2 THEN printed ELSE rule END)::INTEGER AS number,
      CASE WHEN printed IS NULL THEN NULL WHEN rule IS NULL THEN 'number in front matter' WHEN printed = rule THEN NULL WHEN abs(printed - rule) <= 2 THEN 'printed number differs' ELSE 'foreign numbering' END AS warning FROM q""",
    "printed_number": "SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(concat_ws(chr(10), '12', text, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 1500)::VARCHAR END), chr(10)), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]{1,3}')), lambda x: x::INTEGER), lambda x: x > 0)[-1] AS printed FROM documents",
    "heading_detect": f"""WITH h AS (SELECT doc_id, replace(CASE doc_id % 4 WHEN 0 THEN (doc_id % 9) || '.' || (doc_id % 5) || ' ' || f WHEN 1 THEN '3 ' || f || ' . . . . 17' ELSE f END, chr(10), ' ') AS line FROM (SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS f FROM documents))
      SELECT doc_id, regexp_extract(line, '{S.HEADING}', 1) AS number, trim(regexp_extract(line, '{S.HEADING}', 2)) AS title FROM h WHERE regexp_matches(line, '{S.HEADING}') AND NOT regexp_matches(line, '{S.DOT_LEADER}') AND length(line) < 130""",
    "asof_section": """SELECT user_id, event_id, purchase_id FROM (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase') e
      ASOF LEFT JOIN (SELECT user_id, ts, event_id AS purchase_id FROM events WHERE event_type = 'purchase') m USING (user_id, ts)""",
    "section_carry_forward": f"""WITH {_P}, q AS (SELECT doc_id, page, doc || '-' || (page // 30) AS chapter, CASE WHEN doc_id % 11 = 3 THEN 'S' || doc_id END AS own FROM p),
      r AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY page ROWS UNBOUNDED PRECEDING) AS section FROM q) SELECT doc_id, section, own IS NULL AND section IS NOT NULL AS inherited FROM r""",
    "toc_lead_end": f"WITH {_P}, {_TOC} SELECT doc, page, title, greatest(page, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page, level, title) - 1, 206))::INTEGER AS page_end FROM toc",
    "reference_split": f"""WITH {_P}, {_TOC}, h AS (SELECT p.doc, p.page AS start, greatest(p.page, coalesce(min(toc.page) - 1, p.page))::INTEGER AS "end" FROM p LEFT JOIN toc ON toc.doc = p.doc AND toc.page > p.page WHERE doc_id % 23 = 5 GROUP BY p.doc, p.page)
      SELECT p.doc, p.page, start, "end" FROM p JOIN h ON h.doc = p.doc AND p.page BETWEEN start AND "end" """,
    "reference_moved": f"""WITH {_ART} SELECT doc, page, thesis_page, ch AS chapter_title, article, title AS section, cut > 0 AS partial_page, md5(CASE WHEN cut > 0 AND instr(raw, title) > 0 THEN substr(raw, instr(raw, title)) ELSE raw END) AS raw_text, md5(tail) AS clean_text,
      length(tail)::INTEGER AS clean_char_count, 'references_internes_article' AS exclusion_reason FROM mo""",
    "reference_kept": f"""WITH {_ART}, j AS (SELECT ar.doc_id, ar.keep, array_to_string(ar.l, chr(10) || chr(10)) AS t, mo.doc_id IS NOT NULL AS moved, head FROM ar LEFT JOIN mo USING (doc_id)), k AS (SELECT *, moved AND head = '' AS gone, CASE WHEN moved THEN head ELSE t END AS c FROM j)
      SELECT doc_id, keep AND NOT gone AS keep_for_rag, CASE WHEN gone THEN 'references_internes_article' WHEN NOT keep THEN 'left out' END AS exclusion_reason, CASE WHEN gone THEN 'excluded' ELSE 'single_column' END AS extraction_mode, length(c)::INTEGER AS clean_char_count, md5(c) AS clean_text,
        CASE WHEN moved THEN 'references moved' ELSE '' END AS warnings FROM k""",
    "inclusion_policy": f"""WITH {_P}, {_Z}, q AS (SELECT *, length(trim(CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END)) AS n, zone IN {S.KEPT_ZONES} AS ok FROM z),
      r AS (SELECT doc_id, zone, CASE WHEN NOT ok THEN CASE zone {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in S.REASONS.items())} ELSE 'hors_perimetre' END WHEN n = 0 THEN 'page_blanche'
        WHEN zone = 'appendix_c' AND n < 150 THEN 'annexe_c_sans_texte_exploitable' WHEN zone <> 'appendix_c' AND n < 120 THEN 'page_quasi_vide_ou_titre_seul' END AS reason FROM q) SELECT doc_id, zone, reason IS NULL AS keep, reason FROM r""",
    "content_type": f"""WITH {_P}, {_Z}, q AS (SELECT doc_id, zone, {_TITLE} AS title, ltrim(CASE doc_id % 13 WHEN 0 THEN 'Figure 3 ' || text WHEN 1 THEN 'Table A.1 ' || text ELSE text END)[1:80] AS head FROM z)
      SELECT doc_id, CASE WHEN regexp_matches(head, '(?i)^(Figure|Fig\\.)\\s*[A-Z]?\\.?[0-9]') THEN 'figure_caption' WHEN regexp_matches(head, '(?i)^(Table|Tableau)\\s*[A-Z]?\\.?[0-9]') THEN 'table_caption' WHEN doc_id % 10 = 9 THEN 'figure_caption'
      WHEN zone = 'summaries' OR starts_with(lower(head), 'abstract') THEN 'abstract' {_CT} WHEN zone IN ('appendix_a', 'appendix_b', 'appendix_c') THEN 'appendix' ELSE 'other' END AS content_type FROM q""",
    "layout_classify": f"WITH {_BL} SELECT * FROM ly",
    "reading_order": f"WITH {_BL}, {_RO} SELECT page, pos::INTEGER AS pos, band, col, nth FROM ro",
    "column_alternations": f"WITH {_BL}, {_RO} SELECT a.page, a.s AS switches, b.s AS naive_switches FROM ({_ALT.format(o='nth')}) a JOIN ({_ALT.format(o='naive')}) b USING (page)",
    "paragraph_groups": f"""WITH {_BL}, {_RO}, mg AS (SELECT page, list(m) AS ms FROM (SELECT page, round(x1) AS m FROM ro GROUP BY ALL HAVING count(*) >= 2) GROUP BY page),
      pv AS (SELECT ro.*, ms, lag(band) OVER w AS pb, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(text) OVER w AS pt FROM ro LEFT JOIN mg USING (page) WINDOW w AS (PARTITION BY page ORDER BY nth)),
      jn AS (SELECT *, coalesce(pb = band AND abs(px0 - x0) <= 0.06 * 595 AND y0 - py1 < 1.6 * (py1 - py0) AND (len(list_filter(coalesce(ms, []), lambda m: abs(px1 - m) <= 0.02 * 595)) > 0 OR ends_with(pt, '-')), false) AS j FROM pv)
      SELECT page, count(*) FILTER (WHERE NOT j) AS groups, count(*) AS blocks FROM jn GROUP BY page""",
    "html_blocks": f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<div class="ad">.*?</div>', ' ', 'g'), '(?s)<head>.*?</head>', ' ', 'g') AS h FROM pages),
      s AS (SELECT page_id, string_split(regexp_replace(h, '<(h[1-6]|p)([ >])', chr(30) || '\\1|\\2', 'g'), chr(30)) AS l FROM b), u AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS part FROM s),
      t AS (SELECT page_id, pos, regexp_extract(part, '^(h[1-6]|p)\\|', 1) AS kind, {_PLAIN.format(x="regexp_replace(part, '^(h[1-6]|p)\\|[^>]*>', '')")} AS text FROM u WHERE pos > 0)
      SELECT page_id, pos::INTEGER AS pos, kind, md5(text) AS digest, length(text)::BIGINT AS n FROM t WHERE text <> ''""",
    "page_identity": f"SELECT page_id, {_TITLE_OF} AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, upper(sha256(html)) AS sha256 FROM pages",
}
