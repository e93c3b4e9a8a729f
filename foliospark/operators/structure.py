"""Document structure: zones, pagination, headings, table of contents, sections by as-of joins, inclusion rules.

A page table has `page`; other columns are named by each function. Windows are partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page ranges, both ends included, and their zones.
ZONES = [
    (1, 5, "front_matter"), (6, 11, "summaries"), (12, 13, "acknowledgements"), (14, 15, "toc"), (16, 127, "chapters"), (128, 129, "acronyms"),
    (130, 139, "bibliography"), (140, 141, "lists_figures_tables"), (142, 143, "appendix_divider"), (144, 149, "appendix_a"), (150, 173, "appendix_b"), (174, 206, "appendix_c"),
]
# Why a zone is left out; other zones are kept.
REASONS = {
    "front_matter": "couverture_et_metadonnees", "acknowledgements": "remerciements", "toc": "table_des_matieres", "acronyms": "page_acronymes_traitee_separement", "bibliography": "bibliographie",
    "lists_figures_tables": "listes_figures_et_tableaux", "appendix_divider": "page_structurelle_sans_contenu_scientifique", "appendix_b": "annexe_b_hors_sujet",
}
KEPT_ZONES = ("summaries", "chapters", "appendix_a", "appendix_c")
# The first page that has a thesis number, and how far printed numbers may be off.
FIRST_NUMBERED, OFFSET, TOLERANCE = 16, 15, 2
LEAST_CHARS, LEAST_APPENDIX_CHARS = 120, 150
HEADING = r"^([0-9]+(?:\.[0-9]+){0,3})\s+(\S.{2,120})$"
LONE_NUMBER = r"^[0-9]+(?:\.[0-9]+){0,3}$"
# First pages of the chapters and appendices.
CHAPTER_STARTS = {16: "1", 34: "2", 50: "3", 86: "4", 122: "5", 144: "A", 150: "B", 174: "C"}
# Titles that are a paragraph of their own and open a list of references.
REFERENCE_TITLES = ("references", "bibliography", "literature cited", "bibliographie", "references cited", "reference list")
DOT_LEADER = r"\.\s*\.\s*\.|…"
# Words of a section title, in order of precedence, and the content type they tell.
TITLE_WORDS = [
    ("introduction", ("introduction",)), ("conclusion", ("conclusion", "perspective", "resume", "résumé", "summary")), ("result", ("result", "résultat", "resultat")), ("discussion", ("discussion", "caveat")),
    ("methodology", ("method", "méthode", "methode", "data", "generator", "analogues", "algorithm", "approach")), ("definition", ("definition", "définition")),
]


def with_zone(pages: DataFrame) -> DataFrame:
    """Adds zone by a range join on the small zone table; a page outside all ranges is front matter."""
    zones = F.broadcast(pages.sparkSession.createDataFrame(ZONES, "_lo int, _hi int, zone string"))  # a fixed dozen of rows
    return pages.join(zones, F.col("page").between(F.col("_lo"), F.col("_hi")), "left").drop("_lo", "_hi").withColumn("zone", F.coalesce("zone", F.lit("front_matter")))


def thesis_page(page: Column) -> Column:
    """The thesis number that follows from the page's place; null before numbering begins."""
    return F.when(page >= FIRST_NUMBERED, page - OFFSET)


def pagination(page: Column, printed: Column) -> Column:
    """STRUCT<number, warning>: the printed number where it agrees with the place within the tolerance, else the place's."""
    rule = thesis_page(page)
    out = lambda n, w: F.struct(n.cast("int").alias("number"), w.cast("string").alias("warning"))
    none = F.lit(None)
    return (
        F.when(printed.isNull(), out(rule, none))
        .when(rule.isNull(), out(none, F.lit("number in front matter")))
        .when(printed == rule, out(printed, none))
        .when(F.abs(printed - rule) <= TOLERANCE, out(printed, F.lit("printed number differs")))
        .otherwise(out(rule, F.lit("foreign numbering")))
    )


def printed_number(text: Column) -> Column:
    """The last line of only digits that is a number from 1 to 999, if any."""
    found = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,3}$"))
    return F.try_element_at(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x > 0), F.lit(-1))


def heading(line: Column) -> Column:
    """STRUCT<number, title> of a numbered heading; null for other lines and lines of a table of contents."""
    ok = line.rlike(HEADING) & ~line.rlike(DOT_LEADER) & (F.length(line) < 130)
    return F.when(ok, F.struct(F.regexp_extract(line, HEADING, 1).alias("number"), F.trim(F.regexp_extract(line, HEADING, 2)).alias("title")))


def inclusion(zone: Column, n_chars: Column) -> Column:
    """STRUCT<keep, reason>: zones left out, then blank pages, then pages with too little text for their zone."""
    out = lambda k, r: F.struct(F.lit(k).alias("keep"), r.cast("string").alias("reason"))
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return (
        F.when(~zone.isin(*KEPT_ZONES), out(False, F.coalesce(reason[zone], F.lit("hors_perimetre"))))
        .when(n_chars == 0, out(False, F.lit("page_blanche")))
        .when((zone == "appendix_c") & (n_chars < LEAST_APPENDIX_CHARS), out(False, F.lit("annexe_c_sans_texte_exploitable")))
        .when((zone != "appendix_c") & (n_chars < LEAST_CHARS), out(False, F.lit("page_quasi_vide_ou_titre_seul")))
        .otherwise(out(True, F.lit(None)))
    )


def content_type(zone: Column, title: Column, text: Column, layout: Column) -> Column:
    """The first rule that fits: captions, sparse layout, abstracts, words of the section title, appendices."""
    head, low = F.substring(F.ltrim(text), 1, 80), F.lower(F.coalesce(title, F.lit("")))
    out = F.when(head.rlike(r"(?i)^(Figure|Fig\.)\s*[A-Z]?\.?[0-9]"), "figure_caption").when(head.rlike(r"(?i)^(Table|Tableau)\s*[A-Z]?\.?[0-9]"), "table_caption")
    out = out.when(layout == "figure_or_sparse", "figure_caption").when((zone == "summaries") | F.lower(head).startswith("abstract"), "abstract")
    for kind, words in TITLE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, kind)
    return out.when(zone.isin("appendix_a", "appendix_b", "appendix_c"), "appendix").otherwise("other")


def as_of(events: DataFrame, marks: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """events with each value of the latest mark at or before it, within `by`: a union and one window, no range join.

    Where mark and event fall together the mark counts. Marks (by, at, values); of marks at one place the
    greatest value wins. Columns of events must not be named like the values.
    """
    left = events.select("*", *[F.lit(None).cast(marks.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("_side"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in (by, at)]
    right = marks.select(by, at, *blank, *values, F.lit(0).alias("_side"))
    w = Window.partitionBy(by).orderBy(F.col(at), F.col("_side"), *values).rowsBetween(Window.unboundedPreceding, 0)
    both = left.select(*[F.col(c) for c in left.columns]).unionByName(right)
    found = [F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w).alias("_m")]
    return both.select(*events.columns, "_side", *found).where("_side = 1").select(*events.columns, *[F.col(f"_m.{v}").alias(v) for v in values])


def carry_forward(pages: DataFrame, chapter: str = "chapter", section: str = "own_section", order: str = "page") -> DataFrame:
    """Adds section, the latest own section within the chapter, and inherited, whether it is an earlier page's."""
    w = Window.partitionBy(chapter).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section", F.last(section, ignorenulls=True).over(w)).withColumn("inherited", F.col(section).isNull() & F.col("section").isNotNull())


def section_ends(toc: DataFrame, last_page: int, by: str = "doc") -> DataFrame:
    """Adds page_end: one before the next entry's start, at least the own start, and the last page for the last entry."""
    w = Window.partitionBy(by).orderBy("page", "level", "title")
    return toc.withColumn("page_end", F.greatest("page", F.coalesce(F.lead("page").over(w) - 1, F.lit(last_page))))


def reference_ranges(pages: DataFrame, headings: DataFrame, toc: DataFrame, by: str = "doc") -> DataFrame:
    """(by, page, start, end): from a page with a bibliography heading to the page before the next entry of the contents."""
    nexts = toc.select(F.col(by).alias("_b"), F.col("page").alias("_next"))
    ends = headings.join(nexts, (F.col(by) == F.col("_b")) & (F.col("_next") > F.col("page")), "left").groupBy(by, "page").agg(F.min("_next").alias("_n"))
    spans = ends.select(by, F.col("page").alias("start"), F.greatest("page", F.coalesce(F.col("_n") - 1, F.col("page"))).alias("end"))
    covered = spans.select(by, "start", "end", F.explode(F.sequence("start", "end")).alias("page"))
    return pages.select(by, "page").join(covered, [by, "page"])


def page_heading(blocks: Column) -> Column:
    """STRUCT<number, title> of the first block of an array of texts that opens with a numbered heading, or with a lone number and its title in the next line; null if none does."""

    def of_block(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        first, second = F.try_element_at(rows, F.lit(1)), F.try_element_at(rows, F.lit(2))
        two = first.rlike(LONE_NUMBER) & (F.length(second) < 130) & ~second.rlike(DOT_LEADER)
        return F.coalesce(heading(first), F.when(two, F.struct(first.alias("number"), second.alias("title"))))

    return F.try_element_at(F.filter(F.transform(blocks, of_block), lambda h: h.isNotNull()), F.lit(1))


def contents(toc: DataFrame, by: str = "doc") -> DataFrame:
    """Entries (by, page, level, title) of pages from 1 on, titles in plain characters, with chapter_number for entries of level 1 on a chapter's first page."""
    from foliospark.functions.text import normalize_unicode

    number = F.create_map(*[F.lit(x) for kv in CHAPTER_STARTS.items() for x in kv])
    kept = toc.where("page >= 1").select(by, F.col("page").cast("int").alias("page"), F.col("level").cast("int").alias("level"), F.trim(normalize_unicode(F.col("title"))).alias("title"))
    return kept.withColumn("chapter_number", F.when(F.col("level") == 1, number[F.col("page")]))


def with_sections(pages: DataFrame, toc: DataFrame, by: str = "doc", own: str = "own_heading") -> DataFrame:
    """Adds chapter_number, chapter_title, section_number, section_title and section_inherited to pages (by, page, own).

    The chapter is the latest entry of level 1 at or before the page. A page's own heading is its section; without
    one a deeper entry of the contents that begins on the page is, its deepest; else the section before goes on
    within the chapter. Inherited sections are marked; a page before any section has none. Of equal entries the
    greatest title counts. toc is contents().
    """
    chapters = toc.where("level = 1").select(by, "page", F.struct("page", "chapter_number", "title").alias("_c"))
    begun = toc.where("level > 1").groupBy(by, "page").agg(F.max_by("title", F.struct("level", "title")).alias("_t"))
    p = as_of(pages, chapters, by, "page", ["_c"]).join(begun, [by, "page"], "left")
    section = F.coalesce(F.when(F.col(own).isNotNull(), F.struct(F.col(f"{own}.number").alias("number"), F.col(f"{own}.title").alias("title"))), F.when(F.col("_t").isNotNull(), F.struct(F.lit(None).cast("string").alias("number"), F.col("_t").alias("title"))))
    p = p.withColumn("_s", section)
    w = Window.partitionBy(by, "_c").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_l", F.last("_s", ignorenulls=True).over(w))
    out = p.withColumns({"chapter_number": F.col("_c.chapter_number"), "chapter_title": F.col("_c.title"), "section_number": F.col("_l.number"), "section_title": F.col("_l.title")})
    return out.withColumn("section_inherited", F.col("_s").isNull() & F.col("_l").isNotNull()).drop("_c", "_t", "_s", "_l")


def article_references(records: DataFrame, toc: DataFrame, by: str = "doc") -> DataFrame:
    """records with `_reference`: STRUCT<start, paragraph, title, chapter_number, chapter_title, article> of the reference list that covers a kept page, or null.

    A list begins at a kept page's first paragraph that is one of REFERENCE_TITLES, but for a final dot or colon,
    and ends before the next page on which an entry of the contents begins, or on its own page if none follows.
    Between two entries lists end together, so the earliest covers the later ones. The article is the latest entry
    of level 2 or deeper. One as-of join and one window: pages and lists are not multiplied.
    """
    parts = F.split("clean_text", "\n\n")
    is_title = lambda p: F.rtrim(F.lower(F.trim(p)), F.lit(".:")).isin(*REFERENCE_TITLES)
    place = F.array_position(F.transform(parts, is_title), F.lit(True))
    deeper = toc.where("level > 1").groupBy(by, "page").agg(F.max_by("title", F.struct("level", "title")).alias("_article"))
    r = as_of(records, deeper, by, "page", ["_article"])
    found = F.struct(F.col("page").alias("start"), (place - 1).cast("int").alias("paragraph"), F.trim(F.get(parts, (place - 1).cast("int"))).alias("title"), "chapter_number", "chapter_title", F.col("_article").alias("article"))
    r = r.withColumn("_own", F.when(F.col("keep_for_rag") & (place > 0), found))
    begun = toc.select(by, "page").distinct()
    spans = begun.select(by, "page", F.struct("page", (F.lead("page").over(Window.partitionBy(by).orderBy("page")) - 1).alias("end")).alias("_span"))
    first = begun.groupBy(by).agg((F.min("page") - 1).alias("_before"))  # pages before the first entry end with it
    r = as_of(r, spans, by, "page", ["_span"]).join(first, by, "left")
    end = F.when(F.col("_span").isNull(), F.col("_before")).otherwise(F.col("_span.end"))
    w = Window.partitionBy(by, F.col("_span.page")).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    earliest = F.when(end.isNull(), F.col("_own")).otherwise(F.first("_own", ignorenulls=True).over(w))
    return r.withColumn("_reference", earliest).drop("_article", "_own", "_span", "_before")
