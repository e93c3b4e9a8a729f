"""Record, report and service queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import records as P
from foliospark.operators import routing
from foliospark.plans import builds, chunks, graphs, structures, texts
from foliospark.service import Service
from foliospark.sources import table

REL = ("CAUSES", "LINKED_TO", "BASED_ON", "NEAR", "CONSTRAINS")


def _pages(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 206 + 1).cast("int").alias("page"), "text")


def page_records(spark, d):
    """Records of all pages."""
    return P.page_records(_pages(spark, d)).select("doc_id", "page", "thesis_page", "zone", "language", "language_confidence", "keep_for_rag", "exclusion_reason", "raw_char_count", "clean_char_count", "estimated_word_count", F.md5(F.col("clean_text").cast("binary")).alias("digest"))


def document_records(spark, d):
    """The whole record of every page; some pages begin with a heading, in one line or two."""
    k = F.col("doc_id")
    text = F.when(k % 11 == 3, F.concat(F.lit("2.1\nResult of "), k, F.lit("\n\n"), "text")).when(k % 11 == 4, F.concat(F.lit("3 Method of "), k, F.lit("\n"), "text")).otherwise(F.col("text"))
    layout = F.when(k % 10 == 9, "figure_or_sparse").when(k % 10 == 8, "double_column").otherwise("single_column")
    pages = structures._pages(spark, d).select("doc_id", "doc", "page", text.alias("text"), layout.alias("layout"), (k % 3).cast("int").alias("n_images"), F.lit("thesis").alias("document_id"), F.lit("thesis.pdf").alias("source_file"), F.lit("0A").alias("source_sha256"))
    out = P.document_records(pages, structures._toc(spark, d))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return out.withColumns({"raw_text": digest("raw_text"), "clean_text": digest("clean_text"), "warnings": F.array_join("warnings", ",")})


def warnings_histogram(spark, d):
    """Warnings of all page records."""
    return P.warnings_histogram(P.page_records(_pages(spark, d)))


def appendix_report(spark, d):
    """The report on the last appendix's pages, its lists as text."""
    r = P.appendix_stats(P.page_records(_pages(spark, d)))
    listed = F.array_join(F.transform("excluded_pages", lambda x: F.format_string("%03d:%s", x["page"], x["exclusion_reason"])), ",")
    return r.withColumn("kept_pages", F.array_join("kept_pages", ",")).withColumn("excluded_pages", listed)


def forbidden_leaks(spark, d):
    """Kept pages that are on the forbidden list (those whose number ends in 7)."""
    forbidden = _pages(spark, d).where("page % 10 = 7").select("page")
    return P.leaks(P.page_records(_pages(spark, d)), forbidden).select("doc_id", "page")


def page_metadata(spark, d):
    """Chapter, section and language of documents with parts missing."""
    k = F.col("doc_id")
    m = P.page_meta(F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("source")), F.when(k % 2 == 0, F.lit("2")), F.when(k % 5 == 0, F.lit("Results")), F.when(k % 4 == 0, F.lit("2.1")), F.when(k % 7 > 0, F.col("lang")))
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.*")


def label_report(spark, d):
    """Counts of labels by each field."""
    return P.question_report(table(spark, d, "labels"), ["quality", "toxic"])


def evidence_similarity(spark, d):
    """Mean and best inner product of each query vector with the vectors of its label."""
    from foliospark.operators import scoring as S
    from foliospark.plans.retrieval import _same_label

    scorers, same = _same_label(spark, d)

    def other(ids, batch):
        return same(ids, batch) & (batch.column(0).to_numpy(zero_copy_only=False)[None, :] != ids[:, None])

    out = S.stats(spark, scorers, other).select(F.col("query_id").alias("question_id"), F.round("mean", 6).alias("mean"), F.round("best", 6).alias("best"))
    return out.withColumn("warned", F.col("best") < 0.40)


def evidence_best_chunk(spark, d):
    """For every passage the document on its page that shares most words."""
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id"), (F.col("item_id") % 206 + 1).cast("int").alias("page"), "text")
    return P.best_chunk(e, _pages(spark, d).withColumnRenamed("doc_id", "chunk_id"))


def verified_relations(spark, d):
    """Relations between nations and regions by aliases, with mapped types."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    kinds = F.element_at(F.array(*map(F.lit, REL)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rel = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("subject"), kinds.alias("predicate"), F.col("r_name").alias("object"))
    return P.verified_relations(rel, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("alias"), F.concat(F.lit("N:"), "n_name").alias("canonical")))


def entity_names(spark, d):
    """Gazetteer entries in the benchmark passages."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    e = spark.createDataFrame([(t, t) for t in graphs.TERMS], "entity string, alias string")
    return P.entity_names(q, e).select(F.col("question_id").alias("item_id"), F.array_join("names", "|").alias("names"))


def _service(spark, d, reports=None):
    docs = table(spark, d, "documents").select("doc_id", "text")
    e = spark.createDataFrame([(t, t) for t in graphs.TERMS], "entity string, alias string")
    relations = graphs._trade(spark, d).select((F.col("u") * 100 + F.col("v")).alias("relation_id"), "u", "v")
    q_table = routing.states(spark).crossJoin(spark.createDataFrame([(a, 1.0 if a == "use_vector" else 0.5) for a in routing.ACTIONS], "action string, q double"))
    return Service(docs, e, relations, q_table, reports)


def _reports(spark, d):
    return {"chunking": chunks.chunk_score(spark, d), "embeddings": builds.embedding_score(spark, d).withColumn("dimension", F.length("method"))}


def service_answers(spark, d):
    """Answers to the user turns of conversations by the service with a made-up table of values."""
    asked = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    out = _service(spark, d).answer(asked)
    return out.withColumn("answer", F.md5(F.col("answer").cast("binary")))


def service_vectorial(spark, d):
    """The winners that the service names, by scores made from order lines."""
    return _service(spark, d, _reports(spark, d)).vectorial()


def service_evaluation(spark, d):
    """Rows of each report of the service."""
    return _service(spark, d, _reports(spark, d)).evaluation().groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("row", "$.winner") == "true").alias("winners"))


def service_graph(spark, d):
    """Nodes and relations that the service gives of the trade between nations."""
    return _service(spark, d).graph()


def service_graph_status(spark, d):
    """Distinct counts of the service's graph."""
    return _service(spark, d).graph_status()


def service_plot(spark, d):
    """Two components of all documents, those nearest to a question marked."""
    return _service(spark, d).plot("the meaning of the text", 5)


_CLEAN = f"""kp AS (SELECT doc_id, pos, line FROM ln WHERE {texts._KEY} NOT IN (SELECT line_key FROM rl) AND NOT regexp_full_match(trim(line), '[0-9]{{1,4}}') AND NOT regexp_full_match(lower(trim(line)), '[ivxlcdm]{{1,8}}')
  AND NOT regexp_full_match(lower(trim(line)), '(page|p\\.)\\s*[0-9]{{1,4}}')),
jn AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS j FROM kp GROUP BY 1),
ct AS (SELECT d.doc_id, (d.doc_id % 206 + 1)::INTEGER AS page, d.text, coalesce(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace({texts._duck('j')}, '([{texts.T.LETTERS}]{{2,}})-\\n([{texts.T.LETTERS}]+)', '\\1\\2', 'g'), '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)), '') AS t FROM documents d LEFT JOIN jn USING (doc_id))"""
_FRC, _ENC = (x.replace("lower(text)", "lower(t)") for x in (texts._FR, texts._EN))
_REC = f"""{texts._LINES}, {texts._RUN}, {_CLEAN},
pn AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]{{1,3}}')), lambda x: x::INTEGER), lambda x: x > 0)[-1] AS printed,
  CASE WHEN page >= 16 THEN page - 15 END AS rule, {_FRC} AS fr, {_ENC} AS en FROM ct),
zn AS (SELECT pn.*, coalesce(zone, 'front_matter') AS zone FROM pn LEFT JOIN (VALUES {', '.join(map(str, P.structure.ZONES))}) v(lo, hi, zone) ON page BETWEEN lo AND hi),
rc AS (SELECT doc_id, page, (CASE WHEN printed IS NULL THEN rule WHEN rule IS NULL THEN NULL WHEN abs(printed - rule) <= 2 THEN printed ELSE rule END)::INTEGER AS thesis_page, zone,
  CASE WHEN t = '' THEN 'unknown' WHEN fr + en < 5 OR fr = en THEN 'en' WHEN fr > en THEN 'fr' ELSE 'en' END AS language,
  CASE WHEN t = '' OR fr + en < 5 THEN 0.0::DOUBLE WHEN fr = en THEN 0.5::DOUBLE ELSE round(greatest(fr, en)::DOUBLE / (fr + en), 3) END AS language_confidence,
  CASE WHEN zone NOT IN {P.structure.KEPT_ZONES} THEN CASE zone {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in P.structure.REASONS.items())} ELSE 'hors_perimetre' END WHEN t = '' THEN 'page_blanche'
    WHEN zone = 'appendix_c' AND length(t) < 150 THEN 'annexe_c_sans_texte_exploitable' WHEN zone <> 'appendix_c' AND length(t) < 120 THEN 'page_quasi_vide_ou_titre_seul' END AS exclusion_reason,
  length(text)::INTEGER AS raw_char_count, length(t)::INTEGER AS clean_char_count, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> ''))::INTEGER AS estimated_word_count, t,
  CASE WHEN printed IS NULL THEN NULL WHEN rule IS NULL THEN 'number in front matter' WHEN printed = rule THEN NULL WHEN abs(printed - rule) <= 2 THEN 'printed number differs' ELSE 'foreign numbering' END AS warning FROM zn)"""

QUERIES = {f.__name__: f for f in (page_records, document_records, appendix_report, warnings_histogram, forbidden_leaks, page_metadata, label_report, evidence_similarity, evidence_best_chunk, verified_relations, entity_names, service_answers, service_vectorial, service_evaluation, service_graph, service_graph_status, service_plot)}

ORACLE_SQL = {
    "page_records": f"WITH {_REC} SELECT doc_id, page, thesis_page, zone, language, language_confidence, exclusion_reason IS NULL AS keep_for_rag, exclusion_reason, raw_char_count, clean_char_count, estimated_word_count, md5(t) AS digest FROM rc",
    "warnings_histogram": f"WITH {_REC} SELECT warning, count(*) AS n FROM (SELECT warning FROM rc UNION ALL SELECT 'language not sure' FROM rc WHERE language_confidence = 0 UNION ALL SELECT 'blank' FROM rc WHERE t = '') WHERE warning IS NOT NULL GROUP BY 1",
    "forbidden_leaks": f"WITH {_REC} SELECT doc_id, page FROM rc WHERE exclusion_reason IS NULL AND page % 10 = 7",
    "page_metadata": """SELECT doc_id, coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source END, ''), CASE WHEN doc_id % 2 = 0 THEN '2' END, 'Front matter') AS chapter,
      coalesce(CASE WHEN doc_id % 5 = 0 THEN 'Results' END, CASE WHEN doc_id % 4 = 0 THEN '2.1' END, 'Non spécifiée') AS section, coalesce(CASE WHEN doc_id % 7 > 0 THEN lang END, 'unknown') AS language FROM documents""",
    "label_report": "SELECT field, value, count(*) AS n FROM (SELECT 'quality' AS field, quality::VARCHAR AS value FROM labels UNION ALL SELECT 'toxic', toxic::VARCHAR FROM labels) GROUP BY ALL",
    "evidence_similarity": """WITH s AS (SELECT q.vec_id AS question_id, v.vec_id, q.label = v.label AS same, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s), g AS (SELECT question_id, round(avg(score), 6) AS mean, round(max(score), 6) AS best FROM r WHERE same AND question_id <> vec_id GROUP BY 1)
      SELECT *, best < 0.40 AS warned FROM g""",
    "evidence_best_chunk": """WITH w AS (SELECT item_id AS evidence_id, item_id % 206 + 1 AS page, list_distinct(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS we FROM benchmark),
      c AS (SELECT doc_id AS chunk_id, doc_id % 206 + 1 AS page, list_distinct(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS wc FROM documents),
      s AS (SELECT evidence_id, chunk_id, len(list_intersect(we, wc))::INTEGER AS shared FROM w JOIN c USING (page))
      SELECT evidence_id, chunk_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY shared DESC, chunk_id) AS r FROM s) WHERE r = 1""",
    "verified_relations": f"""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'N:' || n_name ELSE lower(n_name) END AS source, r_name AS target, CASE n_nationkey % 5 WHEN 0 THEN 'CAUSES' WHEN 2 THEN 'USES' WHEN 4 THEN 'INFLUENCES' ELSE 'ASSOCIATED_WITH' END AS type,
      0.95::DOUBLE AS confidence, {list(REL)}[n_nationkey % 5 + 1] AS original_predicate FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "entity_names": f"""SELECT item_id, array_to_string((list(e ORDER BY e))[1:12], '|') AS names FROM (SELECT item_id, text, {graphs._NORM.format(x='text')} AS nt FROM benchmark), {graphs.GAZETTEER} WHERE {graphs.FOUND} GROUP BY 1""",
    "service_graph": f"WITH {graphs._T} SELECT 'node' AS kind, node::VARCHAR AS id, NULL::VARCHAR AS u, NULL::VARCHAR AS v, degree::BIGINT AS degree FROM dg UNION ALL SELECT 'relation', (u * 100 + v)::VARCHAR, u::VARCHAR, v::VARCHAR, NULL FROM t",
    "service_graph_status": f"WITH {graphs._T} SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM t) AS relations, {len(graphs.TERMS)}::BIGINT AS entities, {len(graphs.TERMS)}::BIGINT AS aliases, (SELECT count(*) FROM dg) > 0 AS connected",
    "appendix_report": f"""WITH {_REC}, o AS (SELECT * FROM rc WHERE page BETWEEN 174 AND 206) SELECT count(*) AS inspected, count(*) FILTER (exclusion_reason IS NULL) AS kept, count(*) FILTER (exclusion_reason IS NOT NULL) AS excluded,
      coalesce(sum(len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: trim(p) <> ''))) FILTER (exclusion_reason IS NULL), 0)::BIGINT AS segments_kept, coalesce(sum(clean_char_count) FILTER (exclusion_reason IS NULL), 0)::BIGINT AS characters_kept,
      coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (exclusion_reason IS NULL)), ','), '') AS kept_pages,
      coalesce(array_to_string(list_sort(list(DISTINCT format('{{:03d}}:{{}}', page, exclusion_reason)) FILTER (exclusion_reason IS NOT NULL)), ','), '') AS excluded_pages FROM o""",
}

_RUNS = (chunks.ORACLE_SQL["chunk_score"], builds.ORACLE_SQL["embedding_score"])
ORACLE_SQL |= {
    "service_vectorial": f"SELECT (SELECT count(*) FROM documents) AS chunks, c.method AS chunking_winner, e.method AS embeddings_winner, length(e.method)::INTEGER AS dimension, NULL::VARCHAR AS retrieval_winner FROM ({_RUNS[0]}) c, ({_RUNS[1]}) e WHERE c.winner AND e.winner",
    "service_evaluation": f"SELECT 'chunking' AS report, count(*) AS n, count(*) FILTER (winner) AS winners FROM ({_RUNS[0]}) UNION ALL SELECT 'embeddings', count(*), count(*) FILTER (winner) FROM ({_RUNS[1]})",
    "document_records": f"""WITH documents AS (SELECT doc_id, CASE doc_id % 11 WHEN 3 THEN '2.1' || chr(10) || 'Result of ' || doc_id || chr(10) || chr(10) || text WHEN 4 THEN '3 Method of ' || doc_id || chr(10) || text ELSE text END AS text FROM main.documents), {structures._P}, {structures._TOC}, {_REC},
      e AS (SELECT doc_id, doc, page, doc_id % 11 IN (3, 4) AS own, CASE WHEN page IN {tuple(P.structure.CHAPTER_STARTS)} THEN page END AS start FROM p),
      c AS (SELECT e.*, (SELECT max(page) FROM toc WHERE toc.doc = e.doc AND level = 1 AND toc.page <= e.page) AS cp, (SELECT max(title) FROM toc WHERE toc.doc = e.doc AND level > 1 AND toc.page = e.page) AS tt FROM e),
      o AS (SELECT *, CASE WHEN own THEN CASE doc_id % 11 WHEN 3 THEN '2.1|Result of ' || doc_id ELSE '3|Method of ' || doc_id END WHEN tt IS NOT NULL THEN '|' || tt END AS s FROM c),
      f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY doc, cp ORDER BY page ROWS UNBOUNDED PRECEDING) AS l FROM o),
      g AS (SELECT f.*, nullif(string_split(l, '|')[1], '') AS sn, string_split(l, '|')[2] AS st, CASE doc_id % 10 WHEN 9 THEN 'figure_or_sparse' WHEN 8 THEN 'double_column' ELSE 'single_column' END AS ly FROM f),
      h AS (SELECT g.*, zn.printed, zn.text, rc.* EXCLUDE (doc_id, page), lower(coalesce(st, '')) AS title, ltrim(rc.t)[1:80] AS head, rc.exclusion_reason IS NULL AS keep, (SELECT max(title) FROM toc WHERE toc.doc = g.doc AND toc.page = cp) AS ct FROM g JOIN zn USING (doc_id) JOIN rc USING (doc_id))
      SELECT 'thesis' AS document_id, 'thesis.pdf' AS source_file, '0A' AS source_sha256, doc, page, thesis_page, printed AS printed_page, zone, CASE cp {' '.join(f"WHEN {k} THEN '{v}'" for k, v in P.structure.CHAPTER_STARTS.items())} END AS chapter_number, ct AS chapter_title, sn AS section_number, st AS section_title,
        s IS NULL AND l IS NOT NULL AS section_inherited, language, language_confidence, CASE WHEN regexp_matches(head, '(?i)^(Figure|Fig\\.)\\s*[A-Z]?\\.?[0-9]') THEN 'figure_caption' WHEN regexp_matches(head, '(?i)^(Table|Tableau)\\s*[A-Z]?\\.?[0-9]') THEN 'table_caption' WHEN ly = 'figure_or_sparse' THEN 'figure_caption'
          WHEN zone = 'summaries' OR starts_with(lower(head), 'abstract') THEN 'abstract' {structures._CT} WHEN zone IN ('appendix_a', 'appendix_b', 'appendix_c') THEN 'appendix' ELSE 'other' END AS content_type,
        CASE WHEN keep THEN ly ELSE 'excluded' END AS extraction_mode, ly AS detected_layout, keep AS keep_for_rag, exclusion_reason, md5(text) AS raw_text, md5(t) AS clean_text, raw_char_count, clean_char_count, estimated_word_count, (doc_id % 3)::INTEGER AS n_images,
        concat_ws(',', warning, CASE WHEN language_confidence = 0 THEN 'language not sure' END, CASE WHEN t = '' THEN 'blank' END, CASE WHEN ly = 'figure_or_sparse' THEN 'figures' END, CASE WHEN keep AND t = '' THEN 'kept without text' END) AS warnings FROM h""",
}
