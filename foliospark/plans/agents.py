"""Routing queries and their SQL; questions are the user turns of conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliospark.operators import retrieval as R
from foliospark.operators import routing as A
from foliospark.scratch import shared_dir
from foliospark.sources import table
from foliospark.streaming import feedback

ALIASES = ["tion", "ment", "inge", "de", "the", "thinge"]
DOMAIN, HYBRID, RELATION = ("ation", "queau"), ("of the", "de la"), ("inter", "entre", "contr")


def _questions(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


def _features(spark, d):
    vocabulary = table(spark, d, "benchmark").select(F.explode(R.tokens(F.col("text"))).alias("term")).where(F.length("term") >= 3).distinct()
    predicted = F.when(F.length("question") % 2 == 0, "semantic").otherwise("hybrid")
    return A.with_features(_questions(spark, d), vocabulary, ALIASES, predicted, DOMAIN, HYBRID, RELATION)


def route_features(spark, d):
    """Features and state of every question."""
    return _features(spark, d).select("question_id", "estimated_type", "has_entity", "coverage", "coverage_level", "state")


def route_state(spark, d):
    """Questions per state, states without any included."""
    return A.states(spark).join(_features(spark, d).select("state", "question_id"), "state", "left").groupBy("state").agg(F.count("question_id").alias("n"))


def _q_table(spark):
    rows = [(s[0], a, round(((i * 7 + j * 5) % 11) / 4 - 1, 4)) for i, s in enumerate(sorted(A.states(spark).collect())) for j, a in enumerate(A.ACTIONS)]
    return spark.createDataFrame(rows, "state string, action string, q double")


def policy_argmax(spark, d):
    """The policy of a made-up table of values, ties to the first action."""
    return A.greedy(_q_table(spark))


def _gold(spark, d):
    """Questions with a gold type made up: the estimated one but for a tenth of the questions."""
    other = F.element_at(F.array(*map(F.lit, A.TYPES)), (F.col("question_id") % 4 + 1).cast("int"))
    return _features(spark, d).withColumn("gold_type", F.when(F.col("question_id") % 10 == 3, other).otherwise(F.col("estimated_type")))


def routing_accuracy(spark, d):
    """Share of questions routed as their gold type expects, overall and by type."""
    expected = F.create_map(*[F.lit(x) for kv in A.EXPECTED.items() for x in kv])
    decided = _gold(spark, d).join(A.greedy(_q_table(spark)), "state").select(F.col("gold_type").alias("question_type"), "action", expected[F.col("gold_type")].alias("expected"))
    return A.accuracy(decided)


def policy_report(spark, d):
    """Routing and type detection of all questions by the made-up table of values, and how often it abstains where it must."""
    return A.policy_report(_gold(spark, d).join(A.greedy(_q_table(spark)), "state"))


def q_training(spark, d):
    """Values and visits of the trained table; training runs on the questions of even ids, the others are the test split."""
    groups = A.gold_groups(_gold(spark, d).where("question_id % 2 = 0"))
    return A.values_table(spark, A.train(groups)[0], groups)


def q_history(spark, d):
    """Exploration, rewards and accuracy of every epoch of the training."""
    history = A.train(A.gold_groups(_gold(spark, d).where("question_id % 2 = 0")))[2]
    return spark.createDataFrame([tuple(h.values()) for h in history], "epoch long, epsilon double, mean_reward double, cumulative_reward double, routing_accuracy double")


def q_visits(spark, d):
    """Visits of each state over all epochs of the training."""
    groups = A.gold_groups(_gold(spark, d).where("question_id % 2 = 0"))
    return A.values_table(spark, A.train(groups, 1)[0], groups).select("state", "visits").distinct()


def _feedback(spark, d):
    action = F.when(F.col("event_type") == "view", "use_vector").when(F.col("event_type") == "click", "use_graph").when(F.col("event_type") == "purchase", "use_hybrid").otherwise("abstain")
    state = F.concat_ws("|", F.element_at(F.array(*map(F.lit, A.TYPES)), (F.col("user_id") % 4 + 1).cast("int")), F.lit("entity_0"), F.lit("coverage_low"))
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), state.alias("state"), action.alias("action"), F.when(F.col("value") >= 50, A.FEEDBACK).otherwise(-A.FEEDBACK).alias("reward"))


def q_feedback_fold(spark, d):
    """Values after all feedback events in order."""
    return A.feedback_fold(_feedback(spark, d).withColumn("ord", F.col("ts")))


def feedback_stream(spark, d):
    """The same values from a replay of the events as a stream of four files."""
    base = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    events = _feedback(spark, d)
    cuts = events.select(F.unix_micros("ts").alias("u")).agg(F.min("u").alias("a"), F.max("u").alias("b")).first()
    part = F.least(F.lit(3), F.floor((F.unix_micros("ts") - cuts["a"]) * 4 / max(1, cuts["b"] - cuts["a"])))
    for k in range(4):  # files arrive in order of time
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return feedback.run(spark, f"{base}/in", f"{base}/values", f"{base}/checkpoint").select("state", "action", "n", F.round("q", 6).alias("q"))


def context_confidence(spark, d):
    """Confidence of contexts that BM25 and made-up relation counts give."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = R.share_of_best(R.bm25(docs, items, 2)).where("rank = 2")
    action = F.element_at(F.array(*map(F.lit, A.ACTIONS)), (F.col("query_id") % 4 + 1).cast("int"))
    return best.select(F.col("query_id").alias("item_id"), action.alias("action"), F.round(A.context_confidence(action, F.col("share"), (F.col("query_id") % 7)), 6).alias("confidence"))


def final_confidence(spark, d):
    """Final confidence of every action in every state of the made-up table."""
    q = _q_table(spark)
    rows = q.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, A.ACTIONS)), F.col("action")).alias("i"), "q"))), lambda x: x["q"]).alias("values"))
    return q.select("state", "action").join(rows, "state").select("state", "action", A.final_confidence(F.col("values"), F.col("action"), F.lit(0.5)).alias("confidence"))


def answer_rules(spark, d):
    """Kinds of answers over made-up matches and contexts of questions."""
    k, f = F.col("question_id"), _features(spark, d)
    action = F.element_at(F.array(*map(F.lit, A.ACTIONS)), (k % 4 + 1).cast("int"))
    text = A.answer(action, F.col("estimated_type"), (k % 10) / 10, F.lit("gold"), (k % 7) / 10, F.when(k % 3 > 0, "excerpt"), serve_gold=True)
    return f.groupBy(text.alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def query_history_50(spark, d):
    """The fifty latest events, newest first."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def nearest_question_jaccard(spark, d):
    """For every benchmark passage the nearest other one by shared words."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return A.nearest(items.withColumnRenamed("item_id", "question_id"), items.withColumnRenamed("item_id", "known_id"), others_only=True)


def nearest_question_blended(spark, d):
    """For every benchmark passage the nearest other one by letters and words."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return A.nearest_blended(items.withColumnRenamed("item_id", "question_id"), items.withColumnRenamed("item_id", "known_id"), others_only=True)


def evidence_anchor(spark, d):
    """Documents that hold a passage, blanks collapsed, with its place and the sentence context around it, 480 characters at most."""
    flat = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    docs = table(spark, d, "documents").select("doc_id", flat("text").alias("t"))
    items = table(spark, d, "benchmark").select("item_id", flat("text").alias("needle"))
    found = docs.join(F.broadcast(items), F.col("t").contains(F.col("needle")))
    at = F.expr("locate(needle, t)")
    start = F.expr("locate(needle, t) - length(substring_index(substring(t, 1, locate(needle, t) - 1), '. ', -1))")
    return found.select("item_id", "doc_id", at.cast("long").alias("place"), F.md5(F.expr("substring(t, {0}, 480)".format("cast(locate(needle, t) - length(substring_index(substring(t, 1, locate(needle, t) - 1), '. ', -1)) as int)")).cast("binary")).alias("digest"), start.cast("long").alias("start"))


def evidence_missing(spark, d):
    """Passages that no document holds."""
    docs, items = table(spark, d, "documents").select(F.col("text").alias("t")), table(spark, d, "benchmark")
    held = docs.join(F.broadcast(items), F.col("t").contains(F.col("text"))).select("item_id").distinct()
    return items.join(held, "item_id", "left_anti").select("item_id")


def type_classifier(spark, d):
    """Predicted language of all documents by the question-type classifier, trained on those of odd ids."""
    docs = A.type_vectors(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text"))
    out = A.fit_types(docs.where("doc_id % 2 = 1")).transform(docs)
    return out.select("doc_id", "label", F.col("prediction").cast("int").alias("predicted"))


_VOC = f"voc AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '{R.TOKEN}')) AS term FROM benchmark) WHERE length(term) >= 3)"
_ANY = lambda words, c="n": " OR ".join(f"contains({c}, '{w}')" for w in words)
_FT = f"""{_VOC}, qs AS (SELECT conv_id * 1000 + turn AS question_id, text AS question, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS n FROM conversations WHERE role = 'user'),
cv AS (SELECT question_id, round(count(voc.term)::DOUBLE / count(*), 6) AS c FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '{R.TOKEN}')) AS term FROM qs) t LEFT JOIN voc ON voc.term = t.term WHERE length(t.term) >= 3 GROUP BY 1),
f0 AS (SELECT qs.*, coalesce(c, 0) AS coverage, {_ANY([a for a in ALIASES if len(a) > 4])} OR {_ANY([f' {a} ' for a in ALIASES if len(a) <= 4], "' ' || n || ' '")} AS has_entity FROM qs LEFT JOIN cv USING (question_id)),
f1 AS (SELECT *, CASE WHEN coverage >= 0.22 THEN 'high' ELSE 'low' END AS coverage_level, CASE WHEN NOT (has_entity OR {_ANY(DOMAIN)}) THEN 'unknown' WHEN {_ANY(HYBRID)} THEN 'hybrid' WHEN {_ANY(RELATION)} THEN 'relational'
  WHEN length(question) % 2 = 0 THEN 'semantic' ELSE 'hybrid' END AS estimated_type FROM f0),
ft AS (SELECT question_id, estimated_type, has_entity, coverage, coverage_level, estimated_type || '|entity_' || has_entity::INT || '|coverage_' || coverage_level AS state FROM f1)"""
_ST = f"st AS (SELECT t || '|entity_' || e || '|coverage_' || c AS state FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in A.TYPES)}) a(t), (VALUES (0), (1)) b(e), (VALUES ('low'), ('high')) x(c))"
_AC = f"(VALUES {', '.join(f'({j}, {chr(39)}{a}{chr(39)})' for j, a in enumerate(A.ACTIONS))}) ac(j, action)"
_QT = f"""{_ST}, qt AS (SELECT state, action, j, round(((i * 7 + j * 5) % 11) / 4.0 - 1, 4)::DOUBLE AS q FROM (SELECT state, row_number() OVER (ORDER BY state) - 1 AS i FROM st), {_AC}),
po AS (SELECT state, action, q FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY q DESC, j) AS r FROM qt) WHERE r = 1)"""
_EXP = "CASE gold_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.EXPECTED.items()) + " END"
_GT = f"gt AS (SELECT ft.*, CASE WHEN question_id % 10 = 3 THEN {list(A.TYPES)}[question_id % 4 + 1] ELSE estimated_type END AS gold_type FROM ft)"
_FB = """fb AS (SELECT event_id, ts, ['semantic', 'relational', 'hybrid', 'unknown'][user_id % 4 + 1] || '|entity_0|coverage_low' AS state,
  CASE event_type WHEN 'view' THEN 'use_vector' WHEN 'click' THEN 'use_graph' WHEN 'purchase' THEN 'use_hybrid' ELSE 'abstain' END AS action, CASE WHEN value >= 50 THEN 0.5 ELSE -0.5 END::DOUBLE AS reward FROM events),
fo AS (SELECT state, action, count(*) AS n, sum(0.1::DOUBLE * pow(0.9, i) * reward) AS q FROM (SELECT *, row_number() OVER (PARTITION BY state, action ORDER BY ts DESC, event_id DESC) - 1 AS i FROM fb) GROUP BY ALL)"""
_ACT = "['use_vector', 'use_graph', 'use_hybrid', 'abstain']"


def _bm25_second() -> str:
    from foliospark.plans import retrieval as P

    return f"""WITH {P._BM25_BASE}, {P._bm25_sql('br', P._ITEMS, 2)}, s AS (SELECT query_id, rank, {P._SHARE} FROM br), a AS (SELECT query_id, share AS v, least(1.0, (query_id % 7) / 5.0) AS g, {_ACT}[query_id % 4 + 1] AS action FROM s WHERE rank = 2)
      SELECT query_id AS item_id, action, round(CASE action WHEN 'abstain' THEN 1 WHEN 'use_vector' THEN greatest(0, least(1, v)) WHEN 'use_graph' THEN g ELSE 0.55 * v + 0.45 * g END, 6)::DOUBLE AS confidence FROM a"""


_FLATS = "fd AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), fi AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS needle FROM benchmark)"

QUERIES = {
    f.__name__: f
    for f in (route_features, route_state, policy_argmax, routing_accuracy, policy_report, q_training, q_history, q_visits, q_feedback_fold, feedback_stream, context_confidence, final_confidence, answer_rules, query_history_50, nearest_question_jaccard, nearest_question_blended,
              evidence_anchor, evidence_missing, type_classifier)
}

ORACLE_SQL = {
    "route_features": f"WITH {_FT} SELECT * FROM ft",
    "route_state": f"WITH {_FT}, {_ST} SELECT state, count(question_id) AS n FROM st LEFT JOIN ft USING (state) GROUP BY 1",
    "policy_argmax": f"WITH {_QT} SELECT * FROM po",
    "routing_accuracy": f"WITH {_FT}, {_GT}, {_QT} SELECT gold_type AS question_type, count(*) AS n, round(avg((action = {_EXP})::INT), 6) AS accuracy FROM gt JOIN po USING (state) GROUP BY ROLLUP (gold_type)",
    "policy_report": f"""WITH {_FT}, {_GT}, {_QT}, r AS (SELECT gold_type = 'unknown' AS none, gold_type = estimated_type AS same, action = {_EXP} AS good FROM gt JOIN po USING (state))
      SELECT count(*) AS questions, round(count(*) FILTER (good) / greatest(1, count(*)), 6) AS routing_accuracy, round(count(*) FILTER (same) / greatest(1, count(*)), 6) AS type_detection_accuracy,
        round(count(*) FILTER (good AND none) / greatest(1, count(*) FILTER (none)), 6) AS correct_abstention_rate FROM r""",
    "q_visits": f"WITH {_FT}, {_GT}, {_ST}, g AS (SELECT regexp_replace(state, '^[^|]*', gold_type) AS state, count(*) AS n FROM gt WHERE question_id % 2 = 0 GROUP BY 1) SELECT state, coalesce(n, 0) * 160 AS visits FROM st LEFT JOIN g USING (state)",
    "q_feedback_fold": f"WITH {_FB} SELECT state, action, n, round(q, 8) AS q FROM fo",
    "feedback_stream": f"WITH {_FB} SELECT state, action, n, round(q, 6) AS q FROM fo",
    "context_confidence": _bm25_second(),
    "final_confidence": f"WITH {_QT} SELECT state, action, round(0.5 * exp(q - m) / sum(exp(q - m)) OVER (PARTITION BY state) + 0.25, 6)::DOUBLE AS confidence FROM (SELECT *, max(q) OVER (PARTITION BY state) AS m FROM qt)",
    "answer_rules": f"""WITH {_FT} SELECT CASE WHEN action = 'abstain' OR estimated_type = 'unknown' THEN '{A.UNKNOWN}' WHEN (k % 10) / 10.0 >= 0.3 THEN 'gold' WHEN (k % 7) / 10.0 < 0.18 OR k % 3 = 0 THEN '{A.UNKNOWN}' ELSE 'excerpt' END AS answer, count(*) AS n
      FROM (SELECT question_id AS k, estimated_type, {_ACT}[question_id % 4 + 1] AS action FROM ft) GROUP BY 1""",
    "query_history_50": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "nearest_question_jaccard": """WITH w AS (SELECT item_id, list_distinct(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM benchmark),
      s AS (SELECT a.item_id AS question_id, b.item_id AS known_id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS score FROM w a, w b WHERE a.item_id <> b.item_id)
      SELECT question_id, known_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, known_id) AS r FROM s WHERE score > 0) WHERE r = 1""",
    "evidence_anchor": f"""WITH {_FLATS}, h AS (SELECT item_id, doc_id, t, instr(t, needle) AS place FROM fd JOIN fi ON contains(t, needle)), g AS (SELECT *, (place - length(string_split(t[1:place - 1], '. ')[-1])) AS start FROM h)
      SELECT item_id, doc_id, place, md5(substring(t, start, 480)) AS digest, start FROM g""",
    "evidence_missing": "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
}
