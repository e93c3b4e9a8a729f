"""Routing of questions: features, states, a tabular policy, its training and feedback, confidences and answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import normalize_text, tokens

ACTIONS = ("use_vector", "use_graph", "use_hybrid", "abstain")
TYPES = ("semantic", "relational", "hybrid", "unknown")
ALPHA, GAMMA, FEEDBACK, COVERAGE = 0.1, 0.9, 0.5, 0.22
MATCHED, CONTEXT, UNKNOWN = 0.30, 0.18, "Je ne sais pas."
# Parts of a normalised question that tell the domain, hybrid and relational questions.
DOMAIN = ("froid", "cold", "climat", "hiver", "winter", "temperature", "atmospher", "circulation", "stratospher", "swg", "nao", "wcc", "cmip", "analogue", "generateur", "echantillonnage", "alpha t", "blocage", "jet")
HYBRID = ("et quel objectif", "et quelle amelioration", "et pourquoi", "et comment", "ainsi que")
RELATION = ("lien", "relation", "relie", "associe", "effet", "influence", "contribu", "mecanisme", "trajet", "regime", "entre")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def with_features(questions: DataFrame, vocabulary: DataFrame, aliases: list[str], predicted: Column, domain: tuple[str, ...] = DOMAIN, hybrid: tuple[str, ...] = HYBRID, relation: tuple[str, ...] = RELATION) -> DataFrame:
    """questions (question_id, question) with estimated_type, has_entity, coverage, coverage_level and state.

    An alias of over four characters may be part of a word, a shorter one must be a word. Coverage is the
    share of tokens of three characters or more that vocabulary (term) holds, by an equality join.
    `predicted` is the type model's verdict for questions that no rule decides.
    """
    norm = normalize_text(F.col("question"))
    long, short = tuple(a for a in aliases if len(a) > 4), tuple(f" {a} " for a in aliases if len(a) <= 4)
    base = questions.withColumn("_n", norm).withColumn("has_entity", contains_any(F.col("_n"), long) | contains_any(F.concat(F.lit(" "), "_n", F.lit(" ")), short)).withColumn("_p", predicted)
    toks = questions.select("question_id", F.explode(tokens(F.col("question"))).alias("term")).where(F.length("term") >= 3)
    known = toks.join(vocabulary.select("term", F.lit(1).alias("k")), "term", "left").groupBy("question_id").agg(F.round(F.count("k") / F.count(F.lit(1)), 6).alias("coverage"))
    f = base.join(known, "question_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    inside = F.col("has_entity") | contains_any(F.col("_n"), domain)
    kind = F.when(~inside, "unknown").when(contains_any(F.col("_n"), hybrid), "hybrid").when(contains_any(F.col("_n"), relation), "relational").otherwise(F.when(F.col("_p").isin(*TYPES), F.col("_p")).otherwise("unknown"))
    f = f.withColumn("estimated_type", kind).withColumn("coverage_level", F.when(F.col("coverage") >= COVERAGE, "high").otherwise("low"))
    return f.withColumn("state", F.concat_ws("|", "estimated_type", F.concat(F.lit("entity_"), F.col("has_entity").cast("int")), F.concat(F.lit("coverage_"), "coverage_level"))).drop("_n", "_p")


def states(spark) -> DataFrame:
    """All states of the policy: four types, entity or not, coverage low or high."""
    rows = [(f"{t}|entity_{e}|coverage_{c}",) for t in TYPES for e in (0, 1) for c in ("low", "high")]
    return spark.createDataFrame(rows, "state string")


def greedy(q_table: DataFrame) -> DataFrame:
    """(state, action, q): the action of highest value, the first of ACTIONS on ties; q_table is (state, action, q)."""
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    return q_table.groupBy("state").agg(F.max_by(F.struct("action", "q"), F.struct(F.col("q"), -place)).alias("b")).select("state", "b.action", "b.q")


def accuracy(decided: DataFrame) -> DataFrame:
    """Accuracy over all and by type: decided is (question_type, action, expected)."""
    hit = (F.col("action") == F.col("expected")).cast("int")
    return decided.rollup("question_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def epsilon(epoch: int, epochs: int = 160) -> float:
    """Exploration falls from 0.30 to 0.05."""
    return max(0.05, 0.3 * math.exp(-3 * epoch / max(1, epochs - 1)))


EXPECTED = {"semantic": "use_vector", "relational": "use_graph", "hybrid": "use_hybrid", "unknown": "abstain"}


POST_ACTIONS, POST_STATES = ("answer", "abstain", "escalate_hybrid"), ("context_found", "context_weak", "context_empty")


def shares(values: list[float], eps: float) -> list[float]:
    """How often each action is taken: all alike while exploring, the best ones (ties alike) otherwise."""
    top = [math.isclose(v, max(values), rel_tol=1e-9, abs_tol=1e-12) for v in values]
    return [eps / len(values) + (1 - eps) * t / sum(top) for t in top]


def train(groups: list[tuple[str, str, int]], epochs: int = 160) -> tuple[dict, dict, list[dict]]:
    """(route values, post-retrieval values, history) of tabular Q-learning over groups (state, type, questions).

    The right route earns 1 (0.7 for the costly hybrid), a wrong one -1 (-1.3). After it the context is found, for
    unanswerable questions (type unknown) empty, and after a wrong route weak. To abstain earns 1 for an unanswerable
    question, to answer after the right route and to escalate after a wrong one for another; anything else earns -1,
    and half a point more goes to every step after the right route of an answerable question. Route values learn from their reward and the best value of the context that follows; states never
    seen take the mean of the seen ones of their type.

    Expected steps in place of drawn ones: a group's n questions take every action n times its share() in an epoch,
    and m steps towards one target are one step of 1 - 0.9^m. So the result depends on no seed and no order, and
    the work on the number of groups, 64 at most, and not on that of questions. Without questions all values are zero.
    """
    every = [f"{t}|entity_{e}|coverage_{c}" for t in TYPES for e in (0, 1) for c in ("low", "high")]
    route, post = {s: [0.0] * len(ACTIONS) for s in every}, {s: [0.0] * len(POST_ACTIONS) for s in POST_STATES}
    asked = sum(n for _, _, n in groups)
    history = []
    for epoch in range(epochs if asked else 0):
        eps, total, right = epsilon(epoch, epochs), 0.0, 0.0
        steps = []  # (state, action, type, reward, context, times) by the values at the epoch's start
        for state, kind, n in groups:
            for a, p in enumerate(shares(route[state], eps)):
                good = ACTIONS[a] == EXPECTED[kind]
                context = "context_weak" if not good else "context_empty" if kind == "unknown" else "context_found"
                steps.append((state, a, (1.0 if good else -1.0) - 0.3 * (ACTIONS[a] == "use_hybrid"), context, kind, n * p))
                right += n * p * good
        gains = {c: [0.0] * len(POST_ACTIONS) for c in POST_STATES}  # sums of the rewards, by times
        times = dict.fromkeys(POST_STATES, 0.0)
        for _, _, reward, context, kind, n in steps:
            want = "escalate_hybrid" if context == "context_weak" and kind != "unknown" else "answer" if context == "context_found" else "abstain"
            times[context] += n
            for b, name in enumerate(POST_ACTIONS):
                gains[context][b] += n * ((1.0 if name == want else -1.0) + 0.5 * (context == "context_found"))
            total += n * reward
        for c in POST_STATES:
            if times[c] > 0:
                for b, p in enumerate(shares(post[c], eps)):
                    mean = gains[c][b] / times[c]
                    total += times[c] * p * mean
                    post[c][b] += (1 - (1 - ALPHA) ** (times[c] * p)) * (mean - post[c][b])
        moves: dict[tuple[str, int], list[float]] = {}
        for state, a, reward, context, _, n in steps:
            at = moves.setdefault((state, a), [0.0, 0.0])
            at[0] += n
            at[1] += n * (reward + GAMMA * max(post[context]))
        for (state, a), (n, aim) in moves.items():
            if n > 0:
                route[state][a] += (1 - (1 - ALPHA) ** n) * (aim / n - route[state][a])
        history.append({"epoch": epoch + 1, "epsilon": round(eps, 6), "mean_reward": round(total / asked, 6), "cumulative_reward": round(total, 6), "routing_accuracy": round(right / asked, 6)})
    seen = {s for s, _, n in groups if n > 0}
    for s in every:
        like = [route[x] for x in sorted(seen) if x.split("|")[0] == s.split("|")[0]]
        if s not in seen and like:
            route[s] = [sum(v) / len(like) for v in zip(*like, strict=True)]
    return route, post, history


def gold_groups(decided: DataFrame) -> list[tuple[str, str, int]]:
    """Groups of train() from questions (state, gold_type): the state's type is the gold one while training; 64 groups at most reach the driver."""
    rest = F.regexp_replace("state", "^[^|]*", "")
    rows = decided.groupBy(F.concat("gold_type", rest).alias("state"), "gold_type").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["state"], r["gold_type"], r["n"]) for r in rows)


def values_table(spark, route: dict, groups: list[tuple[str, str, int]], epochs: int = 160) -> DataFrame:
    """(state, action, q, visits) of trained values; visits counts the questions of a state over all epochs."""
    visits: dict[str, int] = {}
    for state, _, n in groups:
        visits[state] = visits.get(state, 0) + n * epochs
    rows = [(s, a, round(v, 8), visits.get(s, 0)) for s, values in sorted(route.items()) for a, v in zip(ACTIONS, values, strict=True)]
    return spark.createDataFrame(rows, "state string, action string, q double, visits long")


def policy_report(decided: DataFrame) -> DataFrame:
    """One row over questions (gold_type, estimated_type, action): their number, the shares of right routes and right types, and that of abstentions among the unanswerable.

    A share over no questions is zero.
    """
    expected = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])[F.col("gold_type")]
    right, unknown = F.col("action") == expected, F.col("gold_type") == "unknown"
    n = F.count(F.lit(1))
    share = lambda hits, of: F.round(hits / F.greatest(F.lit(1), of), 6)
    return decided.agg(
        n.alias("questions"), share(F.count_if(right), n).alias("routing_accuracy"), share(F.count_if(F.col("estimated_type") == F.col("gold_type")), n).alias("type_detection_accuracy"),
        share(F.count_if(right & unknown), F.count_if(unknown)).alias("correct_abstention_rate"),
    )


def feedback_fold(events: DataFrame, start: float = 0.0, by: tuple[str, ...] = ("state", "action")) -> DataFrame:
    """(by, n, q): the value after all feedback (by, ord, event_id, reward) in order, each step moving a tenth of the way.

    Closed form of the fold: the start fades by 0.9 each step and the reward of the step i-th from the end
    weighs 0.1 x 0.9^i, so it is one window and one sum. Steps too far back to matter in a double (under
    1e-300) add nothing and are computed as zero weights.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("ord"), F.desc("event_id"))
    back = events.withColumn("_i", F.row_number().over(w) - 1)
    weight = F.when(F.col("_i") < 6500, F.pow(F.lit(1 - ALPHA), F.col("_i"))).otherwise(0.0)
    out = back.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ALPHA * weight * F.col("reward")).alias("s"))
    fade = F.when(F.col("n") < 6500, F.pow(F.lit(1 - ALPHA), F.col("n"))).otherwise(0.0)
    return out.select(*by, "n", F.round(F.col("s") + start * fade, 8).alias("q"))


def context_confidence(action: Column, vector_score: Column, relations: Column) -> Column:
    """How far the context supports an answer: the best score, the relations over five, or a mix; abstaining is sure."""
    v, g = F.coalesce(vector_score, F.lit(0.0)), F.least(F.lit(1.0), F.coalesce(relations, F.lit(0)) / 5.0)
    return F.when(action == "abstain", 1.0).when(action == "use_vector", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).when(action == "use_graph", g).otherwise(0.55 * v + 0.45 * g)


def final_confidence(q_values: Column, action: Column, context: Column) -> Column:
    """Half the action's share in the softmax of q_values (in the order of ACTIONS), half the context's confidence."""
    e = F.transform(F.array(F.array_max(q_values)), lambda m: F.transform(q_values, lambda x: F.exp(x - m)))[0]
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    mine = F.element_at(e, F.array_position(F.array(*map(F.lit, ACTIONS)), action).cast("int"))
    return F.round(0.5 * mine / total + 0.5 * context, 6)


def answer(action: Column, kind: Column, match: Column, gold: Column, context: Column, excerpt: Column, serve_gold: bool = False) -> Column:
    """The answer's text: none when abstaining or unknown; the annotated one of a near question if asked for; else the first excerpt."""
    out = F.when((action == "abstain") | (kind == "unknown"), UNKNOWN)
    if serve_gold:
        out = out.when(match >= MATCHED, gold)
    return out.when((context < CONTEXT) | excerpt.isNull(), UNKNOWN).otherwise(excerpt)


def nearest(questions: DataFrame, known: DataFrame, least_shared: int = 1, others_only: bool = False) -> DataFrame:
    """(question_id, known_id, score): for each question the known question of most similar words (Jaccard), ties to the smaller id.

    Candidates share `least_shared` words at least, found by an equality join on words, so pairs without a
    common word, whose similarity is zero, never meet. others_only leaves out a question's own id.
    """
    words = lambda f, i: f.select(F.col(i), F.array_distinct(F.split(normalize_text(F.col("question")), " ")).alias("w"))
    q, k = words(questions, "question_id"), words(known, "known_id")
    a = q.select("question_id", F.size("w").alias("na"), F.explode("w").alias("t"))
    b = k.select("known_id", F.size("w").alias("nb"), F.explode("w").alias("t"))
    met = a.join(b, "t")
    if others_only:
        met = met.where("question_id <> known_id")
    shared = met.groupBy("question_id", "known_id", "na", "nb").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_shared)
    scored = shared.select("question_id", "known_id", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "known_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def nearest_blended(questions: DataFrame, known: DataFrame, others_only: bool = False, sequence: float = 0.65) -> DataFrame:
    """As nearest(), by 0.65 of the sequence similarity and 0.35 of the word overlap of the normalised questions.

    Candidates share a word; a pair without one is not compared, however alike its letters.
    """
    from foliospark.functions.python import match_ratio

    def words(f: DataFrame, i: str, n: str) -> DataFrame:
        return f.select(F.col(i), normalize_text(F.col("question")).alias(n))

    q, k = words(questions, "question_id", "qn"), words(known, "known_id", "kn")
    split = lambda c: F.array_distinct(F.split(c, " "))
    met = q.select("question_id", F.explode(split("qn")).alias("t")).join(k.select("known_id", F.explode(split("kn")).alias("t")), "t").select("question_id", "known_id").distinct()
    if others_only:
        met = met.where("question_id <> known_id")
    pairs = met.join(q, "question_id").join(k, "known_id")
    overlap = F.size(F.array_intersect(split("qn"), split("kn"))) / F.size(F.array_union(split("qn"), split("kn")))
    scored = pairs.select("question_id", "known_id", F.round(sequence * match_ratio("qn", "kn") + (1 - sequence) * overlap, 6).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "known_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


GRAMS = 1 << 12


def type_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `tf`, hashed character grams, in place of the text; texts are cut once, as training and prediction read the vectors only."""
    from foliospark.operators.vectors import hashed_grams

    return hashed_grams(docs, GRAMS, text)


def fit_types(labelled: DataFrame, label: str = "label"):
    """A pipeline that predicts a label from type_vectors() by multinomial logistic regression with balanced weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, StringIndexer

    per = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(0))) / (F.col("n") * F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))))  # one row per label
    weighted = labelled.join(F.broadcast(per.select(label, "weight")), label)
    stages = [StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"), IDF(inputCol="tf", outputCol="x")]
    stages.append(LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=50, regParam=0.01, family="multinomial"))
    return Pipeline(stages=stages).fit(weighted)
