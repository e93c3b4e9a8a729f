"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Every rule is a Boolean SQL expression over the text and the word array. A sample over all partitions tells each
rule's cost and selectivity (share rejected): one job reads the clock before and after every rule on every sampled
row, REPEATS times, and takes the least, less what a rule that does nothing takes. The rules then run
in the order of falling rejection per cost inside one CASE expression, so a row that one rule rejects never
evaluates a later rule. The order changes the work only: a row is kept if no rule rejects it.

Edge cases. A null text counts as empty: no words, so the rule on few words rejects it. A null id or
a repeated row is judged like any other row. Ties between rules fall to the rule's name. An empty table
gives no rows, and rules in the order of their names. Extra columns pass through keep() untouched,
whatever their names; judge() adds one column, for which a name is chosen that docs does not have. Very long
texts are judged whole.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.scratch import discard, stage
from foliospark.sources import table

SAMPLE_ROWS = 2000  # about so many rows are timed; the order, not the verdict, follows from them
SAMPLE_BYTES = 1 << 16  # longer texts are judged, but not timed
REPEATS = 4
CLOCK = "java_method('java.lang.System', 'nanoTime')"
MARK = "__fs_"

TEXT = f"coalesce({MARK}text, '')"
WORDS = "w"  # bound by the one lambda around the cascade, so that no rewrite can copy the splitting into inner lambdas
#: Words: split at 0x20 and 0x09-0x0D.
WORDS_SQL = f"array_remove(split({TEXT}, '[ \\\\t-\\\\r]'), '')"
WORD_CHARS = f"length(array_join({WORDS}, ''))"
SYMBOLS = f"regexp_count({TEXT}, '[#*$%&|<>]')"
UPPER = f"regexp_count({TEXT}, '[A-Z]')"
LINES = f"filter(split({TEXT}, '\\n'), l -> l rlike '[^ \\\\t-\\\\r]')"
WINDOW = 5
WINDOWS = f"if(size({WORDS}) < {WINDOW}, array(), transform(sequence(0, size({WORDS}) - {WINDOW}), i -> xxhash64({', '.join(f'{WORDS}[i + {k}]' for k in range(WINDOW))})))"
#: Words covered by the windows whose hash occurs twice or more: neighbours in hash order give the windows, gaps in position order the cover.
REPEATED = f"""transform(array({WINDOWS}), h -> if(size(array_distinct(h)) = size(h), 0,
  transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
    transform(array(sort_array(transform(
        filter(s, (e, k) -> coalesce(if(k > 0, get(s, k - 1).h = e.h, false), false) or coalesce(get(s, k + 1).h = e.h, false)), e -> e.i))), p ->
      aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0, (a, b) -> a + b))[0])[0]))[0]"""


class Rule(NamedTuple):
    """reject: SQL over the marked text and word columns that is true where the rule rejects."""

    name: str
    reject: str


N_WORDS = f"size({WORDS})"
DUP_LINES = f"transform(array({LINES}), l -> size(l) - size(array_distinct(l)))[0]"
RULES = [
    Rule("few_words", f"{N_WORDS} < 10"),
    Rule("repeated_windows", f"100L * {REPEATED} > 20L * {N_WORDS}"),
    Rule("symbols", f"10 * {SYMBOLS} > {N_WORDS}"),
    Rule("word_length", f"{WORD_CHARS} < 2 * {N_WORDS} or {WORD_CHARS} > 15 * {N_WORDS}"),
    Rule("shouting", f"2 * {UPPER} > {WORD_CHARS}"),
    Rule("repeated_lines", f"transform(array({LINES}), l -> 2 * (size(l) - size(array_distinct(l))) > size(l))[0]"),
    Rule("ellipsis_lines", f"transform(array({LINES}), l -> 10 * size(filter(l, x -> x like '%...' or x like '%…')) > 3 * size(l))[0]"),
    Rule("bullet_lines", f"transform(array({LINES}), l -> 10 * size(filter(l, x -> substr(x, 1, 1) in ('-', '*', '•'))) > 9 * size(l))[0]"),
    Rule("wordless", f"10 * size(filter({WORDS}, x -> x rlike '\\\\p{{L}}')) < 5 * {N_WORDS}"),
    Rule("stutter", f"10 * size(filter({WORDS}, (x, i) -> i > 0 and x = {WORDS}[greatest(i - 1, 0)])) > 3 * {N_WORDS}"),
]


def over_words(sql: str) -> F.Column:
    """A Column for SQL over the marked text and the word array w."""
    return F.expr(f"transform(array({WORDS_SQL}), {WORDS} -> {sql})[0]")


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """docs as a struct column __fs_row beside its text, so that no column name of docs can meet a working one."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(f"{MARK}row"), docs[f"`{text_col}`"].cast("string").alias(f"{MARK}text"))


def estimate(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per row, share rejected) in cascade order, from about sample_rows rows of docs."""
    rules = sorted(RULES if rules is None else rules)
    text = docs[f"`{text_col}`"].cast("string")
    rows = docs.count()  # of a Parquet table, from its footers
    picked = docs.select(text.alias(f"{MARK}text")).where(text.isNull() | (F.octet_length(text) <= SAMPLE_BYTES)).sample(min(1.0, sample_rows / max(rows, 1)), 7)
    sample = stage(picked.coalesce(1), "rule-sample")
    timed = [Rule("", "false"), *rules]
    ticks = ", ".join(f"cast({CLOCK} as bigint), if({r.reject}, 1L, 0L)" for r in timed)
    runs = sample.select(over_words(f"transform(sequence(1, {REPEATS}), r -> array({ticks}, cast({CLOCK} as bigint)))").alias("t"))
    spent = [F.expr(f"array_min(transform(t, x -> x[{2 * k + 2}] - x[{2 * k}]))") for k in range(len(timed))]
    sums = [F.sum(c).alias(f"c{k}") for k, c in enumerate(spent)] + [F.sum(F.expr(f"t[0][{2 * k + 1}]")).alias(f"h{k}") for k in range(len(timed))]
    got = runs.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    discard(sample)
    n = max(got["n"], 1)
    found = [(r, max(1e-9, ((got[f"c{k}"] or 0) - (got["c0"] or 0)) / n * 1e-9), (got[f"h{k}"] or 0) / n) for k, r in enumerate(timed) if k]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(rules: list[Rule]) -> str:
    """SQL for the name of the first rule, in the given order, that rejects; null for a row that is kept."""
    return "case " + " ".join(f"when {r.reject} then '{r.name}'" for r in rules) + " end" if rules else "cast(null as string)"


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def judge(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with one more column, the last: `__fs_rejected_by` (with more underscores if docs has it), the first rule of the estimated order that rejects the row, or null."""
    order = [r for r, _, _ in estimate(docs, rules, text_col, sample_rows)]
    return _marked(docs, text_col).select(f"{MARK}row.*", over_words(cascade(order)).alias(_free(docs, f"{MARK}rejected_by")))


def keep(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    order = [r for r, _, _ in estimate(docs, rules, text_col, sample_rows)]
    return _marked(docs, text_col).where(over_words(cascade(order)).isNull()).select(f"{MARK}row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for all of documents.

    The two base rules read the counts that the result holds anyway; the other rules follow in the
    cascade's estimated order, for rows that the base keeps.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [r for r, _, _ in estimate(docs) if r.name not in ("few_words", "repeated_windows")]
    counts = {"n_words": N_WORDS, "word_chars": WORD_CHARS, "n_symbols": SYMBOLS, "n_dup_lines": DUP_LINES, "n_repeat_words": REPEATED}
    inner = f"named_struct('c', c, 'failed', c.n_words < 10 or 100 * c.n_repeat_words > 20 * c.n_words)"
    fields = ", ".join(f"'{name}', cast({sql} as bigint)" for name, sql in counts.items())
    order = [Rule(r.name, functools.reduce(lambda q, c: q.replace(c[1], f"b.c.{c[0]}"), counts.items(), r.reject)) for r in order]  # counts are there already
    verdict = f"transform(array(transform(array(named_struct({fields})), c -> {inner})[0]), b -> named_struct('c', b.c, 'failed', b.failed, 'kept', if(b.failed, false, ({cascade(order)}) is null)))[0]"
    judged = docs.select("doc_id", F.col("text").cast("string").alias(f"{MARK}text")).select("doc_id", over_words(verdict).alias("v"))
    return judged.select("doc_id", *[f"v.c.{name}" for name in counts], F.col("v.failed").alias("base_failed"), F.col("v.kept").alias("kept"))


_DUCK_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DUCK_BASE = f"""
base AS (
  SELECT *, list_filter(string_split(translate(t, {_DUCK_SPACES}, '     '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda l: trim(translate(l, {_DUCK_SPACES}, '     ')) <> '') AS l
  FROM (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS rid FROM {{source}})
),
pos AS (SELECT rid, w, unnest(range(0, len(w) - 4)) AS i FROM base WHERE len(w) >= 5),
win AS (SELECT rid, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM pos),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
counted AS (
  SELECT base.*, len(w)::BIGINT AS n_words, length(translate(t, {_DUCK_SPACES} || ' ', ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN cov USING (rid)
),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
     OR 2 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars
     OR 2 * n_dup_lines > len(l)
     OR 10 * len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) > 3 * len(l)
     OR 10 * len(list_filter(l, lambda x: left(x, 1) IN ('-', '*', '•'))) > 9 * len(l)
     OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{{{L}}}}'))) < 5 * n_words
     OR 10 * len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 3 * n_words) AS rejected
  FROM counted
)"""


def duck_judged(source: str) -> str:
    """The common table expressions up to `judged`, over a relation that has doc_id and text."""
    return _DUCK_BASE.format(source=source)


OP1_SQL = f"""WITH {duck_judged('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept FROM judged"""
