"""Quality rules with weak supervision: rules vote, EM weighs them.

Every rule looks at counts of one document and votes good (1), bad (-1) or
abstains (0). Over the whole table, documents with the same votes are one
pattern; expectation-maximisation on the pattern counts estimates, without
labels, how often each rule is right on good and on bad documents. A
document's posterior probability of being good replaces an all-must-pass
filter. Only DataFrame functions run: the counts are expressions within the
row, the pattern table has at most 3^rules rows, and the EM is a fold over it.

A large group of documents that trip one rule alone must not turn the model
over: patterns count distinct texts that pass the base check, a bad vote that
stands alone says nothing about its rule, and accuracies and the prior stay at
``FLOOR`` or above. On tables without such a group this keeps the same rows as
the plain EM, which the SQL states.

Null and empty texts have no words, every count is 0 and they fail the base
check. Texts of any length, very long ones too, are handled whole, within their
row. Repeated rows are judged alike. Ties: a posterior at the bound is kept.
The columns added win over clashing ones. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import common
from answerlake.llm.common import let

#: Words of a window that counts as a repeat when found twice.
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ITERATIONS = 30
#: Starting values, and imaginary documents that carry them, as a share of all.
ACCURACY, PRIOR, PRIOR_SHARE = 0.8, 0.8, 0.02
#: A document stays from this posterior probability on.
THRESHOLD = 0.5
#: No rule counts as wrong more often than right, and no table as mostly bad.
FLOOR = 0.5


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str = "false"

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


#: Conditions on the counts of ``counts``.
RULES = (
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("symbol_words", "100 * n_symbol_words > 20 * n_words"),
    Rule("symbol_runs", "100 * n_symbol_runs > 20 * n_words"),
    Rule("capitals", "100 * n_upper > 30 * word_chars"),
    Rule("shouting", "100 * n_bangs > 10 * n_words"),
    Rule("lines", "n_dup_lines >= 2 AND 100 * n_dup_lines > 20 * n_lines"),
    Rule("repeats", "100 * n_repeat_words > 15 * n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule("prose", "n_words >= 50 AND 100 * n_ends < n_words",
         "100 * n_ends >= 3 * n_words AND 100 * n_symbols <= word_chars AND 100 * n_upper <= 15 * word_chars"),
)


def _repeated(words: Column) -> Column:
    """Words within windows that are found twice or more, the first time included."""
    k = REPEAT_WINDOW

    def covered(hashes: Column) -> Column:
        def marked(by_hash: Column) -> Column:
            same = lambda e, i: F.get(by_hash, i)["h"].eqNullSafe(e["h"])
            starts = F.sort_array(F.transform(F.filter(by_hash, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(by_hash, marked))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) < 2, 0).when(F.size(words) <= k, 0).otherwise(let(hashes, covered))


def counts(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One struct ``c`` of all counts beside the kept columns: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_upper, n_bangs, n_ends, n_symbol_words (ending in a symbol), n_symbol_runs
    (one symbol twice or more, or a bar before a blank)."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    number = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    words = let(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)),
                lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD)),
                lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], F.struct(
        words.alias("w"), lines.alias("l"), (F.length(text) - number(f"[{common.BLANK}]")).cast("long").alias("word_chars"),
        number(r"[#*$%&|<>]").alias("n_symbols"), number(rf"[#*$%&|<>]++(?![^{common.BLANK}])").alias("n_symbol_words"),
        number(rf"([#*$%&])\1++|\|[{common.BLANK}]").alias("n_symbol_runs"), number(r"\p{Lu}").alias("n_upper"), number("!").alias("n_bangs"),
        number(rf"[.!?](?:[{common.BLANK}]|$)").alias("n_ends")).alias("_c"))
    flat = ["_c.w.n AS n_words", "_c.word_chars AS word_chars", "_c.n_symbols AS n_symbols", "_c.n_symbol_words AS n_symbol_words",
            "_c.n_symbol_runs AS n_symbol_runs", "_c.l.d AS n_dup_lines",
            "_c.w.r AS n_repeat_words", "_c.l.n AS n_lines", "_c.n_upper AS n_upper", "_c.n_bangs AS n_bangs", "_c.n_ends AS n_ends"]
    return out.withColumn("_c", F.struct(*[F.expr(x) for x in flat]))


def _votes(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[r.vote() for r in rules])


def _logit(state: Column, votes: Column, m: int) -> Column:
    """Log odds of good: the prior's, and each vote's by the accuracy of its rule."""
    def step(acc: Column, j: Column) -> Column:
        right = state["accuracy"][j]
        return acc + votes[j] * F.log(right / (1 - right))
    return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.log(state["prior"] / (1 - state["prior"])), step)


def posteriors(patterns: DataFrame, m: int, iterations: int = ITERATIONS, guarded: bool = False) -> DataFrame:
    """(votes, posterior, prior, accuracy) for each pattern (votes, n).

    ``accuracy[j]`` is how often rule j is right where it votes; abstentions
    say nothing. It starts at ``ACCURACY``, the share of good documents at
    ``PRIOR``; every estimate carries imaginary documents of the starting kind,
    as many as ``PRIOR_SHARE`` of all, so that no rule is trusted without limit.
    If ``guarded``, lone bad votes are left out of the accuracies, since nothing
    else in their documents confirms or denies them, and ``FLOOR`` holds.
    """
    at_least = (lambda c: F.greatest(c, F.lit(FLOOR))) if guarded else (lambda c: c)
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array(*[F.lit(ACCURACY)] * m).alias("accuracy"))
    rules = F.sequence(F.lit(0), F.lit(m - 1))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("ps", lambda p: F.struct(
            p["votes"].alias("v"), (p["n"] / (1 + F.exp(-_logit(state, p["votes"], m)))).alias("g"), p["n"].alias("n"), p["lone"].alias("lone")))

        def estimate(ps: Column) -> Column:
            def total(value):
                return F.aggregate(ps, F.lit(0.0), lambda a, p: a + value(p))
            held = F.col("held")
            accuracy = F.transform(rules, lambda j: at_least((
                total(lambda p: F.when(p["lone"], 0.0).when(p["v"][j] == 1, p["g"]).when(p["v"][j] == -1, p["n"] - p["g"]).otherwise(0.0)) + ACCURACY * held)
                / (total(lambda p: F.when(~p["lone"] & (p["v"][j] != 0), p["n"]).otherwise(0.0)) + held)))
            prior = at_least((total(lambda p: p["g"]) + PRIOR * held) / (total(lambda p: p["n"]) + held))
            return F.struct(prior.alias("prior"), accuracy.alias("accuracy"))

        return let(weighed, estimate)

    cast = F.filter("votes", lambda v: v != 0)
    lone = (F.size(cast) == 1) & (F.get(cast, F.lit(0)) == -1) if guarded else F.lit(False)
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"), lone.alias("lone")))).alias("ps"),
                       (F.sum("n") * PRIOR_SHARE + 1).alias("held"))
    fitted = one.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("state"))
    rows = fitted.select(F.explode("ps").alias("p"), "state")
    return rows.select("p.votes", (1 / (1 + F.exp(-_logit(F.col("state"), F.col("p.votes"), m)))).alias("posterior"), "state.*")


def judge(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES,
          threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, a struct ``counts``, base_failed, posterior and kept.

    Counts and votes are written to the shared folder with the kept columns,
    so that the texts are read once; a hash of the text tells copies apart.
    """
    common.ready(docs.sparkSession)
    columns = docs.columns if keep is None else keep
    given = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], F.md5(F.col(f"`{text_column}`")).alias("_text"))
    counted = counts(given, f"in_{text_column}", [*[f"in_{c}" for c in columns], "_text"])
    failed = (F.col("_c.n_words") < MIN_WORDS) | (100 * F.col("_c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_c.n_words"))
    voted = counted.select("*", "_c.*").withColumn("votes", _votes(rules)).select(*[f"`in_{c}`" for c in columns], "_c", "votes", "_text", failed.alias("failed"))
    seen = common.stored(voted, "quality-votes")
    # Equal texts have equal votes. Patterns of none but failed texts stay, with a count of 0.
    texts = seen.groupBy("votes", "_text", "failed").agg(F.lit(1).alias("one"))
    patterns = texts.groupBy("votes").agg(F.count_if(~F.col("failed")).alias("n"))
    fitted = common.stored(posteriors(patterns, len(rules), guarded=True).select("votes", "posterior"), "quality-posteriors")
    out = seen.join(F.broadcast(fitted), "votes")
    new = {"counts", "base_failed", "posterior", "kept"}
    return out.select(*[F.col(f"`in_{c}`").alias(c) for c in columns if c.lower() not in new], F.col("_c").alias("counts"),
                      F.col("failed").alias("base_failed"), "posterior", (~F.col("failed") & (F.col("posterior") >= threshold)).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "counts.n_words", "counts.word_chars", "counts.n_symbols", "counts.n_dup_lines", "counts.n_repeat_words",
                      "base_failed", "kept")


def _op1_sql() -> str:
    """The same rows in DuckDB: counts from words and lines laid out as rows, EM as a recursion over the pattern table."""
    m = len(RULES)
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"v[{j}] * ln(a[{j}] / (1 - a[{j}]))" for j in range(1, m + 1))])
    right = ", ".join(f"(sum(CASE v[{j}] WHEN 1 THEN n * g WHEN -1 THEN n * (1 - g) ELSE 0 END) + {ACCURACY} * any_value(held))"
                      f" / (sum(CASE WHEN v[{j}] <> 0 THEN n ELSE 0 END) + any_value(held))" for j in range(1, m + 1))
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in RULES)
    leads = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER x" for k in range(1, REPEAT_WINDOW))])
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
g AS (SELECT r, p, {leads} AS g FROM u WINDOW x AS (PARTITION BY r ORDER BY p)),
again AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS times FROM g WHERE g IS NOT NULL),
cov AS (SELECT r, count(DISTINCT p + o) AS n FROM again, unnest(range({REPEAT_WINDOW})) AS q(o) WHERE times > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.r, doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.d, 0) AS n_dup_lines, coalesce(dup.n, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '[#*$%&|<>]+(?:[\x20\x09-\x0D]|$)')) AS n_symbol_words, len(regexp_extract_all(t, '[*][*]+|[#][#]+|[$][$]+|[%][%]+|[&][&]+|[|][\x20\x09-\x0D]')) AS n_symbol_runs,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_bangs, len(regexp_extract_all(t, '[.!?](?:[\x20\x09-\x0D]|$)')) AS n_ends
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
v AS (SELECT *, [{votes}] AS v FROM c),
ps AS (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY v),
h AS (SELECT sum(n) * {PRIOR_SHARE} + 1 AS held FROM ps),
em AS (
  SELECT 0 AS i, CAST({PRIOR} AS DOUBLE) AS prior, [CAST({ACCURACY} AS DOUBLE) FOR x IN range({m})] AS a
  UNION ALL
  SELECT i + 1, (sum(n * g) + {PRIOR} * any_value(held)) / (sum(n) + any_value(held)), [{right}]
  FROM (SELECT i, v, n, held, 1 / (1 + exp(-({odds}))) AS g FROM em, ps, h WHERE i < {ITERATIONS}) GROUP BY i),
post AS (SELECT v, 1 / (1 + exp(-({odds}))) AS posterior FROM ps, em WHERE i = {ITERATIONS})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND posterior >= {THRESHOLD} AS kept
FROM v JOIN post USING (v)
"""


OP1_SQL = _op1_sql()
