"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

The model learns from a small table of labelled urls. Its weights are a
combination of the labelled examples' feature vectors, so gradient descent
runs on one number for each example: a fold over a one-row table. Pages are
scored by joining their n-grams, once for each distinct host and path, to the
weights (at most ``DIMENSIONS`` rows, broadcast). Only DataFrame functions run.

A null url, or one without "://", has empty host and path, fits no rule and is
judged by the model on no features. Urls of any length, very long ones too, are
judged whole. Ties: of rules of one length the first listed wins, a probability
of exactly one half blocks. The columns added win over clashing ones. Repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import common

DIMENSIONS = 1 << 14
GRAMS = (3, 4)
STEPS, RATE, PENALTY = 500, 8.0, 0.0005

#: (verdict, host, path) of the fixed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Hosts and paths of the training urls: unwanted and wanted ones. Each host goes with each path of its kind, in turn.
BLOCKED_HOSTS = ("cheap-pills.test", "casino-win.test", "free-bets.test", "spam-farm.test", "ads-track.test", "adult-x.test", "best-casino.test",
                 "pills-online.test", "xxx-adult.test", "win-bets.test", "track-ads.test", "spam-links.test", "free-casino-bonus.test", "viagra-pills.test")
BLOCKED_PATHS = ("/win/free-bonus", "/click?track=1", "/ads/banner", "/buy-cheap", "/en/12", "/")
ALLOWED_HOSTS = ("library.test", "news.test", "weather.test", "museum.test", "university.test", "science.test", "blog.garden.test", "www.history.test",
                 "m.recipes.test", "docs.software.test", "travel.test", "theatre.test", "thother.test", "tionsh.test", "therand.test", "blog.ththe.test")
ALLOWED_PATHS = ("/articles/2020/spring", "/en/12", "/de/345.html", "/about", "/docs/manual/page", "/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 blocked, 0 allowed; a fixed table of about 90 rows."""
    table = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in _training_rows()])
    return spark.range(1).select(F.explode(table).alias("r")).select("r.*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = common.lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def bucket(kind: str, gram: Column) -> Column:
    """Feature number of an n-gram: 32 bits of the MD5 of its kind and text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(kind), gram)), 1, 8), 16, 10).cast("long") % DIMENSIONS


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of all n-grams of the host, marked at both ends, and of the path."""
    def grams(kind: str, text: Column) -> Column:
        def runs(chars: Column, n: int) -> Column:
            part = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: bucket(kind, F.array_join(F.slice(chars, i, n), "")))
            return F.when(F.size(chars) >= n, part).otherwise(F.array().cast("array<bigint>"))
        return common.let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda chars: F.concat(*[runs(chars, n) for n in GRAMS]))
    marked = F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise(F.lit(""))
    return F.array_distinct(F.concat(grams("host", marked), grams("path", path)))


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[DataFrame, DataFrame]:
    """Weights (bucket, weight) and the bias (one row) of a small labelled table (url, label)."""
    host, path = host_and_path(F.col("url"))
    examples = labelled.select(F.col("label").cast("double").alias("y"), features(host, path).alias("f")).filter("size(f) > 0")
    one = examples.agg(F.sort_array(F.collect_list(F.struct("y", "f"))).alias("es"))
    dot = lambda a, b: F.size(F.array_intersect(a["f"], b["f"])) / F.sqrt(F.size(a["f"]).cast("double") * F.size(b["f"]))
    one = one.select("es", F.transform("es", lambda a: F.transform("es", lambda b: dot(a, b))).alias("k"),
                     F.transform("es", lambda e: e["y"]).alias("y"), F.size("es").cast("double").alias("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, _: Column) -> Column:
        margins = F.transform("k", lambda row: total(F.zip_with(row, state["a"], lambda x, a: x * a)) + state["b"])
        errors = F.zip_with(margins, "y", lambda m, y: 1 / (1 + F.exp(-m)) - y)
        return common.let(errors, lambda e: F.struct(
            F.zip_with(state["a"], e, lambda a, x: a * (1 - rate * penalty) - rate * x / F.col("n")).alias("a"),
            (state["b"] - rate * total(e) / F.col("n")).alias("b")))

    start = F.struct(F.transform("y", lambda y: y * 0.0).alias("a"), F.lit(0.0).alias("b"))
    fitted = common.stored(one.select("es", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("m")), "url-model")
    each = fitted.select(F.explode(F.arrays_zip("es.f", F.col("m.a").alias("a"))).alias("e")).select("e.f", "e.a")
    weights = each.select(F.explode("f").alias("bucket"), (F.col("a") / F.sqrt(F.size("f"))).alias("w")).groupBy("bucket").agg(F.sum("w").alias("weight"))
    return common.stored(weights, "url-weights"), fitted.select("m.b")


def best_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null where none does."""
    out = None
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        struct = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, struct) if out is None else out.when(fits, struct)
    return out


def judge(pages: DataFrame, url_column: str = "url", labelled: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with host, path, rule, verdict and block_probability (null where a rule decides)."""
    spark = common.ready(pages.sparkSession)
    weights, bias = train(labelled_urls(spark) if labelled is None else labelled)
    b = bias.first()["b"]
    new = {"host", "path", "rule", "verdict", "block_probability"}
    columns = [c for c in (pages.columns if keep is None else keep) if c.lower() not in new]
    host, path = host_and_path(F.col(f"`{url_column}`"))
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), host.alias("host"), path.alias("path")).withColumn("r", best_rule(F.col("host"), F.col("path")))
    # The model is asked once for each host and path that no rule decides.
    open_ = split.filter("r IS NULL").select("host", "path").distinct().select("host", "path", features(F.col("host"), F.col("path")).alias("f"))
    grams = open_.select("host", "path", F.size("f").alias("n"), F.explode_outer("f").alias("bucket"))
    sums = grams.join(F.broadcast(weights), "bucket", "left").groupBy("host", "path").agg(
        F.coalesce(F.sum("weight") / F.sqrt(F.first("n").cast("double")), F.lit(0.0)).alias("margin"))
    scored = common.stored(sums.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), (1 / (1 + F.exp(-(F.col("margin") + b)))).alias("p")), "url-scores")
    both = split.join(scored, F.col("r").isNull() & (F.col("host") == F.col("s_host")) & (F.col("path") == F.col("s_path")), "left")
    verdict = F.coalesce("r.verdict", F.when(F.col("p") >= 0.5, "block").otherwise("allow"))
    return both.select("row.*", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("r").isNull(), F.col("p")).alias("block_probability"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "pages", "page_id", "url"), keep=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict")


def _training_rows() -> list[tuple[str, int]]:
    out = []
    for hosts, paths, label in ((BLOCKED_HOSTS, BLOCKED_PATHS, 1), (ALLOWED_HOSTS, ALLOWED_PATHS, 0)):
        out += [(f"https://{h}{paths[(i + k) % 6]}", label) for i, h in enumerate(hosts) for k in (0, 1, 3)]
    return out


def _op10_sql() -> str:
    """The same rows in DuckDB: training as a recursion over the labelled urls."""
    def split(url: str) -> tuple[str, str]:
        rest = f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://(.*)$', 1)"
        lower = f"translate(regexp_extract({rest}, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return lower, f"regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1)"

    def grams(kind: str, text: str) -> str:
        one = lambda n: f"[CAST('0x' || md5('{kind}' || substr({text}, i, {n}))[1:8] AS BIGINT) % {DIMENSIONS} FOR i IN range(1, length({text}) - {n} + 2)]"
        return " || ".join(one(n) for n in GRAMS)

    features_of = f"list_distinct({grams('host', 'marked')} || {grams('path', 'path')})"
    marked = "CASE WHEN host <> '' THEN '^' || host || '$' ELSE '' END AS marked"
    rows = ", ".join(f"({i}, '{u}', {y})" for i, (u, y) in enumerate(_training_rows(), 1))
    (l_host, l_path), (p_host, p_path) = split("u"), split("url")
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p} {v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"""
WITH RECURSIVE lab0 AS (SELECT i, y, {l_host} AS host, {l_path} AS path FROM (VALUES {rows}) AS t(i, u, y)),
lab AS MATERIALIZED (SELECT i, y, {features_of} AS f FROM (SELECT *, {marked} FROM lab0)),
k AS MATERIALIZED (SELECT a.i, a.y, list(len(list_intersect(a.f, b.f)) / sqrt(CAST(len(a.f) AS DOUBLE) * len(b.f)) ORDER BY b.i) AS row FROM lab a, lab b GROUP BY a.i, a.y),
gd AS (
  SELECT 0 AS step, [CAST(0 AS DOUBLE) FOR x IN range({len(_training_rows())})] AS a, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT step + 1, list(a[i] * (1 - {RATE * PENALTY!r}) - {RATE!r} * e / n ORDER BY i), any_value(b) - {RATE!r} * sum(e) / any_value(n)
  FROM (SELECT step, a, b, k.i, {len(_training_rows())} AS n, 1 / (1 + exp(-(list_dot_product(k.row, a) + b))) - y AS e FROM gd, k WHERE step < {STEPS}) GROUP BY step),
model AS (SELECT a, b FROM gd WHERE step = {STEPS}),
w AS (SELECT bucket, sum(v) AS weight FROM (SELECT unnest(f) AS bucket, model.a[i] / sqrt(len(f)) AS v FROM lab, model) GROUP BY bucket),
p AS (SELECT page_id, {p_host} AS host, {p_path} AS path FROM pages),
ruled AS (SELECT *, CASE {rules} END AS hit FROM p),
open AS (SELECT host, path, {features_of} AS f FROM (SELECT DISTINCT host, path, {marked} FROM ruled WHERE hit IS NULL)),
s AS (SELECT host, path, sum(weight) AS total FROM (SELECT host, path, unnest(f) AS bucket FROM open) LEFT JOIN w USING (bucket) GROUP BY host, path)
SELECT page_id, ruled.host, ruled.path, string_split(hit, ' ')[1] AS rule,
  CASE WHEN hit IS NOT NULL THEN string_split(hit, ' ')[2]
       WHEN 1 / (1 + exp(-(coalesce(s.total / sqrt(len(open.f)), 0) + (SELECT b FROM model)))) >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN open ON hit IS NULL AND open.host = ruled.host AND open.path = ruled.path LEFT JOIN s ON s.host = open.host AND s.path = open.path
"""


OP10_SQL = _op10_sql()
