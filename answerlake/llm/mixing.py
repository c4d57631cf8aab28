"""Mixing sources to target weights.

Every source gets a share of the mix by weight, at most ``MAX_EPOCHS`` times
its size; what that cuts off goes to the others by weight until none is above.
Documents get hash-random keys and are sorted by them within their source; a
distributed prefix sum over their sizes cuts each source at its exact budget.
A target above the source's size repeats it: whole epochs first, then the cut.

The prefix sum has three levels, so that no task sorts a whole source: keys
fall into ranges of about ``RANGE_ROWS`` rows, ranges into spans of ranges.
A key hashes the id, the text and the number of the row among its full repeats
in the source. Repeats are numbered part by part, with one offset a part, so
neither rows without an id nor a third of all rows being one text meet in a
range, and the set of keys is the same however the rows are divided.
Sources are one row each in ``targets``, whose window sorts them in one task:
that bounds them to what a task sorts, tens of millions.

Null texts have size 0 and are taken with 0 words. A null source is a source
of its own, the last one. Repeated rows count each, ties among them are
settled by their numbers. Very long texts are counted and hashed whole. The
columns added win over clashing ones. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.llm import common

WEIGHTS = (5, 2, 1)
#: Size of the mix as a share of all sizes, in percent, and the most often a source is repeated.
MIX_PERCENT, MAX_EPOCHS = 150, 2
#: Documents of a key range, and key ranges of a span, on average.
RANGE_ROWS, SPAN_RANGES = 128, 128


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) for sources (source, source_size, n), one row each.

    target = least(cap, level * weight). Sources in the order of cap / weight
    reach their caps first; the level is what is left after these, shared by
    the weights of the others. Sums are whole numbers, so reruns agree to the bit.
    """
    everywhere = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * MAX_EPOCHS).alias("cap"))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everywhere) * MIX_PERCENT
    rest = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", (budget - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (100 * rest))
    # Capped sources come first. The first open one's level holds for all open ones; the numbers after it only fall.
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    s = s.withColumn("open_level", F.max(F.when(~capped, F.col("level"))).over(everywhere))
    return s.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def keyed(rows: DataFrame) -> DataFrame:
    """Replace ``content`` by ``key``: a hash of it and of the row's number among the repeats in its source."""
    rows = rows.withColumn("part", F.shiftright("uid", 33))
    by_content = W.partitionBy("source", "content")
    counts = rows.groupBy("source", "content", "part").agg(F.count("*").alias("n"))
    counts = counts.select("*", F.sum("n").over(by_content).alias("all"), F.coalesce(F.sum("n").over(by_content.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = common.stored(counts.filter(F.col("all") > 1).select(F.col("source").alias("o_source"), F.col("content").alias("o_content"), F.col("part").alias("o_part"), "before"), "mix-repeats")
    same = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("content") == F.col("o_content")) & (F.col("part") == F.col("o_part"))
    single = rows.join(offsets, same, "left_anti").withColumn("number", F.lit(0).cast("long"))
    local = F.row_number().over(W.partitionBy("source", "content", "part").orderBy("uid")) - 1
    repeats = rows.join(offsets, same).withColumn("number", (F.col("before") + local).cast("long")).drop("before", "o_source", "o_content", "o_part")
    return single.unionByName(repeats).select("uid", "source", "size", "id", F.md5(F.concat_ws(":", "content", "number")).alias("key"))


def mix(docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", keep: list[str] | None = None,
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The kept columns with size, source_size, target and taken (words)."""
    common.ready(docs.sparkSession)
    new = {"size", "source_size", "target", "taken"}
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    size = F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(common.WORD)), F.lit(0)).cast("long")
    ident = F.col(f"`{id_column}`").cast("string")
    content = F.md5(F.concat(F.coalesce(ident, F.lit("")), F.lit("\0"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{source_column}`").cast("string").alias("source"),
                       size.alias("size"), ident.alias("id"), content.alias("content"))
    # Written once, so that the row numbers stay what they are; the rows themselves move only in the last join.
    whole = common.stored(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    rows = common.stored(keyed(whole.select("uid", "source", "size", "id", "content")), "mix-keys")
    sources = common.stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights), "mix-sources")
    plan = sources.select(F.col("source").alias("s_source"), "source_size", "target", F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    # 48 bits of the key as a fraction of all keys: ranges of equal width have about equal rows.
    fraction = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    placed = placed.withColumn("range", F.floor(fraction * F.col("ranges"))).withColumn("span", F.floor(F.col("range") / SPAN_RANGES))
    sums = common.stored(placed.groupBy("source", "span", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    earlier = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    base = lambda w: F.coalesce(F.sum("words").over(w), F.lit(0)).cast("long")
    spans = sums.groupBy("source", "span").agg(F.sum("words").alias("words")).select(
        F.col("source").alias("p_source"), F.col("span").alias("p_span"), base(earlier(["source"], "span")).alias("span_base"))
    ranges = sums.select(F.col("source").alias("r_source"), F.col("span").alias("r_span"), F.col("range").alias("r_range"),
                         base(earlier(["source", "span"], "range")).alias("range_base"))
    offsets = common.stored(ranges.join(spans, F.col("r_source").eqNullSafe(F.col("p_source")) & (F.col("r_span") == F.col("p_span")))
                            .select("r_source", "r_range", (F.col("span_base") + F.col("range_base")).alias("range_base")), "mix-offsets")
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    inner = W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("range_base") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    cut = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    taken = common.stored(placed.select("uid", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken")), "mix-taken")
    # The same plan at every size: rows are shuffled once and not sorted, only the numbers are hashed.
    return whole.select("uid", "row", "size").join(taken.hint("shuffle_hash"), "uid").select("row.*", "size", "source_size", "target", "taken")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir, "doc_id", "text", "source"), keep=["doc_id"])


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, content,
    row_number() OVER (PARTITION BY source, content) - 1 AS number
  FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(0) || coalesce(text, '')) AS content FROM documents)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT 0 AS i, source, source_size, weight, false AS capped FROM s
  UNION ALL
  SELECT i + 1, source, source_size, weight, capped OR coalesce(2 * source_size <= level * weight, false)
  FROM (SELECT *, CAST(150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0) AS DOUBLE)
                  / CAST(100 * sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) AS level FROM r)
  WHERE i < (SELECT count(*) FROM s)),
f AS (SELECT * FROM r WHERE i = (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0) AS DOUBLE)
         / CAST(100 * sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) * weight END AS target
  FROM f),
p AS (
  SELECT doc_id, size, t.source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(content || ':' || CAST(number AS VARCHAR)), CAST(doc_id AS VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
    + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
FROM p
"""
