"""From raw documents to a training mix: five stages, each written and read again by the next.

Quality rules reject junk; of each group of near duplicates one document
stays; benchmark passages are cut out; personal data is masked; sources are
mixed to their target weights. Nulls, empty texts, ties, repeated rows, empty
tables and clashing column names are handled as each operator says; an empty
table gives an empty mix. All stages but the last return the columns of their
input, in its order; ``n_chars`` follows the text where a stage changes it.

No SQL states the whole: the quality rules are weighed by expectation-
maximisation and the fingerprints need XXH64, so ORACLE_SQL is None and the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import common, decontaminate, mixing, pii, quality, simhash
from answerlake.session import shared_path

ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under names that clash with nothing, and where each name went (the first of equal ones)."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(reversed(list(zip(docs.columns, names))))


def _named(df: DataFrame, docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; n_chars is counted anew where the text has ``changed``."""
    text = f"in_{docs.columns.index('text')}"
    out = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"in_{i}")
        if changed is not None and c == "n_chars":
            value = F.when(changed, F.length(text).cast(docs.schema[i].dataType)).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    rows, at = _numbered(docs)
    return _named(quality.judge(rows, at["text"]).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints: the one with the smallest id, null ids last."""
    rows, at = _numbered(docs)
    # Written once, so that the row numbers stay what they are.
    rows = common.stored(simhash.with_fingerprint(rows, at["text"]).withColumn("uid", F.monotonically_increasing_id()), "pipeline-prints")
    grouped = simhash.near_duplicates(rows.select("fp", F.col(at["doc_id"]).alias("doc_id"), "uid"))
    # A group has the smallest id as its name; where no row has an id, the fingerprint names it.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp"))]
    kept = common.stored(grouped.groupBy(*group).agg(F.min(order).alias("first")).select("first.uid"), "pipeline-kept")
    # The same plan at every size: texts are shuffled once and not sorted, only the numbers are hashed.
    return _named(rows.join(kept.hint("shuffle_hash"), "uid", "left_semi"), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    rows, at = _numbered(docs)
    out = decontaminate.remove_leaks(rows, common.table(spark, sf_dir, "benchmark"), at["text"])
    return _named(out, docs, F.col("leak_cut"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked."""
    rows, at = _numbered(docs)
    return _named(pii.mask_pii(rows, at["text"]), docs, F.col("masked"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, source_size, target and taken; untaken ones go."""
    return mixing.mix(docs).filter("taken > 0")


_own_tables: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``work``, after deleting what earlier stages stored for themselves: their results are written by now."""
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.ready(spark)
        common.release(spark, _own_tables)
        with common.stored_here(_own_tables):
            return work(spark, docs, sf_dir)
    return stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", _stage(quality_rules)),
    ("SimHash near-dedup", _stage(near_duplicates)),
    ("benchmark decontamination", _stage(benchmark_leaks)),
    ("PII", _stage(personal_data)),
    ("mixing sources to target weights", _stage(mixture)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder; only the last one stays there."""
    docs, before = common.documents(common.ready(spark), sf_dir), []
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.release(spark, before)
        common.release(spark, _own_tables)
        before = [path]
    return docs
