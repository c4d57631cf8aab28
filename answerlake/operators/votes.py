"""Vote analytics.

Counts and pivots are single aggregations with partial (map-side) combine;
the pivot lists its values so no extra job runs to discover them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.sources.inline import CANDIDATES, DISPLAY_NAMES, TIE


def vote_counts(votes: DataFrame, vote_col: str = "vote") -> DataFrame:
    """A1: rows per vote value; NULL votes are dropped (pandas default)."""
    return votes.filter(F.col(vote_col).isNotNull()).groupBy(vote_col).agg(F.count("*").alias("n"))


def vote_pivot(votes: DataFrame, category_col: str = "category", vote_col: str = "vote",
               values: Sequence[str] = tuple(CANDIDATES), total_col: str = "total") -> DataFrame:
    """A2-A5: category x vote counts as columns, missing combinations 0, row total."""
    p = (votes.filter(F.col(vote_col).isNotNull() & F.col(category_col).isNotNull())
         .groupBy(category_col).pivot(vote_col, list(values)).agg(F.count(F.lit(1)))
         .na.fill(0, subset=list(values)))
    return p.withColumn(total_col, sum((F.col(v) for v in values[1:]), F.col(values[0])))


def vote_percent(pivot: DataFrame, values: Sequence[str] = tuple(CANDIDATES),
                 total_col: str = "total", suffix: str = "_pct") -> DataFrame:
    """Row percentages x100, rounded half-even to 2 places; NULL for a row
    without any listed vote."""
    out = pivot
    for v in values:
        out = out.withColumn(v + suffix, F.bround(F.try_divide(F.lit(100.0) * F.col(v), F.col(total_col)), 2))
    return out


def total_label(col: str = "total") -> F.Column:
    """F16: ``f'{v:0.0f}'`` bar label."""
    return F.format_string("%.0f", F.col(col).cast("double"))


def percent_label(col: str) -> F.Column:
    """F16: ``f'{v:0.2f}%'`` bar label."""
    return F.format_string("%.2f%%", F.col(col).cast("double"))


def winner(a_votes: F.Column, b_votes: F.Column, a_name: str, b_name: str) -> F.Column:
    """The candidate with more votes, ``Tie`` otherwise (0-0 is a tie)."""
    return (F.when(a_votes > b_votes, F.lit(a_name))
            .when(b_votes > a_votes, F.lit(b_name))
            .otherwise(F.lit(TIE)))


def display_name(picked: F.Column, literal: bool = False) -> F.Column:
    """Display name of a pick; ``literal`` shows NULL as the second name."""
    first, second = CANDIDATES
    expr = F.when(picked == F.lit(first), F.lit(DISPLAY_NAMES[first]))
    if literal:
        return expr.otherwise(F.lit(DISPLAY_NAMES[second]))
    return expr.when(picked == F.lit(second), F.lit(DISPLAY_NAMES[second]))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key (one vote per question).

    ``row_number() = 1`` is planned with a per-partition group limit before the
    shuffle, so a key with very many rows sends only its local first rows.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
