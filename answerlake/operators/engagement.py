"""Engagement: milestones, badges, streaks, counters, quiz scores, sessions
(W2, G4-G9, A9, A10, O3-O5).

Milestones only ever look at the first events of a (user, kind), up to the
largest number any rule names, so the ranking window is filtered by that
number and Spark runs it as a group limit before the shuffle: a user with a
third of all events ships that many rows per map partition, not all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.sources.inline import CANDIDATES, EVENT_KINDS, STREAK_RULES, lit_map


def props_k(col: str = "props") -> F.Column:
    return F.get_json_object(F.col(col), "$.k").cast("bigint")


def engagement_events(events: DataFrame) -> DataFrame:
    """Tag test events with their engagement kind (fixed role mapping).

    Trivia answers carry the user's answer (parity of ``props.k``) and the
    answer key (parity of ``floor(value)``); a correct answer is an event of
    kind ``correct`` as well.
    """
    first, second = CANDIDATES
    k = props_k()
    ev = (events.select("event_id", "user_id", "ts", "event_type", "value", "props")
          .withColumn("kind", F.element_at(lit_map(EVENT_KINDS), F.col("event_type")))
          .filter(F.col("kind").isNotNull())
          .withColumn("k", k)
          .withColumn("answer", F.when(F.col("kind") == "quiz_answer",
                                       F.when(F.pmod(F.col("k"), F.lit(2)) == 0, F.lit(first))
                                       .otherwise(F.lit(second))))
          .withColumn("answer_key", F.when(F.col("kind") == "quiz_answer",
                                           F.when(F.pmod(F.floor("value"), F.lit(2)) == 0, F.lit(first))
                                           .otherwise(F.lit(second)))))
    return ev


def quiz_correct(answer: F.Column, key: F.Column) -> F.Column:
    """Case-insensitive match; a missing key is not counted."""
    return F.when(key.isNull(), F.lit(None)).otherwise(F.lower(answer) == F.lower(key))


def milestone_events(ev: DataFrame) -> DataFrame:
    """Events that count toward milestones: questions, votes, topic clicks and
    correct trivia answers (kind ``correct``)."""
    base = ev.filter(F.col("kind").isin("question", "vote", "topic_click")) \
        .select("user_id", "kind", "ts", "event_id")
    correct = (ev.filter((F.col("kind") == "quiz_answer")
                         & quiz_correct(F.col("answer"), F.col("answer_key")))
               .select("user_id", F.lit("correct").alias("kind"), "ts", "event_id"))
    return base.unionByName(correct)


def nth_events(ev: DataFrame, max_n: int, key: Sequence[str] = ("user_id", "kind"),
               order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Running number of each event within its (user, kind), first ``max_n``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return ev.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_n)


def milestones(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """The n-th event of a kind awards the rule's badge (once); ``rules``
    (kind, n, badge_id) is a small dimension table and sets how far to count."""
    top = rules.agg(F.max("n").alias("n")).first()["n"]
    nth = nth_events(ev, top or 0)
    return nth.join(F.broadcast(rules), ["kind", "n"])


def vote_days(votes: DataFrame) -> DataFrame:
    return votes.select("user_id", F.to_date("ts").alias("day")).distinct()


def streaks(days: DataFrame) -> DataFrame:
    """Runs of consecutive days per user (gaps and islands).

    The window runs over distinct (user, day) rows, i.e. at most one row per
    day of history per user.
    """
    w = Window.partitionBy("user_id").orderBy("day")
    isl = days.withColumn("_island", F.date_sub(F.col("day"), F.row_number().over(w)))
    return (isl.groupBy("user_id", "_island")
            .agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"),
                 F.count("*").alias("length"))
            .drop("_island"))


def streak_badges(runs: DataFrame) -> DataFrame:
    """Declared-only streak badges: a run of >= n days earns the badge."""
    rules = F.array(*[F.struct(F.lit(n).alias("days"), F.lit(b).alias("badge_id")) for n, b in STREAK_RULES])
    return (runs.select("user_id", "start_day", "length", F.explode(rules).alias("_r"))
            .filter(F.col("length") >= F.col("_r.days"))
            .select("user_id", F.col("_r.badge_id").alias("badge_id"),
                    F.date_add(F.col("start_day"), F.col("_r.days") - 1).alias("earned_day")))


def award_once(awards: DataFrame, order_col: str) -> DataFrame:
    """Idempotent award - earliest occurrence of each (user, badge)."""
    return awards.groupBy("user_id", "badge_id").agg(F.min(order_col).alias(order_col))


def latest_before(left: DataFrame, right: DataFrame, by: str, left_id: str,
                  order: Sequence[str] = ("ts", "event_id"), out: str = "matched_id",
                  bucket: F.Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """As-of match: for each ``right`` row, the id of the latest ``left`` row of
    the same ``by`` key at or before it (``NULL`` when none).  Columns of
    ``right`` named in ``carry`` come along.

    Two levels so that a key with a huge share of the rows is still split:
    (1) inside each (key, time bucket) a running ``last`` over the bucket's
    rows; (2) rows with no match in their bucket take the last left row of
    the latest earlier bucket, found on a per-bucket summary (one row per
    key and bucket that has left rows).  ``bucket`` defaults to the hour of
    the first ordering column (which must then be a timestamp).
    """
    first = order[0]
    bkt = bucket if bucket is not None else F.date_trunc("hour", F.col(first))
    cols = [by, *order]
    types = {f.name: f.dataType for f in right.schema.fields}
    l = left.select(*cols, F.col(left_id).alias("_lid"), F.lit(0).alias("_side"),
                    *[F.lit(None).cast(types[c]).alias(c) for c in carry])
    r = right.select(*cols, F.lit(None).cast("bigint").alias("_lid"), F.lit(1).alias("_side"), *carry)
    both = l.unionByName(r).withColumn("_bkt", bkt)
    w = (Window.partitionBy(by, "_bkt").orderBy(*order, "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = both.withColumn("_in", F.last("_lid", ignorenulls=True).over(w))
    rb = inner.filter(F.col("_side") == 1)
    # Carry-over for rows unmatched inside their bucket: one summary row per
    # (key, bucket) with left rows holding its last left id, plus one row per
    # (key, bucket) that needs a carry; a running ``last`` over this bucket
    # sequence (one row per bucket, not per event) gives the latest earlier
    # bucket's last left id.  Needs sort before summaries of the same bucket.
    summary = (l.withColumn("_bkt", bkt).groupBy(by, "_bkt")
               .agg(F.max_by("_lid", F.struct(*order)).alias("_last")).withColumn("_o", F.lit(1)))
    need = (rb.filter(F.col("_in").isNull()).select(by, "_bkt").distinct()
            .select(by, "_bkt", F.lit(None).cast("bigint").alias("_last"), F.lit(0).alias("_o")))
    wb = Window.partitionBy(by).orderBy("_bkt", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = (summary.unionByName(need).withColumn("_prev", F.last("_last", ignorenulls=True).over(wb))
            .filter(F.col("_o") == 0).select(by, "_bkt", "_prev"))
    out_df = rb.join(prev, [by, "_bkt"], "left").withColumn(out, F.coalesce("_in", "_prev"))
    return out_df.drop("_lid", "_side", "_bkt", "_in", "_prev")


def hash_order(seed: str, id_col: str) -> F.Column:
    """Reproducible shuffle key: md5 of seed and id (O3)."""
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def slot_a_candidate(id_col: str) -> F.Column:
    """Blind mapping of a question, drawn from the hash of its id.

    Slot A gets the first candidate when the last hex digit of md5(id) is even.
    """
    first, second = CANDIDATES
    last = F.substring(F.md5(F.col(id_col).cast("string")), 32, 1)
    return F.when(last.isin(*"02468ace"), F.lit(first)).otherwise(F.lit(second))


def blind_assignment(questions: DataFrame, id_col: str) -> DataFrame:
    """O4 + J5: two rows per question, ``slot`` A/B -> ``candidate``."""
    first, second = CANDIDATES
    a = slot_a_candidate(id_col)
    b = F.when(a == F.lit(first), F.lit(second)).otherwise(F.lit(first))
    return questions.select(id_col, F.explode(F.array(
        F.struct(F.lit("A").alias("slot"), a.alias("candidate")),
        F.struct(F.lit("B").alias("slot"), b.alias("candidate")))).alias("_s")) \
        .select(id_col, "_s.slot", "_s.candidate")


def sample_n(df: DataFrame, n: int, seed: str, id_col: str) -> DataFrame:
    """``n`` rows in a reproducible random order (a top-n sort)."""
    return df.withColumn("_h", hash_order(seed, id_col)).orderBy("_h", id_col).limit(n).drop("_h")
