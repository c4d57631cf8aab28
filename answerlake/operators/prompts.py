"""Context assembly, prompt budgeting and per-candidate prompts
(A13, F4-F6, C5, P15, J8).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.functions.payloads import (ANSWER_SUFFIX, CONTEXT_PREFIX, QUESTION_PREFIX, join_contexts,
                                           prompt, question_suffix)
from answerlake.functions.text import token_count, truncate_tokens
from answerlake.operators.retrieval import NO_HIT_FILENAME, NO_HIT_RESPONSE

PROMPT_BUDGET = 2000


def collect_contexts(hits: DataFrame, q_key: str, order: Sequence[str], text_col: str = "text",
                     file_col: str = "filename") -> DataFrame:
    """Per question, the retrieved texts and their files in ``order``.

    Only for bounded hit lists (see ``budgeted_contexts``): it collects one
    array per question.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(text_col).alias("_text"), F.col(file_col).alias("_file"))
    agg = hits.groupBy(q_key).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return agg.select(q_key,
                      F.transform("_items", lambda x: x.getField("_text")).alias("contexts"),
                      F.transform("_items", lambda x: x.getField("_file")).alias("filenames"))


def _allow_group_limit(spark, k: int) -> None:
    """Spark plans ``rank <= k`` as a partial group limit only up to a
    threshold (1000 by default); raise it so the head stays skew-safe."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key, "1000")) < k:
        spark.conf.set(key, str(k))


def budgeted_contexts(hits: DataFrame, q_key: str, order: Sequence[str], budget: int = PROMPT_BUDGET,
                      text_col: str = "text", file_col: str = "filename") -> DataFrame:
    """Per question: ``n_contexts``, ``context_tokens`` (over all hits) and the
    first ``budget + 1`` hits in ``order`` as ``contexts``/``filenames``.

    Token counts add up over ``', '.join`` (each separator is one token and
    no token spans a boundary), so totals come from a partial aggregation; a
    prompt within budget has at most ``budget`` hits and a truncated one
    only uses its first ``budget`` tokens, so the first ``budget + 1`` hits
    are all any prompt needs.  The rank filter runs as a per-partition group
    limit before the shuffle: a question hitting a third of the corpus ships
    at most ``budget + 1`` rows per map partition.
    """
    _allow_group_limit(hits.sparkSession, budget + 1)
    stats = hits.groupBy(q_key).agg(F.count("*").alias("n_contexts"),
                                    F.sum(token_count(text_col)).alias("context_tokens"))
    w = Window.partitionBy(q_key).orderBy(*order)
    head = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= budget + 1).drop("_rn")
    return stats.join(collect_contexts(head, q_key, order, text_col, file_col), q_key)


def assemble_prompts(questions: DataFrame, contexts: DataFrame, q_key: str, q_text: str = "text",
                     budget: int = PROMPT_BUDGET) -> DataFrame:
    """F4 + F5 + C5 + P15: one prompt per question.

    ``contexts`` comes from ``budgeted_contexts``.  Budget rule: if the full
    prompt exceeds ``budget`` tokens, the context is cut to
    ``budget - tokens('Question: ...\n\nAnswer:')`` tokens; the ``Context:``
    prefix is not counted, so the result may exceed the budget slightly.
    Questions without any retrieved text get the fixed fallback, no prompt.
    """
    q = F.col(q_text)
    ctx = join_contexts(F.col("contexts"))
    full = prompt(ctx, q)
    total = (token_count(F.lit(CONTEXT_PREFIX)) + F.col("context_tokens") + F.col("n_contexts") - 1
             + token_count(F.concat(F.lit(QUESTION_PREFIX), q, F.lit(ANSWER_SUFFIX))))
    over = total > F.lit(budget)
    cut = truncate_tokens(ctx, F.lit(budget) - token_count(question_suffix(q)))
    has = F.col("n_contexts").isNotNull() & (F.col("n_contexts") > 0)
    return (questions.join(contexts, q_key, "left")
            .withColumn("prompt_tokens", F.when(has, total))
            .withColumn("truncated", F.when(has, over.cast("int")))
            .withColumn("prompt", F.when(has, F.when(over, prompt(cut, q)).otherwise(full)))
            .withColumn("response", F.when(~has, F.lit(NO_HIT_RESPONSE)))
            .withColumn("filenames", F.when(has, F.col("filenames")).otherwise(F.array(F.lit(NO_HIT_FILENAME)))))


def candidate_prompts(questions: DataFrame, assignment: DataFrame, templates: DataFrame,
                      q_key: str, q_text: str = "text") -> DataFrame:
    """F6 + J8: each question fans out to both candidates' templated prompts."""
    return (questions.join(assignment, q_key)
            .join(F.broadcast(templates), "candidate")
            .withColumn("prompt", F.concat(F.col("template"), F.col(q_text)))
            .drop("template"))
