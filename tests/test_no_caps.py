"""Values beyond what the test tables hold: nothing is cut off, multiplied or lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlake.operators import classify, engagement, evaluate, retrieval, votes


def test_milestone_rules_beyond_fifty(spark):
    ev = spark.createDataFrame([(1, "question", i, i) for i in range(80)], "user_id long, kind string, ts long, event_id long")
    rules = spark.createDataFrame([("question", 50, 1), ("question", 60, 2)], "kind string, n int, badge_id int")
    got = sorted((r["badge_id"], r["event_id"]) for r in engagement.milestones(ev, rules).collect())
    assert got == [(1, 49), (2, 59)]


def test_turn_1000_is_an_answer_of_its_own(spark):
    key = ["conv_id", "turn"]
    answers = spark.createDataFrame([(1, 1000, "apple pear"), (2, 0, "plum fig")], "conv_id long, turn long, answer string")
    contexts = spark.createDataFrame([(1, 1000, "pear apple"), (2, 0, "nothing here")], "conv_id long, turn long, context string")
    got = sorted((r["conv_id"], r["turn"], r["support"]) for r in evaluate.context_support(answers, contexts, key).collect())
    assert got == [(1, 1000, 1.0), (2, 0, 0.0)]


def test_percent_of_a_row_without_listed_votes(spark):
    df = spark.createDataFrame([("x", "trump"), ("x", "biden"), ("x", "biden"), ("y", "other")], "category string, vote string")
    got = {r["category"]: tuple(r)[1:] for r in votes.vote_percent(votes.vote_pivot(df)).select("category", "trump_pct", "biden_pct").collect()}
    assert got == {"x": (33.33, 66.67), "y": (None, None)}


@pytest.mark.parametrize("max_bytes", [8, 1 << 20])
def test_centroids_of_any_number_and_length(spark, max_bytes):
    """A label past the taxonomy, vectors of another length, of zero norm and missing; one pass or many."""
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (30, [-1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "label long, centroid array<double>")
    vecs = spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.1, 2.0]), (3, [-3.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [1.0, 1.0])],
                                 "vec_id long, embedding array<double>")
    out = {r["vec_id"]: (r["category"], r["score"]) for r in classify.classify_centroid(vecs, cents, max_bytes=max_bytes).collect()}
    names = classify.TAXONOMY
    assert [out[i][0] for i in range(1, 9)] == [names[0], names[1], "Other", names[2], "Other", "Other", "Other", names[0]]
    assert abs(out[3][1] - 1.0) < 1e-12 and out[5][1] is None and out[6][1] is None and out[7][1] is None


def test_dense_questions_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=4 if i % 2 else 3).tolist()) for i in range(40)]
    q = spark.createDataFrame(data[:2], "qid long, qvec array<double>")
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = retrieval.dense_topk(retrieval.dense_topk_candidates(q, v, 3), 3).collect()
    assert sorted({r["qid"] for r in got}) == [0, 1] and len(got) == 6
    assert all(r["vec_id"] % 2 == r["qid"] % 2 for r in got)


def test_hooks_keep_values_and_errors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)

    def embed(s):
        if (s == "bad").any():
            raise ValueError("no vector")
        return s.map(lambda t: [float(len(t or ""))])
    got = {r["id"]: (r["embedding"], r["embedding_error"]) for r in classify.embed_with(df, embed).collect()}
    assert got == {1: ([2.0], None), 2: (None, "no vector"), 3: ([0.0], None)}
    done = classify.complete_with(df, lambda s: s.str.upper(), prompt_col="text").filter("id = 1").first()
    assert (done["response"], done["response_error"]) == ("AB", None)
    count = classify.token_udf(lambda t: len(t) // 2)
    assert [r[0] for r in df.orderBy("id").select(count("text")).collect()] == [1, 1, None]


def test_alias_table(spark):
    df = spark.createDataFrame([(1, " Economy "), (2, "Healthcare"), (3, None)], "id long, category string")
    aliases = spark.createDataFrame([("economy", "Economic Policy")], "alias string, label string")
    got = {r["id"]: r["category"] for r in classify.alias_labels(df, aliases).collect()}
    assert got == {1: "Economic Policy", 2: "Healthcare", 3: None}


def test_as_of_match_carries_columns(spark):
    qs = spark.createDataFrame([(1, 1, 100)], "user_id long, ts long, event_id long")
    vs = spark.createDataFrame([(1, 9, 202, 7)], "user_id long, ts long, event_id long, k long")
    got = engagement.latest_before(qs, vs, "user_id", "event_id", bucket=F.floor(F.col("ts") / 4), carry=["k"]).first()
    assert (got["matched_id"], got["k"]) == (100, 7)
