"""Question sides past the collect bound, and batches past the pair bound."""

import pytest

from answerlake.operators import scoring


@pytest.fixture(scope="module")
def sides(spark):
    q = [(i, t, 0.1 + (i * t) % 7) for i in range(12) for t in range(i % 4, 9, 2)]
    d = [(i, i % 3, t, 0.2 + (i + t) % 5) for i in range(30) for t in range(i % 3, 11, 2)]
    postings = spark.createDataFrame(d, "uid long, grp long, term long, weight double")
    return spark.createDataFrame(q, "qid long, term long, qweight double"), scoring.forward_index(postings, ["uid", "grp"])


def _all(sides, **kw):
    rows = scoring.score_index(*sides, "qid", ["uid", "grp"], "threshold", threshold=1.0, **kw)
    return rows, sorted((r["qid"], r["uid"], round(r["score"], 9)) for r in rows.collect())


def test_questions_past_the_bound_stay_in_the_tasks(sides, monkeypatch):
    want = _all(sides)[1]
    seen, build = [], scoring._Questions.__init__
    monkeypatch.setattr(scoring._Questions, "__init__", lambda self, *a: (seen.append(1), build(self, *a))[1])
    rows, got = _all(sides, max_question_postings=5)
    assert got == want and want and not seen
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 10, 10_000])
def test_pairs_are_bounded(sides, most, monkeypatch):
    import numpy as np
    import pandas as pd
    q, forward = sides
    qs = scoring._Questions(q.toPandas(), "qid")
    batch = forward.toArrow().combine_chunks().to_batches()[0].slice(2)
    whole = scoring._scores(batch, qs)
    monkeypatch.setattr(scoring, "MAX_PAIRS", most)
    at, out = 0, []
    for part in scoring._parts(batch, qs):
        rows, i, score = scoring._scores(part, qs)
        assert part.num_rows == 1 or sum(len(pd.Index(qs.q)[qs.ptr[t]:qs.ptr[t + 1]]) for x in part.column("items").to_pylist() for e in x
                                         if (t := qs.vocab.get_indexer([e["term"]])[0]) >= 0) <= most
        out.append((rows + at, i, score))
        at += part.num_rows
    assert at == batch.num_rows and all(np.allclose(np.concatenate(c), w) for c, w in zip(zip(*out), whole))


def test_only_asked_terms_go_through_the_join_with_groups(spark):
    forward = spark.createDataFrame([("t1", [("x", 1.0), ("z", 2.0)]), ("t2", [("y", 0.5)]), (None, [("z", 1.0)])], "uid string, items array<struct<term: string, weight: double>>")
    asked = spark.createDataFrame([("q", "x", 1.0), ("r", "z", 1.0)], "qid string, term string, qweight double")
    got = {r["uid"]: [tuple(i) for i in r["items"]] for r in scoring.with_asked_terms(forward, asked, ["uid"]).collect()}
    assert got == {"t1": [("x", 1.0), ("z", 2.0)], None: [("z", 1.0)]}
    assert scoring.with_asked_terms(forward, asked, ["uid"], max_question_postings=1).count() == 3
