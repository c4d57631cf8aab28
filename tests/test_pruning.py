"""Vectors around pivots and similar sets against comparing everything."""

import random

import numpy as np
import pytest

from answerlake.operators import pivots, similar


def exhaustive(questions, vectors, k, farthest):
    out = []
    for q, a in questions:
        if a is None or not any(a):
            continue
        rows = []
        for v, b in vectors:
            if b is None or len(a) != len(b) or not any(b):
                continue
            d = 1 - np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))
            if not farthest or d > 0:
                rows.append((-round(d, 9) if farthest else round(d, 9), v, d))
        out += [(q, v, i + 1, round(d, 6) + 0.0) for i, (_, v, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def clustered(seed: int, n: int):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 8))
    rows = [(f"v{i:04d}", (centres[i % 12] + 0.05 * r.normal(size=8)).tolist()) for i in range(n)]
    rows += [(f"same{i}", centres[0].tolist()) for i in range(40)]  # ties, one hot direction
    rows += [("null", None), ("zero", [0.0] * 8), ("short", [1.0, 0.0]), ("short2", [0.6, 0.8])]
    questions = [(f"q{i}", (centres[i % 12] + 0.1 * r.normal(size=8)).tolist()) for i in range(20)] + [("exact", centres[0].tolist()), ("none", None), ("zero", [0.0] * 8), ("two", [1.0, 1.0]), ("odd", [1.0] * 5)]
    return questions, rows


@pytest.mark.parametrize("farthest", [False, True])
@pytest.mark.parametrize("part,count", [(4096, 256), (7, 5), (3, 1)])
def test_vectors_around_pivots_are_the_exhaustive_ones(spark, monkeypatch, farthest, part, count):
    monkeypatch.setattr(pivots, "PART", part)
    questions, rows = clustered(part, 200)
    groups = pivots.Groups(spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3), count=count)
    found, report = groups.search(spark.createDataFrame(questions, "qid string, qvec array<double>"), 4, farthest=farthest)
    got = sorted((r["qid"], r["vec_id"], r["rank"], round(r["distance"], 6) + 0.0) for r in found.collect())
    assert got == exhaustive(questions, rows, 4, farthest)
    visited = report.agg({"visited": "sum", "groups": "sum"}).first()
    if count == 256 and not farthest:
        assert visited["sum(visited)"] < visited["sum(groups)"] / 2


def brute(texts, least):
    sets = {}
    for key, terms in texts:
        if terms:
            sets.setdefault(frozenset(terms), []).append(key)
    classes = [(s, min(keys)) for s, keys in sets.items()]
    out = []
    for i, (s, a) in enumerate(classes):
        for t, b in classes[:i]:
            if len(s & t) / len(s | t) >= least - 1e-9:
                out.append((*sorted((a, b)), len(s & t)))
    return sorted(out), {k: (min(keys), len(keys)) for keys in sets.values() for k in keys}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("hot", [1000, 5, 1])
def test_similar_sets_are_brute_force(spark, least, hot):
    """With every term rare, some and all of them crowded."""
    r = random.Random(int(least * 10) + hot)
    texts = [(i, [r.choice("abcdefghijkl") + r.choice(["", "", "1", "2"]) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12]))]) for i in range(160)]
    texts += [(1000 + i, ["hot", f"x{i}"]) for i in range(30)] + [(2000, ["hot"]), (2001, ["hot"])] + [(3000 + i, list("abcd")) for i in range(20)]
    df = spark.createDataFrame(texts, "id int, terms array<string>")
    pairs, members = similar.similar_texts(df, ["id"], least, hot=hot)
    want, classes = brute(texts, least)
    assert sorted((p["a"]["id"], p["b"]["id"], p["n_shared"]) for p in pairs.collect()) == want
    assert {m["id"]: (m["rep"]["id"], m["size"]) for m in members.collect()} == classes


def test_no_pair_of_a_hot_term_is_formed(spark):
    """3,000 sets share a term and little else: the join makes no row of two of them."""
    texts = [(i, ["the", "of", *(f"{i}-{j}" for j in range(6))]) for i in range(3000)]
    sets = similar.classes(spark.createDataFrame(texts, "id int, terms array<string>"), ["id"])
    assert similar.similar_classes(sets.select("class", "set"), 0.2, hot=100).count() == 0


def test_text_labels_and_text_ids(spark):
    """Labels name themselves or are named by a table; question ids of any type are scored."""
    from answerlake.operators.classify import classify_centroid
    from answerlake.operators.scoring import score_index
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "vec_id string, embedding array<double>")
    cents = spark.createDataFrame([("red", [1.0, 0.1]), ("blue", [0.1, 1.0])], "label string, centroid array<double>")
    got = lambda df: {r["vec_id"]: r["category"] for r in df.collect()}
    assert got(classify_centroid(vectors, cents)) == {"a": "red", "b": "blue", "c": "Other"}
    names = spark.createDataFrame([("red", "Rot")], "label string, category string")
    assert got(classify_centroid(vectors, cents, names=names)) == {"a": "Rot", "b": "Other", "c": "Other"}
    numbered = spark.createDataFrame([(100, [1.0, 0.1]), (101, [0.1, 1.0])], "label int, centroid array<double>")
    many = spark.createDataFrame([(100, "Hundred"), (101, "More")], "label int, category string")
    assert got(classify_centroid(vectors, numbered, names=many)) == {"a": "Hundred", "b": "More", "c": "Other"}
    forward = spark.createDataFrame([("t1", [("x", 1.0)]), ("t2", [("y", 0.5)])], "uid string, items array<struct<term: string, weight: double>>")
    asked = spark.createDataFrame([("first", "x", 1.0), ("second", "y", 1.0)], "qid string, term string, qweight double")
    scores = score_index(asked, forward, "qid", ["uid"], "threshold", threshold=0.0)
    assert sorted(map(tuple, scores.collect())) == [("first", "t1", 1.0), ("second", "t2", 0.5)]


def test_unlike_classes_of_a_frequent_term_leave_no_pair(spark):
    """Parities reject them where the keys meet, so the join itself puts out similar classes alone."""
    texts = [(i, ["often", *[f"w{i}x{j}" for j in range(3)]]) for i in range(300)] + [(900, ["a", "b", "c", "d"]), (901, ["a", "b", "c", "e"])]
    sets = similar.classes(spark.createDataFrame(texts, "id int, terms array<string>"), ["id"])
    found = similar.similar_classes(sets.select("class", "set"), 0.6)
    assert [(r["n_shared"], r["similarity"]) for r in found.collect()] == [(3, 0.6)]
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()
