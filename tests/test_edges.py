"""Edge cases, one per rule (small inline fixtures)."""

import pytest
from pyspark.sql import functions as F

from answerlake.functions import payloads as P
from answerlake.functions.text import normalize, py_strip, token_count, truncate_tokens
from answerlake.operators import retrieval as R
from answerlake.operators.chunking import _greedy_pack_ids, chunk_chars, pack_greedy
from answerlake.operators.engagement import latest_before, milestones, nth_events
from answerlake.operators.evaluate import quotas
from answerlake.operators.paragraphs import split_paragraphs
from answerlake.operators.tfidf import build_index, term_frequencies, vectorize
from answerlake.operators.votes import display_name, first_per_key, vote_percent, vote_pivot, winner
from answerlake.sources.inline import badge_rules


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_exact_multiple_chunking(spark):
    df = spark.createDataFrame([(1, 0, "abcdefghij")], "doc_id long, para_idx int, text string")
    keep = rows(chunk_chars(df, 5).orderBy("piece_idx"), "piece_idx", "text")
    drop = rows(chunk_chars(df, 5, drop_exact=True).orderBy("piece_idx"), "piece_idx", "text")
    assert keep == [(0, "abcde"), (1, "fghij")]
    assert drop == [(0, "abcde")]


def test_empty_paragraph_has_no_chunk(spark):
    df = spark.createDataFrame([(1, "a\n\n\n\nb")], "doc_id long, text string")
    paras = split_paragraphs(df)
    assert rows(paras.orderBy("para_idx"), "text") == [("a",), ("",), ("b",)]
    assert chunk_chars(paras, 5).count() == 2


def test_three_newlines_and_whitespace_collapse(spark):
    df = spark.createDataFrame([(1, "a\n\n\nb")], "doc_id long, text string")
    paras = split_paragraphs(df).withColumn("text", normalize("text"))
    assert rows(paras.orderBy("para_idx"), "text") == [("a",), (" b",)]


def test_unicode_space_and_strip(spark):
    df = spark.createDataFrame([("a \x1cb",), ("\t x 　",)], "t string")
    assert [r[0] for r in df.select(normalize("t")).collect()] == ["a b", " x "]
    assert [r[0] for r in df.select(py_strip("t")).collect()] == ["a \x1cb", "x"]


def test_supplementary_character_substring(spark):
    df = spark.createDataFrame([(1, 0, "a\U0001F600bc")], "doc_id long, para_idx int, text string")
    assert rows(chunk_chars(df, 2).orderBy("piece_idx"), "text") == [("a\U0001F600",), ("bc",)]


def test_greedy_packing_rules():
    import numpy as np
    assert list(_greedy_pack_ids(np.array([5, 6, 3, 9, 1, 1, 20, 2]), 10)) == [0, 1, 1, 2, 2, 3, 4, 5]
    assert list(_greedy_pack_ids(np.array([20, 2]), 10)) == [0, 1]


def test_greedy_packing_spark(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 6, 3, 9, 1, 1, 20, 2])],
                               "doc_id long, para_idx int, n_tokens long")
    out = rows(pack_greedy(df, 10).orderBy("para_idx"), "pack_id")
    assert [r[0] for r in out] == [0, 1, 1, 2, 2, 3, 4, 5]


def test_token_count_and_truncate(spark):
    df = spark.createDataFrame([("Hello, world! how are you",)], "t string")
    r = df.select(token_count("t").alias("n"), truncate_tokens("t", 3).alias("cut"),
                  truncate_tokens("t", 99).alias("same")).first()
    assert r.n == 7 and r.cut == "Hello, world" and r.same == "Hello, world! how are you"


def _index(spark, texts):
    units = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    return build_index(units, ["uid"])


def test_tfidf_matches_vectoriser_formula(spark):
    import math
    ix = _index(spark, ["the cat sat", "the dog", "  "])
    idf = {r.term: r.idf for r in ix.idf.collect()}
    assert ix.n_fit == 2
    assert math.isclose(idf["the"], math.log(3 / 3) + 1)
    assert math.isclose(idf["cat"], math.log(3 / 2) + 1)
    norms = ix.postings.groupBy("uid").agg(F.sum(F.col("weight") ** 2).alias("n2")).collect()
    assert all(math.isclose(r.n2, 1.0) for r in norms)


def test_ties_go_to_the_first_text(spark):
    ix = _index(spark, ["red apple", "red apple", "green pear"])
    q = spark.createDataFrame([(7, "apple")], "item_id long, text string")
    qv = vectorize(q, ix.idf, ["item_id"])
    best = R.top1(R.sparse_scores(qv, ix.postings, ["item_id"], ["uid"]), ["item_id"], ["uid"])
    assert rows(best, "uid") == [(0,)]


def test_kernel_equals_join(spark):
    from answerlake.operators.scoring import forward_index, score_index
    ix = _index(spark, ["red apple pie", "green apple", "pear tart", "apple apple red"])
    q = spark.createDataFrame([(1, "red apple"), (2, "tart pear"), (3, "zebra")], "item_id long, text string")
    qv = vectorize(q, ix.idf, ["item_id"])
    joined = R.sparse_scores(qv, ix.postings, ["item_id"], ["uid"])
    kern = score_index(qv, forward_index(ix.postings, ["uid"]), "item_id", ["uid"], "threshold", threshold=0.0)
    a = sorted((r.item_id, r.uid, round(r.score, 9)) for r in joined.collect())
    b = sorted((r.item_id, r.uid, round(r.score, 9)) for r in kern.collect())
    assert a == b and len(a) > 0


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.2000001)], "uid long, score double")
    assert rows(R.above_threshold(df, 0.2), "uid") == [(2,)]


def test_no_overlap_falls_back(spark):
    q = spark.createDataFrame([(1,), (2,)], "item_id long")
    hits = spark.createDataFrame([(1, 0.5, "f.txt")], "item_id long, score double, filename string")
    out = {r.item_id: (r.response, r.filename) for r in R.with_fallback(q, hits, ["item_id"]).collect()}
    assert out[1] == (None, "f.txt") and out[2] == (R.NO_HIT_RESPONSE, R.NO_HIT_FILENAME)


def test_dense_zero_vector_and_equal_vector(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>")
    v = spark.createDataFrame([(10, [0.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])],
                              "vec_id long, embedding array<double>")
    d = R.dense_distances(q, v)
    dist = {r.vec_id: r.distance for r in d.collect()}
    assert dist[10] is None and dist[11] == pytest.approx(0.0) and dist[12] == pytest.approx(1.0)
    near = rows(R.dense_topk(d, 1), "vec_id")
    far = rows(R.dense_topk(d, 5, farthest=True), "vec_id")
    assert near == [(11,)] and far == [(12,)]


def test_reference_extraction(spark):
    df = spark.createDataFrame([("Yes http://x.y/z ok http://q",), ("no link here ",)], "m string")
    text, ref = P.extract_reference(F.col("m"))
    got = [(r[0], r[1]) for r in df.select(text, ref).collect()]
    assert got == [("Yes  ok http://q", "http://x.y/z"), ("no link here", "No reference provided")]


def test_quiz_parse(spark):
    df = spark.createDataFrame([("Question: Who? Answer: Trump",), ("Question: Who?",)], "m string")
    q, a = P.parse_quiz(F.col("m"), ["trump", "biden"])
    assert [(r[0], r[1]) for r in df.select(q, a).collect()] == [("Who?", "Trump"), (None, None)]


def test_chat_response_path_trims(spark):
    df = spark.createDataFrame([("  padded answer \n",), ("not json",)], "c string")
    body = P.chat_response_body(F.col("c"), F.lit("id-1"))
    got = [r[0] for r in df.select(P.response_content(body)).collect()]
    assert got == ["padded answer", "not json"]
    bad = [r[0] for r in df.select(P.response_content(F.col("c"))).collect()]
    assert bad == [None, None]


def test_tally_winner(spark):
    df = spark.createDataFrame([(0, 0), (2, 2), (3, 1)], "a long, b long")
    assert [r[0] for r in df.select(winner(F.col("a"), F.col("b"), "A", "B")).collect()] == ["Tie", "Tie", "A"]


def test_display_name_null(spark):
    df = spark.createDataFrame([("trump",), (None,)], "p string")
    assert [r[0] for r in df.select(display_name(F.col("p"))).collect()] == ["Donald Trump", None]
    assert [r[0] for r in df.select(display_name(F.col("p"), literal=True)).collect()] == ["Donald Trump",
                                                                                            "Joe Biden"]


def test_second_vote_on_a_question_is_ignored(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 3, 12)], "question_id long, ts long, vote_id long")
    assert sorted(rows(first_per_key(df, ["question_id"], ["ts"]), "vote_id")) == [(10,), (12,)]


def test_milestones_once(spark):
    ev = spark.createDataFrame([(1, "question", i, i) for i in range(12)], "user_id long, kind string, ts long, event_id long")
    got = sorted(rows(milestones(ev, badge_rules(spark)), "badge_id", "event_id"))
    assert got == [(1, 0), (4, 9)]
    assert nth_events(ev, 5).count() == 5


def test_latest_before(spark):
    qs = spark.createDataFrame([(1, 1, 100), (1, 5, 101)], "user_id long, ts long, event_id long")
    vs = spark.createDataFrame([(1, 0, 200), (1, 3, 201), (1, 9, 202)], "user_id long, ts long, event_id long")
    got = sorted(rows(latest_before(qs, vs, "user_id", "event_id", bucket=F.floor(F.col("ts") / 4)),
                      "event_id", "matched_id"))
    assert got == [(200, None), (201, 100), (202, 101)]
    one = sorted(rows(latest_before(qs, vs, "user_id", "event_id", bucket=F.lit(0)), "event_id", "matched_id"))
    assert one == got


def test_vote_golden_percentages(spark):
    # the golden table of the original vote sample (counts per category)
    counts = {"education": (1, 1), "healthcare": (0, 3), "environment": (2, 3), "foreign policy": (4, 2),
              "government": (4, 3), "infrastructure": (2, 5), "economy": (4, 5), "society": (3, 7)}
    data = [(c, "trump") for c, (t, _) in counts.items() for _ in range(t)] + \
           [(c, "biden") for c, (_, b) in counts.items() for _ in range(b)]
    votes = spark.createDataFrame(data, "category string, vote string")
    p = vote_percent(vote_pivot(votes))
    got = {r.category: (r.total, r.biden_pct, r.trump_pct) for r in p.collect()}
    assert got["foreign policy"] == (6, 33.33, 66.67)
    assert got["government"] == (7, 42.86, 57.14)
    assert sum(r.biden for r in p.collect()) == 29


def test_quota_rule():
    assert quotas(10, {"simple": .5, "reasoning": .25, "multi_context": .25}) == \
        {"simple": 5, "reasoning": 3, "multi_context": 2}


def test_dense_kernel_equals_pairwise(spark):
    import random
    rnd = random.Random(3)
    q = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(5)],
                              "qid long, qvec array<double>")
    v = spark.createDataFrame([(j, [rnd.uniform(-1, 1) for _ in range(8)]) for j in range(60)]
                              + [(60, [0.0] * 8), (61, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for far in (False, True):
        a = R.dense_topk(R.dense_distances(q, v), 4, farthest=far)
        b = R.dense_topk(R.dense_topk_candidates(q, v, 4, farthest=far), 4, farthest=far)
        key = lambda df: sorted((r.qid, r.vec_id, r.rank) for r in df.collect())
        assert key(a) == key(b)


def test_classify_with_hook_and_failure(spark):
    from answerlake.operators.classify import classify_with
    df = spark.createDataFrame([(1, "how to fix roads"), (2, "tax cuts")], "id long, text string")
    ok = classify_with(df, lambda s: s.str.contains("tax").map({True: "Tax Policy", False: "Infrastructure"}))
    assert sorted(rows(ok, "id", "category")) == [(1, "Infrastructure"), (2, "Tax Policy")]

    def boom(s):
        raise RuntimeError("model down")
    assert rows(classify_with(df, boom), "category", "category_error") == [(None, "model down")] * 2

    def one_bad(s):
        if s.str.contains("tax").any():
            raise ValueError("no tax")
        return s.str.upper()
    got = sorted(rows(classify_with(df.coalesce(1), one_bad), "id", "category", "category_error"))
    assert got == [(1, "HOW TO FIX ROADS", None), (2, None, "no tax")]


def test_question_list_and_text_folders(spark, tmp_path):
    from answerlake.sources.files import read_question_list, scan_text_dir
    (tmp_path / "q.txt").write_text('"What is it?",\n"Why, though?",\n"Last one"\n', encoding="utf-8")
    assert rows(read_question_list(spark, str(tmp_path / "q.txt")), "text") == \
        [("What is it?",), ("Why, though?",), ("Last one",)]
    d = tmp_path / "corpus"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    (d / "b.TXT").write_text("upper", encoding="utf-8")
    (d / "sub" / "c.txt").write_text("deep", encoding="utf-8")
    flat = rows(scan_text_dir(spark, str(d)), "filename", "text")
    assert flat == [("a.txt", "one\n\ntwo")]  # case-sensitive suffix, not recursive
    deep = sorted(rows(scan_text_dir(spark, str(d), recursive=True), "filename"))
    assert deep == [("a.txt",), ("b.TXT",), ("c.txt",)]


def test_csv_out_name():
    from answerlake.sinks.writers import out_name
    assert out_name("uncategorizedQuestions_small.csv") == "uncategorizedQuestions_smallOut.csv"


def test_block_parallel_packing_equals_sequential(spark):
    import random
    import numpy as np
    from answerlake.operators.chunking import _greedy_pack_ids
    rnd = random.Random(7)
    docs = {d: [rnd.choice([0, 1, 3, 5, 9, 12, 30]) for _ in range(rnd.randint(1, 60))] for d in range(12)}
    data = [(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "doc_id long, para_idx int, n_tokens long")
    for block in (1, 4, 7, 1000):
        got = {(r.doc_id, r.para_idx): r.pack_id for r in pack_greedy(df, 10, block_rows=block).collect()}
        for d, ts in docs.items():
            want = list(_greedy_pack_ids(np.array(ts), 10))
            assert [got[(d, i)] for i in range(len(ts))] == want, (block, d)


def test_append_questions_and_latest(spark, tmp_path):
    from answerlake.sinks.writers import append_questions
    path = str(tmp_path / "questions")
    q = spark.createDataFrame([("first?",), ("second?",)], "text string")
    assert append_questions(q, path) == 2
    assert append_questions(q.limit(1), path, session_id=7) == 1
    assert append_questions(q.limit(0), path) == 0
    back = spark.read.parquet(path)
    assert sorted(rows(back.groupBy("session_id").count(), "session_id", "count")) == [(0, 2), (7, 1)]
    assert back.filter(F.col("timestamp").isNull()).count() == 0
