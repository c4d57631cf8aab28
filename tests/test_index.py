"""The segmented index against one full build, and pruned retrieval against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from answerlake.operators import pruned, segments
from answerlake.operators import retrieval as R
from answerlake.operators.tfidf import build_index, vectorize
from answerlake.plans import corpus as C
from answerlake.plans.catalog import QUERIES
from answerlake.session import shared_path
from answerlake.sources import storage


def texts(spark, seed: int, docs: range):
    r = random.Random(seed)
    rows = [(f"d{d}", i, "src", " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(r.choice(["", "", r.randrange(30)])) for _ in range(r.randrange(0, 25))))
            for d in docs for i in range(3)]
    return spark.createDataFrame(rows, "doc string, idx int, source string, text string")


KEYS = ["doc", "idx"]


def weights(index) -> dict:
    return {(r["doc"], r["idx"], r["term"]): (r["tf"], round(r["weight"], 12)) for r in index.postings.collect()}


def same_as_full(spark, path, units) -> None:
    full = build_index(units, KEYS, keep=("source",))
    got = segments.open_index(spark, path)
    assert {r["term"]: (r["df"], round(r["idf"], 12)) for r in got.idf.collect()} == {r["term"]: (r["df"], round(r["idf"], 12)) for r in full.idf.collect()}
    assert weights(got) == weights(full)
    assert sorted(map(tuple, got.units.select(*KEYS, "text").collect())) == sorted(map(tuple, units.select(*KEYS, "text").collect()))


def test_appended_segments_are_one_full_build(spark):
    path = shared_path(spark, "segments")
    parts = [texts(spark, i, range(10 * i, 10 * i + 10)) for i in range(3)]
    for i, part in enumerate(parts):
        assert segments.append(part, path, KEYS, [f"file{i}"], keep=("source",)).version == i
    same_as_full(spark, path, parts[0].unionByName(parts[1]).unionByName(parts[2]))
    # a replayed append adds nothing
    assert segments.append(parts[1], path, KEYS, ["file1"], keep=("source",)).version == 2
    assert len(segments.manifest(spark, path).segments) == 3


def test_deleted_and_replaced_texts(spark):
    path = shared_path(spark, "segments")
    one, two, again = texts(spark, 1, range(10)), texts(spark, 2, range(10, 20)), texts(spark, 3, range(3, 5))
    segments.append(one, path, KEYS, ["one"], keep=("source",))
    segments.append(two, path, KEYS, ["two"], keep=("source",))
    segments.delete(spark.createDataFrame([("d3",), ("d4",), ("d15",), ("nowhere",)], "doc string"), path)
    left = one.unionByName(two).filter("doc NOT IN ('d3', 'd4', 'd15')")
    same_as_full(spark, path, left)
    # new texts under deleted keys live; a second tombstone by another key takes single texts
    segments.append(again, path, KEYS, ["again"], keep=("source",))
    segments.delete(spark.createDataFrame([("d1", 0), ("d3", 2)], "doc string, idx int"), path)
    left = left.unionByName(again).filter("NOT (doc = 'd1' AND idx = 0) AND NOT (doc = 'd3' AND idx = 2)")
    same_as_full(spark, path, left)
    before = weights(segments.open_index(spark, path))
    m = segments.compact(spark, path)
    assert len(m.segments) == 1 and m.tombstones == [] and m.segments[0]["inputs"] == ["again", "one", "two"]
    same_as_full(spark, path, left)
    assert weights(segments.open_index(spark, path)) == before
    assert segments.vacuum(spark, path) > 3
    same_as_full(spark, path, left)


def test_a_crash_before_the_manifest_changes_nothing(spark, monkeypatch):
    path = shared_path(spark, "segments")
    one, two = texts(spark, 1, range(8)), texts(spark, 2, range(8, 16))
    segments.append(one, path, KEYS, ["one"], keep=("source",))
    with monkeypatch.context() as m:
        m.setattr(storage, "write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            segments.append(two, path, KEYS, ["two"], keep=("source",))
    assert len(storage.names(spark, f"{path}/segments")) == 2
    same_as_full(spark, path, one)
    segments.append(two, path, KEYS, ["two"], keep=("source",))
    same_as_full(spark, path, one.unionByName(two))


def test_of_two_writers_none_is_lost(spark, monkeypatch):
    """Another append gets its version in between: this one is put after it."""
    path = shared_path(spark, "segments")
    one, two, three = (texts(spark, i, range(5 * i, 5 * i + 5)) for i in (1, 2, 3))
    segments.append(one, path, KEYS, ["one"], keep=("source",))
    write, between = storage.write_new, []

    def late(*a):
        if not between:
            between.append(1)
            segments.append(two, path, KEYS, ["two"], keep=("source",))
        return write(*a)

    monkeypatch.setattr(storage, "write_new", late)
    assert segments.append(three, path, KEYS, ["three"], keep=("source",)).version == 2
    assert not storage.write_new(spark, f"{path}/manifest/00000001.json", "{}")
    same_as_full(spark, path, one.unionByName(two).unionByName(three))


def test_one_build_per_input(spark, monkeypatch, tmp_path):
    import shutil
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    built, add = [], segments.append
    monkeypatch.setattr(segments, "append", lambda *a, **k: (built.append(a[1]), add(*a, **k))[1])
    first = {}
    for name in ("retrieve_top1", "serve_top1", "prompt_budget", "retrieve_best_per_pack", "retrieve_threshold", "tfidf_idf", "context_rows"):
        first[name] = sorted(map(str, QUERIES[name](spark, str(tmp_path / "sf")).collect()))
    assert len(built) == len(set(built)) == 2  # paragraphs, chunks
    assert first["retrieve_top1"] == first["serve_top1"]
    (tmp_path / "sf" / "documents.parquet").touch()  # a changed input is another index
    QUERIES["tfidf_idf"](spark, str(tmp_path / "sf")).count()
    assert len(built) == 3


# --- pruned retrieval ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fine,coarse,seeds,bucket", [(4, 8, 2, 32 << 20), (0, 1, 1, 2000), (1, 3, 3, 500)])
def test_pruned_is_scoring_everything(spark, monkeypatch, fine, coarse, seeds, bucket):
    for name, value in (("FINE", fine), ("COARSE", coarse), ("SEEDS", seeds), ("NEXT", 2 * seeds), ("BUCKET_BYTES", bucket)):
        monkeypatch.setattr(pruned, name, value)
    path = shared_path(spark, "segments")
    units = texts(spark, fine, range(60))
    units = units.unionByName(units.filter("idx = 1").withColumn("doc", F.concat(F.lit("copy"), "doc")))  # ties
    segments.append(units, path, KEYS, ["all"], keep=("source",))
    index = pruned.Blocks(spark, path)
    questions = spark.createDataFrame([("q1", "alpha beta"), ("q2", "gamma7 delta the"), ("q3", ""), ("q4", None), ("q5", "unheard of5"), ("q6", "the of alpha beta gamma delta " * 3)],
                                      "qid string, text string")
    qv = vectorize(questions, index.idf, ("qid",))
    everything = R.sparse_scores(qv, segments.open_index(spark, path).postings, ["qid"], KEYS)
    search = pruned.Search(index, questions, ["qid"])
    rows = lambda df: sorted((r["qid"], r["doc"], r["idx"], round(r["score"], 9)) for r in df.collect())
    assert rows(search.top1()) == rows(R.top1(everything, ["qid"], KEYS))
    for threshold in (0.0, 0.3, 0.8):
        assert rows(search.above(threshold)) == rows(everything.filter(F.col("score") > threshold))


def test_fewer_than_half_of_the_blocks_are_read(spark):
    sf = "/root/testdata/sf0.1"
    search = pruned.Search(C.paragraph_blocks(spark, sf), C.questions(spark, sf), ["item_id"])
    _, fine = search.needed_for_top1()
    read, there = search.blocks_read(fine)
    assert 0 < read < there / 2, (read, there)
    search = pruned.Search(C.chunk_blocks(spark, sf), C.questions(spark, sf), ["item_id"])
    read, there = search.blocks_read(search.needed_for_threshold(C.THRESHOLD))
    assert 0 < read < there / 2, (read, there)


def test_few_questions_read_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BUCKET_BYTES", 20_000)
    path = shared_path(spark, "segments")
    segments.append(C.paragraphs(spark, "/root/testdata/sf0.001"), path, C.PARA_KEYS, ["all"], keep=("source",))
    index = pruned.Blocks(spark, path)
    assert index.buckets > 16
    one = C.questions(spark, "/root/testdata/sf0.001").filter("item_id = 1").select("item_id", F.substring("text", 1, 60).alias("text"))
    search = pruned.Search(index, one, ["item_id"])
    plan = index.table(index.blocks_at, index.buckets_of(search.terms.withColumn("bucket", index.bucket())))._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("PartitionFilters: [bucket", 1)[1].split("]", 1)[0]
    assert 0 < len(scan.split("IN (", 1)[1].split(",")) < index.buckets / 2
    assert search.top1().count() == 1


def test_terms_of_a_block_meet_the_vocabulary_once(spark):
    """Weighing joins the distinct terms of blocks, not postings; equal and null keys and null texts as in one full build."""
    path = shared_path(spark, "segments")
    rows = [(f"d{i % 40}" if i % 7 else None, i % 3 or None, "src", f"the of alpha{i} beta{i % 5} the" if i % 11 else None) for i in range(200)]
    units = spark.createDataFrame(rows, "doc string, idx int, source string, text string")
    m = segments.append(units, path, KEYS, ["one"], keep=("source",))
    index, full = segments.open_index(spark, path), build_index(units, KEYS, keep=("source",))
    key = lambda r: (str(r["doc"]), str(r["idx"]), r["term"], r["tf"], round(r["weight"], 12))
    assert sorted(map(key, index.postings.collect())) == sorted(map(key, full.postings.collect()))
    plan = segments._weighted(spark, path, m, index.idf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "collect_list" not in plan


def test_questions_in_sets_and_split_shards_find_the_same(spark, monkeypatch):
    """many sets of questions, ranges cut by batches, slices of one range; null and repeated question keys."""
    units = texts(spark, 5, range(40))
    questions = spark.createDataFrame([(i if i % 5 else None, w) for i, w in enumerate(["alpha beta", "gamma7 the of", "delta", "the", "of beta3 beta", "", "unheard", "alpha1 alpha2 the"])]
                                      + [(3, "beta gamma")], "qid int, text string")
    rows = lambda df: sorted((str(r["qid"]), r["doc"], r["idx"], round(r["score"], 9)) for r in df.collect())
    found = {}
    for sets, batch in ((500_000, 1_000_000), (3, 1)):
        for name, value in (("QUESTION_POSTINGS", sets), ("MAX_PAIRS", sets), ("MAX_POSTINGS", batch)):
            monkeypatch.setattr(pruned, name, value)
        path = shared_path(spark, "segments")
        segments.append(units, path, KEYS, ["all"], keep=("source",))
        search = pruned.Search(pruned.Blocks(spark, path), questions, ["qid"])
        found[sets] = rows(search.top1()), rows(search.above(0.25)), search.sets
    assert found[3][:2] == found[500_000][:2] and found[3][2] > 3 and found[500_000][2] == 1
    qv = vectorize(questions, segments.open_index(spark, path).idf, ("qid",)).select(F.struct("qid").alias("q"), "term", "qweight")
    everything = R.sparse_scores(qv, segments.open_index(spark, path).postings, ["q"], KEYS).select("q.*", *KEYS, "score")
    assert found[3][1] == rows(everything.filter("score > 0.25"))


def test_pairs_of_questions_and_ranges_do_not_pass_a_shuffle(spark):
    """of a search, blocks by shard and results are shuffled; numbers of texts come with the weighted index."""
    sf = "/root/testdata/sf0.001"
    index = C.chunk_blocks(spark, sf)
    assert {"place", "norm"} <= set(index.places.columns)
    assert storage.names(spark, f"{index.path}/views/{index.manifest.version:08d}") == ["blocks", "vocabulary", "weighted"]
    search = pruned.Search(index, C.questions(spark, sf), ["item_id"])
    plan = search.blocks.groupBy("shard").count()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # a search reads its result back: texts meet the few best keys, which are stored
    assert "Aggregate" not in search.top1()._jdf.queryExecution().executedPlan().toString()


def test_texts_given_twice_score_with_both(spark, monkeypatch):
    """Rows with equal keys are one text that has its terms more than once: bounds count them all."""
    for name, value in (("FINE", 0), ("COARSE", 1), ("SEEDS", 1), ("NEXT", 1)):
        monkeypatch.setattr(pruned, name, value)
    path = shared_path(spark, "segments")
    units = texts(spark, 6, range(40))
    units = units.unionByName(units.filter("crc32(doc) % 3 = 0")).unionByName(units.filter("crc32(doc) % 9 = 0"))
    segments.append(units, path, KEYS, ["all"], keep=("source",))
    questions = spark.createDataFrame([(1, "alpha beta gamma"), (2, "the of"), (3, "delta gamma7 alpha3"), (4, "beta1 beta2 beta3 the")], "qid int, text string")
    rows = lambda df: sorted((r["qid"], r["doc"], r["idx"], round(r["score"], 9)) for r in df.collect())
    index = pruned.Blocks(spark, path)
    everything = R.sparse_scores(vectorize(questions, index.idf, ("qid",)), segments.open_index(spark, path).postings, ["qid"], KEYS)
    search = pruned.Search(index, questions, ["qid"])
    assert rows(search.top1()) == rows(R.top1(everything, ["qid"], KEYS))
    for threshold in (0.3, 0.5, 0.8):
        assert rows(search.above(threshold)) == rows(everything.filter(F.col("score") > threshold))
