"""What an index and its readers store and shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from answerlake.operators import evaluate, pruned, scoring, segments
from answerlake.operators import retrieval as R
from answerlake.session import shared_path
from answerlake.sources import storage

KEYS = ("doc_id", "para_idx")


def _index(spark, n=300):
    r = random.Random(1)
    texts = [(i, 0, "src", " ".join(f"w{int(r.paretovariate(0.6)) % 900}x" for _ in range(r.randint(1, 30)))) for i in range(n)]
    path = shared_path(spark, "disk-index")
    segments.append(spark.createDataFrame(texts, "doc_id int, para_idx int, source string, text string"), path, KEYS, ["a"], keep=("source",))
    return path


def test_rare_pairs_write_no_weights(spark):
    """pairs of rare terms need terms and vocabulary alone; postings meet the rare terms through a filter."""
    path = _index(spark)
    index = segments.open_index(spark, path)
    pairs = evaluate.rare_term_pairs(index.terms, index.idf, list(KEYS))
    assert pairs.count() > 0
    assert storage.names(spark, f"{path}/views/00000000") == ["vocabulary"]


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_the_filter_of_rare_terms_loses_none(spark, monkeypatch, bits):
    monkeypatch.setattr(evaluate, "FILTER_BITS", bits)
    monkeypatch.setattr(evaluate, "SLICE_BITS", 64)
    index = segments.open_index(spark, _index(spark, 80))
    few = index.idf.filter("df <= 2").select("term")
    want = index.terms.join(few, "term", "left_semi")
    got = evaluate.with_terms_of(index.terms, few)
    assert sorted(map(tuple, got.select(*KEYS, "term", "tf").collect())) == sorted(map(tuple, want.select(*KEYS, "term", "tf").collect()))


def test_blocks_travel_packed_and_idf_are_stored_for_weights(spark):
    """a batch sends a row a part, not one a block; what is stored of weights are the terms' few idf."""
    index = segments.open_index(spark, _index(spark))
    rows = index.weighted.withColumn("buckets", F.transform("items", lambda i: F.lit(1)))
    packed = rows.select("place", "norm", "items", "buckets").coalesce(1).mapInArrow(pruned._gather(8, 10**6, 2 * pruned.SPREAD), "part int, blocks binary")
    assert packed.count() <= pruned.SPREAD < index.idf.count()
    stored = index.weighted.select(F.explode("items.idf").alias("x")).distinct().count()
    assert stored == index.idf.select("idf").distinct().count()
    assert {f.name for f in index.weighted.schema["items"].dataType.elementType} == {"term", "tf", "idf"}


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_best_in_groups_is_final(spark, batch):
    """groups go on over batches and slices; what leaves the tasks is one row a question and group."""
    r = random.Random(batch)
    texts = [(i % 7 if i % 11 else None, i % 3, i, [("t%d" % r.randint(0, 6), r.choice([0.25, 0.5, 0.75])) for _ in range(3)]) for i in range(120)]
    forward = spark.createDataFrame(texts, "doc_id int, pack_id int, para_idx int, items array<struct<term:string,weight:double>>")
    asked = spark.createDataFrame([(q, f"t{t}", 0.5) for q in range(5) for t in (q, q + 1)], "item_id int, term string, qweight double")
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        best = lambda most: sorted(map(str, scoring.best_in_groups(asked, forward, "item_id", ["doc_id", "pack_id"], ["para_idx"], most).collect()))
        postings = forward.select("doc_id", "pack_id", "para_idx", F.explode("items").alias("i")).select("doc_id", "pack_id", "para_idx", "i.*")
        scores = asked.join(postings, "term").groupBy("item_id", "doc_id", "pack_id", "para_idx").agg(F.sum(F.col("weight") * F.col("qweight")).alias("score"))
        want = sorted(map(str, R.top1(scores, ["item_id", "doc_id", "pack_id"], ["para_idx"]).collect()))
        assert best(1000) == want and best(1) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
