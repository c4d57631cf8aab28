"""A TF-IDF index in segments (K5, S7): built once per input, extended without a rebuild.

``append`` counts the terms of new texts and writes them as a segment;
``delete`` writes tombstones; a segment counts only once the manifest that
names it is in place, which is one rename, so a crash before it changes
nothing and a replayed append of the same inputs adds nothing.  Document
frequencies of the segments are summed at read and those of deleted texts taken
off, so weights are those of one full build over the live texts.  ``compact``
rewrites the live texts as one segment.

    <path>/segments/<id>/{texts,forward,terms}   keys + kept columns, keys + term counts, term + df
    <path>/tombstones/<id>                       keys of deleted texts
    <path>/manifest/<version>.json               segments with their inputs, tombstones
    <path>/views/<version>/...                   what is derived from one version, written once

A tombstone deletes from the segments that were there when it was written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions.text import is_blank
from answerlake.operators.tfidf import with_term_counts
from answerlake.sources import storage

#: Stored bytes of term counts, about, that a task weighs at a time.
BLOCK_BYTES = 8 << 20
#: Bits of a text's number within its block.
BLOCK_BITS = 32
#: Compression of what is stored.
PACKED = "zstd"


class Manifest(NamedTuple):
    """One version of an index: segments in order, each {"id", "inputs"}; tombstones, each {"id", "keys", "segments"}."""
    version: int
    keys: list[str]
    segments: list[dict]
    tombstones: list[dict]


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest version, None before the first append."""
    versions = [n for n in storage.names(spark, f"{path}/manifest") if n.endswith(".json")]
    if not versions:
        return None
    return Manifest(**json.loads(storage.read_text(spark, f"{path}/manifest/{versions[-1]}")))


def _commit(spark: SparkSession, path: str, change: Callable[[Manifest | None], Manifest | None]) -> Manifest:
    """Put ``change`` of the newest version in place; tried again if another writer was first.  None changes nothing."""
    while True:
        old = manifest(spark, path)
        new = change(old)
        if new is None:
            return old
        new = new._replace(version=old.version + 1 if old else 0)
        if storage.write_new(spark, f"{path}/manifest/{new.version:08d}.json", json.dumps(new._asdict())):
            return new


def append(units: DataFrame, path: str, keys: Sequence[str], inputs: Sequence[str], text_col: str = "text", keep: Sequence[str] = ()) -> Manifest:
    """Add texts as a segment; ``inputs`` name what they come from, and inputs that the index has are not added again."""
    spark = units.sparkSession
    have = manifest(spark, path)
    if have and set(inputs) <= _inputs(have):
        return have
    name = uuid.uuid4().hex[:12]
    at = f"{path}/segments/{name}"
    units.select(*keys, *keep, F.col(text_col).alias("text")).write.option("compression", PACKED).parquet(f"{at}/texts")
    texts = spark.read.parquet(f"{at}/texts")
    counted = with_term_counts(texts.withColumn("_fit", ~is_blank("text")), keys, "text", keep=["_fit"])
    counted.write.option("compression", PACKED).parquet(f"{at}/forward")
    forward = spark.read.parquet(f"{at}/forward")
    terms = forward.select(F.explode("items.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms.write.parquet(f"{at}/terms")
    segment = {"id": name, "inputs": sorted(inputs), "n_fit": forward.filter("_fit").count()}

    def change(old: Manifest | None) -> Manifest | None:
        if old and set(inputs) <= _inputs(old):
            return None
        return Manifest(0, list(keys), [*(old.segments if old else []), segment], list(old.tombstones) if old else [])

    return _commit(spark, path, change)


def _inputs(m: Manifest) -> set[str]:
    return {i for s in m.segments for i in s["inputs"]}


def delete(which: DataFrame, path: str) -> Manifest:
    """Delete all live texts with these values of some of the key columns."""
    spark = which.sparkSession
    name = uuid.uuid4().hex[:12]
    which.distinct().write.parquet(f"{path}/tombstones/{name}")
    return _commit(spark, path, lambda old: old._replace(tombstones=[*old.tombstones, {"id": name, "keys": which.columns, "segments": [s["id"] for s in old.segments]}]))


def _segment(spark: SparkSession, path: str, m: Manifest, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/segments/{name}/{table}")


def _stones(m: Manifest, segment: str) -> list[dict]:
    return [t for t in m.tombstones if segment in t["segments"]]


def live(spark: SparkSession, path: str, m: Manifest, table: str, deleted: bool = False) -> DataFrame | None:
    """``forward`` or ``texts`` of all segments without the deleted texts, or those of the deleted ones alone."""
    out = None
    for s in m.segments:
        rows = _segment(spark, path, m, s["id"], table)
        for t in _stones(m, s["id"]):
            stone = spark.read.parquet(f"{path}/tombstones/{t['id']}")
            if deleted:
                gone = rows.join(stone, t["keys"], "left_semi")
                out = gone if out is None else out.unionByName(gone)
            rows = rows.join(stone, t["keys"], "left_anti")
        if not deleted:
            out = rows if out is None else out.unionByName(rows)
    return out


def view(spark: SparkSession, path: str, m: Manifest, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from one version: made by the first that asks, read by all others."""
    at = f"{path}/views/{m.version:08d}/{name}"
    if not storage.exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", PACKED).parquet(at)
    return spark.read.parquet(at)


def vocabulary(spark: SparkSession, path: str, m: Manifest) -> DataFrame:
    """(term, df, idf) over the live texts: the segments' counts summed, those of deleted texts taken off."""
    n_fit = sum(s["n_fit"] for s in m.segments)
    df = None
    for s in m.segments:
        part = _segment(spark, path, m, s["id"], "terms").select("term", "df")
        df = part if df is None else df.unionByName(part)
    gone = live(spark, path, m, "forward", deleted=True)
    if gone is not None:
        n_fit -= gone.filter("_fit").count()
        df = df.unionByName(gone.select(F.explode("items.term").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
    df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return df.withColumn("idf", F.log(F.lit(1.0 + n_fit) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def _weighted(spark: SparkSession, path: str, m: Manifest, idf: DataFrame) -> DataFrame:
    """One row a text: items with term, tf and idf, sorted by term; the length of its weights as ``norm``.

    Texts are dealt to blocks by their keys.  Each distinct term of a block,
    not each posting, meets the vocabulary, so a term that all texts have is
    one row a block there; a block then weighs its texts with its own terms.
    ``place`` numbers texts: within a block those with about as many terms are neighbours.
    """
    size = sum(storage.folder_bytes(spark, f"{path}/segments/{s['id']}/forward") for s in m.segments)
    blocks = max(spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    # A term has no blank in it: terms and counts travel as two short texts.
    numbers = F.array_join(F.col("items.tf").cast("array<string>"), " ")
    forward = live(spark, path, m, "forward").select(*m.keys, "items", F.pmod(F.xxhash64(*m.keys), F.lit(blocks)).alias("block")).filter(F.size("items") > 0)
    own = forward.select("block", F.explode("items.term").alias("term")).distinct().join(idf.select("term", "idf"), "term").select(F.col("block").alias("part"), "term", "idf")
    item = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("idf", T.DoubleType())])
    schema = T.StructType([*[forward.schema[k] for k in m.keys], T.StructField("items", T.ArrayType(item)), T.StructField("place", T.LongType()), T.StructField("norm", T.DoubleType())])
    sent = forward.select(*m.keys, F.array_join("items.term", " ").alias("terms"), numbers.alias("tfs"), "block")
    return sent.groupBy("block").cogroup(own.groupBy("part")).applyInArrow(_weigh(m.keys), schema)


def _weigh(keys: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Weights of one block's texts from its terms; texts with equal keys are one."""
    def weigh(texts: pa.Table, own: pa.Table) -> pa.Table:
        text = np.zeros(texts.num_rows, np.int64)
        for k in keys:
            code = texts.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            text = np.unique(text * (len(code.dictionary) + 1) + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        n = int(text.max()) + 1 if len(text) else 0
        first = np.zeros(n, np.int64)
        first[text[::-1]] = np.arange(len(text))[::-1]
        terms = pc.split_pattern(texts.column("terms").combine_chunks(), " ")
        parent = np.repeat(text, pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        tf = pc.split_pattern(texts.column("tfs").combine_chunks(), " ").flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
        term = own.column("term").combine_chunks()
        order = pc.sort_indices(term)
        term, idf = term.take(order), own.column("idf").combine_chunks().take(order).to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=term), -1).to_numpy(zero_copy_only=False)
        known = code >= 0
        parent, tf, code = parent[known], tf[known], code[known]
        order = np.argsort(np.bincount(parent, minlength=n), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        parent, first = rank[parent], first[order]
        at = np.lexsort((tf, code, parent))
        parent, tf, code = parent[at], tf[at], code[at]
        w = tf * idf[code]
        norm = np.sqrt(np.bincount(parent, w * w, minlength=n))
        ends = np.r_[0, np.cumsum(np.bincount(parent, minlength=n))]
        out = pa.StructArray.from_arrays([term.take(pa.array(code)), pa.array(tf), pa.array(idf[code])], names=["term", "tf", "idf"])
        rows = texts.select(list(keys)).take(pa.array(first))
        place = np.arange(n) + ((texts.column("block")[0].as_py() << BLOCK_BITS) if n else 0)
        rows = rows.append_column("items", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out))
        return rows.append_column("place", pa.array(place, pa.int64())).append_column("norm", pa.array(norm, pa.float64()))

    return weigh


class StoredIndex:
    """One version with the parts of an ``Index``; the vocabulary is written by the first that opens it, weights by the first that asks."""

    def __init__(self, spark: SparkSession, path: str, m: Manifest):
        self._at = spark, path, m
        self.idf = view(spark, path, m, "vocabulary", lambda: vocabulary(spark, path, m))
        self.units, self.n_fit = live(spark, path, m, "texts"), sum(s["n_fit"] for s in m.segments)
        counted = live(spark, path, m, "forward")
        self.terms = counted.select(*m.keys, F.explode("items").alias("p")).select(*m.keys, "p.term", "p.tf")

    @cached_property
    def weighted(self) -> DataFrame:
        """What is stored of the weights: few different idf pack far better than as many weights as postings."""
        spark, path, m = self._at
        return view(spark, path, m, "weighted", lambda: _weighted(spark, path, m, self.idf))

    @cached_property
    def forward(self) -> DataFrame:
        def weigh(i: Column) -> Column:
            return F.struct(i["term"].alias("term"), i["tf"].alias("tf"), (i["tf"] * i["idf"] / F.col("norm")).alias("weight"))

        return self.weighted.withColumn("items", F.transform("items", weigh))

    @cached_property
    def postings(self) -> DataFrame:
        keys = self._at[2].keys
        each = self.weighted.select(*keys, "norm", F.explode("items").alias("p"))
        return each.select(*keys, "p.term", "p.tf", (F.col("p.tf") * F.col("p.idf") / F.col("norm")).alias("weight"))


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The newest version as an index."""
    return StoredIndex(spark, path, manifest(spark, path))


def compact(spark: SparkSession, path: str) -> Manifest:
    """The live texts as one segment without tombstones; appended segments that come in meanwhile stay beside it."""
    m = manifest(spark, path)
    name = uuid.uuid4().hex[:12]
    at = f"{path}/segments/{name}"
    live(spark, path, m, "forward").write.parquet(f"{at}/forward")
    live(spark, path, m, "texts").write.parquet(f"{at}/texts")
    forward = spark.read.parquet(f"{at}/forward")
    forward.select(F.explode("items.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/terms")
    merged = {s["id"] for s in m.segments}
    one = {"id": name, "inputs": sorted(_inputs(m)), "n_fit": forward.filter("_fit").count()}

    def change(old: Manifest) -> Manifest | None:
        if old.tombstones != m.tombstones or not merged <= {s["id"] for s in old.segments}:
            return None  # texts were deleted meanwhile: this result is left unused
        return old._replace(segments=[one, *(s for s in old.segments if s["id"] not in merged)], tombstones=[])

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete segments, tombstones and views that the newest version does not use; the number of folders."""
    m = manifest(spark, path)
    used = {f"segments/{s['id']}" for s in m.segments} | {f"tombstones/{t['id']}" for t in m.tombstones} | {f"views/{m.version:08d}"}
    have = {f"{top}/{n}" for top in ("segments", "tombstones", "views") for n in storage.names(spark, f"{path}/{top}")}
    return sum(storage.remove(spark, f"{path}/{n}") for n in sorted(have - used))
