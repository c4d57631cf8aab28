"""Exact nearest vectors by groups around pivots.

Vectors are scaled to length one and grouped around their nearest pivot.  Of a
group the smallest and the largest distance to its pivot are kept.  By the
triangle inequality no vector of a group is nearer to a question than the
question's distance to the pivot less the largest one, or the smallest one less
it, and none is farther than both distances together.  A question first meets
the nearest groups (the farthest, for the literal variant) that hold ``k``
vectors; that gives a distance to beat, and then only groups whose bounds reach
it.  The result is that of comparing everything.

Pivots come from at most ``SAMPLE`` vectors by a hash, each chosen farthest
from those before: they bound what is broadcast (``PIVOTS`` vectors), every
vector is in one group, and only the bounds depend on the choice.  Questions
stay in the tasks.  A large group is dealt into parts of ``PART`` vectors, the
questions that meet it into parts of ``PART`` questions; each pair of parts is
one matrix product.  Vectors and questions of different lengths do not meet;
null and zero vectors have no distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.operators.retrieval import RANK_DIGITS
from answerlake.session import stored

PIVOTS, SAMPLE = 256, 4096
PART = 4096
#: Room for rounding in comparing bounds, which are distances between vectors of length one.
ROOM = 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec, dim) of vectors that have a direction."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return df.select(F.col(key).alias("key"), v.alias("vec")).withColumn("dim", F.size("vec")).filter(F.col("vec").isNotNull() & (norm > 0) & ~F.isnan(norm))


def pivots(vectors: DataFrame, count: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots of each vector length, each farthest from those before it among a sample by hash."""
    taken = vectors.withColumn("rank", F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("vec"), "key"))).filter(F.col("rank") <= sample)
    by_dim: dict[int, list] = {}
    for r in taken.select("dim", "vec").toLocalIterator():
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    out = {}
    for dim, rows in by_dim.items():
        unit = _unit(np.asarray(rows, np.float64))
        chosen, far = [0], np.full(len(unit), np.inf)
        # About the square root: groups and vectors of a group are then as many.
        for _ in range(min(count, max(1, round(len(unit) ** 0.5))) - 1):
            far = np.minimum(far, ((unit - unit[chosen[-1]]) ** 2).sum(axis=1))
            if far.max() <= ROOM:
                break
            chosen.append(int(far.argmax()))
        out[dim] = unit[chosen]
    return out


class Groups:
    """Vectors in groups; ``groups`` has their sizes and distances to the pivot, ``vectors`` one row a vector."""

    def __init__(self, vectors: DataFrame, v_key: str = "vec_id", v_vec: str = "embedding", count: int = PIVOTS, sample: int = SAMPLE):
        rows = _usable(vectors, v_key, v_vec)
        self.spark, self.v_key, self.key_type = vectors.sparkSession, v_key, vectors.schema[v_key].dataType.simpleString()
        self.pivots = self.spark.sparkContext.broadcast(pivots(rows, count, sample))
        pivot_of = self.pivots

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    d = _distances(_unit(_matrix(part.column("vec"), dim)), pivot_of.value[dim])
                    near = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])], names=["key", "vec", "dim", "pivot", "away"])

        grouped = rows.mapInArrow(assign, f"key {self.key_type}, vec array<double>, dim int, pivot int, away double")
        # Written once; sorted by group, so that a group is read by those that meet it.
        self.vectors = stored(grouped.repartition("dim", "pivot", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("dim", "pivot"), "vector-groups")
        self.groups = stored(self.vectors.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")), "vector-group-bounds")

    def bounds(self, questions: DataFrame, q_key: str, q_vec: str) -> DataFrame:
        """(q, qvec, dim, pivot, n, low, high): how near and how far the vectors of a group can be."""
        rows = _usable(questions, q_key, q_vec)
        pivot_of, q_type = self.pivots, questions.schema[q_key].dataType.simpleString()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim in pivot_of.value:
                        part = batch.filter(pa.array(dims == dim))
                        d = _distances(_unit(_matrix(part.column("vec"), dim)), pivot_of.value[dim])
                        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("dim"), pa.array(list(d), pa.list_(pa.float64()))], names=["q", "dim", "d"])

        measured = rows.mapInArrow(measure, f"q {q_type}, dim int, d array<double>").select("q", "dim", F.posexplode("d").alias("pivot", "d"))
        low = F.greatest(F.col("d") - F.col("most"), F.col("least") - F.col("d"), F.lit(0.0))
        return measured.join(F.broadcast(self.groups), ["dim", "pivot"]).select("q", "dim", "pivot", "n", low.alias("low"), (F.col("d") + F.col("most")).alias("high"))

    def compare(self, meet: DataFrame, questions: DataFrame, k: int, farthest: bool) -> DataFrame:
        """(q, key, distance): of every part of a group the ``k`` best of each question that meets it, and ties of the last."""
        q_type = questions.schema["q"].dataType.simpleString()
        parts = F.ceil(F.col("n") / PART).cast("int")
        sizes = self.groups.select("dim", "pivot", parts.alias("v_parts"))
        asked = meet.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("q_parts"))
        plan = F.broadcast(stored(sizes.join(asked, ["dim", "pivot"]), "group-parts"))
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = (meet.join(plan, ["dim", "pivot"]).join(questions, "q").withColumn("q_part", deal("q", "q_parts"))
                .select("dim", "pivot", "q_part", all_of("v_parts").alias("v_part"), "q", "qvec"))
        right = (self.vectors.join(plan, ["dim", "pivot"]).withColumn("v_part", deal("key", "v_parts"))
                 .select("dim", "pivot", all_of("q_parts").alias("q_part"), "v_part", "key", "vec"))
        v_type = self.key_type
        out_types = pa.schema([("q", _arrow(left, "q")), ("key", _arrow(right, "key")), ("distance", pa.float64())])

        def best(key: tuple, asks: pa.Table, has: pa.Table) -> pa.Table:
            dim = key[0].as_py()
            if not asks.num_rows or not has.num_rows:
                return out_types.empty_table()
            qm, vm = _matrix(asks.column("qvec").combine_chunks(), dim), _matrix(has.column("vec").combine_chunks(), dim)
            dist = 1.0 - (qm @ vm.T) / np.outer(np.sqrt((qm * qm).sum(axis=1)), np.sqrt((vm * vm).sum(axis=1)))
            rank = np.round(dist, RANK_DIGITS)
            rank = np.where(dist > 0, -rank, np.inf) if farthest else rank
            last = np.partition(rank, min(k, vm.shape[0]) - 1, axis=1)[:, min(k, vm.shape[0]) - 1]
            i, j = np.nonzero((rank <= last[:, None]) & np.isfinite(rank))
            return pa.table([asks.column("q").take(pa.array(i)), has.column("key").take(pa.array(j)), pa.array(dist[i, j])], schema=out_types)

        on = ["dim", "pivot", "q_part", "v_part"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best, f"q {q_type}, key {v_type}, distance double")

    def topk(self, questions: DataFrame, k: int, q_key: str = "qid", q_vec: str = "qvec", farthest: bool = False) -> DataFrame:
        """``k`` nearest vectors of each question with their rank; ties go to the smallest key."""
        found, _ = self.search(questions, k, q_key, q_vec, farthest)
        return found

    def search(self, questions: DataFrame, k: int, q_key: str = "qid", q_vec: str = "qvec", farthest: bool = False) -> tuple[DataFrame, DataFrame]:
        """The result, and (question, visited, groups): how many groups each question met."""
        asked = stored(_usable(questions, q_key, q_vec).select(F.col("key").alias("q"), F.col("vec").alias("qvec")), "questions")
        bounds = stored(self.bounds(asked, "q", "qvec"), "question-bounds")
        order = F.col("high").desc() if farthest else F.col("low").asc()
        before = W.partitionBy("q").orderBy(order, "dim", "pivot").rowsBetween(W.unboundedPreceding, -1)
        # The literal variant passes over vectors at distance zero: its first groups may hold less than k.
        first = stored(bounds.withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("had") < k).select("q", "dim", "pivot"), "first-groups")
        one = stored(self.compare(first, asked, k, farthest), "first-distances")
        rank = F.round("distance", RANK_DIGITS)
        nth = F.row_number().over(W.partitionBy("q").orderBy((rank.desc() if farthest else rank.asc()), "key"))
        kth = one.withColumn("nth", nth).filter(F.col("nth") == k).select("q", F.col("distance").alias("beat"))
        # Between vectors of length one, distance squared is twice the cosine distance.
        reach = F.sqrt(F.greatest(F.col("beat"), F.lit(0.0)) * 2)
        open_ = F.col("beat").isNull() | ((F.col("high") >= reach - ROOM) if farthest else (F.col("low") <= reach + ROOM))
        rest = stored(bounds.join(first, ["q", "dim", "pivot"], "left_anti").join(kth, "q", "left").filter(open_).select("q", "dim", "pivot"), "other-groups")
        every = one.unionByName(self.compare(rest, asked, k, farthest))
        found = every.withColumn("rank", nth).filter(F.col("rank") <= k).select(F.col("q").alias(q_key), F.col("key").alias(self.v_key), "distance", "rank")
        visited = first.unionByName(rest).groupBy("q").agg(F.count("*").alias("visited"))
        report = bounds.groupBy("q").agg(F.count("*").alias("groups")).join(visited, "q").select(F.col("q").alias(q_key), "visited", "groups")
        return found, report


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows of length one."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[name].dataType)

