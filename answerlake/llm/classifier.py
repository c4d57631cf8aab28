"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document, standardised, go through random cosines whose inner
products approximate a Gaussian kernel. Each partition sums its part of the
normal equations; the small total is solved for ridge scores. A fold of its
own calibrates them: isotonic regression makes the score the share of good
documents among those scored alike.

Null and empty texts have all-zero statistics and a score like any other.
A document with several labels counts with their mean; labels without a
document, documents without a label and null labels teach nothing. Without any
label the score is 0.5. Repeated rows are scored alike, and their labels count
as often. Ties: documents of one raw score share a calibrated one. Very long
texts are measured whole. Standardised statistics are held within 8 deviations
and raw scores within -1 and 2, so that no single document sways the fit. The
columns added win over clashing ones. An empty table gives an empty result.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.llm import common

FEATURES = 160
#: Width of the kernel in standard deviations, ridge penalty for each row, bins of raw scores for the calibration.
WIDTH, RIDGE, BINS = 3.0, 1e-4, 1000
SEED = 7
STATISTICS = ("words", "word_length", "longest", "symbols", "capitals", "digits", "bangs", "stops", "commas", "lines",
              "distinct", "repeated_lines", "repeated_triples", "doubled", "beyond_ascii", "bars")

_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&<>@^~_=+", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` of a whole text; shares by word or by byte."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    raw, n = text.encode("utf-8", "surrogatepass"), len(words)
    size = len(raw)
    less = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = [x for x in text.split("\n") if x.strip()]
    triples = n - 2 - len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    return [float(np.log1p(n)), sum(map(len, words)) / n, float(np.log1p(max(map(len, words)))), less(_SYMBOLS), less(_CAPITALS), less(_DIGITS),
            raw.count(b"!") / n, raw.count(b".") / n, raw.count(b",") / n, float(np.log1p(len(lines))), len(set(words)) / n,
            1 - len(set(lines)) / len(lines), triples / n, sum(map(operator.eq, words, words[1:])) / n, (size - len(text)) / size, raw.count(b"|") / n]


def with_statistics(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    common.ready(docs.sparkSession)
    return common.add_columns(docs, [text_column], [T.StructField("stats", T.ArrayType(T.DoubleType()))],
                              lambda: lambda texts: [[statistics(t) for t in texts]], keep)


class Model:
    """Standardisation, random features, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 0, spread, 1.0)
        self.frequencies = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps_at, self.steps = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequencies + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps_at, self.steps), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to total / n, by pooling neighbours that are out of order; x ascending."""
    pools: list[list[float]] = []
    for t, w in zip(total, n):
        pools.append([t, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, w, k = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + w, pools[-1][2] + k]
    return np.concatenate([np.full(int(k), t / w) for t, w, k in pools])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def fit(rows: DataFrame, calibration: DataFrame) -> Model:
    """The model of rows (stats, y), calibrated on others of the same kind."""
    spark = common.ready(rows.sparkSession)
    moments = {r["i"]: r for r in rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    d = len(STATISTICS)
    model = Model(np.array([moments[i]["m"] if i in moments else 0.0 for i in range(d)]), np.array([moments[i]["s"] if i in moments else 1.0 for i in range(d)]))
    if not moments:
        return model
    shared = spark.sparkContext.broadcast(model)
    k = FEATURES + 2

    def sums(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                both = np.hstack([shared.value.features(_matrix(batch.column(0))), np.asarray(batch.column(1))[:, None]])
                total += both.T @ both
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    equations = np.zeros((k, k))
    for i, j, v in rows.select("stats", "y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        equations[i, j] = equations[j, i] = v
    n = equations[k - 2, k - 2]
    model.weights = np.linalg.solve(equations[:-1, :-1] + RIDGE * n * np.eye(k - 1), equations[:-1, -1])
    solved = spark.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.round(np.clip(solved.value.raw(_matrix(batch.column(0))), -1, 2) * BINS)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), batch.column(1)], names=["bin", "y"])

    bins = calibration.select("stats", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("t"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        at, total, count = (np.array([r[c] for r in bins], float) for c in ("bin", "t", "n"))
        model.steps_at, model.steps = at / BINS, isotonic(at, total, count)
    return model


def score(rows: DataFrame, model: Model, keep: list[str], threshold: float) -> DataFrame:
    """The kept columns of rows with ``stats``, with score and predicted."""
    shared = common.ready(rows.sparkSession).sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        def work(stats):
            s = shared.value.scores(np.array(stats, float))
            return [s.tolist(), (s >= threshold).astype(int).tolist()]
        return work

    return common.add_columns(rows, ["stats"], fields, make, keep)


def op7_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    rows = common.stored(with_statistics(docs, keep=["doc_id"]), "statistics")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = common.table(spark, sf_dir, "labels", "doc_id", "quality").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = common.stored(rows.filter(fold != 2).join(labels, "doc_id").select("stats", "y", fold.alias("fold")), "labelled")
    model = fit(known.filter("fold < 2"), known.filter("fold = 3"))
    out = score(rows, model, ["doc_id"], 0.7)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")
