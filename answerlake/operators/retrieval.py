"""Similarity retrieval.

Sparse: the named queries score with the Arrow batch kernel in
``operators/scoring.py``; ``sparse_scores`` here is the plain SQL form
(question postings join index postings on ``term``, sum per pair), kept as
the reference path and tested equal to the kernel.

Top-1 is an aggregation (``min`` of a struct ordered by score then position)
which Spark computes partially before the shuffle, so a question that matches
most of the corpus does not pile up in one task.  Top-k uses ``row_number``
with a ``<= k`` filter, which Spark plans as a per-partition group limit
before the shuffle.  Dense: ``dense_topk_candidates`` scores batches of
vectors against the size-checked question matrix with one matrix product;
``dense_distances`` gives the full distance table where one is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fallback of the original application when nothing is found.
NO_HIT_RESPONSE = "No suitable chunk found."
NO_HIT_FILENAME = "N/A"

# Scores are rounded this far before ranking so that float noise from
# different summation orders cannot reorder equal scores.
RANK_DIGITS = 9


def sparse_scores(qvec: DataFrame, postings: DataFrame, q_keys: Sequence[str],
                  d_keys: Sequence[str]) -> DataFrame:
    """V6: cosine of L2-normalised TF-IDF vectors = sum of weight products."""
    q = qvec.select(*q_keys, "term", "qweight")
    d = postings.select(*d_keys, "term", "weight")
    return (q.join(d, "term")
            .groupBy(*q_keys, *d_keys)
            .agg(F.sum(F.col("qweight") * F.col("weight")).alias("score")))


def top1(scores: DataFrame, q_keys: Sequence[str], d_keys: Sequence[str],
         score_col: str = "score") -> DataFrame:
    """R2: best text per question; ties go to the smallest ``d_keys``."""
    ranked = F.struct((-F.round(F.col(score_col), RANK_DIGITS)).alias("_neg"),
                      *[F.col(k) for k in d_keys], F.col(score_col))
    best = scores.groupBy(*q_keys).agg(F.min(ranked).alias("_b"))
    return best.select(*q_keys, *[F.col(f"_b.{k}").alias(k) for k in d_keys],
                       F.col(f"_b.{score_col}").alias(score_col))


def above_threshold(scores: DataFrame, threshold: float, score_col: str = "score") -> DataFrame:
    """R3 + P10: every text scoring strictly above ``threshold``."""
    return scores.filter(F.col(score_col) > F.lit(float(threshold)))


def with_fallback(questions: DataFrame, hits: DataFrame, q_keys: Sequence[str]) -> DataFrame:
    """Questions without a hit get the fixed response and file name."""
    out = questions.join(hits, list(q_keys), "left")
    missing = F.col("score").isNull()
    return (out.withColumn("response", F.when(missing, F.lit(NO_HIT_RESPONSE)))
            .withColumn("filename", F.when(missing, F.lit(NO_HIT_FILENAME)).otherwise(F.col("filename"))))


# ----------------------------------------------------------------- dense ----

def _norm(col: Column) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - a.b/(|a||b|)`` of two array columns; NULL for a zero norm."""
    return F.lit(1.0) - F.try_divide(_dot(a, b), _norm(a) * _norm(b))


def checked_broadcast_batches(df: DataFrame, key: str, max_rows: int) -> list[DataFrame]:
    """Split ``df`` into batches of at most ``max_rows`` rows for broadcasting.

    The row count is measured, not assumed; a small side stays one broadcast,
    a large one becomes several bounded broadcasts over hash buckets of ``key``.
    """
    n = df.count()
    if n <= max_rows:
        return [df]
    buckets = -(-n // max_rows) * 2  # headroom for uneven hashing
    tagged = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)))
    return [tagged.filter(F.col("_bucket") == b).drop("_bucket") for b in range(buckets)]


def dense_distances(queries: DataFrame, vectors: DataFrame, q_key: str = "qid",
                    q_vec: str = "qvec", v_key: str = "vec_id", v_vec: str = "embedding",
                    max_broadcast_rows: int = 200_000) -> DataFrame:
    """V7: cosine distance ``1 - a.b/(|a||b|)`` of every question to every vector.

    The vectors stream; the question side is broadcast after a measured size
    check (split into bounded batches beyond it).  Zero norms give NULL.
    """
    v = vectors.select(F.col(v_key), F.col(v_vec).alias("_v"), _norm(F.col(v_vec)).alias("_vn"))
    parts = []
    for batch in checked_broadcast_batches(queries.select(q_key, q_vec), q_key, max_broadcast_rows):
        q = batch.select(F.col(q_key), F.col(q_vec).alias("_q"), _norm(F.col(q_vec)).alias("_qn"))
        pairs = v.join(F.broadcast(q), how="cross")
        parts.append(pairs.select(
            q_key, v_key,
            (F.lit(1.0) - F.try_divide(_dot(F.col("_q"), F.col("_v")), F.col("_qn") * F.col("_vn")))
            .alias("distance")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dense_topk(distances: DataFrame, k: int, q_key: str = "qid", v_key: str = "vec_id",
               farthest: bool = False) -> DataFrame:
    """``k`` nearest vectors per question (smallest distance).

    ``farthest=True`` is the literal variant: keep ``distance > 0`` (drops exact
    matches and zero vectors) and sort descending, i.e. the least similar.
    """
    d = F.round(F.col("distance"), RANK_DIGITS)
    if farthest:
        distances = distances.filter(F.col("distance") > 0)
        order = [d.desc(), F.col(v_key).asc()]
    else:
        distances = distances.filter(F.col("distance").isNotNull())
        order = [d.asc(), F.col(v_key).asc()]
    w = Window.partitionBy(q_key).orderBy(*order)
    return (distances.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def dense_topk_candidates(queries: DataFrame, vectors: DataFrame, k: int, q_key: str = "qid",
                          q_vec: str = "qvec", v_key: str = "vec_id", v_vec: str = "embedding",
                          farthest: bool = False, max_broadcast_rows: int = 20_000) -> DataFrame:
    """Each Arrow batch of vectors is scored against all questions with one
    matrix product; per question only the batch's ``k`` best (plus ties at
    the k-th value) leave the task.  ``dense_topk`` on the result gives the
    exact top-k.  The question side is counted and split into bounded
    batches like a broadcast build side."""
    q_type = {f.name: f.dataType.simpleString() for f in queries.schema.fields}[q_key]
    v_type = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}[v_key]
    schema = f"{q_key} {q_type}, {v_key} {v_type}, distance double"
    parts = []
    for batch in checked_broadcast_batches(queries.select(q_key, q_vec), q_key, max_broadcast_rows):
        pdf = batch.toPandas()
        if pdf.empty:
            continue
        # a question meets the vectors of its own length; each length is a pass of its own
        for dim, same in pdf[pdf[q_vec].notna()].groupby(pdf[q_vec].dropna().map(len)):
            parts.append(_topk_pass(same, vectors, k, int(dim), q_key, q_vec, v_key, v_vec, farthest, schema))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _topk_pass(pdf, vectors: DataFrame, k: int, dim: int, q_key: str, q_vec: str, v_key: str, v_vec: str,
               farthest: bool, schema: str) -> DataFrame:
    """The batches' ``k`` best of the vectors of length ``dim`` for the questions of that length."""
    import numpy as np
    import pyarrow as pa
    qids = pdf[q_key].to_numpy()
    qm = np.stack(pdf[q_vec].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
    qn = np.sqrt((qm * qm).sum(axis=1))

    def run(batches, qm=qm, qn=qn, qids=qids, dim=dim):
        for rb in batches:
            col = rb.column(v_vec)
            ids = rb.column(v_key).to_numpy(zero_copy_only=False)
            lens = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            good = lens == dim
            if not good.all():  # ragged rows have no cosine with the questions
                starts = col.offsets.to_numpy()[:-1][good]
                flat = np.concatenate([flat[s:s + dim] for s in starts]) if len(starts) else flat[:0]
                ids = ids[good]
            if len(ids) == 0:
                continue
            vm = flat.reshape(len(ids), dim)
            vn = np.sqrt((vm * vm).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = 1.0 - (vm @ qm.T) / np.outer(vn, qn)
            r = np.round(dist, RANK_DIGITS)
            valid = (dist > 0) if farthest else ~np.isnan(dist)
            out_q, out_v, out_d = [], [], []
            for j in range(len(qids)):
                m = valid[:, j]
                if not m.any():
                    continue
                rj = r[m, j] if not farthest else -r[m, j]
                kth = np.partition(rj, min(k, len(rj)) - 1)[min(k, len(rj)) - 1]
                sel = np.flatnonzero(m)[rj <= kth]
                out_q.append(np.full(len(sel), qids[j]))
                out_v.append(ids[sel])
                out_d.append(dist[sel, j])
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)),
                     pa.array(np.concatenate(out_d))], names=[q_key, v_key, "distance"])

    return vectors.select(v_key, v_vec).mapInArrow(run, schema)
