"""Sparse cosine scoring of many questions against an index, per partition.

The SQL form (question postings join index postings on ``term``, sum per
(question, text)) materialises one row per shared (question, text, term):
with common words that is tens of millions of rows per few hundred questions,
all hash-aggregated and sorted again for top-1.  Here the index streams as
one row per text (its postings as an array, grouped without a shuffle since
postings are clustered by text) through an Arrow batch function that does
the same sums with numpy and emits only what the caller asks for:

* ``top1``: each batch's best text per question -> a tiny final aggregation;
* ``threshold``: every (question, text) scoring above the threshold;
* ``group_best``: each batch's best text per (question, group).

The question side is collected after a measured size check (like a broadcast
build side) and shipped with the task; a larger question set stays in the
tasks and is scored by the join on ``term``, so nothing grows without bound on
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_DIGITS = 9
MAX_QUESTION_POSTINGS = 1_000_000
#: Pairs of a question's and a text's posting that a task expands at a time, besides those of one text.
MAX_PAIRS = 4_000_000


def forward_index(postings: DataFrame, d_keys: Sequence[str]) -> DataFrame:
    """One row per text: ``d_keys..., items ARRAY<STRUCT<term, weight>>``."""
    return postings.groupBy(*d_keys).agg(F.collect_list(F.struct("term", "weight")).alias("items"))


class _Questions:
    """Question postings as CSR over the question vocabulary."""

    def __init__(self, pdf: pd.DataFrame, q_key: str):
        pdf = pdf.sort_values(["term", q_key], kind="stable")
        #: Ids in their own type; scores go by their positions.
        self.qids = np.asarray(pd.unique(pdf[q_key]))
        qpos = pd.Index(self.qids)
        self.vocab = pd.Index(pd.unique(pdf["term"]))
        tix = self.vocab.get_indexer(pdf["term"])
        self.ptr = np.zeros(len(self.vocab) + 1, dtype=np.int64)
        np.add.at(self.ptr, tix + 1, 1)
        self.ptr = np.cumsum(self.ptr)
        self.q = qpos.get_indexer(pdf[q_key]).astype(np.int64)
        self.w = pdf["qweight"].to_numpy(dtype=np.float64)


def _scores(batch: pa.RecordBatch, qs: _Questions):
    """``(row, question index, score)`` for every pair sharing a term."""
    items = batch.column("items")
    offsets = items.offsets.to_numpy()
    flat = items.flatten()
    terms = flat.field("term").to_numpy(zero_copy_only=False)
    w = flat.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)
    parent = np.repeat(np.arange(len(batch), dtype=np.int64), np.diff(offsets))
    tix = qs.vocab.get_indexer(terms)
    keep = tix >= 0
    parent, tix, w = parent[keep], tix[keep], w[keep]
    cnt = qs.ptr[tix + 1] - qs.ptr[tix]
    total = int(cnt.sum())
    if total == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    first = np.cumsum(cnt) - cnt
    idx = np.repeat(qs.ptr[tix] - first, cnt) + np.arange(total, dtype=np.int64)
    rows = np.repeat(parent, cnt)
    qi = qs.q[idx]
    val = np.repeat(w, cnt) * qs.w[idx]
    nq = len(qs.qids)
    key, inv = np.unique(rows * nq + qi, return_inverse=True)
    score = np.bincount(inv, weights=val)
    return key // nq, key % nq, score


def _parts(batch: pa.RecordBatch, qs: _Questions) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that expand to ``MAX_PAIRS`` pairs at most, or hold one text."""
    items = batch.column("items")
    tix = qs.vocab.get_indexer(items.flatten().field("term").to_numpy(zero_copy_only=False))
    pairs = np.r_[0, np.cumsum(np.where(tix >= 0, qs.ptr[tix + 1] - qs.ptr[tix], 0))]
    offsets = items.offsets.to_numpy()
    ends, at = pairs[offsets - offsets[0]], 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + MAX_PAIRS, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _kernel(qs: _Questions, d_keys: Sequence[str], q_key: str, mode: str,
            threshold: float | None, group_keys: Sequence[str], whole_groups: bool = False):
    out_names = [q_key, *d_keys, "score"]

    def codes(cols: list[np.ndarray]) -> list[np.ndarray]:
        return [pd.factorize(c, use_na_sentinel=False)[0] for c in cols]

    def best(qi: np.ndarray, keys: dict[str, np.ndarray], score: np.ndarray) -> np.ndarray:
        """The best row of each question and group, first by rounded score, then by the text keys."""
        part = [qi, *codes([keys[g] for g in group_keys])]
        order = np.lexsort([keys[k] for k in reversed(d_keys)] + [-np.round(score, RANK_DIGITS)] + list(reversed(part)))
        grp = np.stack([p[order] for p in part], axis=1)
        is_first = np.ones(len(order), dtype=bool)
        is_first[1:] = np.any(grp[1:] != grp[:-1], axis=1)
        return order[is_first]

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts lie sorted by group: only the last group of a slice can go on in the next."""
        held, held_of = None, None
        for batch in (part for whole in batches if whole.num_rows for part in _parts(whole, qs)):
            rows, qi, score = _scores(batch, qs)
            last = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group_keys)
            keys = {k: batch.column(k).take(pa.array(rows)) for k in d_keys}
            found = pa.table({"_q": pa.array(qi), **keys, "score": pa.array(score)})
            if held is not None:
                found = pa.concat_tables([held, found])
            num = {k: found.column(k).to_numpy() for k in d_keys}
            found = found.take(pa.array(best(found.column("_q").to_numpy(), num, found.column("score").to_numpy())))
            ends = np.ones(found.num_rows, bool)
            for g, v in zip(group_keys, last):
                col = found.column(g)
                ends &= (pc.is_null(col) if v is None else pc.fill_null(pc.equal(col, pa.scalar(v, col.type)), False)).to_numpy()
            held, done = found.filter(pa.array(ends)), found.filter(pa.array(~ends))
            yield from named(done)
        if held is not None:
            yield from named(held)

    def named(found: pa.Table) -> Iterator[pa.RecordBatch]:
        out = [pa.array(qs.qids[found.column("_q").to_numpy()]), *(found.column(k).combine_chunks() for k in [*d_keys, "score"])]
        if found.num_rows:
            yield pa.RecordBatch.from_arrays(out, names=out_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in _parts(whole, qs)):
            rows, qi, score = _scores(batch, qs)
            if len(rows) == 0:
                continue
            keys = {k: batch.column(k).to_numpy(zero_copy_only=False)[rows] for k in d_keys}
            if mode == "threshold":
                sel = score > threshold
            else:
                sel = best(qi, keys, score)
            cols = [pa.array(qs.qids[qi[sel]])] + [pa.array(keys[k][sel]) for k in d_keys] \
                + [pa.array(score[sel])]
            yield pa.RecordBatch.from_arrays(cols, names=out_names)

    return run_whole if whole_groups else run


def best_in_groups(qvec: DataFrame, forward: DataFrame, q_key: str, group_keys: Sequence[str], inner_keys: Sequence[str],
                   max_question_postings: int = MAX_QUESTION_POSTINGS) -> DataFrame:
    """The best text of each question and group: a group's texts are brought together before they are scored, so
    that the scores of each are compared where they are found and no losing one is shuffled."""
    from answerlake.operators.retrieval import top1
    spark = forward.sparkSession
    keys = [*group_keys, *inner_keys]
    if qvec.limit(max_question_postings + 1).count() > max_question_postings:
        return top1(score_index(qvec, forward, q_key, keys, "group_best", group_keys=group_keys, max_question_postings=max_question_postings), [q_key, *group_keys], inner_keys)
    # A number of one's own: texts expand to many scores, so sizes before do not tell how many tasks are wanted.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = forward.select(*keys, F.transform("items", lambda i: F.struct(i["term"].alias("term"), i["weight"].alias("weight"))).alias("items"))
    together = slim.repartition(n, *group_keys).sortWithinPartitions(*group_keys)
    return score_index(qvec, together, q_key, keys, "group_best", group_keys=group_keys, max_question_postings=max_question_postings, whole_groups=True)


def with_asked_terms(forward: DataFrame, qvec: DataFrame, d_keys: Sequence[str],
                     max_question_postings: int = MAX_QUESTION_POSTINGS) -> DataFrame:
    """A forward index with those items alone whose terms some question has: all that scoring uses, before it goes
    through a join.  Past the bound on questions it is returned as it is."""
    asked = qvec.select("term").distinct().limit(max_question_postings + 1).toArrow().column("term").combine_chunks()
    if len(asked) > max_question_postings:
        return forward
    slim = forward.select(*d_keys, "items")
    names = slim.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            flat = items.flatten()
            known = pc.is_in(flat.field("term"), value_set=asked).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy(zero_copy_only=False))[known]
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))]
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(known)))
            whole = pa.RecordBatch.from_arrays([*batch.columns[:-1], left], names=names)
            yield whole.filter(pa.array(np.diff(ends) > 0))

    return slim.mapInArrow(keep, slim.schema)


def score_index(qvec: DataFrame, forward: DataFrame, q_key: str, d_keys: Sequence[str], mode: str,
                threshold: float | None = None, group_keys: Sequence[str] = (),
                max_question_postings: int = MAX_QUESTION_POSTINGS, whole_groups: bool = False) -> DataFrame:
    """Score questions (``q_key, term, qweight``) against a forward index.

    Output ``q_key, d_keys..., score`` rows per ``mode`` (see module doc); for
    ``top1``/``group_best`` these are per-batch winners, or all scores past the
    bound, to be reduced by the caller with a partial-aggregating ``top1``.
    ``whole_groups``: every partition holds whole groups, sorted by group, and
    the winners are the last ones.
    """
    if mode == "group_best" and not group_keys:
        raise ValueError("group_best needs group_keys")
    spark = forward.sparkSession
    key_types = {f.name: f.dataType.simpleString() for f in forward.schema.fields}
    q_type = {f.name: f.dataType.simpleString() for f in qvec.schema.fields}[q_key]
    schema = ", ".join([f"{q_key} {q_type}"] + [f"{k} {key_types[k]}" for k in d_keys] + ["score double"])
    slim = qvec.select(q_key, "term", "qweight")
    # The size check and the collect are one job: at most bound + 1 rows come back.
    pdf = slim.limit(max_question_postings + 1).toPandas()
    if len(pdf) > max_question_postings:
        postings = forward.select(*d_keys, F.explode("items").alias("_i")).select(*d_keys, "_i.term", "_i.weight")
        scores = (slim.join(postings, "term").groupBy(q_key, *d_keys)
                  .agg(F.sum(F.col("weight") * F.col("qweight")).alias("score")).select(q_key, *d_keys, "score"))
        return scores.filter(F.col("score") > threshold) if mode == "threshold" else scores
    if pdf.empty:
        return spark.createDataFrame([], schema)
    fn = _kernel(_Questions(pdf, q_key), list(d_keys), q_key, mode, threshold, list(group_keys), whole_groups)
    return forward.select(*d_keys, "items").mapInArrow(fn, schema)
