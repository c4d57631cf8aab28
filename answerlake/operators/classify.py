"""Question classification into a closed taxonomy.

* ``classify_centroid``: per-label mean vector, cosine argmax, ``Other`` below a
  floor.  Centroids go to the tasks in blocks of bounded bytes.
* ``classify_terms``: TF-IDF of each question against the label texts.
* ``classify_with``, ``embed_with``, ``complete_with``: user model hooks over
  Arrow batches, with value and error per row; ``token_udf``: a user's token counter.
* ``alias_labels``: off-list labels mapped by a table.
* ``offtaxonomy``: labels outside the taxonomy (a model can answer off-list).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from answerlake.operators import retrieval as R
from answerlake.operators.tfidf import build_index, vectorize
from answerlake.sources.inline import OTHER, TAXONOMY, TEST_CATEGORY


def centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label: ``label, centroid ARRAY<DOUBLE>``.

    Exploding to (label, dim) and averaging keeps the aggregation partial and
    vectorised; the re-assembly groups only (#labels x dim) rows.
    """
    cells = vectors.select(label_col, F.posexplode(vec_col).alias("_d", "_x"))
    means = cells.groupBy(label_col, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return (means.groupBy(label_col)
            .agg(F.sort_array(F.collect_list(F.struct("_d", "_m"))).alias("_c"))
            .select(label_col, F.transform("_c", lambda s: s.getField("_m")).alias("centroid")))


#: Bytes of centroids that one pass over the vectors holds; more labels take more passes.
CENTROID_BYTES = 64 * 1024 * 1024


def _centroid_blocks(cents: DataFrame, label_col: str, max_bytes: int) -> Iterator[tuple[list[int], list[list[float]]]]:
    labels, rows, size = [], [], 0
    for r in cents.select(label_col, "centroid").orderBy(label_col).toLocalIterator():
        if rows and size + 8 * len(r[1]) > max_bytes:
            yield labels, rows
            labels, rows, size = [], [], 0
        labels.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1])
    if rows:
        yield labels, rows


def classify_centroid(vectors: DataFrame, cents: DataFrame, id_col: str = "vec_id",
                      vec_col: str = "embedding", label_col: str = "label",
                      min_score: float = 0.0, max_bytes: int = CENTROID_BYTES, names: DataFrame | None = None) -> DataFrame:
    """Nearest centroid by cosine; below ``min_score`` (or no score) -> ``Other``.

    Each pass holds a block of centroids of at most ``max_bytes`` as one matrix
    per vector length and keeps the best label of every vector, so vectors are
    neither joined nor shuffled.  Ties go to the smallest label.  A vector of a
    length that no centroid has, or of zero norm, has no score.  Labels are of
    any type.  ``names`` is a table (``label_col``, ``category``); without it
    whole numbers are positions in the taxonomy and other labels name
    themselves.  A label without a name is ``Other``.
    """
    types = {f.name: f.dataType for f in vectors.schema.fields}
    label_type = cents.schema[label_col].dataType
    whole = isinstance(label_type, T.IntegralType)
    label_type = T.LongType() if whole else label_type
    label_arrow = to_arrow_type(label_type)
    schema = T.StructType([T.StructField(id_col, types[id_col]), T.StructField(vec_col, types[vec_col]),
                           T.StructField("_label", label_type), T.StructField("score", T.DoubleType())])
    out = vectors.select(id_col, vec_col, F.lit(None).cast(label_type).alias("_label"), F.lit(None).cast("double").alias("score"))
    for labels, rows in _centroid_blocks(cents, label_col, max_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast((labels, rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, tuple[list, list]] = {}
            for name, row in zip(*shared.value):
                names, matrix = by_length.setdefault(len(row), ([], []))
                names.append(name)
                matrix.append(row)
            ready = {}
            for length, (names, matrix) in by_length.items():
                m = np.asarray(matrix, np.float64)
                ready[length] = (np.asarray(names), m, np.sqrt((m * m).sum(axis=1)))
            for rb in batches:
                vec = rb.column(1)
                best_label = rb.column(2).to_pylist()
                best_score = rb.column(3).to_pylist()
                sizes = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
                for length, (names, m, norms) in ready.items():
                    at = np.flatnonzero(sizes == length)
                    if not len(at) or not length:
                        continue
                    v = np.asarray(vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), length)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = (v @ m.T) / (np.sqrt((v * v).sum(axis=1))[:, None] * norms)
                    # a score that is no number loses to any; equal ones go to the smallest label
                    ranked = np.where(np.isnan(score), -np.inf, np.round(score, R.RANK_DIGITS))
                    top = ranked.argmax(axis=1)
                    for i, row, j in zip(range(len(at)), at.tolist(), top.tolist()):
                        if ranked[i, j] == -np.inf:
                            continue
                        old = best_score[row]
                        key = (-ranked[i, j], names[j])
                        if old is None or key < (-round(old, R.RANK_DIGITS), best_label[row]):
                            best_label[row], best_score[row] = (int(names[j]) if whole else names[j]), float(score[i, j])
                yield pa.RecordBatch.from_arrays([rb.column(0), vec, pa.array(best_label, label_arrow), pa.array(best_score, pa.float64())],
                                                 names=[id_col, vec_col, "_label", "score"])

        out = out.mapInArrow(run, schema)
    if names is not None:
        out = out.join(names.select(F.col(label_col).alias("_named"), F.col("category").alias("_name")), F.col("_label") == F.col("_named"), "left")
        label_name = F.col("_name")
    elif whole:
        # a position past the end of the taxonomy has no name
        label_name = F.get(F.array(*[F.lit(t) for t in TAXONOMY]), F.col("_label").cast("int"))
    else:
        label_name = F.col("_label").cast("string")
    keep = F.col("score").isNotNull() & (F.col("score") >= F.lit(min_score)) & label_name.isNotNull()
    return out.select(id_col, F.when(keep, label_name).otherwise(F.lit(OTHER)).alias("category"), F.col("score"))


def classify_terms(questions: DataFrame, labels: DataFrame, q_key: str, text_col: str = "text",
                   label_key: str = "label_id", label_text: str = "label") -> DataFrame:
    """Best-matching taxonomy label by TF-IDF cosine; no shared term -> ``Other``."""
    ix = build_index(labels.select(label_key, F.col(label_text).alias("text")), [label_key])
    post, idf = ix.postings, ix.idf
    qv = vectorize(questions.select(q_key, F.col(text_col).alias("text")), idf, [q_key])
    best = R.top1(R.sparse_scores(qv, post, [q_key], [label_key]), [q_key], [label_key])
    named = best.join(F.broadcast(labels), label_key)
    out = questions.select(q_key).join(named, q_key, "left")
    return out.select(q_key, F.coalesce(F.col(label_text), F.lit(OTHER)).alias("category"), "score")


def _hook(df: DataFrame, fn: Callable[[pd.Series], pd.Series], in_col: str, out_col: str, out_type: T.DataType) -> DataFrame:
    """Append ``out_col`` and ``<out_col>_error``.  ``fn`` maps a batch; when it
    fails, each row of the batch is tried alone, so one bad row costs only
    itself and says why."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, out_type), T.StructField(out_col + "_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                values, errors = list(fn(pdf[in_col])), [None] * len(pdf)
                if len(values) != len(pdf):
                    raise ValueError(f"{len(values)} results for {len(pdf)} rows")
            except Exception:  # noqa: BLE001 - a model failure is data, not a crash
                values, errors = [], []
                for i in range(len(pdf)):
                    try:
                        values.append(list(fn(pdf[in_col].iloc[i:i + 1]))[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        values.append(None)
                        errors.append(str(e))
            yield pdf.assign(**{out_col: pd.Series(values, index=pdf.index, dtype=object), out_col + "_error": errors})

    return df.mapInPandas(run, schema=schema)


def classify_with(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text_col: str = "text",
                  out_col: str = "category") -> DataFrame:
    """H1 / P25: user model hook from texts to labels; a failing row has a
    NULL label and its error beside it."""
    return _hook(df, fn, text_col, out_col, T.StringType())


def embed_with(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text_col: str = "text",
               out_col: str = "embedding") -> DataFrame:
    """H2: user embedding hook from texts to vectors, with the error beside."""
    return _hook(df, fn, text_col, out_col, T.ArrayType(T.DoubleType()))


def complete_with(df: DataFrame, fn: Callable[[pd.Series], pd.Series], prompt_col: str = "prompt",
                  out_col: str = "response") -> DataFrame:
    """H3: user completion hook from prompts (or request bodies) to answers,
    with the error beside."""
    return _hook(df, fn, prompt_col, out_col, T.StringType())


def token_udf(fn: Callable[[str], int]):
    """H4: a token counter of the user's as a column function; NULL stays NULL."""
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else int(fn(t))).astype("Int64")
    return count


def alias_labels(labelled: DataFrame, aliases: DataFrame, label_col: str = "category") -> DataFrame:
    """Off-list labels mapped to taxonomy ones by a table (alias, label);
    compared trimmed and without case, labels without an alias stay."""
    key = lambda c: F.lower(F.trim(c))
    known = aliases.select(key(F.col("alias")).alias("_alias"), F.col("label").alias("_label"))
    joined = labelled.join(known, key(F.col(label_col)) == F.col("_alias"), "left")
    return joined.withColumn(label_col, F.coalesce("_label", label_col)).drop("_alias", "_label")


def stub_category(df: DataFrame, out_col: str = "Category") -> DataFrame:
    """Test mode, constant category."""
    return df.withColumn(out_col, F.lit(TEST_CATEGORY))


def offtaxonomy(labelled: DataFrame, taxonomy_df: DataFrame, label_col: str = "category") -> DataFrame:
    """Labels outside taxonomy and ``Other``, with counts."""
    counts = labelled.groupBy(label_col).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(taxonomy_df.select(F.col("label").alias(label_col))), label_col, "left_anti")
