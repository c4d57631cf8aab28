"""TF-IDF index as postings tables.

Semantics follow the common vectoriser defaults: lower-case, terms are runs of
two or more word characters, smoothed IDF ``ln((1+N)/(1+df)) + 1`` where N is
the number of non-blank fitted texts, weights ``tf * idf`` L2-normalised per
text; terms unknown to the fitted vocabulary are dropped before normalising.

Plan shape: the index counts term frequencies in Arrow batches, questions
inside each row with array functions (sort, run starts), so no shuffle is needed to count them; the
document-frequency table is a partial aggregation on ``term``; the join of
term frequencies with IDF is left to AQE (broadcast when the vocabulary
proved small at runtime, sort-merge with skew splitting otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions.text import is_blank, terms


class Index(NamedTuple):
    """A fitted TF-IDF index: postings, vocabulary with IDF, the indexed texts
    (keys, kept columns, text), the number of fitted (non-blank) texts, the
    same postings as one row per text (``forward``, for batch scoring) and the
    raw term frequencies (``terms``: keys, term, tf)."""
    postings: DataFrame
    idf: DataFrame
    units: DataFrame
    n_fit: int
    forward: DataFrame | None = None
    terms: DataFrame | None = None


def _term_count_parts():
    s, st = F.col("_s"), F.col("_st")
    n = F.size(s)
    run_start = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (n > 0) & ((i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1))))))
    pairs = F.transform(
        st,
        lambda p, j: F.struct(
            F.try_element_at(s, p).alias("term"),
            (F.coalesce(F.try_element_at(st, j + 2), n + 1) - p).cast("bigint").alias("tf")))
    return run_start, pairs


def with_term_counts(units: DataFrame, keys: Sequence[str], text_col: str = "text",
                     keep: Sequence[str] = (), out: str = "items") -> DataFrame:
    """Add ``out ARRAY<STRUCT<term, tf>>`` (distinct terms, sorted) to each row.

    Spark finds the terms; each Arrow batch of them is numbered, sorted and
    counted at once.  A NULL text has none.
    """
    cols = [*keys, *keep]
    fields = [units.schema[c] for c in cols]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(cols))
            coded = found.flatten().dictionary_encode()
            # bytes decide the order, as in Spark
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), size)
            pair, tf = np.unique(row * max(len(order), 1) + rank[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            row, term = np.divmod(pair, max(len(order), 1))
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))]
            items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[term])), pa.array(tf.astype(np.int64))], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cols)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=[*cols, out])

    return units.select(*cols, terms(text_col).alias("_s")).mapInArrow(count, schema)


def term_frequencies(units: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keys..., term, tf`` rows, one per distinct term of each text."""
    run_start, pairs = _term_count_parts()
    return (units.select(*keys, F.array_sort(terms(text_col)).alias("_s"))
            .select(*keys, "_s", run_start.alias("_st"))
            .select(*keys, F.explode(pairs).alias("_t"))
            .select(*keys, F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf")))


def explode_terms(counted: DataFrame, keys: Sequence[str], items: str = "items") -> DataFrame:
    return (counted.select(*keys, F.explode(items).alias("_t"))
            .select(*keys, F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf")))


def weigh(tf: DataFrame, idf: DataFrame, keys: Sequence[str], weight_col: str = "weight") -> DataFrame:
    """Inner join on the vocabulary, ``tf * idf``, L2-normalise per text."""
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy(*keys)))
    return (tf.join(idf.select("term", "idf"), "term")
            .withColumn(weight_col, w / norm)
            .select(*keys, "term", "tf", weight_col))


def build_index(units: DataFrame, keys: Sequence[str], text_col: str = "text",
                keep: Sequence[str] = ()) -> Index:
    """Fit and transform the same texts in one pass over them.

    The texts with their in-row term counts are checkpointed to the cluster's
    shared checkpoint folder (lineage cut, survives executor loss); document
    frequencies, the fitted-text count, the index and text lookups are then
    all derived from that one materialisation.  The index is built as one
    row per text (``forward``: terms with tf and L2-normalised weight) by a
    single aggregation that needs no shuffle while the texts keep their
    partitioning; ``postings`` is its exploded view.
    """
    from answerlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(units.sparkSession)
    counted = with_term_counts(units.withColumn("_fit", ~is_blank(text_col)), keys, text_col,
                               keep=[*keep, text_col, "_fit"])
    counted = counted.checkpoint(eager=True)
    n_fit = counted.filter(F.col("_fit")).count()
    tf = explode_terms(counted, keys)
    # the vocabulary is read by the question side and by the index join:
    # materialise it once (it is small next to the postings)
    idf = (tf.groupBy("term").agg(F.count("*").alias("df"))
           .withColumn("idf", F.log(F.lit(1.0 + n_fit) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
           .checkpoint(eager=True))
    w = F.col("tf") * F.col("idf")
    grouped = (tf.join(idf.select("term", "idf"), "term")
               .groupBy(*keys)
               .agg(F.collect_list(F.struct("term", "tf", w.alias("w"))).alias("_it"),
                    F.sum(w * w).alias("_n2")))
    forward = grouped.select(*keys, F.transform(
        "_it", lambda x: F.struct(x.getField("term").alias("term"), x.getField("tf").alias("tf"),
                                  (x.getField("w") / F.sqrt(F.col("_n2"))).alias("weight"))).alias("items"))
    postings = (forward.select(*keys, F.explode("items").alias("_p"))
                .select(*keys, "_p.term", "_p.tf", "_p.weight"))
    return Index(postings, idf, counted.drop("items", "_fit"), n_fit, forward, tf)


def vectorize(texts: DataFrame, idf: DataFrame, keys: Sequence[str], text_col: str = "text",
              weight_col: str = "qweight") -> DataFrame:
    """V4: transform new texts (questions) with the fitted vocabulary."""
    return weigh(term_frequencies(texts, keys, text_col), idf, keys, weight_col)
