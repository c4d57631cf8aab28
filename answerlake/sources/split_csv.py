"""Quoted CSV and TSV read by byte ranges (S3, S4, K1, K2), newlines inside quotes included.

A file's physical lines are read in splits.  Whether a line starts inside a
quoted value depends on the number of quotes before it: each split counts its
own, a prefix sum over the splits of a file (one row each) gives the parity at
every split's start, and each task then cuts its lines into records.  A record
that goes over the edge of a split comes out as pieces, which are put together
by the split it starts in.  Records are parsed by Spark's own CSV expression.

Quotes are doubled inside quoted values, so that parity holds for any text.
Lines end in ``\\n`` or ``\\r\\n``.  The first record of each file is its header;
names are those of the first file.  A byte-order mark before it is dropped.
Blank lines between records are passed over, as the CSV reader does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.session import stored


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and the split that they were read in; ``uid`` follows the order within a split."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits that each come in order -> (file, split, kind, text).

    ``whole``: a record; ``header``: the first one of a file; ``head``: what
    stands before the end of a record from an earlier split; ``all``: a split
    without any such end; ``tail``: the start of a record that goes on in the
    next split, ``header tail`` if it is the first of its file.
    """
    at, inside, kind, open_lines = None, False, "whole", []

    def flush() -> list[tuple]:
        if at is None or not open_lines:
            return []
        text = "\n".join(open_lines)
        return [(*at, ("all" if kind == "head" else "header tail" if kind == "header" else "tail") if inside else kind, text)]

    for batch in batches:
        out: list[tuple] = []
        for file, split, odd, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, split) != at:
                out += flush()
                at, inside, open_lines = (file, split), bool(odd), []
                kind = "head" if inside else "whole" if split else "header"
            open_lines.append(line)
            if line.count('"') % 2:
                inside = not inside
            if not inside:
                out.append((*at, kind, "\n".join(open_lines)))
                kind, open_lines = "whole", []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                         names=["file", "split", "kind", "text"])
    rest = flush()
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["file", "split", "kind", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(text): one row a CSV record, headers left out."""
    lines = _lines(spark, path)
    quotes = (F.length("line") - F.length(F.replace("line", F.lit('"'))))
    counts = lines.groupBy("file", "split").agg(F.sum(quotes.cast("long")).alias("quotes"))
    from pyspark.sql import Window as W
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    parity = stored(counts.select(F.col("file").alias("p_file"), F.col("split").alias("p_split"),
                                  (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("odd")), "csv-parity")
    # One row a split: broadcast, so that lines stay in the order of their split.
    marked = lines.join(F.broadcast(parity), (F.col("file") == F.col("p_file")) & (F.col("split") == F.col("p_split"))).select("file", "split", "odd", "line")
    cut = stored(marked.mapInArrow(_pieces, "file string, split long, kind string, text string"), "csv-records")
    # Pieces are few, two a split at most: a record's pieces share the split it starts in.
    parts = cut.filter("kind NOT IN ('whole', 'header')").withColumn("starts", F.col("kind").endswith("tail"))
    started = W.partitionBy("file").orderBy("split", "starts").rowsBetween(W.unboundedPreceding, 0)
    owned = parts.withColumn("start", F.max(F.when(F.col("starts"), F.col("split"))).over(started))
    joined = owned.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("split", "text"))).alias("p"), F.max(F.col("kind") == "header tail").alias("first")).filter("NOT first")
    return cut.filter("kind = 'whole'").select("text").unionByName(joined.select(F.array_join("p.text", "\n").alias("text")))


def header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names: the first record of the first file that has one."""
    rows = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    return rows.columns


def read_csv_splits(spark: SparkSession, path: str, sep: str = ",", null_value: str | None = None) -> DataFrame:
    """The rows of a CSV file or folder as strings, in any number of tasks."""
    names = header(spark, path, sep)
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": "" if null_value is None else null_value, "maxColumns": str(max(20480, len(names)))}
    text = F.regexp_replace(F.regexp_replace("text", "\\A\ufeff", ""), "\\r\\z", "")
    parsed = records(spark, path).select(text.alias("text")).filter("text <> ''").select(F.from_csv("text", schema, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
