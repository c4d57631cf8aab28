"""Paragraphs of text files read by byte ranges.

A file's lines are read in splits; no file is held as one row.  A separator is
``breaks`` line breaks in a row, counted from the left as splitting the whole
text does, so where a split's first separator ends depends on the breaks before
the split.  Each split states, for every number of breaks that may stand before
it, how many separators it has and how many breaks are open at its end; a fold
over the splits of a file (one row each) gives the number at every start.
Then each task cuts its lines into numbered parts, and the few parts that go
over an edge of a split are put together by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.session import stored
from answerlake.sources import storage


def _summaries(breaks: int):
    """(path, filename, split, size, bytes, found, open): for each number of open breaks at the start, separators and open breaks at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs, found, size = None, [], [], 0

        def row() -> pa.RecordBatch:
            values = (*at, size, found, runs)
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["path", "filename", "split", "size", "bytes", "found", "open"])

        for batch in batches:
            for *key, line in zip(*(batch.column(c).to_pylist() for c in ("path", "filename", "split", "size", "line"))):
                if key != at:
                    if at:
                        yield row()
                    at, runs, found, size = key, list(range(breaks)), [0] * breaks, 0
                size += len(line.encode()) + 1
                for k in range(breaks):
                    run_ = 1 if line else runs[k] + 1
                    if run_ == breaks:
                        found[k] += 1
                        run_ = 0
                    runs[k] = run_
        if at:
            yield row()
    return run


def _fold(splits: pa.Table) -> pa.Table:
    """Splits of one file in order: number of the first part, open breaks at the start, whether the last line has no break."""
    rows = sorted(splits.to_pylist(), key=lambda r: r["split"])
    unended = sum(r["bytes"] for r in rows) > rows[0]["size"]
    part = run = 0
    out = []
    for i, r in enumerate(rows):
        out.append((r["path"], r["split"], part, run, unended and i + 1 == len(rows)))
        part, run = part + r["found"][run], r["open"][run]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["f_path", "f_split", "part", "run", "unended"])


def _parts(breaks: int):
    """(path, filename, para_idx, split, edge, ended, text): the pieces of parts, line breaks included.

    ``edge`` pieces stand at the start or the end of their split and may have
    others; ``ended`` ones end in a separator.
    """
    names = ["path", "filename", "para_idx", "split", "edge", "ended", "text"]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows with whether they are the last of their split."""
        before = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "filename", "split", "line", "part", "run", "unended"))):
                if before:
                    yield *before, before[:3] != row[:3]
                before = row
        if before:
            yield *before, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[str] = []
        part = open_ = 0
        first = fresh = True
        for path, filename, split, line, number, run_, unended, last in lines(batches):
            if fresh:
                held, part, open_, first, fresh = [], number, run_, True, False
            open_ = 0 if line else open_
            if last and unended:
                held.append(line)
            else:
                held.append(line + "\n")
                open_ += 1
            if open_ == breaks:
                out.append((path, filename, part, split, first, True, "".join(held)))
                held, part, open_, first = [], part + 1, 0, False
            if last:
                out.append((path, filename, part, split, True, False, "".join(held)))
                fresh = True
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return run


def read_paragraphs(spark: SparkSession, path: str, breaks: int = 2, suffix: str | None = "*.txt", recursive: bool = False) -> DataFrame:
    """``filename, path, para_idx, text``: what splitting each whole file at ``breaks`` line breaks gives, empty parts included.

    ``suffix`` is a case-sensitive glob on the file name; ``recursive`` walks
    sub-folders without it.
    """
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    elif suffix:
        reader = reader.option("pathGlobFilter", suffix)
    meta = {"path": "file_path", "filename": "file_name", "split": "file_block_start", "size": "file_size"}
    lines = reader.text(path).select(*[F.col(f"_metadata.{m}").alias(n) for n, m in meta.items()], F.col("value").alias("line"))
    splits = lines.mapInArrow(_summaries(breaks), "path string, filename string, split long, size long, bytes long, found array<long>, open array<long>")
    starts = stored(splits.groupBy("path").applyInArrow(_fold, "f_path string, f_split long, part long, run int, unended boolean"), "text-splits")
    # One row a split: broadcast, so that lines stay in the order of their split.
    placed = lines.join(F.broadcast(starts), (F.col("path") == F.col("f_path")) & (F.col("split") == F.col("f_split")))
    pieces = stored(placed.select("path", "filename", "split", "line", "part", "run", "unended")
                    .mapInArrow(_parts(breaks), "path string, filename string, para_idx long, split long, edge boolean, ended boolean, text string"), "text-parts")
    whole = pieces.filter("NOT edge").select("filename", "path", "para_idx", "text", "ended")
    joined = (pieces.filter("edge").groupBy("filename", "path", "para_idx")
              .agg(F.sort_array(F.collect_list(F.struct("split", "text"))).alias("p"), F.max("ended").alias("ended"))
              .select("filename", "path", "para_idx", F.array_join("p.text", "").alias("text"), "ended"))
    cut = F.when(F.col("ended"), F.substring(F.col("text"), F.lit(1), F.length("text") - breaks)).otherwise(F.col("text"))
    out = whole.unionByName(joined).select("filename", "path", "para_idx", cut.alias("text"))
    empty = storage.empty_files(spark, path, suffix if not recursive else None, recursive)
    if empty:
        out = out.unionByName(spark.createDataFrame([(p.rsplit("/", 1)[1], p, 0, "") for p in empty], "filename string, path string, para_idx long, text string"))
    return out
