"""Structured Streaming operators (ST1-ST6).

Sources are file streams over parquet tables of any number of files.  Each
micro-batch is reduced and written to a folder of its own below the output,
``epoch=<n>``, overwriting it: a batch that runs again after a failure replaces
its rows instead of adding them.  Output and checkpoint paths are the caller's,
so a restarted query resumes where it stopped.  Results over all batches come
from merging the reduced batches (first rows per key, latest full count), so
no row is lost for being late and no key's events meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.session import shared_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1000) -> DataFrame:
    """A parquet test table as a file stream (schema taken from the batch read).

    ``max_files`` bounds each micro-batch (and so the rows any stateful group
    sees at once) without turning a large folder into one micro-batch per file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern for this one name: the table may be a single file or a folder of part files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append",
                 batch_fn: Callable[[DataFrame], DataFrame] = lambda batch: batch, path: str | None = None) -> DataFrame:
    """Run a streaming query to completion (``availableNow``) and return what
    its batches wrote, reduced by ``batch_fn``, with their ``epoch``.

    ``path`` is the output folder, with the checkpoint beside it; calling again
    with the same path resumes after the last finished batch.  Without one a
    fresh folder is taken.
    """
    out = path or shared_path(spark, name)
    kept: list[T.StructType] = []

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch_fn(batch)
        kept.append(rows.schema)
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (df.writeStream.option("checkpointLocation", out.rstrip("/") + "-checkpoint").trigger(availableNow=True)
             .outputMode(mode).foreachBatch(write).start())
    query.awaitTermination()
    if not kept and not _exists(spark, out):
        # no batch so far: an empty table of the same columns
        write(spark.createDataFrame([], df.schema), -1)
    return spark.read.parquet(out)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest_epoch(table: DataFrame) -> DataFrame:
    """Of complete-mode results, the rows of the last batch."""
    last = table.agg(F.max("epoch").alias("epoch"))
    return table.join(F.broadcast(last), "epoch", "left_semi").drop("epoch")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """ST2/ST3: the first ``n`` rows of each key; a group limit before the
    shuffle splits a key with very many rows.  Applying it to every batch and
    again to all batches together gives the same rows as one batch would."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def scoreboard(votes: DataFrame, candidate_col: str = "candidate") -> DataFrame:
    """ST1: running vote count per candidate (complete mode)."""
    return votes.groupBy(candidate_col).agg(F.count("*").alias("votes"))
