"""File sources: text folders, CSV, quoted question lists, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A question-list line: the question in double quotes, optional trailing comma.
QUOTED_LINE = r'(?s)\A"(.*)",?\z'


def scan_text_dir(spark: SparkSession, path: str, suffix: str = "*.txt", recursive: bool = False) -> DataFrame:
    """One row per file: ``filename, path, text`` (whole file, UTF-8).

    ``suffix`` is a case-sensitive glob on the file name (S1); ``recursive``
    walks sub-folders without a suffix filter (S2).
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    elif suffix:
        reader = reader.option("pathGlobFilter", suffix)
    df = reader.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("filename"),
                     F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv_header(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV with a header; values may hold doubled quotes, commas and line
    breaks.  Files are read by byte ranges; a leading BOM is dropped."""
    from answerlake.sources.split_csv import read_csv_splits
    return read_csv_splits(spark, path)


def read_csv_first_column(spark: SparkSession, path: str, out: str = "question") -> DataFrame:
    """Rows positional, first row is the header; column 0 is the text."""
    df = read_csv_header(spark, path)
    return df.select(F.col(df.columns[0]).alias(out), *df.columns[1:])


def read_question_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of quoted questions, one per line, trailing commas."""
    lines = spark.read.text(path)
    return (lines.select(F.regexp_extract("value", QUOTED_LINE, 1).alias("text"))
            .filter(F.col("text") != ""))


def read_jdbc_latest(spark: SparkSession, url: str, table: str, id_col: str = "id",
                     properties: dict | None = None) -> DataFrame:
    """Latest row by id from a database table.  The sort and the limit are
    part of the query that the database runs, so one row crosses the
    connection.  (Not run here: there is no database.)"""
    latest = f"(SELECT * FROM {table} ORDER BY {id_col} DESC LIMIT 1) latest"
    return spark.read.jdbc(url, latest, properties=properties or {})
