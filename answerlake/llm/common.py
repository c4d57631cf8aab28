"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from answerlake.session import ensure_checkpoint_dir, shared_path, ship_package

#: ASCII blanks that separate words, as a Java/RE2 character class body.
BLANK = r"\x20\x09-\x0D"
#: A word of the blank-separated kind.
WORD = rf"[^{BLANK}]+"
#: A word of letters, digits and everything beyond ASCII, in text whose A-Z are lower-cased already.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python task turns into objects at a time.
SLICE_ROWS = 256

_TABLES: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Shared folder known, package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def stored_here(names: list[str]) -> Iterator[None]:
    """Collect the tables that are stored within the block in ``names``."""
    at = len(_TABLES)
    try:
        yield
    finally:
        names += _TABLES[at:]
        del _TABLES[at:]


def release(spark: SparkSession, names: list[str] | None = None) -> int:
    """Delete stored tables, all so far by default; call it once the results built on them are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = _TABLES if names is None else names
    n = 0
    while names:
        path = jvm.org.apache.hadoop.fs.Path(names.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, also inside lambdas, within one row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add; its own columns win over clashing ones."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def add_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
                make: Callable[[], Callable[..., list[Sequence]]], keep: Sequence[str] | None = None) -> DataFrame:
    """Append ``fields`` computed in Arrow batches from the ``inputs`` columns.

    ``make()`` runs once in each task and returns a function from lists of
    input values (``SLICE_ROWS`` rows at most) to one list per field.
    ``keep`` are the columns passed through; all by default.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    passed = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                values = [part.column(passed.index(c)).to_pylist() for c in inputs]
                out = [pa.array(v, type=t) for v, t in zip(work(*values), types)]
                yield pa.RecordBatch.from_arrays([part.column(passed.index(c)) for c in kept] + out,
                                                 names=[*kept, *(f.name for f in fields)])

    return df.select(*[F.col(f"`{c}`") for c in passed]).mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def remember(*paths: str) -> None:
    """Tables written elsewhere that ``release`` is to delete as well."""
    _TABLES.extend(paths)
