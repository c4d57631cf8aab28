"""Small control files and sizes on the shared storage, through the file system that Spark itself uses."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet, whole or not at all; False if another writer was first."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    # Renaming does not replace a file: of two writers one gets False.
    done = fs.rename(part, p)
    if not done:
        fs.delete(part, False)
    return done


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A name for the present content of input paths: every file with its length and time of change."""
    seen = []
    for path in paths:
        fs, p = _fs(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def empty_files(spark: SparkSession, path: str, glob: str | None, recursive: bool) -> list[str]:
    """Files without a byte, which the text reader passes over."""
    import fnmatch
    fs, p = _fs(spark, path)
    files = fs.listFiles(p, recursive)
    out = []
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and not name.startswith(("_", ".")) and (not glob or fnmatch.fnmatchcase(name, glob)):
            out.append(f.getPath().toString())
    return sorted(out)
