"""Files read by byte ranges: quoted CSV and paragraphs against whole-file reading, logs to the character."""

import csv
import random

import pytest

from answerlake.sinks import writers
from answerlake.sources import files, split_csv, split_text


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that edges fall everywhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size: int):
        for n in names:
            spark.conf.set(n, str(size))

    yield put
    for n, v in before.items():
        spark.conf.set(n, v)


def nasty(r: random.Random) -> str:
    return "".join(r.choice(['"', '""', ",", "\n", "\r\n", "a", "é", " ", "\t", "x y", "漢", "\\"]) for _ in range(r.randrange(0, 9)))


@pytest.mark.parametrize("size", [19, 150, 10_000])
def test_csv_by_ranges_is_the_csv_module(spark, small_splits, tmp_path, size):
    r = random.Random(size)
    want = []
    for f in range(2):
        rows = [[str(i), nasty(r), nasty(r)] for i in range(18)]
        with open(tmp_path / f"part-{f}.csv", "w", newline="", encoding="utf-8-sig" if f == 0 else "utf-8") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n", quoting=csv.QUOTE_ALL)
            w.writerows([["id", "te\nxt", "more"], *rows])
        want += [tuple(x or None for x in row) for row in rows]
    small_splits(size)
    got = files.read_csv_header(spark, str(tmp_path))
    assert got.columns == ["id", "te\nxt", "more"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_one_large_file_is_read_by_several_tasks(spark, small_splits, tmp_path):
    """200 MB in one file, values with line breaks; a record over each edge."""
    line = '"{i}","' + 'some words, a ""quoted"" one\nand a second line ' * 40 + '"\n'
    with open(tmp_path / "big.csv", "w") as out:
        out.write("id,text\n")
        for at in range(0, 100_000, 1000):
            out.write("".join(line.replace("{i}", str(i)) for i in range(at, at + 1000)))
    assert (tmp_path / "big.csv").stat().st_size > 180_000_000
    small_splits(16 << 20)
    assert split_csv._lines(spark, str(tmp_path / "big.csv")).rdd.getNumPartitions() >= 8
    rows = files.read_csv_header(spark, str(tmp_path / "big.csv"))
    r = rows.selectExpr("count(*) AS n", "count(DISTINCT id) AS ids", "min(length(text)) AS low", "max(length(text)) AS high").first()
    assert (r["n"], r["ids"]) == (100_000, 100_000) and r["low"] == r["high"]


LOG = [("1", "", None, " lead"), ("2", None, "", "trail "), ("3", "\\N", "\\\\N", "a\tb"), ("4", '"', 'say ""it""', "line\nbreak\r\nand\rmore"), ("5", " ", "\\N x", "N"), ("6", "é", "\t", '\\"')]


@pytest.mark.parametrize("size", [11, 10_000])
def test_logs_keep_every_character(spark, small_splits, tmp_path, size):
    df = spark.createDataFrame(LOG, "id string, Query string, `Retrieved Text` string, Response string")
    path = str(tmp_path / "log")
    writers.append_log_tsv(df.repartition(2), path)
    writers.append_log_tsv(df.limit(2), path)
    small_splits(size)
    got = writers.read_log_tsv(spark, path)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [*LOG, *LOG[:2]]))


def test_rewritten_csv_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([("1", " lead"), ("2", "trail "), ("3", 'a "b", c'), ("4", None)], "id string, text string")
    writers.rewrite_csv(df, str(tmp_path / "out.csv"))
    assert sorted(map(str, map(tuple, files.read_csv_header(spark, str(tmp_path / "out.csv")).collect()))) == sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("size,breaks", [(3, 2), (5, 3), (16, 1), (10_000, 2)])
def test_paragraphs_by_ranges_are_the_split_file(spark, small_splits, tmp_path, size, breaks):
    r = random.Random(4)
    texts = ["", "\n\n", "\n", "\n\n\n", "a\n\n\nb", "a\n\nb\n\n", "a\n\nb\n", "\n\n\n\n\n", "no break", "é\n\n漢\n\n\n\nend"]
    texts += ["".join(r.choice(["\n", "\n\n", "a", "word", "é"]) for _ in range(25)) for _ in range(2)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    (tmp_path / "skip.TXT").write_text("not\n\nread")
    small_splits(size)
    got = {}
    for x in split_text.read_paragraphs(spark, str(tmp_path), breaks).collect():
        got.setdefault(x["filename"], {})[x["para_idx"]] = x["text"]
    assert {f: [p[i] for i in range(len(p))] for f, p in got.items()} == {f"{i}.txt": t.split("\n" * breaks) for i, t in enumerate(texts)}


def test_recursive_paragraphs(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.md").write_text("one\n\ntwo")
    (tmp_path / "y.txt").write_text("three")
    rows = {(r["filename"], r["para_idx"], r["text"]) for r in split_text.read_paragraphs(spark, str(tmp_path), recursive=True).collect()}
    assert rows == {("x.md", 0, "one"), ("x.md", 1, "two"), ("y.txt", 0, "three")}
