"""Substring dedup: a count-min sketch in front of an exact grouping of word windows.

A window is ``WINDOW`` consecutive words of one text. Words of every window
whose words also start elsewhere, in the same text or another, are removed.

First pass: each window is stood for by the place of its smallest ``GRAM``-word
piece, leftmost among equals. Equal windows have equal pieces at equal places
in them, so a window that starts twice has a piece that stands twice: counts
of pieces are never below counts of windows. Each partition counts pieces in a
sketch of two rows of cells that saturate at two; its non-zero cells are sent
by block and merged. Of the merged sketch only "two or more" is kept, a bitmap
of 2 ** (SKETCH_BITS - 2) bytes (32 MiB), the same at every size of the corpus:
that is all the driver collects and broadcasts. Fuller cells estimate more
windows as repeated and make the second pass longer; they lose none.

Second pass: windows estimated repeated get a digest of all their words (two
64-bit polynomial hashes over words' XXH3) and are grouped by it. A task first
groups the windows that it holds at a time and sends one of each group, so
that a passage in a third of all texts is a few rows a task. Texts without such
windows are finished there; of the others the spans come back by row number.

Nulls and blank texts have no words. Texts shorter than a window keep all.
Ties and repeated rows: equal rows repeat each other and lose every window.
Very long texts are read whole, as one slice of their task. The columns added
win over clashing ones. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from answerlake.llm import common

WINDOW = 35
#: Words of the piece that stands for a window.
GRAM = 8
#: Cells of a sketch row, as a power of two; there are two rows.
SKETCH_BITS = 27
_BLOCK_BITS = 16
#: Characters of the texts that a task turns into words at a time, and pieces counted before they are sent.
SLICE_CHARS, SKETCH_PIECES = 4_000_000, 2_000_000

_WORD = re.compile(rf"[^{common.BLANK}]+")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_PLACE = np.uint64((1 << 28) - 1)
_U64 = 1 << 64

Spans = list[tuple[int, int]]


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolling(w: np.ndarray, k: int, base: int) -> np.ndarray:
    """sum(w[i + j] * base ** j for j < k) modulo 2 ** 64 for every i."""
    n = len(w)
    up = np.cumprod(np.full(n, base, np.uint64))
    down = np.cumprod(np.full(n - k + 1, pow(base, -1, _U64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up)])
    return (sums[k:] - sums[:n - k + 1]) * down


def _smallest(keys: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every k neighbouring keys."""
    have = 1
    while 2 * have <= k:
        keys, have = np.minimum(keys[:-have], keys[have:]), 2 * have
    return np.minimum(keys[:len(keys) - (k - have)], keys[k - have:]) if k > have else keys


class Slice:
    """The words of some texts one after the other, and what stands for each window."""

    def __init__(self, texts: list[str | None], window: int, gram: int):
        self.tokens = [words(t) for t in texts]
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.first[-1])
        self.hashes = np.fromiter((h for t in self.tokens for h in map(xxhash.xxh3_64_intdigest, t)), np.uint64, n)
        #: Starts of windows that lie within one text, the place of the piece of each, and the pieces by place.
        self.starts = self.places = np.zeros(0, np.int64)
        self.pieces = np.zeros(0, np.uint64)
        if n >= window:
            text = np.repeat(np.arange(len(texts)), self.sizes)
            self.starts = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
            self.pieces = _mix(_rolling(self.hashes, gram, _BASES[0]))
            ordered = (self.pieces & ~_PLACE) | (np.arange(len(self.pieces), dtype=np.uint64) & _PLACE)
            self.places = (_smallest(ordered, window - gram + 1)[self.starts] & _PLACE).astype(np.int64)

    def standing(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place once, in order, and for each window the number of its place."""
        if not len(self.places):
            return self.places, self.places
        new = np.concatenate([[True], np.diff(self.places) != 0])
        return self.places[new], np.cumsum(new) - 1


def _cells(pieces: np.ndarray, bits: int) -> np.ndarray:
    """Two cells for each piece, numbered through both rows."""
    return np.concatenate([(_mix(pieces ^ np.uint64(seed)) >> np.uint64(64 - bits)) + np.uint64(row << bits) for row, seed in enumerate(_SEEDS)])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with about ``SLICE_CHARS`` characters each."""
    at, held, texts = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        held += len(texts[-1] or "")
        if held >= SLICE_CHARS or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at), texts
            at, held, texts = i + 1, 0, []


def sketch(docs: DataFrame, text_column: str, window: int = WINDOW, gram: int = GRAM, bits: int = SKETCH_BITS) -> DataFrame:
    """(block, cells): the merged sketch as bitmaps of cells that counted two or more; blocks without one are left out."""
    block_bits = min(bits, _BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(pieces: list[np.ndarray]) -> pa.RecordBatch:
            cells, n = np.unique(_cells(np.concatenate(pieces), bits), return_counts=True)
            blocks, at = np.unique(cells >> np.uint64(block_bits), return_index=True)
            small = (cells & np.uint64((1 << block_bits) - 1)).astype(np.uint16)
            edges = np.append(at, len(cells))
            part = lambda keep: [small[a:b][keep(n[a:b])].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int64)), pa.array(part(lambda c: c == 1), pa.binary()), pa.array(part(lambda c: c > 1), pa.binary())],
                                              names=["block", "once", "more"])

        held, size = [], 0
        for batch in batches:
            for _, texts in _slices(batch, text_column):
                s = Slice(texts, window, gram)
                held.append(s.pieces[s.standing()[0]])
                size += len(held[-1])
                if size >= SKETCH_PIECES:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block: one block of counters is held at a time."""
        block, counters = None, np.zeros(1 << block_bits, np.uint8)

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None and (counters > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(counters > 1).tobytes()], pa.binary())], names=["block", "cells"])

        for batch in batches:
            for number, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if number != block:
                    yield from done()
                    block = number
                    counters[:] = 0
                single = np.frombuffer(once, np.uint16)
                counters[single] = np.minimum(counters[single] + 1, 2)
                counters[np.frombuffer(more, np.uint16)] = 2
        yield from done()

    parts = docs.select(F.col(f"`{text_column}`")).mapInArrow(count, "block long, once binary, more binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, cells binary")


def _bitmap(merged: DataFrame, bits: int) -> np.ndarray:
    block_bits = min(bits, _BLOCK_BITS)
    out = np.zeros((2 << bits) >> 3, np.uint8)
    for row in merged.toLocalIterator():
        at = (row["block"] << block_bits) >> 3
        out[at:at + len(row["cells"])] = np.frombuffer(row["cells"], np.uint8)
    return out


def _estimated(pieces: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether each piece counted two or more in both rows of the sketch."""
    cells = _cells(pieces, bits)
    hit = (bitmap[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1
    return (hit[:len(pieces)] & hit[len(pieces):]).astype(bool)


def _spans(starts: np.ndarray, window: int) -> Spans:
    """Merged spans of words that windows from ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    gaps = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.r_[0, gaps + 1]].tolist(), (starts[np.r_[gaps, len(starts) - 1]] + window).tolist()))


def merged(spans: Spans) -> Spans:
    """Overlapping or touching spans as one."""
    out: Spans = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(tokens: list[bytes], spans: Spans) -> list[bytes]:
    out, done = [], 0
    for a, b in spans:
        out += tokens[done:a]
        done = b
    return [*out, *tokens[done:]]


def cut_text(text: str | None, tokens: list[bytes], spans: Spans) -> str | None:
    """The text without the words of ``spans``, a line break where they stood."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return "\n".join([*out, text[done:]])


def words_digest(text: str | None, tokens: list[bytes], spans: Spans) -> str:
    """Lowercase hex SHA-256 of the kept words, joined by one space."""
    return hashlib.sha256(b" ".join(_kept(tokens, spans))).hexdigest()


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def remove_repeats(docs: DataFrame, text_column: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = SKETCH_BITS, keep: list[str] | None = None,
                   result: Callable[[str | None, list[bytes], Spans], str | None] = cut_text, result_column: str = "kept_text") -> DataFrame:
    """Add n_words, n_removed, repeat_spans (word positions) and ``result(text, words, spans)`` to every row."""
    if not 0 < gram <= window or not 3 <= bits <= 40:
        raise ValueError("a piece has between one word and a window, a sketch row 2 ** 3 to 2 ** 40 cells")
    spark = common.ready(docs.sparkSession)
    added = ["n_words", "n_removed", "repeat_spans", result_column]
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row") if columns else F.struct(F.lit(0).alias("none")).alias("row")
    rows = docs.select(row, F.col(f"`{text_column}`").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(_bitmap(sketch(rows, "text", window, gram, bits), bits))
    schema = T.StructType([rows.schema["row"], T.StructField("uid", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("result", T.StringType())])
    arrow = to_arrow_schema(schema)

    def estimated(s: Slice) -> np.ndarray:
        """Starts of the windows whose pieces the sketch has twice or more."""
        places, number = s.standing()
        return s.starts[_estimated(s.pieces[places], shared.value, bits)[number]] if len(places) else s.starts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without an estimated window with their result, others with their text."""
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                s = Slice(texts, window, gram)
                at = np.searchsorted(estimated(s), s.first)
                waits = (at[1:] > at[:-1]).tolist()
                columns = {"uid": range(uid, uid + len(texts)), "text": [t if w else None for t, w in zip(texts, waits)], "n_words": s.sizes,
                           "result": [None if w else result(t, tokens, []) for t, tokens, w in zip(texts, s.tokens, waits)]}
                uid += len(texts)
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(columns[f.name], f.type) for f in arrow if f.name != "row")], schema=arrow)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One window of each group with its digest and no stop; and the spans that groups within the slice cover already."""
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                s = Slice(texts, window, gram)
                starts = estimated(s)
                uid = part.column("uid").to_numpy()
                one = _rolling(s.hashes, window, _BASES[0])[starts]
                two = _rolling(_mix(s.hashes ^ np.uint64(_SEEDS[0])), window, _BASES[1])[starts]
                order = np.lexsort((starts, two, one))
                one, two, starts = one[order], two[order], starts[order]
                same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                new = np.concatenate([[True], ~same])
                known = np.sort(starts[~new | np.concatenate([same, [False]])])
                cut = np.searchsorted(known, s.first)
                spans = [(u, a, b) for i, u in enumerate(uid.tolist()) if cut[i + 1] > cut[i] for a, b in _spans(known[cut[i]:cut[i + 1]] - s.first[i], window)]
                starts, one, two = starts[new], one[new].view(np.int64), two[new].view(np.int64)
                text = np.searchsorted(s.first, starts, "right") - 1
                u, a, b = (np.array(x, np.int64) for x in (zip(*spans) if spans else ([], [], [])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ((one, _mix((u ^ a).view(np.uint64)).view(np.int64)), (two, u), (uid[text], u),
                                                           ((starts - s.first[text]).astype(np.int32), a.astype(np.int32)), (np.zeros(len(starts), np.int32), b.astype(np.int32)))],
                    names=["h1", "h2", "uid", "at", "stop"])

    # Written once, so that the row numbers stay what they are; finished rows carry no text.
    judged = common.stored(rows.mapInArrow(judge, schema), "repeat-rows")
    waiting = judged.filter("result IS NULL AND text IS NOT NULL")
    sent = waiting.select("uid", "text").mapInArrow(send, "h1 long, h2 long, uid long, at int, stop int")
    twice = sent.withColumn("n", F.count("uid").over(W.partitionBy("h1", "h2"))).filter("n > 1 OR stop > 0")
    found = twice.groupBy("uid").agg(F.collect_list(F.when(F.col("stop") == 0, F.col("at"))).alias("more"),
                                     F.collect_list(F.when(F.col("stop") > 0, F.struct("at", "stop"))).alias("known")).withColumnRenamed("uid", "r_uid")
    joined = waiting.select("row", "uid", "text", "n_words").join(found.hint("shuffle_hash"), F.col("uid") == F.col("r_uid"), "left")

    def make():
        def work(texts, known, more):
            tokens = [words(t) for t in texts]
            spans = [merged([*((k["at"], k["stop"]) for k in a or ()), *_spans(np.array(b or (), np.int64), window)]) for a, b in zip(known, more)]
            return [[sum(b - a for a, b in s) for s in spans], [[{"start": a, "stop": b} for a, b in s] for s in spans],
                    [result(*x) for x in zip(texts, tokens, spans)]]
        return work

    fields = [T.StructField("n_removed", T.LongType()), T.StructField("repeat_spans", SPAN), T.StructField("result", T.StringType())]
    cut = common.add_columns(joined, ["text", "known", "more"], fields, make, ["row", "n_words"])
    whole = judged.filter("result IS NOT NULL OR text IS NULL").select("row", "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast(SPAN).alias("repeat_spans"), "result")
    out = whole.unionByName(cut)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], "n_words", "n_removed", "repeat_spans", F.col("result").alias(result_column))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    out = remove_repeats(docs, keep=["doc_id"], result=words_digest, result_column="kept_sha256")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, p, md5(list_aggregate(w[p:p + 34], 'string_agg', ' ')) AS g
  FROM d, unnest(range(1, len(w) - 33)) AS t(p) WHERE len(w) >= 35),
twice AS (SELECT r, p FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
cov AS (SELECT DISTINCT r, p + o AS i FROM twice, unnest(range(0, 35)) AS t(o)),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cov USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
