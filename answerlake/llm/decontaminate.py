"""Benchmark decontamination: a generalised suffix automaton of the test items.

The normalised items become automata of word ids, one for each block of about
``BLOCK_WORDS`` words. Document words stream through them; the state knows the
longest piece of any item that ends at the current word. Wherever that length
reaches the window, the whole matched stretch is benchmark text. Items shorter
than the window count as one window.

Automata are built and used inside tasks, as flat integer arrays; neither they
nor items come to the driver. A filter of the items' neighbouring words, a
bitmap of 2 ** PAIR_BITS bits (16 MiB) whatever the benchmark, is merged from
all tasks and broadcast; only stretches of documents all of whose neighbours
pass it can hold a window, and only these go to the blocks. A fuller filter
sends more, it loses none. The stretches of a block are dealt into groups of
about ``GROUP_BYTES``; each group builds its automaton anew.

Nulls and texts without a word have no words: no hits, not contaminated.
Repeated rows are judged each for itself; items with equal ids count as one
item; items without a word or id match nothing. Ties: an item is listed once
however often it occurs. Very long texts are scanned whole. The columns added
win over clashing ones. An empty table gives an empty result; an empty
benchmark gives no hits.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.llm import common

WINDOW = 10
#: Words of one automaton, about; bytes of the stretches that one group scans, about.
BLOCK_WORDS, GROUP_BYTES = 500_000, 16 << 20
#: Bits of the filter of neighbouring words, as a power of two, and bits that are merged at a time.
PAIR_BITS, _PIECE_BITS = 27, 19
#: A document with a larger share of hit words goes as a whole; from others the hit spans are cut.
MAX_COVERAGE = 0.5

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items behind each window.

    States and edges are numbers in flat arrays; the edges of a state are a
    linked list, and found by (state, word).
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.length, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.word, self.to, self.after = array("i"), array("i"), array("i")
        self.edge: dict[int, int] = {}
        sequences = []
        for name, item in items:
            if item:
                ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item])
                sequences.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._mark(sequences)

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.first.append(-1)
        return len(self.link) - 1

    def _add(self, state: int, c: int, to: int) -> None:
        self.edge[state << 32 | c] = len(self.to)
        self.word.append(c)
        self.to.append(to)
        self.after.append(self.first[state])
        self.first[state] = len(self.to) - 1

    def _split(self, p: int, c: int) -> int:
        """The state reached from ``p`` by ``c`` that is exactly one word longer than ``p``."""
        q = self.to[self.edge[p << 32 | c]]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q])
        e = self.first[q]
        while e >= 0:
            self._add(copy, self.word[e], self.to[e])
            e = self.after[e]
        self.link[q] = copy
        while p >= 0 and (e := self.edge.get(p << 32 | c, -1)) >= 0 and self.to[e] == q:
            self.to[e] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if last << 32 | c in self.edge:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and p << 32 | c not in self.edge:
            self._add(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _mark(self, sequences: list[tuple[str, array]]) -> None:
        """Items of each window state, and short items that end in each state."""
        lengths = np.frombuffer(self.length, np.int32)
        order = np.argsort(lengths, kind="stable")[1:].tolist()
        #: The state of the last ``window`` words, where as many are matched.
        self.cut = array("i", [-1]) * len(lengths)
        for v in order:
            up = self.link[v]
            self.cut[v] = self.cut[up] if self.length[up] >= self.window else v if self.length[v] >= self.window else -1
        self.items: dict[int, set[str]] = defaultdict(set)
        ends: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for name, ids in sequences:
            v = 0
            for n, c in enumerate(ids, 1):
                v = self.to[self.edge[v << 32 | c]]
                if n >= self.window:
                    self.items[self.cut[v]].add(name)
            if len(ids) < self.window:
                ends[v].append((len(ids), name))
        #: Items shorter than a window that end in a state, for states that have some.
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        if ends:
            for v in order:
                own = (*self.short.get(self.link[v], ()), *ends.get(v, ()))
                if own:
                    self.short[v] = own

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged spans of hit words, the items with an occurring window, and the longest match."""
        spans: list[list[int]] = []
        found: set[str] = set()
        longest = v = length = 0
        edge, to, link, lengths = self.edge, self.to, self.link, self.length
        for i, word in enumerate(text):
            c = self.vocabulary.get(word)
            if c is None:
                v = length = 0
                continue
            e = edge.get(v << 32 | c)
            while e is None and v:
                v = link[v]
                length = lengths[v]
                e = edge.get(v << 32 | c)
            if e is not None:
                v, length = to[e], length + 1
            longest = max(longest, length)
            hit = 0
            if length >= self.window:
                hit = length
                found |= self.items[self.cut[v]]
            for size, name in self.short.get(v, ()):
                if size <= length:
                    hit = max(hit, size)
                    found.add(name)
            if hit:
                start = i - hit + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [tuple(s) for s in spans], found, longest


# --- the filter of neighbouring words --------------------------------------------------------------------------------


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _pair_cells(h: np.ndarray, bits: int) -> np.ndarray:
    """The cell of every word and its neighbour."""
    return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _single_cells(h: np.ndarray, bits: int) -> np.ndarray:
    """The cell of a word that is an item by itself."""
    return (h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - bits)


def _filter(items: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all items' cells: tasks send the pieces that they set bits in, which are merged by piece."""
    piece = min(bits, _PIECE_BITS)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for text in batch.column(0):
                h = _hashes(words(text.as_py()))
                for cell in (_single_cells(h, bits) if len(h) == 1 else _pair_cells(h, bits)).tolist() if len(h) else ():
                    block = held.get(cell >> piece)
                    if block is None:
                        block = held[cell >> piece] = np.zeros(1 << piece, bool)
                    block[cell & ((1 << piece) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(b).tobytes() for b in held.values()], pa.binary())], names=["piece", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros((1 << piece) >> 3, np.uint8)
        for part in table.column("bits"):
            out |= np.frombuffer(part.as_buffer(), np.uint8)
        return pa.table([table.column("piece").slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["piece", "bits"])

    out = np.zeros((1 << bits) >> 3, np.uint8)
    width = (1 << piece) >> 3
    for row in items.select("t").mapInArrow(cells, "piece int, bits binary").groupBy("piece").applyInArrow(merge, "piece int, bits binary").toLocalIterator():
        out[row["piece"] * width:(row["piece"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _passes(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 1


def stretches(tokens: list[bytes], bitmap: np.ndarray, bits: int, shortest: int, singles: bool) -> list[tuple[int, int]]:
    """Runs of words that may hold a window: ``shortest`` words at least whose neighbours all pass, or single words."""
    n = len(tokens)
    if not n:
        return []
    h = _hashes(tokens)
    inside = _passes(bitmap, _single_cells(h, bits)) if singles else np.zeros(n, bool)
    if n > 1 and shortest:
        ok = np.zeros(n + 1, np.int8)
        ok[1:n] = _passes(bitmap, _pair_cells(h, bits))
        turns = np.flatnonzero(np.diff(ok))
        starts, stops = turns[::2], turns[1::2] + 1
        long = stops - starts >= shortest
        for a, b in zip(starts[long].tolist(), stops[long].tolist()):
            inside[a:b] = True
    turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


# --- documents -------------------------------------------------------------------------------------------------------


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_STRETCH = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("words", T.BinaryType())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _matches(stretched: DataFrame, items: DataFrame, total: int, window: int, block_words: int, group_bytes: int) -> DataFrame:
    """(uid, s, i, m): spans, items and longest match of each row's stretches, by block and group."""
    blocks = max(1, -(-total // block_words))
    rows = stretched.select("uid", F.explode("stretches").alias("x")).select("uid", "x.at", "x.words")
    size = rows.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // group_bytes))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = items.select(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int").alias("block"), every(groups, "part"), "i", "t")
    right = rows.select(every(blocks, "block"), F.pmod(F.xxhash64("uid", "at"), F.lit(groups)).cast("int").alias("part"), "uid", "at", "words")
    schema = "uid long, s array<struct<start: long, stop: long>>, i array<string>, m long"

    def match(own: pa.Table, texts: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if texts.num_rows and own.num_rows:
            automaton = Automaton(((i.as_py(), words(t.as_py())) for i, t in zip(own.column("i"), own.column("t"))), window)
            for uid, at, text in zip(texts.column("uid"), texts.column("at"), texts.column("words")):
                spans, found, longest = automaton.scan(text.as_py().split(b" "))
                if longest:
                    start = at.as_py()
                    for column, value in zip(out, (uid.as_py(), [{"start": a + start, "stop": b + start} for a, b in spans], sorted(found), longest)):
                        column.append(value)
        types = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["uid", "s", "i", "m"])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(match, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", id_column: str = "item_id",
               item_column: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, group_bytes: int = GROUP_BYTES,
               pair_bits: int = PAIR_BITS, keep: list[str] | None = None) -> DataFrame:
    """Add n_words, leak_spans (word positions), leak_items (distinct item ids) and leak_longest to every row."""
    spark = common.ready(docs.sparkSession)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("leak_spans", SPAN),
              T.StructField("leak_items", T.ArrayType(T.StringType())), T.StructField("leak_longest", T.LongType())]
    items = benchmark.select(F.col(id_column).cast("string").alias("i"), F.col(item_column).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    n = F.regexp_count(common.lower_ascii(F.col("t")), F.lit(common.TERM)).cast("long")
    items = common.stored(items.withColumn("n", n).filter("n > 0"), "leak-items")
    facts = items.agg(F.sum("n").alias("total"), F.min(F.when(F.col("n") > 1, F.col("n"))).alias("least"), F.count_if(F.col("n") == 1).alias("single")).first()
    shortest, singles = min(window, facts["least"] or 0), facts["single"] > 0 or window == 1
    docs = common.without(docs, *(f.name for f in fields))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in fields}]
    shared = spark.sparkContext.broadcast(_filter(items, pair_bits))

    def make():
        number = [TaskContext.get().partitionId() << 33]

        def work(texts):
            out = [[], [], []]
            for text in texts:
                tokens = words(text)
                if window == 1:
                    found = [(0, len(tokens))] if tokens else []
                else:
                    found = stretches(tokens, shared.value, pair_bits, shortest, singles)
                number[0] += 1
                for column, value in zip(out, (number[0], len(tokens), [{"at": a, "words": b" ".join(tokens[a:b])} for a, b in found] or None)):
                    column.append(value)
            return out
        return work

    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row")
    marks = [T.StructField("uid", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("stretches", _STRETCH)]
    # Written once, so that the row numbers stay what they are; only rows with a stretch go further.
    whole = common.stored(common.add_columns(docs.select(row, F.col(f"`{text_column}`").cast("string").alias("text")), ["text"], marks, make, ["row"]), "leak-rows")
    marked = whole.filter("stretches IS NOT NULL")
    found = _matches(marked.select("uid", "stretches"), items, facts["total"] or 0, window, block_words, group_bytes)
    by_row = found.groupBy("uid").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("i")).alias("i"), F.max("m").alias("m")).withColumnRenamed("uid", "r_uid")

    def join():
        def work(spans, items, longest):
            joined = [_merged([(x["start"], x["stop"]) for x in s or ()]) for s in spans]
            return [[[{"start": a, "stop": b} for a, b in s] for s in joined], [sorted(set(i or ())) for i in items], [m or 0 for m in longest]]
        return work

    rows = marked.select("row", "uid", "n_words").join(by_row.hint("shuffle_hash"), F.col("uid") == F.col("r_uid"), "left")
    hit = common.add_columns(rows, ["s", "i", "m"], fields[1:], join, ["row", "n_words"])
    clean = whole.filter("stretches IS NULL").select("row", "n_words", F.array().cast(SPAN).alias("leak_spans"), F.array().cast("array<string>").alias("leak_items"), F.lit(0).cast("long").alias("leak_longest"))
    out = clean.unionByName(hit)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *(f.name for f in fields))


def hit_words() -> Column:
    return F.aggregate("leak_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans``, with a line break where they stood."""
    at = [m.span() for m in _TERM.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return "\n".join([*out, text[done:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", max_coverage: float = MAX_COVERAGE,
                 window: int = WINDOW) -> DataFrame:
    """Documents without their leaked spans; those over ``max_coverage`` go as a whole. Adds ``leak_cut`` (boolean)."""
    found = find_leaks(docs, benchmark, text_column, window=window)
    found = found.filter(~(hit_words() > F.lit(max_coverage) * F.col("n_words")))

    def make():
        def work(texts, spans):
            return [[cut_spans(t, [(x["start"], x["stop"]) for x in s]) if s else t for t, s in zip(texts, spans)]]
        return work

    kept = [c for c in found.columns if c not in (text_column, "n_words", "leak_items", "leak_longest")]
    out = common.add_columns(found, [text_column, "leak_spans"], [T.StructField("leak_text", T.StringType())], make, kept)
    order = [c for c in docs.columns]
    return out.select(*[F.col("leak_text" if c == text_column else f"`{c}`").alias(c) for c in order],
                      (F.size("leak_spans") > 0).alias("leak_cut"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.documents(spark, sf_dir, "doc_id", "text"), common.table(spark, sf_dir, "benchmark")
    found = find_leaks(docs, items, keep=["doc_id"])
    hits = found.withColumn("n_hit", hit_words())
    return hits.select("doc_id", "n_words", "n_hit", F.size("leak_items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", F.array_sort("leak_items")), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, list_aggregate(w[p:p + least(10, len(w)) - 1], 'string_agg', ' ') AS g
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT r, k, p, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') AS g
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(p) WHERE len(w) >= k),
hit AS (SELECT r, pos.k, p, item FROM pos JOIN win ON pos.k = win.k AND pos.g = win.g),
cov AS (SELECT r, count(DISTINCT p + o) AS n FROM hit, unnest(range(0, k)) AS t(o) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       coalesce(its.s, sha256('')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
