"""Spelling variants: k-d trees over letter-count vectors.

Words are counted over all texts. Two words are near if one inserted, deleted
or replaced code point makes one of the other. Such an edit moves the vector
of letter counts by L1 distance one (insertion, deletion) or two (replacement),
so for each pair of lengths (n, n) and (n, n + 1) the words of the second
length lie in k-d trees by vector, and every word of the first is searched in
them by range: subtrees whose box is farther away are pruned, what is left is
checked letter by letter.

The upper levels of each length's tree are split planes from a sample of at
most ``SAMPLE_WORDS`` words; they only say which leaf, and so which task, a
word is in, and every word is in exactly one. A word is sent to each leaf
whose region its range meets, so no length and no leaf goes through one task
as a whole. Within a leaf the tree goes on to ``BOX_WORDS`` words. Pairs are
summed to counts and best partners inside the leaf; only those are shuffled.

A word's form is its near word of largest count (ties: smallest in code-point
order), if that count is at least ``RATIO`` times its own. Roots follow forms
by pointer jumping; each step multiplies the count, so chains end.

Nulls and empty texts have no words; a null id is the empty text in the hash.
Repeated rows count each. Very long texts are read whole. Only the columns
named are read, clashing ones are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import common

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter, by hash.
TYPO_ONE_IN = 199
#: Words that the upper split planes are made from, words of an upper leaf, and of a box that is not split further.
SAMPLE_WORDS, LEAF_WORDS, BOX_WORDS = 100_000, 20_000, 48
#: Distinct words that a task counts before it sends them, and pairs that it compares at a time.
HELD_WORDS, HELD_PAIRS = 300_000, 100_000
#: a-z and U+00C0 to U+00FF, all that a word can hold.
DIMS = 26 + 64

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def run_word(doc_id: object, run: str) -> str:
    """The lower-cased run, without one letter where the hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % TYPO_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        lower: dict[str, tuple[str, bytes]] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            lower.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                runs = Counter(_RUN.findall(text.as_py() or ""))
                doc = doc_id.as_py()
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    if len(run) < min_letters:
                        continue
                    low = lower.get(run)
                    if low is None:
                        word = run.translate(_LOWER)
                        low = lower[run] = (word, word.encode())
                    word, data = low
                    h = zlib.crc32(data, start)
                    if h % TYPO_ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_letters:
                            continue
                    total[word] += n
                if len(total) >= HELD_WORDS or len(lower) >= HELD_WORDS:
                    yield sent()
        if total:
            yield sent()

    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- vectors, trees, pairs -------------------------------------------------------------------------------------------


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded with zeros, and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=1))
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width), sizes


def vectors(code: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    place = np.where(code < 0xC0, code.astype(np.int64) - 97, code.astype(np.int64) - 0xC0 + 26)
    out = np.zeros((len(code), DIMS), np.int32)
    for column in range(code.shape[1]):
        there = np.flatnonzero(code[:, column])
        out[there, place[there, column]] += 1
    return out


def split_plane(vec: np.ndarray) -> tuple[int, int] | None:
    """(dimension, largest value of the left side) that halves the rows best, None where all rows are equal."""
    best, found = len(vec), None
    for d in np.argsort(-vec.var(axis=0), kind="stable")[:8].tolist():
        values, n = np.unique(vec[:, d], return_counts=True)
        if len(values) > 1:
            left = np.cumsum(n)[:-1]
            i = int(np.argmin(np.abs(2 * left - len(vec))))
            if abs(2 * int(left[i]) - len(vec)) < best:
                best, found = abs(2 * int(left[i]) - len(vec)), (d, int(values[i]))
    return found


class Regions:
    """Upper levels of one length's tree: split planes from a sample; the leaves cover all of the space."""

    def __init__(self, vec: np.ndarray, leaf_rows: int):
        #: (dimension, value, left, right) of inner nodes, (-1, leaf, 0, 0) of leaves.
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self._grow(vec, leaf_rows)

    def _grow(self, vec: np.ndarray, leaf_rows: int) -> int:
        at = len(self.nodes)
        plane = split_plane(vec) if len(vec) > leaf_rows else None
        if plane is None:
            self.nodes.append((-1, self.leaves, 0, 0))
            self.leaves += 1
            return at
        self.nodes.append((0, 0, 0, 0))
        left = vec[:, plane[0]] <= plane[1]
        a = self._grow(vec[left], leaf_rows)
        b = self._grow(vec[~left], leaf_rows)
        self.nodes[at] = (*plane, a, b)
        return at

    def meeting(self, vec: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf whose region has a point within ``reach`` of the row; reach 0: the row's own leaf."""
        rows, leaves = [], []
        stack = [(0, np.arange(len(vec)), np.zeros(vec.shape, np.int32))]
        while stack:
            node, at, off = stack.pop()
            dim, value, left, right = self.nodes[node]
            if dim < 0:
                rows.append(at)
                leaves.append(np.full(len(at), value))
                continue
            for child, away in ((left, vec[at, dim] - value), (right, value + 1 - vec[at, dim])):
                # What a row lacks in one dimension is the larger of the planes' demands on either side, never both.
                far = off.copy()
                far[:, dim] = np.maximum(far[:, dim], away)
                near = far.sum(axis=1) <= reach
                if near.any():
                    stack.append((child, at[near], far[near]))
        return np.concatenate(rows), np.concatenate(leaves)


def one_edit(a: np.ndarray, b: np.ndarray, same_length: bool) -> np.ndarray:
    """Whether row i of ``b`` is row i of ``a`` with one letter replaced, or with one more letter."""
    if same_length:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_pairs(targets: np.ndarray, t_vec: np.ndarray, queries: np.ndarray, q_vec: np.ndarray, same_length: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, target row) of all pairs one edit apart: range searches in a k-d tree over the targets."""
    reach = 2 if same_length else 1
    stack = [(np.arange(len(targets)), np.arange(len(queries)))]
    while stack:
        t, q = stack.pop()
        low, high = t_vec[t].min(axis=0), t_vec[t].max(axis=0)
        v = q_vec[q]
        q = q[(np.maximum(low - v, 0) + np.maximum(v - high, 0)).sum(axis=1) <= reach]
        if not len(q):
            continue
        plane = split_plane(t_vec[t]) if len(t) > BOX_WORDS else None
        if plane is not None:
            left = t_vec[t, plane[0]] <= plane[1]
            stack += [(t[left], q), (t[~left], q)]
            continue
        # Box against queries, in pieces: a box of equal vectors may be large.
        step = max(1, HELD_PAIRS // len(t))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            i, j = np.nonzero(np.abs(q_vec[part][:, None, :] - t_vec[t][None, :, :]).sum(axis=2) == reach)
            i, j = part[i], t[j]
            good = one_edit(queries[i], targets[j], same_length)
            if good.any():
                yield i[good], j[good]


def _best(words: list[str], n: list[int], pairs: list[tuple[np.ndarray, np.ndarray]], of: int, other: tuple[list[str], list[int]]) -> dict[int, tuple[int, int, str]]:
    """For the rows of one side: number of partners, and count and word of the best one."""
    out: dict[int, tuple[int, int, str]] = {}
    for pair in pairs:
        for a, b in zip(pair[of].tolist(), pair[1 - of].tolist()):
            word, m = other[0][b], other[1][b]
            have = out.get(a)
            if have is None:
                out[a] = (1, m, word)
            else:
                better = m > have[1] or (m == have[1] and word < have[2])
                out[a] = (have[0] + 1, m if better else have[1], word if better else have[2])
    return out


def near_counts(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near word."""
    spark = vocabulary.sparkSession
    words = vocabulary.select("word", "n", F.length("word").alias("size"))
    # The sample decides about regions alone; lengths that it misses are one region.
    sample: dict[int, list[str]] = defaultdict(list)
    for r in words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).select("word", "size").toLocalIterator():
        sample[r["size"]].append(r["word"])
    total = {r["size"]: r["rows"] for r in words.groupBy("size").agg(F.count("*").alias("rows")).collect()}
    regions = {size: Regions(vectors(codes(sample[size])[0]) if sample[size] else np.zeros((0, DIMS), np.int32),
                             max(1, LEAF_WORDS * len(sample[size]) // rows)) for size, rows in total.items()}
    shared = spark.sparkContext.broadcast(regions)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word as a target in its own leaf, and as a query in every leaf that its range meets."""
        for batch in batches:
            by_size: dict[int, list[tuple[str, int]]] = defaultdict(list)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_size[len(word)].append((word, n))
            for size, same in by_size.items():
                vec = vectors(codes([w for w, _ in same])[0])
                for role, length, reach in (("t", size, 0), ("r", size, 2), ("i", size + 1, 1)):
                    if length in shared.value:
                        rows, leaves = shared.value[length].meeting(vec, reach)
                        keys = rows.tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), length), pa.int32()), pa.array(leaves, pa.int32()), pa.array([role] * len(keys)),
                             pa.array([same[k][0] for k in keys], pa.string()), pa.array([same[k][1] for k in keys], pa.int64())], names=["length", "leaf", "role", "word", "n"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        role, word, n = (table.column(c).to_pylist() for c in ("role", "word", "n"))
        side = {r: [i for i, x in enumerate(role) if x == r] for r in "tri"}
        pick = {r: ([word[i] for i in at], [n[i] for i in at]) for r, at in side.items()}
        out: list[tuple[str, int, int, str]] = []
        if pick["t"][0]:
            t_code = codes(pick["t"][0])[0]
            t_vec = vectors(t_code)
            for r in "ri":
                if pick[r][0]:
                    q_code = codes(pick[r][0])[0]
                    pairs = list(near_pairs(t_code, t_vec, q_code, vectors(q_code), r == "r"))
                    out += [(pick[r][0][a], *x) for a, x in _best(*pick[r], pairs, 0, pick["t"]).items()]
                    if r == "i":
                        out += [(pick["t"][0][a], *x) for a, x in _best(*pick["t"], pairs, 1, pick[r]).items()]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                        names=["word", "n_near", "best_n", "best"])

    routed = words.select("word", "n").mapInArrow(route, "length int, leaf int, role string, word string, n long")
    found = routed.groupBy("length", "leaf").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of each chain, by pointer jumping."""
    roots = common.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        # Only words whose root has a form itself move; when none does, all are at their ends.
        step = common.stored(roots.join(ahead, F.col("root") == F.col("a_word"), "left")
                             .select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")), "spelling-roots")
        if not step.filter("moved").head(1):
            return step.select("word", "root")
        roots = step.select("word", "root")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    common.ready(docs.sparkSession)
    vocabulary = common.stored(count_words(docs, id_column, text_column, min_letters, min_count), "spelling-words")
    near = near_counts(vocabulary).select(F.col("word").alias("w"), "n_near", "best_n", "best")
    named = F.col("best_n") >= ratio * F.col("n")
    words = common.stored(vocabulary.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, F.col("best")).alias("form"), F.when(named, F.col("best_n")).alias("form_n")),
        "spelling-forms")
    roots = follow(words.filter("form IS NOT NULL")).select(F.col("word").alias("w"), F.col("root").alias("r"))
    return words.join(roots, F.col("word") == F.col("w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("r", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.documents(spark, sf_dir, "doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE byte AS (
  SELECT i, list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda k: 0),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM byte),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, c, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
                                 lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS h
  FROM bytes, tab),
voc AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
holes AS (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM voc, unnest(range(1, length(word) + 1)) AS t(p)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION
  SELECT x.word, y.word, y.n FROM holes x JOIN voc y ON x.a || x.b = y.word
  UNION
  SELECT y.word, x.word, x.n FROM holes x JOIN voc y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
form AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 5 * v.n THEN (SELECT min(encode(r.other)) FROM near r WHERE r.word = v.word AND r.m = b.m) END AS f
  FROM voc v LEFT JOIN best b USING (word)),
forms AS (SELECT word, n, n_near, form_n, decode(f) AS form FROM form),
walk AS (
  SELECT word, form, 1 AS d FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT w.word, f.form, d + 1 FROM walk w JOIN forms f ON w.form = f.word WHERE f.form IS NOT NULL)
SELECT word, form, coalesce((SELECT arg_max(w.form, w.d) FROM walk w WHERE w.word = forms.word), word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms
"""
