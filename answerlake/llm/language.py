"""Language identification by unigram pieces, all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words, and the language
with the largest one is predicted. The probabilities come from expectation-
maximisation: expected piece counts by forward and backward sums over the
words of labelled documents.

Fitting reads about ``SAMPLE_DOCS`` documents of each language, drawn by a
hash of their id, whole texts. Predictions read every word of every text.

Null and empty texts, and texts without a letter (``str.isalpha``), are "und"
with score 0. Words are whole runs of letters, however long: the sums are
rescaled on the way. Letters outside the vocabulary have a small fixed
probability in every language. Ties go to the language that sorts first.
Repeated rows are judged alike. Very long texts are read whole, in time
proportional to their length. Without any labelled document everything is
"und". The columns added win over clashing ones. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language to fit on, in expectation.
SAMPLE_DOCS = 1500
ROUNDS = 3
#: Probability of a letter that is no piece, and imaginary occurrences of every piece.
UNKNOWN, SMOOTHING = 1e-7, 0.1
CACHED_WORDS = 250_000
#: Sums are divided by their own size every so many letters, so that words of any length stay within doubles.
RESCALE = 16
MARK = "▁"

_WORD = re.compile(r"[^\W\d_]+")


def parts(text: str) -> list[str]:
    """Lower-cased runs of letters, marked at their start."""
    words = _WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):
        # The pattern also takes numerals that are no decimal digits.
        words = [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return [MARK + w for w in words]


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the mark at the start."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and (p[p.startswith(MARK):].isalpha() or p == MARK))


class Lattice:
    """A dense trie over pieces, and sums over all segmentations of many words at a time."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        self.longest = max(map(len, pieces), default=1)
        index = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}, {}]
        ends = [-1, -1]
        for k, p in enumerate(pieces):
            node = 1
            for c in p:
                new = children[node].setdefault(index[c], len(children))
                if new == len(children):
                    children.append({})
                    ends.append(-1)
                node = new
            ends[node] = k
        # Node 0 is the dead end, node 1 the root; letter 0 is any letter without a piece.
        self.child = np.zeros((len(children), len(letters) + 1), np.int32)
        for node, edges in enumerate(children):
            for c, to in edges.items():
                self.child[node, c] = to
        self.piece = np.array(ends, np.int32)

    def encode(self, words: list[str]) -> np.ndarray:
        """Letter numbers of words of equal length."""
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.codes, raw), max(len(self.codes) - 1, 0))
        return np.where(self.codes[at] == raw, at + 1, 0) if len(self.codes) else np.zeros(raw.shape, np.int64)

    def steps(self, letters: np.ndarray):
        """(start, stop, piece of each word or -1), only where some word has a piece, and always for one letter."""
        n = letters.shape[1]
        for a in range(n):
            node = np.ones(len(letters), np.int32)
            for b in range(a, min(n, a + self.longest)):
                node = self.child[node, letters[:, b]]
                piece = self.piece[node]
                if b == a or (piece >= 0).any():
                    yield a, b + 1, piece
                elif not node.any():
                    break

    @staticmethod
    def weights(a: int, b: int, piece: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of the pieces; ``p`` ends in a row for letters that are none, and one of zeros."""
        return p[np.where(piece >= 0, piece, len(p) - 2 if b - a == 1 else len(p) - 1)]

    def forward(self, letters: np.ndarray, p: np.ndarray, steps=None) -> tuple[list, list]:
        """Sums over all segmentations up to each letter, and the logs that each is short of; all of them if ``steps`` are given, else the last."""
        n, keep = letters.shape[1], steps is not None
        shape = (len(letters), p.shape[1])
        alpha: list = [np.ones(shape), *[None] * n]
        logs: list = [None] * (n + 1)
        lack, at = np.zeros(shape), -1
        for a, b, piece in steps if keep else self.steps(letters):
            if a != at:
                if not keep and at >= 0:
                    alpha[at] = logs[at] = None
                at = a
                if a and a % RESCALE == 0:
                    size = alpha[a].copy()
                    for c in range(a, min(n, a + self.longest) + 1):
                        if alpha[c] is not None:
                            alpha[c] = alpha[c] / size
                    lack = lack + np.log(size)
                logs[a] = lack
            add = alpha[a] * self.weights(a, b, piece, p)
            alpha[b] = add if alpha[b] is None else alpha[b] + add
        logs[n] = lack
        return alpha, logs

    def log_sums(self, letters: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of each word."""
        alpha, logs = self.forward(letters, p)
        return np.log(alpha[-1]) + logs[-1]

    def expected(self, letters: np.ndarray, times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected count of each piece in words seen ``times`` (words x languages)."""
        steps = list(self.steps(letters))
        (alpha, logs), n = self.forward(letters, p, steps), letters.shape[1]
        total = np.log(alpha[n]) + logs[n]
        counts = np.zeros_like(p)
        beta: list = [None] * n + [np.ones_like(alpha[0])]
        lack, at = np.zeros_like(alpha[0]), n
        # A start's sums are whole once its first step has been met from behind: all steps that end there start before it.
        for a, b, piece in reversed(steps):
            if a != at and beta[at] is not None and at != n and at % RESCALE == 0:
                size = beta[at].copy()
                for c in range(at, min(n, at + self.longest) + 1):
                    beta[c] = beta[c] / size
                lack = lack + np.log(size)
            at = a
            w = self.weights(a, b, piece, p) * beta[b]
            share = alpha[a] * w * np.exp(logs[a] + lack - total) * times
            known = piece >= 0
            np.add.at(counts, piece[known], share[known])
            beta[a] = w if beta[a] is None else beta[a] + w
        return counts


def _by_length(words: list[str]) -> list[list[int]]:
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    return [g[k:k + max(1, min(4096, 65536 // size))] for size, g in sorted(groups.items()) for k in range(0, len(g), max(1, min(4096, 65536 // size)))]


def _with_unknown(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


class Model:
    """Piece probabilities by language."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.lattice, self.p = languages, Lattice(pieces), _with_unknown(p)

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        for group in _by_length(words):
            letters = self.lattice.encode([words[i] for i in group])
            out[group] = self.lattice.log_sums(letters, self.p)
        return out

    def scorer(self):
        """A function from texts to (language or "und", score) that remembers the words it has met."""
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__
        table = np.zeros((0, len(self.languages)))

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal table
            if len(known) > CACHED_WORDS:
                known.clear()
                table = table[:0]
            rows = [list(map(known.__getitem__, parts(t))) if t else [] for t in texts]
            if len(known) > len(table):
                new = list(known)[len(table):] if len(table) else list(known)
                table = np.vstack([table, self.word_scores(new)])
            out = []
            for ids in rows:
                if not ids or not self.languages:
                    out.append(("und", 0.0))
                    continue
                total = table[ids].sum(0)
                odds = np.exp(total - total.max())
                best = int(odds.argmax())
                out.append((self.languages[best], float(odds[best] / odds.sum())))
            return out

        return score


def word_counts(docs: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    """(lang, word, n) of whole texts."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                seen: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen[lang].update(parts(text))
                rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                                  pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])
    named = docs.select(F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text"))
    return named.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sampled(docs: DataFrame, id_column: str, lang_column: str, text_column: str, per_language: int, eligible: Column) -> DataFrame:
    """About ``per_language`` eligible documents of each language, those whose id hashes lowest."""
    able = docs.filter(eligible & F.col(f"`{lang_column}`").isNotNull() & F.col(f"`{text_column}`").isNotNull())
    sizes = able.groupBy(F.col(f"`{lang_column}`").alias("s_lang")).agg(F.count("*").alias("n")).collect()
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["s_lang"]), F.lit(min(1.0, per_language / r["n"])))]) if sizes else None
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(f"`{id_column}`")), F.lit(1 << 30)) / float(1 << 30)
    return able.filter(draw < share[F.col(f"`{lang_column}`")]) if sizes else able.limit(0)


def fit(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """The model of a sample of labelled documents; its words and counts stay in the shared folder."""
    spark = common.ready(docs.sparkSession)
    words = common.stored(word_counts(docs, lang_column, text_column), "language-words")
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    letters = {r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()}
    pieces = [p for p in vocabulary(path) if letters.issuperset(p)]
    if not languages or not pieces:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((languages, pieces, p))

        def run(batches, shared=shared):
            langs, known, p = shared.value
            lattice, p = Lattice(known), _with_unknown(p)
            number = {x: i for i, x in enumerate(langs)}
            counts = np.zeros_like(p)
            for batch in batches:
                lang, word, n = (batch.column(i).to_pylist() for i in range(3))
                for group in _by_length(word):
                    times = np.zeros((len(group), len(langs)))
                    times[np.arange(len(group)), [number[lang[i]] for i in group]] = [n[i] for i in group]
                    counts += lattice.expected(lattice.encode([word[i] for i in group]), times, p)
            piece, g = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(g, pa.int32()), pa.array(counts[piece, g])], names=["piece", "g", "n"])

        # One row for each piece and language of the fixed vocabulary.
        counts = np.full(p.shape, SMOOTHING)
        for k, g, n in words.mapInArrow(run, "piece int, g int, n double").groupBy("piece", "g").agg(F.sum("n").alias("n")).collect():
            counts[k, g] += n
        p = counts / counts.sum(0)
        shared.unpersist()
    # Pieces that no language uses only lengthen the sums.
    used = (counts.max(1) > SMOOTHING + 0.5) | (np.array(list(map(len, pieces))) == 1)
    return Model(languages, [x for x, u in zip(pieces, used) if u], p[used])


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score."""
    shared = common.ready(docs.sparkSession).sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        score = shared.value.scorer()

        def work(texts):
            found = score(texts)
            return [[x for x, _ in found], [s for _, s in found]]
        return work

    return common.add_columns(docs, [text_column], fields, make, keep)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(sampled(docs, "doc_id", "lang", "text", SAMPLE_DOCS, fold != 0))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
