"""Exact term retrieval that scores only ranges that can matter.

Texts are numbered so that those with about as many terms are neighbours:
``FINE`` of them are a fine range, ``COARSE`` a coarse one.  A term's postings
within a coarse range are a block with the largest weight in it as its bound;
the largest weight within a fine range follows from the block.  No text of a
range can score more with a question than the sum of question weight times
bound over their shared terms.

For top-1 each question first scores the texts of its most promising coarse
ranges, which gives a score to beat, then the most promising fine ranges within
the coarse ones whose bounds reach it, which raises it; then only fine ranges
whose bounds reach that are scored.  For a threshold the threshold
is what bounds have to reach.  Results are those of scoring everything.

Blocks lie in buckets by term, as many as their bytes ask for, each dealt over
several files by range.  Those of the questions' terms are dealt to shards of
neighbouring ranges, and a shard finds bounds and scores of its ranges at once:
what is shuffled are the blocks and what is found, never the pairs of a question
and a range or posting between.  Questions go to the tasks in sets of counted
size, one set after the other, and keys are of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.operators import retrieval as R
from answerlake.operators import segments
from answerlake.operators.tfidf import vectorize
from answerlake.session import shared_path, stored
from answerlake.sources import storage

#: Texts of a fine and of a coarse range, and coarse ranges of a shard, as powers of two.
FINE, COARSE, SHARD = 4, 8, 2
#: Coarse ranges that a question scores first, and fine ranges that it scores next.
SEEDS, NEXT = 2, 8
#: Bytes of a bucket's postings, about, and files of a bucket.
BUCKET_BYTES, SPREAD = 32 << 20, 4
#: Distinct terms of a question set that are broadcast, at most (a few megabytes).
BROADCAST_TERMS = 100_000
#: Terms of questions that go to the tasks at a time, about.
QUESTION_POSTINGS = 500_000
#: Postings that become blocks at a time, and meetings of a block and a question that a task expands at a time.
MAX_POSTINGS, MAX_PAIRS = 1_000_000, 500_000
#: Bounds are compared with this much room for sums in another order; ranks round to 9 digits.
ROOM = 1e-8


class Blocks:
    """The published tables of one version of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = m = segments.manifest(spark, path)
        index = segments.open_index(spark, path)
        self.idf, self.texts, self.keys = index.idf, index.units, m.keys
        at = f"{path}/views/{m.version:08d}"
        #: Texts with their numbers and lengths.
        self.places = index.weighted.select(*self.keys, "place", "norm")
        # What is stored of the weights takes about half the bytes of a bucket's postings.
        self.buckets = max(1, -(-2 * storage.folder_bytes(spark, f"{at}/weighted") // BUCKET_BYTES))
        self.blocks_at = f"{at}/blocks"
        if not storage.exists(spark, f"{self.blocks_at}/_SUCCESS"):
            blocks = self._blocks(index.weighted).write.mode("overwrite").option("compression", segments.PACKED)
            blocks.partitionBy("bucket").parquet(self.blocks_at)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _blocks(self, weighted: DataFrame) -> DataFrame:
        """(bucket, term, coarse, bound, at, tf): where in the range the term's texts are, and how often they have it."""
        buckets = F.transform("items.term", lambda t: F.pmod(F.xxhash64(t), F.lit(self.buckets)).cast("int"))
        # Blocks travel packed: a row of its own takes several times a block's bytes.
        rows = weighted.select("place", "norm", "items", buckets.alias("buckets")).mapInArrow(_gather(COARSE, MAX_POSTINGS, self.buckets * SPREAD), "part int, blocks binary")
        return rows.groupBy("part").applyInArrow(_unpack, "bucket int, term string, coarse long, bound float, at array<smallint>, tf array<int>")

    def question_terms(self, questions: DataFrame, q_keys: Sequence[str], text_col: str) -> DataFrame:
        """(q, term, qweight): ``q`` is a struct of the question's keys."""
        qv = vectorize(questions.select(*q_keys, F.col(text_col).alias("text")), self.idf, tuple(q_keys))
        return stored(qv.select(F.struct(*q_keys).alias("q"), "term", "qweight").withColumn("bucket", self.bucket()), "question-terms")

    def buckets_of(self, terms: DataFrame) -> list[int]:
        """Buckets that some question has a term in; at most ``buckets`` numbers."""
        return [r["bucket"] for r in terms.select("bucket").distinct().collect()]

    def table(self, at: str, needed: list[int]) -> DataFrame:
        return self.spark.read.parquet(at).filter(F.col("bucket").isin(needed)).drop("bucket")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows sorted by ``keys``."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, at, np.bincount(at, value, minlength=len(keys))


_BLOCK = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("coarse", pa.int64()), ("bound", pa.float32()), ("at", pa.list_(pa.int16())), ("tf", pa.list_(pa.int32()))])


def _pack(blocks: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(blocks)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Table) -> pa.Table:
    """The blocks of a part, those of a term one after the other."""
    blocks = pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in packed.column("blocks")])
    return blocks.take(pc.sort_indices(blocks.select(["term", "coarse"]), sort_keys=[("term", "ascending"), ("coarse", "ascending")]))


def _gather(coarse_bits: int, most: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the postings of neighbouring texts, packed by part, a bucket's share of ranges; a range that goes over the end of a batch has two blocks a term."""
    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = batch.column("items")
        flat = items.flatten()
        term = flat.field("term").dictionary_encode()
        code = term.indices.to_numpy(zero_copy_only=False)
        size = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        place, norm = (np.repeat(batch.column(c).to_numpy(), size) for c in ("place", "norm"))
        bucket = np.empty(len(term.dictionary), np.int32)
        bucket[code] = batch.column("buckets").flatten().to_numpy(zero_copy_only=False)
        tf, idf = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("tf", "idf"))
        weight = tf * idf / norm
        # Blocks of a term one after the other: they pack well on their way.
        order = np.lexsort((place, code))
        code, place = code[order], place[order]
        start = _starts(place >> coarse_bits, code)
        ends = pa.array(np.r_[start, len(code)], pa.int32())
        tf, weight = tf[order], weight[order]
        # A text that was given twice has a term twice, and scores with both.
        text = _starts(place, code)
        most_in = np.maximum.reduceat(np.add.reduceat(weight, text), np.searchsorted(text, start))
        bound = np.nextafter(most_in.astype(np.float32), np.float32(np.inf))  # not below any text's weight
        at = (place & ((1 << coarse_bits) - 1)).astype(np.int16)
        coarse, bucket = place[start] >> coarse_bits, bucket[code[start]]
        whole = pa.RecordBatch.from_arrays(
            [pa.array(bucket), term.dictionary.take(pa.array(code[start])), pa.array(coarse), pa.array(bound),
             pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], schema=_BLOCK)
        spread = parts // SPREAD
        part = bucket + spread * ((coarse + (coarse >> (segments.BLOCK_BITS - coarse_bits))) % SPREAD)
        order = np.argsort(part, kind="stable")
        whole, part = whole.take(pa.array(order)), part[order]
        edges = np.r_[_starts(part), len(part)]
        packed = [_pack(whole.slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column("items")).to_numpy(zero_copy_only=False))]
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
                if ends[stop] > ends[at]:
                    yield blocks(batch.slice(at, stop - at))
                at = stop

    return run


class _Asked:
    """A set of questions by the numbers of terms and questions."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["tn", "qn"], kind="stable")
        tn = rows["tn"].to_numpy()
        self.qns = np.unique(rows["qn"].to_numpy())
        self.tns, first = np.unique(tn, return_index=True)
        self.idf = rows["idf"].to_numpy()[first]
        self.ptr = np.r_[first, len(tn)]
        self.q = np.searchsorted(self.qns, rows["qn"].to_numpy())
        self.weight = rows["qweight"].to_numpy()

    def terms(self, blocks: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The blocks of this set's terms, and which term each is of."""
        tn = blocks.column("tn").to_numpy()
        code = np.minimum(np.searchsorted(self.tns, tn), max(len(self.tns) - 1, 0))
        own = self.tns[code] == tn if len(self.tns) else np.zeros(len(tn), bool)
        return blocks.filter(pa.array(own)), code[own]

    def meet(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, question, question weight) of every question that has the term of a row."""
        n = self.ptr[term + 1] - self.ptr[term]
        at = _runs(self.ptr[term], n)
        return np.repeat(np.arange(len(term)), n), self.q[at], self.weight[at]

    def range_bounds(self, coarse: np.ndarray, term: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coarse, question, most): what a question can score at most in each coarse range."""
        if not len(coarse):
            return coarse, np.empty(0, np.int64), np.empty(0)
        order = np.lexsort((term, coarse))
        start = _starts(coarse[order], term[order])
        row, q, weight = self.meet(term[order][start])
        key, _, most = _sums((coarse[order][start][row] - coarse.min()) * len(self.qns) + q, weight * np.maximum.reduceat(bound[order], start)[row])
        return key // len(self.qns) + coarse.min(), key % len(self.qns), most


class _Pairs:
    """Pairs of a question and a range of ``2 ** bits`` texts."""

    def __init__(self, asked: _Asked, rows: pd.DataFrame, bits: int):
        self.bits, self.range = bits, rows.iloc[:, 1].to_numpy()
        self.q = np.searchsorted(asked.qns, rows.iloc[:, 0].to_numpy())

    def have(self, places: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """Whether a question (of ``n``) and the range that a place is in are such a pair."""
        at = places >> self.bits
        if not len(at):
            return np.zeros(0, bool)
        near = (self.range >= at.min()) & (self.range <= at.max())
        return np.isin((at - at.min()) * n + q, (self.range[near] - at.min()) * n + self.q[near])


def _coarse_kernel(asked: _Asked) -> Callable[[pa.Table], pa.Table]:
    def run(blocks: pa.Table) -> pa.Table:
        blocks, term = asked.terms(blocks)
        coarse, q, most = asked.range_bounds(blocks.column("coarse").to_numpy(), term, blocks.column("bound").to_numpy().astype(np.float64))
        return pa.table({"qn": pa.array(asked.qns[q], pa.int64()), "coarse": pa.array(coarse, pa.int64()), "most": pa.array(most, pa.float64())})

    return run


def _shard_kernel(asked: _Asked, fine_bits: int, coarse_bits: int, what: str, least: np.ndarray | None, only: _Pairs | None, but: Sequence[_Pairs], pairs_at_once: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Fine ranges (``what`` "fine": qn, fine, most) or texts ("place": qn, place, score) of a shard.

    With ``least``, a score for each question, ranges whose bounds reach it and
    texts that reach it; without it, texts of the pairs ``only``.  Pairs ``but`` are left out.
    """
    nq, up = len(asked.qns), coarse_bits - fine_bits

    def run(blocks: pa.Table, texts: pa.Table) -> pa.Table:
        blocks, term = asked.terms(blocks)
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if blocks.num_rows:
            coarse = blocks.column("coarse").to_numpy()
            at = blocks.column("at").combine_chunks()
            row = np.repeat(np.arange(len(coarse)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
            place = (coarse[row] << coarse_bits) | at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = blocks.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            known = texts.column("place").to_numpy()
            order = np.argsort(known)
            norm = texts.column("norm").to_numpy()[order][np.searchsorted(known[order], place)]
            weight, term = tf * asked.idf[term[row]] / norm, term[row]
            order = np.lexsort((place, term, place >> fine_bits))
            place, weight, term = place[order], weight[order], term[order]
            text = _starts(place, term)  # a text that was given twice has a term twice
            place, weight, term = place[text], np.add.reduceat(weight, text), term[text]
            first = _starts(place >> fine_bits, term)
            size, fine, term = np.diff(np.r_[first, len(place)]), place[first] >> fine_bits, term[first]
            bound = np.maximum.reduceat(weight, first)
            if least is not None:
                ranges, q, most = asked.range_bounds(fine >> up, term, bound)
                reach = most >= least[q] - ROOM
                base = int(fine[0] >> up)
                open_ = np.sort((ranges[reach] - base) * nq + q[reach])
            met = np.r_[0, np.cumsum(asked.ptr[term + 1] - asked.ptr[term])]
            edges = np.r_[_starts(fine), len(fine)]
            a = 0
            while a < len(edges) - 1:
                b = max(a + 1, int(np.searchsorted(met[edges], met[edges[a]] + pairs_at_once, "right")) - 1)
                lo, hi, a = edges[a], edges[b], b
                row, q, asks = asked.meet(term[lo:hi])
                row += lo
                if least is not None:
                    keep = np.isin(((fine[row] >> up) - base) * nq + q, open_)
                else:
                    keep = only.have(fine[row] << fine_bits, q, nq)
                for pairs in but:
                    keep &= ~pairs.have(fine[row] << fine_bits, q, nq)
                row, q, asks = row[keep], q[keep], asks[keep]
                key, pair, most = _sums((fine[row] - fine[lo]) * nq + q, asks * bound[row])
                if least is not None:
                    reach = most >= least[key % nq] - ROOM
                    if what == "fine":
                        key, value, base_at = key[reach], most[reach], fine[lo]
                    else:
                        row, q, asks = row[reach[pair]], q[reach[pair]], asks[reach[pair]]
                if what == "place":
                    n, text = size[row], _runs(first[row], size[row])
                    base_at = place[first[lo]] >> fine_bits << fine_bits
                    key, _, value = _sums((place[text] - base_at) * nq + np.repeat(q, n), np.repeat(asks, n) * weight[text])
                    if least is not None:
                        reach = value >= least[key % nq] - ROOM
                        key, value = key[reach], value[reach]
                for part, found in zip(out, (asked.qns[key % nq], key // nq + base_at, value)):
                    part.append(found)
        qn, found, value = (np.concatenate(part) for part in out)
        return pa.table({"qn": pa.array(qn, pa.int64()), what: pa.array(found, pa.int64()), "most" if what == "fine" else "score": pa.array(value, pa.float64())})

    return run


class Search:
    """One question set against published blocks; every step that later ones read is written once."""

    def __init__(self, index: Blocks, questions: DataFrame, q_keys: Sequence[str], text_col: str = "text"):
        self.index, self.q_keys, self.spark = index, list(q_keys), index.spark
        terms = index.question_terms(questions, q_keys, text_col)
        needed = index.buckets_of(terms)
        own = terms.select("term").distinct()
        # A term list that is counted small goes to the blocks, instead of the blocks to it.
        few = own.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        number = F.monotonically_increasing_id()
        own = stored((F.broadcast(own) if few else own).join(index.idf.select("term", "idf"), "term").withColumn("tn", number), "question-vocabulary")
        self.questions = stored(terms.select("q").distinct().withColumn("qn", number), "question-numbers")
        #: (q, term, qweight) with the numbers qn and tn and the term's idf.
        self.terms = stored(terms.drop("bucket").join(own, "term").join(self.questions, "q"), "numbered-terms")
        self.sets = max(1, -(-self.terms.count() // QUESTION_POSTINGS))
        own = own.select("term", "tn")
        #: Blocks of the questions' terms alone, by shard.
        self.blocks = index.table(index.blocks_at, needed).join(F.broadcast(own) if few else own, "term").withColumn("shard", F.shiftright("coarse", SHARD))
        self._coarse = None

    def _set(self, df: DataFrame, i: int) -> pd.DataFrame:
        """The rows of the ``i``-th set of questions, whose terms are counted."""
        return (df.filter(F.pmod(F.xxhash64("qn"), F.lit(self.sets)) == i) if self.sets > 1 else df).toPandas()

    def _by_set(self, find: Callable[[int, _Asked], DataFrame], name: str) -> DataFrame:
        """What ``find`` gives for each set of questions, written set by set."""
        path, schema = shared_path(self.spark, name), None
        for i in range(self.sets):
            found = find(i, _Asked(self._set(self.terms.select("qn", "tn", "idf", "qweight"), i)))
            found.write.mode("append").parquet(path)
            schema = found.schema
        return self.spark.read.schema(schema).parquet(path)

    @property
    def coarse(self) -> DataFrame:
        """(qn, coarse, most): what a question can score at most in each coarse range."""
        if self._coarse is None:
            bounds = self.blocks.select("shard", "tn", "coarse", "bound").groupBy("shard")
            self._coarse = self._by_set(lambda i, asked: bounds.applyInArrow(_coarse_kernel(asked), "qn long, coarse long, most double"), "coarse-bounds")
        return self._coarse

    def _shards(self, what: str, name: str, least: DataFrame | float | None = None, only: tuple[DataFrame, str] | None = None, but: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
        """``_shard_kernel`` over all shards, or those of the ranges ``only``; ``least`` is one number or (qn, least)."""
        bits = {"fine": FINE, "coarse": COARSE}
        blocks, texts = self.blocks.select("shard", "tn", "coarse", "at", "tf"), self.index.places.select(F.shiftright("place", COARSE + SHARD).alias("shard"), "place", "norm")
        if only is not None:
            ranges = only[0].select(F.shiftright(only[1], COARSE - bits[only[1]]).alias("coarse")).distinct()
            blocks = blocks.join(ranges, "coarse", "left_semi")
            texts = texts.join(ranges.select(F.shiftright("coarse", SHARD).alias("shard")).distinct(), "shard", "left_semi")

        def find(i: int, asked: _Asked) -> DataFrame:
            pairs = [_Pairs(asked, self._set(df.select("qn", w), i), bits[w]) for df, w in [*([only] if only else []), *but]]
            reach = None
            if isinstance(least, DataFrame):
                rows = self._set(least.select("qn", "least"), i)
                reach = np.full(len(asked.qns), np.inf)
                reach[np.searchsorted(asked.qns, rows["qn"].to_numpy())] = rows["least"].to_numpy()
            elif least is not None:
                reach = np.full(len(asked.qns), float(least))
            kernel = _shard_kernel(asked, FINE, COARSE, what, reach, pairs[0] if only else None, pairs[1:] if only else pairs, MAX_PAIRS)
            return blocks.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(kernel, f"qn long, {what} long, {'most' if what == 'fine' else 'score'} double")

        return self._by_set(find, name)

    def _best(self, ranges: DataFrame, what: str, n: int) -> DataFrame:
        """The ``n`` ranges of each question with the largest bounds."""
        rank = F.row_number().over(W.partitionBy("qn").orderBy(F.col("most").desc(), what))
        return stored(ranges.withColumn("rank", rank).filter(F.col("rank") <= n).select("qn", what), f"best-{what}")

    def _until_last(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Scores of the most promising ranges, the best of each question, and the fine ranges that reached the first of them."""
        first = self._best(self.coarse, "coarse", SEEDS)
        scores = self._shards("place", "first-scores", only=(first, "coarse"))
        beat = scores.groupBy("qn").agg(F.max("score").alias("least"))
        fine = self._shards("fine", "fine-bounds", least=beat, but=[(first, "coarse")])
        second = self._best(fine, "fine", NEXT)
        scores = scores.unionByName(self._shards("place", "next-scores", only=(second, "fine")))
        self.scored = [(first, "coarse"), (second, "fine")]
        return scores, stored(scores.groupBy("qn").agg(F.max("score").alias("least")), "scores-to-beat"), fine

    def needed_for_top1(self) -> tuple[DataFrame, DataFrame]:
        """Scores of the most promising ranges, and the other fine ranges that can hold something as good."""
        scores, beat, fine = self._until_last()
        rest = fine.join(beat, "qn").filter(F.col("most") >= F.col("least") - ROOM).join(self.scored[1][0], ["qn", "fine"], "left_anti")
        return scores, stored(rest.select("qn", "fine"), "fine-ranges")

    def needed_for_threshold(self, threshold: float) -> DataFrame:
        """(qn, fine, most): fine ranges whose bound reaches ``threshold``."""
        self.scored = []
        return self._shards("fine", "fine-ranges", least=threshold)

    def _keyed(self, scores: DataFrame) -> DataFrame:
        places = self.index.places.select(*self.index.keys, F.col("place").alias("p"))
        return scores.join(places, F.col("place") == F.col("p")).join(self.questions, "qn").select("q.*", *self.index.keys, "score")

    def top1(self) -> DataFrame:
        """Best text of each question that shares a term with any; ties go to the smallest keys."""
        seeds, beat, _ = self._until_last()
        rest = self._shards("place", "last-scores", least=beat, but=self.scored)
        scores = seeds.unionByName(rest).withColumn("ranked", F.round("score", R.RANK_DIGITS))
        # Keys decide between texts that share the best rounded score.
        best = scores.groupBy("qn").agg(F.max("ranked").alias("ranked"))
        last = stored(scores.join(best, ["qn", "ranked"]).drop("ranked"), "question-scores")
        return stored(R.top1(self._keyed(last), self.q_keys, self.index.keys), "best-texts")

    def above(self, threshold: float) -> DataFrame:
        """Every (question, text) scoring strictly above ``threshold``."""
        return self._keyed(self._shards("place", "scores", least=threshold).filter(F.col("score") > F.lit(float(threshold))))

    def blocks_read(self, fine: DataFrame) -> tuple[int, int]:
        """Blocks, by fine range, that scoring reads, those scored before ``fine`` included, and all blocks of the questions' terms."""
        own = self.blocks.select("tn", "coarse", F.explode("at").alias("at")).select(
            "tn", "coarse", F.shiftright(F.shiftleft("coarse", COARSE) + F.col("at"), FINE).alias("fine")).distinct()
        read = [ranges.select("qn", what).join(self.terms, "qn").join(own, ["tn", what]).select("tn", "fine") for ranges, what in [(fine, "fine"), *self.scored]]
        whole = read[0]
        for part in read[1:]:
            whole = whole.unionByName(part)
        return whole.distinct().count(), own.count()
