"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of word shingles are linked where they differ in at most
``max_bits`` bits. Bits that go together are grouped into partitions; every
partition gets a threshold of its own, so that thresholds t_i with
sum(t_i + 1) = max_bits + 1 (-1 switches a partition off) leave no link out: two fingerprints within
max_bits differ in at most t_i bits of some partition i. Dynamic programming
picks the thresholds that need the fewest candidates, by counts taken from the
fingerprints themselves. Each fingerprint is probed under all values within
t_i of its own, candidates are verified on all 64 bits, and the links make
components.

Partition values that many fingerprints share are dealt out further, exactly:
what agrees there still differs in at most max_bits of the other bits, so one
of max_bits + 1 groups of these agrees as well and joins the key.

Nulls, empty texts and texts without a word get fingerprint zero, linked like
any other. Equal fingerprints are one class, so copies never meet in pairs.
Repeated rows are in one component. A row without doc_id gets its component's
smallest doc_id, null if there is none. Ties: a bit set in exactly half the
shingles is 0. Very long texts are hashed whole. The columns added win over
clashing ones. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.llm import common

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BITS = 64
#: Index rows of one partition value from which on its members are dealt out by further bits.
HOT_VALUES = 200

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = np.arange(0, 2048, 256)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set where over half of the shingles' XXH64 have it; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip((stop - size)[:1 - shingle].tolist(), stop[shingle - 1:].tolist())]
    seen = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((seen + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def with_fingerprint(docs: DataFrame, text_column: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long."""
    common.ready(docs.sparkSession)

    def make():
        return lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]]

    return common.add_columns(docs, [text_column], [T.StructField("fp", T.LongType())], make, keep)


# --- planning: groups of bits and their thresholds ------------------------------------------------------------------


def bit_groups(together: np.ndarray, m: int, width: int = BITS) -> list[list[int]]:
    """``m`` groups of about equal size; each takes the bits most correlated with those it has."""
    left, out = set(range(width)), []
    for k in range(m):
        size = (width - sum(map(len, out))) // (m - k)
        first = max(left, key=lambda b: (together[b, list(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (together[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[list[int], float]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = total and the least sum of ``costs[i][t_i + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for extra in range(min(total - used, len(cost) - 1) + 1):
                new = (c + cost[extra], [*chosen, extra - 1])
                if used + extra not in step or new[0] < step[used + extra][0]:
                    step[used + extra] = new
        best = step
    return best[total][1], best[total][0]


def _masks(group: list[int], t: int) -> list[int]:
    """XOR masks of up to ``t`` bits of the group, as signed longs."""
    out, layer = [0], [(0, 0)]
    for _ in range(max(t, 0)):
        layer = [(m | 1 << group[j], j + 1) for m, at in layer for j in range(at, len(group))]
        out += [m for m, _ in layer]
    return [signed(m) for m in out]


def _mask(group: list[int]) -> int:
    return signed(sum(1 << b for b in group))


def plan(classes: DataFrame, max_bits: int = MAX_BITS) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and thresholds with the least estimated work for these distinct fingerprints.

    The statistics cover all rows: how often two bits are set together (64 x 64
    sums), and for every split and group the sum of squared value counts.
    """
    def sums(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            fps = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fps, axis=1)[:, ::-1].astype(np.float32)
            n, both = n + len(bits), both + (bits.T @ bits).astype(np.int64)
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array([*both.tolist(), [n]], pa.list_(pa.int64()))], names=["i", "v"])

    rows = (classes.select("fp").mapInArrow(sums, "i int, v array<bigint>")
            .select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect())
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, x in rows:
        if i == BITS:
            n = x
        else:
            both[i, j] = x
    if not n:
        return bit_groups(np.zeros((BITS, BITS)), max_bits + 1), [0] * (max_bits + 1)
    mean = both.diagonal() / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    together = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(together, 0)
    splits = {m: bit_groups(together, m) for m in range(2, max_bits + 2)}
    masks = [(m, i, _mask(g)) for m, groups in splits.items() for i, g in enumerate(groups)]
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for m, i, x in masks])
    squares = {(r["m"], r["i"]): r["s"] for r in classes.select(F.explode(parts).alias("p")).groupBy("p").count()
               .groupBy("p.m", "p.i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    choices = []
    for m, groups in splits.items():
        costs = []
        for i, group in enumerate(groups):
            cost, ball, ring = [0.0], 0.0, 1.0
            for t in range(max_bits + 1):
                ball += ring
                ring *= (len(group) - t) / (t + 1)
                # Equal values are counted; other values within t bits are taken to be as full as by chance.
                pairs = squares[m, i] + (ball - 1) * float(n) * n / 2.0 ** len(group)
                cost.append(pairs + (ball + 1) * n)
            costs.append(cost)
        thresholds, cost = allocate(costs, max_bits + 1)
        choices.append((cost, m, thresholds))
    _, m, thresholds = min(choices)
    return splits[m], thresholds


# --- probing ---------------------------------------------------------------------------------------------------------


def _deal(rows: DataFrame, keys: list[str], groups: Column) -> DataFrame:
    """Each row once for every group of bits in ``groups`` (masks), its key made longer by that group's value."""
    g = F.explode(groups).alias("g")
    return rows.select(*keys, "fp", "probe", g).select(*keys, "fp", "probe", F.struct("g", F.col("fp").bitwiseAND(F.col("g")).alias("w")).alias("w"))


def links(classes: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_VALUES) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that differ in at most ``max_bits`` bits; each pair once."""
    groups, thresholds = plan(classes, max_bits)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]
    entry = lambda i, g, x, probe: F.struct(
        F.lit(i).alias("i"), F.col("fp").bitwiseXOR(F.lit(x)).bitwiseAND(F.lit(_mask(g))).alias("v"), F.lit(probe).alias("probe"))
    # The value itself serves as index entry and as probe; the changed ones are probes only.
    entries = classes.select("fp", F.explode(F.array(*[entry(i, g, x, x != 0) for i, g, t in used for x in _masks(g, t)])).alias("e")).select("fp", "e.*")
    found, keys = [], ["i", "v"]
    here = common.stored(entries, "simhash-entries")
    for depth in range(3):
        sizes = here.groupBy(*keys).agg(F.count_if(~F.col("probe")).alias("n"), F.count("*").alias("all"))
        last = depth == 2
        busy = common.stored(sizes.filter((F.col("n") > 0) & (F.col("all") > 1)), "simhash-busy")
        hot_keys = busy.filter(F.col("all") > hot).select(*keys)
        calm = here.join((busy if last else busy.filter(F.col("all") <= hot)).select(*keys), keys, "left_semi")
        index = calm.filter(~F.col("probe")).select(*keys, F.col("fp").alias("a"))
        probe = calm.select(*keys, F.col("fp").alias("b"), "probe")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits) & (F.col("probe") | (F.col("a") < F.col("b")))
        found.append(index.join(probe, keys).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if last or not hot_keys.limit(1).count():
            break
        # Bits outside the partition, in max_bits + 1 groups; deeper, the groups of another cut.
        rest = F.create_map(*[x for i, g, _ in used for x in (F.lit(i), F.array(*[F.lit(_mask(s)) for s in _shares(g, max_bits + 1, depth)]))])
        here = common.stored(_deal(here.join(hot_keys, keys, "left_semi"), keys, rest[F.col("i")]).withColumnRenamed("w", f"w{depth}"), "simhash-hot")
        keys = [*keys, f"w{depth}"]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _shares(group: list[int], n: int, depth: int) -> list[list[int]]:
    """The bits outside ``group`` in ``n`` parts: every n-th bit first, then neighbouring ones."""
    rest = [b for b in range(BITS) if b not in set(group)]
    return [rest[k::n] for k in range(n)] if depth == 0 else [rest[k * len(rest) // n:(k + 1) * len(rest) // n] for k in range(n)]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each one reaches, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes; every
    step's edges and minima are written to the shared folder, so that each
    join has two plain tables and Spark can split the edges of a busy node. No
    node's neighbours are ever gathered in one row.
    """
    now = common.stored(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v"), "links")
    total: tuple | None = None
    while True:
        # large star: each node links its larger neighbours to the smallest node around it
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        large = common.stored(large, "large-star")
        # small star: each node links itself and its smaller neighbours to the smallest of these
        low = common.stored(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y")).filter("x < y").distinct()
        now = common.stored(small.select(F.col("x").alias("u"), F.col("y").alias("v")), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == total:
            break
        total = state
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(prints: DataFrame, id_column: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` (a stored table with ``fp``) with ``component_id``: the smallest id reachable over links."""
    classes = common.stored(prints.groupBy("fp").agg(F.min(id_column).alias("low")), "classes")
    pairs = common.stored(links(classes, max_bits), "pairs")
    roots = components(pairs)
    lows = roots.join(classes.withColumnRenamed("fp", "node"), "node")
    ids = common.stored(lows.groupBy("root").agg(F.min("low").alias("component")), "roots")
    linked = common.stored(roots.join(ids, "root").select(F.col("node").alias("fp"), "component"), "components")
    # Classes without links are their own component; one row for each class either way.
    per_class = common.stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")), "classes")
    return common.without(prints, "component_id").join(per_class, "fp")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    prints = common.stored(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    out = near_duplicates(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
