"""Conversation prefix trie in minimal-perfect-hash node tables.

Every conversation starts with some turns of another one (see ``rebuilt``); each
distinct sequence of first turns is a node. Nodes are named by digests: a turn
is two residues of its BLAKE2 digest, a prefix the polynomial of its turns in
two bases modulo 2**61 - 1. Such sums can be cut anywhere, so turns are sorted
by range, numbered and summed in their tasks, and a conversation that spans
several tasks gets its offsets from one row a task. Prefixes are distinct
digests of all turns; a digest whose turns or parents differ stops the job.

Nodes that more than ``S`` conversations share are the top of the trie, the
subtrees below it are dealt to shards. ``S`` is the number of turns over
``TOP_NODES`` (``MIN_SHARED`` at least), so the top has at most ``TOP_NODES``
nodes and a subtree at most ``S`` conversations. What only one conversation has
is closed: its first node enters the table as a leaf, the rest follows from it,
so a conversation of any length does not fill a shard. A shard gives each
digest a slot by a minimal perfect hash, checks every digest against the slot's
own, scatters counts into flat arrays, and sums leaves and saved bytes through
the array of parent slots, deepest nodes first. The sums of its subtrees enter
the top, which is one more such table.

Turns are ordered by turn (null first), then role and text, so ties and
repeated rows give one order; each repeated row is a turn. Null roles and texts
are empty. Rows without a conversation id belong to none and are left out.
Very long texts are read whole once, for their digest. Only the columns named
are read, clashing ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import common

#: Prefixes come from the conversation whose id is the next lower multiple of this, and have fewer turns than that.
BASE_EVERY, HEAD_TURNS = 5, 9
#: Nodes of the top table at most; conversations that a node of the top has at least; nodes of a shard, about.
TOP_NODES, MIN_SHARED, SHARD_NODES = 100_000, 32, 200_000
#: Conversation ids of one piece of an end list.
PIECE_IDS = 20_000

_P = (1 << 61) - 1
_BASES = (0x1D8AF066F2A5D3B1 % _P, 0x0B5297A4D9E3C6F5 % _P)
#: base ** -k for the shifts that a rebuilt conversation can need.
_BACK = [[pow(b, -k, _P) for k in range(HEAD_TURNS)] for b in _BASES]


# --- digests ---------------------------------------------------------------------------------------------------------


def turn_digest(role: str, text: str) -> tuple[int, int]:
    """Two residues that are not zero."""
    data = role.encode("utf-8", "surrogatepass")
    h = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, salt=hashlib.blake2b(data, digest_size=16).digest()).digest()
    return int.from_bytes(h[:8], "little") % (_P - 1) + 1, int.from_bytes(h[8:], "little") % (_P - 1) + 1


_NUMBERED = "conv long, part int, place long, p1 long, p2 long, u1 long, u2 long, size long, check long"


def numbered(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(conv, place, p1, p2, u1, u2, size, check): each turn's place from 1, digests of the prefix with and without it, its text's bytes."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col(f"`{id_column}`").cast("long").alias("conv"), F.col(f"`{turn_column}`").alias("turn"),
                                F.coalesce(F.col(f"`{role_column}`").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, sums, power = TaskContext.get().partitionId(), None, 0, [0, 0], [1, 1]
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(8)]
            for conv, role, text, check in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != last:
                    last, place, sums, power = conv, 0, [0, 0], [1, 1]
                place += 1
                before = sums
                power = [p * b % _P for p, b in zip(power, _BASES)]
                sums = [(s + t * p) % _P for s, t, p in zip(sums, turn_digest(role, text), power)]
                for column, value in zip(out, (conv, part, place, *sums, *before, len(text.encode("utf-8", "surrogatepass")))):
                    column.append(value)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), batch.column("check")],
                                             names=["conv", "part", "place", "p1", "p2", "u1", "u2", "size", "check"])

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.xxhash64("role", "text").alias("check"))
    # Written once: later steps need the same division into parts.
    local = common.stored(placed.mapInArrow(number, _NUMBERED), "prefix-turns")
    pieces = local.groupBy("conv", "part").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    split = pieces.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("s_conv"))
    # A part shares a conversation with its neighbours only: two rows a part at most.
    offsets: dict[tuple[int, int], tuple[int, int, int]] = {}
    last, state = None, (0, 0, 0)
    for r in pieces.join(split, F.col("conv") == F.col("s_conv"), "left_semi").orderBy("conv", "part").toLocalIterator():
        if r["conv"] != last:
            last, state = r["conv"], (0, 0, 0)
        offsets[r["conv"], r["part"]] = state
        at, *sums = state
        state = (at + r["end"]["place"], *((s + r["end"][f"p{i + 1}"] * pow(b, at, _P)) % _P for i, (s, b) in enumerate(zip(sums, _BASES))))
    if not any(k for k, _, _ in offsets.values()):
        return local.drop("part")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("conv", "part", "place", "p1", "p2", "u1", "u2")}
            for i, key in enumerate(zip(cols["conv"], cols["part"])):
                at, *sums = offsets.get(key, (0, 0, 0))
                if at:
                    cols["place"][i] += at
                    for b, s, names in zip(_BASES, sums, (("p1", "u1"), ("p2", "u2"))):
                        for name in names:
                            cols[name][i] = (s + cols[name][i] * pow(b, at, _P)) % _P
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[n], pa.int64()) for n in ("conv", "place", "p1", "p2", "u1", "u2")), batch.column("size"), batch.column("check")],
                                             names=["conv", "place", "p1", "p2", "u1", "u2", "size", "check"])

    return common.stored(local.mapInArrow(shift, _NUMBERED.replace(" part int,", "")), "prefix-places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations c with the first h turns of c - c % 5 in place of their own first h, h = crc32(c) % 9.

    (conv, length, e1, e2): turns and digest of the whole; and one row for each of its turns.
    """
    heads = turns.filter(F.col("place") < HEAD_TURNS).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "p1", "p2", "u1", "u2", "size", "check"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    own = heads.select(F.col("conv").alias("o_conv"), F.col("head").alias("own"))
    base = heads.select(F.col("conv").alias("b_conv"), F.col("head").alias("base"))
    plan = convs.select("conv", "end", (F.col("conv") - F.col("conv") % BASE_EVERY).alias("from"),
                        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS).cast("int").alias("h"))
    plan = plan.join(own, F.col("conv") == F.col("o_conv")).join(base, F.col("from") == F.col("b_conv"), "left")
    plan = plan.withColumn("base", F.slice(F.coalesce("base", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))).withColumn("m", F.size("base").cast("long"))
    none = F.lit(0).cast("long")
    at = lambda array, k, field: F.coalesce(F.get(F.col(array), F.lit(k) - 1 if isinstance(k, int) else k - 1).getField(field), none)
    h = F.col("h").cast("long")
    plan = common.stored(plan.select(
        "conv", "m", h.alias("h"), "base", F.col("end.place").alias("n"), at("base", F.col("m").cast("int"), "p1").alias("m1"), at("base", F.col("m").cast("int"), "p2").alias("m2"),
        at("own", F.col("h"), "p1").alias("h1"), at("own", F.col("h"), "p2").alias("h2")).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "prefix-plan")
    from_base = plan.select("conv", "length", F.explode("base").alias("t")).select("conv", F.col("t.place").alias("depth"), "length", "t.p1", "t.p2", "t.u1", "t.u2", "t.size", "t.check")
    rest = plan.filter("n > h").select(F.col("conv").alias("r_conv"), "length", "m", "h", "m1", "m2", "h1", "h2")
    joined = turns.join(rest, (F.col("conv") == F.col("r_conv")) & (F.col("place") > F.col("h"))).select(
        "conv", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "length", "p1", "p2", "u1", "u2", "size", "check", (F.col("h") - F.col("m")).alias("back"), "m1", "m2", "h1", "h2")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """prefix of the base + (own prefix - own head) * base ** (m - h)"""
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("p1", "p2", "u1", "u2", "back", "m1", "m2", "h1", "h2")}
            out = {}
            for name in ("p1", "p2", "u1", "u2"):
                i = name[1]
                out[name] = [(m + (v - h) * _BACK[int(i) - 1][k]) % _P for v, m, h, k in zip(cols[name], cols["m" + i], cols["h" + i], cols["back"])]
            yield pa.RecordBatch.from_arrays([batch.column(n) if n not in out else pa.array(out[n], pa.int64()) for n in names], names=names)

    names = ["conv", "depth", "length", "p1", "p2", "u1", "u2", "size", "check"]
    path = from_base.unionByName(joined.mapInArrow(move, ", ".join(f"{n} long" for n in names)))
    return plan.select("conv", "length"), common.stored(path, "prefix-path")


# --- node tables -----------------------------------------------------------------------------------------------------


class PerfectHash:
    """Slots 0..n-1 for n distinct digests, without gaps: keys that share a place move on to the next, smaller level."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        rest, done = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == 100:
                raise ValueError("equal digests have no slots of their own")
            place = self._place(a[rest], b[rest], len(self.levels), max(64, 2 * len(rest)))
            alone = np.bincount(place, minlength=max(64, 2 * len(rest))) == 1
            rank = done + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            mine = alone[place]
            slots = rank[place[mine]]
            self.a[slots], self.b[slots] = a[rest[mine]], b[rest[mine]]
            done += int(alone.sum())
            rest = rest[~mine]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (a ^ np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32)) ^ b) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not the one stored in it."""
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(a[rest], b[rest], level, len(alone))
            here = alone[place]
            found, slot = rest[here], rank[place[here]]
            right = (self.a[slot] == a[found]) & (self.b[slot] == b[found])
            out[found[right]] = slot[right]
            rest = rest[~here]
        return out


_NODE = "p1 long, p2 long, u1 long, u2 long, depth long, conv long, n_convs long, size long, kids long, leaves long, saved long"
_DONE = "p1 long, p2 long, u1 long, u2 long, depth long, conv long, n_convs long, parent_conv long, n_children long, n_leaves long, saved_tokens long"


def accumulate(table: pa.Table) -> pa.Table:
    """Counts of the subtrees of some nodes; kids, leaves and saved are what comes from below the table."""
    col = {n: table.column(n).to_numpy() for n in table.column_names}
    digest = [col[n].view(np.uint64) for n in ("p1", "p2", "u1", "u2")]
    table_of = PerfectHash(digest[0], digest[1])
    slot = table_of.slots(digest[0], digest[1])
    n = len(slot)
    if (slot < 0).any():
        raise ValueError("a digest is not in its slot")
    flat = {name: np.zeros(n, np.int64) for name in ("depth", "conv", "n_convs", "size", "kids", "leaves", "saved")}
    for name, array in flat.items():
        array[slot] = col[name]
    parent = np.full(n, -1, np.int64)
    # The root has no parent, though its digest is that of its own parent column.
    up = np.where(col["depth"] > 0, table_of.slots(digest[2], digest[3]), -1)
    parent[slot] = up
    inner = np.flatnonzero(parent >= 0)
    kids = flat["kids"] + np.bincount(parent[inner], minlength=n)
    leaves = flat["leaves"] + (kids == 0)
    saved = flat["saved"] + (flat["n_convs"] - 1) * flat["size"]
    order = inner[np.argsort(-flat["depth"][inner], kind="stable")]
    cuts = np.flatnonzero(np.diff(flat["depth"][order])) + 1
    for level in np.split(order, cuts) if len(order) else []:
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    has = up >= 0
    parent_conv = pa.array(np.where(has, flat["conv"][np.maximum(up, 0)], 0), mask=~has)
    return pa.table([*(table.column(c) for c in ("p1", "p2", "u1", "u2", "depth", "conv", "n_convs")), parent_conv, *(pa.array(x[slot]) for x in (kids, leaves, saved))],
                    names=["p1", "p2", "u1", "u2", "depth", "conv", "n_convs", "parent_conv", "n_children", "n_leaves", "saved_tokens"])


def end_lists(ends: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256) for (p1, p2, conv): ids in order, comma-joined, in pieces sorted by range and then hashed piece by piece."""
    order = ["p1", "p2", "conv"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                                              names=["p1", "p2", "first", "ids"])

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != (a, b) or len(ids) == PIECE_IDS):
                    yield piece()
                    ids = []
                key = (a, b)
                ids.append(conv)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done(rows: list[tuple[tuple[int, int], str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.string())],
                                              names=["e1", "e2", "ends_sha256"])

        for batch in batches:
            rows = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids"))):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if key:
                        rows.append((key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield done(rows)
        if key:
            yield done([(key, state.hexdigest())])

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "p1 long, p2 long, first long, ids string")
    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(digest, "e1 long, e2 long, ends_sha256 string")


def _same(name: str) -> F.Column:
    """The one value of a group; a digest that stands for two different prefixes stops the job."""
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(F.raise_error(F.lit(f"two prefixes share a digest: {name}")).cast("long")).alias(name)


def prefix_trie(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
                top_nodes: int = TOP_NODES, min_shared: int = MIN_SHARED, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    common.ready(conversations.sparkSession)
    turns = numbered(conversations, id_column, turn_column, role_column, text_column)
    convs, path = rebuilt(turns)
    # Depth and bytes in one row a node; every prefix once.
    nodes = path.groupBy("p1", "p2").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), *[_same(c) for c in ("u1", "u2", "depth", "size", "check")]).drop("check")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).filter("n_convs > 0").select(
        zero.alias("p1"), zero.alias("p2"), "n_convs", "conv", zero.alias("u1"), zero.alias("u2"), zero.alias("depth"), zero.alias("size"))
    nodes = common.stored(nodes.unionByName(root), "prefix-nodes")
    total = nodes.agg(F.sum("n_convs").alias("t")).first()["t"] or 0
    shared = max(min_shared, -(-total // top_nodes))
    shards = -(-total // shard_nodes) or 1
    of_top = (F.col("n_convs") > shared) | (F.col("depth") == 0)
    outside = [zero.alias(c) for c in ("kids", "leaves", "saved")]
    columns = [c.split()[0] for c in _NODE.split(", ")]
    # Below its first node, what a single conversation has needs no table.
    first_own = nodes.filter("n_convs = 1 AND depth > 0").groupBy("conv").agg(F.min("depth").alias("f_depth")).withColumnRenamed("conv", "f_conv")
    single = F.col("n_convs") == 1
    below = nodes.join(first_own, F.col("conv") == F.col("f_conv"), "left").withColumn("closed", single & (F.col("depth") > F.col("f_depth")))
    # A conversation's subtree is that of its first node below the top; top nodes are few, see TOP_NODES.
    top = nodes.filter(of_top).select(F.col("p1").alias("t1"), F.col("p2").alias("t2"), F.col("conv").alias("t_conv"))
    outer = path.join(F.broadcast(top.select("t1", "t2")), (F.col("p1") == F.col("t1")) & (F.col("p2") == F.col("t2")), "left_anti")
    trees = outer.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2")).alias("t")).select(
        F.col("conv").alias("c_conv"), F.pmod(F.xxhash64("t.p1", "t.p2"), F.lit(shards)).cast("int").alias("shard"))
    in_shard = below.filter(~of_top & ~F.coalesce("closed", F.lit(False))).join(trees, F.col("conv") == F.col("c_conv")).select("shard", *columns[:8], *outside)
    lower = common.stored(in_shard.groupBy("shard").applyInArrow(_part(accumulate), _DONE), "prefix-shards")
    into_top = lower.filter("parent_conv IS NULL").groupBy("u1", "u2").agg(
        F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).select(F.col("u1").alias("i1"), F.col("u2").alias("i2"), "kids", "leaves", "saved")
    upper = nodes.filter(of_top).join(into_top, (F.col("p1") == F.col("i1")) & (F.col("p2") == F.col("i2")), "left").select(
        F.lit(0).alias("shard"), *columns[:8], *[F.coalesce(c, zero).alias(c) for c in ("kids", "leaves", "saved")])
    above = upper.groupBy("shard").applyInArrow(_part(accumulate), _DONE)
    lower = lower.join(F.broadcast(top), (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")), "left").withColumn("parent_conv", F.coalesce("parent_conv", "t_conv"))
    # A closed node: one leaf, nothing saved, its parent has the same conversation; a child unless it is the end.
    ends = path.filter("depth = length").select("p1", "p2", "conv").unionByName(
        convs.filter("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv"))
    lists = end_lists(ends)
    names = [c.split()[0] for c in _DONE.split(", ")]
    closed = below.filter("closed").select(*names[:7], F.col("conv").alias("parent_conv"), F.lit(None).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    # The first node of a single conversation is a leaf of its table; it has a child unless a list ends there.
    out = above.select(*names).unionByName(lower.select(*names)).unionByName(closed)
    out = out.join(lists, (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), "left")
    only = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    children = F.when(only, F.when(F.col("ends_sha256").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")).otherwise(F.col("n_children"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def _part(work):
    """``work`` on the columns without the key of the group."""
    def run(table: pa.Table) -> pa.Table:
        return work(table.drop_columns(["shard"]))
    return run


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


OP12_SQL = r"""
WITH byte AS (
  SELECT i, list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda k: 0),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM byte),
t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n, hex(encode(CAST(c AS VARCHAR))) AS x FROM t GROUP BY c),
conv AS (
  SELECT c, n, c - c % 5 AS b,
    xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
                    lambda p, q: xor(p >> 8, t[CAST(xor(p, q) & 255 AS BIGINT) + 1])), 4294967295) % 9 AS h
  FROM ids, tab),
plan AS (SELECT conv.*, least(h, coalesce(o.n, 0)) AS m FROM conv LEFT JOIN ids o ON conv.b = o.c),
re AS (
  SELECT p.c, t.k AS d, role, text FROM plan p JOIN t ON t.c = p.b AND t.k <= p.h
  UNION ALL
  SELECT p.c, t.k - p.h + p.m, role, text FROM plan p JOIN t ON t.c = p.c AND t.k > p.h),
path AS (SELECT c, d, octet_length(encode(text)) AS size, string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS x FROM re),
whole AS (
  SELECT c, d, size, md5(x) AS x, coalesce(lag(md5(x)) OVER (PARTITION BY c ORDER BY d), '') AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM path
  UNION ALL
  SELECT c, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM re WHERE re.c = ids.c) FROM ids),
node AS (SELECT x, min(d) AS d, min(size) AS size, min(up) AS up, count(*) AS n, min(c) AS c, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS e FROM whole GROUP BY x),
kid AS (SELECT up AS x, count(*) AS n FROM node GROUP BY up),
full_node AS (SELECT node.*, coalesce(kid.n, 0) AS kids FROM node LEFT JOIN kid ON node.x = kid.x),
sub AS (
  SELECT w.x, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum((f.n - 1) * f.size) AS saved
  FROM full_node f JOIN whole w ON w.c = f.c AND w.d <= f.d GROUP BY w.x)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(f.e, '')) AS ends_sha256
FROM full_node f JOIN sub ON f.x = sub.x LEFT JOIN node p ON f.up = p.x
"""
