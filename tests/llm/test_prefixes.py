"""The prefix trie against brute force: shards, the top, spans of parts, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from answerlake.llm import prefixes as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows) -> set[tuple]:
    convs: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - (abs(c) % 5 * (1 if c >= 0 else -1)), [])
        whole[c] = [x[2:] for x in base[:h]] + [x[2:] for x in turns[h:]]
    nodes: dict[tuple, list[int]] = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list] = {}
    for x in nodes:
        if x:
            kids.setdefault(x[:-1], []).append(x)
    out, sums = [], {}
    for x in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in kids.get(x, [])]
        own = (len(nodes[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
        sums[x] = (sum(a for a, _ in below) or 1, sum(b for _, b in below) + own)
        ends = sorted(c for c in nodes[x] if len(whole[c]) == len(x))
        out.append((min(nodes[x]), len(x), min(nodes[x[:-1]]) if x else None, len(nodes[x]), len(kids.get(x, [])), *sums[x],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def talks(seed: int, n: int = 150) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if r.random() < 0.15:
            continue
        rows += [(c, t, r.choice(["user", "bot"]), f"text {r.randrange(2)}é") for t in range(r.choice([1, 2, 3, 8, 9, 12, 30]))]
    rows += [(400, t, "user", "long") for t in range(300)] + [(401, t, "user", "long") for t in range(300)]
    rows += [(500 + i, t, "bot", "hot") for i in range(60) for t in range(12)]
    rows += [(None, 1, "user", "no one"), (600, None, None, None), (600, None, "user", ""), (600, 1, None, "x" * 50_000), (601, 2, "user", "tie"), (601, 2, "bot", "tie"), (601, 2, "bot", "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("top,shared,shard", [(100_000, 32, 200_000), (100_000, 1, 50), (5, 1, 100), (100_000, 10_000, 1_000_000)])
def test_every_node_is_brute_force(spark, top, shared, shard):
    rows = talks(top + shared)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    got = [tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df, top_nodes=top, min_shared=shared, shard_nodes=shard).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 61, 5000).astype(np.uint64), rng.integers(0, 1 << 61, 5000).astype(np.uint64)
    table = P.PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(5000))
    assert (table.slots(a + np.uint64(1), b) == -1).all()
    with pytest.raises(ValueError):
        P.PerfectHash(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))
    assert len(P.PerfectHash(a[:0], b[:0]).slots(a[:3], b[:3])) == 3


def test_a_shared_digest_stops_the_job(spark, monkeypatch):
    """Equal digests of different turns are found, not merged."""
    monkeypatch.setattr(P, "_same", P._same)
    nodes = spark.createDataFrame([(1, 1, 5), (1, 1, 6)], "p1 long, p2 long, check long")
    with pytest.raises(Exception, match="share a digest"):
        nodes.groupBy("p1", "p2").agg(P._same("check")).collect()


def test_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 3)
    ends = [(1, 1, c) for c in range(100, 0, -1)] + [(1, 2, 7), (-4, 2, -1), (-4, 2, -10)]
    got = {(r["e1"], r["e2"]): r["ends_sha256"] for r in P.end_lists(spark.createDataFrame(ends, "p1 long, p2 long, conv long").repartition(5)).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 1): digest(range(1, 101)), (1, 2): digest([7]), (-4, 2): digest([-10, -1])}
