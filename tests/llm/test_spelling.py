"""Spelling variants against brute force: pairs, forms, roots, split regions, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from answerlake.llm import spelling as S


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int = S.RATIO) -> dict[str, tuple]:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def words(seed: int, n: int, letters: str = "abceöüÿ") -> dict[str, int]:
    r = random.Random(seed)
    made: set[str] = set()
    while len(made) < n:
        w = "".join(r.choice(letters) for _ in range(r.randrange(6, 9)))
        made.add(w)
        for _ in range(r.randrange(4)):
            at, c = r.randrange(len(w)), r.choice(letters)
            w = r.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w[:at] + w[at + 1:]])
            if len(w) >= 6:
                made.add(w)
    return {w: r.choice([5, 6, 25, 30, 125, 1000]) for w in made}


def table(df) -> dict[str, tuple]:
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("sample,leaf,box", [(100_000, 20_000, 48), (100_000, 40, 4), (60, 50, 1), (1, 10, 2)])
def test_pairs_and_forms_are_brute_force(spark, monkeypatch, sample, leaf, box):
    """However few words the regions are made from and however small they are, no pair is lost."""
    monkeypatch.setattr(S, "SAMPLE_WORDS", sample)
    monkeypatch.setattr(S, "LEAF_WORDS", leaf)
    monkeypatch.setattr(S, "BOX_WORDS", box)
    monkeypatch.setattr(S, "HELD_PAIRS", 50)
    counts = words(leaf + box, 500)
    want = brute(counts)
    near = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in S.near_counts(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)).collect()}
    assert {w: near.get(w, (0,))[0] for w in counts} == {w: x[3] for w, x in want.items()}
    for w, (_, m, best) in near.items():
        assert m == max(counts[x] for x in counts if one_edit(w, x)) and counts[best] == m and one_edit(w, best)


def test_whole_operator_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_WORDS", 40)
    counts = words(3, 120)
    r = random.Random(5)
    stream = [w for w, n in counts.items() for _ in range(n)]
    r.shuffle(stream)
    texts = [(i, ", ".join(stream[at:at + 400]).replace("abc", "ABC")) for i, at in enumerate(range(0, len(stream), 400))]
    texts += [(None, "abcdef 1abcdefg"), (7, None), (8, ""), (9, "short é"), (None, None), (3, texts[3][1])]
    want: Counter = Counter()
    for doc, text in texts:
        for run in S._RUN.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            want[low[:h % len(low)] + low[h % len(low) + 1:] if h % 199 == 0 else low] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(4)
    assert table(S.variants(docs)) == brute(want)


def test_chains_end_at_their_root(spark):
    chain = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625)]
    rows = table_of = {r["word"]: r["root"] for r in S.follow(spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain, chain[1:])], "word string, form string")).collect()}
    assert rows == {w: "abbbbb" for w, _ in chain[:-1]} and table_of


def test_anagrams_and_beyond_ascii():
    """Equal vectors are one box, and are compared with neighbours in pieces."""
    import itertools
    left = ["".join(p) for p in itertools.permutations("abcdeé")]
    right = [w.replace("a", "ÿ") for w in left] + [w + "z" for w in left]
    t, q = S.codes(right)[0], S.codes(left)[0]
    same = S.codes([w for w in right if len(w) == 6])[0]
    pairs = {(int(a), int(b)) for i, j in S.near_pairs(same, S.vectors(same), q, S.vectors(q), True) for a, b in zip(i, j)}
    assert pairs == {(i, i) for i in range(len(left))}
    longer = S.codes([w for w in right if len(w) == 7])[0]
    pairs = {(int(a), int(b)) for i, j in S.near_pairs(longer, S.vectors(longer), q, S.vectors(q), False) for a, b in zip(i, j)}
    assert pairs == {(i, i) for i in range(len(left))}
    assert t.shape[1] == 7 and S.vectors(t).sum(axis=1).tolist() == [6] * 720 + [7] * 720


def test_regions_hold_every_point_once():
    vec = np.random.default_rng(1).integers(0, 4, (2000, S.DIMS)).astype(np.int32)
    regions = S.Regions(vec[:150], 10)
    rows, leaves = regions.meeting(vec, 0)
    assert sorted(rows.tolist()) == list(range(2000)) and regions.leaves > 8
    home = dict(zip(rows.tolist(), leaves.tolist()))
    rows, leaves = regions.meeting(vec, 2)
    met = set(zip(rows.tolist(), leaves.tolist()))
    for i in range(0, 2000, 97):
        close = np.flatnonzero(np.abs(vec - vec[i]).sum(axis=1) <= 2)
        assert all((i, home[j]) in met for j in close.tolist())
