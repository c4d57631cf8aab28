"""Substring dedup against brute force: every sketch size, planted repeats, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from answerlake.llm import substrings as S


def brute(texts: list[str | None], window: int) -> list[set[int]]:
    """Positions of removed words of each text."""
    at: dict[tuple, list] = {}
    words = [(t or "").split() for t in texts]
    for r, w in enumerate(words):
        for p in range(len(w) - window + 1):
            at.setdefault(tuple(w[p:p + window]), []).append((r, p))
    gone: list[set[int]] = [set() for _ in texts]
    for starts in at.values():
        if len(starts) > 1:
            for r, p in starts:
                gone[r] |= set(range(p, p + window))
    return gone


def corpus(seed: int, rows: int = 60) -> list[str | None]:
    """Few words, so that pieces and windows repeat; passages shared across texts, runs of one word, copies."""
    r = random.Random(seed)
    passage = [" ".join(r.choice("abcdef") + str(r.randrange(40)) for _ in range(r.randrange(6, 30))) for _ in range(5)]
    texts: list[str | None] = [None, "", " \n ", "x " * 50, "x " * 11, passage[0], passage[0]]
    for _ in range(rows):
        parts = [" ".join(r.choice("abcdef") + str(r.randrange(40)) for _ in range(r.randrange(0, 40)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passage), " ".join(r.choice("uvw") for _ in range(r.randrange(12)))]
        texts.append(" \n".join(parts))
    return texts + texts[-3:]


def gone_positions(spans) -> set[int]:
    return {i for s in spans for i in range(s["start"], s["stop"])}


@pytest.mark.parametrize("window,gram,bits", [(10, 4, 12), (10, 10, 12), (10, 1, 20), (7, 3, 3), (12, 5, 4)])
def test_every_sketch_gives_the_brute_force_spans(spark, window, gram, bits):
    texts = corpus(window * 100 + bits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    rows = S.remove_repeats(docs, window=window, gram=gram, bits=bits, keep=["doc_id"]).collect()
    gone = brute(texts, window)
    assert len(rows) == len(texts)
    for r in rows:
        assert gone_positions(r["repeat_spans"]) == gone[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len((texts[r["doc_id"]] or "").split()), len(gone[r["doc_id"]]))
        kept = [w for i, w in enumerate((texts[r["doc_id"]] or "").split()) if i not in gone[r["doc_id"]]]
        assert (r["kept_text"] or "").split() == kept


def test_the_sketch_never_counts_less():
    texts = corpus(7)
    s = S.Slice(texts, 10, 4)
    places, number = s.standing()
    pieces, counts = np.unique(s.pieces[places], return_counts=True)
    more = dict(zip(pieces.tolist(), counts.tolist()))
    words = [w for t in texts for w in (t or "").split()]
    windows: dict[tuple, list[int]] = {}
    for at, i in zip(s.starts.tolist(), number.tolist()):
        windows.setdefault(tuple(words[at:at + 10]), []).append(more[int(s.pieces[places[i]])])
    assert all(min(seen) >= len(seen) for seen in windows.values())


def test_a_hot_passage_is_few_rows(spark):
    """4,000 copies of one passage: each slice sends one row of each window."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.range(4000, numPartitions=4).selectExpr("id AS doc_id", f"concat('w', id, ' {passage} v', id) AS text")
    rows = S.remove_repeats(docs, bits=16, keep=["doc_id"])
    assert {(r["n_words"], r["n_removed"], r["kept_text"]) for r in rows.filter("doc_id < 3").collect()} == {(42, 40, f"w{i} \n v{i}") for i in range(3)}
    assert rows.filter("n_removed <> 40").count() == 0


def test_digest_and_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(36))
    docs = spark.createDataFrame([(1, text, "c", "c"), (2, f"z {text}", "c", "c"), (3, "one", "c", "c")], "doc_id int, text string, uid string, n_words string")
    out = S.remove_repeats(docs, bits=10, result=S.words_digest, result_column="sha")
    assert out.columns == ["doc_id", "text", "uid", "n_words", "n_removed", "repeat_spans", "sha"]
    rows = {r["doc_id"]: r for r in out.collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [rows[i]["sha"] for i in (1, 2, 3)] == [digest(""), digest("z"), digest("one")]
    assert rows[2]["uid"] == "c" and rows[2]["n_words"] == 37
