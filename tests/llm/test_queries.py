"""The registered queries: SQL and brute force on the small tables, and what they give for odd rows and empty tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from answerlake.llm import quality, registry, simhash
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SAME = "Some words that stand here twice, and then once more, with the number +1 (555) 123-4567 in them and a full stop at the end."
#: doc_id, text: nulls, blanks, a very long text, ties, repeated rows, rows without an id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, SAME), (5, SAME), (6, SAME), (None, SAME), (None, None), (7, "\U0001f600 é ß 漢字"), (8, "x" * 200_000)]
CLASH = ["kept", "score", "fp", "n_words", "size", "taken", "spans", "text_hash", "verdict", "row", "counts", "uid", "leak_spans", "votes", "id", "masked", "component_id", "target"]


def _write(folder, empty: bool) -> str:
    n = 0 if empty else len(ODD)
    docs = {"doc_id": pa.array([d for d, _ in ODD][:n], pa.int64()), "text": pa.array([t for _, t in ODD][:n], pa.string()),
            "lang": pa.array(["en", None, "de", "en", "en", "en", "fr", None, "x", "y", "en"][:n], pa.string()),
            "source": pa.array(["a", None, "b", "a", "a", "a", None, "c", "c", "a", "b"][:n], pa.string()),
            "n_chars": pa.array([None if t is None else len(t) for _, t in ODD][:n], pa.int64())}
    docs |= {c: pa.array(["clash"] * n, pa.string()) for c in CLASH}
    pq.write_table(pa.table(docs), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 5, 5, None, 99][:n], pa.int64()), "quality": pa.array([0, 1, 0, 1, None][:n], pa.int64()),
                             "toxic": pa.array([0, 0, 0, 0, 0][:n], pa.int64())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 2, None, 3][:n], pa.int64()), "text": pa.array([SAME, None, "", SAME, "w1 w2 w3"][:n], pa.string())}),
                   folder / "benchmark.parquet")
    pq.write_table(pa.table({"page_id": pa.array([1, 2, 2, None, 3, 4, 5][:n], pa.int64()),
                             "url": pa.array([None, "", "no scheme", "http://A.Example.com/en/x?y", "HTTP://u", "s://h#f", "https://x.net/es/" + "a" * 100_000][:n], pa.string()),
                             "html": pa.array([None, "", "a", "a", "a", "é" * 100_000, "a"][:n], pa.string()),
                             "header": pa.array(["clash"] * min(n, 7), pa.string())}), folder / "pages.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([1, 1, 1, 1, 1, None, 2, 5, -4][:n], pa.int64()), "turn": pa.array([2, 1, None, 1, 1, 0, 0, None, 3][:n], pa.int64()),
                             "role": pa.array(["user", None, "user", "user", "user", "user", "bot", None, ""][:n], pa.string()),
                             "text": pa.array(["é" * 100_000, SAME, None, "", "", "no one's", SAME, None, "\U0001f600"][:n], pa.string()),
                             **{c: pa.array(["clash"] * min(n, 9), pa.string()) for c in ("place", "check", "conv", "size", "depth")}}), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    ok, message = compare(registry.QUERIES[name](spark, SF), duck(SF), registry.ORACLE[name])
    assert ok, message


def _odd_duck(folder):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = registry.QUERIES[name](spark, odd).collect()
    # Words; nodes: many conversations lose their first turns and have no base to take others from.
    counts = {"op9_warc": 7, "op10_urls": 7, "op11_spelling": 0, "op12_prefixes": 5}
    assert len(rows) == counts.get(name, len(ODD))


@pytest.mark.parametrize("name", ["op1_quality", "op4_licenses", "op8_mix", "op9_warc", "op10_urls", "op11_spelling", "op12_prefixes", "op13_substrings"])
def test_odd_rows_sql(spark, odd, name):
    ok, message = compare(registry.QUERIES[name](spark, odd), _odd_duck(odd), registry.ORACLE[name])
    assert ok, message


def test_odd_counts(spark, odd):
    by_id = {r["doc_id"]: r for r in registry.QUERIES["op1_quality"](spark, odd).collect()}
    assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[4]["n_words"] == 60_000 and by_id[4]["n_repeat_words"] == 60_000


def test_odd_components(spark, odd):
    rows = registry.QUERIES["op3_simhash"](spark, odd).collect()
    zero = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    same = [r["component_id"] for r in rows if r["fingerprint"] == f"{simhash.fingerprint(SAME):016x}"]
    assert zero == {1} and same == [5] * 4


def test_odd_archive(spark, odd):
    rows = {(r["page_id"], r["payload_bytes"]): r for r in registry.QUERIES["op9_warc"](spark, odd).collect()}
    assert rows[1, 0]["record_type"] == "revisit" and rows[1, 0]["refers_to"] == 2
    assert rows[2, 0]["record_type"] == "response" and rows[5, 1]["record_type"] == "response"
    assert rows[None, 1]["refers_to"] == 5 and rows[4, 200_000]["refers_to"] is None
    assert rows[2, 0]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_odd_urls(spark, odd):
    rows = {r["page_id"]: r for r in registry.QUERIES["op10_urls"](spark, odd).filter("page_id IS NOT NULL AND page_id <> 2").collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"]) == ("", "", None)
    assert (rows[3]["host"], rows[4]["host"], rows[4]["path"]) == ("u", "h", "")
    assert (rows[5]["rule"], rows[5]["verdict"]) == ("net/es/", "block")


# --- brute force on the small tables ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_quality_counts(spark, texts):
    for r in registry.QUERIES["op1_quality"](spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen: dict = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i:i + 8]), []).append(i)
        repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_quality_em_is_brute_force_em(spark):
    patterns = [([1, -1, 0], 40), ([1, 1, 1], 300), ([-1, -1, 1], 30), ([0, 0, -1], 15), ([-1, 0, -1], 12)]
    got = {tuple(r["votes"]): r["posterior"] for r in quality.posteriors(spark.createDataFrame(patterns, "votes array<int>, n long"), 3).collect()}
    votes, n = np.array([p for p, _ in patterns]), np.array([k for _, k in patterns], float)
    prior, right, held = quality.PRIOR, np.full(3, quality.ACCURACY), n.sum() * quality.PRIOR_SHARE + 1
    for step in range(quality.ITERATIONS + 1):
        g = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right)))))
        if step < quality.ITERATIONS:
            hits = (np.where(votes == 1, g[:, None], np.where(votes == -1, 1 - g[:, None], 0)) * n[:, None]).sum(0)
            right = (hits + quality.ACCURACY * held) / (((votes != 0) * n[:, None]).sum(0) + held)
            prior = ((g * n).sum() + quality.PRIOR * held) / (n.sum() + held)
    assert all(abs(got[tuple(v)] - p) < 1e-9 for v, p in zip(votes.tolist(), g))


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.QUERIES["op1_quality"](spark, sf).join(labels, "doc_id").filter("NOT base_failed").select("kept", "quality").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def _pages_of_kinds(n_good, n_blank, n_three, n_hot, hot, copies=1):
    """(doc_id, text): good prose, texts on which all rules abstain, texts with three bad votes, and texts that trip ``hot`` alone."""
    plain = lambda k, i, n: [f"{k}{i}x{j}word" for j in range(n)]
    one = {"symbols": lambda i: " ".join("#" + w for w in plain("h", i, 30)), "capitals": lambda i: " ".join(plain("h", i, 30)).replace("word", "WORDS").replace("h", "H"),
           "shouting": lambda i: " ".join("!" + w if j % 5 == 0 else w for j, w in enumerate(plain("h", i, 30)))}[hot]
    texts = [". ".join(" ".join(plain(f"g{k}", i, 10)) for k in range(6)) + "." for i in range(n_good)]
    texts += [" ".join(plain("b", i, 30)) for i in range(n_blank)]
    texts += [" ".join(w + "##" for w in plain("t", i, 30)) for i in range(n_three)]
    texts += [one(i) for i in range(n_hot) for _ in range(copies)]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot, n_hot, copies", [("symbols", 100, 1), ("symbols", 450, 1), ("symbols", 1, 450), ("capitals", 450, 1), ("shouting", 450, 1)])
def test_quality_hot_group_of_one_rule(spark, hot, n_hot, copies):
    """A tenth, a third or many copies of junk that trips one rule: texts with three bad votes still go, good ones stay."""
    docs = spark.createDataFrame(_pages_of_kinds(700, 140, 60, n_hot, hot, copies), "doc_id long, text string")
    rows = quality.judge(docs, keep=["doc_id"]).collect()
    kinds = [[r["kept"] for r in rows if a <= r["doc_id"] < b] for a, b in ((0, 700), (700, 840), (840, 900), (900, 10_000))]
    assert all(kinds[0]) and all(kinds[1]) and not any(kinds[2])
    assert len(rows) == 900 + n_hot * copies and (copies > 1 or n_hot < 450 or not any(kinds[3]))


def test_quality_abstaining_tables_stay(spark):
    """Few good votes, half abstentions and lone bad votes: the prior does not collapse."""
    patterns = [([0] * 8 + [1], 200), ([0] * 9, 500), ([0] * 8 + [-1], 300)]
    got = [r["posterior"] for r in quality.posteriors(spark.createDataFrame(patterns, "votes array<int>, n long"), 9, guarded=True).orderBy("votes").collect()]
    assert got[0] < 0.5 <= got[1] < got[2]


def _components(prints, max_bits=3):
    """Brute force: all pairs of distinct fingerprints."""
    values = sorted(set(prints.values()))
    root = {v: v for v in values}
    find = lambda v: v if root[v] == v else find(root[v])
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    low: dict = {}
    for d, v in prints.items():
        low[find(v)] = min(low.get(find(v), d), d)
    return {d: low[find(v)] for d, v in prints.items()}


def test_simhash_on_documents(spark, texts):
    import xxhash

    def slow(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        if not words:
            return 0
        runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: slow(t) for d, t in texts.items()}
    want = _components(prints)
    for r in registry.QUERIES["op3_simhash"](spark, SF).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("hot", [2, 5, 10_000])
def test_simhash_links_near_and_dense(spark, hot):
    """Chains, stars and dense groups, with few and with all values dealt out."""
    rng = random.Random(hot)
    prints, n = {}, 0
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            value = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6])):
                value ^= 1 << b
            base = value if rng.random() < 0.3 else base
            prints[n] = value
            n += 1
    df = spark.createDataFrame([(d, simhash.signed(v)) for d, v in prints.items()], "doc_id long, fp long")
    classes = df.select("fp").distinct()
    got = {(r["a"], r["b"]) for r in simhash.links(classes, hot=hot).collect()}
    values = sorted({simhash.signed(v) for v in prints.values()})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want
    components = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert components == _components(prints)


def test_simhash_thresholds():
    chosen, cost = simhash.allocate([[0, 5, 9, 30, 99], [0, 1, 2, 50, 99], [0, 7, 70, 99, 99]], 4)
    assert sum(t + 1 for t in chosen) == 4 and cost == min(
        a + b + c for i, a in enumerate([0, 5, 9, 30, 99]) for j, b in enumerate([0, 1, 2, 50, 99]) for k, c in enumerate([0, 7, 70, 99, 99]) if i + j + k == 4)


# --- pipeline --------------------------------------------------------------------------------------------------------


def _run(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs)
    return out


def test_pipeline_stages(spark, tmp_path, texts):
    """Each stage against brute force on what the one before kept."""
    from answerlake.llm import decontaminate, pii
    first, second, third, fourth, last = [[r.asDict() for r in d.collect()] for d in _run(spark, SF, tmp_path)]
    kept = {r["doc_id"] for r in registry.QUERIES["op1_quality"](spark, SF).filter("kept").collect()}
    assert {r["doc_id"] for r in first} == kept and len(first) == len(kept)
    assert all(r["text"] == texts[r["doc_id"]] for r in first)
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in first}
    assert sorted(r["doc_id"] for r in second) == sorted(set(_components(prints).values()))
    items = [(r["item_id"], decontaminate.words(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    windows = {tuple(w[i:i + min(10, len(w))]) for _, w in items for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    dirty = 0
    after = {r["doc_id"]: r for r in third}
    for r in second:
        w = decontaminate.words(r["text"])
        hit = {j for k in sizes for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in windows for j in range(i, i + k)}
        dirty += bool(hit)
        if len(hit) > 0.5 * len(w):
            assert r["doc_id"] not in after
        elif hit:
            left = decontaminate.words(after[r["doc_id"]]["text"])
            assert left == [x for i, x in enumerate(w) if i not in hit]
            assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
        else:
            assert after[r["doc_id"]] == r
    assert dirty
    assert len(fourth) == len(third) and all(not pii.spans(r["text"])[0] for r in fourth)
    assert {r["doc_id"] for r in fourth if r["text"] == after[r["doc_id"]]["text"]} == {d for d, r in after.items() if not any(pii.spans(r["text"]))}
    by_source: dict = {}
    for r in last:
        by_source.setdefault(r["source"], []).append(r)
    assert all(sum(r["taken"] for r in rows) == int(rows[0]["target"]) for rows in by_source.values())


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    stages = _run(spark, odd, tmp_path / "odd")
    columns = spark.read.parquet(f"{odd}/documents.parquet").columns
    assert all(d.columns == columns for d in stages[:-1])
    assert all(d.count() == 0 for d in _run(spark, empty, tmp_path / "empty"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_keeps_one_of_equal_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, odd).write.parquet(str(tmp_path / "x"))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "x")).collect()]
    assert (5, SAME) in rows and sum(t == SAME for _, t in rows) == 1
    assert [d for d, t in rows if not (t or "").strip()] == [1]
