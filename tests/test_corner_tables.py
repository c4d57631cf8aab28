"""Queries against their SQL on tables made to reach the branches that the test tables do not: questions without a
hit, the zero branch, truncated prompts, sentinels, missing vectors, turns from 1000 on, empty texts."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from answerlake.plans.catalog import QUERIES
from answerlake.plans.oracle import ORACLE
from tests.oracle_compare import compare

LONG = " ".join(f"word{i % 700} and" for i in range(2600))
DOCS = [(0, "a", "alpha beta gamma\n\nshort line"), (1, "b", f"{LONG} gamma delta\nepsilon zeta"), (2, "a", ""), (3, "b", "eta theta, iota.\n alpha beta ")]
QUESTIONS = [(0, "alpha beta"), (1, "zzzz qqqq"), (2, "word1 word2 word3 and"), (3, "Theta\niota?"), (4, ""), (5, "no such thing")]
TURNS = [(1, 0, "system", "alpha facts"), (1, 1, "user", "exit"), (1, 2, "assistant", "bye"), (1, 3, "user", "QUIT"), (1, 4, "assistant", "ok"),
         (1, 5, "user", ""), (1, 6, "assistant", "what"), (1, 1000, "user", "alpha?"), (1, 1001, "assistant", "alpha facts. More words here!"),
         (2, 0, "user", "beta"), (2, 1, "assistant", "nothing like it"), (2, 2, "user", "open question"), (3, 0, "user", "gamma"), (3, 1, "assistant", "")]
VECTORS = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 1), (3, [1.0, 1.0], 30), (4, [-1.0, 0.5], 1), (5, [0.5, 0.5], 0)]


@pytest.fixture(scope="module")
def corner(tmp_path_factory):
    out = tmp_path_factory.mktemp("corner")
    tables = {
        "documents": {"doc_id": [d[0] for d in DOCS], "text": [d[2] for d in DOCS], "lang": ["en"] * 4, "source": [d[1] for d in DOCS], "n_chars": [len(d[2]) for d in DOCS]},
        "benchmark": {"item_id": [q[0] for q in QUESTIONS], "text": [q[1] for q in QUESTIONS]},
        "conversations": {c: [t[i] for t in TURNS] for i, c in enumerate(("conv_id", "turn", "role", "text"))},
        "embeddings": {"vec_id": pa.array([v[0] for v in VECTORS], pa.int64()), "embedding": pa.array([v[1] for v in VECTORS], pa.list_(pa.float32())), "label": pa.array([v[2] for v in VECTORS], pa.int64())},
    }
    con = duckdb.connect()
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), out / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{out}/{name}.parquet')")
    return str(out), con


@pytest.mark.parametrize("name", [
    "retrieve_top1", "retrieve_top1_allow_zero", "serve_top1", "stream_answer", "prompt_budget", "context_prompts", "context_rows", "request_bodies",
    "sentinel_filter", "latest_question", "response_rows", "response_records", "context_support", "answer_scores", "embed_join_filter",
    "dense_topk_nearest", "dense_topk_farthest", "classify_centroid", "truncate_tokens", "dense_context_prompts", "token_stats", "chunk_tokens_greedy",
    "question_rows", "classify_terms"])
def test_corner_tables(spark, corner, name):
    ok, message = compare(QUERIES[name](spark, corner[0]), corner[1], ORACLE[name])
    assert ok, message


def test_the_branches_are_reached(spark, corner):
    rows = {n: [r.asDict() for r in QUERIES[n](spark, corner[0]).collect()] for n in ("retrieve_top1", "retrieve_top1_allow_zero", "prompt_budget", "sentinel_filter", "truncate_tokens")}
    assert {r["item_id"] for r in rows["retrieve_top1"] if r["response"]} >= {1, 4, 5}
    assert any(r["score"] == 0.0 for r in rows["retrieve_top1_allow_zero"])
    assert any(r["truncated"] == 1 and r["final_tokens"] < r["prompt_tokens"] for r in rows["prompt_budget"])
    assert sorted((r["conv_id"], r["turn"]) for r in rows["sentinel_filter"]) == [(1, 1000), (2, 0)]
    assert any(r["n_tokens"] > 100 for r in rows["truncate_tokens"])
