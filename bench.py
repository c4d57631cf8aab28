"""Benchmark the headline queries.

Runs each query fully (``noop`` sink: every row is produced, nothing is
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one JSON
line with the median of ``$BENCH_REPEATS`` runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "retrieve_top1",            # corpus -> paragraphs -> TF-IDF -> top-1 (entry query)
    "retrieve_threshold",       # char chunks -> TF-IDF -> threshold hits
    "tfidf_postings",           # index build
    "context_prompts",          # hits -> ordered contexts -> budgeted prompts
    "chunk_tokens_greedy",      # sequential packing per document
    "dense_topk_nearest",       # exact cosine top-k
    "classify_centroid",        # centroid classification
    "vote_pivot",               # category x vote pivot
    "milestones",               # n-th event badges
    "first_vote_per_question",  # as-of vote matching + first vote
    "eval_multi_context_pairs", # rare-term self join
    "stream_answer",            # streaming questions vs static index
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE

    from answerlake.plans.catalog import QUERIES
    from answerlake.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          app_name="answerlake-bench")

    results: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        runs = []
        try:
            for _ in range(repeats):
                t = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        results[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {results[name]}s (runs {[round(r, 2) for r in runs]})", file=sys.stderr, flush=True)

    if not sys.argv[1:]:
        # the stored index apart: the queries above open what the first of them built
        from answerlake.operators import segments
        from answerlake.operators.pruned import Blocks
        from answerlake.plans import corpus
        from answerlake.plans.catalog import C, served
        from answerlake.session import shared_path
        t = time.perf_counter()
        path = shared_path(spark, "bench-index")
        segments.append(corpus.paragraphs(spark, sf_dir), path, C.PARA_KEYS, ["documents"], keep=("source",))
        blocks = Blocks(spark, path)
        results["index_build"] = round(time.perf_counter() - t, 3)
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            served(blocks, C.questions(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        results["index_serve"] = round(statistics.median(runs), 3)

    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(v for k, v in results.items() if not k.startswith("index_")), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeats": repeats,
        "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "failed": failed,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
