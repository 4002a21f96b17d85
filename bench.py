"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs in full into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from medialoom.plans import load_all  # noqa: E402
from medialoom.plans.registry import QUERIES  # noqa: E402
from medialoom.session import build_session  # noqa: E402

HEADLINE = [
    "sentence_prepare",
    "doc_bias_score",
    "frame_topic_keywords",
    "keyword_quota",
    "focus_keywords",
    "emotion_spans",
    "title_body_gap",
    "vector_topk",
    "video_context",
    "search_rank",
    "related_rank",
    "country_issue_kpi",
    "bridge_channels",
    "dq_summary",
    "rank_stability",
    "ndcg_metrics",
    "lexicon_mine",
    "review_candidates",
    "ingest_candidates",
    "upsert_latest",
    "stream_ingest_jobs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus) if cpus.isdigit() else 8)),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
