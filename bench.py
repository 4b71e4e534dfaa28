"""Time the headline queries; prints one JSON line.

Each query is run to the end (rows are computed and thrown away) twice on
``local[$BENCH_CPUS]``; the faster run counts, planning included.
"""

from __future__ import annotations

import json
import os
import time

from checks import registry
from checks.all import load
from markbook.session import build_session

HEADLINE = (
    "reading_level_by_language",
    "word_syllables",
    "question_evaluation",
    "quality_advice",
    "scoring_advice",
    "agreement_at_volume",
    "category_distribution",
    "document_rules",
    "answer_similarity",
    "short_answer_similarity_scores",
    "test_scores",
    "score_rollup",
    "learner_recommendations",
    "training_examples",
    "stratified_split_at_volume",
    "tokenized_examples",
    "question_plan",
    "prompts",
    "generated_questions",
    "parsed_questions",
    "subject_shares",
    "annual_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    load()
    spark = build_session(
        name="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
