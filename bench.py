"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``values`` are the best of $BENCH_RUNS runs after one warm-up of the session. The ``short_*``
queries use the clauses of the documents as reviews: as short as real ones, and far more rows,
so that they show throughput and not planning time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plaudit.functions import text as T  # noqa: E402
from plaudit.operators import cleaning as N  # noqa: E402
from plaudit.operators import keywords as K  # noqa: E402
from plaudit.operators import models as M  # noqa: E402
from plaudit.operators import ratings as R  # noqa: E402
from plaudit.operators import spam as X  # noqa: E402
from plaudit.operators.scale import stored  # noqa: E402
from plaudit.plans import catalog  # noqa: E402
from plaudit.session import local_session  # noqa: E402
from plaudit.sources import driver_tables as D  # noqa: E402

HEADLINE = [
    "item_scoreboard", "clean_text", "dedup_keep_first", "corpus_profile", "vocab_top",
    "encode_supervised", "sample_per_item", "best_threshold", "auc_rank", "aspect_rollup",
    "aspect_evidence", "pros", "keywords_topk", "spam_detail", "spam_summary", "spam_top8",
    "item_summary", "quality_checks", "event_day_volume", "event_user_burst", "stream_dedup",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def short_reviews(spark, sf):
    docs = D.reviews(spark, sf)
    parts = T.clauses(F.col("comment"), D.ASPECTS.clause_pattern, 3)
    rows = docs.select(
        "row_id", "item", "item_label", "star", "likes", F.posexplode(parts).alias("at", "comment")
    )
    key = F.col("row_id") * 100_000 + F.col("at")
    return rows.select(
        key.alias("row_id"), "item", "item_label", F.pmod(F.xxhash64("comment"), F.lit(50_000)).alias("user_id"),
        F.pmod(F.col("at") + F.col("row_id"), F.lit(365)).cast("int").alias("day_no"), "star", "likes", "comment",
    )


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, "bench")
    seconds: dict[str, float] = {}

    def clock(name: str, job) -> None:
        best = None
        for _ in range(runs):
            t0 = time.time()
            job()
            took = time.time() - t0
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    drain(catalog.QUERIES["spam_summary"](spark, "/root/testdata/sf0.001"))
    for name in HEADLINE:
        clock(name, lambda: drain(catalog.QUERIES[name](spark, sf)))

    raw, rows = stored(short_reviews(spark, sf))

    def prepare():
        return M.attach_lexicon_scores(N.dedup_keep_first(N.clean_reviews(raw)), D.SENTIMENT)

    read = {"short_prepare_and_score": rows}
    clock("short_prepare_and_score", lambda: drain(prepare()))
    scored, kept = stored(prepare())

    def spam():
        base, _ = stored(X.signal_base(scored, D.SPAM))
        drain(X.spam_summary(X.spam_detail(base, D.SPAM)))

    clock("short_spam", spam)
    clock("short_keywords", lambda: drain(K.top_keywords(K.log_odds(K.word_bags(scored, D.KEYWORDS), D.KEYWORDS), D.KEYWORDS)))
    clock("short_aggregate", lambda: drain(R.item_summary(R.item_scores(R.item_stats(scored)))))

    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "short_rows": rows, "short_rows_kept": kept,
        "rows_per_sec": {n: round(read.get(n, kept) / seconds[n]) for n in seconds if n.startswith("short_")},
    }))


if __name__ == "__main__":
    main()
