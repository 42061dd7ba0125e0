"""Headline timings: python bench.py prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose data, cores and repetitions (median).
Every stage is timed on tables written by the stage before it, as in a real run.
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sentrymill import corpus
from sentrymill.catalog.queries import Tables
from sentrymill.operators import attribute, merge, serve
from sentrymill.operators.spread import staged
from sentrymill.plans import pipeline
from sentrymill.sources import landed
from sentrymill.streaming import incremental

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    t = Tables(spark, SF_DIR)
    articles = staged(t.articles, "articles")
    decided = staged(pipeline.process(articles), "decided")
    extracted = staged(pipeline.extract(decided), "extracted")
    linked = staged(pipeline.link(extracted), "linked")
    events = staged(merge.merge_events(linked), "events")
    attributed = staged(attribute.attribute_events(events, linked, t.dictionary), "attributed")
    now = articles.agg(F.max("published_at")).first()[0]

    def write(frame):
        frame.write.format("noop").mode("overwrite").save()

    def stream():
        out = tempfile.mkdtemp(prefix="bench-x6-")
        clicks = spark.readStream.schema(t.table("events").schema).parquet(f"{SF_DIR.rstrip('/')}/events.parque[t]")
        incremental.start(incremental.windowed_counts(clicks, "event_type", "ts", "1 day", None, "0 seconds"),
                          out + "/checkpoint", path=out + "/out").awaitTermination()

    families = {
        "process": lambda: write(pipeline.process(articles)),
        "extract": lambda: write(pipeline.extract(decided)),
        "cluster": lambda: write(pipeline.link(extracted)),
        "merge": lambda: write(merge.merge_events(linked)),
        "attribute": lambda: write(attribute.attribute_events(events, linked, t.dictionary)),
        "feed": lambda: write(serve.feed(serve.filtered_events(attributed, now, signal_type="incident"), 100)),
        "payload": lambda: write(serve.feed_payload(attributed, linked, now)),
        "summary": lambda: write(serve.summary_cards(attributed, now)),
        "trends": lambda: (write(serve.rising_attack_types(attributed, now)), write(serve.source_coverage(attributed, linked))),
        "facets": lambda: write(serve.facet_counts(attributed, {"industry": "Technology"})),
        "page_text": lambda: write(landed.page_status(t.table("pages"))),
        "stream_windows": stream,
    }
    seconds = {}
    for name, work in families.items():
        work()
        laps = []
        for _ in range(RUNS):
            started = time.perf_counter()
            work()
            laps.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(laps), 3)
    print(json.dumps({"metric": "pipeline and serving seconds, sum of medians", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").split("sf")[-1],
                      "rows": {"articles": articles.count(), "events": events.count()}}))


if __name__ == "__main__":
    main()
