import random

import pytest

from pyspark.sql import functions as F

from sentrymill.operators import cluster as CL
from sentrymill.operators.spread import join_unique, neighbour_text, numbered, ranges, run_starts
from sentrymill.streaming.incremental import open_events


def sequential(articles):
    """One article after the other against the events known so far."""
    events, links = {}, {}
    for article_id, key, kind in sorted(articles):
        target = None
        if key is not None:
            target = min((e for e, (k, _) in events.items() if k == key), default=None)
        if target is None:
            target = article_id
            events[target] = (key, set())
        links[article_id] = target
        kinds = events[target][1] | ({kind} - {"none"})
        # An event of activity sources only loses its name, so nothing finds it again.
        closed = "activity" in kinds and "incident" not in kinds
        events[target] = (None if closed else events[target][0], kinds)
    return links


@pytest.mark.parametrize("seed", range(4))
def test_closed_form_equals_sequential_loop(spark, seed):
    rng = random.Random(seed)
    articles = [(i, rng.choice([None, "n:a", "n:b", "n:c", "n:hot", "n:hot", "n:hot"]),
                 rng.choice(["incident", "activity", "activity", "none", "none"] if seed else ["activity", "none"]))
                for i in rng.sample(range(1000), 250)]
    frame = spark.createDataFrame(articles, "article_id bigint, cluster_key string, kind string")
    # Many ranges and low hot limits send the rows through every branch.
    got = {r[0]: r[1] for r in CL.assign_clusters(frame, parts=40, hot_rows=20).collect()}
    assert got == sequential(articles)


def test_batches_attach_to_open_events(spark):
    rng = random.Random(9)
    articles = [(i, rng.choice(["a", "b", "c", "d"]), rng.choice(["incident", "activity", "none"])) for i in range(60)]
    frame = spark.createDataFrame([(i, k, None, None if s == "none" else s) for i, k, s in articles],
                                  "article_id bigint, victim_org_name string, victim_org_normalized string, signal_kind string")
    whole = {r[0]: r[1] for r in CL.assign_clusters(CL.with_keys(frame)).collect()}
    first = frame.filter("article_id < 25")
    links = first.join(CL.assign_clusters(CL.with_keys(first)), "article_id")
    later = CL.assign_clusters(CL.with_keys(frame.filter("article_id >= 25")), open_events(links))
    got = {r[0]: r[1] for r in links.select("article_id", "event_id").unionByName(later).collect()}
    assert got == whole


def test_join_unique_covers_hot_and_cold_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "id bigint, k string")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    left = left.unionByName(spark.createDataFrame([(200, None)], left.schema))
    got = join_unique(left, right, "k", "n", "id", hot_rows=10).collect()
    assert len(got) == 91 and {(r["k"], r["n"]) for r in got if r["id"] % 3} == {("hot", 60), (None, None)}


def test_join_unique_spreads_hot_rows(spark, tmp_path):
    """Nine rows of ten share a key, or have none; no task gets them all."""
    for hot in ("'hot'", "null"):
        path = str(tmp_path / hot.strip("'"))
        spark.range(20_000).selectExpr("id", f"if(id % 10 = 0, concat('k', id), {hot}) as k").write.parquet(path)
        left = spark.read.parquet(path)
        joined = join_unique(left, left.groupBy("k").agg(F.count("*").alias("n")), "k", "n", "id", hot_rows=1000)
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            rows = joined.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) < 4000


def test_ranges_cut_a_hot_key(spark, tmp_path):
    """One key has nearly all rows and ids of 62 bits: its rows lie in all ranges, in order, and no task gets them all."""
    path = str(tmp_path / "hot")
    spark.range(100_000).selectExpr("pmod(xxhash64(id), 1L << 62) as id", "if(id % 50 = 0, concat('k', id), 'hot') as k",
                                    "if(id % 3 = 0, 'activity', 'none') as kind").write.parquet(path)
    rows = spark.read.parquet(path)
    cut = ranges(rows, ["k"], ["id"], 16).filter("k = 'hot'").groupBy("_range").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("_range").collect()
    assert len(cut) >= 15 and max(r["n"] for r in cut) < 15_000
    assert all(a["high"] < b["low"] for a, b in zip(cut, cut[1:]))
    want, seed, opens = {}, None, True
    for r in rows.filter("k = 'hot'").orderBy("id").collect():
        seed = r["id"] if opens else seed
        want[r["id"]], opens = seed, r["kind"] == "activity"
    got = run_starts(rows.withColumn("seed", F.col("id")), "k", "id", "kind", "seed", "activity", "run", 16).filter("k = 'hot'")
    assert {r["id"]: r["run"] for r in got.collect()} == want


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"u{i}") for i in range(1000)], "at int, u string")
    got = sorted((r["number"], r["at"]) for r in numbered(rows, ["at", "u"], "number", 5, parts=7).collect())
    assert got == [(6 + i, i) for i in range(1000)]
    assert numbered(rows.limit(0), ["at"], "number").count() == 0


@pytest.mark.parametrize("parts", [1, 13, 60])
def test_neighbour_text_equals_joined_text(spark, parts):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abcdef") for _ in range(rng.choice([2, 3, 5, 40]))) for i in rng.sample(range(300), 60)}
    reach = 25
    frame = spark.createDataFrame([(i, "e", t) for i, t in texts.items()], "article_id bigint, e string, t string")
    got = {r["article_id"]: (r["before_text"], r["after_text"]) for r in neighbour_text(frame, "e", "article_id", "t", reach, parts).collect()}
    order = sorted(texts, reverse=True)
    for pos, i in enumerate(order):
        before = " ".join(texts[j] for j in order[:pos])[-reach:] or None
        after = " ".join(texts[j] for j in order[pos + 1:])[:reach] or None
        assert got[i] == (before, after)


def test_reconcile_and_aliases(spark):
    events = spark.createDataFrame(
        [(1, "Acme (ACM)", "acme", "Kenya", "DDoS"), (2, "Other Corp (ACM)", "other", "Kenya", "DDoS"), (3, "ACME Inc", "acme", "Kenya", "DDoS"), (4, None, None, None, "DDoS")],
        "event_id bigint, victim_org_name string, victim_org_normalized string, country string, attack_type string")
    links = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "event_id bigint, article_id bigint")
    assert {tuple(r) for r in CL.reconcile(links, events).collect()} == {(1, 10), (2, 20), (1, 30), (4, 40)}
    assert {tuple(r) for r in CL.resolve_aliases(events).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    kept, orphaned = CL.drop_articles(links, spark.createDataFrame([(20,), (99,)], "article_id bigint"))
    assert {r["article_id"] for r in kept.collect()} == {10, 30, 40} and [r[0] for r in orphaned.collect()] == [2]
