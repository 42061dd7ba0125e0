from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrymill import corpus
from sentrymill.operators import merge as MG
from sentrymill.operators import quality as DQ
from sentrymill.operators import serve as SV
from sentrymill.plans import pipeline
from sentrymill.sources.actors import actor_dictionary
from sentrymill.streaming import incremental as INC
from sentrymill.streaming.state import BucketState, current

SF = "/root/testdata/sf0.001"
NEWS, TRUSTED, ALERT, KEV, FILING = ("incident_news", False), ("incident_news", True), ("official_alert", False), ("exploited_vulnerability", False), ("primary_disclosure", True)
# (sources, primary evidence, actor) -> status, level, score
TRUST = [
    ([NEWS], False, None, ("emerging", "low", 25)), ([NEWS], True, None, ("confirmed", "medium", 75)),
    ([TRUSTED], False, None, ("confirmed", "high", 80)), ([ALERT], False, None, ("confirmed", "high", 85)), ([KEV], False, None, ("confirmed", "high", 85)),
    ([FILING], False, None, ("confirmed", "high", 90)), ([NEWS] * 2, False, None, ("confirmed", "high", 75)), ([NEWS] * 3, False, None, ("confirmed", "high", 78)),
    ([NEWS] * 4, False, None, ("confirmed", "high", 81)), ([NEWS] * 5, False, None, ("confirmed", "high", 84)), ([NEWS] * 9, False, None, ("confirmed", "high", 84)),
    ([NEWS] * 2, False, "X", ("confirmed", "high", 80)), ([FILING], True, "X", ("confirmed", "high", 95)),
]


def link_row(article, event, source, **over):
    row = dict(article_id=article, event_id=event, source_name="s", source_class=source[0], tier_trusted_alone=source[1], signal_kind="incident",
               title="T", published_at=datetime(2025, 1, 1), is_primary_source=False, victim_org_name="Acme", victim_org_normalized="acme",
               victim_display_label="Acme", victim_entity_type="organization", industry="Unknown", region=None, country=None,
               attack_type="Unknown", short_event_summary=None)
    return {**row, **over}


LINK_SCHEMA = ("article_id bigint, event_id bigint, source_name string, source_class string, tier_trusted_alone boolean, signal_kind string, title string, "
               "published_at timestamp_ntz, is_primary_source boolean, victim_org_name string, victim_org_normalized string, victim_display_label string, "
               "victim_entity_type string, industry string, region string, country string, attack_type string, short_event_summary string, irrelevant boolean")


def linked(spark, rows):
    names = [f.split()[0] for f in LINK_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"irrelevant": False, **r}[n] for n in names) for r in rows], LINK_SCHEMA)


def test_trust_table(spark):
    rows = [link_row(e * 100 + i, e, s, is_primary_source=evidence) for e, (sources, evidence, _, _) in enumerate(TRUST) for i, s in enumerate(sources)]
    events = MG.merge_events(linked(spark, rows))
    actors = spark.createDataFrame([(e, actor) for e, (_, _, actor, _) in enumerate(TRUST)], "event_id bigint, a string")
    final = MG.final_trust(events.join(actors, "event_id").withColumn("actor_name", F.col("a")))
    got = {r["event_id"]: (r["event_status"], r["confidence_level"], r["confidence_score"]) for r in final.collect()}
    assert got == {e: want for e, (_, _, _, want) in enumerate(TRUST)}


def test_golden_record(spark):
    rows = [
        link_row(1, 1, NEWS, attack_type="DDoS", country="Kenya", title="first", published_at=datetime(2025, 1, 3)),
        link_row(2, 1, NEWS, attack_type="Malware", industry="Energy", title="second", short_event_summary="S2", published_at=datetime(2025, 1, 4)),
        link_row(3, 1, FILING, attack_type="Unknown", title="filing", source_name="sec-edgar-cyber-8k", published_at=datetime(2025, 1, 1)),
        link_row(4, 4, NEWS, irrelevant=True), link_row(5, 5, NEWS, victim_org_name="CVE-2025-1", victim_display_label="cve-2025-1"),
        link_row(6, 6, ALERT, signal_kind="activity", title="actively exploited"), link_row(7, 7, NEWS, victim_org_name=None, victim_org_normalized=None),
    ]
    got = {r["event_id"]: r for r in MG.merge_events(linked(spark, rows)).collect()}
    assert set(got) == {1, 5, 6, 7}
    one = got[1]
    assert (one["attack_type"], one["industry"], one["country"], one["region"], one["canonical_title"], one["summary_short"]) == (
        "Malware", "Energy", "Kenya", "Africa", "filing", "S2")
    assert (one["first_seen_at"], one["last_seen_at"], one["source_count"]) == (datetime(2025, 1, 3), datetime(2025, 1, 4), 3)
    assert (got[5]["victim_org_name"], got[5]["victim_display_label"]) == (None, None)
    assert (got[6]["event_signal_type"], got[6]["victim_org_name"], got[6]["is_high_impact"]) == ("activity", None, True)
    assert (got[7]["event_signal_type"], got[7]["is_high_impact"]) == ("intelligence", False)


def test_merge_keeps_earlier_values(spark):
    first = MG.merge_events(linked(spark, [link_row(1, 1, NEWS, attack_type="DDoS", short_event_summary="old", published_at=datetime(2025, 1, 5))]))
    later = MG.merge_events(linked(spark, [link_row(1, 1, NEWS, industry="Energy", published_at=datetime(2025, 1, 1))]),
                            first.withColumn("actor_name", F.lit("Play")).withColumn("attribution_status", F.lit("claimed")))
    row = later.first()
    assert (row["attack_type"], row["summary_short"], row["industry"], row["actor_name"], row["confidence_score"]) == ("DDoS", "old", "Energy", "Play", 30.0)
    assert (row["first_seen_at"], row["last_seen_at"]) == (datetime(2025, 1, 5), datetime(2025, 1, 5))


@pytest.fixture(scope="module")
def run(spark):
    return pipeline.run(corpus.articles(spark, SF))


def test_pipeline_properties(spark, run):
    links, events = run.links, run.events
    relevant = run.processed.filter("relevant").count()
    assert links.count() == links.select("article_id").distinct().count() == relevant
    assert events.filter("confidence_score < 0 or confidence_score > 100").count() == 0
    counts = links.groupBy("event_id").count().join(events, "event_id", "full")
    assert counts.filter("not (count <=> source_count)").count() == 0
    assert set(run.seconds) == {"process", "extract", "cluster", "merge", "attribute"}


def test_result_does_not_depend_on_partitions(spark, run):
    again = pipeline.run(corpus.articles(spark, SF).repartition(3, "title"))
    a, b = run.events.drop("considered"), again.events.drop("considered")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_upsert_equals_whole_run(spark, run):
    articles = corpus.articles(spark, SF)
    part = pipeline.run(articles.filter("article_id < 1200"))
    links, events, outcome = INC.upsert_articles(articles.filter("article_id >= 1200"), part.links, part.events.drop("considered", "changed"), actor_dictionary(spark))
    keys = ["event_id", "source_count", "victim_org_name", "event_status", "attack_type", "canonical_title"]
    assert events.select(keys).exceptAll(run.events.select(keys)).count() == 0 and events.count() == run.events.count()
    assert {r["event_action"] for r in outcome.collect()} == {"created", "merged", "irrelevant"}


def test_cluster_stream_keeps_state_by_key(spark, run, tmp_path):
    """Links, events and actors after several epochs equal runs over whole tables; an epoch rewrites its own buckets only."""
    state = str(tmp_path / "state")
    articles = corpus.articles(spark, SF).withColumn("fetched_at", F.col("published_at")).select(
        "article_id", "source_name", "article_url", "title", "summary", "content", "published_at", "fetched_at")
    dictionary, sink = actor_dictionary(spark), INC.cluster_sink(state, buckets=8)
    first, second = articles.filter("article_id < 800"), articles.filter("article_id >= 800")
    sink(first, 0)
    one = pipeline.run(first)
    columns = ["event_id", "source_count", "victim_org_name", "event_status", "actor_name", "actor_type", "attribution_status", "is_high_impact"]

    def same(events):
        got = current(spark, state, "events").select(columns)
        return got.exceptAll(events.select(columns)).count() == 0 and got.count() == events.count()
    assert same(one.events)
    sink(second.unionByName(first.limit(50)), 7)  # a gap in the numbers, and articles that are known
    sink(second.unionByName(first.limit(50)), 7)  # the same epoch once more
    _, events, _ = INC.upsert_articles(second, one.links, one.events.drop("considered", "changed"), dictionary)
    assert same(events) and current(spark, state, "events").filter("actor_name is not null").count() > 0
    assert current(spark, state, "links").select("article_id", "event_id").exceptAll(run.links.select("article_id", "event_id")).count() == 0
    assert current(spark, state, "links").count() == run.links.count()
    # A single article that nothing else goes with: one bucket of events and links changes, the rest is neither read nor written.
    at = datetime(1998, 7, 1)
    lone = spark.createDataFrame([(9_000_001, "bleepingcomputer", "https://news.example.com/lone", "Zebrafish Ltd hit by ransomware attack",
                                   "Hackers stole customer data.", None, at, at)], articles.schema)
    before = BucketState(spark, state, 8, 8).slots
    sink(lone, 8)
    after = BucketState(spark, state, 9, 8).slots
    changed = {k for k in after if after[k] != before.get(k)}
    assert {n for n, _ in changed} == {"links", "events", "open_keys", "seen"} and len(changed) == 4
    assert current(spark, state, "links").count() == run.links.count() + 1
    sink(lone.limit(0), 9)
    assert BucketState(spark, state, 10, 8).slots == after


def test_cluster_stream_equals_batch(spark, run, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    articles = corpus.articles(spark, SF).withColumn("fetched_at", F.col("published_at")).select(
        "article_id", "source_name", "article_url", "title", "summary", "content", "published_at", "fetched_at")
    for low, high in ((0, 800), (800, 2000)):
        articles.filter(F.col("article_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
    stream = INC.article_stream(spark, source, files_per_trigger=1)
    INC.start(stream, str(tmp_path / "cp"), sink=INC.cluster_sink(state, buckets=8)).awaitTermination()
    snapshot = current(spark, state, "events")
    assert snapshot.agg(F.sum("source_count")).first()[0] == run.links.count()
    keys = ["event_id", "source_count", "victim_org_name", "event_status"]
    assert snapshot.select(keys).exceptAll(run.events.select(keys)).count() == 0


def test_filters_and_feed(spark):
    now = datetime(2025, 1, 10)
    rows = [(1, "incident", "Acme", 80.0, True, 2, datetime(2025, 1, 9, 12), "Energy", "DDoS", "Play"), (2, "incident", None, 90.0, False, 2, datetime(2025, 1, 9), "Energy", "DDoS", None),
            (3, "activity", None, 99.0, True, 1, datetime(2025, 1, 1), "Unknown", "Unknown", None), (4, "incident", "B", 80.0, False, 9, datetime(2025, 1, 9), "Tech_x", "Malware", None)]
    events = spark.createDataFrame(rows, "event_id bigint, event_signal_type string, victim_org_name string, confidence_score double, is_high_impact boolean, "
                                   "source_count bigint, last_seen_at timestamp_ntz, industry string, attack_type string, actor_name string")

    def ids(frame):
        return [r["event_id"] for r in frame.collect()]
    assert ids(SV.feed(events)) == [2, 1, 4, 3] and ids(SV.feed(events, 2, 1)) == [1, 4] and ids(SV.feed(events, 0)) == []
    assert sorted(ids(SV.filtered_events(events, now, signal_type="incident"))) == [1, 4]
    assert sorted(ids(SV.filtered_events(events, now, time_range="24h"))) == [1, 2, 4]
    assert sorted(ids(SV.filtered_events(events, now, time_range="1y", industry="ENERGY"))) == [1, 2]
    assert ids(SV.filtered_events(events, now, industry="tech__")) == [4]
    assert SV.most_common_label(events, "attack_type").first()[0] == "DDoS"
    assert SV.most_common_label(events.filter("event_id = 3"), "attack_type").first()[0] == "Unknown"
    assert SV.most_common_label(events.filter("event_id = 9"), "attack_type").first()[0] is None
    assert [tuple(r) for r in SV.rising_attack_types(events, now).collect()] == [("DDoS", 2, 0, 2, True), ("Malware", 1, 0, 1, True)]
    page = SV.page(events, 0, 3).collect()
    assert [r["event_id"] for r in page] == [2, 1, 4] and all(r["has_more"] for r in page)


def test_clean_ups(spark):
    events = spark.createDataFrame([(1, "Alert: x", None, "P"), (2, "Acme", "CVE-2025-1", "P"), (3, None, "Defending against y", None)],
                                   "event_id bigint, victim_org_name string, victim_display_label string, actor_name string").withColumns(
        {n: F.lit(None).cast("string") for n in ("victim_org_normalized", "actor_type", "attribution_status")})
    got = {r["event_id"]: (r["victim_org_name"], r["victim_display_label"], r["actor_name"], r["victim_cleared"]) for r in DQ.clear_bad_victims(events).collect()}
    assert got == {1: (None, None, None, True), 2: ("Acme", None, "P", True), 3: (None, None, None, True)}
