"""Streaming and incremental runs: the same column functions on arriving files.

Progress lives in the checkpoint of the query, not in a status column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.attribute import attribute_events
from ..operators.cluster import assign_clusters, cluster_key, link_articles, source_kind, with_keys
from ..operators.merge import merge_events
from ..operators.spread import staged
from ..plans.pipeline import process_and_extract
from ..sources.actors import actor_dictionary
from ..sources.landed import young
from .state import BucketState

FILE_SCHEMA = ("article_id bigint, source_name string, article_url string, title string, summary string, "
               "content string, published_at timestamp_ntz, fetched_at timestamp_ntz")


def article_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                   file_schema: str = FILE_SCHEMA) -> DataFrame:
    reader = spark.readStream.schema(file_schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def as_instant(col: Column) -> Column:
    """Time without zone read as UTC; watermarks need a point in time."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col).cast("timestamp")


def without_zone(col: Column) -> Column:
    """Back from a point in time to UTC time without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))


def first_by_url(stream: DataFrame, delay: str = "7 days", time_col: str = "fetched_at") -> DataFrame:
    """Drops repeated addresses while the watermark remembers them.

    The time column is a time without zone.
    """
    stream = stream.withColumn(time_col, as_instant(F.col(time_col)))
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["article_url"])


def least_by_url(stream: DataFrame, id_col: str = "article_id") -> DataFrame:
    """The least id per address; run in update mode, the last row of an address holds."""
    return stream.groupBy("article_url").agg(F.min(id_col).alias(id_col))


def update_sink(out_path: str):
    """foreachBatch function: the rows that each epoch changed."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    return write


def extraction_sink(out_path: str):
    """foreachBatch function: verdicts and extraction of each batch, no state."""
    def write(batch: DataFrame, epoch: int) -> None:
        _, extracted = process_and_extract(batch)
        extracted.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    return write


def split_by_age(batch: DataFrame, fetched_col: str = "fetched_at") -> tuple[DataFrame, DataFrame]:
    """Rows within the age limit and rows beyond it."""
    kept = F.coalesce(young(F.col("published_at"), F.col(fetched_col)), F.lit(True))
    return batch.filter(kept), batch.filter(~kept)


def age_limited_sink(out_path: str, late_path: str):
    """foreachBatch function: young rows to one table, old rows to a side table."""
    def write(batch: DataFrame, epoch: int) -> None:
        fresh, late = split_by_age(batch)
        fresh.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        late.write.mode("overwrite").parquet(f"{late_path}/epoch={epoch}")
    return write


def windowed_counts(stream: DataFrame, label_col: str, time_col: str, length: str = "7 days",
                    slide: str | None = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per label in tumbling (no slide) or sliding windows of a time without zone."""
    stream = stream.withColumn(time_col, as_instant(F.col(time_col)))
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return (stream.withWatermark(time_col, delay).groupBy(window.alias("w"), F.col(label_col).alias("label"))
            .agg(F.count("*").alias("n_rows"))
            .select(without_zone(F.col("w.start")).alias("window_start"),
                    without_zone(F.col("w.end")).alias("window_end"), "label", "n_rows"))


def first_last_seen(stream: DataFrame, key_col: str, time_col: str) -> DataFrame:
    """First and last time per key; run in update mode."""
    return stream.groupBy(key_col).agg(F.min(time_col).alias("first_seen_at"), F.max(time_col).alias("last_seen_at"))


# -- incremental clustering -------------------------------------------------------------------
def key_facts(links: DataFrame) -> DataFrame:
    """Per key and event whether it has incident and activity articles."""
    kind = source_kind(F.col("signal_kind"))
    keyed = links.withColumn("cluster_key", cluster_key(F.col("victim_org_name"), F.col("victim_org_normalized")))
    return keyed.filter("cluster_key is not null").groupBy("cluster_key", "event_id").agg(
        F.bool_or(kind == "incident").alias("inc"), F.bool_or(kind == "activity").alias("act"))


def joined_facts(facts: DataFrame) -> DataFrame:
    """Facts of several runs, one row per key and event."""
    return facts.groupBy("cluster_key", "event_id").agg(F.bool_or("inc").alias("inc"), F.bool_or("act").alias("act"))


def open_events(links: DataFrame) -> DataFrame:
    """Events that further articles can join, built from links; see open_by_key."""
    return open_by_key(key_facts(links))


def open_by_key(facts: DataFrame) -> DataFrame:
    """Events that further articles can join: those with a key that are not activity.

    One row per key; an event of unregistered sources only is open as kind none.
    """
    usable = facts.filter("inc or not act").withColumn("kind", F.when(F.col("inc"), F.lit("incident")).otherwise(F.lit("none")))
    return usable.groupBy("cluster_key").agg(F.min(F.struct("event_id", "kind")).alias("e")).select(
        "cluster_key", "e.event_id", "e.kind")


def attach_batch(extracted: DataFrame, links: DataFrame | None) -> DataFrame:
    """New links of a batch, joined to open events of earlier links."""
    if links is None:
        return link_articles(extracted, assign_clusters(with_keys(extracted)))
    fresh = extracted.join(links.select("article_id"), "article_id", "left_anti")
    return link_articles(fresh, assign_clusters(with_keys(fresh), open_events(links)))


def refresh_touched(events: DataFrame, links: DataFrame, new_links: DataFrame) -> DataFrame:
    """Snapshot with only the events re-merged that got new links."""
    touched = new_links.select("event_id").distinct()
    remerged = merge_events(links.join(touched, "event_id", "left_semi"), events)
    return events.join(touched, "event_id", "left_anti").select(*remerged.columns).unionByName(remerged)


def upsert_articles(articles: DataFrame, links: DataFrame, events: DataFrame, dictionary: DataFrame
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Small batch of articles through all stages against current links and events.

    Gives the links and events afterwards and one outcome row per article:
    created, merged or irrelevant.
    """
    processed, extracted = process_and_extract(articles)
    new_links = staged(attach_batch(extracted, links), "new-links")
    columns = [c for c in new_links.columns if c in links.columns]
    # Each table is written before the next step reads it several times.
    all_links = staged(links.select(*columns).unionByName(new_links.select(*columns)), "all-links")
    merged = staged(refresh_touched(events, all_links, new_links), "refreshed")
    refreshed = staged(attribute_events(merged, all_links, dictionary).drop("considered", "changed"), "attributed")
    old = events.select("event_id", F.lit(True).alias("existed"))
    outcome = processed.select("article_id", "relevant").join(new_links.select("article_id", "event_id"), "article_id", "left").join(
        old, "event_id", "left")
    action = (F.when(~F.col("relevant"), F.lit("irrelevant"))
              .when(F.col("existed") | (F.col("event_id") != F.col("article_id")), F.lit("merged")).otherwise(F.lit("created")))
    return all_links, refreshed, outcome.select("article_id", "event_id", action.alias("event_action"))


KEY_FACTS = "cluster_key string, event_id bigint, inc boolean, act boolean"
SEEN = "article_id bigint"
# Neighbouring article ids share a bucket, so what has arrived lately is looked up in few of them.
SEEN_RANGE = 100_000


def cluster_sink(state_path: str, dictionary: DataFrame | None = None, buckets: int = 64):
    """foreachBatch function: links, events and their actors as keyed state below one folder.

    The tables are links and events by event, open_keys by cluster key and seen by article.
    An epoch reads the keys and events that its articles fall on, joins the articles to open
    events, merges and attributes the touched events anew and rewrites their buckets.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        c, spark = F.col, batch.sparkSession
        state = BucketState(spark, state_path, epoch, buckets)
        actors = dictionary if dictionary is not None else actor_dictionary(spark)
        _, extracted = process_and_extract(batch)
        group = F.floor(c("article_id") / SEEN_RANGE)
        near = state.touched(extracted, group)
        seen = state.read("seen", SEEN, near)
        fresh = staged(extracted.join(seen, "article_id", "left_anti"), "fresh")
        keys = with_keys(fresh)
        at_keys = state.touched(keys.filter("cluster_key is not null"), c("cluster_key"))
        facts = state.read("open_keys", KEY_FACTS, at_keys)
        new_links = staged(link_articles(fresh, assign_clusters(keys, open_by_key(facts))), "new-links")
        at_events = state.touched(new_links, c("event_id"))
        links = staged(state.read("links", new_links.schema, at_events).unionByName(new_links), "links")
        touched = new_links.select("event_id").distinct()
        own = links.join(touched, "event_id", "left_semi")
        empty = merge_events(links.limit(0)).schema
        before = state.read("events", empty, at_events)
        merged = staged(merge_events(own, before.join(touched, "event_id", "left_semi")), "merged")
        attributed = attribute_events(merged, own, actors).select(*before.columns)
        events = before.join(touched, "event_id", "left_anti").unionByName(attributed)
        state.write("links", links, c("event_id"), at_events)
        state.write("events", events, c("event_id"), at_events)
        state.write("open_keys", joined_facts(facts.unionByName(key_facts(new_links))), c("cluster_key"), at_keys)
        state.write("seen", seen.unionByName(fresh.select("article_id")), group, near)
        state.commit()
    return write


def start(stream: DataFrame, checkpoint: str, sink=None, path: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run everything that is there, then stop: to a parquet path or a batch function."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if sink is not None:
        return writer.foreachBatch(sink).start()
    return writer.format("parquet").option("path", path).start()
