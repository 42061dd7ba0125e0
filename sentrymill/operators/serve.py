"""Query surface: feed, payload, facets, summary and trends over events.

All functions take events as merged, links as staged by the pipeline and as_of,
the moment that counts as now.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import strip
from ..functions.text import relative_time
from .merge import source_weight

TIME_RANGES = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}
PAGE_SIZE = 25
HIGH_TRUST = 75


def at(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of: datetime | Column, days: int) -> Column:
    return at(as_of) - F.expr(f"INTERVAL {days} DAYS")


def since(events: DataFrame, as_of: datetime | Column, days: int) -> Column:
    """Within so many days before as_of, which itself is the last moment that counts."""
    moment = reference_time(events)
    return (moment >= days_before(as_of, days)) & (moment <= at(as_of))


def reference_time(events: DataFrame) -> Column:
    """Last seen, else first seen, updated or created."""
    return F.coalesce(*[F.col(n) for n in ("last_seen_at", "first_seen_at", "updated_at", "created_at")
                        if n in events.columns])


def filtered_events(events: DataFrame, as_of: datetime | Column | None = None, industry: str | None = None,
                    region: str | None = None, attack_type: str | None = None, time_range: str | None = None,
                    signal_type: str | None = None, high_impact: bool = False, high_trust: bool = False) -> DataFrame:
    """Structured filters; text filters are case-insensitive patterns with % and _."""
    out = events
    for name, pattern in (("industry", industry), ("region", region), ("attack_type", attack_type)):
        if pattern:
            out = out.filter(F.col(name).ilike(pattern))
    if signal_type:
        out = out.filter(F.col("event_signal_type") == signal_type)
    if signal_type == "incident":
        out = out.filter(F.col("victim_org_name").isNotNull())
    if high_impact:
        out = out.filter(F.col("is_high_impact"))
    if high_trust:
        out = out.filter(F.col("confidence_score") >= HIGH_TRUST)
    if time_range in TIME_RANGES:
        out = out.filter(since(out, as_of, TIME_RANGES[time_range]))
    return out


def feed_order(events: DataFrame) -> list[Column]:
    return [
        F.when(F.coalesce("event_signal_type", F.lit("incident")) == "incident", 0).otherwise(1).asc(),
        F.coalesce("confidence_score", F.lit(0.0)).desc(),
        F.when(F.col("is_high_impact"), 0).otherwise(1).asc(),
        F.coalesce("source_count", F.lit(0)).desc(),
        reference_time(events).desc_nulls_last(),
        F.col("event_id").asc(),
    ]


def feed(events: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events by priority: incidents, trust, impact, corroboration, recency."""
    out = events.orderBy(*feed_order(events))
    if offset and offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None and limit >= 0 else out


def page(events: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, counted from 0; has_more as a client shows it: the page is full."""
    rows = feed(events, size, number * size)
    return rows.withColumn("has_more", F.count("*").over(Window.partitionBy()) == size)


def source_label(with_publisher: bool = True) -> Column:
    names = ["display_label", "publisher", "source_name"] if with_publisher else ["display_label", "source_name"]
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def link_facts(links: DataFrame) -> DataFrame:
    """Per event: distinct sources, primary links and names.

    The name sets hold distinct sources, of which there are few, not articles.
    """
    publisher = F.coalesce(F.nullif(F.col("publisher"), F.lit("")), F.col("source_name")) if "publisher" in links.columns else F.col("source_name")
    return links.groupBy("event_id").agg(
        F.count_distinct("source_name").alias("distinct_sources"),
        F.count_if("is_primary_source").alias("primary_source_count"),
        F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("source_names"),
        F.array_join(F.array_sort(F.collect_set(publisher)), ",").alias("publishers"))


def feed_payload(events: DataFrame, links: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Events as shown, with display fields and source facts."""
    c = F.col
    facts = link_facts(links)
    shown = events.withColumn("reference_time", reference_time(events)).join(facts, "event_id", "left")
    return shown.select(
        "event_id", c("canonical_title").alias("title"), c("summary_short").alias("summary"),
        c("victim_org_name").alias("victim_name"),
        F.coalesce("victim_display_label", "victim_org_name").alias("display_entity"),
        F.coalesce("victim_entity_type", F.lit("unknown")).alias("entity_type"),
        F.when(c("industry") != "Unknown", c("industry")).alias("display_context"),
        F.coalesce("country", "region").alias("display_location"), c("actor_name").alias("display_attribution"),
        "industry", "country", "region", "attack_type", "actor_name", "actor_type",
        F.when(c("attribution_status") != "unknown", c("attribution_status")).alias("attribution_status"),
        F.coalesce("event_signal_type", F.lit("incident")).alias("event_signal_type"),
        c("event_status").alias("status"), c("is_high_impact").alias("high_impact"),
        c("confidence_level").alias("confidence"), c("confidence_score").cast("int").alias("confidence_score"),
        relative_time(c("reference_time"), at(as_of)).alias("time_label"), "reference_time",
        F.coalesce("distinct_sources", F.lit(0)).alias("source_count"),
        F.coalesce("primary_source_count", F.lit(0)).alias("primary_source_count"), "source_names", "publishers")


def event_sources(links: DataFrame) -> DataFrame:
    """Linked articles of each event, most authoritative and most recent first.

    Rows, not one list per event, so that the sort splits a large event.
    """
    return links.select(
        "event_id", "article_id", "source_name", source_label("publisher" in links.columns).alias("publisher"), "title",
        F.col("article_url").alias("url"), "published_at", F.coalesce("is_primary_source", F.lit(False)).alias("is_primary_source"),
        source_weight(F.col("source_class"), F.col("tier_trusted_alone")).alias("weight"),
    ).orderBy("event_id", F.desc("weight"), F.desc_nulls_last("published_at"), "article_id")


# Reasons shown for a source class.
CLASS_REASONS = {
    "primary_disclosure": "primary-source disclosure",
    "official_alert": "official alert",
    "exploited_vulnerability": "known exploited vuln",
}


def score_factors(events: DataFrame, links: DataFrame) -> DataFrame:
    """Readable reasons behind the trust score, joined in a fixed order.

    Class reasons appear in the order in which the event's links first show them.
    """
    c = F.col
    firsts = {k: F.min(F.when(c("source_class") == k, c("article_id"))).alias("first_" + k) for k in CLASS_REASONS}
    facts = links.groupBy("event_id").agg(
        F.count_distinct("source_name").alias("n"), *firsts.values(),
        F.bool_or("tier_trusted_alone").alias("trusted"), F.bool_or("is_primary_source").alias("statement"))
    classes = F.array_compact(F.array(*[
        F.when(c("first_" + k).isNotNull(), F.struct(c("first_" + k).alias("at"), F.lit(label).alias("label")))
        for k, label in CLASS_REASONS.items()]))
    labels = F.transform(F.array_sort(classes), lambda x: x["label"])
    joined = facts.withColumn("labels", labels).join(
        events.select("event_id", "actor_name", "event_signal_type"), "event_id")
    reasons = F.array_compact(F.concat(
        F.array(F.when(c("n") >= 2, F.concat(c("n").cast("string"), F.lit(" sources"))).when(c("n") == 1, F.lit("1 source"))),
        c("labels"),
        F.array(
            F.when(F.coalesce(c("trusted"), F.lit(False)) & (F.size("labels") == 0), F.lit("tier-1 trusted source")),
            F.when(c("statement") & ~F.array_contains("labels", CLASS_REASONS["primary_disclosure"]), F.lit("primary statement")),
            F.when(c("actor_name").isNotNull() & (c("event_signal_type") == "incident"), F.lit("attributed actor")),
        )))
    return joined.select("event_id", F.array_join(reasons, "; ").alias("score_factors"))


# -- counts ------------------------------------------------------------------------------
def is_unknown(label: Column) -> Column:
    return F.lower(strip(label)).isin("unknown", "other")


def label_counts(frame: DataFrame, column: str) -> DataFrame:
    """label, n of non-empty values."""
    return (frame.select(strip(F.col(column)).alias("label")).filter("label <> ''")
            .groupBy("label").agg(F.count("*").alias("n")))


def _label_order() -> list[Column]:
    return [is_unknown(F.col("label")).asc(), F.desc("n"), F.lower("label").asc(), F.col("label").asc()]


def top_counts(frame: DataFrame, column: str, limit: int | None = 5) -> DataFrame:
    """Most frequent labels, unknown and other last."""
    out = label_counts(frame, column).orderBy(*_label_order())
    return out if limit is None else out.limit(limit)


def most_common_label(frame: DataFrame, column: str, name: str = "label") -> DataFrame:
    """One row: the most frequent known label, Unknown if there is no known one, else null."""
    counts = label_counts(frame, column)
    known = ~is_unknown(F.col("label"))
    best = F.min_by("label", F.when(known, F.struct((-F.col("n")).alias("n"), F.lower("label").alias("l"), F.col("label").alias("x"))))
    return counts.agg(F.coalesce(best, F.when(F.count("*") > 0, F.lit("Unknown"))).alias(name))


def summary_cards(events: DataFrame, as_of: datetime | Column) -> DataFrame:
    """One row of totals with the leading attack type and industry."""
    c = F.col
    totals = events.agg(
        F.count("*").alias("total_events"),
        F.count_if(c("confidence_score") >= HIGH_TRUST).alias("high_trust_events"),
        F.count_if("is_high_impact").alias("high_impact_events"),
        F.count_if(since(events, as_of, 1)).alias("new_today_events"),
        F.count_if(c("event_status") == "confirmed").alias("confirmed_events"),
        F.count_if(c("event_status") == "emerging").alias("emerging_events"))
    # Three results of one row each.
    return (totals.join(F.broadcast(most_common_label(events, "attack_type", "top_attack_type")))
            .join(F.broadcast(most_common_label(events.filter("industry <> 'Unknown'"), "industry", "top_targeted_industry"))))


def rising_attack_types(events: DataFrame, as_of: datetime | Column, limit: int = 5) -> DataFrame:
    """Attack types of the last week against the week before, largest increase first."""
    week = reference_time(events) >= days_before(as_of, 7)
    counted = (
        events.filter(since(events, as_of, 14) & (F.col("attack_type") != "") & ~is_unknown(F.col("attack_type")))
        .groupBy(F.col("attack_type").alias("label"))
        .agg(F.count_if(week).alias("current"), F.count_if(~week).alias("previous"))
        .filter("current > 0"))
    return (counted.withColumns({"delta": F.col("current") - F.col("previous"), "is_new": F.col("previous") == 0})
            .orderBy(F.desc("delta"), F.desc("current"), F.lower("label"), "label").limit(limit))


def active_actors(events: DataFrame, as_of: datetime | Column, limit: int = 5) -> DataFrame:
    """Actors of the last week by number of events; ties by name."""
    recent = events.filter(since(events, as_of, 7) & (F.col("actor_name") != "")
                           & ~is_unknown(F.col("actor_name")))
    return (recent.groupBy(F.col("actor_name").alias("label")).agg(F.count("*").alias("n_events"))
            .orderBy(F.desc("n_events"), "label").limit(limit))


def source_coverage(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events per source label with their share of all given events."""
    pairs = links.select("event_id", source_label("publisher" in links.columns).alias("label")).filter("label is not null").distinct()
    counts = pairs.join(events.select("event_id"), "event_id", "left_semi").groupBy("label").agg(F.count("*").alias("n_events"))
    total = events.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    # One row.
    return counts.join(F.broadcast(total)).select(
        "label", "n_events", F.bround(F.col("n_events") / F.col("total") * 100).cast("int").alias("pct")
    ).orderBy(F.desc("n_events"), "label")


FACETS = ("industry", "attack_type")


def facet_counts(events: DataFrame, selected: dict[str, str] | None = None, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """Per facet and value, events that meet the selection of all other facets."""
    selected = selected or {}

    def others(facet: str) -> Column:
        test = F.lit(True)
        for other in facets:
            if other != facet and selected.get(other):
                test = test & (F.col(other) == selected[other])
        return F.coalesce(test, F.lit(False))

    entries = F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), others(f).alias("counts")) for f in facets])
    return (events.select(F.inline(entries)).filter("counts and value <> ''")
            .groupBy("facet", "value").agg(F.count("*").alias("n_events")))


def event_context(events: DataFrame) -> DataFrame:
    c = F.col
    label = (F.when(c("victim_entity_type") == "vulnerability", F.lit("Vulnerability"))
             .when(c("victim_entity_type") == "product_or_platform", F.lit("Product / Platform"))
             .when(c("event_signal_type") == "activity", F.lit("Security Activity"))
             .when((c("industry") != "Unknown") & (c("industry") != ""), c("industry")).otherwise(F.lit("Other")))
    return events.select("event_id", label.alias("context"))


def latest_extractions(extracted: DataFrame, limit: int = 25, time_col: str = "created_at") -> DataFrame:
    return extracted.orderBy(F.desc_nulls_last(time_col), F.desc("article_id")).limit(limit)
