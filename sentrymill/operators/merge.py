"""Merge of linked articles into events: golden record, trust and impact.

One shuffle on the event; every field is a mergeable aggregate, so a large event
is pre-aggregated before the shuffle and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import any_substring, blank_to_null
from ..functions.text import country_region
from ..rules import registry as G
from ..rules import sectors as S
from .cluster import CVE_NAME

OFFICIAL = ("official_alert", "exploited_vulnerability")
COMPLETENESS_FIELDS = ("victim_org_name", "attack_type", "actor_name", "short_event_summary", "country", "industry")


def source_weight(source_class: Column, trusted_alone: Column) -> Column:
    # Authority of a source when fields are merged.
    return (F.when(source_class == "primary_disclosure", 100).when(source_class.isin(*OFFICIAL), 80)
            .when(trusted_alone, 80).when(source_class == "incident_news", 50).otherwise(30))


def class_score(source_class: Column, trusted_alone: Column) -> Column:
    # Least trust score an event gets from one such source.
    return (F.when(source_class == "primary_disclosure", 90).when(source_class.isin(*OFFICIAL), 85)
            .when(trusted_alone, 80).otherwise(0))


def trusted_alone_source(source_class: Column, trusted_alone: Column) -> Column:
    return F.coalesce(source_class.isin("primary_disclosure", *OFFICIAL), F.lit(False)) | F.coalesce(trusted_alone, F.lit(False))


def completeness(fields: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name in COMPLETENESS_FIELDS:
        if name in fields:
            total = total + blank_to_null(fields[name]).isNotNull().cast("int")
    return total


def trust_score(n_links: Column, best_class: Column, has_evidence: Column, attributed: Column) -> Column:
    """0 to 100 from corroboration, source class, evidence and attribution."""
    by_links = F.when(n_links == 1, 25).when(n_links >= 2, 75 + F.least(n_links - 2, F.lit(3)) * 3).otherwise(0)
    base = F.greatest(by_links, F.coalesce(best_class, F.lit(0)), F.when(has_evidence, 75).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), base + F.when(attributed, 5).otherwise(0))).cast("double")


def event_status(n_links: Column, trusted: Column, has_evidence: Column) -> Column:
    return F.when((n_links >= 2) | ((n_links == 1) & (trusted | has_evidence)), F.lit("confirmed")).otherwise(F.lit("emerging"))


def confidence_level(n_links: Column, trusted: Column, has_evidence: Column) -> Column:
    return (F.when((n_links >= 2) | ((n_links == 1) & trusted), F.lit("high"))
            .when((n_links == 1) & has_evidence, F.lit("medium")).when(n_links == 1, F.lit("low")))


def impact_text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def high_impact(kind: Column, actor: Column, filing: Column, catalogue: Column, text: Column) -> Column:
    return (F.when(kind == "activity", catalogue | any_substring(text, S.ACTIVITY_HIGH_IMPACT))
            .when(kind == "intelligence", F.lit(False))
            .otherwise((actor != "") & actor.isNotNull() | filing | any_substring(text, S.HIGH_IMPACT)))


def _rank_columns(linked: DataFrame) -> DataFrame:
    c = F.col
    seen = [c(n) for n in ("published_at", "created_at") if n in linked.columns]
    weight = source_weight(c("source_class"), c("tier_trusted_alone"))
    active = ~c("irrelevant") if "irrelevant" in linked.columns else F.lit(True)
    seen_at = F.coalesce(*seen)
    return linked.withColumns({
        "_active": active, "_weight": weight, "_seen": seen_at,
        "_complete": completeness({n: c(n) for n in linked.columns}),
    }).withColumns({
        "_rank": F.struct(c("_weight"), c("_seen").alias("t"), (-c("article_id")).alias("i")),
        "_content_rank": F.struct(c("_weight"), c("_complete"), c("_seen").alias("t"), (-c("article_id")).alias("i")),
    })


def best_field(name: str, rank: str = "_rank") -> Column:
    value = blank_to_null(F.col(name))
    return F.max_by(value, F.when(F.col("_active") & value.isNotNull(), F.col(rank)))


def best_fields(linked: DataFrame, names: list[str]) -> DataFrame:
    """Per event and field, the value of the most authoritative article that has one."""
    return _rank_columns(linked).groupBy("event_id").agg(*[best_field(n).alias(n) for n in names])


def source_ranks(linked: DataFrame) -> DataFrame:
    """Leading article of each event by weight and time, and by weight, completeness and time."""
    ranked = _rank_columns(linked)
    return ranked.groupBy("event_id").agg(
        F.max_by("article_id", F.when(F.col("_active"), F.col("_rank"))).alias("lead_article_id"),
        F.max_by("article_id", F.when(F.col("_active"), F.col("_content_rank"))).alias("content_article_id"),
        F.max_by("article_id", F.struct(F.col("_seen").alias("t"), F.col("article_id").alias("i"))).alias("latest_article_id"),
        F.max(F.when(F.col("_active"), F.col("_weight"))).alias("best_weight"),
        F.max(F.when(F.col("_active"), F.col("_complete"))).alias("best_completeness"))


KEPT_FIELDS = ("attack_type", "victim_entity_type", "summary_short", "canonical_title")
EVENT_COLUMNS = (
    "event_id", "slug", "canonical_title", "event_status", "confidence_level", "confidence_score",
    "first_seen_at", "last_seen_at", "victim_org_name", "victim_org_normalized", "victim_display_label",
    "victim_entity_type", "industry", "attack_type", "event_signal_type", "actor_name", "actor_type",
    "attribution_status", "region", "country", "source_count", "is_high_impact", "summary_short",
    "has_filing", "has_primary_evidence", "trusted_alone", "best_class_score",
)


def merge_events(linked: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row per event from its linked articles.

    Victim, industry and place always follow the articles.  Attack type, entity
    type, summary and title keep their earlier value where the articles give
    none: that of `previous` if given, else that of the creating article.
    Articles flagged irrelevant count as links but give no fields; an event with
    only such articles disappears.
    """
    c = F.col
    merged = _rank_columns(linked).groupBy("event_id").agg(
        F.count("*").alias("source_count"),
        F.count_if("_active").alias("n_active"),
        *[best_field(n).alias(n) for n in (
            "victim_org_name", "victim_org_normalized", "victim_display_label", "industry", "country", "region")],
        best_field("attack_type").alias("new_attack_type"),
        best_field("victim_entity_type").alias("new_victim_entity_type"),
        best_field("short_event_summary", "_content_rank").alias("new_summary_short"),
        F.max_by("title", F.when(c("_active"), c("_content_rank"))).alias("new_canonical_title"),
        F.min_by("attack_type", "article_id").alias("old_attack_type"),
        F.min_by("victim_entity_type", "article_id").alias("old_victim_entity_type"),
        F.min_by("short_event_summary", "article_id").alias("old_summary_short"),
        F.min_by("title", "article_id").alias("old_canonical_title"),
        F.bool_or(c("signal_kind") == "incident").alias("any_incident"),
        F.bool_or(c("signal_kind") == "activity").alias("any_activity"),
        F.min_by("_seen", F.when(c("_seen").isNotNull(), c("article_id"))).alias("first_seen_at"),
        F.max("_seen").alias("last_seen_at"),
        F.bool_or(trusted_alone_source(c("source_class"), c("tier_trusted_alone"))).alias("trusted_alone"),
        F.bool_or("is_primary_source").alias("has_primary_evidence"),
        F.max(class_score(c("source_class"), c("tier_trusted_alone"))).alias("best_class_score"),
        F.max_by("source_name", F.struct(c("_seen").alias("t"), c("article_id").alias("i"))).alias("latest_source"),
        F.bool_or(c("source_name") == G.FILING_SOURCE).alias("has_filing"),
    ).filter("n_active > 0")
    earlier_actor = {n: F.lit(None).cast("string") for n in ("actor_name", "actor_type", "attribution_status")}
    if previous is not None:
        kept = previous.select(
            "event_id", *[c(n).alias("kept_" + n) for n in KEPT_FIELDS],
            *[c(n).alias("kept_" + n) for n in earlier_actor],
            c("first_seen_at").alias("kept_first"), c("last_seen_at").alias("kept_last"))
        merged = merged.join(kept, "event_id", "left").withColumns({
            **{"old_" + n: F.coalesce("kept_" + n, "old_" + n) for n in KEPT_FIELDS},
            "first_seen_at": F.coalesce("kept_first", "first_seen_at"),
            "last_seen_at": F.greatest("kept_last", "last_seen_at"),
        })
        earlier_actor = {n: c("kept_" + n) for n in earlier_actor}
    return _event_fields(merged, earlier_actor)


def _event_fields(merged: DataFrame, earlier_actor: dict[str, Column]) -> DataFrame:
    c = F.col
    is_cve = F.coalesce(F.rlike(c("victim_org_name"), F.lit(CVE_NAME)), F.lit(False))
    kind0 = F.when(c("any_incident"), F.lit("incident")).when(c("any_activity"), F.lit("activity")).otherwise(F.lit("incident"))
    events = merged.withColumns({
        **{n: F.coalesce("new_" + n, "old_" + n) for n in ("attack_type", "victim_entity_type", "summary_short")},
        "canonical_title": F.coalesce(F.nullif(c("new_canonical_title"), F.lit("")),
                                      F.nullif(c("old_canonical_title"), F.lit("")), F.lit("Untitled Event")),
        "industry": F.coalesce("industry", F.lit("Unknown")),
        "region": F.coalesce(F.when(c("country").isNotNull(), country_region(c("country"))), c("region")),
        "kind0": kind0,
        "drop_victim": is_cve | (kind0 == "activity"),
        "victim_display_label": F.when(
            ~F.coalesce(F.rlike(c("victim_display_label"), F.lit(CVE_NAME)), F.lit(False)), c("victim_display_label")),
    }).withColumns({
        "victim_org_name": F.when(~c("drop_victim"), c("victim_org_name")),
        "victim_org_normalized": F.when(~c("drop_victim"), c("victim_org_normalized")),
    })
    # An actor of an earlier run stays only on an incident that still has a victim.
    keeps_actor = c("victim_org_name").isNotNull() & (c("kind0") == "incident")
    events = events.withColumns({n: F.when(keeps_actor, v) for n, v in earlier_actor.items()})
    trusted, evidence = c("trusted_alone"), c("has_primary_evidence")
    events = events.withColumns({
        "event_status": event_status(c("source_count"), trusted, evidence),
        "confidence_level": confidence_level(c("source_count"), trusted, evidence),
        "confidence_score": trust_score(c("source_count"), c("best_class_score"), evidence,
                                        c("actor_name").isNotNull() & (c("kind0") == "incident")),
    }).withColumn("event_signal_type", F.when(
        (c("kind0") == "incident") & c("victim_org_name").isNull() & c("actor_name").isNull()
        & (c("confidence_score") < 50), F.lit("intelligence")).otherwise(c("kind0")))
    return events.withColumns({
        "slug": F.concat(F.lit("event-"), c("event_id").cast("string")),
        "is_high_impact": high_impact(
            c("event_signal_type"), c("actor_name"), c("latest_source") == G.FILING_SOURCE,
            c("latest_source") == G.CATALOGUE_SOURCE, impact_text(c("canonical_title"), c("summary_short"))),
    }).select(*EVENT_COLUMNS)


def final_high_impact(events: DataFrame) -> DataFrame:
    """Second pass after attribution: an actor or any filing link counts."""
    c = F.col
    text = impact_text(c("canonical_title"), c("summary_short"))
    return events.withColumn("is_high_impact", F.when(
        c("event_signal_type").isin("incident", "intelligence"),
        high_impact(c("event_signal_type"), c("actor_name"), c("has_filing"), F.lit(False), text),
    ).otherwise(c("is_high_impact")))


def final_trust(events: DataFrame) -> DataFrame:
    """Trust score including the attribution of this run."""
    c = F.col
    attributed = c("actor_name").isNotNull() & (c("event_signal_type") == "incident")
    return events.withColumn("confidence_score", trust_score(
        c("source_count"), c("best_class_score"), c("has_primary_evidence"), attributed))
