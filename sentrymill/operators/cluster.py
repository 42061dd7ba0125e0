"""Clustering of articles into events.

Sequential creation of events has a closed form.  Per key, in article order:

* from the first incident article on, everything belongs to one event;
* before it, an event stays open only while all its articles come from
  unregistered sources; an activity article joins such an event and closes it,
  or stands alone;
* the first incident article joins an event that is still open.

Articles without a key stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import org_acronym
from ..functions.text import combined_text, primary_evidence
from .spread import HOT_ROWS, join_unique, run_starts

CVE_NAME = r"(?i)^CVE-\d{4}-\d+$"


def cluster_key(name: Column, normalized: Column) -> Column:
    """Key under which articles meet: normalised name, else exact name; never a CVE id."""
    return F.when(~F.coalesce(F.rlike(name, F.lit(CVE_NAME)), F.lit(False)), F.coalesce(
        F.concat(F.lit("n:"), normalized), F.concat(F.lit("x:"), name)))


def source_kind(signal_kind: Column) -> Column:
    return F.when(signal_kind.isin("incident", "activity"), signal_kind).otherwise(F.lit("none"))


def assign_clusters(keyed: DataFrame, open_events: DataFrame | None = None,
                    parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """article_id, event_id for rows of (article_id, cluster_key, kind).

    `open_events` (cluster_key, event_id, kind) are events of earlier runs that
    can still be joined; they come before every new article of their key.
    """
    rows = keyed.select("article_id", "cluster_key", "kind", F.col("article_id").alias("seed"),
                        F.col("article_id").alias("at"), F.lit(True).alias("fresh"))
    alone = rows.filter(F.col("cluster_key").isNull()).select("article_id", F.col("seed").alias("event_id"))
    rows = rows.filter(F.col("cluster_key").isNotNull())
    if open_events is not None:
        rows = rows.unionByName(open_events.select(
            F.col("event_id").alias("article_id"), "cluster_key", "kind", F.col("event_id").alias("seed"),
            F.lit(-1).cast("bigint").alias("at"), F.lit(False).alias("fresh")))

    firsts = rows.groupBy("cluster_key").agg(
        F.min(F.when(F.col("kind") == "incident", F.col("at"))).alias("first_at"),
        F.min_by("seed", F.when(F.col("kind") == "incident", F.col("at"))).alias("first_seed"),
        F.count("*").alias("n_rows"))
    known = join_unique(rows, firsts, "cluster_key", "n_rows", "article_id", hot_rows)

    # Before the first incident article: runs of unregistered sources.
    early = known.filter(F.col("first_at").isNull() | (F.col("at") < F.col("first_at")))
    early = run_starts(early, "cluster_key", "at", "kind", "seed", "activity", "event_id", parts)
    still_open = (
        early.groupBy("cluster_key")
        .agg(F.max_by(F.struct("kind", "event_id"), "at").alias("tail"))
        .filter(F.col("tail.kind") == "none")
        .select("cluster_key", F.col("tail.event_id").alias("joined_event"))
    )
    # One row per key: which event the incident run of the key belongs to.
    run_event = (
        firsts.filter(F.col("first_at").isNotNull()).join(still_open, "cluster_key", "left")
        .select("cluster_key", "n_rows", F.coalesce("joined_event", "first_seed").alias("event_id"))
    )
    late = known.filter(F.col("at") >= F.col("first_at")).drop("n_rows")
    late = join_unique(late, run_event, "cluster_key", "n_rows", "article_id", hot_rows)
    assigned = early.select("article_id", "event_id", "fresh").unionByName(
        late.select("article_id", "event_id", "fresh"))
    return assigned.filter("fresh").select("article_id", "event_id").unionByName(alone)


def with_keys(extracted: DataFrame) -> DataFrame:
    return extracted.select(
        "article_id",
        cluster_key(F.col("victim_org_name"), F.col("victim_org_normalized")).alias("cluster_key"),
        source_kind(F.col("signal_kind")).alias("kind"))


def link_articles(extracted: DataFrame, assigned: DataFrame) -> DataFrame:
    """Extraction rows with their event, match score and evidence flag."""
    evidence = primary_evidence(combined_text(F.col("title"), F.col("summary"), F.col("content")))
    return extracted.join(assigned, "article_id").withColumns({
        "match_score": F.lit(1.0), "is_primary_source": evidence})


# -- matching as a query of its own ------------------------------------------------------
def candidate_events(extracted: DataFrame, events: DataFrame) -> DataFrame:
    """The least event sharing the normalised or the exact name with each article.

    Events of one name are reduced first, so an article meets one row and the result
    does not grow with the square of a name.  An exact name implies the normalised
    one, so exact names only matter where the normal form is empty.
    """
    def matched(column: str, only: Column, score: float) -> DataFrame:
        left = extracted.filter(F.col(column).isNotNull() & only).select("article_id", column)
        sizes = left.groupBy(column).agg(F.count("*").alias("n_articles"))
        least = events.filter(F.col(column).isNotNull() & only).groupBy(column).agg(F.min("event_id").alias("event_id"))
        joined = join_unique(left, least.join(sizes, column), column, "n_articles", "article_id")
        return joined.filter("event_id is not null").select("article_id", "event_id", F.lit(score).alias("match_score"))
    no_key = F.col("victim_org_normalized").isNull()
    return matched("victim_org_normalized", F.lit(True), 1.0).unionByName(matched("victim_org_name", no_key, 0.95))


MATCH_THRESHOLD = 0.8


def best_matches(candidates: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best event per article: highest score, then least event id."""
    best = F.max(F.struct(F.col("match_score"), (-F.col("event_id")).alias("neg")))
    return (candidates.filter(F.col("match_score") >= threshold)
            .groupBy("article_id").agg(best.alias("b"))
            .select("article_id", (-F.col("b.neg")).alias("event_id"), F.col("b.match_score").alias("match_score")))


def alias_groups(events: DataFrame) -> DataFrame:
    """Events that share acronym, country and attack type, each with its group's least event.

    Sharing all three is an equivalence, so a group needs no pair list and no
    iteration: every event points at the least id of its group.
    """
    named = events.select("event_id", "country", "attack_type", org_acronym(F.col("victim_org_name")).alias("acronym"))
    named = named.filter(F.col("acronym").isNotNull() & (F.col("country") != "") & (F.col("attack_type") != ""))
    keyed = named.withColumn("alias_key", F.concat_ws("\u0001", "acronym", "country", "attack_type"))
    groups = keyed.groupBy("alias_key").agg(F.min("event_id").alias("resolved_event_id"), F.count("*").alias("group_size"))
    return join_unique(keyed, groups, "alias_key", "group_size", "event_id").select(
        "event_id", "acronym", "country", "attack_type", "resolved_event_id", "group_size")


def resolve_aliases(events: DataFrame) -> DataFrame:
    """Opt-in: event_id and the event it is merged into through acronym aliases."""
    groups = alias_groups(events).select("event_id", "resolved_event_id")
    return events.select("event_id").join(groups, "event_id", "left").select(
        "event_id", F.coalesce("resolved_event_id", "event_id").alias("resolved_event_id"))


def reconcile(links: DataFrame, events: DataFrame) -> DataFrame:
    """Move links of events with one key to the least event of that key.

    Links of events without a key stay where they are.
    """
    keyed = events.select("event_id", cluster_key(F.col("victim_org_name"), F.col("victim_org_normalized")).alias("key"))
    keyed = keyed.filter(F.col("key").isNotNull())
    least = keyed.groupBy("key").agg(F.min("event_id").alias("target"), F.count("*").alias("n_events"))
    moves = join_unique(keyed, least, "key", "n_events", "event_id").filter("target <> event_id").select("event_id", "target")
    sizes = links.groupBy("event_id").agg(F.count("*").alias("n_links"))
    moves = moves.join(sizes, "event_id")
    moved = join_unique(links, moves, "event_id", "n_links", "article_id")
    return moved.withColumn("event_id", F.coalesce("target", "event_id")).select(*links.columns)


def drop_articles(links: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that survive the removal of articles, and ids of events left without any."""
    kept = links.join(removed.select("article_id"), "article_id", "left_anti").select(*links.columns)
    touched = links.join(removed.select("article_id"), "article_id", "left_semi").select("event_id").distinct()
    orphaned = touched.join(kept.select("event_id").distinct(), "event_id", "left_anti")
    return kept, orphaned
