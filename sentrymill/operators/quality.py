"""Data quality: flags, audits, backfills and clean-ups over articles, links and events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import matches, strip
from ..functions.text import company_case, country_region, filing_accession, trust_band
from ..rules import names as N
from ..rules import places as P
from ..rules import registry as G
from .cluster import CVE_NAME, drop_articles

# Flags of the feed audit.
QUALITY_FLAGS = ("NO ACTOR", "UNKNOWN TYPE", "UNKNOWN IND", "NO GEO", "LOW SCORE")


def quality_flags(events: DataFrame) -> DataFrame:
    """Incidents with their flags; incidents without a victim are not in the feed."""
    c = F.col

    def missing(name: str) -> Column:
        return c(name).isNull() | (c(name) == "")
    tests = (missing("actor_name"), missing("attack_type") | (c("attack_type") == "Unknown"),
             missing("industry") | (c("industry") == "Unknown"), missing("country") & missing("region"),
             c("confidence_score") < 50)
    flags = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(QUALITY_FLAGS, tests)]))
    in_feed = c("victim_org_name").isNotNull()
    return events.filter("event_signal_type = 'incident'").select(
        "event_id", "victim_org_name", in_feed.alias("in_feed"),
        F.when(in_feed, F.array_join(flags, ", ")).otherwise(F.lit("")).alias("flags"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return (flagged.filter("in_feed and flags <> ''").select(F.explode(F.split("flags", ", ")).alias("flag"))
            .groupBy("flag").agg(F.count("*").alias("n_events")))


def band_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events per status and trust band in two snapshots."""
    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("event_status", F.coalesce(trust_band(F.col("confidence_score")), F.lit("none")).alias("band")).agg(
            F.count("*").alias(name))
    joined = counted(before, "n_before").join(counted(after, "n_after"), ["event_status", "band"], "full")
    return joined.select("event_status", "band", F.coalesce("n_before", F.lit(0)).alias("n_before"),
                         F.coalesce("n_after", F.lit(0)).alias("n_after"))


def rejected_by_source(decided: DataFrame) -> DataFrame:
    return (decided.filter(~F.col("relevant")).groupBy("source_name")
            .agg(F.count("*").alias("n_articles"), F.count_if("content_enriched").alias("n_enriched")))


def suspicious_events(events: DataFrame, links: DataFrame, max_score: float = 30,
                      victim_prefix: str | None = None) -> DataFrame:
    """Events likely to be noise or duplicates with their source articles, one row per link."""
    c = F.col
    incident = c("event_signal_type") == "incident"
    reasons = F.array_compact(F.array(
        F.when(incident & (c("confidence_score") <= max_score), F.lit("low_score")),
        F.when(c("victim_org_name").isNull() & c("victim_display_label").isNull(), F.lit("no_victim")),
        F.when(c("victim_org_name").isNull() & (c("attack_type") == "Ransomware"), F.lit("no_victim_ransomware")),
        F.when(F.startswith("victim_org_name", F.lit(victim_prefix)), F.lit("same_prefix")) if victim_prefix
        else F.lit(None).cast("string")))
    listed = events.select("event_id", "confidence_score", F.explode(reasons).alias("reason"))
    return listed.join(links.select("event_id", "article_id", "source_name", "title"), "event_id")


def keyword_drilldown(articles: DataFrame, patterns: Sequence[str], context: int = 40) -> DataFrame:
    """Articles whose title or summary holds a keyword, with the text around it."""
    c = F.col
    both = F.concat_ws(" ", "title", "summary")
    rows = []
    for p in patterns:
        at = F.locate(p.lower(), F.lower(both))
        start = F.greatest(at - context, F.lit(1))
        rows.append(F.when(at > 0, F.struct(F.lit(p).alias("keyword"), at.alias("found_at"),
                                            F.substr(both, start, F.lit(2 * context + len(p))).alias("context"))))
    found = articles.withColumn("hit", F.explode(F.array_compact(F.array(*rows))))
    return found.select("article_id", "source_name", c("hit.keyword").alias("keyword"),
                        c("hit.found_at").alias("found_at"), c("hit.context").alias("context"))


def rederive_regions(events: DataFrame) -> DataFrame:
    """Region from country; a region without country stays only if canonical."""
    c = F.col
    canonical = country_region(c("country"))
    has_country = c("country").isNotNull() & (c("country") != "")
    region = (F.when(has_country, F.coalesce(canonical, c("region")))
              .when(c("region").isin(P.CANONICAL_REGIONS), c("region")))
    return events.withColumn("old_region", c("region")).withColumn("region", region).withColumn(
        "region_change", F.when(c("old_region").eqNullSafe(c("region")), F.lit("kept"))
        .when(has_country, F.lit("fixed")).otherwise(F.lit("cleared")))


def recompute_evidence(links: DataFrame, evidence: Column) -> DataFrame:
    """Links with the evidence flag from current rules and whether it changed."""
    return links.withColumn("old_flag", F.col("is_primary_source")).withColumn("is_primary_source", evidence).withColumn(
        "flag_changed", ~F.col("old_flag").eqNullSafe(F.col("is_primary_source"))).drop("old_flag")


def changed_victims(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """Articles with an audience title whose victim differs under current rules."""
    audience = matches(F.col("title"), N.AUDIENCE_TITLE)
    now = extracted.filter(audience).select("article_id", F.col("victim_org_name").alias("new_victim"))
    old = stored.select("article_id", F.col("victim_org_name").alias("old_victim"))
    return old.join(now, "article_id").filter(~F.col("old_victim").eqNullSafe(F.col("new_victim")))


def rebuild_filing_text(articles: DataFrame) -> DataFrame:
    """Filing articles regenerated from their cleaned company name."""
    c = F.col
    company = company_case(F.split_part(c("title"), F.lit(" discloses"), F.lit(1)))
    filed = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("unknown"))
    title = F.concat(company, F.lit(" discloses breach in SEC 8-K filing"))
    text = F.concat(company, F.lit(" disclosed a data breach in a Form 8-K filing with the SEC on "), filed,
                    F.lit(f". {G.FILING_TEMPLATE_MARK} {G.FILING_CLOSING}"))
    filings = articles.filter((c("source_name") == G.FILING_SOURCE) & F.contains("title", F.lit(" discloses")))
    return filings.select("article_id", company.alias("victim_org_name"), title.alias("title"), text.alias("summary"),
                          text.alias("content"), F.lower(strip(title)).alias("normalized_title"))


def clear_bad_victims(events: DataFrame) -> DataFrame:
    """Null out victims that are document headings or CVE ids; headings lose their actor too."""
    c = F.col
    shown = F.lower(F.coalesce("victim_org_name", "victim_display_label"))
    heading = F.lit(False)
    for prefix in N.HEADING_PREFIXES:
        heading = heading | F.coalesce(F.startswith(shown, F.lit(prefix)), F.lit(False))

    def is_cve(name: str) -> Column:
        return F.coalesce(F.rlike(c(name), F.lit(CVE_NAME)), F.lit(False))
    marked = events.withColumns({"_heading": heading, "_cve": is_cve("victim_org_name"), "_label_cve": is_cve("victim_display_label")})
    gone = c("_heading") | c("_cve")
    return marked.withColumns({
        "victim_org_name": F.when(~gone, c("victim_org_name")),
        "victim_org_normalized": F.when(~gone, c("victim_org_normalized")),
        "victim_display_label": F.when(~c("_heading") & ~c("_label_cve"), c("victim_display_label")),
        **{n: F.when(~c("_heading"), c(n)) for n in ("actor_name", "actor_type", "attribution_status")},
        "victim_cleared": gone | c("_label_cve"),
    }).drop("_heading", "_cve", "_label_cve")


def stale_filings(articles: DataFrame, valid: DataFrame) -> DataFrame:
    """Filing articles whose accession is not in the valid set (or cannot be read)."""
    filings = articles.filter(F.col("source_name") == G.FILING_SOURCE).withColumn(
        "accession", filing_accession(F.col("article_url")))
    return filings.join(valid.select("accession").distinct(), "accession", "left_anti").select("article_id", "accession")


def remove_with_cascade(articles: DataFrame, links: DataFrame, events: DataFrame,
                        removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, links and events after removing articles; events without links go."""
    kept_links, orphaned = drop_articles(links, removed)
    return (articles.join(removed.select("article_id"), "article_id", "left_anti"), kept_links,
            events.join(orphaned, "event_id", "left_anti"))


def reset_status(articles: DataFrame, source: str = G.CATALOGUE_SOURCE) -> DataFrame:
    """Rejected articles of a source go back to pending."""
    c = F.col
    reset = (c("source_name") == source) & (c("processing_status") == "irrelevant")
    return articles.withColumn("processing_status", F.when(reset, F.lit("pending")).otherwise(c("processing_status")))


def keep_actors(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rebuilt events with the actors of an earlier snapshot where they have none."""
    actor = ("actor_name", "actor_type", "attribution_status")
    old = snapshot.filter("actor_name is not null").select("event_id", *[F.col(n).alias("old_" + n) for n in actor])
    eligible = F.col("actor_name").isNull() & F.col("victim_org_name").isNotNull() & (F.col("event_signal_type") == "incident")
    joined = events.join(old, "event_id", "left").withColumn("_take", eligible & F.col("old_actor_name").isNotNull())
    return joined.select(*[
        F.when(F.col("_take"), F.col("old_" + n)).otherwise(F.col(n)).alias(n) if n in actor else F.col(n)
        for n in events.columns])


# -- enrichment audit -------------------------------------------------------------------------
# Audited fields.
AUDITED_FIELDS = (
    "victim_org_name", "industry", "attack_type", "actor_name", "actor_type", "attribution_status",
    "country", "region", "summary_short",
)


def _audit_value(col: Column) -> Column:
    """Null for null, blank and unknown in any case."""
    return F.when((strip(col) != "") & (F.lower(strip(col)) != "unknown"), col)


def _recent(audit: DataFrame, as_of: datetime | Column | None, days: int) -> DataFrame:
    if as_of is None:
        return audit
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return audit.filter(F.col("started_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def audit_fields(audit: DataFrame, as_of: datetime | Column | None = None, days: int = 7) -> DataFrame:
    """Per field: already filled, filled now, filled in vain, still blank."""
    field = F.col("field")

    def value(name: str) -> Column:
        return F.try_element_at(F.col(name), field)
    rows = _recent(audit, as_of, days).withColumn("field", F.explode(F.array(*[F.lit(f) for f in AUDITED_FIELDS])))
    before, after = value("fields_before"), value("fields_after")
    # A web value replaces an article value only where it says something.
    returned = F.coalesce(_audit_value(value("web_returned")), _audit_value(value("article_returned")))
    bucket = (
        F.when(_audit_value(before).isNotNull(), F.when(returned.isNotNull(), F.lit("redundant")).otherwise(F.lit("already")))
        .when(_audit_value(after).isNotNull() & ~before.eqNullSafe(after), F.lit("filled")).otherwise(F.lit("blank")))
    return rows.select("field", bucket.alias("bucket")).groupBy("field").agg(*[
        F.count_if(F.col("bucket") == b).alias(b) for b in ("already", "filled", "redundant", "blank")])


def audit_totals(audit: DataFrame, as_of: datetime | Column | None = None, days: int = 7) -> DataFrame:
    return _recent(audit, as_of, days).agg(
        F.count("*").alias("runs"), F.count_if("article_called").alias("article_calls"),
        F.count_if("web_called").alias("web_calls"), F.count_if(F.col("error") != "").alias("failures"),
        F.when(F.count("*") > 0, F.floor(F.coalesce(F.sum("duration_ms"), F.lit(0)) / F.count("*"))).otherwise(0)
        .cast("bigint").alias("avg_duration_ms"))


def audit_usage(audit: DataFrame, as_of: datetime | Column | None = None, days: int = 7) -> DataFrame:
    """Usage sums per call kind and unit."""
    recent = _recent(audit, as_of, days)
    parts = [recent.select(F.lit(kind).alias("call"), F.explode(col).alias("unit", "amount"))
             for kind, col in (("article", "article_usage"), ("web", "web_usage"))]
    return parts[0].unionByName(parts[1]).groupBy("call", "unit").agg(F.sum("amount").alias("amount"))
