"""Stored articles: insert, enrich, deduplicate, scan, purge; run log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.matching import strip
from ..functions.text import submitted_domain
from ..operators.spread import HOT_ROWS, join_unique, numbered, staged
from ..rules import registry as G


def domain_table(spark: SparkSession) -> DataFrame:
    """Allow-listed domains; a constant of the package."""
    return spark.createDataFrame(list(G.DOMAIN_TO_SOURCE.items()), "domain string, source_name string")


def with_allowed_source(rows: DataFrame, url_col: str = "url", domains: DataFrame | None = None) -> DataFrame:
    """Adds domain, source_name and domain_status."""
    if domains is None:
        domains = F.broadcast(domain_table(rows.sparkSession))
    marked = rows.withColumn("domain", submitted_domain(F.col(url_col))).join(domains, "domain", "left")
    return marked.withColumn("domain_status", F.when(F.col("source_name").isNull(), F.lit("domain_not_allowed")).otherwise(F.lit("ok")))


def with_article_ids(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New addresses with article_id, numbered in the order in which they were published, then by address.

    Of rows with one address the earliest stays, then the least source and title.  Numbers
    go on behind the largest stored one, so a later run never comes before an earlier one.
    """
    first = F.min_by(F.struct(*batch.columns), F.struct("published_at", "source_name", "title"))
    rows = batch.groupBy("article_url").agg(first.alias("_first")).select("_first.*")
    last = 0
    if stored is not None:
        rows = rows.join(stored.select("article_url").distinct(), "article_url", "left_anti").select(*batch.columns)
        last = stored.agg(F.max("article_id")).first()[0] or 0
    # Written, because finding the ranges looks at the rows a second time.
    fresh = staged(rows, "new-addresses")
    return numbered(fresh, ["published_at", "article_url"], "article_id", last).select("article_id", *batch.columns)


def new_by_url(batch: DataFrame, stored: DataFrame | None = None, order_col: str = "article_id") -> DataFrame:
    """Rows whose address is not stored yet; the first row of an address wins.

    The winner is found from addresses and ids alone and joined back by id, so
    neither a popular address nor the texts meet in one task.
    """
    winners = batch.groupBy("article_url").agg(F.min(order_col).alias(order_col))
    if stored is not None:
        winners = winners.join(stored.select("article_url"), "article_url", "left_anti")
    return batch.join(winners.select(order_col), order_col, "left_semi")


def insert_articles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.unionByName(new_by_url(batch, stored), allowMissingColumns=True)


def enrich(articles: DataFrame, bodies: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Replace thin feed content by landed page bodies (article_url, body).

    Adds candidate and enriched flags for the counts.  Bodies stay whole unless
    `max_chars` limits them (G.BODY_MAX_CHARS is the published limit).
    """
    c = F.col
    candidate = F.coalesce((c("source_type") == "rss") & (c("content_enriched") == F.lit(False)), F.lit(False))
    body = c("body") if max_chars is None else F.substring("body", 1, max_chars)
    usable = bodies.filter(F.length("body") >= G.BODY_MIN_CHARS).groupBy("article_url").agg(F.min(strip(body)).alias("body"))
    joined = articles.join(usable, "article_url", "left").withColumn("candidate", candidate).withColumn(
        "enriched", c("candidate") & c("body").isNotNull())
    thick = F.coalesce(F.length("content") >= G.THIN_CONTENT_CHARS, F.lit(False))
    return joined.withColumns({
        "content_enriched": F.when(c("candidate"), c("enriched") | thick).otherwise(c("content_enriched")),
        "content": F.when(c("enriched"), c("body")).otherwise(c("content")),
    }).select(*articles.columns, "candidate", "enriched")


def enrich_counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count_if("candidate").alias("candidates"), F.count_if("enriched").alias("enriched"))


def exact_duplicates(rows: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, text hash, whether the row repeats an earlier one, and which.

    Texts are compared stripped, squeezed and lower-cased.
    """
    normal = F.lower(F.regexp_replace(strip(text_col), r"(?U)\s+", " "))
    hashed = rows.select(id_col, F.sha2(normal, 256).alias("text_hash"))
    groups = hashed.groupBy("text_hash").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n_copies"))
    joined = join_unique(hashed, groups, "text_hash", "n_copies", id_col, hot_rows)
    is_copy = F.col(id_col) > F.col("first_id")
    return joined.select(id_col, "text_hash", is_copy.alias("is_duplicate"),
                         F.when(is_copy, F.col("first_id")).alias("duplicate_of"))


# Statuses a stage reads, in normal and in forced mode.
STAGE_STATUSES = {
    "process": (["pending"],
                ["pending", "irrelevant", "ready_for_extraction", "ready_for_clustering", "clustered"]),
    "extract": (["ready_for_extraction"], ["ready_for_extraction", "ready_for_clustering", "clustered"]),
    "cluster": (["ready_for_clustering"], ["ready_for_clustering", "clustered"]),
}


def stage_input(articles: DataFrame, stage: str, force: bool = False) -> DataFrame:
    return articles.filter(F.col("processing_status").isin(STAGE_STATUSES[stage][int(force)]))


def derived_status(decided: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """article_id and status: irrelevant, ready_for_extraction or clustered."""
    status = F.when(F.col("relevant"), F.lit("ready_for_extraction")).otherwise(F.lit("irrelevant"))
    out = decided.select("article_id", status.alias("processing_status"))
    if linked is None:
        return out
    marks = linked.select("article_id", F.lit("clustered").alias("later"))
    return out.join(marks, "article_id", "left").select(
        "article_id", F.coalesce("later", "processing_status").alias("processing_status"))


def purge(articles: DataFrame, retired_sources: Sequence[str] = ("ransomware-live",)) -> DataFrame:
    """Articles without rejected ones and without retired sources."""
    gone = F.coalesce(F.col("processing_status") == "irrelevant", F.lit(False))
    if retired_sources:
        gone = gone | F.coalesce(F.col("source_name").isin(list(retired_sources)), F.lit(False))
    return articles.filter(~gone)


def clean_articles(articles: DataFrame) -> DataFrame:
    """Texts trimmed, normal title lower-cased."""
    c = F.col

    def trimmed(name: str) -> Column:
        return strip(F.coalesce(c(name), F.lit("")))
    return articles.withColumns({"title": trimmed("title"), "summary": trimmed("summary"), "content": trimmed("content")}).withColumn(
        "normalized_title", F.lower("title"))


def submission_outcomes(submissions: DataFrame, stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Outcome of each submitted address (submission_id, url).

    `pages` gives url and the status of the landed page; a page that is not
    landed could not be fetched.
    """
    c = F.col
    rows = with_allowed_source(submissions.withColumn("url", strip(F.coalesce("url", F.lit("")))))
    known = stored.select(c("article_url").alias("url")).distinct().withColumn("known", F.lit(True))
    landed = pages.groupBy("url").agg(F.max_by("status", F.when(c("status") == "ok", 1).otherwise(0)).alias("page_status"))
    joined = rows.join(known, "url", "left").join(landed, "url", "left")
    outcome = (
        F.when(c("url") == "", F.lit("url required"))
        .when(~(F.startswith("url", F.lit("http://")) | F.startswith("url", F.lit("https://"))), F.lit("invalid url"))
        .when(c("known"), F.lit("already_exists"))
        .when(c("domain_status") != "ok", F.lit("domain_not_allowed"))
        .when(c("page_status").isNull(), F.lit("fetch_failed"))
        .when(c("page_status") != "ok", F.lit("insufficient_content"))
        .otherwise(F.lit("ingested")))
    return joined.select("submission_id", "url", "source_name", outcome.alias("outcome"))


# -- run log --------------------------------------------------------------------------------
def run_row(spark: SparkSession, started_at: datetime, finished_at: datetime, seconds: dict[str, float],
            error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(started_at, finished_at, error is None, {k: float(v) for k, v in seconds.items()}, error)], schema.RUNS)


def append_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run, and latest successful finished run, as one row each."""
    cols = [c for c in ("started_at", "finished_at", "success") if c in runs.columns]
    done = F.col("success") & F.col("finished_at").isNotNull()
    both = runs.agg(F.max_by(F.struct(*cols), "started_at").alias("latest"),
                    F.max_by(F.struct(*cols), F.when(done, F.col("finished_at"))).alias("latest_success"))
    entries = F.array(*[F.struct(F.lit(n).alias("which"), F.col(n).alias("run")) for n in ("latest", "latest_success")])
    return both.select(F.inline(entries)).filter("run is not null").select("which", "run.*")
