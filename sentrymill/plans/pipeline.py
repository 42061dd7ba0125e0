"""The batch pipeline: process, extract, cluster, merge, attribute."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attribute import attribute_events
from ..operators.cluster import assign_clusters, link_articles, with_keys
from ..operators.extract import extract_signals
from ..operators.merge import final_trust, merge_events
from ..operators.relevance import with_relevance
from ..operators.spread import dealt, staged
from ..sources import landed, store
from ..sources.actors import actor_dictionary
from ..sources.registry import with_source

WORK_COLUMNS = ("text_all", "text_lead", "text_title")


def process(articles: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Articles with source columns, working texts, named victim and verdict."""
    return with_relevance(with_source(articles, registry))


def extract(processed: DataFrame) -> DataFrame:
    """Extraction rows of the relevant articles; `processed` is a written table."""
    relevant = processed.filter("relevant")
    return extract_signals(dealt(relevant, "article_id", processed.count())).drop(*WORK_COLUMNS)


def process_and_extract(articles: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Processed articles and the extraction rows of the relevant ones, each written once.

    In one plan the filter on the verdict would move below the verdict, and every
    consumer would evaluate victim and rules again; written tables prevent that.
    """
    processed = staged(process(articles, registry), "processed")
    return processed, staged(extract(processed), "extracted")


def link(extracted: DataFrame) -> DataFrame:
    """Extraction rows with the event each article belongs to."""
    return link_articles(extracted, assign_clusters(with_keys(extracted)))


@dataclass
class Result:
    """Tables of one run and what each stage took."""
    processed: DataFrame
    links: DataFrame
    events: DataFrame
    seconds: dict[str, float]
    run_row: DataFrame


def run(articles: DataFrame, dictionary: DataFrame | None = None, registry: DataFrame | None = None,
        trust_pass: str = "compat", runs_path: str | None = None) -> Result:
    """Run all stages from articles to attributed events.

    The row of the run log is part of the result; with `runs_path` it is appended there,
    also when a stage fails.

    Extraction and links are written once, because several later stages read
    them.  trust_pass "final" adds the attribution of this run to the score;
    "compat" leaves it to the next merge.
    """
    if trust_pass not in ("compat", "final"):
        raise ValueError(f"unknown trust_pass '{trust_pass}'")
    if dictionary is None:
        dictionary = actor_dictionary(articles.sparkSession)
    seconds: dict[str, float] = {}
    spark, began = articles.sparkSession, _now()

    def logged(error: str | None = None) -> DataFrame:
        row = store.run_row(spark, began, _now(), seconds, error)
        if runs_path is not None:
            store.append_run(row, runs_path)
        return row

    def timed(stage: str, build):
        started = time.monotonic()
        try:
            return build()
        finally:
            seconds[stage] = round(time.monotonic() - started, 2)

    try:
        processed = timed("process", lambda: staged(process(articles, registry), "processed"))
        extracted = timed("extract", lambda: staged(extract(processed), "extracted"))
        linked = timed("cluster", lambda: staged(link(extracted), "linked"))
        merged = timed("merge", lambda: staged(merge_events(linked), "events"))
        attributed = timed("attribute", lambda: staged(attribute_events(merged, linked, dictionary), "attributed"))
    except Exception as error:
        logged(str(error)[:2000])
        raise
    if trust_pass == "final":
        attributed = final_trust(attributed)
    return Result(processed, linked, attributed, seconds, logged())


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def collect_articles(spark: SparkSession, paths: dict[str, str], fetched_at: datetime, stored: DataFrame | None = None,
                     bodies: DataFrame | None = None, documents: DataFrame | None = None,
                     max_age_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ingest and enrich: landed feeds to stored articles with ids, ready for `run`, and rows left out for their age.

    `stored` holds articles of earlier runs, `bodies` (article_url, body) landed pages.
    """
    fresh = landed.ingest(spark, paths, fetched_at, documents=documents)
    aged = fresh.limit(0)
    if max_age_days is not None:
        fresh, aged = landed.split_by_age(fresh, max_age_days)
    batch = store.with_article_ids(fresh, stored).withColumn("content_enriched", F.lit(False))
    articles = batch if stored is None else stored.unionByName(batch, allowMissingColumns=True)
    if bodies is not None:
        articles = store.enrich(articles, bodies).drop("candidate", "enriched")
    return staged(articles, "stored"), aged
