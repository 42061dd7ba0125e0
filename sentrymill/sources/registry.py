"""Source registry as a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import registry as G

REGISTRY_SCHEMA = (
    "source_name string, display_label string, source_class string, signal_kind string, "
    "ingest_type string, url string, tier string, tier_trusted_alone boolean, active boolean"
)


def source_registry(spark: SparkSession, active_only: bool = False) -> DataFrame:
    registry = spark.createDataFrame(G.SOURCES, REGISTRY_SCHEMA)
    return registry.filter("active") if active_only else registry


def with_source(articles: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Registry columns next to each article, null for an unknown source.

    The registry is a constant of the package with one row per source, so
    broadcasting the built-in one is always safe.  A registry passed by the
    caller carries no hint: Spark picks the join from its size.
    """
    if registry is None:
        registry = F.broadcast(source_registry(articles.sparkSession))
    known = registry.select("source_name", "display_label", "source_class", "signal_kind",
                            "tier_trusted_alone", F.col("url").alias("source_feed_url"))
    return articles.join(known, "source_name", "left")
