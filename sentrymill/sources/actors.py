"""Actor dictionary: loading, names in matching order, difference to an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import squeeze, strip
from ..rules.actors import SEED_ACTORS

ACTOR_SCHEMA = "canonical string, actor_type string, aliases array<string>"


def actor_dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Dictionary of (position, canonical, actor_type, aliases).

    `path` is a JSON-lines file with the columns of ACTOR_SCHEMA plus position,
    the order of its entries; without it the built-in seed is used.
    """
    if path is not None:
        return spark.read.schema("position int, " + ACTOR_SCHEMA).json(path)
    rows = [(i, *entry) for i, entry in enumerate(SEED_ACTORS)]
    return spark.createDataFrame(rows, "position int, " + ACTOR_SCHEMA)


def actor_names(dictionary: DataFrame) -> DataFrame:
    """One row per name; ord decides between names of equal length, entry order first."""
    names = dictionary.select(
        "position", "canonical", "actor_type",
        F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "alias"))
    return names.select(
        "alias", "canonical", "actor_type", F.length("alias").alias("alias_chars"),
        (F.col("position").cast("bigint") * 100000 + F.col("at")).alias("ord"))


def normal_name(col):
    return F.lower(squeeze(strip(F.coalesce(col, F.lit("")))))


def read_group_export(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a landed knowledge-base export: one JSON document with an object list."""
    schema = "objects array<struct<type:string,name:string,aliases:array<string>>>"
    return (spark.read.schema(schema).option("multiLine", True).json(path)
            .select(F.posexplode("objects").alias("position", "o"))
            .filter((F.col("o.type") == "intrusion-set") & (strip(F.col("o.name")) != ""))
            .select("position", strip(F.col("o.name")).alias("canonical"),
                    F.filter(F.coalesce("o.aliases", F.array().cast("array<string>")),
                             lambda a: a != strip(F.col("o.name"))).alias("aliases")))


def missing_groups(dictionary: DataFrame, export: DataFrame) -> DataFrame:
    """Exported groups of which neither name nor alias is known, one per name."""
    known = actor_names(dictionary).select(F.lower("alias").alias("name_key")).distinct()
    names = export.select("position", F.explode(F.concat(F.array("canonical"), "aliases")).alias("n"))
    hits = names.select("position", normal_name(F.col("n")).alias("name_key")).join(known, "name_key", "left_semi")
    fresh = export.join(hits.select("position").distinct(), "position", "left_anti")
    first = fresh.withColumn("name_key", normal_name(F.col("canonical"))).groupBy("name_key").agg(
        F.min_by(F.struct("canonical", "aliases"), "position").alias("g"))
    return (first.select("g.canonical", "g.aliases", F.lit("nation_state").alias("actor_type"))
            .orderBy(F.lower("canonical")))
