"""Units of work for comparing the rows of groups of any size, all with all.

A group above the tile size is cut into tiles by layer and hash, and each pair of tiles
of the same or neighbouring layers is a unit of its own, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.operators.spread import staged

TILE = 4096


def tile_units(rows: DataFrame, name_col: str, tile: int = TILE) -> DataFrame:
    """rows with `unit`, repeated for each unit: two rows of a group meet in one if their layers differ by 1 or less.

    rows: group (bigint), layer (int, of a bounded range), and the column that tells rows of a group apart.
    """
    counted = rows.groupBy("group", "layer").count()
    hot = staged(counted.groupBy("group").agg(
        F.sum("count").alias("_rows"),
        F.collect_list(F.struct("layer", F.ceil(F.col("count") / tile).cast("int").alias("parts"))).alias("tiles"))  # one per layer
        .filter(F.col("_rows") > tile).select("group", "tiles"), "hot_groups")
    joined = rows.join(hot, "group", "left")
    own = F.get(F.filter("tiles", lambda t: t["layer"] == F.col("layer")), F.lit(0))["parts"]
    me = F.struct(F.col("layer"), F.pmod(F.xxhash64(name_col), own).cast("int").alias("part"))

    def pairs(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), t["parts"] - 1), lambda q: F.xxhash64(
            F.col("group"), F.least(me, F.struct(t["layer"].alias("layer"), q.alias("part"))),
            F.greatest(me, F.struct(t["layer"].alias("layer"), q.alias("part")))))
    near = F.filter("tiles", lambda t: F.abs(t["layer"] - F.col("layer")) <= 1)
    units = F.when(F.col("tiles").isNull(), F.array(F.xxhash64("group"))).otherwise(F.flatten(F.transform(near, pairs)))
    return joined.select(F.explode(units).alias("unit"), *rows.columns)
