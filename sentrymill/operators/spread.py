"""Joins and ordered windows that do not send a hot key to one task.

A key may hold a large share of all rows.  `join_unique` keeps such keys out of
one task of the big side's shuffle.

The ordered helpers are prefix scans over ranges.  Rows are range-partitioned by key and
order, so a hot key is cut wherever a partition ends, whatever its order values look like.
Each range of a key is worked on by itself and gives one summary; the summaries of a key,
at most one per partition, are scanned in order, and what they carry is joined back to the
rows of their range.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one key from which it is joined on the map side.  At most
# rows / HOT_ROWS keys can be that large, which bounds the broadcast.
HOT_ROWS = 2_000_000

# Rows of costly rules that one task works on.
TASK_ROWS = 50_000


def dealt(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows dealt by key to as many tasks as `n_rows` ask for, in full rounds of all cores.

    How files are cut says little about the work on their rows: of a file that is one
    row group one task gets all, and small files are put together by their bytes.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, math.ceil(n_rows / TASK_ROWS / cores)), key)


def join_unique(left: DataFrame, right: DataFrame, key: str, size_col: str, spread_col: str,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to a side with one row per key that knows the group size.

    `size_col` of the right side is the number of left rows of the key.  Left rows of
    keys above `hot_rows` meet their broadcast row where they are; in the shuffle of the
    second join they and rows without a key match nothing and are spread by a salt.
    """
    values = [c for c in right.columns if c != key]
    hot = right.filter(F.col(size_col) > hot_rows).select(key, F.struct(*values).alias("_hot"))
    # Always 0, but worked out from the row: a literal would be moved out of the join keys.
    salt = F.when(F.col(size_col) < 0, 1).otherwise(0)
    cold = right.filter(F.col(size_col) <= hot_rows).select(key, F.struct(*values).alias("_cold"), salt.alias("_salt"))
    spread = 1 + F.pmod(F.xxhash64(spread_col), F.lit(1024)).cast("int")
    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(spread))
    joined = salted.join(cold, [key, "_salt"], "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*[F.col(c) for c in left.columns], *[found[v].alias(v) for v in values])


def ranges(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with `_range`: the number of the partition that holds them when rows are range-partitioned by key and order.

    Rows of one key with a lower order have a lower or the same number.  The number is written
    with the rows, so it stays the same for all readers and after a loss.  `parts` is the number
    of partitions; by default that of shuffles.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], out: str, start: int = 0, parts: int | None = None) -> DataFrame:
    """rows with a gapless number in the given order, from `start` + 1 on; ties in any order.

    Each range counts its rows, and the running sum of these counts, one per partition, is
    where the numbers of a range begin.
    """
    cut = ranges(rows, [], order, parts)
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = counts.select("_range", (before + start).alias("_before"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.withColumn("_local", local).join(F.broadcast(carry), "_range").select(
        *rows.columns, (F.col("_before") + F.col("_local")).alias(out))


def run_starts(rows: DataFrame, key: str, order_col: str, kind_col: str, seed_col: str, closing_kind: str,
               out: str, parts: int | None = None) -> DataFrame:
    """Seed of the run each row belongs to.

    Within a key and in order, a run starts at the first row and after every row
    of `closing_kind`.
    """
    order = F.col(order_col)
    cut = ranges(rows, [key], [order_col], parts)
    w = Window.partitionBy(key, "_range").orderBy(order_col)
    cut = cut.withColumn("_prev", F.lag(kind_col).over(w))
    cut = cut.withColumn("_opened", F.when(F.col("_prev") == closing_kind, F.col(seed_col)))
    cut = cut.withColumn("_local", F.last("_opened", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = cut.groupBy(key, "_range").agg(
        F.max_by(kind_col, order).alias("_last_kind"), F.min_by(seed_col, order).alias("_first_seed"),
        F.max_by("_opened", F.when(F.col("_opened").isNotNull(), order)).alias("_last_opened"))
    wk = Window.partitionBy(key).orderBy("_range")
    edges = edges.withColumn("_before", F.lag("_last_kind").over(wk))
    opens = F.col("_before").isNull() | (F.col("_before") == closing_kind)
    edges = edges.withColumn("_first_run", F.when(opens, F.col("_first_seed")))
    carried = F.last(F.coalesce("_last_opened", "_first_run"), ignorenulls=True).over(
        wk.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(key, "_range", F.coalesce("_first_run", carried).alias("_carry"))
    joined = cut.join(edges, [key, "_range"], "left")
    return joined.select(*rows.columns, F.coalesce("_local", "_carry").alias(out))


def neighbour_text(rows: DataFrame, key: str, order_col: str, text_col: str, reach: int,
                   parts: int | None = None) -> DataFrame:
    """Up to `reach` characters of the texts before and after each row of the key.

    Rows are taken in descending `order_col`, joined by one blank; texts are not
    empty.  Adds before_text and after_text, null where there is no neighbour.

    Inside a range a row gets a position that counts at most `reach` characters
    per text, so all neighbours that can matter lie within twice the reach: the
    range frame holds a row or two of normal texts and more only of short ones.
    """
    near = 2 * reach + 1

    def joined_tail(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.right(F.array_join(parts, " "), F.lit(reach)))

    def joined_head(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.left(F.array_join(parts, " "), F.lit(reach)))

    def glue(first: Column, second: Column) -> Column:
        return F.concat_ws(" ", first, second)

    cut = ranges(rows, [key], [order_col], parts).withColumns({
        "_head": F.left(text_col, F.lit(reach)), "_tail": F.right(text_col, F.lit(reach)),
    })
    group = Window.partitionBy(key, "_range")
    upto = group.orderBy(F.desc(order_col)).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_place", F.coalesce(F.sum(F.length("_head") + 1).over(upto), F.lit(0)).cast("bigint"))
    by_place = group.orderBy("_place")
    local = placed.withColumns({
        "_before": joined_tail(F.collect_list("_tail").over(by_place.rangeBetween(-near, -1))),
        "_after": joined_head(F.collect_list("_head").over(by_place.rangeBetween(1, near))),
    }).drop("_place")
    edges = local.groupBy(key, "_range").agg(
        F.min_by(F.right(glue(F.col("_before"), F.col("_tail")), F.lit(reach)), order_col).alias("_range_tail"),
        F.max_by(F.left(glue(F.col("_head"), F.col("_after")), F.lit(reach)), order_col).alias("_range_head"),
    )
    wk = Window.partitionBy(key).orderBy(F.desc("_range"))
    edges = edges.select(
        key, "_range",
        joined_tail(F.collect_list("_range_tail").over(wk.rowsBetween(-reach, -1))).alias("_far_before"),
        joined_head(F.collect_list("_range_head").over(wk.rowsBetween(1, reach))).alias("_far_after"),
    )
    both = local.join(edges, [key, "_range"], "left")
    before = F.nullif(F.right(glue(F.col("_far_before"), F.col("_before")), F.lit(reach)), F.lit(""))
    after = F.nullif(F.left(glue(F.col("_after"), F.col("_far_after")), F.lit(reach)), F.lit(""))
    return both.select(*rows.columns, before.alias("before_text"), after.alias("after_text"))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut-off results, as the session names it.

    Only where the session names none is a temporary folder used, which is right
    for tests on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        root = current if current else None
    if not root:
        root = tempfile.mkdtemp(prefix="sentrymill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a result once and read it back: consumers share it and losses stop here."""
    spark = frame.sparkSession
    path = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
