"""Keyed state of a stream in bucketed tables.

A table is cut into a fixed number of buckets by a hash of its key, and an epoch reads and
rewrites only the buckets that its rows fall into.  Every bucket has two slots: the one the
manifest names is in force, the other one takes what the running epoch writes.  The manifest
of an epoch is written last, in one of a few turning places, so

* an epoch that is repeated finds the state as it was before it and writes the same slots,
* a lost executor costs a task, a lost driver costs the epoch,
* what is kept and read does not grow with the number of epochs, which may have gaps.

The driver sees bucket numbers only, at most `buckets` for each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Manifests that are kept; the one before the running epoch has to be among them.
MANIFESTS = 4
_MANIFEST = "epoch bigint, name string, bucket int, slot int"


class BucketState:
    """State below one folder as it was before an epoch, and what the epoch makes of it."""

    def __init__(self, spark: SparkSession, path: str, epoch: int, buckets: int):
        self.spark, self.path, self.epoch, self.buckets = spark, path, epoch, buckets
        self.slots = self._manifest(epoch)

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(conf).exists(folder)

    def _manifest(self, before: int | None) -> dict[tuple[str, int], int]:
        """Slots in force in the last epoch before the given one."""
        if not self._exists("manifest"):
            return {}
        rows = self.spark.read.schema(_MANIFEST + ", place int").parquet(f"{self.path}/manifest")
        rows = rows if before is None else rows.filter(F.col("epoch") < before)
        found = rows.collect()  # MANIFESTS times the buckets of all tables
        last = max((r["epoch"] for r in found), default=None)
        return {(r["name"], r["bucket"]): r["slot"] for r in found if r["epoch"] == last}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: Column) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())

    def read(self, name: str, schema, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the buckets (all by default), without their bucket; the scan names the folders it needs."""
        slots = {b: s for (n, b), s in self.slots.items() if n == name and (buckets is None or b in buckets)}
        paths = [f"{self.path}/{name}/slot={s}/bucket={b}" for b, s in sorted(slots.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, key: Column, buckets: list[int]) -> None:
        """The new content of the buckets, all of it, into the slots that are not in force."""
        if not buckets:
            return
        target = {b: 1 - self.slots.get((name, b), 1) for b in buckets}
        slot = F.get(F.array(*[F.lit(target.get(b, 0)) for b in range(self.buckets)]), F.col("bucket"))
        dealt = rows.withColumn("bucket", self.bucket(key)).withColumn("slot", slot).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").parquet(f"{self.path}/{name}")
        self.slots = self.slots | {(name, b): s for b, s in target.items()}

    def commit(self) -> None:
        rows = [(self.epoch, n, b, s) for (n, b), s in sorted(self.slots.items())] or [(self.epoch, "", -1, 0)]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/place={self.epoch % MANIFESTS}")


def current(spark: SparkSession, path: str, name: str, schema=None) -> DataFrame:
    """A table of the state as the last committed epoch left it."""
    state = BucketState(spark, path, 0, 1)
    slots = {b: s for (n, b), s in state._manifest(None).items() if n == name}
    paths = [f"{path}/{name}/slot={s}/bucket={b}" for b, s in sorted(slots.items())]
    if not paths and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)
