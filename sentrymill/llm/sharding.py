"""Sharding by histogram sort: count bytes below probes, refine, exchange once.

The sort key of a row is (hash of its text, id): equal texts lie side by side, and
a hot group of them can still be cut.  Each round counts the exact bytes between
the current probes over all partitions and draws the next probes from the keys
that lie in the brackets still open, so the number of rounds does not depend on
how keys are spread.  A splitter is done within `tolerance` of a shard's share, or
when no key lies between its bounds.  Counts that reach the driver are bounded by
the number of shards and probes, never by rows.

Only then are rows exchanged, once, by (shard, part); a part holds a bounded
number of rows, and slots are offset of the part plus place in the part.

Defined results: a null text has no bytes; size is its UTF-8 bytes plus one, so
empty rows count too; rows that repeat id and text share a key and get different
slots of one shard; a null id sorts first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.llm.common import body
from sentrymill.operators.spread import staged

PROBES = 16
TOLERANCE = 0.001
ROWS_PER_PART, LEAST_PARTS = 1_000_000, 16
_LOWEST = -(1 << 63)

Key = tuple[int, int]


@dataclass
class Bracket:
    """Keys around a splitter with the bytes of all rows below them; None is beyond the last key."""
    target: float
    low: Key
    low_bytes: int
    high: Key | None
    high_bytes: int
    open: bool = True


def _below(probes: list[Key]) -> Column:
    """How many probes are not above the key of the row."""
    if not probes:
        return F.lit(0)
    known = F.array(*[F.struct(F.lit(h).cast("bigint").alias("_hash"), F.lit(d).cast("bigint").alias("_order")) for h, d in probes])
    return F.size(F.filter(known, lambda p: p <= F.struct("_hash", "_order")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = body(text_col)
    return docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST)).alias("_order"),
        (F.octet_length(text) + 1).cast("bigint").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))


def _histogram(rows: DataFrame, probes: list[Key], draws: int) -> tuple[list[int], dict[int, list[Key]]]:
    """Bytes of each interval between probes, and keys drawn from it."""
    draw = F.xxhash64("_hash", "_order", F.lit(len(probes)))
    found = (rows.groupBy(_below(probes).alias("_at"), F.pmod(draw, F.lit(draws)).alias("_draw"))
             .agg(F.sum("_size").alias("_bytes"), F.min(F.struct(draw.alias("_r"), "_hash", "_order")).alias("_key"))
             .select("_at", "_bytes", "_key._hash", "_key._order").collect())
    sizes, keys = [0] * (len(probes) + 1), {}
    for at, size, h, d in found:
        sizes[at] += size
        keys.setdefault(at, []).append((h, d))
    return sizes, keys


def _narrow(brackets: list[Bracket], probes: list[Key], sizes: list[int]) -> None:
    below = 0
    for i, probe in enumerate(probes):
        below += sizes[i]
        for b in brackets:
            if b.low < probe and (b.high is None or probe < b.high):
                if below <= b.target:
                    b.low, b.low_bytes = probe, below
                else:
                    b.high, b.high_bytes = probe, below


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, draws: int = PROBES) -> list[Key]:
    """Keys that start shards 1, 2, ...; rows below the first belong to shard 0."""
    sizes, keys = _histogram(rows, [], draws)
    total = sizes[0]
    if not total or shards < 2:
        return []
    slack = tolerance * total / shards
    first = (_LOWEST, _LOWEST)
    brackets = [Bracket(total * i / shards, first, 0, None, total) for i in range(1, shards)]
    drawn = [k for ks in keys.values() for k in ks]
    while True:
        probes = sorted(set(drawn) - {first})
        if not probes:
            break
        sizes, keys = _histogram(rows, probes, draws)
        _narrow(brackets, probes, sizes)
        drawn = []
        for b in brackets:
            near = min(b.target - b.low_bytes, b.high_bytes - b.target)
            fresh = [k for k in keys.get(bisect_right(probes, b.low), []) if k > b.low]
            b.open = b.open and near > slack and bool(fresh)
            # The bounds stay probes, so that the next keys are drawn from inside the bracket.
            drawn += [*fresh, b.low, *([b.high] if b.high else [])] if b.open else []
    chosen = [b.low if b.high is None or b.target - b.low_bytes <= b.high_bytes - b.target else b.high for b in brackets]
    return _whole_groups(rows, chosen, [b.target for b in brackets], slack)


def _whole_groups(rows: DataFrame, chosen: list[Key], targets: list[float], slack: float) -> list[Key]:
    """Moves a splitter to an edge of the group of equal texts it cuts, where that stays within the slack."""
    edges = {s: [(s[0], _LOWEST), *([(s[0] + 1, _LOWEST)] if s[0] < -_LOWEST - 1 else [])] for s in chosen}
    probes = sorted({k for ks in edges.values() for k in ks} | set(chosen))
    sizes, _ = _histogram(rows, probes, 1)
    below, total = {}, 0
    for probe, size in zip(probes, sizes):
        total += size
        below[probe] = total
    return sorted(min((abs(below[k] - t), k) for k in edges[s] if abs(below[k] - t) <= slack)[1]
                  if any(abs(below[k] - t) <= slack for k in edges[s]) else s for s, t in zip(chosen, targets))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot, part."""
    rows = staged(keyed(docs, id_col, text_col), "shard_keys")
    cuts = splitters(rows, shards, tolerance)
    count = rows.count()
    parts = max(LEAST_PARTS, -(-count // (shards * ROWS_PER_PART)))
    dealt = rows.withColumns({"shard": _below(cuts), "part": F.pmod(F.xxhash64("_order", "_hash"), F.lit(parts)).cast("int")})
    held = dealt.groupBy("shard", "part").count()
    offsets = held.select("shard", "part", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("_hash", "_order"))
    return (dealt.withColumn("_place", place).join(offsets, ["shard", "part"]).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
        (F.col("_offset") + F.col("_place") - 1).cast("bigint").alias("slot"), "part"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = TOLERANCE) -> DataFrame:
    """Writes all columns of docs below path, a folder per shard, rows in key order in each part; returns what was written.

    Texts move in one exchange, by (shard, part).
    """
    spark = docs.sparkSession
    rows = staged(keyed(docs, id_col, text_col), "shard_keys")
    cuts = splitters(rows, shards, tolerance)
    parts = max(LEAST_PARTS, -(-rows.count() // (shards * ROWS_PER_PART)))
    hashed = docs.withColumns({"_hash": F.xxhash64(body(text_col)), "_order": F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST))})
    dealt = hashed.withColumns({"shard": _below(cuts), "_part": F.pmod(F.xxhash64("_order", "_hash"), F.lit(parts))})
    (dealt.repartition(shards * parts, "shard", "_part").sortWithinPartitions("shard", "_part", "_hash", "_order")
     .drop("_hash", "_order", "_part").write.partitionBy("shard").parquet(path))
    return spark.read.parquet(path)
