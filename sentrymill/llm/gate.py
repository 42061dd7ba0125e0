"""A gate of fixed size: which of many keys can occur in another table.

The gate is a bitmap over hashes of the keys, kept as rows (_bucket, _bitmap).  Its size
is set by `bits` alone, so it can be sent to every task.  It never holds back a key that
occurs; a key that does not may pass, so an exact step has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2**24 bits are 2 MB.
GATE_BITS = 24


def _slot(key: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits)) + 1


def gate(keys: DataFrame, key: list[str], bits: int = GATE_BITS) -> DataFrame:
    slots = keys.select(_slot(key, bits).alias("_slot"))
    return (slots.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bitmap")))


def passes(rows: DataFrame, built: DataFrame, key: list[str], bits: int = GATE_BITS, flag: str = "_passes") -> DataFrame:
    """rows with a flag that is false where the key cannot occur."""
    slot = _slot(key, bits)
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bitmap", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) > 0
    # Of proven size: 2**bits / 8 bytes.
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(built), "_bucket", "left")
            .withColumn(flag, F.coalesce(is_set, F.lit(False))).drop("_bucket", "_bitmap"))
