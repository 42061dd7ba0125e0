"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

The first scan reads length and prefix hash of every text.  Keys that more than
one row shares are put into a bitmap of fixed size, the gate.  The second scan
hashes the full content only of rows that pass the gate; the others are alone
for certain.  No text is ever shuffled.

Defined results: a null text counts as empty and all empty texts are one group;
the largest id of a group stays, a null id only if the group has no other; rows
that repeat both id and text are kept or dropped together; an empty table gives
an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import body
from sentrymill.llm.gate import GATE_BITS, gate, passes
from sentrymill.operators.spread import staged

# Characters of a text that the prefix hash covers.
PREFIX_CHARS = 256

def _shape(text_col: str, prefix_chars: int) -> list[Column]:
    text = body(text_col)
    return [F.octet_length(text).alias("_length"), F.xxhash64(F.left(text, F.lit(prefix_chars))).alias("_prefix")]


def shared_shapes(shapes: DataFrame) -> DataFrame:
    """The (length, prefix) keys that more than one row has: lengths first, prefixes only of lengths that repeat."""
    # Written, so that Spark can split the join at a length that very many texts have.
    lengths = staged(shapes.groupBy("_length").count().filter("count > 1").select("_length"), "exact_lengths")
    return (shapes.join(lengths, "_length", "left_semi").groupBy("_length", "_prefix").count().filter("count > 1")
            .select("_length", "_prefix"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False,
                 prefix_chars: int = PREFIX_CHARS, gate_bits: int = GATE_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that the gate held back, unless `digest_all`.
    """
    shapes = staged(docs.select(*_shape(text_col, prefix_chars)), "exact_shapes")
    key = ["_length", "_prefix"]
    rows = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"), *_shape(text_col, prefix_chars))
    gated = passes(rows, gate(shared_shapes(shapes), key, gate_bits), key, gate_bits, "_survives")
    wanted = F.lit(True) if digest_all else F.col("_survives")
    hashed = staged(gated.select("_id", "_survives", "_length", "_prefix", F.when(
        wanted, F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest")), "exact_digests")
    key = [*key, "_digest"]
    groups = staged(hashed.filter("_survives").groupBy(*key).agg(
        F.max("_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1"), "exact_groups")
    several = hashed.filter("_survives").join(groups, key, "left").select("_id", "_digest", "_keep", "_size")
    alone = hashed.filter("NOT _survives").select(
        "_id", "_digest", F.lit(None).cast(docs.schema[id_col].dataType).alias("_keep"), F.lit(None).cast("bigint").alias("_size"))
    both = several.unionByName(alone)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return both.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
                       F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    # By id and content: another row without an id, or another text with the same id, is no copy.
    gone = staged(exact_groups(docs, id_col, text_col).filter("NOT kept").select(
        F.col(id_col).alias("id"), F.col("text_sha256").alias("digest")).distinct(), "exact_gone")
    # Only rows whose id may go are shuffled, and every row travels as one struct, so no name can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), body(text_col).alias("text"))
    flagged = passes(rows, gate(gone, ["id"]), ["id"])
    doubtful = flagged.filter("_passes").select("row", "id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    same = doubtful["id"].eqNullSafe(gone["id"]) & (doubtful["digest"] == gone["digest"])
    return flagged.filter("NOT _passes").select("row.*").union(doubtful.join(gone, same, "left_anti").select("row.*"))
