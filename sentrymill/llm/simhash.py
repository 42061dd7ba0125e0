"""SimHash near-dedup by tiled exact comparison.

Fingerprints that can be near share a group: one of radius + 1 blocks of bytes must be
equal, and no link is missed.  Inside a group numpy compares whole tiles by exclusive-or and bit counts; rows are sorted by their
population count, and tiles whose counts differ by more than the radius are skipped.

A group above the tile size is cut into tiles by population count and hash, and each
pair of tiles that can hold a near pair is a unit of work of its own, so no task holds a
group.  Equal fingerprints are compared once.  A unit gives a spanning set of links
instead of all its pairs; star contraction joins them to components.

Defined results: a null text counts as empty; a text without words has fingerprint
zero and links like any other; repeated rows share a component; null ids are
ignored when the least id is taken; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import body
from sentrymill.llm.components import components
from sentrymill.llm.similar_sets import near_dedup  # noqa: F401  the pipeline's stage, by its former name
from sentrymill.llm.tiles import TILE, tile_units
from sentrymill.operators.spread import staged

SEED = 42
_SMALL, _BLOCK = 64, 512
_ROWS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Kind:
    """Words of a shingle, 64-bit words of a fingerprint, differing bits that still link."""
    shingle: int = 3
    width: int = 1
    radius: int = 3


EXACT_RADIUS = Kind()


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash made of a hash; the first is the hash itself."""
    if k == 0:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of every run of `size` words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])]


def fingerprints_of(texts: list[str], kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as big-endian bytes (rows, 8 * width), and shingle counts."""
    hashed = [shingle_hashes(t, kind.shingle) for t in texts]
    counts = np.array([len(h) for h in hashed], np.int64)
    flat = np.array([x for h in hashed for x in h], np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    votes = np.zeros((len(texts), 64 * kind.width), np.int64)
    for start in range(0, len(flat), _ROWS_AT_ONCE):
        own, rows = flat[start:start + _ROWS_AT_ONCE], owner[start:start + _ROWS_AT_ONCE]
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        for k in range(kind.width):
            bits = np.unpackbits(_mixed(own, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[rows[edges], 64 * k:64 * k + 64] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > counts[:, None], axis=1), counts


def fingerprints(docs: DataFrame, kind: Kind = EXACT_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (binary), ones (its population count), shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                bits, counts = fingerprints_of(part.column(1).to_pylist(), kind)
                ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(ones, pa.int32()),
                                                  pa.array(counts, pa.int64())], schema.names)

    rows = docs.select(id_col, body(text_col).alias("_text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("fingerprint", T.BinaryType()), T.StructField("ones", T.IntegerType()),
                           T.StructField("shingles", T.LongType())])
    return rows.mapInArrow(run, schema)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index that each of n rows reaches over the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_rows(bits: np.ndarray, ones: np.ndarray, unit: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by (unit, ones): the least row of the same unit that each is linked with, over links inside units."""
    n, found_a, found_b = len(ones), [], []
    sizes = np.diff(np.append(np.flatnonzero(np.diff(unit, prepend=unit[0] - 1 if n else 0)), n))
    starts = np.cumsum(sizes) - sizes
    small = np.repeat(sizes <= _SMALL, sizes)
    rows, step = np.flatnonzero(small), 1
    while len(rows):
        rows = rows[rows + step < n]
        rows = rows[(unit[rows] == unit[rows + step]) & (ones[rows + step] - ones[rows] <= radius)]
        near = np.bitwise_count(bits[rows] ^ bits[rows + step]).sum(axis=1, dtype=np.int32) <= radius
        found_a.append(rows[near])
        found_b.append(rows[near] + step)
        step += 1
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        a, b = _tiles(bits[start:start + size], ones[start:start + size], radius)
        found_a.append(a + start)
        found_b.append(b + start)
    empty = [np.empty(0, np.int64)]
    return spanning(np.concatenate(found_a or empty), np.concatenate(found_b or empty), n)


def _tiles(bits: np.ndarray, ones: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one unit, tile against tile."""
    n, a, b = len(ones), np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, n, _BLOCK):
        for j in range(i, n, _BLOCK):
            if ones[j] - ones[min(i + _BLOCK, n) - 1] > radius:
                break
            differ = np.zeros((min(_BLOCK, n - i), min(_BLOCK, n - j)), np.uint16)
            for k in range(bits.shape[1]):
                differ += np.bitwise_count(bits[i:i + _BLOCK, k, None] ^ bits[None, j:j + _BLOCK, k])
            x, y = np.nonzero(differ <= radius)
            x, y = x + i, y + j
            keep = x < y
            label = spanning(np.concatenate((a, x[keep])), np.concatenate((b, y[keep])), n)
            a = np.flatnonzero(label != np.arange(n))
            b = label[a]
    return a, b


def _groups(kind: Kind) -> Column:
    """Groups that near fingerprints share at least one of."""
    blocks = kind.radius + 1
    size = 8 * kind.width // blocks
    return F.array(*[F.xxhash64(F.lit(i), F.substring("fingerprint", i * size + 1, size if i + 1 < blocks else 8 * kind.width))
                     for i in range(blocks)])


def near_links(distinct: DataFrame, kind: Kind, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span all pairs within the radius."""
    rows = distinct.select("fingerprint", "ones", F.explode(_groups(kind)).alias("group"))
    layered = rows.withColumn("layer", F.floor(F.col("ones") / max(kind.radius, 1)).cast("int"))
    units = tile_units(layered, "fingerprint", tile).select("unit", "ones", "fingerprint").repartition("unit").sortWithinPartitions("unit", "ones")

    def linked(table: pa.Table) -> pa.RecordBatch:
        raw = table.column("fingerprint").combine_chunks()
        bits = np.frombuffer(b"".join(raw.to_pylist()), ">u8").reshape(-1, kind.width).astype(np.uint64)
        label = near_rows(bits, table.column("ones").to_numpy(), table.column("unit").to_numpy(), kind.radius)
        rows = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([raw.take(pa.array(rows)), raw.take(pa.array(label[rows]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # rows of the last unit may go on in the next batch
            if cut or (held and held[-1].column(0)[-1].as_py() != unit[-1]):
                yield linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield linked(pa.Table.from_batches(held))

    return units.mapInArrow(run, "a binary, b binary")


def near_groups(docs: DataFrame, kind: Kind = EXACT_RADIUS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of docs: id, fingerprint (binary), component_id (least id reachable)."""
    known = staged(fingerprints(docs, kind, id_col, text_col), "simhash_fingerprints")
    distinct = staged(known.groupBy("fingerprint", "ones").agg(F.min(id_col).alias("_least"), F.max("shingles").alias("shingles")),
                      "simhash_distinct")
    labels = staged(components(near_links(distinct, kind, tile)), "simhash_labels")
    classed = distinct.join(labels, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("label", "fingerprint").alias("_label"), "_least")
    least = staged(classed.groupBy("_label").agg(F.min("_least").alias("component_id")), "simhash_components")
    by_print = staged(classed.join(least, "_label").select("fingerprint", "component_id"), "simhash_classes")
    return known.join(by_print, "fingerprint").select(id_col, "fingerprint", "component_id")


def linked_texts(docs: DataFrame, kind: Kind = EXACT_RADIUS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of ids, a > b, that join all rows whose fingerprints link; not every two of them."""
    known = staged(fingerprints(docs, kind, id_col, text_col), "simhash_fingerprints")
    distinct = staged(known.groupBy("fingerprint", "ones").agg(F.min(id_col).alias("_least")), "simhash_distinct")
    least = distinct.select("fingerprint", "_least")
    equal = known.join(least, "fingerprint").select(F.col(id_col).alias("a"), F.col("_least").alias("b"))
    near = (near_links(distinct, kind, tile)
            .join(least.select(F.col("fingerprint").alias("a"), F.col("_least").alias("_one")), "a")
            .join(least.select(F.col("fingerprint").alias("b"), F.col("_least").alias("_two")), "b").select("_one", "_two"))
    return equal.union(near).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
