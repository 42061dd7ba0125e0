"""Byte-level BPE over whole texts: vectorised pre-tokens, cached pair merging, exact decoding.

Encoding runs per Arrow batch inside tasks; nothing is shuffled.  Every pre-token
is merged once per worker and then found in a cache of bounded size.  Byte offsets
of the tokens are kept, so any slice of tokens can be decoded to its place.

Defined results: a null text counts as empty and has no tokens; each row is
encoded on its own, so repeated rows and null ids are fine; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm import pretokens
from sentrymill.llm.common import body

# Entries of a worker's cache; rows and characters that are worked on at once.
CACHE_SIZE = 250_000
CHUNK_ROWS = 256
CHUNK_CHARS = 1_000_000
_LONG_PIECE = 48


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: always the leftmost adjacent pair of the least rank is merged."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i:i + 1] for i in range(len(piece))]
        parts = self._merge_long(parts) if len(parts) > _LONG_PIECE else self._merge_short(parts)
        return [self.ranks[p] for p in parts]

    def _merge_short(self, parts: list[bytes]) -> list[bytes]:
        get, never = self.ranks.get, len(self.tokens)
        costs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < never:
            i = costs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], never)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], never)
        return parts

    def _merge_long(self, parts: list[bytes | None]) -> list[bytes]:
        """The same with a heap, for pieces of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = parts[i] + parts[after[i]]
                if both in self.ranks:
                    heapq.heappush(heap, (self.ranks[both], i, both))
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or parts[i] + parts[after[i]] != both:
                continue
            gone = after[i]
            parts[i], parts[gone] = both, None
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many belong to each text."""
        together = "".join(texts)
        codepoints = np.frombuffer(together.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        first = np.zeros(len(codepoints) + 1, bool)
        first[0] = True
        first[ends] = True
        starts = pretokens.starts(codepoints, first[:-1])
        cuts = [*starts.tolist(), len(together)]
        pieces = [together[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        cache = self.cache
        for piece in set(pieces).difference(cache):
            cache[piece] = np.array(self.merge(piece.encode()), "<i4").tobytes()
        blobs = [cache[p] for p in pieces]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        per_piece = np.concatenate(([0], np.cumsum(sizes)))
        bounds = per_piece[np.searchsorted(starts, ends)]
        return np.frombuffer(b"".join(blobs), "<i4"), np.diff(bounds, prepend=0)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of tokens that stand at the given byte offsets."""
        lengths = self.lengths[ids]
        source = np.repeat(self.places[ids] - offsets, lengths) + np.arange(lengths.sum())
        return self.bytes[source].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def _chunks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: id, ids, offsets (byte where each token starts in the UTF-8 text).

    With `decoded`, the ids are decoded again at once, which saves moving them twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                texts = part.column(1).to_pylist()
                for a, b in _chunks([len(t) for t in texts], CHUNK_CHARS):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), *_encoded(words, texts[a:b], decoded)], schema.names)

    rows = docs.select(id_col, body(text_col).alias("_text"))
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([rows.schema[id_col], T.StructField("ids", ints), T.StructField("offsets", ints)])
    if decoded:
        schema = schema.add("decoded", T.BinaryType())
    return rows.mapInArrow(run, schema)


def _encoded(words: Vocabulary, texts: list[str], decoded: bool) -> list[pa.Array]:
    ids, counts = words.encode(texts)
    lengths = words.lengths[ids]
    places = np.concatenate(([0], np.cumsum(lengths)))
    base = places[np.cumsum(counts) - counts]
    out = [_lists(ids, counts), _lists(places[:-1] - np.repeat(base, counts), counts)]
    if decoded:
        together, ends = words.decode(ids, places[:-1]), places[np.cumsum(counts)]
        out.append(pa.array([together[a:b] for a, b in zip(base.tolist(), ends.tolist())], pa.binary()))
    return out


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", offsets_col: str = "offsets", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the tokens; offsets may start anywhere, so slices of a text decode too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids, offsets = batch.column(batch.schema.get_field_index(ids_col)), batch.column(batch.schema.get_field_index(offsets_col))
            done = []
            for i in range(batch.num_rows):
                own = ids[i].values.to_numpy() if ids[i].is_valid else np.empty(0, np.int32)
                at = offsets[i].values.to_numpy().astype(np.int64) if len(own) else np.empty(0, np.int64)
                done.append(words.decode(own, at - at[0]) if len(own) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], [*batch.schema.names, out])

    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: n_tokens, ids_sha256 and decoded_sha256, the last from decoding the ids."""
    both = encode(docs, path, id_col, text_col, decoded=True)
    told = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(told.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
