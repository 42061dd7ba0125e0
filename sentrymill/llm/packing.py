"""Packing of tokenised documents into sequences of fixed size by length patterns.

Only lengths matter for packing, so the driver sees one thing: how many pieces have
each length, at most `size` numbers.  Patterns of two to four lengths that fill a
sequence exactly are enumerated, non-negative least squares fits their repeat
counts to the histogram, the counts are rounded down, and the residual lengths are
packed best fit, longest first, by counts.  The result is a list of patterns with
repeat counts; each piece finds its place from its length and its rank in it.

Ranks are row numbers inside cells of a length plus the offset of the cell, so a
length that a third of all pieces have is spread over many tasks.

Defined results: a null text counts as empty and gives one piece, the end id;
repeated rows are packed each on its own; a null id is an id like any other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import body
from sentrymill.operators.spread import staged

SIZE = 2048
END_ID = 0
CACHE_SIZE = 300_000
CELLS = 64
NNLS_ROUNDS = 200
_MARK = "\x02"
_WORD = re.compile("[^ \t\n\x0b\f\r]+")
# In texts of ASCII and precomposed Latin letters alone nothing joins across the edges of a run of letters, so runs
# are looked up instead of words: there are fewer different ones.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_OTHER_SIGN = re.compile(f"[^\x00-\x7f{_LATIN}]")
_RUN = re.compile(f"[a-z{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\x0b\f\ra-z0-9{_LATIN}]+")

Pattern = tuple[int, ...]


def lookups(text: str) -> list[str]:
    """Parts of a text whose ids in a row are the ids of the text: the tokenizer never joins across white space."""
    return _WORD.findall(text) if _OTHER_SIGN.search(text) else _RUN.findall(text.lower())


class WordTokens:
    """Ids of whole texts, each different part tokenized once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # Strings that the tokenizer takes as one token wherever they stand, across the edges of words too.
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Ids of new words, many in one call: a control sign that no word holds stands between them."""
        plain = [w for w in new if _MARK not in w]
        for start in range(0, len(plain), 1000):
            own = plain[start:start + 1000]
            ids = np.array([*self.tokenizer.encode_batch_fast([f" {_MARK} ".join(own)], add_special_tokens=False)[0].ids, *self.mark], "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            blob, begin = ids.tobytes(), 0
            for word, end in zip(own, (4 * ends).tolist(), strict=True):
                self.cache[word] = blob[begin:end]
                begin = end + 4
        for word in set(new).difference(plain):
            self.cache[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        whole = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                 for i, t in enumerate(texts) if self.special.search(t)}
        split = [[] if i in whole else lookups(t) for i, t in enumerate(texts)]
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        self.learn(list(set().union(*split).difference(self.cache)))
        get = self.cache.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, words)) for i, words in enumerate(split)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker and file."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids.

    Only documents longer than `size` are cut; each document ends with END_ID.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                row, piece, length, crc, ids = [], [], [], [], []
                for i, blob in enumerate(words.encode(part.column(1).to_pylist())):
                    blob += end
                    for k in range(0, len(blob), 4 * size):
                        own = blob[k:k + 4 * size]
                        row.append(i)
                        piece.append(k // (4 * size))
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        ids.append(np.frombuffer(own, "<u4"))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array([p * size for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = docs.select(id_col, body(text_col).alias("_text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def enumerate_patterns(histogram: np.ndarray, size: int) -> list[Pattern]:
    """Two, three and four lengths that occur and fill a sequence exactly."""
    here = np.flatnonzero(histogram[:size])
    found = {(int(size - a), int(a)) for a in here if histogram[size - a]}
    step = max(1, size // 48)
    for a in here.tolist():
        for b in range(max(1, a % step), size - a, step):
            c = size - a - b
            if histogram[b] and histogram[c]:
                found.add(tuple(sorted((a, b, c), reverse=True)))
        for b in range(max(1, a % step), (size - a) // 2, 3 * step):
            c = (size - a - b) // 2
            d = size - a - b - c
            if c > 0 and histogram[b] and histogram[c] and histogram[d]:
                found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[Pattern], histogram: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum of x times pattern near the histogram in least squares.

    Multiplicative updates keep every count non-negative.
    """
    if not patterns:
        return np.zeros(0)
    which = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.concatenate([np.array(p) for p in patterns])
    wanted = np.bincount(which, histogram[length].astype(float))
    x = wanted / np.bincount(which, np.bincount(length, minlength=len(histogram))[length])
    for _ in range(rounds):
        made = np.bincount(length, x[which], len(histogram))
        x *= wanted / np.maximum(np.bincount(which, made[length]), 1e-12)
    return x


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over counts: bins of equal room are handled together."""
    room: list[list[tuple[Pattern, int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        left, free = int(histogram[length]), length
        while left:
            while free <= size and not room[free]:
                free += 1
            if free > size:
                each = size // length
                whole, rest = divmod(left, each)
                if whole:
                    room[size - each * length].append(((length,) * each, whole))
                if rest:
                    room[size - rest * length].append(((length,) * rest, 1))
                break
            pattern, count = room[free].pop()
            used = min(left, count)
            if used < count:
                room[free].append((pattern, count - used))
            room[free - length].append(((*pattern, length), used))
            left -= used
            free = min(free, max(free - length, length))
    return [entry for entries in room for entry in entries]


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[Pattern, int]]:
    """Patterns with repeat counts that use every piece exactly once."""
    left = histogram.astype(np.int64).copy()
    patterns = enumerate_patterns(left, size)
    counts = fit_counts(patterns, left)
    chosen = []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 1:
            break
        lengths, times = np.unique(np.array(patterns[i]), return_counts=True)
        repeat = int(min(counts[i], (left[lengths] // times).min()))
        if repeat:
            left[lengths] -= repeat * times
            chosen.append((patterns[i], repeat))
    return chosen + best_fit(left, size)


class Places:
    """Slots of a plan by length and rank: sequence and offset of every piece."""

    def __init__(self, chosen: list[tuple[Pattern, int]]):
        used: dict[int, int] = {}
        slots, sequence = [], 0
        for pattern, count in chosen:
            offset = 0
            for length in pattern:
                slots.append(((length << 40) + used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + count
                offset += length
            sequence += count
        slots.sort()
        self.starts, self.sequences, self.offsets = (np.array([s[k] for s in slots], np.int64) for k in range(3))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 40) + rank
        slot = np.searchsorted(self.starts, key, "right") - 1
        return self.sequences[slot] + key - self.starts[slot], self.offsets[slot]


def pack(pieces: DataFrame, id_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ids_crc32, ...)."""
    counted = pieces.groupBy("length").count().collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for length, count in counted:
        histogram[length] = count
    places = Places(plan(histogram, size))
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64(id_col, "piece"), F.lit(CELLS)).cast("int"))
    held = dealt.groupBy("length", "_cell").count()
    before = held.select("length", "_cell", (F.sum("count").over(
        Window.partitionBy("length").orderBy("_cell")) - F.col("count")).alias("_before"))  # at most CELLS rows each
    place = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(id_col, "piece", "ids_crc32"))
    ranked = dealt.withColumn("_place", place).join(before, ["length", "_cell"]).select(
        *pieces.columns, (F.col("_before") + F.col("_place") - 1).cast("bigint").alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = places.find(length, rank) if batch.num_rows else (length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema.names)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of docs: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(token_pieces(docs, path, size, id_col, text_col), "pack_pieces"), id_col, size)


def sequences(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences: sequence_id and at most `size` ids."""
    packed = pack(staged(token_pieces(docs, path, size, id_col, text_col, with_ids=True), "pack_pieces"), id_col, size)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # bounded: the ids of one sequence
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
