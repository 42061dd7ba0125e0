"""Periodic runs of words, found with a difference cover and a harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least `min_powers`
periods and `min_length` words long, that no neighbouring word extends.

For every period q the places 0, q, 2q, ... of a text form a grid, q/1 + q/2 + ... places in
all.  A run of period q holds at least two neighbouring grid places whose common extension
is long, so extensions of grid neighbours find every run.  An extension compares words only
up to the next pair of places that both lie in a difference cover; from there it is the
minimum of common prefixes between two ranks, which a sparse table answers.  Only suffixes
at places of the cover are sorted, and only in texts where a comparison gets that far.

Texts are joined into one sequence with an own end mark each, so a task works on many short
texts in one array; no text is cut.  Memory is linear in the longest text (about 60 bytes a
word) plus a fixed number of grid places at a time.

Defined results: a null or empty text has no words and no runs; repeated rows are worked
out each on its own; a null id is an id like any other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import body

MIN_LENGTH, MIN_POWERS = 6, 4
# A perfect difference set: every distance below 31 is a difference of two members.
COVER_SIZE = 31
COVER = (1, 5, 11, 24, 25, 27)
# Words of short texts that share one array, and grid places compared at a time.
BATCH_WORDS = 60_000
GRID_PLACES = 1_000_000


def _meeting_table() -> np.ndarray:
    """Steps from places of residue a and b until both lie in the cover."""
    member = np.isin(np.arange(2 * COVER_SIZE) % COVER_SIZE, COVER)
    a, b, step = np.ogrid[:COVER_SIZE, :COVER_SIZE, :COVER_SIZE]
    return (member[(a + step) % COVER_SIZE] & member[(b + step) % COVER_SIZE]).argmax(axis=2)


_MEETING = _meeting_table()


@dataclass(frozen=True)
class Sequence:
    """Word numbers of many texts: text t fills start[t] up to start[t + 1] - 1, where its end mark stands."""
    words: np.ndarray
    start: np.ndarray
    text_of: np.ndarray


class Extensions:
    """Lengths of common extensions to the right of pairs of places in one text."""

    def __init__(self, words: np.ndarray, text_of: np.ndarray):
        self.words, self.text_of = words, text_of
        self.sorted_texts: np.ndarray | None = None

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from places a and b on; a < b, in the same text."""
        steps = _MEETING[a % COVER_SIZE, b % COVER_SIZE]
        length, active = self._compare(a, b, steps)
        if len(active):
            near, far = (a + steps)[active], (b + steps)[active]
            self._prepare(np.unique(self.text_of[near]))
            length[active] += self._between(near, far)
        return length

    def _compare(self, a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words within the first `steps`, and which pairs agree in all of them."""
        length = np.zeros(len(a), np.int64)
        active, agreed = np.arange(len(a)), []
        for step in range(COVER_SIZE + 1):
            done = steps[active] == step
            if done.any():
                agreed.append(active[done])
                active = active[~done]
            active = active[self.words[a[active] + step] == self.words[b[active] + step]]
            if not len(active):
                break
            length[active] += 1
        return length, np.concatenate(agreed) if agreed else active[:0]

    def _prepare(self, texts: np.ndarray) -> None:
        """Sorted cover suffixes of these texts, their common prefixes and the sparse table over them."""
        if self.sorted_texts is not None:
            if np.isin(texts, self.sorted_texts).all():
                return
            texts = np.union1d(texts, self.sorted_texts)
        self.sorted_texts = texts
        chosen = np.zeros(int(self.text_of.max()) + 1, bool)
        chosen[texts] = True
        places = np.flatnonzero(np.isin(np.arange(COVER_SIZE), COVER)[np.arange(len(self.words)) % COVER_SIZE] & chosen[self.text_of])
        number = np.full(len(self.words), -1, np.int64)
        number[places] = np.arange(len(places))
        order, levels = self._sort(places, number)
        self.rank = np.full(len(self.words), -1, np.int64)
        self.rank[places[order]] = np.arange(len(places))
        self.table = self._sparse_table(self._prefixes(places[order], number, levels))

    def _sort(self, places: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Order of the suffixes at the places, and group ranks at depth COVER_SIZE, twice that and so on.

        Groups of suffixes that agree so far are split by the next word; from the size of the
        cover on by the rank of the suffix that far ahead, which lies in the cover too.  Suffixes
        of different texts never agree, so the words read stay inside a text and its end mark.
        """
        order = np.argsort(self.text_of[places], kind="stable")
        rank = self._group_starts(self.text_of[places][order], np.arange(len(order)))
        of = np.empty(len(order), np.int64)
        of[order] = rank
        active, depth, levels = np.arange(len(order)), 0, []
        while len(active):
            if depth < COVER_SIZE:
                key = self.words[places[order[active]] + depth].astype(np.int64)
            else:
                levels.append((depth, of.copy()))
                key = of[number[places[order[active]] + depth]]
            group = of[order[active]]
            inner = np.lexsort((key, group))
            order[active] = order[active][inner]
            group, key = group[inner], key[inner]
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            starts = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
            of[order[active]] = starts
            single = fresh & np.concatenate([fresh[1:], [True]])
            active = active[~single]
            depth = depth + 1 if depth < COVER_SIZE else 2 * depth
        return order, levels

    @staticmethod
    def _group_starts(values: np.ndarray, index: np.ndarray) -> np.ndarray:
        fresh = np.concatenate([[True], values[1:] != values[:-1]])
        return np.maximum.accumulate(np.where(fresh, index, 0))

    def _prefixes(self, suffixes: np.ndarray, number: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common words of each sorted suffix and the next one; 0 where they belong to different texts."""
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        length = np.zeros(len(a), np.int64)
        same = np.flatnonzero(self.text_of[a] == self.text_of[b])
        for depth, of in reversed(levels):
            equal = same[of[number[a[same]]] == of[number[b[same]]]]
            for side in (a, b, length):
                side[equal] += depth
        while len(same):
            same = same[self.words[a[same]] == self.words[b[same]]]
            for side in (a, b, length):
                side[same] += 1
        return length

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        """Row k holds the minimum of 2 ** k values from each place on."""
        rows, width = [values], 1
        while 2 * width <= len(values):
            rows.append(np.minimum(rows[-1][:-width], rows[-1][width:]))
            width *= 2
        return rows

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of suffixes at two places of the cover."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            found[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << int(k))])
        return found


def sequence(texts: list[list[bytes]]) -> Sequence:
    """One number per different word and an end mark of its own behind each text."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(lengths + 1)])
    words = np.empty(start[-1], np.int32)
    for i, text in enumerate(texts):
        words[start[i]:start[i + 1] - 1] = [numbers.setdefault(w, len(numbers)) for w in text]
    words[start[1:] - 1] = len(numbers) + np.arange(len(texts))
    return Sequence(words, start, np.repeat(np.arange(len(texts)), lengths + 1))


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_powers: int = MIN_POWERS) -> list[list[tuple[int, int, int]]]:
    """Per text its runs as (start, length, period), by start and period; min_powers is 3 at least."""
    both = sequence(texts)
    lengths = np.diff(both.start) - 1
    n = len(both.words)
    ahead = Extensions(both.words, both.text_of)
    # Read backwards; the mark in front of a text now ends it, so it belongs to that text.
    back = Extensions(np.concatenate([both.words[::-1], [-1]]), np.concatenate([both.text_of, both.text_of[-1:]])[::-1])
    # One grid per text and period: a run with `min_powers` periods leaves at least two of them behind its first grid place.
    periods = lengths // min_powers
    text = np.repeat(np.arange(len(texts)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = lengths[text] // period - (min_powers - 2)
    ends = np.cumsum(places)
    found: list[tuple[np.ndarray, ...]] = []
    done, first = 0, 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, done + GRID_PLACES, "right")))
        own = slice(first, last)
        q = np.repeat(period[own], places[own])
        k = np.arange(len(q)) - np.repeat(ends[own] - places[own] - done, places[own])
        a = both.start[np.repeat(text[own], places[own])] + k * q
        common = ahead.query(a, a + q)
        # The first grid place of a run: the one before it, if any, does not reach here.
        opens = np.concatenate([[True], common[:-1] < q[:-1]]) | (k == 0)
        hit = np.flatnonzero(opens & (common >= (min_powers - 2) * q))
        if len(hit):
            a, q, common = a[hit], q[hit], common[hit]
            before = back.query(n - a - q, n - a)
            size = before + q + common
            keep = size >= np.maximum(min_length, min_powers * q)
            found.append((a[keep] - before[keep], size[keep], q[keep]))
        done, first = int(ends[last - 1]), last
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        begin, size, q = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((q, size, begin))
        begin, size, q = begin[order], size[order], q[order]
        # Multiples of the smallest period give the same stretch again.
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (begin[1:] != begin[:-1]) | (size[1:] != size[:-1])
        begin, size, q = begin[fresh], size[fresh], q[fresh]
        owner = both.text_of[begin]
        order = np.lexsort((q, begin))
        for t, s, length, p in zip(*(x[order].tolist() for x in (owner, begin - both.start[owner], size, q)), strict=True):
            runs[t].append((s, length, p))
    return runs


def collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return text
    edge = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [text[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_powers: int = MIN_POWERS) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start and period) and the collapsed text.

    Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and
    carriage return, numbered from 0; the collapsed text has its kept words joined by one blank.
    """
    if min_powers < 3:
        raise ValueError("a grid finds runs of three periods and more")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def out(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(texts, min_length, min_powers)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
        kept = [b" ".join(collapse(t, r)).decode() for t, r in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, run_type), pa.array(kept, pa.string())],
            [id_col, "n_words", "runs", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[bytes]] = []
            first, words = 0, 0
            for i, value in enumerate(batch.column(1)):
                # Splitting bytes knows exactly the six white space characters.
                texts.append(value.as_py().encode().split())
                words += len(texts[-1])
                if words >= BATCH_WORDS or i == batch.num_rows - 1:
                    yield out(batch.column(0).slice(first, len(texts)), texts)
                    texts, first, words = [], i + 1, 0

    rows = docs.select(id_col, body(text_col).alias("_text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
                           T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(work, schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count, strongest run and hashes of what periodic_runs returns."""
    def field(name: str) -> Column:
        return F.get("_best", F.lit(0))[name]

    def stronger(x: Column, y: Column) -> Column:
        """Greatest length / period first, without rounding; then smallest start, then smallest period."""
        gap = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(gap != 0, F.signum(gap).cast("int")).when(
            x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", F.array_sort("runs", stronger))
    return best.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), field("start").alias("start"), field("length").alias("length"),
        field("period").alias("period"), F.floor(1000 * field("length") / field("period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text) in which the ids themselves choose one document in ten whose rest repeats a stretch of words.

    With h the CRC-32 of the decimal id and g = h div 10, a document of n > 0 words with h divisible
    by 10 goes on from word a = g mod n with the period 1 + (n - a) div (3 + g mod 8).  A row
    without an id is left as it is.
    """
    n, g = F.size("_words"), F.floor(F.col("_hash") / 10)
    rows = docs.select(id_col, body(text_col).alias("_text")).withColumn("_hash", F.crc32(F.col(id_col).cast("string").cast("binary")))
    rows = rows.withColumn("_words", F.when(F.col("_hash") % 10 == 0, F.filter(F.split("_text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")))
    rows = rows.withColumn("_from", (g % F.greatest(n, F.lit(1))).cast("int"))
    rows = rows.withColumn("_period", (1 + F.floor((n - F.col("_from")) / (3 + g % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(i < F.col("_from"), i).otherwise(
        F.col("_from") + (i - F.col("_from")) % F.col("_period"))))
    return rows.select(id_col, F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("_text")).alias(text_col))
