"""Log-likelihood of whole documents under a recurrent language model that the corpus itself trains.

1. Words of all training documents are counted.  Those that make more than one token in HEAD
   (so fewer than HEAD words) go to every task; the most frequent are the words of the model,
   all others are UNKNOWN to it, followed by their own add-one chance among the unknown.
2. Documents become token numbers once.  Words outside the head stay words and meet their
   counts in a join, summed per document; no such word is frequent in the training documents.
3. All training tokens are dealt by hash to shares of about SHARE tokens.  In each of ROUNDS
   rounds every share of that round is one pass of truncated backpropagation from the same
   parameters, and the results are averaged by tokens, FAN at a time (gru.py).  The number of
   shares grows with the corpus, what a task holds and what the driver gets does not.
4. Every document is scored as one sequence from its first to its last token, the state
   carried across windows.

Defined results: a null or empty text is its end token alone; a document without an id trains
(its id counts as empty text); repeated rows count and are scored each; with no training
document every word is unknown; other columns are not read; an empty table gives an empty
result.  A document is scored in one task, at a speed that does not depend on others only if
it has fewer than about CHUNK / gru.LANES tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm import gru
from sentrymill.llm.common import body
from sentrymill.operators.spread import staged

HEAD = 500_000
ROUNDS, SHARE, PIECE = 3, 1_000_000, 65_536
RATE_DECAY = 0.6
FAN = 64
SLICE = 8192
CHUNK = 3_000_000
END_WORD = ""
HELD_OUT = (7, 2)
_FLUSH_WORDS = 300_000


def held_out(doc_id: Column) -> Column:
    every, remainder = HELD_OUT
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % every == remainder


def _tokens(text: str) -> list[bytes]:
    """Words in lower case: bytes know ASCII letters and white space only."""
    return text.encode().lower().split()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; END_WORD counts the documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(_tokens(text.as_py()))
                if len(seen) > _FLUSH_WORDS:
                    yield out()
                    seen = Counter()
            seen[b""] += batch.num_rows
        yield out()

    rows = docs.select(body(text_col).alias("_text")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


@dataclass(frozen=True)
class Lexicon:
    """The head of the counted words and totals over all of them."""
    words: list[str]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int

    @property
    def modelled(self) -> int:
        """Words of the head that have a number of their own in the model."""
        return min(len(self.words), gru.VOCABULARY - 2)

    @property
    def unknown(self) -> tuple[int, int]:
        """Training tokens and different words that the model does not know."""
        known = int(self.counts[:self.modelled].sum()) + self.ends
        return self.tokens - known, self.distinct - self.modelled - (self.ends > 0)

    def model_counts(self) -> np.ndarray:
        """Training tokens by token number; UNKNOWN counts one more, for words that are still to come."""
        out = np.zeros(gru.VOCABULARY)
        out[gru.END], out[gru.UNKNOWN] = max(self.ends, 1), self.unknown[0] + 1
        out[2:2 + self.modelled] = self.counts[:self.modelled]
        return out


def lexicon(counted: DataFrame, head: int = HEAD) -> Lexicon:
    total = counted.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END_WORD, F.col("n")))).first()
    # Fewer than `head` rows: each is more than one in `head` of all tokens.
    first = counted.filter((F.col("word") != END_WORD) & (F.col("n") * head > (total[0] or 0))).collect()
    first.sort(key=lambda r: (-r["n"], r["word"]))
    return Lexicon([r["word"] for r in first], np.array([r["n"] for r in first], np.int64), total[2] or 0, total[0] or 0, total[1])


def numbered(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its token numbers, what the head words add to the scores, and its other words, joined by blanks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w.encode(): i for i, w in enumerate(lex.words)}
        logs = np.append(np.log10(lex.counts + 1.0), 0.0)
        end_log = math.log10(lex.ends + 1.0)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [_tokens(t) for t in batch.column(2).to_pylist()]
                lengths = np.array([len(t) for t in texts], np.int64)
                ranks = np.fromiter(map(place.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(lengths.sum()))
                edges = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                numbers = np.where((ranks >= 0) & (ranks < lex.modelled), ranks + 2, gru.UNKNOWN).astype(np.uint16)
                found, of_unknown = logs[ranks], np.where(numbers == gru.UNKNOWN, logs[ranks], 0.0)
                ids, sums, unknown_sums, n_head, n_unknown, rare = [], [], [], [], [], []
                for text, low, high in zip(texts, edges, edges[1:]):
                    own = numbers[low:high]
                    ids.append(np.append(own, np.uint16(gru.END)).tobytes())
                    sums.append(float(found[low:high].sum()) + end_log)
                    unknown_sums.append(float(of_unknown[low:high].sum()))
                    missing = np.flatnonzero(ranks[low:high] < 0).tolist()
                    n_head.append(high - low - len(missing) + (lex.ends > 0))
                    n_unknown.append(int((own == gru.UNKNOWN).sum()))
                    rare.append(b" ".join([text[i] for i in missing]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(lengths + 1), pa.array(ids, pa.binary()), pa.array(n_head, pa.int64()),
                     pa.array(n_unknown, pa.int64()), pa.array(sums, pa.float64()), pa.array(unknown_sums, pa.float64()),
                     pa.array(rare, pa.string())], schema.names)

    rows = docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), body(text_col).alias("_text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("held_out", T.BooleanType())]).add("n_tokens", "long").add("ids", "binary").add(
        "n_head", "long").add("n_unknown", "long").add("head_log", "double").add("unknown_log", "double").add(
        "rare", "string")
    return rows.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id())


def shares(rows: DataFrame, tokens: int, id_col: str = "doc_id", share: int = SHARE, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(worker, round, ids): all training tokens, dealt by hash in pieces, and the number of workers."""
    workers = max(1, math.ceil(tokens / (share * rounds)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, ids = [], [], []
            for i, blob in enumerate(batch.column(1).to_pylist()):
                for k in range(0, len(blob), 2 * PIECE):
                    at.append(batch.column(0)[i].as_py())
                    piece.append(k // (2 * PIECE))
                    ids.append(blob[k:k + 2 * PIECE])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(piece, pa.int32()), pa.array(ids, pa.binary())], ["key", "piece", "ids"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("ids", "ascending")])
        return pa.table({"share": group["share"][:1], "ids": pa.array([b"".join(group["ids"].to_pylist())], pa.binary())})

    key = F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.col("row")))
    pieces = rows.filter("NOT held_out").select(key.alias("key"), "ids").mapInArrow(cut, "key bigint, piece int, ids binary")
    order = F.xxhash64("key", "piece")
    dealt = pieces.select(F.pmod(order, F.lit(workers * rounds)).cast("int").alias("share"), order.alias("order"), "ids")
    joined = dealt.groupBy("share").applyInArrow(join, "share int, ids binary")
    cut_at = F.col("share")
    return joined.select((cut_at / rounds).cast("int").alias("worker"), (cut_at % rounds).alias("round"), "ids"), workers


def _averaged(parts: DataFrame, workers: int) -> DataFrame:
    """Mean of the parameters (worker, slice, values, tokens) by tokens, FAN workers at a time."""
    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("worker")
        weights = np.array(group["tokens"].to_pylist(), np.float64)
        values = np.stack([np.frombuffer(v, np.float32) for v in group["values"].to_pylist()])
        found = (weights @ values / weights.sum()).astype(np.float32)
        return pa.table({"worker": pa.array([group["worker"][0].as_py() // FAN], pa.int32()), "slice": group["slice"][:1],
                         "values": pa.array([found.tobytes()], pa.binary()), "tokens": pa.array([int(weights.sum())], pa.int64())})

    while workers > 1:
        workers = math.ceil(workers / FAN)
        parts = parts.groupBy("slice", (F.col("worker") / FAN).cast("int").alias("team")).applyInArrow(mean, parts.schema)
    return parts


def train(shared: DataFrame, workers: int, flat: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after `rounds` rounds; the driver gets one set of them per round."""
    schema = "worker int, slice int, values binary, tokens bigint"
    for turn in range(rounds):
        def work(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, rate: float = gru.RATE * RATE_DECAY ** turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    tokens = np.frombuffer(batch.column(1)[i].as_py(), np.uint16)
                    found = gru.train(flat, tokens, rate=rate)
                    parts = [found[k:k + SLICE].tobytes() for k in range(0, len(found), SLICE)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()),
                         pa.array(parts, pa.binary()), pa.array([len(tokens)] * len(parts), pa.int64())], ["worker", "slice", "values", "tokens"])

        own = shared.filter(F.col("round") == turn).select("worker", "ids").repartition(workers, "worker").mapInArrow(work, schema)
        slices = _averaged(own, workers).select("slice", "values").orderBy("slice").collect()
        if slices:
            flat = np.frombuffer(b"".join(r["values"] for r in slices), np.float32)
    return flat


def score_rows(rows: DataFrame, flat: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """rows with `model_log` instead of the token numbers: log10 of the chance of the token numbers."""
    names = [c for c in rows.columns if c != "ids"]
    schema = T.StructType([rows.schema[c] for c in names]).add("model_log", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            logs = gru.score(flat, texts) / math.log(10)
            done = pa.Table.from_batches(held).combine_chunks().append_column("model_log", pa.array(logs, pa.float64()))
            return done.to_batches()[0]

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts += [np.frombuffer(x, np.uint16) for x in batch.column(len(names)).to_pylist()]
                held.append(batch.select(names))
                total += sum(map(len, texts[-batch.num_rows:]))
                if total >= chunk:
                    yield out()
                    held, texts, total = [], [], 0
        if held:
            yield out()

    return rows.select(*names, "ids").mapInArrow(work, schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, share: int = SHARE,
              rounds: int = ROUNDS) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model), as log10."""
    counted = staged(count_words(docs.filter(~held_out(F.col(id_col))), text_col), "lm_counts")
    lex = lexicon(counted, head)
    rows = staged(numbered(docs, lex, id_col, text_col), "lm_tokens")
    dealt, workers = shares(rows, lex.tokens, id_col, share, rounds)
    flat = train(staged(dealt, "lm_shares"), workers, gru.initial(lex.model_counts()), rounds)
    seldom = rows.filter("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word"))
    rare = seldom.join(counted, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count("*").alias("n_rare"))
    scored = score_rows(rows.select("row", id_col, "held_out", "n_tokens", "n_head", "n_unknown", "head_log", "unknown_log", "ids"), flat)
    both = scored.join(rare, "row", "left").withColumns({"rare_log": F.coalesce("rare_log", F.lit(0.0)), "n_rare": F.coalesce("n_rare", F.lit(0))})
    tokens_unknown, words_unknown = lex.unknown
    return both.select(
        id_col, "held_out", "n_tokens", (F.col("n_head") + F.col("n_rare")).alias("n_known"), F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_log") + F.col("rare_log") - F.col("n_tokens") * math.log10(lex.tokens + lex.distinct + 1)).alias("base_score"),
        (F.col("model_log") + F.col("unknown_log") + F.col("rare_log")
         - F.col("n_unknown") * math.log10(tokens_unknown + words_unknown + 1)).alias("score"))
