"""Quality rules as weak supervision: rules vote or abstain and EM weighs them.

Each rule votes 1 (good), -1 (bad) or 0 (abstains); most can only vote bad, since a
text without one fault may have another.  The votes of all documents
are counted by pattern, expectation-maximisation over these counts estimates how
accurate each rule is, and a document is kept if the posterior
probability of being good reaches the threshold.

The table of patterns has at most 3 ** len(RULES) rows, whatever the input, so
its way to the driver is bounded.

Defined results: a null text has no words; a text with no words fails the base
rule; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import SPACES, bind, body
from sentrymill.operators.spread import staged

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
EM_ROUNDS = 50
THRESHOLD = 0.5


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(at: str = "") -> dict[str, Column]:
    """Votes over counts; `at` is the prefix of their columns."""
    def count(name: str) -> Column:
        return F.col(f"{at}{name}")

    words, many = count("n_words"), count("n_words") >= MIN_WORDS
    mean_word, symbols = _share(count("word_chars"), words), _share(count("n_symbols"), words)
    dup_lines, repeats = _share(count("n_dup_lines"), count("n_lines")), _share(count("n_repeat_words"), words)
    unique, ends = _share(count("n_distinct_words"), words), _share(count("n_ended_lines"), count("n_lines"))
    prose = (many & mean_word.between(3.5, 7) & (symbols < 0.05) & (dup_lines < 0.1) & (repeats < 0.2) & (unique > 0.4)
             & (ends > 0.7))
    return {
        "prose": _vote(prose, F.lit(False)),
        "length": _vote(F.lit(False), words < 20),
        "word_length": _vote(F.lit(False), (mean_word < 2.5) | (mean_word > 12)),
        "symbols": _vote(F.lit(False), symbols > 0.1),
        "line_repeats": _vote(F.lit(False), dup_lines > 0.5),
        "phrase_repeats": _vote(F.lit(False), repeats > 0.5),
        "variety": _vote(F.lit(False), many & (unique < 0.2)),
        "line_ends": _vote(F.lit(False), ends < 0.1),
    }


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice.

    A window becomes one number: its hash above, its position below, so that a
    sort of plain numbers brings equal windows together.  Rows that agree are
    checked again with a second hash.
    """
    def packed(seed: int, windows: Column, positions: Column, bits: Column) -> Column:
        return F.sort_array(F.transform(positions, lambda p: F.call_function(
            "shiftleft", F.xxhash64(F.lit(seed), F.get(windows, p)), bits).bitwiseOR(p.cast("bigint"))))

    def repeated(numbers: Column, bits: Column) -> Column:
        def high(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        return bind(numbers, lambda s: F.transform(
            F.filter(s, lambda x, i: (high(x) == high(F.get(s, i - 1))) | (high(x) == high(F.get(s, i + 1)))),
            lambda x: x.bitwiseAND(mask).cast("int")))

    def covered(positions: Column) -> Column:
        return bind(F.sort_array(positions), lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.coalesce(F.get(s, i + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0).cast("bigint"), lambda total, x: total + x))

    def of(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(
            " ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        bits = F.ceil(F.log2(F.size(words).cast("double"))).cast("int")
        return bind(windows, lambda w: bind(bits, lambda b: bind(
            repeated(packed(1, w, F.sequence(F.lit(0), F.size(w) - 1), b), b),
            lambda found: F.when(F.size(found) == 0, F.lit(0).cast("bigint")).otherwise(
                covered(repeated(packed(2, w, found, b), b))))))

    return bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(of(w)))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct `_quality`: counts over the whole text, made while scanning, without a shuffle."""
    text = body(text_col)
    rows = docs.withColumn("_quality_text", text).withColumns({
        "_quality_words": F.filter(F.split("_quality_text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != ""),
        "_quality_lines": F.filter(F.split("_quality_text", "\n"), lambda x: F.translate(x, SPACES, "") != "")})
    text, words, lines = F.col("_quality_text"), F.col("_quality_words"), F.col("_quality_lines")
    ended = F.filter(lines, lambda x: F.rtrim(F.translate(x, SPACES, " " * len(SPACES))).rlike("[.!?\"”»]$"))
    counts = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(ended).cast("bigint").alias("n_ended_lines"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct_words"),
        _repeat_words(words).alias("n_repeat_words"))
    return rows.withColumn("_quality", counts).drop("_quality_text", "_quality_words", "_quality_lines")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document, one column each."""
    return with_features(docs.select(id_col, text_col), text_col).select(id_col, "_quality.*")


@dataclass(frozen=True)
class Weights:
    """Log odds of a good document: `bias` plus, per rule, the weight of its vote (1 or -1)."""
    bias: float
    said: dict[tuple[str, int], float]
    accuracy: dict[str, float]

    def log_odds(self, votes: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for name, vote in votes.items():
            total = total + F.when(vote == 1, self.said[name, 1]).when(vote == -1, self.said[name, -1]).otherwise(0.0)
        return total


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = EM_ROUNDS) -> Weights:
    """EM for rules that speak independently given the class.

    Each rule has a chance of voting good, of abstaining and of voting bad in either
    class; an abstention itself is no evidence.  The start takes nine of ten votes as right and four of five documents as
    good; a pseudo-count per cell keeps chances off 0 and 1.  The accuracy of a rule is
    the share of its votes that the fitted classes confirm.
    """
    classes, saying, n = (1, -1), (1, 0, -1), sum(c for _, c in patterns)
    prior = 0.8
    chance = {(r, v, y): {y: 0.45, 0: 0.5, -y: 0.05}[v] for r in range(len(names)) for v in saying for y in classes}
    right, cast = [0.0] * len(names), [0.0] * len(names)
    for _ in range(rounds if n else 0):
        mass, cells = dict.fromkeys(classes, 0.0), dict.fromkeys(chance, 0.5)
        right, cast = [0.0] * len(names), [0.0] * len(names)
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(chance[r, v, 1] / chance[r, v, -1]) for r, v in enumerate(votes) if v)
            good = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            for y, share in ((1, good), (-1, 1 - good)):
                mass[y] += share * count
                for r, v in enumerate(votes):
                    cells[r, v, y] += share * count
                    cast[r] += share * count * (v != 0)
                    right[r] += share * count * (v == y)
        prior = (mass[1] + 1) / (n + 2)
        total = {(r, y): sum(cells[r, v, y] for v in saying) for r in range(len(names)) for y in classes}
        chance = {(r, v, y): cells[r, v, y] / total[r, y] for r, v, y in chance}
    said = {(x, v): math.log(chance[r, v, 1] / chance[r, v, -1]) for r, x in enumerate(names) for v in classes}
    return Weights(math.log(prior / (1 - prior)), said,
                   {x: (right[r] + 0.5) / (cast[r] + 1) for r, x in enumerate(names)})


def estimate(counted: DataFrame) -> Weights:
    """EM over the vote patterns of all documents."""
    votes = {k: v.alias(k) for k, v in rules().items()}
    seen = counted.select(*votes.values()).groupBy(*votes).count().collect()  # at most 3 ** len(votes) rows
    return fit(sorted((tuple(row[:-1]), row[-1]) for row in seen), list(votes))


def verdict(weights: Weights, threshold: float = THRESHOLD, at: str = "") -> dict[str, Column]:
    """base_failed, p_good and kept over counts; `at` is the prefix of their columns."""
    words = F.col(f"{at}n_words")
    failed = (words < MIN_WORDS) | (100 * F.col(f"{at}n_repeat_words") > 50 * words)
    good = 1 / (1 + F.exp(-weights.log_odds(rules(at))))
    return {"base_failed": failed, "p_good": good, "kept": ~failed & (good >= threshold)}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base rule, posterior and verdict for every row of docs."""
    counted = staged(features(docs, id_col, text_col), "quality_features")
    return counted.withColumns(verdict(estimate(counted), threshold))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The verdict needs only the row and the weights, so texts are scanned twice and never shuffled.
    """
    weights = estimate(features(docs, id_col, text_col))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))  # so that no name can clash
    return with_features(rows).filter(verdict(weights, threshold, "_quality.")["kept"]).select("row.*")
