"""Spelling variants: words within one edit, found through an index of variable-length grams.

1. Words are counted, and those that are long and frequent enough are the vocabulary.
2. A dictionary of grams is pruned by frequency (gram_index.py) and sent to every task;
   at most MAX_GRAMS grams and all two-letter ones, the limit rises until they fit.
   Every dictionary gives the same result.
3. Each word is decomposed into grams.  One edit leaves all but `affected` grams in place,
   so two words within one edit agree in one of their `affected` + 1 rarest grams.  Words
   of one length meet in lists of (length, place, gram).  Words of n and n + 1 letters are
   decomposed with the same limits and meet at the same place, if the edit is behind the
   gram, or one place on, if it is in front.
4. Lists of frequent grams are split by a second part of the word: the edit lies in one
   half of the rest and leaves the other as it is, so each half makes a list of its own.
5. What meets in a list is verified by its edit distance inside the join.

A word's form is its near word of most occurrences, if that has `ratio` times its own or
more; its root is where the forms lead.  Forms have ever more occurrences, so there are no
circles and few steps; each round of following them doubles the steps.

Defined results: a null text has no words; a null id counts as an empty string in the hash
that plants errors; ties go to the smallest word in code-point order; repeated rows count each; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import ascii_lower, body
from sentrymill.llm.gram_index import MIN_GRAM, GramDictionary, count_grams
from sentrymill.operators.spread import staged

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
LONGEST_GRAM = 4
# Grams that occur in more words than this get continuations; there are MAX_GRAMS longer ones at most.
PRUNE_COUNT = 50
MAX_GRAMS = 100_000
# Lists of grams that occur in more words than this are split.
LONG_LIST = 200
PLANT_EVERY = 199
_SHORTER, _LONGER = 1, 2


def planted(doc_id: Column, run: Column) -> Column:
    """The run; where PLANT_EVERY divides the CRC-32 h of `id:run`, without its letter h modulo its length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % PLANT_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False,
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): maximal runs of ASCII and Latin-1 letters with A-Z in lower case, long and frequent enough."""
    runs = F.regexp_extract_all(ascii_lower(body(text_col)), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(F.filter(runs, lambda r: F.length(r) >= min_letters)).alias("_run"))
    word = planted(F.col("_id"), F.col("_run")) if plant else F.col("_run")
    return (rows.select(word.alias("word")).filter(F.length("word") >= min_letters)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count))


def gram_dictionary(words: DataFrame, prune_count: int = PRUNE_COUNT, max_grams: int = MAX_GRAMS) -> GramDictionary:
    """All two-letter grams and the continuations of frequent grams; a fixed number, whatever the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_grams(batch.column(0).to_pylist(), LONGEST_GRAM)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

    counted = staged(words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "spelling_grams")
    shortest = F.length("gram") == MIN_GRAM
    heads = counted.select(F.col("gram").alias("_head"), F.col("n").alias("_head_n"))
    longer = (counted.filter(~shortest).withColumn("_head", F.expr("left(gram, length(gram) - 1)"))
              .join(heads, "_head").filter(F.col("_head_n") > prune_count))
    # Fixed numbers of rows: max_grams + 1, and the pairs of letters that occur.
    first = longer.orderBy(F.desc("_head_n"), "_head", "gram").select("gram", "n", "_head_n").limit(max_grams + 1).collect()
    limit = first[max_grams]["_head_n"] if len(first) > max_grams else 0
    kept = [(r["gram"], r["n"]) for r in first if r["_head_n"] > limit]
    return GramDictionary(dict(kept + [(r["gram"], r["n"]) for r in counted.filter(shortest).collect()]))


def _lists(word: str, grams: GramDictionary, long_list: int) -> tuple[list[str], list[str], list[str]]:
    """Names of the lists that a word is in: among words of its length, as the shorter and as the longer word."""
    def split(gram: str) -> bool:
        return grams.counts.get(gram, 0) > long_list

    n = len(word)
    own, shorter, longer = [], [], []
    limit = min(LONGEST_GRAM, n // 2)
    rarest = grams.rarest(word, limit)
    for place, gram in rarest:
        end = place + len(gram)
        name = f"{n} {place} {gram}"
        if not split(gram):
            own.append(f"= {name}")
            shorter.append(f"+ {name}")
            continue
        rest = word[:place] + word[end:]
        half = len(rest) // 2
        own += [f"= {name} < {rest[:half]}", f"= {name} > {rest[half:]}"]
        left, right = word[:place], word[end:]
        half = len(right) // 2
        shorter += [f"+ {name} {left} < {right[:half]}", f"+ {name} {left} > {right[half:]}"]
        half = len(left) // 2
        shorter += [f"+ {name} < {left[:half]} {right}", f"+ {name} > {left[half:]} {right}"]
    limit = min(LONGEST_GRAM, (n - 1) // 2)
    for place, gram in grams.rarest(word, limit):
        end = place + len(gram)
        behind, before = f"+ {n - 1} {place} {gram}", f"+ {n - 1} {place - 1} {gram}"
        if not split(gram):
            longer += [behind, before]
            continue
        left, right = word[:place], word[end:]
        if right:  # the extra letter is behind the gram
            half = (len(right) - 1) // 2
            longer += [f"{behind} {left} < {right[:half]}", f"{behind} {left} > {right[half + 1:]}"]
        if left:
            half = (len(left) - 1) // 2
            longer += [f"{before} < {left[:half]} {right}", f"{before} > {left[half + 1:]} {right}"]
    return own, shorter, longer


def near_pairs(words: DataFrame, grams: GramDictionary, long_list: int = LONG_LIST) -> DataFrame:
    """(word, n, other, other_n), once per pair of words that one edit tells apart."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                keys, row, role = [], [], []
                for i, word in enumerate(batch.column(0).to_pylist()):
                    for kind, names in enumerate(_lists(word, grams, long_list)):
                        different = dict.fromkeys(names)
                        keys += [xxhash.xxh64_intdigest(x.encode()) for x in different]
                        row += [i] * len(different)
                        role += [kind] * len(different)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0).take(pa.array(row, pa.int64())),
                     batch.column(1).take(pa.array(row, pa.int64())), pa.array(role, pa.int8())], ["key", "word", "n", "role"])

    rows = staged(words.select("word", "n").mapInArrow(emit, "key bigint, word string, n bigint, role tinyint"), "spelling_lists")
    left = rows.filter(F.col("role") != _LONGER).select("key", "word", "n")
    right = rows.filter(F.col("role") != _SHORTER).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = ((F.length("word") < F.length("other")) | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & near).select("word", "n", "other", "other_n").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) in which no word comes back to itself."""
    at = staged(links.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                             F.col("_next").isNotNull().alias("_moved")), "spelling_roots")
        at = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, ratio: int = RATIO, long_list: int = LONG_LIST, prune_count: int = PRUNE_COUNT,
                      max_grams: int = MAX_GRAMS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of different words.

    Words of fewer than 2 * MIN_GRAM letters have no gram that is sure to stay, so they are refused.
    """
    words = staged(words.select("word", F.col("n").cast("bigint")).withColumn("word", F.when(F.length("word") < 2 * MIN_GRAM, F.raise_error(
        F.lit("words need four letters"))).otherwise(F.col("word"))), "spelling_words")
    pairs = staged(near_pairs(words, gram_dictionary(words, prune_count, max_grams), long_list), "spelling_pairs")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = (both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("_best")))
    formed = staged(words.join(best, "word", "left").withColumn("_is", -F.col("_best.minus") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), F.col("_best.other")).alias("form"),
        F.when(F.col("_is"), -F.col("_best.minus")).alias("form_n")), "spelling_forms")
    found = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
