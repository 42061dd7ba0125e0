"""License scan: ordered signature rules over the words of a text, by Spark expressions only.

A text becomes lower-case words joined by blanks.  Anchors, then keywords decide
which patterns run at all.  A detection is an interval of words; it is suppressed
if the interval of a rule of the same or a better priority contains it (of equal
intervals the better priority, then the earlier rule stays).  Base phrases neither
suppress nor are suppressed.

Defined results: a null text has no words; a text without detections gets a row
with no labels and score 0; each row is scanned on its own, so repeated rows and
ids are fine; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.llm.common import ascii_lower, bind, body
from sentrymill.llm.license_rules import ANCHORS, CONFIDENCE, Rule, load

_BEGIN, _END = "\x01", "\x02"  # never part of a word
_BASE_PRIORITY = max(CONFIDENCE) + 1


def words_text(text: Column) -> Column:
    """The words in lower case, joined by single blanks, with a blank at either end."""
    inner = F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(inner), F.lit(" "))


def _detections(text: Column, rules: list[Rule]) -> Column:
    """Detections (number, start, end) of all rules, by words from 0, end included."""
    known = F.array(*[F.struct(F.lit(r.number).alias("number"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"))
                      for r in rules])

    def of(rule: Column) -> Column:
        marked = F.regexp_replace(text, F.concat(F.lit("(?<= )("), rule["pattern"], F.lit(")(?= )")), F.lit(f"{_BEGIN}$1{_END}"))

        def places(mark: Column) -> Column:
            return F.transform(F.filter(mark, lambda x: x >= 0), lambda x: x)
        words = F.split(F.trim(marked), " ")
        return bind(words, lambda w: F.zip_with(
            places(F.transform(w, lambda x, i: F.when(F.startswith(x, F.lit(_BEGIN)), i).otherwise(-1))),
            places(F.transform(w, lambda x, i: F.when(F.endswith(x, F.lit(_END)), i).otherwise(-1))),
            lambda a, b: F.struct(rule["number"].alias("number"), a.alias("start"), b.alias("end"))))
    return F.flatten(F.transform(F.filter(known, lambda r: F.contains(text, r["keyword"])), of))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per detection, one row with a null rule for a text without any.

    Columns: row (unique per row of docs), id, n_words, rule, label, priority,
    start, end, base, kept.
    """
    rules = rules or load()
    text = F.col("_norm")
    anchored = reduce(lambda a, b: a | b, [F.contains(text, F.lit(a)) for a in ANCHORS])
    none = F.array().cast("array<struct<number:int,start:int,end:int>>")
    inner = F.trim(text)
    scanned = docs.select(F.col(id_col).alias("_id"), words_text(body(text_col)).alias("_norm")).select(
        F.monotonically_increasing_id().alias("row"), "_id",
        F.when(inner == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) - 1)
        .cast("bigint").alias("n_words"),
        F.when(anchored, _detections(text, rules)).otherwise(none).alias("_found"))
    facts = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(_BASE_PRIORITY if r.base else r.priority).alias("priority"))
                      for r in rules])
    rows = scanned.select("row", "_id", "n_words", F.explode_outer("_found").alias("_d")).select(
        "row", "_id", "n_words", F.col("_d.number").alias("rule"), F.col("_d.start").alias("start"), F.col("_d.end").alias("end"),
        F.get(facts, F.col("_d.number"))["label"].alias("label"), F.get(facts, F.col("_d.number"))["priority"].alias("priority"))
    earlier = (Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule")
               .rowsBetween(Window.unboundedPreceding, -1))
    reach = [F.max(F.when(F.col("priority") <= p, F.col("end"))).over(earlier) for p in sorted(CONFIDENCE)]
    covered = reduce(lambda rest, p: F.when(F.col("priority") == p, reach[p - 1] >= F.col("end")).otherwise(rest),
                     sorted(CONFIDENCE), F.lit(False))
    return rows.select(
        "row", F.col("_id").alias(id_col), "n_words", "rule", "label", "priority", "start", "end",
        (F.col("priority") == _BASE_PRIORITY).alias("base"), (~F.coalesce(covered, F.lit(False))).alias("kept"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: words, base places, labels and the confidence of the best label."""
    spans = license_spans(docs, id_col, text_col)
    base, kept = F.col("base"), F.col("kept")
    trust = reduce(lambda rest, p: F.when(F.col("priority") == p, CONFIDENCE[p]).otherwise(rest), CONFIDENCE,
                   F.when(base, CONFIDENCE[3]).otherwise(0.0))

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(kept).alias("labels"),
        F.coalesce(F.max(F.when(kept, trust)), F.lit(0.0)).alias("score")).drop("row")
