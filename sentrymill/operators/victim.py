"""Victim extraction from titles, summaries and article bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import (
    any_substring, any_word_in, extract_all, extract_first, matches, no_strings, strip, through,
)
from ..functions.names import CLEANING_STEPS, clean_org, generic_descriptor, starts_upper, words
from ..rules import names as N



def candidates(text: Column, rules: Sequence[tuple[str, str, list[str]]]) -> Column:
    """Cleaned candidates in pattern order, then match order."""
    def captures(v: Column) -> Column:
        return F.flatten(F.array(*[
            F.when(any_substring(v["low"], anchors), extract_all(v["text"], pattern)).otherwise(no_strings())
            for _, pattern, anchors in rules
        ]))

    raw = through(
        F.coalesce(text, F.lit("")),
        lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")),
        captures,
    )
    cleaned = F.filter(F.transform(raw, strip), lambda c: ~matches(c, N.AUDIENCE_TAIL))
    for step in CLEANING_STEPS:
        cleaned = F.transform(cleaned, step)
    return F.filter(
        cleaned,
        lambda c: c.isNotNull() & starts_upper(c) & ~matches(c, N.BLOCKED_ACTION)
        & ~any_word_in(words(c), N.ACTOR_NOUNS),
    )


def first_named(cands: Column) -> Column:
    return F.get(F.filter(cands, lambda c: ~generic_descriptor(c)), F.lit(0))


def title_form(title: Column) -> Column:
    """Headline forms that settle the victim on their own."""
    def usable(pattern: str) -> Column:
        return through(clean_org(extract_first(title, pattern)),
                       lambda c: F.when(~generic_descriptor(c), c))
    options = [F.when(any_substring(F.lower(title), hints), usable(pattern)) for _, pattern, hints in N.TITLE_FORMS]
    return F.coalesce(*options)


def victim_name(title: Column, summary: Column, content: Column, is_alert: Column, scan_chars: int | None = None) -> Column:
    """Victim named by an article, or null.

    The whole body is read unless `scan_chars` limits it (N.CONTENT_SCAN_CHARS is the published limit).

    Order: settled headline forms, body relationships, summary, title.  Alert
    feeds use titles as document headings, so only their body counts.
    """
    def pick(v: Column) -> Column:
        lead_allowed = ~v["is_alert"]
        return F.when(
            (v["title"] != "") & ~F.startswith(F.lower(v["title"]), F.lit("webinar:")),
            F.coalesce(
                F.when(lead_allowed, title_form(v["title"])),
                first_named(candidates(v["content"], N.BODY_PATTERNS)),
                F.when(lead_allowed, first_named(candidates(v["summary"], N.HEADLINE_PATTERNS))),
                F.when(lead_allowed, first_named(candidates(v["title"], N.HEADLINE_PATTERNS))),
            ),
        )

    def trimmed(c: Column) -> Column:
        return strip(F.coalesce(c, F.lit("")))
    body = trimmed(content) if scan_chars is None else F.substring(trimmed(content), 1, scan_chars)
    return through(
        F.struct(trimmed(title).alias("title"), trimmed(summary).alias("summary"),
                 body.alias("content"), F.coalesce(is_alert, F.lit(False)).alias("is_alert")),
        pick,
    )


def with_named_victim(articles: DataFrame) -> DataFrame:
    """Adds victim_named; expects title, summary, content and source_class."""
    return articles.withColumn("victim_named", victim_name(
        F.col("title"), F.col("summary"), F.col("content"), F.col("source_class") == "official_alert"))
