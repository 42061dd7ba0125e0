"""Organisation names: cleaning, plausibility, cluster keys, acronyms, vendors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import names as N
from .matching import any_word_in, matches, replace_all, split_words, squeeze, strip, through
from .text import is_upper

def _strip_edges(col: Column) -> Column:
    return F.btrim(col, F.lit(N.EDGE_CHARS))


def words(col: Column) -> Column:
    """Lower-cased words; one empty word for blank text."""
    return split_words(F.lower(col))


def _plausible(name: Column, w: Column) -> Column:
    capital = F.rlike(name, F.lit(r"(?U)\b[A-Z][A-Za-z0-9&._-]*\b|[A-Z]{2,}|^\p{Lu}"))
    return (
        (name != "")
        & ~any_word_in(w, N.ACTION_WORDS)
        & ~((F.size(w) >= 3) & F.coalesce(F.try_element_at(w, F.lit(-1)).isin(N.GENERIC_TAIL_WORDS), F.lit(False)))
        & ~F.contains(name, F.lit(":"))
        & ~F.coalesce(F.get(w, F.lit(0)).isin(N.BAD_FIRST_WORDS), F.lit(False))
        & capital
    )


def plausible_org(col: Column) -> Column:
    """Looks like a name: no action words, no generic tail, no colon, some capital."""
    return F.coalesce(through(
        strip(squeeze(col)),
        lambda n: F.struct(n.alias("n"), words(n).alias("w")),
        lambda v: _plausible(v["n"], v["w"]),
    ), F.lit(False))


# Steps of the name cleaner, in order.  Each takes and gives text.
_SENTENCE_CUT = r"\.*\.\s+(?:" + "|".join(N.SENTENCE_STARTERS) + r")\b.*$"
_CLAUSE_CUT = r"(?s)\s+(?:" + "|".join(N.CLAUSE_BOUNDARY) + r")\b.*$"
_CATEGORY = (r"^(?:(?:[A-Za-z][A-Za-z0-9&._-]*\s+){0,2}(?:" + "|".join(N.CATEGORY_PREFIX) + r")\s+)(?=[A-Z])")


def clean_edges_and_clauses(col: Column) -> Column:
    """The rewriting part of the cleaner."""
    text = strip(squeeze(_strip_edges(col)))
    text = replace_all(text, r"^the\s+")
    text = replace_all(text, _SENTENCE_CUT)
    text = strip(replace_all(text, _CLAUSE_CUT))
    text = _strip_edges(squeeze(text))
    text = strip(replace_all(text, _CATEGORY))
    return strip(F.regexp_replace(text, "(?U)" + N.TRAILING_LOWER, "$1"))


def name_if_usable(v: Column) -> Column:
    """The deciding part: struct(n, w) to the name or null."""
    name, w = v["n"], v["w"]
    return F.when(
        (F.length(name) >= N.NAME_MIN_CHARS)
        & ~F.lower(name).isin(N.BLOCKED_NAMES)
        & (F.size(w) <= N.NAME_MAX_WORDS)
        & _plausible(name, w), name)


CLEANING_STEPS = (
    clean_edges_and_clauses,
    lambda n: F.struct(n.alias("n"), words(n).alias("w")),
    name_if_usable,
)


def clean_org(col: Column) -> Column:
    """A usable organisation name or null."""
    return through(col, *CLEANING_STEPS)


def generic_descriptor(col: Column) -> Column:
    """A description such as "cybersecurity firm" rather than a name."""
    return F.coalesce(through(
        words(col),
        lambda w: F.try_element_at(w, F.lit(-1)).isin(N.GENERIC_TERMINAL_WORDS)
        & ((F.size(w) == 1) | ((F.size(w) <= 3) & F.get(w, F.lit(0)).isin(N.DESCRIPTOR_PREFIXES))),
    ), F.lit(False))


def org_key(col: Column) -> Column:
    """Normalised name; the key that clusters articles."""
    text = F.replace(F.replace(F.lower(strip(col)), F.lit("-"), F.lit(" ")), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"(?U)'s\b", "")
    text = F.regexp_replace(text, r"(?U)[^a-z0-9\s]", " ")
    text = F.regexp_replace(text, r"(?U)\b(?:" + "|".join(N.LEGAL_FORMS) + r")\b", "")
    return F.nullif(strip(squeeze(text)), F.lit(""))


def org_acronym(col: Column) -> Column:
    """Acronym in brackets, else the only all-capital token."""
    bracketed = F.nullif(F.regexp_extract(col, r"\(([A-Z0-9&.-]{2,})\)", 1), F.lit(""))
    tokens = F.regexp_extract_all(col, F.lit(r"(?U)\b[A-Z][A-Z0-9&.-]{1,}\b"), F.lit(0))
    return F.coalesce(bracketed, through(tokens, lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0)))))


def advisory_vendor(title: Column) -> Column:
    """Vendor at the head of an advisory title: one or two words."""
    def pick(w: Column) -> Column:
        first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        product_code = (
            F.rlike(second, F.lit(r"(?U)\d"))
            | (is_upper(second) & (F.length(second) >= 3))
            | F.contains(second, F.lit("&")) | F.contains(second, F.lit("/"))
            | F.lower(second).isin(N.VENDOR_STOP_WORDS)
        )
        return (
            F.when(first == "", F.lit(None).cast("string"))
            .when(is_upper(first) & (F.length(first) >= 3), first)
            .when(second.isNull() | product_code | (F.lower(second) == F.lower(first)), first)
            .otherwise(F.concat(first, F.lit(" "), second))
        )
    return F.when(title.isNotNull(), F.coalesce(through(split_words(title), pick), title))


def clean_anchor(col: Column) -> Column:
    """A usable anchor name or null."""
    def check(v: Column) -> Column:
        w, t = v["w"], v["t"]
        return F.when(
            F.length(t).between(N.ANCHOR_MIN_CHARS, N.ANCHOR_MAX_CHARS)
            & ~F.lower(t).isin(N.ANCHOR_BLOCKED)
            & ~any_word_in(w, N.ANCHOR_ACTOR_WORDS)
            & ~F.coalesce(F.get(w, F.lit(0)).isin(N.BAD_FIRST_WORDS), F.lit(False)), t)
    return through(
        _strip_edges(squeeze(col)),
        lambda t: F.struct(words(t).alias("w"), t.alias("t")),
        check,
    )


def starts_upper(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(r"^\p{Lu}")), F.lit(False))
