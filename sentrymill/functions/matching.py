"""Rule matching on text columns, built from native expressions only.

A rule is a plain list of substrings or a regular expression.  Two plan-time
reductions keep the row cost low without changing any result:

* a term that contains another term of the same list is dropped, because the
  shorter one already decides the test;
* terms that share a stem are grouped and only tried where the stem occurs.

Text arguments are columns or column names.  A name lets a whole rule table go to
the parser as one expression, which keeps building a plan cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java character classes, word edges and case folding behave like Unicode text.
JAVA_IGNORE_CASE = "(?iU)"
JAVA_UNICODE = "(?U)"
# White space as text libraries strip it, beyond the plain blank.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
               "         　")
# Lists up to this length are tested one by one.
FEW_TERMS = 6


def as_column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Sequence[str]) -> Column:
    """Constant array of strings."""
    return F.expr("array(" + ",".join(map(sql_text, values)) + ")" if values else "cast(array() as array<string>)")


def no_strings() -> Column:
    return string_array([])


def through(col: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply steps one after the other, evaluating each exactly once.

    Nested expressions would repeat a step for every reference to its result;
    binding it to a lambda variable does not.
    """
    values = F.array(col)
    for step in steps:
        values = F.transform(values, step)
    return F.get(values, F.lit(0))


def any_of(tests: Sequence[Column]) -> Column:
    """Balanced disjunction, so that long rule lists stay shallow."""
    if len(tests) == 1:
        return tests[0]
    half = len(tests) // 2
    return any_of(tests[:half]) | any_of(tests[half:])


def _minimal_terms(terms: Sequence[str]) -> list[str]:
    distinct = list(dict.fromkeys(terms))
    return [t for t in distinct if not any(o != t and o in t for o in distinct)]


@lru_cache(maxsize=None)
def _stem_groups(terms: tuple[str, ...], min_len: int = 4) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Greedy cover of the minimal terms: the stem shared by most first, then the rest."""
    left = _minimal_terms(terms)
    groups = []
    while len(left) > FEW_TERMS:
        counts: dict[str, int] = {}
        for term in left:
            for stem in {term[i:j] for i in range(len(term)) for j in range(i + min_len, len(term) + 1)}:
                counts[stem] = counts.get(stem, 0) + 1
        shared = [(n, len(s), s) for s, n in counts.items() if n > 2]
        if not shared:
            break
        stem = max(shared)[2]
        groups.append((stem, tuple(t for t in left if stem in t)))
        left = [t for t in left if stem not in t]
    return tuple(groups) + tuple((t, ()) for t in left)


def _any_substring_sql(text: str, terms: Sequence[str]) -> str:
    groups = _stem_groups(tuple(terms))
    single = [stem for stem, members in groups if not members]
    shared = [(stem, members) for stem, members in groups if members]
    tests = []
    if 0 < len(single) <= FEW_TERMS:
        tests += [f"contains({text}, {sql_text(t)})" for t in single]
    elif single:
        tests.append(f"exists(array({','.join(map(sql_text, single))}), t -> contains({text}, t))")
    if shared:
        rows = ",".join(
            f"struct({sql_text(stem)} AS stem, array({','.join(map(sql_text, members))}) AS terms)"
            for stem, members in shared)
        tests.append(f"exists(array({rows}), g -> contains({text}, g.stem)"
                     f" AND exists(g.terms, t -> contains({text}, t)))")
    return "coalesce(" + (" OR ".join(tests) or "false") + ", false)"


def any_substring(text: Column | str, terms: Sequence[str]) -> Column:
    """True where the text holds at least one term; false for null text."""
    if isinstance(text, str):
        return F.expr(_any_substring_sql(text, terms))
    minimal = _minimal_terms(terms)
    if len(minimal) <= 2 * FEW_TERMS:
        return F.coalesce(any_of([F.contains(text, F.lit(t)) for t in minimal]), F.lit(False))
    return F.coalesce(through(text, lambda x: F.exists(string_array(minimal), lambda t: F.contains(x, t))), F.lit(False))


def any_word_in(words: Column, listed: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(words, string_array(listed)), F.lit(False))


def first_label(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first rule with a matching term, else null."""
    if isinstance(text, str):
        return F.expr("CASE " + " ".join(
            f"WHEN {_any_substring_sql(text, terms)} THEN {sql_text(label)}" for label, terms in rules) + " END")

    def pick(x: Column) -> Column:
        chain = None
        for label, terms in rules:
            test = F.exists(string_array(_minimal_terms(terms)), lambda t: F.contains(x, t))
            chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
        return chain
    return through(text, pick)


def matches(text: Column | str, pattern: str, flags: str = JAVA_IGNORE_CASE) -> Column:
    """Regex search; false for null text."""
    return F.coalesce(F.rlike(as_column(text), F.lit(flags + pattern)), F.lit(False))


def first_regex_label(text: Column | str, rules: Sequence[tuple[str, str]], flags: str = JAVA_IGNORE_CASE) -> Column:
    chain = None
    for label, pattern in rules:
        test = matches(text, pattern, flags)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def extract_all(text: Column | str, pattern: str, group: int = 1, flags: str = JAVA_IGNORE_CASE) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(flags + pattern), F.lit(group))


def extract_first(text: Column | str, pattern: str, group: int = 1, flags: str = JAVA_IGNORE_CASE) -> Column:
    """First match of a group; null where the pattern does not match."""
    return F.nullif(F.regexp_extract(as_column(text), flags + pattern, group), F.lit(""))


def replace_all(text: Column | str, pattern: str, by: str = "", flags: str = JAVA_IGNORE_CASE) -> Column:
    return F.regexp_replace(as_column(text), flags + pattern, by)


def strip(text: Column | str) -> Column:
    """Drop white space of any kind from both ends (a plain trim only drops blanks)."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def rstrip(text: Column | str) -> Column:
    return F.rtrim(as_column(text), F.lit(WHITE_SPACE))


def squeeze(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), r"(?U)\s+", " ")


def split_words(text: Column | str) -> Column:
    """Parts between white space; one empty part for blank text."""
    return F.split(strip(text), r"(?U)\s+")


def blank_to_null(text: Column | str) -> Column:
    """Null for null, blank and the literal Unknown (case-sensitive)."""
    col = as_column(text)
    return F.when((strip(col) != "") & (col != "Unknown"), col)
