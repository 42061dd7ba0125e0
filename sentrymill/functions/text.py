"""Scalar text functions: Column in, Column out."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..rules import names as N
from ..rules import places as P
from ..rules import registry as G
from ..rules import sectors as S
from .matching import any_substring, extract_all, rstrip, split_words, squeeze, strip, through

SENTENCE_BREAK = r"(?<=[.!?])\s+"


# -- markup -----------------------------------------------------------------------
@pandas_udf(StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(col: Column) -> Column:
    """Decode character references; only texts holding an ampersand leave the JVM."""
    return F.coalesce(_decode_entities(F.when(F.contains(col, F.lit("&")), col)), col)


def strip_tags(col: Column) -> Column:
    return strip(squeeze(F.regexp_replace(col, "<[^>]+>", " ")))


def clean_html(col: Column) -> Column:
    """References first, then tags, so an escaped tag disappears as well."""
    return F.coalesce(strip_tags(decode_entities(col)), F.lit(""))


def html_to_text(col: Column) -> Column:
    return strip_tags(decode_entities(col))


# -- addresses and keys ---------------------------------------------------------------
def url_domain(url: Column) -> Column:
    bare = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("https://"), F.lit("")),
                     F.lit("http://"), F.lit(""))
    return F.split_part(bare, F.lit("/"), F.lit(1))


def submitted_domain(url: Column) -> Column:
    return F.regexp_replace(url_domain(url), r"^www\.", "")


def filing_filename(hit_id: Column) -> Column:
    """Part of a search-hit id behind the first colon, null if there is none."""
    return F.nullif(strip(F.regexp_extract(hit_id, r"(?s)^[^:]*:(.*)$", 1)), F.lit(""))


def filing_accession(url: Column) -> Column:
    dashed = F.nullif(F.regexp_extract(url, r"/(\d{10}-\d{2}-\d{6})", 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(url, r"/(\d{18})/", 1), F.lit(""))
    return F.coalesce(dashed, F.when(digits.isNotNull(), F.concat(
        F.substring(digits, 1, 10), F.lit("-"), F.substring(digits, 11, 2), F.lit("-"),
        F.substring(digits, 13, 6))))


def filing_url(cik: Column, accession: Column) -> Column:
    return F.when(
        cik.isNotNull() & (cik != "") & (F.replace(accession, F.lit("-"), F.lit("")) != ""),
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"),
                 F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession,
                 F.lit("-index.htm")),
    ).otherwise(F.concat(
        F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="),
        F.coalesce(cik, F.lit("")), F.lit("&type=8-K")))


# -- combined text ----------------------------------------------------------------------
def combined_text(title: Column, summary: Column, content: Column) -> Column:
    parts = [strip(F.coalesce(c, F.lit(""))) for c in (title, summary, content)]
    return F.lower(F.concat_ws(" ", *parts))


def lead_text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat_ws(" ", strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(summary, F.lit("")))))


# -- sentences ----------------------------------------------------------------------------
def sentences(col: Column) -> Column:
    return F.split(col, "(?U)" + SENTENCE_BREAK)


_ENDS_SENTENCE = r"[.!?][\"')]?\s*$"
# Longest prefix that ends a sentence: the full stop is followed by a capital and the
# word in front is neither an initial nor a listed abbreviation.
_LAST_SENTENCE = (
    r"(?sU)^(.*(?=[.!?])(?<!\b(?:(?i:" + "|".join(N.ABBREVIATIONS) + r")|\p{Lu})\s{0,1})"
    r"[.!?][\"')]?)(?=\s+[A-Z])"
)


def trim_to_sentence(col: Column) -> Column:
    return F.when((col == "") | F.rlike(col, F.lit("(?U)" + _ENDS_SENTENCE)), col).otherwise(
        F.nullif(strip(F.regexp_extract(col, _LAST_SENTENCE, 1)), F.lit("")))


def clean_summary(col: Column) -> Column:
    """Drop trailing ellipses, squeeze and cut to complete sentences; null if nothing is left."""
    text = strip(F.regexp_replace(strip(col), r"\[\.\.\.\]$", ""))
    text = strip(F.regexp_replace(text, r"(?:\.{2,}|…)$", ""))
    return F.nullif(through(squeeze(text), trim_to_sentence), F.lit(""))


def short_event_summary(summary: Column, content: Column) -> Column:
    first = through(clean_summary(content), lambda t: strip(F.get(sentences(t), F.lit(0))))
    return F.coalesce(clean_summary(summary), F.nullif(first, F.lit("")))


# For squeezed text, which is one line: where no sentence ends behind a place, none ends behind a later one, so a search
# that goes on only where the last sentence ended (\G) reads a text once.  Without it a text of n signs that holds no
# end costs n * n steps.
_LEADING_SENTENCE = r"(?U)\G.+?[.!?](?=\s|$)"


def advisory_summary(title: Column, summary: Column) -> Column:
    """First sentence of an advisory text without its label, else a template."""
    def pick(text: Column) -> Column:
        return strip(F.regexp_extract(text, _LEADING_SENTENCE, 0))
    first = pick(strip(squeeze(F.regexp_replace(clean_html(summary), r"(?iU)^\s*View CSAF Summary\s*", ""))))
    return F.when(F.length(first) >= 40, first).otherwise(
        F.concat(title, F.lit(" vulnerability advisory from CISA.")))


# -- exploited-vulnerability catalogue ---------------------------------------------------------
def catalogue_display_name(vendor: Column, product: Column) -> Column:
    shown = F.when((product != "") & (F.lower(product) != F.lower(vendor)), product)
    name = strip(F.concat_ws(" ", F.nullif(vendor, F.lit("")), shown))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("KEV Entry"))


def catalogue_title(display: Column, vulnerability: Column, cve: Column) -> Column:
    rest = F.when(
        (vulnerability != "") & F.startswith(F.lower(vulnerability), F.lower(display)),
        F.btrim(F.substr(vulnerability, F.length(display) + 1), F.lit(" -|:")),
    ).otherwise(vulnerability)
    return strip(squeeze(F.concat(
        display, F.lit(" "), F.coalesce(F.nullif(rest, F.lit("")), F.lit("Vulnerability")),
        F.lit(" ("), cve, F.lit(")"))))


def catalogue_summary(display: Column, cve: Column, description: Column) -> Column:
    text = strip(squeeze(description))
    parts = F.regexp_extract_all(text, F.lit(_LEADING_SENTENCE), F.lit(0))
    cut = rstrip(F.substring(text, 1, 320))
    at_word = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
    return (
        F.when(text == "", F.concat(display, F.lit(" was added to the CISA KEV catalog under "), cve, F.lit(".")))
        .when(F.size(parts) > 0, strip(F.array_join(F.slice(parts, 1, 2), " ")))
        .when(F.length(text) > 320, F.concat(F.rtrim(at_word, F.lit(" ,;:")), F.lit(".")))
        .otherwise(text)
    )


def catalogue_content(summary: Column, cve: Column, vendor: Column, product: Column, version: Column) -> Column:
    def labelled(label: str, col: Column) -> Column:
        return F.when(col != "", F.concat(F.lit(label + ": "), col))
    return F.concat_ws(" ", F.nullif(summary, F.lit("")), labelled("CVE", cve), labelled("Vendor", vendor),
                       labelled("Product", product), labelled("Catalog version", version))


# -- filings ---------------------------------------------------------------------------------
def company_case(col: Column) -> Column:
    """Title-case shouted words, keep acronyms and mixed case."""
    def one(word: Column) -> Column:
        return through(
            F.struct(word.alias("w"), F.rtrim(word, F.lit(".,;:")).alias("bare")),
            lambda v: F.when(F.upper(v["bare"]).isin(G.TITLE_CASE), _title_word(v["w"]))
            .when(F.upper(v["bare"]).isin(G.KEEP_UPPER), F.upper(v["w"]))
            .when(~is_upper(v["bare"]) | ~F.rlike(v["bare"], F.lit(r"^\p{L}+$")) | (F.length(v["bare"]) <= 3), v["w"])
            .otherwise(_title_word(v["w"])),
        )
    return F.when(col == "", col).otherwise(F.array_join(F.transform(split_words(col), one), " "))


def _title_word(word: Column) -> Column:
    """Capital after every non-letter, the rest lower."""
    parts = F.regexp_extract_all(word, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def is_upper(col: Column) -> Column:
    return (F.upper(col) == col) & (F.lower(col) != col)


def sic_industry(code: Column) -> Column:
    sic = F.when(F.rlike(code, F.lit(r"^\s*[+-]?\d+\s*$")), strip(code)).try_cast("int")
    chain = None
    for label, ranges, singles in G.SIC_RULES:
        test = F.lit(False)
        for low, high in ranges:
            test = test | sic.between(low, high)
        if singles:
            test = test | sic.isin(singles)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def industry_hint(industry: Column) -> Column:
    return F.coalesce(F.get(F.map_values(F.map_filter(
        F.create_map(*[F.lit(x) for pair in G.INDUSTRY_HINT.items() for x in pair]),
        lambda k, v: k == industry)), F.lit(0)), F.lit(""))


def state_hint(state: Column) -> Column:
    return F.when(state.isin(G.US_STATE_CODES), F.lit(G.US_HINT)).otherwise(F.lit(""))


def _cut_at_word(body: Column, max_chars: int | None) -> Column:
    if max_chars is None:
        return body
    cut = F.regexp_replace(F.substring(body, 1, max_chars), r"(?s) [^ ]*$", "")
    return F.when(F.length(body) > max_chars, F.concat(cut, F.lit(" [...]"))).otherwise(body)


def disclosure_excerpt(document: Column, max_chars: int | None = None, max_sentences: int | None = None) -> Column:
    """Section body of a filing, else the sentences from the first relevant one on.

    Whole, unless limited (2,500 characters and 12 sentences are the published limits).
    """
    def section(text: Column) -> Column:
        return strip(F.regexp_extract(text, "(?isU)" + G.DISCLOSURE_SECTION, 1))

    def relevant(text: Column) -> Column:
        return through(
            sentences(text),
            lambda s: F.struct(s.alias("s"), F.array_position(
                F.transform(s, lambda x: F.rlike(x, F.lit("(?iU)" + G.DISCLOSURE_TERMS))), True).alias("at")),
            lambda v: F.when(v["at"] > 0, F.slice(v["s"], v["at"], F.lit(max_sentences) if max_sentences else F.size(v["s"]))),
            lambda tail: tail if max_chars is None else F.filter(tail, lambda s, i: F.aggregate(
                F.slice(tail, F.lit(1), i), F.lit(0), lambda n, t: n + F.length(t) + 1) < max_chars),
            lambda kept: strip(F.array_join(kept, " ")),
        )

    def choose(text: Column) -> Column:
        return through(
            F.struct(section(text).alias("section"), text.alias("text")),
            lambda v: F.when(F.length(v["section"]) >= 80, _cut_at_word(v["section"], max_chars)).otherwise(
                through(relevant(v["text"]),
                        lambda b: F.when(F.length(b) >= 100, _cut_at_word(b, max_chars)))),
        )

    return through(F.nullif(html_to_text(document), F.lit("")), choose)


def opening_summary(body: Column, max_chars: int = 400) -> Column:
    """Whole sentences up to a length; the first one is always kept."""
    step = F.aggregate(
        sentences(body),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("done")),
        lambda acc, s: F.when(
            acc["done"] | ((F.length(acc["text"]) + F.length(s) + 1 > max_chars) & (acc["text"] != "")),
            F.struct(acc["text"].alias("text"), F.lit(True).alias("done")),
        ).otherwise(F.struct(strip(F.concat(acc["text"], F.lit(" "), s)).alias("text"),
                             F.lit(False).alias("done"))),
        lambda acc: acc["text"],
    )
    fallback = F.concat(F.regexp_replace(F.substring(body, 1, max_chars), r"(?s) [^ ]*$", ""), F.lit("..."))
    return F.when(body != "", F.coalesce(F.nullif(step, F.lit("")), fallback))


# -- taxonomy --------------------------------------------------------------------------------------
def country_region(country: Column) -> Column:
    """Canonical region of a country name, null if unknown."""
    chain = None
    for region, members in P.REGION_COUNTRIES:
        test = country.isin(members)
        chain = F.when(test, F.lit(region)) if chain is None else chain.when(test, F.lit(region))
    return chain


def normal_attack_type(col: Column) -> Column:
    return F.when(col.isin(S.ATTACK_TYPES), col).otherwise(F.lit("Unknown"))


def normal_anchor_type(col: Column) -> Column:
    return F.when(col.isin(N.ANCHOR_TYPES), col).otherwise(F.lit("unknown"))


def relative_time(ref: Column, as_of: Column) -> Column:
    """m/h/d-ago label, a date from one week on; both sides without time zone."""
    secs = F.timestamp_diff("SECOND", ref, as_of)
    days = F.floor(secs / 86400)
    return (
        F.when(ref.isNull(), F.lit(None).cast("string"))
        .when((days == 0) & (secs < 3600),
              F.concat(F.greatest(F.floor(secs / 60), F.lit(1)).cast("string"), F.lit("m ago")))
        .when(days == 0, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ref, "yyyy-MM-dd"))
    )


def trust_band(score: Column) -> Column:
    return F.when(score >= 75, F.lit("high")).when(score >= 50, F.lit("med")).when(score.isNotNull(), F.lit("low"))


def trust_label(score: Column) -> Column:
    return (F.when(score.isNull(), F.lit("")).when(score >= 75, F.lit("High Trust"))
            .otherwise(score.cast("bigint").cast("string")))


def cve_ids(text: Column) -> Column:
    return F.array_distinct(F.transform(extract_all(text, N.CVE_ID), F.upper))


def primary_evidence(text: Column) -> Column:
    return any_substring(text, S.PRIMARY_EVIDENCE)

