"""Extraction: sector, place, attack type, anchor and summary of each article.

Everything here is a projection; no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import (
    JAVA_UNICODE, any_substring, extract_all, extract_first, first_label, first_regex_label,
    matches, no_strings, replace_all, sql_text, strip, through,
)
from ..functions.names import (
    advisory_vendor, clean_anchor, clean_org, generic_descriptor, org_key, starts_upper, words,
)
from ..functions.text import cve_ids, normal_anchor_type, normal_attack_type, short_event_summary
from ..rules import names as N
from ..rules import places as P
from ..rules import registry as G
from ..rules import sectors as S
from .relevance import exploitation_signal


# -- industry --------------------------------------------------------------------------
def industry_from_name(victim: Column) -> Column:
    return F.when(victim.isNotNull(), first_label(F.lower(victim), S.INDUSTRY_BY_NAME))


def industry_from_text(lead: Column | str) -> Column:
    attacked = any_substring(lead, ["attack"]) & matches(lead, r"attacks?\s+(?:on|against)\s", JAVA_UNICODE)
    return F.coalesce(
        F.when(attacked, first_regex_label(lead, S.INDUSTRY_BY_TARGET, JAVA_UNICODE)),
        first_label(lead, S.INDUSTRY_KEYWORDS),
        first_regex_label(lead, S.ORGANISATION_TYPES, JAVA_UNICODE),
    )


def industry(victim: Column, lead: Column | str) -> Column:
    """Own name first, then the lead text; a named victim is never without a sector."""
    return F.coalesce(
        industry_from_name(victim),
        industry_from_text(lead),
        first_label(lead, S.INDUSTRY_FALLBACK),
        F.when(victim.isNotNull(), F.lit("Technology")).otherwise(F.lit("Unknown")),
    )


# -- geography -------------------------------------------------------------------------
def _country_case(text: str) -> str:
    """country|region of the first country term in list order, as SQL over a name."""
    rules = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, {sql_text(t)})" for t in terms) + f" THEN {sql_text(country + '|' + region)}"
        for terms, country, region in P.COUNTRY_TERMS)
    return f"CASE {rules} END"


def countries_in(texts: str) -> Column:
    """First country|region among the texts of an array column, in array order."""
    return F.expr(f"get(filter(transform({texts}, s -> {_country_case('s')}), p -> p IS NOT NULL), 0)")


def as_place(label: Column) -> Column:
    """struct(country, region) of a country|region label; an empty country is null."""
    return through(label, lambda p: F.when(p.isNotNull(), F.struct(
        F.nullif(F.split_part(p, F.lit("|"), F.lit(1)), F.lit("")).alias("country"),
        F.split_part(p, F.lit("|"), F.lit(2)).alias("region"))))


def without_audience(text: Column | str) -> Column:
    return replace_all(text, P.AUDIENCE_PHRASE, flags=JAVA_UNICODE)


def target_spans(text: Column | str) -> Column:
    """What follows attack, target, campaign and based-in phrases, in phrase order."""
    spans = F.flatten(F.array(*[
        F.when(any_substring(text, anchors), extract_all(text, p, flags=JAVA_UNICODE)).otherwise(no_strings())
        for p, anchors in P.TARGET_PHRASES]))
    spans = F.filter(F.transform(spans, strip), lambda s: (s != "") & ~matches(s, P.LANGUAGE_SOFTWARE, JAVA_UNICODE))
    return F.transform(spans, lambda s: strip(without_audience(s)))


def nationality_spans(text: Column | str) -> Column:
    spans = F.when(any_substring(text, [" is a"]) | matches(text, r"\bis\s+an?\s", JAVA_UNICODE),
                   extract_all(text, P.NATIONALITY_PHRASE, flags=JAVA_UNICODE)).otherwise(no_strings())
    return F.filter(F.transform(spans, strip), lambda s: ~any_substring(s, P.NATIONALITY_ACTOR_WORDS))


def with_place(frame: DataFrame, out: str, text: str = "text_all", lead: str = "text_lead",
               wanted: Column | None = None, lead_only: bool = False) -> DataFrame:
    """Adds struct(country, region): target phrase, lead, nationality, region word.

    Where `wanted` is false nothing is looked for and the result is null.
    """
    wanted = F.lit(True) if wanted is None else wanted
    ready = frame.withColumns({
        "_lead": F.when(wanted, F.array(without_audience(lead))),
        **({} if lead_only else {"_spans": F.when(wanted, target_spans(text)),
                                 "_nation": F.when(wanted, nationality_spans(text))}),
    })
    if lead_only:
        label = countries_in("_lead")
    else:
        ready = ready.withColumn("_bare_lead", F.get("_lead", F.lit(0)))
        label = F.coalesce(
            countries_in("_spans"), countries_in("_lead"), countries_in("_nation"),
            F.concat(F.lit("|"), first_label("_bare_lead", P.REGION_TERMS)))
    return ready.withColumn(out, as_place(label)).drop("_lead", "_spans", "_nation", "_bare_lead")


# -- attack type --------------------------------------------------------------------------
def attack_type(text: str, lead: str, title: str, is_activity: Column, no_defence: str) -> Column:
    """Attack label of an article; the arguments name its working-text columns."""
    guards = {
        "activity": F.coalesce(is_activity, F.lit(False)),
        "title_breach": any_substring(title, S.TITLE_BREACH),
        "title_wiper": any_substring(title, S.TITLE_WIPER),
    }
    scopes = {"text": text, "lead": lead, "ransom": no_defence}
    chain = None
    for label, scope, terms, off in S.ATTACK_RULES:
        if scope == "exploitation_signal":
            test = exploitation_signal(text)
        else:
            test = any_substring(scopes[scope], terms)
        for guard in reversed(off):
            test = ~guards[guard] & test
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return normal_attack_type(chain.otherwise(F.lit("Unknown")))


# -- anchor -----------------------------------------------------------------------------------
def without_defence(text: str) -> Column:
    """Text without "anti-ransomware", which is no sign of an attack."""
    return F.when(F.contains(F.col(text), F.lit("anti-ransomware")),
                  replace_all(text, S.ANTI_RANSOMWARE, flags=JAVA_UNICODE)).otherwise(F.col(text))


def flaw_subject(title: Column) -> Column:
    """Product named by "... flaw" headlines; case-sensitive."""
    return F.when(F.contains(title, F.lit("flaw")), F.coalesce(
        *[clean_org(extract_first(title, p, flags=JAVA_UNICODE)) for p in N.FLAW_SUBJECTS]))


def event_anchor(title: Column, summary: Column, victim: Column, source: Column,
                 actor: Column | None = None) -> Column:
    """struct(name, kind): what an article is about, most specific first."""
    actor = F.lit(None).cast("string") if actor is None else actor

    def named(name: Column, kind: str) -> Column:
        return through(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit(kind).alias("kind"))))

    def pick(v: Column) -> Column:
        t, both = v["title"], F.concat_ws(" ", v["title"], v["summary"])
        return F.coalesce(
            named(v["victim"], "organization"),
            named(F.upper(extract_first(both, N.CVE_ID)), "vulnerability"),
            *[named(clean_anchor(extract_first(t, p)), "campaign")
              for p in N.INCIDENT_PHRASES + N.CAMPAIGN_PHRASES],
            F.when(v["source"].isin(G.CATALOGUE_SOURCE, G.ADVISORY_SOURCE) & (t != ""),
                   named(t, "product_or_platform")),
            *[named(clean_anchor(extract_first(both, p)), "product_or_platform") for p in N.PRODUCT_PHRASES],
            named(flaw_subject(t), "product_or_platform"),
            named(v["actor"], "actor"),
            F.struct(F.lit(None).cast("string").alias("name"), F.lit("unknown").alias("kind")),
        )

    return through(
        F.struct(strip(F.coalesce(title, F.lit(""))).alias("title"), strip(F.coalesce(summary, F.lit(""))).alias("summary"),
                 victim.alias("victim"), source.alias("source"), actor.alias("actor")),
        pick,
    )


def display_label(anchor: Column) -> Column:
    return F.when((anchor["kind"] != "vulnerability") & ~generic_descriptor(anchor["name"]), anchor["name"])


# -- full row ---------------------------------------------------------------------------------------
EXTRACTION_COLUMNS = (
    "victim_org_name", "victim_org_normalized", "victim_display_label", "victim_entity_type",
    "industry", "region", "country", "attack_type", "event_signal_type", "short_event_summary",
)


def extract_signals(prepared: DataFrame) -> DataFrame:
    """Extraction columns next to each article.

    Expects the output of relevance.with_texts over with_named_victim and the
    registry columns.
    """
    c = F.col
    activity = F.coalesce(c("signal_kind") == "activity", F.lit(False))
    base = prepared.withColumns({
        "victim0": F.when(~activity, c("victim_named")), "text_attack": without_defence("text_all")})
    staged = base.withColumns({
        "industry0": industry(c("victim0"), "text_lead"),
        "attack_type": attack_type("text_all", "text_lead", "text_title", activity, "text_attack"),
        "anchor": event_anchor(c("title"), c("summary"), c("victim0"), c("source_name")),
        "event_signal_type": F.coalesce(c("signal_kind"), F.lit("incident")),
        "short_event_summary": short_event_summary(c("summary"), c("content")),
    })
    # Without a named victim a place is incidental, so it is not even looked for.
    staged = with_place(staged, "place", wanted=c("victim0").isNotNull())
    title = strip(F.coalesce(c("title"), F.lit("")))
    anchor_name = c("anchor.name")
    official = c("source_name").isin(G.CATALOGUE_SOURCE, G.ADVISORY_SOURCE)
    title_part = ((anchor_name != title) & (F.size(words(anchor_name)) <= N.NAME_MAX_WORDS) & starts_upper(anchor_name))
    promotable = (
        c("victim0").isNull() & (c("anchor.kind") == "product_or_platform")
        & F.coalesce(anchor_name != "", F.lit(False)) & (official | F.coalesce(title_part, F.lit(False)))
    )
    promoted = F.when(c("source_name") == G.ADVISORY_SOURCE, advisory_vendor(anchor_name)).otherwise(clean_org(anchor_name))
    usable = through(promoted, lambda p: F.when(~generic_descriptor(p) & (p != ""), p))
    staged = staged.withColumns({
        "promotable": F.coalesce(promotable, F.lit(False)),
        "promoted": F.when(promotable, usable),
        "label0": display_label(c("anchor")),
    })
    staged = staged.withColumn("label1", (
        F.when(c("promoted").isNotNull(), c("promoted"))
        .when(c("promotable") & (c("source_name") != G.ADVISORY_SOURCE), F.lit(None).cast("string"))
        .otherwise(c("label0"))
    ))
    catalogue_vendor = F.when(
        (c("source_name") == G.CATALOGUE_SOURCE) & c("label1").isNull() & (title != ""),
        through(advisory_vendor(title), lambda v: F.when(~generic_descriptor(v), v)))
    staged = staged.withColumns({
        "victim_org_name": F.coalesce(c("victim0"), c("promoted")),
        "catalogue_vendor": catalogue_vendor,
    })
    us = F.struct(F.lit("United States").alias("country"), F.lit("North America").alias("region"))
    place = F.when(
        c("victim0").isNotNull() & (c("source_name") == G.FILING_SOURCE) & c("place.country").isNull(), us
    ).otherwise(c("place"))
    return staged.withColumns({
        "victim_org_normalized": org_key(c("victim_org_name")),
        "victim_display_label": F.coalesce(c("label1"), c("catalogue_vendor")),
        "victim_entity_type": normal_anchor_type(c("anchor.kind")),
        "industry": F.when((c("industry0") == "Unknown") & (c("promotable") | c("catalogue_vendor").isNotNull()),
                           F.lit("Technology")).otherwise(c("industry0")),
        "place": place,
    }).withColumns({"country": c("place.country"), "region": c("place.region")}).drop(
        "victim0", "industry0", "anchor", "promotable", "promoted", "label0", "label1", "catalogue_vendor", "place",
        "text_attack")


def guarded_actor(victim: Column, actor: Column, actor_kind: Column, status: Column) -> dict[str, Column]:
    """Actor fields as stored: none without a victim, none without a name, no "unknown"."""
    kept = F.when(victim.isNotNull() & (victim != "") & (actor != ""), actor)
    return {
        "actor_name": kept,
        "actor_type": F.when(kept.isNotNull(), actor_kind),
        "attribution_status": F.when(kept.isNotNull() & (status != "unknown"), status),
    }


def article_cves(articles: DataFrame) -> DataFrame:
    """One row per article and CVE id; position 0 is the primary one."""
    text = F.concat_ws(" ", "title", "summary", "content")
    return articles.select("article_id", F.posexplode(cve_ids(text)).alias("position", "cve_id"))
