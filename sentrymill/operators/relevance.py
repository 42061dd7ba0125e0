"""Relevance: an ordered decision list over each article.

The first rule that fires decides.  `relevance_columns` gives the verdict and the
rule that decided it; the evidence flags are kept so a report can explain it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import JAVA_UNICODE, any_substring, matches, strip
from ..functions.text import combined_text, lead_text
from ..rules import relevance as R
from .victim import with_named_victim


def exploitation_signal(text: Column | str) -> Column:
    """Lower-cased text describes an intrusion or an exploit."""
    return any_substring(text, R.EXPLOITATION_ANCHORS) & matches(text, R.EXPLOITATION_SIGNAL, JAVA_UNICODE)


def direct_attack(lead: Column | str) -> Column:
    return any_substring(lead, R.DIRECT_ATTACK_ANCHORS) & matches(lead, R.DIRECT_ATTACK, JAVA_UNICODE)


def with_texts(articles: DataFrame) -> DataFrame:
    """Lower-cased working texts: everything, title with summary, title."""
    c = F.col
    return articles.withColumns({
        "text_all": combined_text(c("title"), c("summary"), c("content")),
        "text_lead": lead_text(c("title"), c("summary")),
        "text_title": F.lower(strip(F.coalesce(c("title"), F.lit("")))),
    })


def decision_rule(rules=R) -> Column:
    """Name of the rule that decides an article; names starting with + admit it.

    `rules` may be any object with the attributes of rules.relevance, so that a
    changed rule set can be tried before it is adopted.
    """
    c = F.col
    text, lead, title, victim = "text_all", "text_lead", "text_title", c("victim_named")
    exploit = F.contains(c(lead), F.lit("exploit"))
    evidence = F.coalesce(
        F.when(any_substring(text, rules.COMPLETED_INCIDENT), F.lit("completed")),
        F.when(any_substring(text, rules.CONCRETE_IMPACT), F.lit("impact")),
        F.when(direct_attack(lead), F.lit("direct")),
    )
    return (
        F.when(c("source_name") == rules.ALWAYS_RELEVANT_SOURCE, F.lit("+catalogue"))
        .when(c("source_name") == rules.NATIONAL_ALERT_SOURCE,
              F.when(any_substring(lead, rules.NATIONAL_NOISE), F.lit("national_noise"))
              .when(any_substring(lead, rules.NATIONAL_SIGNAL), F.lit("+national_signal"))
              .otherwise(F.lit("national_no_signal")))
        .when(c("source_name") == rules.ADVISORY_SOURCE,
              F.when(any_substring(lead, rules.ADVISORY_NOISE), F.lit("advisory_noise"))
              .when(any_substring(text, rules.ADVISORY_IMPACT), F.lit("+advisory_impact"))
              .otherwise(F.lit("advisory_no_impact")))
        .when(any_substring(lead, rules.LEGAL_FOLLOWUP), F.lit("legal_followup"))
        .when(any_substring(lead, rules.RETRACTION), F.lit("retraction"))
        .when(any_substring(lead, rules.RESEARCHER_TOOL), F.lit("researcher_tool"))
        .when(any_substring(title, rules.NEGATIVE_TITLE), F.lit("negative_title"))
        .when(any_substring(lead, rules.UNSUCCESSFUL_ATTEMPT), F.lit("unsuccessful_attempt"))
        .when(victim.isNull() & exploit & matches(lead, rules.COMPONENT_WORD)
              & matches(lead, rules.COMPONENT_EXPLOITED), F.lit("component_exploitation"))
        .when(victim.isNotNull(),
              F.when(evidence.isNotNull(), F.lit("+named_victim")).otherwise(F.lit("victim_no_evidence")))
        .when(exploitation_signal(text),
              F.when(any_substring(text, rules.CONCRETE_IMPACT) | direct_attack(lead), F.lit("+exploitation"))
              .when(exploit & matches(lead, rules.ACTIVE_EXPLOITATION),
                    F.when(any_substring(text, rules.COMPLETED_INCIDENT), F.lit("+exploitation"))
                    .otherwise(F.lit("exploitation_no_evidence")))
              .otherwise(F.lit("advisory_only")))
        .when(~any_substring(text, rules.TARGET_CONTEXT), F.lit("no_attack_target"))
        .when(direct_attack(lead), F.lit("+attacked_target"))
        .when(any_substring(text, rules.COMPLETED_INCIDENT) & any_substring(text, rules.CONCRETE_IMPACT),
              F.lit("+attacked_target"))
        .otherwise(F.lit("no_attack_construction"))
    )


def with_relevance(articles: DataFrame, rules=R) -> DataFrame:
    """Adds victim_named, decision and relevant to articles joined to their source."""
    return with_decision(with_texts(with_named_victim(articles)), rules)


def with_decision(prepared: DataFrame, rules=R) -> DataFrame:
    decided = prepared.withColumn("decision", decision_rule(rules))
    return decided.withColumn("relevant", F.startswith(F.col("decision"), F.lit("+")))


def rejection_report(decided: DataFrame) -> DataFrame:
    """Rejected articles per source and deciding rule."""
    return (decided.filter(~F.col("relevant"))
            .groupBy("source_name", "decision").agg(F.count("*").alias("n_articles")))


def verdict_counts(decided: DataFrame) -> DataFrame:
    """Dry run of a rule set: admitted and rejected articles per source."""
    return decided.groupBy("source_name").agg(
        F.count_if("relevant").alias("n_passed"), F.count_if(~F.col("relevant")).alias("n_rejected"),
        F.count("*").alias("n_articles"))
