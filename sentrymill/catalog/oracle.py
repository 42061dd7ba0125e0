"""Independent SQL for the queries of the catalog, in the DuckDB dialect.

Written from the rules, not from the Spark plans: windows, ordered aggregates and
string positions take the place of mergeable aggregates, hot-key joins and
padded texts.  Rule tables are the shared input of both sides.
"""

from __future__ import annotations

from ..corpus import CORPUS_SQL
from ..rules import actors as A
from ..rules import names as N
from ..rules import places as P
from ..rules import registry as G
from ..rules import relevance as R
from ..rules import sectors as S


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def within(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_sub(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def any_word(words: str, listed) -> str:
    return f"list_has_any({words}, [{', '.join(q(w) for w in listed)}])"


def rx(x: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, {q(flags + pattern)})"


def labels(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {any_sub(x, t)} THEN {q(label)}" for label, t in rules) + " END"


def rx_labels(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {rx(x, p)} THEN {q(label)}" for label, p in rules) + " END"


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


EDGE = q(N.EDGE_CHARS)
BLANK = "nullif(nullif(trim({0}), ''), 'Unknown')"


# -- names ------------------------------------------------------------------------------
def clean_org(out: str, source: str, raw: str) -> list[str]:
    """CTEs that add the cleaned name (column name, null if unusable) to a table."""
    starters, clauses = "|".join(N.SENTENCE_STARTERS), "|".join(N.CLAUSE_BOUNDARY)
    category = r"(?i)^(?:(?:[A-Za-z][A-Za-z0-9&._-]*\s+){0,2}(?:" + "|".join(N.CATEGORY_PREFIX) + r")\s+)([A-Za-z])"
    return [
        f"{out}_1 AS (SELECT *, regexp_replace(trim(regexp_replace(trim({raw}, {EDGE}), '\\s+', ' ', 'g')), '(?i)^the\\s+', '') AS n1 FROM {source})",
        f"{out}_2 AS (SELECT *, trim(regexp_replace(regexp_replace(n1, {q('(?i)' + chr(92) + '.*' + chr(92) + '.' + chr(92) + 's+(?:' + starters + ')' + chr(92) + 'b.*$')}, ''), {q('(?is)' + chr(92) + 's+(?:' + clauses + ')' + chr(92) + 'b.*$')}, '')) AS n2 FROM {out}_1)",
        f"{out}_3 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(n2, '\\s+', ' ', 'g'), {EDGE}), {q(category)}, '\\1')) AS n3 FROM {out}_2)",
        f"{out}_4 AS (SELECT *, trim(regexp_replace(n3, {q(N.TRAILING_LOWER)}, '\\1')) AS n4 FROM {out}_3)",
        f"{out}_5 AS (SELECT *, string_split_regex(lower(n4), '\\s+') AS w FROM {out}_4)",
        f"{out} AS (SELECT * EXCLUDE (n1, n2, n3, n4, w), CASE WHEN length(n4) > 2 AND lower(n4) NOT IN {within(N.BLOCKED_NAMES)} "
        f"AND len(w) <= {N.NAME_MAX_WORDS} AND NOT {any_word('w', N.ACTION_WORDS)} "
        f"AND NOT (len(w) >= 3 AND w[-1] IN {within(N.GENERIC_TAIL_WORDS)}) AND NOT contains(n4, ':') "
        f"AND w[1] NOT IN {within(N.BAD_FIRST_WORDS)} "
        f"AND regexp_matches(n4, {q(chr(92) + 'b[A-Z][A-Za-z0-9&._-]*' + chr(92) + 'b|[A-Z]{2,}|^' + chr(92) + 'p{Lu}')}) THEN n4 END AS name FROM {out}_5)",
    ]


def generic(x: str) -> str:
    w = f"string_split_regex(lower({x}), '\\s+')"
    return (f"coalesce({w}[-1] IN {within(N.GENERIC_TERMINAL_WORDS)} AND (len({w}) = 1 OR "
            f"(len({w}) <= 3 AND {w}[1] IN {within(N.DESCRIPTOR_PREFIXES)})), false)")


def org_key(x: str) -> str:
    forms = r"\b(" + "|".join(N.LEGAL_FORMS) + r")\b"
    inner = f"regexp_replace(replace(replace(lower(trim({x})), '-', ' '), '&', ' and '), '''s\\b', '', 'g')"
    inner = f"regexp_replace(regexp_replace({inner}, '[^a-z0-9\\s]', ' ', 'g'), {q(forms)}, '', 'g')"
    return f"nullif(trim(regexp_replace({inner}, '\\s+', ' ', 'g')), '')"


def acronym(x: str) -> str:
    return (f"coalesce(nullif(regexp_extract({x}, '\\(([A-Z0-9&.-]{{2,}})\\)', 1), ''), "
            f"CASE WHEN len(regexp_extract_all({x}, '\\b[A-Z][A-Z0-9&.-]{{1,}}\\b')) = 1 "
            f"THEN regexp_extract_all({x}, '\\b[A-Z][A-Z0-9&.-]{{1,}}\\b')[1] END)")


def vendor(x: str) -> str:
    w = f"string_split_regex(trim({x}), '\\s+')"
    upper = "(upper({0}) = {0} AND lower({0}) <> {0})".format
    second = f"{w}[2]"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN trim({x}) = '' THEN {x} WHEN {upper(w + '[1]')} AND length({w}[1]) >= 3 THEN {w}[1] "
            f"WHEN {second} IS NULL OR regexp_matches({second}, '\\d') OR ({upper(second)} AND length({second}) >= 3) "
            f"OR contains({second}, '&') OR contains({second}, '/') OR lower({second}) IN {within(N.VENDOR_STOP_WORDS)} "
            f"OR lower({second}) = lower({w}[1]) THEN {w}[1] ELSE {w}[1] || ' ' || {second} END")


def clean_summary(x: str) -> list[str]:
    """Steps of the summary cleaner as nested SQL: squeezed text, then cut to sentences."""
    text = f"trim(regexp_replace(trim({x}), '\\[\\.\\.\\.\\]$', ''))"
    text = f"trim(regexp_replace({text}, '(?:\\.{{2,}}|…)$', ''))"
    squeezed = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    return squeezed


def sentence_cut(x: str) -> str:
    abbr = "(?:^|[^A-Za-z0-9_])(?:[A-Z]|(?i:" + "|".join(N.ABBREVIATIONS) + "))\\s*$"
    last = (f"list_max(list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) IN ('.', '!', '?') "
            f"AND regexp_matches(substr({x}, i + 1), '^[\"'')]?\\s+[A-Z]') "
            f"AND NOT regexp_matches(substr({x}, 1, i - 1), {q(abbr)})))")
    return (f"nullif(CASE WHEN regexp_matches({x}, '[.!?][\"'')]?\\s*$') THEN {x} "
            f"ELSE substr({x}, 1, {last} + CASE WHEN substr({x}, {last} + 1, 1) IN ('\"', '''', ')') THEN 1 ELSE 0 END) END, '')")


# -- article tables --------------------------------------------------------------------------
def _registry() -> str:
    rows = ", ".join(
        "(" + ", ".join([q(v) if isinstance(v, str) else str(v).lower() for v in row]) + ")" for row in G.SOURCES)
    return f"reg(source_name, display_label, source_class, signal_kind, ingest_type, url, tier, tier_trusted_alone, active) AS (VALUES {rows})"


def region_of(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN {within(c)} THEN {q(r)}" for r, c in P.REGION_COUNTRIES) + " END"


BASE = [
    f"articles AS ({CORPUS_SQL})",
    _registry(),
    "src AS (SELECT a.*, r.display_label, r.source_class, r.signal_kind, r.tier_trusted_alone, "
    "lower(concat_ws(' ', trim(coalesce(title, '')), trim(coalesce(summary, '')), trim(coalesce(content, '')))) AS t_all, "
    "lower(concat_ws(' ', trim(coalesce(title, '')), trim(coalesce(summary, '')))) AS t_lead, lower(trim(coalesce(title, ''))) AS t_title "
    "FROM articles a LEFT JOIN reg r USING (source_name))",
]


def _all(x: str, rules) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({x}, {q('(?i)' + p)}, 1)" for _, p, *_ in rules) + "])"


# The lookahead of the third headline form is written as a shortest match here.
_FORMS = [(n, p.replace(r"(?:\s+(?!(?:data|breach)\b)[A-Z][A-Za-z0-9._-]*){0,2}", r"(?:\s+[A-Z][A-Za-z0-9._-]*){0,2}?"))
          for n, p, _ in N.TITLE_FORMS]
VICTIM = BASE + [
    "lists AS ("
    + " UNION ALL ".join(
        f"SELECT article_id, 0 AS scope, {i} AS base, [nullif(regexp_extract(title, {q('(?i)' + p)}, 1), '')] AS l FROM src "
        "WHERE source_class IS DISTINCT FROM 'official_alert'" for i, (_, p) in enumerate(_FORMS))
    + f" UNION ALL SELECT article_id, 1, 0, {_all('content', N.BODY_PATTERNS)} FROM src WHERE content IS NOT NULL"
    + f" UNION ALL SELECT article_id, 2, 0, {_all('summary', N.HEADLINE_PATTERNS)} FROM src WHERE source_class IS DISTINCT FROM 'official_alert'"
    + f" UNION ALL SELECT article_id, 3, 0, {_all('title', N.HEADLINE_PATTERNS)} FROM src WHERE source_class IS DISTINCT FROM 'official_alert')",
    "raws AS (SELECT article_id, scope, base + generate_subscripts(l, 1) AS pos, trim(unnest(l)) AS raw FROM lists)",
    *clean_org("cleaned", f"(SELECT * FROM raws WHERE raw IS NOT NULL AND (scope = 0 OR NOT {rx('raw', N.AUDIENCE_TAIL)}))", "raw"),
    f"picked AS (SELECT article_id, arg_min(name, scope * 100000 + pos) AS victim FROM cleaned WHERE name IS NOT NULL AND NOT {generic('name')} "
    f"AND (scope = 0 OR (regexp_matches(name, '^\\p{{Lu}}') AND NOT {rx('name', N.BLOCKED_ACTION)} "
    f"AND NOT {any_word(chr(115) + 'tring_split_regex(lower(name), ' + q(chr(92) + 's+') + ')', N.ACTOR_NOUNS)})) GROUP BY article_id)",
    "named AS (SELECT s.*, CASE WHEN t_title <> '' AND NOT starts_with(t_title, 'webinar:') THEN victim END AS victim FROM src s LEFT JOIN picked USING (article_id))",
]

_DIRECT = rx("t_lead", R.DIRECT_ATTACK)
_SIGNAL = rx("t_all", R.EXPLOITATION_SIGNAL)
_COMPLETED, _IMPACT, _TARGET = (any_sub("t_all", t) for t in (R.COMPLETED_INCIDENT, R.CONCRETE_IMPACT, R.TARGET_CONTEXT))
DECIDED = VICTIM + [
    f"flags AS (SELECT *, {_DIRECT} AS f_direct, {_SIGNAL} AS f_signal, {_COMPLETED} AS f_completed, {_IMPACT} AS f_impact, "
    f"{_TARGET} AS f_target, {rx('t_lead', R.ACTIVE_EXPLOITATION)} AS f_active FROM named)",
    "decided AS (SELECT *, CASE "
    f"WHEN source_name = {q(R.ALWAYS_RELEVANT_SOURCE)} THEN '+catalogue' "
    f"WHEN source_name = {q(R.NATIONAL_ALERT_SOURCE)} AND {any_sub('t_lead', R.NATIONAL_NOISE)} THEN 'national_noise' "
    f"WHEN source_name = {q(R.NATIONAL_ALERT_SOURCE)} AND {any_sub('t_lead', R.NATIONAL_SIGNAL)} THEN '+national_signal' "
    f"WHEN source_name = {q(R.NATIONAL_ALERT_SOURCE)} THEN 'national_no_signal' "
    f"WHEN source_name = {q(R.ADVISORY_SOURCE)} AND {any_sub('t_lead', R.ADVISORY_NOISE)} THEN 'advisory_noise' "
    f"WHEN source_name = {q(R.ADVISORY_SOURCE)} AND {any_sub('t_all', R.ADVISORY_IMPACT)} THEN '+advisory_impact' "
    f"WHEN source_name = {q(R.ADVISORY_SOURCE)} THEN 'advisory_no_impact' "
    f"WHEN {any_sub('t_lead', R.LEGAL_FOLLOWUP)} THEN 'legal_followup' "
    f"WHEN {any_sub('t_lead', R.RETRACTION)} THEN 'retraction' "
    f"WHEN {any_sub('t_lead', R.RESEARCHER_TOOL)} THEN 'researcher_tool' "
    f"WHEN {any_sub('t_title', R.NEGATIVE_TITLE)} THEN 'negative_title' "
    f"WHEN {any_sub('t_lead', R.UNSUCCESSFUL_ATTEMPT)} THEN 'unsuccessful_attempt' "
    f"WHEN victim IS NULL AND {rx('t_lead', R.COMPONENT_WORD)} AND {rx('t_lead', R.COMPONENT_EXPLOITED)} THEN 'component_exploitation' "
    "WHEN f_signal AND NOT f_impact AND NOT f_direct AND victim IS NULL AND NOT f_active THEN 'advisory_only' "
    "WHEN victim IS NOT NULL AND (f_direct OR f_completed OR f_impact) THEN '+named_victim' "
    "WHEN victim IS NOT NULL THEN 'victim_no_evidence' "
    "WHEN f_signal AND (f_direct OR f_completed OR f_impact) THEN '+exploitation' "
    "WHEN f_signal THEN 'exploitation_no_evidence' "
    "WHEN NOT f_target THEN 'no_attack_target' "
    "WHEN f_direct OR (f_completed AND f_impact) THEN '+attacked_target' "
    "ELSE 'no_attack_construction' END AS decision FROM flags)",
]

# -- extraction ------------------------------------------------------------------------------------
_GUARDS = {"activity": "is_activity", "title_breach": "f_title_breach", "title_wiper": "f_title_wiper"}
_SCOPES = {"text": "t_all", "lead": "t_lead", "ransom": "t_ransom"}


def attack_case() -> str:
    parts = []
    for label, scope, terms, off in S.ATTACK_RULES:
        test = _SIGNAL if scope == "exploitation_signal" else any_sub(_SCOPES[scope], terms)
        parts.append("WHEN " + " AND ".join([f"NOT {_GUARDS[g]}" for g in off] + [test]) + f" THEN {q(label)}")
    return "CASE " + " ".join(parts) + " ELSE 'Unknown' END"


ATTACK_INPUT = (
    "coalesce(signal_kind = 'activity', false) AS is_activity, "
    f"{any_sub('t_title', S.TITLE_BREACH)} AS f_title_breach, {any_sub('t_title', S.TITLE_WIPER)} AS f_title_wiper, "
    f"regexp_replace(t_all, {q(S.ANTI_RANSOMWARE)}, '', 'g') AS t_ransom")


def country_of(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sub(x, t)} THEN {q(c + '|' + r)}" for t, c, r in P.COUNTRY_TERMS) + " END"


def _no_audience(x: str) -> str:
    return f"regexp_replace({x}, {q('(?i)' + P.AUDIENCE_PHRASE)}, '', 'g')"


def spans_cte(out: str, source: str) -> list[str]:
    """First country of the target phrases per article."""
    lists = "flatten([" + ", ".join(f"regexp_extract_all(t_all, {q(p)}, 1)" for p, _ in P.TARGET_PHRASES) + "])"
    return [
        f"{out}_l AS (SELECT article_id, {lists} AS l FROM {source})",
        f"{out}_r AS (SELECT article_id, generate_subscripts(l, 1) AS pos, trim(unnest(l)) AS span FROM {out}_l)",
        f"{out} AS (SELECT article_id, arg_min(place, pos) AS span_place FROM (SELECT article_id, pos, {country_of('s')} AS place FROM "
        f"(SELECT article_id, pos, trim({_no_audience('span')}) AS s FROM {out}_r WHERE span <> '' AND NOT {rx('span', P.LANGUAGE_SOFTWARE)})) "
        "WHERE place IS NOT NULL GROUP BY article_id)",
    ]


def nation_cte(out: str, source: str) -> list[str]:
    return [
        f"{out}_r AS (SELECT article_id, generate_subscripts(l, 1) AS pos, trim(unnest(l)) AS span FROM "
        f"(SELECT article_id, regexp_extract_all(t_all, {q(P.NATIONALITY_PHRASE)}, 1) AS l FROM {source}))",
        f"{out} AS (SELECT article_id, arg_min(place, pos) AS nation_place FROM (SELECT article_id, pos, {country_of('span')} AS place FROM {out}_r "
        f"WHERE NOT {any_sub('span', P.NATIONALITY_ACTOR_WORDS)}) WHERE place IS NOT NULL GROUP BY article_id)",
    ]


def industry_sql(victim: str, lead: str) -> str:
    return (f"coalesce(CASE WHEN {victim} IS NOT NULL THEN {labels('lower(' + victim + ')', S.INDUSTRY_BY_NAME)} END, "
            f"{rx_labels(lead, S.INDUSTRY_BY_TARGET)}, {labels(lead, S.INDUSTRY_KEYWORDS)}, {rx_labels(lead, S.ORGANISATION_TYPES)}, "
            f"{labels(lead, S.INDUSTRY_FALLBACK)}, CASE WHEN {victim} IS NOT NULL THEN 'Technology' ELSE 'Unknown' END)")


def anchor_ok(x: str) -> str:
    """Trimmed anchor candidate if usable, as SQL over an already trimmed column."""
    w = f"string_split_regex(lower({x}), '\\s+')"
    return (f"CASE WHEN length({x}) BETWEEN {N.ANCHOR_MIN_CHARS} AND {N.ANCHOR_MAX_CHARS} AND lower({x}) NOT IN {within(N.ANCHOR_BLOCKED)} "
            f"AND NOT {any_word(w, N.ANCHOR_ACTOR_WORDS)} AND {w}[1] NOT IN {within(N.BAD_FIRST_WORDS)} THEN {x} END")


def _phrase(x: str, p: str) -> str:
    return f"trim(regexp_replace(regexp_extract({x}, {q('(?i)' + p)}, 1), '\\s+', ' ', 'g'), {EDGE})"


def anchors(source: str, victim: str) -> list[str]:
    """anchor table: anchor_name, anchor_type per article."""
    both = "concat_ws(' ', trim(coalesce(title, '')), trim(coalesce(summary, '')))"
    campaign = [_phrase("title", p) for p in N.INCIDENT_PHRASES + N.CAMPAIGN_PHRASES]
    product = [_phrase(both, p) for p in N.PRODUCT_PHRASES]
    cols = [f"{e} AS k{i}" for i, e in enumerate(campaign)] + [f"{e} AS p{i}" for i, e in enumerate(product)]
    flaw = " UNION ALL ".join(
        f"SELECT article_id, {i} AS ord, nullif(regexp_extract(title, {q(p)}, 1), '') AS raw FROM {source}" for i, p in enumerate(N.FLAW_SUBJECTS))
    campaign_name = "coalesce(" + ", ".join(anchor_ok(f"k{i}") for i in range(len(campaign))) + ")"
    product_name = "coalesce(" + ", ".join(anchor_ok(f"p{i}") for i in range(len(product))) + ")"
    return [
        *clean_org("flaw_c", f"({flaw})", "raw"),
        "flaws AS (SELECT article_id, arg_min(name, ord) AS flaw FROM flaw_c WHERE name IS NOT NULL GROUP BY article_id)",
        f"anchor_in AS (SELECT s.*, nullif(upper(regexp_extract({both}, {q('(?i)' + N.CVE_ID)}, 1)), '') AS cve, flaw, {', '.join(cols)} "
        f"FROM {source} s LEFT JOIN flaws USING (article_id))",
        f"anchor_n AS (SELECT *, {campaign_name} AS campaign, {product_name} AS product, "
        f"source_name IN ({q(G.CATALOGUE_SOURCE)}, {q(G.ADVISORY_SOURCE)}) AND trim(title) <> '' AS official FROM anchor_in)",
        f"anchor AS (SELECT *, CASE WHEN {victim} IS NOT NULL THEN {victim} WHEN cve IS NOT NULL THEN cve WHEN campaign IS NOT NULL THEN campaign "
        "WHEN official THEN trim(title) ELSE coalesce(product, flaw) END AS anchor_name, "
        f"CASE WHEN {victim} IS NOT NULL THEN 'organization' WHEN cve IS NOT NULL THEN 'vulnerability' WHEN campaign IS NOT NULL THEN 'campaign' "
        "WHEN official OR coalesce(product, flaw) IS NOT NULL THEN 'product_or_platform' ELSE 'unknown' END AS anchor_type FROM anchor_n)",
    ]


EXTRACTED = DECIDED + [
    f"base AS (SELECT *, {ATTACK_INPUT}, CASE WHEN signal_kind = 'activity' THEN NULL ELSE victim END AS victim0 FROM decided WHERE starts_with(decision, '+'))",
    *anchors("base", "victim0"),
    *spans_cte("spans", "base"),
    *nation_cte("nations", "base"),
    *clean_org("promo", "(SELECT article_id, anchor_name FROM anchor)", "anchor_name"),
    f"ex1 AS (SELECT a.*, {industry_sql('victim0', 't_lead')} AS industry0, {attack_case()} AS attack_type, "
    f"CASE WHEN victim0 IS NOT NULL THEN coalesce(span_place, {country_of(_no_audience('t_lead'))}, nation_place, "
    f"'|' || {labels(_no_audience('t_lead'), P.REGION_TERMS)}) END AS place0, "
    f"CASE WHEN anchor_type <> 'vulnerability' AND NOT {generic('anchor_name')} THEN anchor_name END AS label0, "
    f"CASE WHEN source_name = {q(G.ADVISORY_SOURCE)} THEN {vendor('anchor_name')} ELSE p.name END AS promo_name, "
    f"{clean_summary('summary')} AS s1, {clean_summary('content')} AS s2 "
    "FROM anchor a LEFT JOIN spans USING (article_id) LEFT JOIN nations USING (article_id) LEFT JOIN (SELECT article_id, name FROM promo) p USING (article_id))",
    "ex2 AS (SELECT *, coalesce(victim0 IS NULL AND anchor_type = 'product_or_platform' AND anchor_name <> '' AND "
    f"(source_name IN ({q(G.CATALOGUE_SOURCE)}, {q(G.ADVISORY_SOURCE)}) OR (anchor_name <> trim(title) "
    f"AND len(string_split_regex(anchor_name, '\\s+')) <= {N.NAME_MAX_WORDS} AND regexp_matches(anchor_name, '^\\p{{Lu}}'))), false) AS promotable, "
    f"{sentence_cut('s1')} AS s3, {sentence_cut('s2')} AS s4 FROM ex1)",
    f"ex3 AS (SELECT *, CASE WHEN promotable AND promo_name <> '' AND NOT {generic('promo_name')} THEN promo_name END AS promoted FROM ex2)",
    f"ex4 AS (SELECT *, CASE WHEN promoted IS NOT NULL THEN promoted WHEN promotable AND source_name <> {q(G.ADVISORY_SOURCE)} THEN NULL ELSE label0 END AS label1 FROM ex3)",
    f"ex5 AS (SELECT *, CASE WHEN source_name = {q(G.CATALOGUE_SOURCE)} AND label1 IS NULL AND trim(title) <> '' AND NOT {generic(vendor('title'))} "
    f"THEN {vendor('title')} END AS kev_vendor FROM ex4)",
    "ext AS (SELECT article_id, source_name, display_label, source_class, signal_kind, tier_trusted_alone, article_url, title, summary, content, published_at, "
    "coalesce(victim0, promoted) AS victim_org_name, " + org_key("coalesce(victim0, promoted)") + " AS victim_org_normalized, "
    "coalesce(label1, kev_vendor) AS victim_display_label, anchor_type AS victim_entity_type, "
    "CASE WHEN industry0 = 'Unknown' AND (promotable OR kev_vendor IS NOT NULL) THEN 'Technology' ELSE industry0 END AS industry, attack_type, "
    f"CASE WHEN victim0 IS NOT NULL AND source_name = {q(G.FILING_SOURCE)} AND coalesce(split_part(place0, '|', 1), '') = '' THEN 'United States' "
    "ELSE nullif(split_part(place0, '|', 1), '') END AS country, "
    f"CASE WHEN victim0 IS NOT NULL AND source_name = {q(G.FILING_SOURCE)} AND coalesce(split_part(place0, '|', 1), '') = '' THEN 'North America' "
    "ELSE nullif(split_part(place0, '|', 2), '') END AS region, coalesce(signal_kind, 'incident') AS event_signal_type, "
    "coalesce(s3, nullif(trim(coalesce(nullif(regexp_extract(s4, '(?s)^(.*?[.!?])\\s', 1), ''), s4)), '')) AS short_event_summary FROM ex5)",
]

# -- clustering and merge ------------------------------------------------------------------------------
KIND = "CASE WHEN signal_kind IN ('incident', 'activity') THEN signal_kind ELSE 'none' END"
KEY = ("CASE WHEN regexp_matches(coalesce(victim_org_name, ''), '(?i)^CVE-\\d{4}-\\d+$') THEN NULL "
       "ELSE coalesce('n:' || victim_org_normalized, 'x:' || victim_org_name) END")
CLUSTERED = EXTRACTED + [
    f"keyed AS (SELECT *, {KEY} AS ckey, {KIND} AS kind FROM ext)",
    "marked AS (SELECT *, coalesce(max(CASE WHEN kind = 'incident' THEN 1 ELSE 0 END) OVER (PARTITION BY ckey ORDER BY article_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had_incident, lag(kind) OVER (PARTITION BY ckey ORDER BY article_id) AS prev_kind FROM keyed)",
    "starts AS (SELECT *, CASE WHEN had_incident = 0 AND (prev_kind IS NULL OR prev_kind = 'activity') THEN article_id END AS started FROM marked)",
    "linked AS (SELECT * EXCLUDE (had_incident, prev_kind, started), CASE WHEN ckey IS NULL THEN article_id ELSE max(started) OVER (PARTITION BY ckey ORDER BY article_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS event_id, "
    + any_sub("lower(concat_ws(' ', trim(coalesce(title, '')), trim(coalesce(summary, '')), trim(coalesce(content, ''))))", S.PRIMARY_EVIDENCE)
    + " AS is_primary_source FROM starts)",
]
WEIGHT = ("CASE WHEN source_class = 'primary_disclosure' THEN 100 WHEN source_class IN ('official_alert', 'exploited_vulnerability') THEN 80 "
          "WHEN tier_trusted_alone THEN 80 WHEN source_class = 'incident_news' THEN 50 ELSE 30 END")
CLASS_SCORE = ("CASE WHEN source_class = 'primary_disclosure' THEN 90 WHEN source_class IN ('official_alert', 'exploited_vulnerability') THEN 85 "
               "WHEN tier_trusted_alone THEN 80 ELSE 0 END")
TRUSTED = "coalesce(source_class IN ('primary_disclosure', 'official_alert', 'exploited_vulnerability'), false) OR coalesce(tier_trusted_alone, false)"
COMPLETE = " + ".join(f"CASE WHEN {BLANK.format(f)} IS NULL THEN 0 ELSE 1 END" for f in (
    "victim_org_name", "attack_type", "short_event_summary", "country", "industry"))


def best(x: str, order: str = "weight DESC, published_at DESC, article_id") -> str:
    return f"first({x} ORDER BY {order}) FILTER (WHERE {BLANK.format(x)} IS NOT NULL)"


_CONTENT_ORDER = "weight DESC, complete DESC, published_at DESC, article_id"
MERGED = CLUSTERED + [
    f"lw AS (SELECT *, {WEIGHT} AS weight, {CLASS_SCORE} AS cscore, {TRUSTED} AS alone, {COMPLETE} AS complete FROM linked)",
    "agg AS (SELECT event_id, count(*) AS source_count, "
    + ", ".join(f"{best(f)} AS {f}" for f in ("victim_org_name", "victim_org_normalized", "victim_display_label", "industry", "country", "region"))
    + ", coalesce(" + best("attack_type") + ", first(attack_type ORDER BY article_id)) AS attack_type"
    + ", coalesce(" + best("victim_entity_type") + ", first(victim_entity_type ORDER BY article_id)) AS victim_entity_type"
    + ", " + best("short_event_summary", _CONTENT_ORDER) + " AS summary_short"
    + f", first(title ORDER BY {_CONTENT_ORDER}) AS canonical_title"
    + ", bool_or(signal_kind = 'incident') AS any_inc, bool_or(signal_kind = 'activity') AS any_act, first(published_at ORDER BY article_id) AS first_seen_at, "
    "max(published_at) AS last_seen_at, bool_or(alone) AS trusted_alone, bool_or(is_primary_source) AS has_primary_evidence, max(cscore) AS best_class_score, "
    "first(source_name ORDER BY published_at DESC, article_id DESC) AS latest_source, "
    f"bool_or(source_name = {q(G.FILING_SOURCE)}) AS has_filing FROM lw GROUP BY event_id)",
    "ev1 AS (SELECT * REPLACE (coalesce(industry, 'Unknown') AS industry, coalesce(" + region_of("country") + ", region) AS region, "
    "CASE WHEN regexp_matches(victim_display_label, '(?i)^CVE-\\d{4}-\\d+$') THEN NULL ELSE victim_display_label END AS victim_display_label, "
    "CASE WHEN NOT coalesce(any_inc, false) AND coalesce(any_act, false) THEN NULL WHEN regexp_matches(victim_org_name, '(?i)^CVE-\\d{4}-\\d+$') THEN NULL ELSE victim_org_name END AS victim_org_name, "
    "CASE WHEN NOT coalesce(any_inc, false) AND coalesce(any_act, false) THEN NULL WHEN regexp_matches(victim_org_name, '(?i)^CVE-\\d{4}-\\d+$') THEN NULL ELSE victim_org_normalized END AS victim_org_normalized), "
    "CASE WHEN any_inc THEN 'incident' WHEN any_act THEN 'activity' ELSE 'incident' END AS kind0 FROM agg)",
    "ev2 AS (SELECT *, CASE WHEN source_count >= 2 OR trusted_alone OR has_primary_evidence THEN 'confirmed' ELSE 'emerging' END AS event_status, "
    "CASE WHEN source_count >= 2 OR trusted_alone THEN 'high' WHEN has_primary_evidence THEN 'medium' ELSE 'low' END AS confidence_level, "
    "CAST(greatest(CASE WHEN source_count = 1 THEN 25 ELSE 75 + 3 * least(source_count - 2, 3) END, best_class_score, CASE WHEN has_primary_evidence THEN 75 ELSE 0 END) AS DOUBLE) AS confidence_score FROM ev1)",
    "ev3 AS (SELECT *, CASE WHEN kind0 = 'incident' AND victim_org_name IS NULL AND confidence_score < 50 THEN 'intelligence' ELSE kind0 END AS event_signal_type, "
    "lower(coalesce(canonical_title, '') || ' ' || coalesce(summary_short, '')) AS itext FROM ev2)",
    f"ev AS (SELECT event_id, 'event-' || event_id AS slug, canonical_title, event_status, confidence_level, confidence_score, first_seen_at, last_seen_at, "
    "victim_org_name, victim_org_normalized, victim_display_label, victim_entity_type, industry, attack_type, event_signal_type, region, country, source_count, "
    f"CASE WHEN event_signal_type = 'activity' THEN latest_source = {q(G.CATALOGUE_SOURCE)} OR {any_sub('itext', S.ACTIVITY_HIGH_IMPACT)} "
    f"WHEN event_signal_type = 'intelligence' THEN false ELSE latest_source = {q(G.FILING_SOURCE)} OR {any_sub('itext', S.HIGH_IMPACT)} END AS is_high_impact, "
    "summary_short, has_filing, has_primary_evidence, trusted_alone, best_class_score, itext FROM ev3)",
]

# -- attribution ---------------------------------------------------------------------------------------------
_NAMES = []
for _i, (_canonical, _kind, _aliases) in enumerate(A.SEED_ACTORS):
    for _j, _name in enumerate([_canonical] + _aliases):
        _NAMES.append((_name, _canonical, _kind, _i * 100000 + _j))
NAMES = "actor_names(alias, canonical, actor_type, ord) AS (VALUES " + ", ".join(
    f"({q(a)}, {q(c)}, {q(k)}, {o})" for a, c, k, o in _NAMES) + ")"


def _win(before: int, after: int) -> str:
    return f"substr(etext, greatest(o - {before}, 0) + 1, least(length(etext), o + {after}) - greatest(o - {before}, 0))"


FOUND = MERGED + [
    NAMES,
    "texts AS (SELECT event_id, string_agg(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(content, '')), ' ' ORDER BY article_id DESC) AS etext FROM linked GROUP BY event_id)",
    "elig AS (SELECT event_id, etext, list_distinct(regexp_extract_all(lower(victim_org_name), '\\w+')) AS vw FROM ev JOIN texts USING (event_id) WHERE event_signal_type = 'incident')",
    "pieces AS (SELECT e.event_id, etext, vw, n.*, string_split(lower(etext), lower(alias)) AS pc FROM elig e JOIN actor_names n ON contains(lower(etext), lower(alias)))",
    "offs AS (SELECT * EXCLUDE (pc), unnest(list_transform(range(1, len(pc)), lambda i: CAST(list_sum(list_transform(pc[1:i], lambda p: length(p))) AS BIGINT) + (i - 1) * length(alias))) AS o FROM pieces)",
    "occ AS (SELECT *, lower(" + _win(A.PHRASE_WINDOW, A.PHRASE_WINDOW) + ") AS near FROM offs "
    "WHERE NOT regexp_matches(substr(etext, o, CASE WHEN o = 0 THEN 0 ELSE 1 END), '[A-Za-z0-9_]') AND NOT regexp_matches(substr(etext, o + length(alias) + 1, 1), '[A-Za-z0-9_]'))",
    f"guarded AS (SELECT *, {any_sub('near', A.CLAIMED + A.CONFIRMED + A.SUSPECTED)} AS has_phrase, "
    f"(NOT (length(alias) <= {A.SHORT_ALIAS_CHARS} AND regexp_matches(alias, '^[A-Za-z-]*[A-Za-z][A-Za-z-]*$')) OR {rx(_win(A.SHORT_ALIAS_WINDOW, A.SHORT_ALIAS_WINDOW), A.ACTOR_CLASS_CONTEXT)}) AS has_class, "
    "CASE WHEN vw IS NULL THEN true WHEN len(vw) = 1 THEN list_contains(regexp_extract_all(lower(etext), '\\w+'), vw[1]) "
    "ELSE list_has_any(regexp_extract_all(near, '\\w+'), vw) END AS near_victim, "
    f"{rx(f'substr(etext, greatest(o - {A.HISTORY_WINDOW}, 0) + 1, o - greatest(o - {A.HISTORY_WINDOW}, 0))', A.HISTORICAL_MARKER)} AS historical, "
    f"CASE WHEN {any_sub('lower(' + _win(A.STATUS_WINDOW, A.STATUS_WINDOW) + ')', A.CLAIMED)} THEN 'claimed' "
    f"WHEN {any_sub('lower(' + _win(A.STATUS_WINDOW, A.STATUS_WINDOW) + ')', A.CONFIRMED)} THEN 'confirmed' ELSE 'suspected' END AS status FROM occ)",
    "hits AS (SELECT event_id, first(canonical ORDER BY o, length(alias) DESC, ord) AS actor_name, first(actor_type ORDER BY o, length(alias) DESC, ord) AS actor_type, "
    "first(status ORDER BY o, length(alias) DESC, ord) AS attribution_status FROM guarded WHERE has_phrase AND has_class AND near_victim AND NOT historical GROUP BY event_id)",
]
ATTRIBUTED = FOUND + [
    "att AS (SELECT ev.* REPLACE (CASE WHEN event_signal_type = 'incident' THEN actor_name IS NOT NULL OR has_filing OR "
    + any_sub("itext", S.HIGH_IMPACT) + " ELSE is_high_impact END AS is_high_impact), actor_name, actor_type, attribution_status, "
    "event_signal_type = 'incident' AND victim_org_name IS NOT NULL AS considered, actor_name IS NOT NULL AS changed FROM ev LEFT JOIN hits USING (event_id))",
    "clock AS (SELECT max(published_at) AS as_of FROM articles)",
]
