"""One SQL statement per registered query, over the tables of catalog.oracle."""

from __future__ import annotations

from ..rules import actors as A
from ..rules import names as N
from ..rules import places as P
from ..rules import registry as G
from ..rules import relevance as R
from ..rules import sectors as S
from .oracle import (
    ATTACK_INPUT, ATTRIBUTED, BASE, CLASS_SCORE, CLUSTERED, COMPLETE, DECIDED, EDGE, EXTRACTED, FOUND, MERGED, NAMES,
    VICTIM, WEIGHT, _no_audience, acronym, anchor_ok, anchors, any_sub, any_word, attack_case, best, clean_org,
    clean_summary, country_of, generic, industry_sql, labels, nation_cte, org_key, q, region_of, rx, rx_labels,
    sentence_cut, spans_cte, vendor, with_ctes, within,
)

ORACLE: dict[str, str] = {}


def add(name: str, ctes: list[str], select: str) -> None:
    ORACLE[name] = with_ctes(ctes, select) if ctes else select


SPLIT = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def unescape(x: str) -> str:
    return f"regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


def clean_html(x: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace({unescape(x)}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')"


# -- sources ---------------------------------------------------------------------------------------
add("s1_source_registry", BASE,
    "SELECT r.source_name, r.display_label, r.source_class, r.signal_kind, r.ingest_type, r.tier, r.tier_trusted_alone, count(*) AS n_articles "
    "FROM reg r JOIN articles USING (source_name) WHERE active GROUP BY ALL")
add("s2_registry_lookup", BASE, "SELECT article_id, source_name, display_label, source_class, signal_kind FROM src")
_MAIN = ("coalesce(nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), ''), "
         "nullif(regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)</body\\s*>', 1), ''), html)")
_NO_TEXT = "<!--.*?-->|" + "|".join(f"<{e}\\b.*?</{e}\\s*>" for e in (
    "script", "style", "nav", "header", "footer", "aside", "table", "form", "noscript"))
PAGES = [
    f"page_text AS (SELECT *, {clean_html(chr(110) + 'ullif(regexp_extract(html, ' + q('(?is)<title' + chr(92) + 'b[^>]*>(.*?)</title' + chr(92) + 's*>') + ', 1), ' + q('') + ')')} AS page_title, "
    + clean_html(f"regexp_replace({_MAIN}, {q('(?is)' + _NO_TEXT)}, ' ', 'g')") + " AS body FROM {pages})",
    "page_state AS (SELECT *, CASE WHEN page_title <> '' AND length(body) >= 100 THEN 'ok' ELSE 'insufficient_content' END AS status, "
    f"array_to_string({SPLIT.format('body')}[1:2], ' ') AS description FROM page_text)",
]


def pages_from(source: str) -> list[str]:
    return [PAGES[0].replace("{pages}", source), PAGES[1]]


add("s7_page_text", pages_from("pages"),
    "SELECT page_id, page_title, CAST(length(body) AS INT) AS body_chars, md5(body) AS body_md5, "
    "CASE WHEN status = 'ok' THEN md5(trim(body)) END AS content_md5, "
    "CASE WHEN status = 'ok' THEN md5(description) END AS summary_md5, status FROM page_state")
LINKS = ("links AS (SELECT page_id AS submission_id, list_extract(['https://www.bleepingcomputer.com', 'http://krebsonsecurity.com', 'https://therecord.media', "
         "'https://www.ncsc.gov.uk', 'https://www.other.org'], page_id % 5 + 1) || '/p/' || (page_id % 100) AS url, html FROM pages)")
_DOMAIN = "regexp_replace(split_part(replace(replace({0}, 'https://', ''), 'http://', ''), '/', 1), '^www\\.', '')"
DOMAINS = "domains(domain, source_name) AS (VALUES " + ", ".join(f"({q(d)}, {q(s)})" for d, s in G.DOMAIN_TO_SOURCE.items()) + ")"
add("s8_domain_allowlist", [LINKS, DOMAINS],
    f"SELECT submission_id, l.domain, source_name, CASE WHEN source_name IS NULL THEN 'domain_not_allowed' ELSE 'ok' END AS domain_status "
    f"FROM (SELECT *, {_DOMAIN.format('url')} AS domain FROM links) l LEFT JOIN domains USING (domain)")
add("s9_url_dedupe", BASE,
    "SELECT article_id, article_url, title FROM (SELECT *, row_number() OVER (PARTITION BY article_url ORDER BY article_id) AS rn FROM articles) a "
    "WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM articles o WHERE o.article_url = a.article_url AND o.published_at < TIMESTAMP '1996-01-01')")
add("s10_enrich_merge", BASE + [
    "bodies AS (SELECT article_url, min(trim(b, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS body FROM (SELECT article_url, "
    "coalesce(d.text, concat_ws(' ', title, summary, content)) AS b FROM articles a LEFT JOIN documents d ON d.doc_id * 3 = a.article_id) "
    "WHERE length(b) >= 100 GROUP BY 1)",
    f"cand AS (SELECT a.article_id, a.content, a.article_id % 7 = 0 AS done, source_name NOT IN ({q(G.CATALOGUE_SOURCE)}, {q(G.FILING_SOURCE)}) AND a.article_id % 7 <> 0 AS candidate, body "
    "FROM articles a LEFT JOIN bodies USING (article_url))"],
    "SELECT article_id, CASE WHEN candidate THEN body IS NOT NULL OR coalesce(length(content) >= 300, false) ELSE done END AS content_enriched, candidate, "
    "candidate AND body IS NOT NULL AS enriched, CAST(length(CASE WHEN candidate AND body IS NOT NULL THEN body ELSE content END) AS INT) AS content_chars, "
    "md5(CASE WHEN candidate AND body IS NOT NULL THEN body ELSE content END) AS content_md5 FROM cand")
_DUP = ("SELECT article_id, article_id > first_id AS is_duplicate, CASE WHEN article_id > first_id THEN first_id END AS duplicate_of FROM "
        "(SELECT {0} AS article_id, min({0}) OVER (PARTITION BY lower(regexp_replace(regexp_replace({1}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS first_id FROM {2})")
add("s12_exact_duplicates", [], _DUP.format("doc_id", "text", "documents"))
add("s12_title_duplicates", BASE, _DUP.format("article_id", "title", "articles"))
add("s13_status_scan", CLUSTERED,
    "SELECT article_id, status AS processing_status FROM (SELECT d.article_id, CASE WHEN l.article_id IS NOT NULL THEN 'clustered' WHEN starts_with(decision, '+') "
    "THEN 'ready_for_extraction' ELSE 'irrelevant' END AS status FROM decided d LEFT JOIN (SELECT article_id FROM linked WHERE event_id <> article_id) l USING (article_id)) "
    "WHERE status IN ('ready_for_extraction', 'clustered')")
add("s14_actor_names", BASE + [NAMES],
    "SELECT alias, canonical, actor_type, CAST(length(alias) AS INT) AS alias_chars, CAST(ord AS BIGINT) AS ord, "
    "(SELECT count(*) FROM articles WHERE actor = alias) AS n_articles FROM actor_names")
add("s17_latest_run", [
    "runs AS (SELECT ts AS started_at, CASE WHEN user_id % 5 <> 0 THEN ts + INTERVAL 10 MINUTE END AS finished_at, event_type <> 'error' AS success FROM events)"],
    "SELECT * FROM (SELECT 'latest' AS which, * FROM runs ORDER BY started_at DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'latest_success' AS which, * FROM runs "
    "WHERE success AND finished_at IS NOT NULL ORDER BY finished_at DESC LIMIT 1)")
add("s18_purge", DECIDED, "SELECT source_name, count(*) AS n_articles FROM decided WHERE starts_with(decision, '+') AND source_name <> 'unregistered-blog' GROUP BY 1")

# -- text functions ------------------------------------------------------------------------------------
add("t1_html_clean", [], f"SELECT page_id, md5({clean_html('html')}) AS clean_md5, CAST(length({clean_html('html')}) AS INT) AS clean_chars FROM pages")
add("t3_url_domain", [], "SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS domain FROM pages")
add("t4_article_payload", BASE,
    "SELECT DISTINCT article_url, r.ingest_type AS source_type, source_name, source_name AS publisher, lower(trim(title)) AS normalized_title, coalesce(content, summary) AS content, "
    "split_part(replace(replace(coalesce(r.url, ''), 'https://', ''), 'http://', ''), '/', 1) AS normalized_domain, '20020101102030' AS ingestion_batch_id, "
    "published_at, 'pending' AS processing_status FROM articles LEFT JOIN reg r USING (source_name)")
_TITLE = "upper(w[1]) || lower(w[2:])"
add("t9_company_case", BASE + [
    "wordy AS (SELECT article_id, string_split((CASE WHEN article_id % 2 = 0 THEN upper(org) ELSE org END) || ' IBM AT&T HOLDINGS, LLC INC.', ' ') AS ws FROM articles)"],
    "SELECT article_id, array_to_string(list_transform(ws, lambda w: CASE "
    f"WHEN upper(rtrim(w, '.,;:')) IN {within(G.TITLE_CASE)} THEN {_TITLE} WHEN upper(rtrim(w, '.,;:')) IN {within(G.KEEP_UPPER)} THEN upper(w) "
    f"WHEN NOT regexp_matches(rtrim(w, '.,;:'), '^[A-Z]+$') OR length(rtrim(w, '.,;:')) <= 3 THEN w ELSE {_TITLE} END), ' ') AS company FROM wordy")
_SIC = "CASE " + " ".join(
    "WHEN " + " OR ".join([f"article_id % 10000 BETWEEN {a} AND {b}" for a, b in ranges] + ([f"article_id % 10000 IN ({', '.join(map(str, single))})"] if single else []))
    + f" THEN {q(label)}" for label, ranges, single in G.SIC_RULES) + " END"
add("t10_sic_industry", BASE, f"SELECT article_id, {_SIC} AS industry FROM articles")
add("t13_filing_ids", BASE,
    "SELECT article_id, CASE WHEN article_id % 3 < 2 THEN lpad(CAST(article_id AS VARCHAR), 10, '0') || '-24-000123' END AS accession, source_name AS filename FROM articles")
add("t15_opening_summary", [
    "sents AS (SELECT doc_id, s, i FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, " + SPLIT.format("text") + " AS x FROM documents)))",
    # Texts up to a sentence, joined by blanks, have upto - 1 characters; 400 is the limit.
    "sums AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sents)",
    "kept AS (SELECT *, coalesce(bool_and(i = 1 OR upto <= 401) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), true) AS keep FROM sums)"],
    "SELECT doc_id, md5(trim(string_agg(s, ' ' ORDER BY i))) AS summary_md5 FROM kept WHERE keep GROUP BY doc_id")
add("t16_combined_text", BASE, "SELECT article_id, t_all AS text_all, t_lead AS text_lead FROM src")
add("t18_clean_summary", BASE + [
    f"sq AS (SELECT article_id, {clean_summary('summary')} AS a, {clean_summary(chr(40) + 'content || ' + q(' And Dr. Who came. No') + chr(41))} AS b FROM articles)"],
    f"SELECT article_id, {sentence_cut('a')} AS clean_summary, {sentence_cut('b')} AS clean_content FROM sq")
add("t19_short_summary", BASE + [
    f"sq AS (SELECT article_id, {clean_summary('summary')} AS a, {clean_summary('content')} AS b FROM articles)",
    f"cut AS (SELECT article_id, {sentence_cut('a')} AS a, {sentence_cut('b')} AS b FROM sq)"],
    "SELECT article_id, coalesce(a, nullif(trim(coalesce(nullif(regexp_extract(b, '(?s)^(.*?[.!?])\\s', 1), ''), b)), '')) AS short_event_summary FROM cut")
RAW_NAMES = ("raw_names AS (SELECT article_id, CASE article_id % 8 WHEN 0 THEN ' the ' || org || ', ' WHEN 1 THEN 'software company ' || org WHEN 2 THEN title "
             "WHEN 3 THEN org || '. The attack was' WHEN 4 THEN org || ' portal users' WHEN 5 THEN 'cybersecurity firm' WHEN 6 THEN country || ' bank' ELSE 'Using ' || org END AS raw FROM articles)")
add("t20_clean_org", BASE + [RAW_NAMES, *clean_org("tidy", "raw_names", "raw")], "SELECT article_id, raw, name FROM tidy")
_TW = "string_split_regex(lower(title), '\\s+')"
add("t21_plausible_org", BASE,
    f"SELECT article_id, title FROM articles WHERE NOT {any_word(_TW, N.ACTION_WORDS)} AND NOT (len({_TW}) >= 3 AND {_TW}[-1] IN {within(N.GENERIC_TAIL_WORDS)}) "
    f"AND NOT contains(title, ':') AND {_TW}[1] NOT IN {within(N.BAD_FIRST_WORDS)}")
add("t22_generic_descriptor", BASE + [RAW_NAMES], f"SELECT article_id, {generic('trim(raw)')} AS is_generic FROM raw_names")
add("t23_normalise_org", BASE,
    "SELECT article_id, " + org_key("CASE WHEN article_id % 2 = 0 THEN org || '''s Holdings & Co-Op GmbH.' ELSE org END") + " AS org_key FROM articles")
add("t24_acronym", BASE + [
    "an AS (SELECT article_id, org || CASE article_id % 3 WHEN 0 THEN ' (ACM)' WHEN 1 THEN ' IBM group' ELSE ' AB CD' END AS n FROM articles)"],
    f"SELECT article_id, {acronym('n')} AS acronym FROM an")
add("t25_advisory_vendor", BASE + ["vt AS (SELECT article_id, CASE WHEN article_id % 2 = 0 THEN title ELSE upper(title) END AS v FROM articles)"],
    f"SELECT article_id, {vendor('v')} AS vendor FROM vt")
add("t26_clean_anchor", BASE + [RAW_NAMES, f"ra AS (SELECT article_id, trim(regexp_replace(raw, '\\s+', ' ', 'g'), {EDGE}) AS a FROM raw_names)"],
    f"SELECT article_id, {anchor_ok('a')} AS anchor FROM ra")
add("t27_country_region", BASE, f"SELECT article_id, country, {region_of('country')} AS region FROM articles")
add("t28_taxonomy", BASE,
    "SELECT article_id, CASE article_id % 4 WHEN 1 THEN 'DDoS' WHEN 2 THEN 'Injection' ELSE 'Unknown' END AS attack_type, "
    "CASE article_id % 3 WHEN 0 THEN 'campaign' ELSE 'unknown' END AS anchor_type FROM articles")
add("t29_blank", BASE, "SELECT article_id, CASE WHEN article_id % 4 = 2 THEN 'unknown' END AS value FROM articles")
_SECS = "date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31') - CASE WHEN ts > date_trunc('second', ts) THEN 1 ELSE 0 END"
add("t30_relative_time", [f"ages AS (SELECT event_id, ts, {_SECS} AS secs FROM events WHERE ts <= TIMESTAMP '2024-01-31')"],
    "SELECT event_id, CASE WHEN secs < 3600 THEN greatest(secs // 60, 1) || 'm ago' WHEN secs < 86400 THEN (secs // 3600) || 'h ago' "
    "WHEN secs < 7 * 86400 THEN (secs // 86400) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM ages")
add("t31_trust_band", BASE + ["sc AS (SELECT article_id, CASE WHEN article_id % 11 <> 0 THEN article_id % 101 END AS s FROM articles)"],
    "SELECT article_id, CASE WHEN s >= 75 THEN 'high' WHEN s >= 50 THEN 'med' WHEN s IS NOT NULL THEN 'low' END AS band, "
    "CASE WHEN s IS NULL THEN '' WHEN s >= 75 THEN 'High Trust' ELSE CAST(s AS VARCHAR) END AS label FROM sc")
add("t32_clean_article", BASE, "SELECT article_id, title, trim(summary) AS summary, trim(coalesce(content, '')) AS content, lower(title) AS normalized_title FROM articles")
add("t33_sentences", [], f"SELECT doc_id, len({SPLIT.format('text')}) AS n_sentences, md5(array_to_string({SPLIT.format('text')}, '|')) AS sentences_md5 FROM documents")

# -- relevance ---------------------------------------------------------------------------------------
from .queries import INJECTED  # noqa: E402  (shared test terms, no logic)

add("r1_first_match", [], f"SELECT doc_id, {labels('text', INJECTED)} AS label, {any_sub('text', ['tion', 'ción', 'schen'])} AS has_stem FROM documents")
add("r3_r9_reject_rules", BASE, "SELECT article_id, " + ", ".join(f"{any_sub(x, t)} AS {n}" for n, x, t in [
    ("national_noise", "t_lead", R.NATIONAL_NOISE), ("national_signal", "t_lead", R.NATIONAL_SIGNAL), ("advisory_noise", "t_lead", R.ADVISORY_NOISE),
    ("advisory_impact", "t_all", R.ADVISORY_IMPACT), ("legal_followup", "t_lead", R.LEGAL_FOLLOWUP), ("retraction", "t_lead", R.RETRACTION),
    ("researcher_tool", "t_lead", R.RESEARCHER_TOOL), ("negative_title", "t_title", R.NEGATIVE_TITLE),
    ("unsuccessful_attempt", "t_lead", R.UNSUCCESSFUL_ATTEMPT)]) + " FROM src")
add("r11_r16_evidence_flags", DECIDED,
    "SELECT article_id, f_direct AS direct_attack, f_completed AS completed, f_impact AS impact, f_target AS target, f_active AS active, f_signal AS exploitation FROM flags")
add("r18_relevance", DECIDED, "SELECT article_id, starts_with(decision, '+') AS relevant, decision FROM decided")
add("r19_reject_reasons", DECIDED, "SELECT source_name, decision, count(*) AS n_articles FROM decided WHERE NOT starts_with(decision, '+') GROUP BY ALL")


def remerged(condition: str, base: list[str] = MERGED) -> list[str]:
    """Merge again over the links that meet a condition (the lw table is the input)."""
    return [x if not x.startswith("lw AS") else x + f", lw0 AS (SELECT * FROM lw WHERE {condition})" for x in
            [y.replace("FROM lw GROUP BY event_id", "FROM lw0 GROUP BY event_id") for y in base]]


add("r20_cascade", remerged("NOT contains(title, ' Bank')"),
    "SELECT event_id, source_count, event_status, confidence_score, victim_org_name FROM ev "
    "WHERE event_id IN (SELECT event_id FROM linked WHERE contains(title, ' Bank'))")

# -- extraction --------------------------------------------------------------------------------------
add("e1_e6_victim", VICTIM, "SELECT article_id, victim AS victim_named FROM named")
add("e11_anchor", BASE + anchors("src", "CAST(NULL AS VARCHAR)"), "SELECT article_id, anchor_name, anchor_type FROM anchor")
add("e14_industry_by_name", BASE, f"SELECT article_id, {labels('lower(title)', S.INDUSTRY_BY_NAME)} AS industry FROM articles")
add("e15_e17_industry_by_text", BASE,
    f"SELECT article_id, coalesce({rx_labels('t_lead', S.INDUSTRY_BY_TARGET)}, {labels('t_lead', S.INDUSTRY_KEYWORDS)}, {rx_labels('t_lead', S.ORGANISATION_TYPES)}) AS industry FROM src")
add("e16_industry_keywords", BASE, f"SELECT article_id, {labels('t_lead', S.INDUSTRY_KEYWORDS)} AS industry FROM src")
add("e18_industry", VICTIM, f"SELECT article_id, {industry_sql('victim', 't_lead')} AS industry FROM named")
_PLACE = "SELECT article_id, nullif(split_part(place, '|', 1), '') AS country, nullif(split_part(place, '|', 2), '') AS region FROM placed"
add("e19_e21_geography", BASE + spans_cte("spans", "src") + nation_cte("nations", "src") + [
    f"placed AS (SELECT article_id, coalesce(span_place, {country_of(_no_audience('t_lead'))}, nation_place, '|' || {labels(_no_audience('t_lead'), P.REGION_TERMS)}) AS place "
    "FROM src LEFT JOIN spans USING (article_id) LEFT JOIN nations USING (article_id))"], _PLACE)
add("e20_country", BASE + [f"placed AS (SELECT article_id, {country_of(_no_audience('t_lead'))} AS place FROM src)"], _PLACE)
add("e23_attack_type", BASE + [f"att_in AS (SELECT *, {ATTACK_INPUT} FROM src)"], f"SELECT article_id, {attack_case()} AS attack_type FROM att_in")
add("e24_cve_ids", BASE + [
    f"ids AS (SELECT article_id, list_transform(regexp_extract_all(concat_ws(' ', title, summary, content), {q('(?i)' + N.CVE_ID)}, 1), lambda x: upper(x)) AS l FROM articles)",
    "flat AS (SELECT article_id, unnest(l) AS cve_id, generate_subscripts(l, 1) AS i FROM ids)"],
    "SELECT article_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY min(i)) - 1 AS INT) AS position, cve_id FROM flat GROUP BY article_id, cve_id")
add("e25_extraction", EXTRACTED,
    "SELECT article_id, victim_org_name, victim_org_normalized, victim_display_label, victim_entity_type, industry, region, country, attack_type, event_signal_type, short_event_summary FROM ext")

# -- joins and clustering ----------------------------------------------------------------------------------
_CAND = ("SELECT x.article_id, e.event_id, CAST(CASE WHEN x.victim_org_normalized = e.victim_org_normalized THEN 1.0 ELSE 0.95 END AS DOUBLE) AS match_score "
         "FROM ext x JOIN ev e ON x.victim_org_normalized = e.victim_org_normalized OR x.victim_org_name = e.victim_org_name")
_BEST = f"SELECT article_id, arg_min(event_id, (-match_score) * 1e9 + event_id) AS event_id, max(match_score) AS match_score FROM ({_CAND}) GROUP BY 1"
add("j3_candidates", MERGED, _BEST)
ACRO = MERGED + [
    "acro AS (SELECT event_id, victim_org_name || ' (AC' || (event_id % 7) || ')' AS victim_org_name, country, attack_type FROM ev)",
    f"acro_n AS (SELECT *, {acronym('victim_org_name')} AS acronym FROM acro)",
    "groups AS (SELECT event_id, acronym, country, attack_type, min(event_id) OVER (PARTITION BY acronym, country, attack_type) AS resolved_event_id, "
    "count(*) OVER (PARTITION BY acronym, country, attack_type) AS group_size FROM acro_n WHERE acronym IS NOT NULL AND country <> '' AND attack_type <> '')"]
add("j4_alias_match", ACRO, "SELECT * FROM groups")
add("j7_orphaned_events", CLUSTERED, "SELECT event_id FROM linked GROUP BY 1 HAVING bool_and(source_name = 'unregistered-blog')")
add("c2_match_score", MERGED, _BEST)
add("c3_cluster_assign", CLUSTERED, "SELECT article_id, event_id FROM linked")
add("c5_links", CLUSTERED, "SELECT event_id, article_id, CAST(1.0 AS DOUBLE) AS match_score, is_primary_source FROM linked")
add("c6_primary_evidence", BASE, f"SELECT article_id, {any_sub('t_all', S.PRIMARY_EVIDENCE)} AS is_primary_source FROM src")
add("c7_reconcile", CLUSTERED, "SELECT CASE WHEN ckey IS NULL THEN article_id ELSE min(article_id) OVER (PARTITION BY ckey) END AS event_id, article_id FROM keyed")
add("c9_alias_resolution", ACRO, "SELECT event_id, coalesce(resolved_event_id, event_id) AS resolved_event_id FROM ev LEFT JOIN groups USING (event_id)")

# -- merge -----------------------------------------------------------------------------------------------
add("m1_source_weight", BASE, f"SELECT article_id, {WEIGHT} AS weight, {CLASS_SCORE} AS class_score FROM src")
_ORD, _CORD = "weight DESC, published_at DESC, article_id", "weight DESC, complete DESC, published_at DESC, article_id"
add("m2_rank_sources", MERGED,
    f"SELECT event_id, first(article_id ORDER BY {_ORD}) AS lead_article_id, first(article_id ORDER BY {_CORD}) AS content_article_id, "
    "first(article_id ORDER BY published_at DESC, article_id DESC) AS latest_article_id, max(weight) AS best_weight, max(complete) AS best_completeness FROM lw GROUP BY 1")
add("m4_completeness", EXTRACTED, f"SELECT article_id, {COMPLETE} AS completeness FROM ext")
add("m5_best_fields", MERGED, "SELECT event_id, " + ", ".join(
    f"{best(f)} AS {f}" for f in ("victim_org_name", "industry", "attack_type", "country", "region", "short_event_summary")) + " FROM lw GROUP BY 1")
add("m8_m10_record", MERGED,
    "SELECT event_id, canonical_title, summary_short, region, event_signal_type, victim_org_name, victim_org_normalized, victim_display_label, victim_entity_type, industry, attack_type, country FROM ev")
add("m11_seen_times", MERGED, "SELECT event_id, first_seen_at, last_seen_at FROM ev")
add("m13_status", MERGED, "SELECT event_id, source_count, event_status, confidence_level FROM ev")
add("m14_trust_score", MERGED, "SELECT event_id, source_count, best_class_score, has_primary_evidence, confidence_score FROM ev")
add("m16_high_impact", MERGED, "SELECT event_id, event_signal_type, is_high_impact FROM ev")
add("m17_final_impact", ATTRIBUTED, "SELECT event_id, is_high_impact FROM att")
_ACTIVE = "source_name NOT IN ('bleepingcomputer', 'ncsc-uk')"
add("m18_zombie_events", MERGED + [
    f"za AS (SELECT event_id, count(*) AS source_count, max(cscore) AS cs, bool_or(is_primary_source) AS pe, "
    f"first(victim_org_name ORDER BY {_ORD}) FILTER (WHERE {_ACTIVE} AND victim_org_name IS NOT NULL) AS vn, "
    f"coalesce(first(attack_type ORDER BY {_ORD}) FILTER (WHERE {_ACTIVE} AND attack_type <> 'Unknown'), first(attack_type ORDER BY article_id)) AS attack_type, "
    "coalesce(bool_or(signal_kind = 'activity'), false) AND NOT coalesce(bool_or(signal_kind = 'incident'), false) AS act "
    f"FROM lw GROUP BY 1 HAVING bool_or({_ACTIVE}))"],
    "SELECT event_id, source_count, CASE WHEN NOT act AND NOT regexp_matches(vn, '(?i)^CVE-\\d{4}-\\d+$') THEN vn END AS victim_org_name, attack_type, "
    "CAST(greatest(CASE WHEN source_count = 1 THEN 25 ELSE 75 + 3 * least(source_count - 2, 3) END, cs, CASE WHEN pe THEN 75 ELSE 0 END) AS DOUBLE) AS confidence_score FROM za")

# -- attribution --------------------------------------------------------------------------------------------
add("a2_alias_occurrences", FOUND, "SELECT event_id, canonical, alias, count(*) AS n_occurrences FROM occ GROUP BY ALL")
add("a2_large_dictionary", MERGED + [
    "cut AS (SELECT article_id, string_split(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(content, ''))), 'acme') AS pc FROM linked)",
    "spots AS (SELECT article_id, unnest(list_transform(range(1, len(pc)), lambda i: {'spot': CAST(list_sum(list_transform(pc[1:i], lambda p: length(p))) AS INT) + 4 * (i - 1), "
    "'before': right(pc[i], 1), 'rest': pc[i + 1]})) AS s FROM cut)",
    "spotted AS (SELECT article_id, CAST(s.spot AS INT) AS place, s.rest AS rest, regexp_extract(s.rest, '^\\d+') AS num FROM spots WHERE NOT regexp_matches(s.before, '[a-z0-9_]')),"
    "crews AS (SELECT n.*, 'Crew ' || c_custkey || ' of the North' AS canonical FROM spotted n JOIN customer ON CAST(c_custkey AS VARCHAR) = num)"],
    "SELECT article_id, place, canonical, 'acme' || num AS alias FROM crews WHERE NOT regexp_matches(substr(rest, length(num) + 1, 1), '[a-z0-9_]') "
    "UNION ALL SELECT article_id, place, canonical, 'ACME' || num || ' Bank' FROM crews WHERE regexp_matches(substr(rest, length(num) + 1), '^ bank([^a-z0-9_]|$)')")
# The single-word victim test is a test of the event, not of an occurrence.
add("a3_a6_guards", FOUND,
    "SELECT event_id, alias, has_phrase, has_class, near_victim OR len(vw) = 1 AS near_victim, historical, count(*) AS n_occurrences FROM guarded GROUP BY ALL")
add("a8_attribution_status", ATTRIBUTED, "SELECT event_id, actor_name, actor_type, attribution_status FROM att WHERE changed")
add("a9_eligible", MERGED,
    "SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(victim_org_name), '\\w+'))), ' ') AS victim_words FROM ev WHERE event_signal_type = 'incident'")
add("a10_attributed_incidents", ATTRIBUTED,
    "SELECT event_id, victim_org_name, actor_name, actor_type, attribution_status, is_high_impact, considered, changed FROM att")
add("a10_attribution_stats", ATTRIBUTED,
    "SELECT count(*) FILTER (WHERE considered) AS events_considered, count(*) FILTER (WHERE changed) AS events_changed FROM att")
add("a11_blocked_report", ATTRIBUTED + [
    f"firsts AS (SELECT event_id, canonical, alias, first(has_phrase ORDER BY o) AS ph, "
    f"first({rx(f'substr(etext, greatest(o - {A.PHRASE_WINDOW}, 0) + 1, o - greatest(o - {A.PHRASE_WINDOW}, 0))', A.HISTORICAL_MARKER)} ORDER BY o) AS mk "
    "FROM guarded WHERE event_id IN (SELECT event_id FROM att WHERE event_signal_type = 'incident' AND victim_org_name IS NOT NULL AND actor_name IS NULL) GROUP BY 1, 2, 3)"],
    "SELECT event_id, canonical, alias, CASE WHEN NOT ph THEN 'no attribution phrase' WHEN mk THEN 'historical marker' ELSE 'passed guards but not best' END AS reason FROM firsts")

# -- queries over events --------------------------------------------------------------------------------------
_AS_OF = "(SELECT as_of FROM clock)"
add("q2_filtered", ATTRIBUTED,
    "SELECT event_id, industry, attack_type, confidence_score FROM att WHERE industry ILIKE '%tech%' AND attack_type ILIKE 'data_breach' AND confidence_score >= 75")
add("q2_incident_window", ATTRIBUTED,
    f"SELECT event_id, victim_org_name, last_seen_at FROM att WHERE event_signal_type = 'incident' AND victim_org_name IS NOT NULL AND is_high_impact AND last_seen_at BETWEEN {_AS_OF} - INTERVAL 90 DAY AND {_AS_OF}")
_FEED = "ORDER BY CASE WHEN event_signal_type = 'incident' THEN 0 ELSE 1 END, confidence_score DESC, CASE WHEN is_high_impact THEN 0 ELSE 1 END, source_count DESC, last_seen_at DESC, event_id"
add("q3_feed", ATTRIBUTED,
    "SELECT event_id, victim_org_name, confidence_score, is_high_impact, source_count, last_seen_at FROM (SELECT * FROM att WHERE event_signal_type = 'incident' "
    f"AND victim_org_name IS NOT NULL {_FEED} LIMIT 100 OFFSET 50)")
_AGE = f"date_diff('second', last_seen_at, {_AS_OF})"
FACTS = ("facts AS (SELECT event_id, count(DISTINCT source_name) AS distinct_sources, count(*) FILTER (WHERE is_primary_source) AS primary_source_count, "
         "array_to_string(list_sort(list(DISTINCT source_name)), ',') AS source_names FROM linked GROUP BY 1)")
add("q4_feed_payload", ATTRIBUTED + [FACTS],
    "SELECT event_id, canonical_title AS title, summary_short AS summary, victim_org_name AS victim_name, coalesce(victim_display_label, victim_org_name) AS display_entity, "
    "victim_entity_type AS entity_type, nullif(industry, 'Unknown') AS display_context, coalesce(country, region) AS display_location, actor_name AS display_attribution, "
    "industry, country, region, attack_type, actor_name, actor_type, attribution_status, event_signal_type, event_status AS status, is_high_impact AS high_impact, "
    "confidence_level AS confidence, CAST(confidence_score AS INT) AS confidence_score, "
    f"CASE WHEN {_AGE} < 3600 THEN greatest({_AGE} // 60, 1) || 'm ago' WHEN {_AGE} < 86400 THEN ({_AGE} // 3600) || 'h ago' WHEN {_AGE} < 604800 THEN ({_AGE} // 86400) || 'd ago' "
    "ELSE strftime(last_seen_at, '%Y-%m-%d') END AS time_label, last_seen_at AS reference_time, distinct_sources AS source_count, primary_source_count, source_names, "
    "source_names AS publishers FROM att JOIN facts USING (event_id)")
add("q5_event_sources", MERGED,
    "SELECT event_id, article_id, source_name, coalesce(display_label, source_name) AS publisher, title, article_url AS url, published_at, is_primary_source, weight FROM lw")
add("q6_score_factors", ATTRIBUTED + [
    "sf AS (SELECT event_id, count(DISTINCT source_name) AS n, coalesce(bool_or(tier_trusted_alone), false) AS tr, bool_or(is_primary_source) AS st FROM linked GROUP BY 1)",
    "cl AS (SELECT event_id, CASE source_class WHEN 'primary_disclosure' THEN 'primary-source disclosure' WHEN 'official_alert' THEN 'official alert' "
    "WHEN 'exploited_vulnerability' THEN 'known exploited vuln' END AS lb, min(article_id) AS a FROM linked GROUP BY ALL HAVING lb IS NOT NULL)",
    "cls AS (SELECT event_id, list(lb ORDER BY a) AS ls FROM cl GROUP BY 1)"],
    "SELECT event_id, concat_ws('; ', CASE WHEN n >= 2 THEN n || ' sources' ELSE '1 source' END, array_to_string(ls, '; '), "
    "CASE WHEN tr AND ls IS NULL THEN 'tier-1 trusted source' END, CASE WHEN st AND NOT coalesce(list_contains(ls, 'primary-source disclosure'), false) THEN 'primary statement' END, "
    "CASE WHEN actor_name IS NOT NULL AND event_signal_type = 'incident' THEN 'attributed actor' END) AS score_factors FROM sf LEFT JOIN cls USING (event_id) JOIN att USING (event_id)")


def _top(column: str, where: str = "true") -> str:
    return (f"(SELECT {column} FROM att WHERE {where} AND lower({column}) NOT IN ('unknown', 'other') GROUP BY 1 ORDER BY count(*) DESC, lower({column}), {column} LIMIT 1)")


add("q7_summary", ATTRIBUTED,
    f"SELECT count(*) AS total_events, count(*) FILTER (WHERE confidence_score >= 75) AS high_trust_events, count(*) FILTER (WHERE is_high_impact) AS high_impact_events, "
    f"count(*) FILTER (WHERE last_seen_at BETWEEN {_AS_OF} - INTERVAL 1 DAY AND {_AS_OF}) AS new_today_events, count(*) FILTER (WHERE event_status = 'confirmed') AS confirmed_events, "
    f"count(*) FILTER (WHERE event_status = 'emerging') AS emerging_events, {_top('attack_type')} AS top_attack_type, {_top('industry')} AS top_targeted_industry FROM att")
add("q8_top_label", ATTRIBUTED, f"SELECT {_top('attack_type')} AS top_attack_type")
add("q9_top_counts", ATTRIBUTED,
    "SELECT attack_type AS label, count(*) AS n FROM att GROUP BY 1 ORDER BY CASE WHEN lower(label) IN ('unknown', 'other') THEN 1 ELSE 0 END, n DESC, lower(label) LIMIT 5")
add("q10_event_context", ATTRIBUTED,
    "SELECT event_id, CASE WHEN victim_entity_type = 'vulnerability' THEN 'Vulnerability' WHEN victim_entity_type = 'product_or_platform' THEN 'Product / Platform' "
    "WHEN event_signal_type = 'activity' THEN 'Security Activity' WHEN industry <> 'Unknown' THEN industry ELSE 'Other' END AS context FROM att")
_RISING = ("SELECT label, current, previous, current - previous AS delta, previous = 0 AS is_new FROM (SELECT {0} AS label, count(*) FILTER (WHERE {1} BETWEEN {2} - INTERVAL 7 DAY AND {2}) AS current, "
           "count(*) FILTER (WHERE {1} >= {2} - INTERVAL 14 DAY AND {1} < {2} - INTERVAL 7 DAY) AS previous FROM {3} WHERE lower({0}) NOT IN ('unknown', 'other') GROUP BY 1) "
           "WHERE current > 0 ORDER BY delta DESC, current DESC, lower(label) LIMIT 5")
add("q11_rising_attack_types", ATTRIBUTED, _RISING.format("attack_type", "last_seen_at", _AS_OF, "att"))
add("q11_rising_event_types", [], _RISING.format("event_type", "ts", "TIMESTAMP '2024-01-20'", "events"))
add("q12_active_actors", ATTRIBUTED,
    f"SELECT actor_name AS label, count(*) AS n_events FROM att WHERE actor_name IS NOT NULL AND last_seen_at BETWEEN {_AS_OF} - INTERVAL 7 DAY AND {_AS_OF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("q13_source_coverage", ATTRIBUTED,
    "SELECT coalesce(display_label, source_name) AS label, count(DISTINCT event_id) AS n_events, CAST(round_even(count(DISTINCT event_id) / (SELECT greatest(count(*), 1) FROM att "
    "WHERE confidence_score >= 75) * 100, 0) AS INT) AS pct FROM linked WHERE event_id IN (SELECT event_id FROM att WHERE confidence_score >= 75) GROUP BY 1")
add("q14_facets", ATTRIBUTED,
    "SELECT 'industry' AS facet, industry AS value, count(*) AS n_events FROM att WHERE attack_type = 'Ransomware' GROUP BY 2 UNION ALL "
    "SELECT 'attack_type', attack_type, count(*) FROM att WHERE industry = 'Technology' GROUP BY 2")
add("q15_page", ATTRIBUTED, f"SELECT event_id, confidence_score, true AS has_more FROM (SELECT * FROM att {_FEED} LIMIT 25 OFFSET 50)")
add("q16_latest_extractions", EXTRACTED, "SELECT article_id, victim_org_name, attack_type, published_at FROM ext ORDER BY published_at DESC, article_id DESC LIMIT 50")
add("q18_submissions", [LINKS, DOMAINS, *pages_from("(SELECT * FROM links WHERE submission_id % 3 <> 0)"),
    "subs AS (SELECT submission_id, CASE WHEN submission_id % 11 = 0 THEN '' WHEN submission_id % 13 = 0 THEN 'ftp://x/y' ELSE url END AS url FROM links)",
    "landed AS (SELECT url, CASE WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'insufficient_content' END AS st FROM page_state GROUP BY 1)",
    f"sd AS (SELECT s.*, d.source_name, l.st, s.url IN (SELECT url FROM links WHERE submission_id % 17 = 3) AS known FROM subs s "
    f"LEFT JOIN domains d ON d.domain = {_DOMAIN.format('s.url')} LEFT JOIN landed l ON l.url = s.url)"],
    "SELECT submission_id, url, source_name, CASE WHEN url = '' THEN 'url required' WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid url' WHEN known THEN 'already_exists' "
    "WHEN source_name IS NULL THEN 'domain_not_allowed' WHEN st IS NULL THEN 'fetch_failed' WHEN st <> 'ok' THEN 'insufficient_content' ELSE 'ingested' END AS outcome FROM sd")
add("q19_full_pipeline", ATTRIBUTED,
    "SELECT event_id, canonical_title, victim_org_name, attack_type, industry, country, event_signal_type, event_status, confidence_score, actor_name, attribution_status, is_high_impact, source_count FROM att")

# -- data quality ------------------------------------------------------------------------------------------------
_FLAGS = ("CASE WHEN victim_org_name IS NULL THEN '' ELSE concat_ws(', ', CASE WHEN actor_name IS NULL THEN 'NO ACTOR' END, CASE WHEN attack_type = 'Unknown' THEN 'UNKNOWN TYPE' END, "
          "CASE WHEN industry = 'Unknown' THEN 'UNKNOWN IND' END, CASE WHEN country IS NULL AND region IS NULL THEN 'NO GEO' END, CASE WHEN confidence_score < 50 THEN 'LOW SCORE' END) END")
add("d1_quality_flags", ATTRIBUTED, f"SELECT event_id, victim_org_name, victim_org_name IS NOT NULL AS in_feed, {_FLAGS} AS flags FROM att WHERE event_signal_type = 'incident'")
add("d1_flag_counts", ATTRIBUTED,
    f"SELECT flag, count(*) AS n_events FROM (SELECT unnest(string_split({_FLAGS}, ', ')) AS flag FROM att WHERE event_signal_type = 'incident') WHERE flag <> '' GROUP BY 1")
_BAND = "CASE WHEN {0} >= 75 THEN 'high' WHEN {0} >= 50 THEN 'med' ELSE 'low' END"
_FINAL = "least(100, confidence_score + CASE WHEN actor_name IS NOT NULL AND event_signal_type = 'incident' THEN 5 ELSE 0 END)"
add("d2_band_counts", ATTRIBUTED + [
    f"bb AS (SELECT event_status, {_BAND.format('confidence_score')} AS band, count(*) AS n FROM ev GROUP BY ALL)",
    f"ba AS (SELECT event_status, {_BAND.format('(' + _FINAL + ')')} AS band, count(*) AS n FROM att GROUP BY ALL)"],
    "SELECT event_status, band, coalesce(bb.n, 0) AS n_before, coalesce(ba.n, 0) AS n_after FROM bb FULL JOIN ba USING (event_status, band)")
add("d3_rejected_by_source", DECIDED,
    "SELECT source_name, count(*) AS n_articles, count(*) FILTER (WHERE article_id % 3 = 0) AS n_enriched FROM decided WHERE NOT starts_with(decision, '+') GROUP BY 1")
add("d4_suspicious_events", ATTRIBUTED + [
    "why AS (SELECT event_id, 'low_score' AS reason FROM att WHERE event_signal_type = 'incident' AND confidence_score <= 30 UNION ALL "
    "SELECT event_id, 'no_victim' FROM att WHERE victim_org_name IS NULL AND victim_display_label IS NULL UNION ALL "
    "SELECT event_id, 'no_victim_ransomware' FROM att WHERE victim_org_name IS NULL AND attack_type = 'Ransomware' UNION ALL "
    "SELECT event_id, 'same_prefix' FROM att WHERE starts_with(victim_org_name, 'Acme1'))"],
    "SELECT event_id, reason, article_id, source_name FROM why JOIN linked USING (event_id)")
_BOTH = "concat_ws(' ', title, summary)"
add("d5_keyword_drilldown", BASE, " UNION ALL ".join(
    f"SELECT article_id, source_name, {q(k)} AS keyword, CAST(spot AS INT) AS found_at, substr(b, greatest(spot - 40, 1), {80 + len(k)}) AS context FROM "
    f"(SELECT *, {_BOTH} AS b, instr(lower({_BOTH}), {q(k.lower())}) AS spot FROM articles) WHERE spot > 0" for k in ("DDoS", "stolen")))
add("d6_region_backfill", ATTRIBUTED + [
    "dist AS (SELECT event_id, country, CASE WHEN event_id % 3 = 0 THEN 'Georgia' ELSE region END AS old_region FROM att)",
    f"fix AS (SELECT *, CASE WHEN country IS NOT NULL THEN coalesce({region_of('country')}, old_region) WHEN old_region IN {within(P.CANONICAL_REGIONS)} THEN old_region END AS region FROM dist)"],
    "SELECT event_id, country, old_region, region, CASE WHEN old_region IS NOT DISTINCT FROM region THEN 'kept' WHEN country IS NOT NULL THEN 'fixed' ELSE 'cleared' END AS region_change FROM fix")
add("d7_evidence_backfill", CLUSTERED,
    "SELECT event_id, bool_or(is_primary_source) AS has_primary_evidence, count(*) FILTER (WHERE is_primary_source <> (article_id % 2 = 0)) AS n_changed FROM linked GROUP BY 1")
add("d8_changed_victims", EXTRACTED,
    "SELECT article_id, 'Russian' AS old_victim, victim_org_name AS new_victim FROM ext WHERE article_id % 2 = 0 AND victim_org_name IS DISTINCT FROM 'Russian'")
add("d9_filing_text", BASE + [
    f"fl AS (SELECT article_id, published_at, array_to_string(list_transform(string_split(upper(org), ' '), lambda w: CASE WHEN w IN {within(G.TITLE_CASE)} "
    f"OR (regexp_matches(w, '^[A-Z]+$') AND length(w) > 3) THEN {_TITLE} ELSE w END), ' ') AS company FROM articles WHERE source_name = {q(G.FILING_SOURCE)} AND contains(title, ' discloses'))",
    "ft AS (SELECT article_id, company, company || ' discloses breach in SEC 8-K filing' AS title, company || ' disclosed a data breach in a Form 8-K filing with the SEC on ' || "
    f"strftime(published_at, '%Y-%m-%d') || '. {G.FILING_TEMPLATE_MARK} {G.FILING_CLOSING}' AS body FROM fl)"],
    "SELECT article_id, company AS victim_org_name, title, body AS summary, body AS content, lower(title) AS normalized_title FROM ft")
add("d10_clear_victims", ATTRIBUTED + [
    "dv AS (SELECT * REPLACE (CASE event_id % 5 WHEN 0 THEN 'Executive Summary: x' WHEN 1 THEN 'CVE-2024-1' ELSE victim_org_name END AS victim_org_name) FROM att)",
    "df AS (SELECT *, event_id % 5 = 0 AS h, event_id % 5 = 1 AS cv FROM dv)"],
    "SELECT event_id, CASE WHEN NOT h AND NOT cv THEN victim_org_name END AS victim_org_name, CASE WHEN NOT h THEN victim_display_label END AS victim_display_label, "
    "CASE WHEN NOT h THEN actor_name END AS actor_name, h OR cv AS victim_cleared FROM df")
add("d11_filing_cleanup", CLUSTERED,
    f"SELECT event_id, count(*) AS n_links FROM linked WHERE NOT (source_name = {q(G.FILING_SOURCE)} AND article_id % 2 = 1) GROUP BY 1")
add("d12_reset_status", DECIDED + [
    f"st AS (SELECT source_name, CASE WHEN starts_with(decision, '+') AND article_id % 2 = 0 THEN 'clustered' WHEN source_name = {q(G.CATALOGUE_SOURCE)} THEN 'pending' ELSE 'irrelevant' END AS processing_status FROM decided)"],
    "SELECT source_name, processing_status, count(*) AS n_articles FROM st GROUP BY ALL")
add("d13_rebuild_keeping_actors", ATTRIBUTED,
    "SELECT event_id, CASE WHEN victim_org_name IS NOT NULL THEN actor_name END AS actor_name, CASE WHEN victim_org_name IS NOT NULL THEN attribution_status END AS attribution_status, confidence_score FROM att")
AUDIT = BASE + [
    "clock AS (SELECT max(published_at) AS as_of FROM articles)",
    f"recent AS (SELECT *, article_id AS m FROM articles WHERE published_at >= {_AS_OF} - INTERVAL 700 DAY)",
    # field, value before, value after, value returned (null where it says nothing)
    "cells AS (SELECT 'victim_org_name' AS field, CASE WHEN m % 2 = 0 THEN org END AS b, org AS a, org AS r FROM recent UNION ALL "
    "SELECT 'industry', NULL, CASE WHEN m % 5 <> 0 THEN 'Energy' END, NULL FROM recent UNION ALL "
    "SELECT 'country', country, country, CASE WHEN m % 11 = 0 THEN country END FROM recent UNION ALL SELECT 'actor_name', NULL, actor, NULL FROM recent UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}', NULL, NULL, NULL FROM recent" for f in ("attack_type", "actor_type", "attribution_status", "region", "summary_short")) + ")"]
add("d14_enrichment_audit", AUDIT,
    "SELECT field, count(*) FILTER (WHERE b IS NOT NULL AND r IS NULL) AS already, count(*) FILTER (WHERE b IS NULL AND a IS NOT NULL) AS filled, "
    "count(*) FILTER (WHERE b IS NOT NULL AND r IS NOT NULL) AS redundant, count(*) FILTER (WHERE b IS NULL AND a IS NULL) AS blank FROM cells GROUP BY 1")
add("d14_audit_totals", AUDIT,
    "SELECT count(*) AS runs, count(*) FILTER (WHERE m % 2 = 0) AS article_calls, count(*) FILTER (WHERE m % 3 = 0) AS web_calls, count(*) FILTER (WHERE m % 50 = 0) AS failures, "
    "CAST(sum(m % 900) // count(*) AS BIGINT) AS avg_duration_ms FROM recent")
add("d14_audit_usage", AUDIT,
    "SELECT 'article' AS call, 'tokens' AS unit, CAST(sum(m % 100) AS DOUBLE) AS amount FROM recent UNION ALL SELECT 'web', 'tokens', CAST(sum(m % 10) AS DOUBLE) FROM recent "
    "UNION ALL SELECT 'web', 'searches', CAST(count(*) AS DOUBLE) FROM recent")
_STRICT = any_sub("t_title", R.NEGATIVE_TITLE)
add("d15_rule_dry_run", [x.replace(_STRICT, any_sub("t_title", R.NEGATIVE_TITLE + ["phishing", "widget"])) for x in DECIDED],
    "SELECT source_name, count(*) FILTER (WHERE starts_with(decision, '+')) AS n_passed, count(*) FILTER (WHERE NOT starts_with(decision, '+')) AS n_rejected, count(*) AS n_articles FROM decided GROUP BY 1")

# -- streaming ------------------------------------------------------------------------------------------------------
add("x1_stream_dedupe", BASE, "SELECT article_url, min(article_id) AS article_id FROM articles GROUP BY 1")
add("x2_stream_extract", EXTRACTED, "SELECT article_id, victim_org_name, attack_type, industry, country FROM ext")
_OLD = "published_at < TIMESTAMP '1998-06-01'"
ORACLE["x3_incremental_cluster"] = with_ctes(EXTRACTED + [
    CLUSTERED[len(EXTRACTED)],
    f"half AS (SELECT *, CASE WHEN {_OLD} THEN 0 ELSE 1 END AS h FROM keyed)",
    "mk AS (SELECT *, coalesce(max(CASE WHEN kind = 'incident' THEN 1 ELSE 0 END) OVER (PARTITION BY ckey ORDER BY h, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, "
    "lag(kind) OVER (PARTITION BY ckey ORDER BY h, article_id) AS prev FROM half)"],
    "SELECT article_id, CASE WHEN ckey IS NULL THEN article_id ELSE last_value(CASE WHEN had = 0 AND (prev IS NULL OR prev = 'activity') THEN article_id END IGNORE NULLS) OVER "
    "(PARTITION BY ckey ORDER BY h, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS event_id FROM mk")
add("x4_age_cutoff", BASE,
    "SELECT article_id, CASE WHEN floor(date_diff('second', published_at, TIMESTAMP '1997-01-01') / 86400) <= 90 THEN 'young' ELSE 'late' END AS side FROM articles")
add("x5_stream_windows", [],
    "SELECT date_trunc('day', ts) AS window_start, event_type AS label, count(*) AS n_rows FROM events GROUP BY ALL")
add("x5_sliding_windows", [
    "starts AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS window_start)"],
    "SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type AS label, count(*) AS n_rows FROM events JOIN starts ON ts >= window_start AND ts < window_start + INTERVAL 7 DAY GROUP BY ALL")
add("x6_first_last_seen", [], "SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY 1")

# -- landed feeds -------------------------------------------------------------------------------------------------
_FEED_URL = "coalesce(CASE WHEN article_id % 3 > 0 THEN article_url END, CASE WHEN article_id % 7 > 0 THEN article_url END)"
add("s3_feed_entries", BASE,
    f"SELECT {_FEED_URL} AS article_url, source_name, CASE WHEN article_id % 5 = 0 THEN 'Feed' ELSE source_name END AS publisher, trim(title) AS title, "
    f"CASE WHEN source_name <> {q(G.ADVISORY_SOURCE)} THEN trim(summary) || ' & more' WHEN length(trim(regexp_extract(trim(summary) || ' & more', '(.+?[.!?])(?:\\s|$)', 1))) >= 40 "
    "THEN trim(regexp_extract(trim(summary) || ' & more', '(.+?[.!?])(?:\\s|$)', 1)) ELSE trim(title) || ' vulnerability advisory from CISA.' END AS summary, "
    f"published_at, r.ingest_type AS source_type FROM articles LEFT JOIN reg r USING (source_name) WHERE {_FEED_URL} IS NOT NULL")
add("s4_catalogue", BASE,
    "SELECT (SELECT url FROM reg WHERE source_name = " + q(G.CATALOGUE_SOURCE) + ") || '#CVE-2024-' || article_id AS article_url, "
    "trim(org) || ' Mail Code Injection (CVE-2024-' || article_id || ')' AS title, CAST(published_at AS DATE)::TIMESTAMP AS published_at, "
    "CASE WHEN floor(date_diff('second', CAST(published_at AS DATE)::TIMESTAMP, TIMESTAMP '1998-08-02') / 86400) <= 90 THEN 'young' ELSE 'aged' END AS side FROM articles")
_ACCESSION = "lpad(article_id::VARCHAR, 10, '0') || '-24-000001'"
_FILINGS = [
    f"fil AS (SELECT *, {_ACCESSION} AS accession, strftime(published_at, '%Y-%m-%d') AS day, CASE WHEN article_id % 2 = 0 THEN {q(G.US_HINT)} END AS hint, "
    "CASE WHEN article_id % 3 = 0 THEN 'On May 1 an unauthorized actor entered the systems of ' || org || ' and copied files of many customers. "
    f"The company contained the incident and told the authorities.' END AS body FROM articles WHERE source_name = {q(G.FILING_SOURCE)} AND article_id % 11 > 0)",
    "filings AS (SELECT 'https://www.sec.gov/Archives/edgar/data/' || article_id || '/' || replace(accession, '-', '') || '/' || accession || '-index.htm' AS article_url, "
    "org || ' discloses breach in SEC 8-K filing' AS title, coalesce(body, concat_ws(' ', org || ' disclosed a data breach in a Form 8-K filing with the SEC on ' || day || '.', "
    f"{q(G.FILING_TEMPLATE_MARK)}, hint, {q(G.FILING_CLOSING)})) AS opening, CASE WHEN body IS NULL THEN opening ELSE concat_ws(chr(10) || chr(10), "
    f"org || ' — cybersecurity disclosure (8-K, filed ' || day || '):', body, hint, {q(G.FILING_CLOSING)}) END AS content, CAST(day AS TIMESTAMP) AS published_at, source_name FROM fil)"]
add("s5_filings", BASE + _FILINGS, "SELECT article_url, title, opening AS summary, md5(content) AS content_md5, published_at, r.ingest_type AS source_type FROM filings JOIN reg r USING (source_name)")
add("s6_valid_accessions", BASE + _FILINGS, "SELECT accession FROM fil")
add("s11_ingest_to_store", BASE + _FILINGS + [
    f"kev AS (SELECT (SELECT url FROM reg WHERE source_name = {q(G.CATALOGUE_SOURCE)}) || '#CVE-2024-' || article_id AS article_url, "
    "org || ' Mail Code Injection (CVE-2024-' || article_id || ')' AS title, replace(trim(summary), '. ', '.  ') || ' CVE: CVE-2024-' || article_id || ' Vendor: ' || org || ' Product: Mail Catalog version: 7' AS content, CAST(CAST(published_at AS DATE) AS TIMESTAMP) AS published_at, source_name "
    f"FROM articles WHERE source_name = {q(G.CATALOGUE_SOURCE)})",
    f"feeds AS (SELECT {_FEED_URL} AS article_url, trim(title) AS title, CASE WHEN source_name <> {q(G.ADVISORY_SOURCE)} THEN trim(summary) || ' & more' "
    "WHEN length(trim(regexp_extract(trim(summary) || ' & more', '(.+?[.!?])(?:\\s|$)', 1))) >= 40 "
    "THEN trim(regexp_extract(trim(summary) || ' & more', '(.+?[.!?])(?:\\s|$)', 1)) ELSE trim(title) || ' vulnerability advisory from CISA.' END AS content, published_at, source_name "
    f"FROM articles WHERE source_name IN (SELECT source_name FROM reg) AND source_name NOT IN ({q(G.CATALOGUE_SOURCE)}, {q(G.FILING_SOURCE)}) AND {_FEED_URL} IS NOT NULL)",
    "landed AS (SELECT article_url, title, content, published_at, source_name FROM filings UNION ALL SELECT article_url, title, content, published_at, source_name FROM kev "
    "UNION ALL SELECT * FROM feeds)",
    "firsts AS (SELECT article_url, arg_min(source_name, (published_at, source_name, title)) AS source_name, arg_min(title, (published_at, source_name, title)) AS title, "
    "arg_min(content, (published_at, source_name, title)) AS content, min(published_at) AS published_at FROM landed GROUP BY 1)"],
    "SELECT row_number() OVER (ORDER BY published_at, article_url) AS article_id, article_url, source_name, title, md5(content) AS content_md5, published_at FROM firsts")
add("s16_run_row", [], "SELECT true AS success, CAST(NULL AS VARCHAR) AS error, 'attribute,cluster,extract,merge,process' AS stages, true AS in_order")
add("s15_missing_groups", [
    NAMES,
    "export AS (SELECT s_suppkey AS position, CASE WHEN s_suppkey % 5 = 0 THEN 'LockBit' ELSE 'Group ' || (s_suppkey // 2) END AS canonical, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 'ALPHV' ELSE s_name END AS alias FROM supplier)",
    "fresh AS (SELECT * FROM export WHERE lower(canonical) NOT IN (SELECT lower(alias) FROM actor_names) AND lower(alias) NOT IN (SELECT lower(alias) FROM actor_names))"],
    "SELECT arg_min(canonical, position) AS canonical, arg_min(alias, position) AS aliases, 'nation_state' AS actor_type FROM fresh GROUP BY lower(canonical)")
_STATUS = ("CASE WHEN l.article_id IS NOT NULL THEN 'clustered' WHEN starts_with(decision, '+') THEN 'ready_for_extraction' ELSE 'irrelevant' END")
add("q17_forced_stages", CLUSTERED + [
    f"st AS (SELECT d.article_id, {_STATUS} AS s FROM decided d LEFT JOIN linked l USING (article_id))",
    "reads(stage, forced, s) AS (VALUES ('process', false, 'pending'), ('process', true, 'irrelevant'), ('process', true, 'ready_for_extraction'), ('process', true, 'clustered'), "
    "('extract', false, 'ready_for_extraction'), ('extract', true, 'ready_for_extraction'), ('extract', true, 'clustered'), ('cluster', true, 'clustered'))"],
    "SELECT article_id, stage, forced FROM st JOIN reads USING (s)")
add("t2_html_text", [], f"SELECT page_id, md5({clean_html('html')}) AS text_md5 FROM pages")
_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
add("t5_advisory_summary", [
    f"cleaned AS (SELECT doc_id, source, {_SQUEEZED.format(clean_html('text'))} AS t FROM documents)",
    "firsts AS (SELECT doc_id, source, trim(regexp_extract(t, '(.+?[.!?])(?:\\s|$)', 1)) AS f FROM cleaned)"],
    "SELECT doc_id, md5(CASE WHEN length(f) >= 40 THEN f ELSE source || ' vulnerability advisory from CISA.' END) AS summary_md5 FROM firsts")
_CAT = ("cat AS (SELECT article_id, CASE WHEN article_id % 5 > 0 THEN org ELSE '' END AS vendor, CASE article_id % 3 WHEN 0 THEN org WHEN 1 THEN 'Mail' ELSE '' END AS product, "
        "'CVE-2024-' || article_id AS cve FROM articles)")
add("t6_catalogue_title", BASE + [
    _CAT,
    "shown AS (SELECT *, coalesce(nullif(trim(concat_ws(' ', nullif(vendor, ''), CASE WHEN product <> '' AND lower(product) <> lower(vendor) THEN product END)), ''), 'KEV Entry') AS display FROM cat)"],
    "SELECT article_id, display, display || ' ' || CASE article_id % 4 WHEN 0 THEN 'Vulnerability' WHEN 1 THEN 'Code Injection' ELSE 'Overflow' END || ' (' || cve || ')' AS title FROM shown")
add("t7_catalogue_summary", [
    f"dt AS (SELECT doc_id, source, lang, {_SQUEEZED.format('CASE doc_id % 4 WHEN 0 THEN ' + q('') + ' WHEN 1 THEN translate(text, ' + q('.!?') + ', ' + q('') + ') ELSE text END')} AS t FROM documents)",
    "dp AS (SELECT *, regexp_extract_all(t, '(.+?[.!?])(?:\\s|$)', 1) AS p, rtrim(substr(t, 1, 320)) AS cut FROM dt)"],
    "SELECT doc_id, md5(CASE WHEN t = '' THEN source || ' was added to the CISA KEV catalog under ' || lang || '.' WHEN len(p) > 0 THEN trim(array_to_string(p[1:2], '  ')) "
    "WHEN length(t) > 320 THEN rtrim(CASE WHEN contains(cut, ' ') THEN regexp_replace(cut, '(?s) [^ ]*$', '') ELSE cut END, ' ,;:') || '.' ELSE t END) AS summary_md5 FROM dp")
add("t8_catalogue_content", BASE + [_CAT],
    "SELECT article_id, concat_ws(' ', 'Short.', 'CVE: ' || cve, CASE WHEN vendor <> '' THEN 'Vendor: ' || vendor END, CASE WHEN product <> '' THEN 'Product: ' || product END, "
    "'Catalog version: 7') AS content FROM cat")
_HINT = "CASE " + " ".join(f"WHEN i = {q(k)} THEN {q(v)}" for k, v in G.INDUSTRY_HINT.items()) + " ELSE '' END"
add("t11_filing_hints", BASE + [f"sic AS (SELECT article_id, {_SIC} AS i FROM articles)"],
    f"SELECT article_id, {_HINT} AS industry_hint, CASE WHEN article_id % 4 IN (0, 2) THEN {q(G.US_HINT)} ELSE '' END AS state_hint FROM sic")
add("t12_filing_url", BASE, "SELECT article_id, CASE WHEN article_id % 4 > 0 AND article_id % 5 > 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || article_id || '/' || "
    "lpad(article_id::VARCHAR, 10, '0') || '24000001/' || lpad(article_id::VARCHAR, 10, '0') || '-24-000001-index.htm' "
    "ELSE 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || CASE WHEN article_id % 4 = 0 THEN '' ELSE lpad(article_id::VARCHAR, 10, '0') END || '&type=8-K' END AS url FROM articles")
_SECTION = (r"Item\s*1\.05[\.\s]*Material\s+Cybersecurity\s+Incidents?[\.\s]*(.+?)(?:Item\s+\d+\.\d+\b|SIGNATURES?\b|\bPursuant to the requirements\b)")
add("t14_disclosure_excerpt", [
    "fd AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<p>Cover. Item 1.05 Material Cybersecurity Incidents. ' || text || '</p> SIGNATURES None.' "
    "WHEN 1 THEN text || ' The incident was found. ' || text ELSE text END AS d FROM documents)",
    f"ft AS (SELECT doc_id, {_SQUEEZED.format(clean_html('d'))} AS t FROM fd)",
    f"fs AS (SELECT doc_id, trim(regexp_extract(t, {q('(?is)' + _SECTION)}, 1)) AS sec, {SPLIT.format('t')} AS s FROM ft)",
    f"fa AS (SELECT *, list_position(list_transform(s, lambda x: {rx('x', G.DISCLOSURE_TERMS)}), true) AS spot FROM fs)",
    "fb AS (SELECT *, CASE WHEN spot > 0 THEN trim(array_to_string(s[spot:], ' ')) END AS b FROM fa)"],
    "SELECT doc_id, md5(CASE WHEN length(sec) >= 80 THEN sec WHEN length(b) >= 100 THEN b END) AS excerpt_md5 FROM fb")
add("e10_guarded_actor", ATTRIBUTED, "SELECT event_id, CASE WHEN victim_org_name <> '' AND actor_name <> '' THEN actor_name END AS actor_name, "
    "CASE WHEN victim_org_name <> '' AND actor_name <> '' THEN actor_type END AS actor_type, "
    "CASE WHEN victim_org_name <> '' AND actor_name <> '' AND event_id % 3 <> 0 AND attribution_status <> 'unknown' THEN attribution_status END AS attribution_status FROM att")
_KEEPS = "victim_org_name IS NOT NULL AND event_signal_type = 'incident'"
add("m19_kept_actors", MERGED, f"SELECT event_id, CASE WHEN {_KEEPS} THEN 'Group ' || (event_id % 5) END AS actor_name, CASE WHEN {_KEEPS} THEN 'criminal' END AS actor_type, "
    f"CASE WHEN {_KEEPS} THEN 'suspected' END AS attribution_status FROM ev")
_X3 = ORACLE["x3_incremental_cluster"]
_X3_CTES, _, _X3_SELECT = _X3.rpartition("\nSELECT ")
ORACLE["c8_upsert"] = (_X3_CTES + f",\nx3 AS (SELECT {_X3_SELECT})\n"
                       "SELECT d.article_id, event_id, CASE WHEN NOT starts_with(decision, '+') THEN 'irrelevant' WHEN event_id <> d.article_id THEN 'merged' ELSE 'created' END AS event_action "
                       f"FROM decided d LEFT JOIN x3 USING (article_id) WHERE NOT ({_OLD})")
