"""Registered queries: one per operator, over the given tables and what is derived from them.

Every entry runs over whole tables.  Tables of the pipeline are built once per
session and data set, as stored tables would be, and shared by the queries that
read them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..functions import matching as M
from ..functions import names as NM
from ..functions import text as T
from ..operators import attribute as AT
from ..operators import cluster as CL
from ..operators import extract as EX
from ..operators import merge as MG
from ..operators import quality as DQ
from ..operators import relevance as RL
from ..operators import serve as SV
from ..operators.spread import checkpoint_root, staged
from ..plans import pipeline
from ..rules import actors as A
from ..rules import registry as G
from ..rules import relevance as R
from ..sources import landed as LD
from ..sources import store as ST
from ..sources.actors import actor_dictionary, actor_names, missing_groups
from ..sources.registry import source_registry, with_source
from ..streaming import incremental as INC
from ..streaming.state import current

c = F.col


class Tables:
    """Pipeline tables of one data set, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return corpus.table(self.spark, self.sf_dir, name)

    @property
    def articles(self) -> DataFrame:
        return corpus.articles(self.spark, self.sf_dir)

    @property
    def sourced(self) -> DataFrame:
        return with_source(self.articles)

    @property
    def texts(self) -> DataFrame:
        return RL.with_texts(self.sourced)

    @cached_property
    def decided(self) -> DataFrame:
        return staged(pipeline.process(self.articles), "decided")

    @cached_property
    def extracted(self) -> DataFrame:
        return staged(pipeline.extract(self.decided), "extracted")

    def extracted_where(self, kept: Column) -> DataFrame:
        """Extraction rows of some articles; others are not extracted for it, unless the session has the whole table."""
        if "extracted" in self.__dict__:
            return self.extracted.filter(kept)
        return pipeline.process_and_extract(self.articles.filter(kept))[1]

    @cached_property
    def linked(self) -> DataFrame:
        return staged(pipeline.link(self.extracted), "linked")

    @cached_property
    def events(self) -> DataFrame:
        return staged(MG.merge_events(self.linked), "events")

    @cached_property
    def attributed(self) -> DataFrame:
        return staged(AT.attribute_events(self.events, self.linked, self.dictionary), "attributed")

    @property
    def dictionary(self) -> DataFrame:
        return actor_dictionary(self.spark)

    @cached_property
    def as_of(self):
        return self.articles.agg(F.max("published_at")).first()[0]


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]):
    QUERIES[build.__name__] = lambda spark, sf_dir: build(tables(spark, sf_dir))
    return build


# -- sources ---------------------------------------------------------------------------------
@query
def s1_source_registry(t):
    return (t.sourced.groupBy("source_name").agg(F.count("*").alias("n_articles"))
            .join(F.broadcast(source_registry(t.spark, active_only=True)), "source_name")
            .select("source_name", "display_label", "source_class", "signal_kind", "ingest_type", "tier",
                    "tier_trusted_alone", "n_articles"))


@query
def s2_registry_lookup(t):
    return t.sourced.select("article_id", "source_name", "display_label", "source_class", "signal_kind")


@query
def s7_page_text(t):
    return LD.page_status(t.table("pages")).select(
        "page_id", "page_title", F.length("body").alias("body_chars"), F.md5("body").alias("body_md5"),
        F.md5("content").alias("content_md5"), F.md5("summary").alias("summary_md5"), "status")


def _link_urls(t):
    """Addresses of the pages with hosts of all kinds put in front."""
    hosts = F.array(*[F.lit(h) for h in ("https://www.bleepingcomputer.com", "http://krebsonsecurity.com",
                                         "https://therecord.media", "https://www.ncsc.gov.uk", "https://www.other.org")])
    return t.table("pages").select(
        c("page_id").alias("submission_id"),
        F.concat(F.get(hosts, (c("page_id") % 5).cast("int")), F.lit("/p/"), (c("page_id") % 100).cast("string")).alias("url"), "html")


@query
def s8_domain_allowlist(t):
    return ST.with_allowed_source(_link_urls(t)).select("submission_id", "domain", "source_name", "domain_status")


@query
def s9_url_dedupe(t):
    stored = t.articles.filter(c("published_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return ST.new_by_url(t.articles, stored).select("article_id", "article_url", "title")


def _enrich_input(t):
    articles = t.sourced.select(
        "article_id", "article_url", "content",
        F.when(c("source_name").isin(G.CATALOGUE_SOURCE, G.FILING_SOURCE), F.lit("other")).otherwise(F.lit("rss")).alias("source_type"),
        (c("article_id") % 7 == 0).alias("content_enriched"))
    # Every article has a body; some are too short, others whole documents.
    bodies = t.articles.join(t.table("documents").select((c("doc_id") * 3).alias("article_id"), "text"), "article_id", "left").select(
        "article_url", F.coalesce("text", F.concat_ws(" ", "title", "summary", "content")).alias("body"))
    return articles, bodies


@query
def s10_enrich_merge(t):
    return ST.enrich(*_enrich_input(t)).select(
        "article_id", "content_enriched", "candidate", "enriched", F.length("content").alias("content_chars"),
        F.md5("content").alias("content_md5"))


@query
def s12_exact_duplicates(t):
    docs = t.table("documents").select(c("doc_id").alias("article_id"), "text")
    return ST.exact_duplicates(docs, "article_id", "text").select("article_id", "is_duplicate", "duplicate_of")


@query
def s12_title_duplicates(t):
    return ST.exact_duplicates(t.articles, "article_id", "title").select("article_id", "is_duplicate", "duplicate_of")


@query
def s13_status_scan(t):
    status = ST.derived_status(t.decided, t.linked.filter(c("event_id") != c("article_id")))
    return ST.stage_input(status, "extract").unionByName(ST.stage_input(status, "cluster", force=True))


@query
def s14_actor_names(t):
    """Names in matching order with the articles that were planted with them."""
    planted = t.articles.groupBy(c("actor").alias("alias")).agg(F.count("*").alias("n_articles"))
    return actor_names(t.dictionary).join(planted, "alias", "left").select(
        "alias", "canonical", "actor_type", "alias_chars", "ord", F.coalesce("n_articles", F.lit(0)).alias("n_articles"))


@query
def s17_latest_run(t):
    """Click-stream rows read as a run log: an error is a failed run, some never finish."""
    runs = t.table("events").select(
        c("ts").alias("started_at"), F.when(c("user_id") % 5 != 0, c("ts") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        (c("event_type") != "error").alias("success"))
    return ST.latest_runs(runs)


@query
def s18_purge(t):
    status = t.decided.select("article_id", "source_name", F.when(c("relevant"), F.lit("clustered")).otherwise(F.lit("irrelevant")).alias("processing_status"))
    return ST.purge(status, ["unregistered-blog"]).groupBy("source_name").agg(F.count("*").alias("n_articles"))


# -- text functions ----------------------------------------------------------------------------
@query
def t1_html_clean(t):
    return t.table("pages").select("page_id", F.md5(T.clean_html(c("html"))).alias("clean_md5"),
                                   F.length(T.clean_html(c("html"))).alias("clean_chars"))


@query
def t3_url_domain(t):
    return t.table("pages").select("page_id", T.url_domain(c("url")).alias("domain"))


@query
def t4_article_payload(t):
    return LD.article_payload(t.articles, F.lit("2002-01-01 10:20:30").cast("timestamp_ntz")).select(
        "article_url", "source_type", "source_name", "publisher", "normalized_title", "content", "normalized_domain",
        "ingestion_batch_id", "published_at", "processing_status").distinct()


@query
def t9_company_case(t):
    shouted = F.when(c("article_id") % 2 == 0, F.upper("org")).otherwise(c("org"))
    name = F.concat(shouted, F.lit(" IBM AT&T HOLDINGS, LLC INC."))
    return t.articles.select("article_id", T.company_case(name).alias("company"))


@query
def t10_sic_industry(t):
    return t.articles.select("article_id", T.sic_industry((c("article_id") % 10000).cast("string")).alias("industry"))


@query
def t13_filing_ids(t):
    digits = F.lpad(c("article_id").cast("string"), 10, "0")
    url = F.when(c("article_id") % 3 == 0, F.concat(F.lit("https://x.gov/a/1/"), digits, F.lit("-24-000123-index.htm"))).when(
        c("article_id") % 3 == 1, F.concat(F.lit("https://x.gov/a/1/"), digits, F.lit("24000123/"))).otherwise(c("article_url"))
    return t.articles.select("article_id", T.filing_accession(url).alias("accession"),
                             T.filing_filename(F.concat("org", F.lit(": "), "source_name")).alias("filename"))


@query
def t15_opening_summary(t):
    return t.table("documents").select("doc_id", F.md5(T.opening_summary(c("text"))).alias("summary_md5"))


@query
def t16_combined_text(t):
    return t.texts.select("article_id", "text_all", "text_lead")


@query
def t18_clean_summary(t):
    return t.articles.select("article_id", T.clean_summary(c("summary")).alias("clean_summary"),
                             T.clean_summary(F.concat(c("content"), F.lit(" And Dr. Who came. No"))).alias("clean_content"))


@query
def t19_short_summary(t):
    return t.articles.select("article_id", T.short_event_summary(c("summary"), c("content")).alias("short_event_summary"))


def _name_inputs(t):
    kinds = F.array(
        F.concat(F.lit(" the "), "org", F.lit(", ")), F.concat(F.lit("software company "), "org"), c("title"),
        F.concat("org", F.lit(". The attack was")), F.concat("org", F.lit(" portal users")), F.lit("cybersecurity firm"),
        F.concat("country", F.lit(" bank")), F.concat(F.lit("Using "), "org"))
    return t.articles.select("article_id", F.get(kinds, (c("article_id") % 8).cast("int")).alias("raw"))


@query
def t20_clean_org(t):
    return _name_inputs(t).select("article_id", "raw", NM.clean_org(c("raw")).alias("name"))


@query
def t21_plausible_org(t):
    return t.articles.select("article_id", "title").filter(NM.plausible_org(c("title")))


@query
def t22_generic_descriptor(t):
    return _name_inputs(t).select("article_id", NM.generic_descriptor(c("raw")).alias("is_generic"))


@query
def t23_normalise_org(t):
    name = F.when(c("article_id") % 2 == 0, F.concat("org", F.lit("'s Holdings & Co-Op GmbH."))).otherwise(c("org"))
    return t.articles.select("article_id", NM.org_key(name).alias("org_key"))


@query
def t24_acronym(t):
    name = F.when(c("article_id") % 3 == 0, F.concat("org", F.lit(" (ACM)"))).when(
        c("article_id") % 3 == 1, F.concat("org", F.lit(" IBM group"))).otherwise(F.concat("org", F.lit(" AB CD")))
    return t.articles.select("article_id", NM.org_acronym(name).alias("acronym"))


@query
def t25_advisory_vendor(t):
    title = F.when(c("article_id") % 2 == 0, c("title")).otherwise(F.upper("title"))
    return t.articles.select("article_id", NM.advisory_vendor(title).alias("vendor"))


@query
def t26_clean_anchor(t):
    return _name_inputs(t).select("article_id", NM.clean_anchor(c("raw")).alias("anchor"))


@query
def t27_country_region(t):
    return t.articles.select("article_id", "country", T.country_region(c("country")).alias("region"))


@query
def t28_taxonomy(t):
    label = F.when(c("article_id") % 4 == 0, F.lit("Hacktivism")).when(c("article_id") % 4 == 1, F.lit("DDoS")).when(
        c("article_id") % 4 == 2, F.lit("Injection"))
    kind = F.when(c("article_id") % 3 == 0, F.lit("campaign")).when(c("article_id") % 3 == 1, F.lit("person"))
    return t.articles.select("article_id", T.normal_attack_type(label).alias("attack_type"), T.normal_anchor_type(kind).alias("anchor_type"))


@query
def t29_blank(t):
    value = F.when(c("article_id") % 4 == 0, F.lit("  ")).when(c("article_id") % 4 == 1, F.lit("Unknown")).when(
        c("article_id") % 4 == 2, F.lit("unknown"))
    return t.articles.select("article_id", M.blank_to_null(value).alias("value"))


@query
def t30_relative_time(t):
    ev = t.table("events")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return ev.filter(c("ts") <= as_of).select("event_id", T.relative_time(c("ts"), as_of).alias("label"))


@query
def t31_trust_band(t):
    score = F.when(c("article_id") % 11 != 0, (c("article_id") % 101).cast("double"))
    return t.articles.select("article_id", T.trust_band(score).alias("band"), T.trust_label(score).alias("label"))


@query
def t32_clean_article(t):
    padded = t.articles.withColumn("title", F.concat(F.lit("  "), "title", F.lit(" ")))
    return ST.clean_articles(padded).select("article_id", "title", "summary", "content", "normalized_title")


@query
def t33_sentences(t):
    return t.table("documents").select("doc_id", F.size(T.sentences(c("text"))).cast("bigint").alias("n_sentences"),
                                       F.md5(F.array_join(T.sentences(c("text")), "|")).alias("sentences_md5"))


# -- landed feeds ------------------------------------------------------------------------------
FETCHED_AT = "2002-01-01 10:20:30"


def _land(t, frame: DataFrame, name: str) -> str:
    path = _scratch(t, name)
    frame.write.json(path)
    return path


def _land_pages(t, frame: DataFrame, name: str) -> str:
    """One JSON document a file: a page of what a source lists, each of a bounded number of articles."""
    path = _scratch(t, name)
    frame.write.partitionBy("page").json(path)
    return path


PAGE_WIDTH = 2000


def _page() -> Column:
    return F.floor(c("article_id") / PAGE_WIDTH).alias("page")


def _feed_lines(t, where=None) -> DataFrame:
    """Articles as feed entries: some without link, some with markup."""
    rows = t.articles if where is None else t.articles.filter(where)
    return rows.select(
        "source_name", F.when(c("article_id") % 5 == 0, F.lit("<i>Feed</i>")).alias("feed_title"),
        F.when(c("article_id") % 3 > 0, c("article_url")).alias("link"), F.when(c("article_id") % 7 > 0, c("article_url")).alias("id"),
        F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.concat("summary", F.lit(" &amp; more")).alias("summary"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published"))


@query
def s3_feed_entries(t):
    entries = LD.read_feed_entries(t.spark, _land(t, _feed_lines(t), "s3"))
    return LD.feed_articles(entries, F.lit(FETCHED_AT).cast("timestamp_ntz")).select(
        "article_url", "source_name", "publisher", "title", "summary", "published_at", "source_type")


@query
def s4_catalogue(t):
    """Catalogue entries from the corpus, one landed document each, and who is young enough."""
    entry = F.struct(
        F.concat(F.lit("CVE-2024-"), c("article_id").cast("string")).alias("cveID"), c("org").alias("vendorProject"), F.lit("Mail").alias("product"),
        F.concat("org", F.lit(" Mail - Code Injection")).alias("vulnerabilityName"), c("summary").alias("shortDescription"),
        F.date_format("published_at", "yyyy-MM-dd").alias("dateAdded"))
    lines = t.articles.select(F.lit("7").alias("catalogVersion"), F.array(entry).alias("vulnerabilities"))
    landed = t.spark.read.schema(LD.schema.CATALOGUE).json(_land(t, lines, "s4"))
    fresh, aged = LD.split_by_age(LD.catalogue_articles(landed, F.lit("1998-08-02 00:00:00").cast("timestamp_ntz")))
    return fresh.select("article_url", "title", "published_at", F.lit("young").alias("side")).unionByName(
        aged.select("article_url", "title", "published_at", F.lit("aged").alias("side")))


def _catalogue_lines(t) -> DataFrame:
    """Articles of the catalogue source, a catalogue per page."""
    own = t.articles.filter(c("source_name") == G.CATALOGUE_SOURCE)
    entry = F.struct(
        F.concat(F.lit("CVE-2024-"), c("article_id").cast("string")).alias("cveID"), c("org").alias("vendorProject"), F.lit("Mail").alias("product"),
        F.lit("Code Injection").alias("vulnerabilityName"), c("summary").alias("shortDescription"),
        F.date_format("published_at", "yyyy-MM-dd").alias("dateAdded"))
    return own.groupBy(_page()).agg(F.lit("7").alias("catalogVersion"), F.collect_list(entry).alias("vulnerabilities"))


def _accession() -> Column:
    return F.concat(F.lpad(c("article_id").cast("string"), 10, "0"), F.lit("-24-000001"))


def _filing_lines(t) -> DataFrame:
    """Articles of the filing source as search hits: some of another item, some found twice."""
    own = t.articles.filter(c("source_name") == G.FILING_SOURCE)
    source = F.struct(
        F.array(F.concat("org", F.lit(" (CIK 0000000001)"))).alias("display_names"), F.date_format("published_at", "yyyy-MM-dd").alias("file_date"),
        _accession().alias("adsh"), F.array(F.lpad(c("article_id").cast("string"), 10, "0")).alias("ciks"),
        F.array(F.when(c("article_id") % 11 == 0, F.lit("9.01")).otherwise(F.lit(G.FILING_ITEM))).alias("items"),
        F.array(F.lit("none")).alias("sics"), F.array(F.when(c("article_id") % 2 == 0, F.lit("CA")).otherwise(F.lit("X0"))).alias("biz_states"))
    first = F.struct(F.concat(_accession(), F.lit(":main.htm")).alias("_id"), source.alias("_source"))
    second = F.struct(F.concat(_accession(), F.lit(":exhibit.htm")).alias("_id"), source.alias("_source"))
    return own.groupBy(_page()).agg(F.struct(F.flatten(F.collect_list(F.array(first, second))).alias("hits")).alias("hits"))


def _filing_documents(t) -> DataFrame:
    """The main document of every third filing, with the section that the excerpt is taken from."""
    own = t.articles.filter((c("source_name") == G.FILING_SOURCE) & (c("article_id") % 3 == 0))
    body = F.concat(F.lit("<h1>FORM 8-K</h1><p>Item 1.05 Material Cybersecurity Incidents</p><p>On May 1 an unauthorized actor entered the systems of "),
                    "org", F.lit(" and copied files of many customers. The company contained the incident and told the authorities.</p><p>SIGNATURES</p>"))
    return own.select(F.lpad(c("article_id").cast("string"), 10, "0").alias("cik"), _accession().alias("accession"),
                      F.lit("main.htm").alias("filename"), body.alias("html"))


@query
def s5_filings(t):
    hits = LD.read_filing_hits(t.spark, _land_pages(t, _filing_lines(t), "s5"))
    return LD.filing_articles(hits, _filing_documents(t), F.lit(FETCHED_AT).cast("timestamp_ntz")).select(
        "article_url", "title", "summary", F.md5("content").alias("content_md5"), "published_at", "source_type")


@query
def s6_valid_accessions(t):
    return LD.valid_accessions(LD.read_filing_hits(t.spark, _land_pages(t, _filing_lines(t), "s6")))


@query
def s11_ingest_to_store(t):
    """Every registered source, by feed, catalogue and filing search, through ingest, ids and store: what the pipeline starts from."""
    feeds = [s[0] for s in G.SOURCES if s[0] not in (G.CATALOGUE_SOURCE, G.FILING_SOURCE)]
    paths = {n: _land(t, _feed_lines(t, c("source_name") == n).drop("source_name"), f"s11-{n}") for n in feeds}
    paths[G.CATALOGUE_SOURCE] = _land_pages(t, _catalogue_lines(t), "s11-catalogue")
    paths[G.FILING_SOURCE] = _land_pages(t, _filing_lines(t), "s11-filings")
    articles, _ = pipeline.collect_articles(t.spark, paths, datetime(2002, 1, 1, 10, 20, 30), documents=_filing_documents(t))
    return articles.select("article_id", "article_url", "source_name", "title", F.md5("content").alias("content_md5"), "published_at")


@query
def s16_run_row(t):
    return pipeline.run(t.articles, t.dictionary).run_row.select(
        "success", "error", F.array_join(F.array_sort(F.map_keys("stage_seconds")), ",").alias("stages"), (c("finished_at") >= c("started_at")).alias("in_order"))


@query
def s15_missing_groups(t):
    """Suppliers as an exported list of groups; some names or aliases are known, names repeat."""
    key = c("s_suppkey")
    export = t.table("supplier").select(
        key.alias("position"), F.when(key % 5 == 0, F.lit("LockBit")).otherwise(F.concat(F.lit("Group "), F.floor(key / 2).cast("string"))).alias("canonical"),
        F.array(F.when(key % 7 == 0, F.lit("ALPHV")).otherwise(c("s_name"))).alias("aliases"))
    return missing_groups(t.dictionary, export).select("canonical", F.array_join("aliases", ",").alias("aliases"), "actor_type")


@query
def q17_forced_stages(t):
    status = ST.derived_status(t.decided, t.linked)
    parts = [ST.stage_input(status, s, force).select("article_id", F.lit(s).alias("stage"), F.lit(force).alias("forced"))
             for s in ("process", "extract", "cluster") for force in (False, True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def t2_html_text(t):
    return t.table("pages").select("page_id", F.md5(T.html_to_text(c("html"))).alias("text_md5"))


@query
def t5_advisory_summary(t):
    text = F.when(c("doc_id") % 2 == 0, F.concat(F.lit(" View CSAF Summary "), "text")).otherwise(c("text"))
    return t.table("documents").select("doc_id", F.md5(T.advisory_summary(c("source"), text)).alias("summary_md5"))


def _catalogue_names(t) -> DataFrame:
    vendor = F.when(c("article_id") % 5 > 0, c("org")).otherwise(F.lit(""))
    product = F.when(c("article_id") % 3 == 0, c("org")).when(c("article_id") % 3 == 1, F.lit("Mail")).otherwise(F.lit(""))
    return t.articles.select("article_id", vendor.alias("vendor"), product.alias("product"), F.concat(F.lit("CVE-2024-"), c("article_id").cast("string")).alias("cve"))


@query
def t6_catalogue_title(t):
    rows = _catalogue_names(t).withColumn("display", T.catalogue_display_name(c("vendor"), c("product")))
    name = F.when(c("article_id") % 4 == 0, F.lit("")).when(c("article_id") % 4 == 1, F.concat("display", F.lit(" - Code  Injection"))).otherwise(F.lit("Overflow"))
    return rows.select("article_id", "display", T.catalogue_title(c("display"), name, c("cve")).alias("title"))


@query
def t7_catalogue_summary(t):
    description = F.when(c("doc_id") % 4 == 0, F.lit("")).when(c("doc_id") % 4 == 1, F.translate("text", ".!?", "")).otherwise(c("text"))
    return t.table("documents").select("doc_id", F.md5(T.catalogue_summary(c("source"), c("lang"), description)).alias("summary_md5"))


@query
def t8_catalogue_content(t):
    return _catalogue_names(t).select("article_id", T.catalogue_content(F.lit("Short."), c("cve"), c("vendor"), c("product"), F.lit("7")).alias("content"))


@query
def t11_filing_hints(t):
    states = F.array(*[F.lit(s) for s in ("GA", "X0", "CA", "")])
    return t.articles.select("article_id", T.industry_hint(T.sic_industry((c("article_id") % 10000).cast("string"))).alias("industry_hint"),
                             T.state_hint(F.get(states, (c("article_id") % 4).cast("int"))).alias("state_hint"))


@query
def t12_filing_url(t):
    cik = F.when(c("article_id") % 4 == 0, F.lit("")).otherwise(F.lpad(c("article_id").cast("string"), 10, "0"))
    accession = F.when(c("article_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lpad(c("article_id").cast("string"), 10, "0"), F.lit("-24-000001")))
    return t.articles.select("article_id", T.filing_url(cik, accession).alias("url"))


@query
def t14_disclosure_excerpt(t):
    """Whole documents as filings: with the section, with a relevant sentence, with neither."""
    section = F.concat(F.lit("<p>Cover. Item 1.05 Material Cybersecurity Incidents. "), "text", F.lit("</p> SIGNATURES None."))
    relevant = F.concat("text", F.lit(" The incident was found. "), "text")
    document = F.when(c("doc_id") % 3 == 0, section).when(c("doc_id") % 3 == 1, relevant).otherwise(c("text"))
    return t.table("documents").select("doc_id", F.md5(T.disclosure_excerpt(document)).alias("excerpt_md5"))


# -- relevance -------------------------------------------------------------------------------
INJECTED = [("article", ["the ", "and "]), ("german", ["der ", "die ", "und "]), ("french", ["les ", "dans"]), ("spanish", ["los ", "que "])]


@query
def r1_first_match(t):
    return t.table("documents").select("doc_id", M.first_label("text", INJECTED).alias("label"),
                                       M.any_substring("text", ["tion", "ción", "schen"]).alias("has_stem"))


@query
def r3_r9_reject_rules(t):
    return t.texts.select(
        "article_id", M.any_substring("text_lead", R.NATIONAL_NOISE).alias("national_noise"),
        M.any_substring("text_lead", R.NATIONAL_SIGNAL).alias("national_signal"),
        M.any_substring("text_lead", R.ADVISORY_NOISE).alias("advisory_noise"),
        M.any_substring("text_all", R.ADVISORY_IMPACT).alias("advisory_impact"),
        M.any_substring("text_lead", R.LEGAL_FOLLOWUP).alias("legal_followup"),
        M.any_substring("text_lead", R.RETRACTION).alias("retraction"),
        M.any_substring("text_lead", R.RESEARCHER_TOOL).alias("researcher_tool"),
        M.any_substring("text_title", R.NEGATIVE_TITLE).alias("negative_title"),
        M.any_substring("text_lead", R.UNSUCCESSFUL_ATTEMPT).alias("unsuccessful_attempt"))


@query
def r11_r16_evidence_flags(t):
    return t.texts.select(
        "article_id", RL.direct_attack("text_lead").alias("direct_attack"),
        M.any_substring("text_all", R.COMPLETED_INCIDENT).alias("completed"), M.any_substring("text_all", R.CONCRETE_IMPACT).alias("impact"),
        M.any_substring("text_all", R.TARGET_CONTEXT).alias("target"), M.matches("text_lead", R.ACTIVE_EXPLOITATION).alias("active"),
        RL.exploitation_signal("text_all").alias("exploitation"))


@query
def r18_relevance(t):
    return RL.with_relevance(t.sourced).select("article_id", "relevant", "decision")


@query
def r19_reject_reasons(t):
    return RL.rejection_report(t.decided)


@query
def r20_cascade(t):
    """Articles that name a bank become irrelevant: their links go, empty events go, others are re-merged."""
    removed = t.linked.filter(F.contains("title", F.lit(" Bank"))).select("article_id")
    kept, _ = CL.drop_articles(t.linked, removed)
    touched = t.linked.join(removed, "article_id", "left_semi").select("event_id").distinct()
    remerged = MG.merge_events(kept.join(touched, "event_id", "left_semi"))
    return remerged.select("event_id", "source_count", "event_status", "confidence_score", "victim_org_name")


# -- extraction -----------------------------------------------------------------------------------
@query
def e1_e6_victim(t):
    return t.decided.select("article_id", "victim_named")


@query
def e11_anchor(t):
    anchor = EX.event_anchor(c("title"), c("summary"), F.lit(None).cast("string"), c("source_name"))
    return t.articles.select("article_id", anchor.alias("a")).select("article_id", c("a.name").alias("anchor_name"), c("a.kind").alias("anchor_type"))


@query
def e14_industry_by_name(t):
    return t.articles.select("article_id", EX.industry_from_name(c("title")).alias("industry"))


@query
def e15_e17_industry_by_text(t):
    return t.texts.select("article_id", EX.industry_from_text("text_lead").alias("industry"))


@query
def e16_industry_keywords(t):
    from ..rules.sectors import INDUSTRY_KEYWORDS
    return t.texts.select("article_id", M.first_label("text_lead", INDUSTRY_KEYWORDS).alias("industry"))


@query
def e18_industry(t):
    return t.decided.select("article_id", EX.industry(c("victim_named"), "text_lead").alias("industry"))


@query
def e19_e21_geography(t):
    return EX.with_place(t.texts, "p").select("article_id", c("p.country").alias("country"), c("p.region").alias("region"))


@query
def e20_country(t):
    return EX.with_place(t.texts, "p", lead_only=True).select("article_id", c("p.country").alias("country"), c("p.region").alias("region"))


@query
def e23_attack_type(t):
    ready = t.texts.withColumn("text_attack", EX.without_defence("text_all"))
    return ready.select("article_id", EX.attack_type("text_all", "text_lead", "text_title", c("signal_kind") == "activity", "text_attack").alias("attack_type"))


@query
def e24_cve_ids(t):
    return EX.article_cves(t.articles)


@query
def e25_extraction(t):
    return t.extracted.select("article_id", *EX.EXTRACTION_COLUMNS)


@query
def e10_guarded_actor(t):
    status = F.when(c("event_id") % 3 == 0, F.lit("unknown")).otherwise(c("attribution_status"))
    return t.attributed.select("event_id", *[v.alias(n) for n, v in EX.guarded_actor(c("victim_org_name"), c("actor_name"), c("actor_type"), status).items()])


# -- joins and clustering ------------------------------------------------------------------------------
@query
def j3_candidates(t):
    return CL.candidate_events(t.extracted, t.events)


@query
def j4_alias_match(t):
    return CL.alias_groups(_acronym_events(t))


def _acronym_events(t):
    """Events whose names carry an acronym, so that aliases exist."""
    name = F.concat("victim_org_name", F.lit(" (AC"), (c("event_id") % 7).cast("string"), F.lit(")"))
    return t.events.select("event_id", name.alias("victim_org_name"), "country", "attack_type")


@query
def j7_orphaned_events(t):
    _, orphaned = CL.drop_articles(t.linked, t.linked.filter(c("source_name") == "unregistered-blog").select("article_id"))
    return orphaned


@query
def c2_match_score(t):
    return CL.best_matches(CL.candidate_events(t.extracted, t.events))


@query
def c3_cluster_assign(t):
    return CL.assign_clusters(CL.with_keys(t.extracted))


@query
def c5_links(t):
    return t.linked.select("event_id", "article_id", "match_score", "is_primary_source")


@query
def c6_primary_evidence(t):
    return t.articles.select("article_id", T.primary_evidence(T.combined_text(c("title"), c("summary"), c("content"))).alias("is_primary_source"))


@query
def c7_reconcile(t):
    """Each article starts as its own event; reconciliation joins those of one key."""
    own = t.extracted.select("article_id", c("article_id").alias("event_id"), "victim_org_name", "victim_org_normalized")
    return CL.reconcile(own.select("event_id", "article_id"), own.select("event_id", "victim_org_name", "victim_org_normalized"))


@query
def c9_alias_resolution(t):
    return CL.resolve_aliases(_acronym_events(t))


# -- merge ----------------------------------------------------------------------------------------------
@query
def m1_source_weight(t):
    return t.sourced.select("article_id", MG.source_weight(c("source_class"), c("tier_trusted_alone")).alias("weight"),
                            MG.class_score(c("source_class"), c("tier_trusted_alone")).alias("class_score"))


@query
def m2_rank_sources(t):
    return MG.source_ranks(t.linked)


@query
def m4_completeness(t):
    return t.extracted.select("article_id", MG.completeness({n: c(n) for n in EX.EXTRACTION_COLUMNS}).alias("completeness"))


@query
def m5_best_fields(t):
    return MG.best_fields(t.linked, ["victim_org_name", "industry", "attack_type", "country", "region", "short_event_summary"])


@query
def m8_m10_record(t):
    return t.events.select("event_id", "canonical_title", "summary_short", "region", "event_signal_type",
                           "victim_org_name", "victim_org_normalized", "victim_display_label", "victim_entity_type",
                           "industry", "attack_type", "country")


@query
def m11_seen_times(t):
    return t.events.select("event_id", "first_seen_at", "last_seen_at")


@query
def m13_status(t):
    return t.events.select("event_id", "source_count", "event_status", "confidence_level")


@query
def m14_trust_score(t):
    return MG.merge_events(t.linked).select("event_id", "source_count", "best_class_score", "has_primary_evidence", "confidence_score")


@query
def m16_high_impact(t):
    return t.events.select("event_id", "event_signal_type", "is_high_impact")


@query
def m17_final_impact(t):
    return t.attributed.select("event_id", "is_high_impact")


@query
def m18_zombie_events(t):
    """Articles of one source turn irrelevant but keep their links."""
    marked = t.linked.withColumn("irrelevant", c("source_name").isin("bleepingcomputer", "ncsc-uk"))
    return MG.merge_events(marked).select("event_id", "source_count", "victim_org_name", "attack_type", "confidence_score")


@query
def m19_kept_actors(t):
    """Every event had an actor before; a merge keeps it on incidents with a victim only."""
    before = t.attributed.withColumns({"actor_name": F.concat(F.lit("Group "), (c("event_id") % 5).cast("string")), "actor_type": F.lit("criminal"),
                                       "attribution_status": F.lit("suspected")}).drop("considered", "changed")
    return MG.merge_events(t.linked, before).select("event_id", "actor_name", "actor_type", "attribution_status")


@query
def c8_upsert(t):
    """Newer articles against links and events of the older ones."""
    old = c("published_at") < F.lit("1998-06-01").cast("timestamp_ntz")
    links = staged(INC.attach_batch(t.extracted_where(old), None), "c8-links")
    events = staged(MG.merge_events(links), "c8-events")
    return INC.upsert_articles(t.articles.filter(~old), links, events, t.dictionary)[2]


# -- attribution --------------------------------------------------------------------------------------------
def _occurrences(t):
    found, _ = AT.scanned_occurrences(t.events, t.linked, AT.prepare_names(t.dictionary))
    return found


@query
def a2_alias_occurrences(t):
    return _occurrences(t).groupBy("event_id", "canonical", "alias").agg(F.count("*").alias("n_occurrences"))


@query
def a2_large_dictionary(t):
    """Names of every customer number, three for each; some of them are the organisations of the articles."""
    number = F.col("c_custkey").cast("string")
    names = t.table("customer").select(
        F.col("c_custkey").cast("int").alias("position"), F.concat(F.lit("Crew "), number, F.lit(" of the North")).alias("canonical"),
        F.lit("cybercriminal").alias("actor_type"),
        F.array(F.concat(F.lit("acme"), number), F.concat(F.lit("ACME"), number, F.lit(" Bank"))).alias("aliases"))
    docs = t.linked.select("article_id", AT.article_text(c("title"), c("summary"), c("content")).alias("doc_text"))
    prepared = AT.prepare_names(names)
    hits = docs.select("article_id", F.explode(AT.name_places(c("doc_text"), prepared)).alias("hit")).select("article_id", c("hit.at").alias("place"), "hit.name_key")
    return hits.join(prepared.table, "name_key").select("article_id", "place", "canonical", "alias")


@query
def a3_a6_guards(t):
    return _occurrences(t).groupBy("event_id", "alias", "has_phrase", "has_class", "near_victim", "historical").agg(F.count("*").alias("n_occurrences"))


@query
def a8_attribution_status(t):
    return t.attributed.filter("changed").select("event_id", "actor_name", "actor_type", "attribution_status")


@query
def a9_eligible(t):
    return AT.eligible_events(t.events).select("event_id", F.array_join(F.array_sort("victim_words"), " ").alias("victim_words"))


@query
def a10_attributed_incidents(t):
    out = AT.attribute_events(t.events, t.linked, t.dictionary)
    return out.select("event_id", "victim_org_name", "actor_name", "actor_type", "attribution_status", "is_high_impact", "considered", "changed")


@query
def a10_attribution_stats(t):
    return AT.attribution_stats(t.attributed)


@query
def a11_blocked_report(t):
    return AT.blocked_report(t.attributed.drop("considered", "changed"), t.linked, t.dictionary, limit=None)


# -- queries over events ---------------------------------------------------------------------------------------
@query
def q2_filtered(t):
    out = SV.filtered_events(t.attributed, t.as_of, industry="%tech%", attack_type="data_breach", time_range=None, high_trust=True)
    return out.select("event_id", "industry", "attack_type", "confidence_score")


@query
def q2_incident_window(t):
    out = SV.filtered_events(t.attributed, t.as_of, time_range="90d", signal_type="incident", high_impact=True)
    return out.select("event_id", "victim_org_name", "last_seen_at")


@query
def q3_feed(t):
    return SV.feed(SV.filtered_events(t.attributed, t.as_of, signal_type="incident"), limit=100, offset=50).select(
        "event_id", "victim_org_name", "confidence_score", "is_high_impact", "source_count", "last_seen_at")


@query
def q4_feed_payload(t):
    return SV.feed_payload(t.attributed, t.linked, t.as_of)


@query
def q5_event_sources(t):
    return SV.event_sources(t.linked)


@query
def q6_score_factors(t):
    return SV.score_factors(t.attributed, t.linked)


@query
def q7_summary(t):
    return SV.summary_cards(t.attributed, t.as_of)


@query
def q8_top_label(t):
    return SV.most_common_label(t.attributed, "attack_type", "top_attack_type")


@query
def q9_top_counts(t):
    return SV.top_counts(t.attributed, "attack_type", 5)


@query
def q10_event_context(t):
    return SV.event_context(t.attributed)


@query
def q11_rising_attack_types(t):
    return SV.rising_attack_types(t.attributed, t.as_of)


@query
def q11_rising_event_types(t):
    """The same trend over the click stream."""
    clicks = t.table("events").select("event_id", c("ts").alias("last_seen_at"), c("event_type").alias("attack_type"))
    return SV.rising_attack_types(clicks, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query
def q12_active_actors(t):
    return SV.active_actors(t.attributed, t.as_of)


@query
def q13_source_coverage(t):
    return SV.source_coverage(SV.filtered_events(t.attributed, t.as_of, high_trust=True), t.linked)


@query
def q14_facets(t):
    return SV.facet_counts(t.attributed, {"industry": "Technology", "attack_type": "Ransomware"})


@query
def q15_page(t):
    return SV.page(t.attributed, 2).select("event_id", "confidence_score", "has_more")


@query
def q16_latest_extractions(t):
    return SV.latest_extractions(t.extracted, 50, "published_at").select("article_id", "victim_org_name", "attack_type", "published_at")


@query
def q18_submissions(t):
    """Submitted addresses against stored ones and landed pages."""
    links = _link_urls(t)
    url = F.when(c("submission_id") % 11 == 0, F.lit("")).when(c("submission_id") % 13 == 0, F.lit("ftp://x/y")).otherwise(c("url"))
    submissions = links.select("submission_id", url.alias("url"))
    stored = links.filter(c("submission_id") % 17 == 3).select(c("url").alias("article_url"))
    pages = LD.page_status(links.filter(c("submission_id") % 3 != 0)).select("url", "status")
    return ST.submission_outcomes(submissions, stored, pages)


@query
def q19_full_pipeline(t):
    """All stages in one run: the record of every event."""
    return pipeline.run(t.articles, t.dictionary).events.select(
        "event_id", "canonical_title", "victim_org_name", "attack_type", "industry", "country", "event_signal_type",
        "event_status", "confidence_score", "actor_name", "attribution_status", "is_high_impact", "source_count")


# -- data quality --------------------------------------------------------------------------------------------------
@query
def d1_quality_flags(t):
    return DQ.quality_flags(t.attributed)


@query
def d1_flag_counts(t):
    return DQ.flag_counts(DQ.quality_flags(t.attributed))


@query
def d2_band_counts(t):
    return DQ.band_changes(t.events, MG.final_trust(t.attributed))


@query
def d3_rejected_by_source(t):
    return DQ.rejected_by_source(t.decided.withColumn("content_enriched", c("article_id") % 3 == 0))


@query
def d4_suspicious_events(t):
    return DQ.suspicious_events(t.attributed, t.linked, victim_prefix="Acme1").select("event_id", "reason", "article_id", "source_name")


@query
def d5_keyword_drilldown(t):
    return DQ.keyword_drilldown(t.articles, ["DDoS", "stolen"])


@query
def d6_region_backfill(t):
    """Regions are disturbed first, so that there is something to repair."""
    region = F.when(c("event_id") % 3 == 0, F.lit("Georgia")).otherwise(c("region"))
    return DQ.rederive_regions(t.attributed.withColumn("region", region)).select("event_id", "country", "old_region", "region", "region_change")


@query
def d7_evidence_backfill(t):
    stale = t.linked.withColumn("is_primary_source", c("article_id") % 2 == 0)
    return DQ.recompute_evidence(stale, T.primary_evidence(T.combined_text(c("title"), c("summary"), c("content")))).groupBy("event_id").agg(
        F.bool_or("is_primary_source").alias("has_primary_evidence"), F.count_if("flag_changed").alias("n_changed"))


@query
def d8_changed_victims(t):
    stored = t.extracted.withColumn("victim_org_name", F.when(c("article_id") % 2 == 0, F.lit("Russian")).otherwise(c("victim_org_name")))
    ready = t.extracted.withColumn("title", F.concat("title", F.lit(" affecting many users")))
    return DQ.changed_victims(stored, ready)


@query
def d9_filing_text(t):
    return DQ.rebuild_filing_text(t.articles.withColumn("title", F.upper("title")).withColumn(
        "title", F.replace("title", F.lit(" DISCLOSES"), F.lit(" discloses"))))


@query
def d10_clear_victims(t):
    name = F.when(c("event_id") % 5 == 0, F.lit("Executive Summary: x")).when(c("event_id") % 5 == 1, F.lit("CVE-2024-1")).otherwise(c("victim_org_name"))
    return DQ.clear_bad_victims(t.attributed.withColumn("victim_org_name", name)).select(
        "event_id", "victim_org_name", "victim_display_label", "actor_name", "victim_cleared")


def _filings(t):
    digits = F.lpad(c("article_id").cast("string"), 10, "0")
    url = F.when(c("source_name") == G.FILING_SOURCE, F.concat(F.lit("https://x.gov/"), digits, F.lit("-24-000001-index.htm"))).otherwise(c("article_url"))
    valid = t.linked.filter(c("article_id") % 2 == 0).select(F.concat(digits, F.lit("-24-000001")).alias("accession"))
    return t.linked.withColumn("article_url", url), valid


@query
def d11_filing_cleanup(t):
    linked, valid = _filings(t)
    articles, links, events = DQ.remove_with_cascade(linked, linked, t.attributed, DQ.stale_filings(linked, valid))
    return links.groupBy("event_id").agg(F.count("*").alias("n_links")).join(events.select("event_id"), "event_id")


@query
def d12_reset_status(t):
    status = t.decided.select("article_id", "source_name", F.when(c("relevant") & (c("article_id") % 2 == 0), F.lit("clustered")).otherwise(F.lit("irrelevant")).alias("processing_status"))
    return DQ.reset_status(status).groupBy("source_name", "processing_status").agg(F.count("*").alias("n_articles"))


@query
def d13_rebuild_keeping_actors(t):
    rebuilt = MG.merge_events(t.linked)
    return DQ.keep_actors(rebuilt, t.attributed).select("event_id", "actor_name", "attribution_status", "confidence_score")


def _audit(t):
    """Audit rows derived from the corpus: states before and after a call."""
    m = c("article_id")

    def state(**fields):
        return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    none = F.lit(None).cast("string")
    return t.articles.select(
        c("article_id").alias("event_id"), c("published_at").alias("started_at"), (m % 900).cast("int").alias("duration_ms"),
        (m % 2 == 0).alias("article_called"), (m % 3 == 0).alias("web_called"),
        state(victim_org_name=F.when(m % 2 == 0, c("org")), industry=F.when(m % 3 == 0, F.lit("unknown")), country=c("country")).alias("fields_before"),
        state(victim_org_name=c("org"), industry=F.when(m % 5 != 0, F.lit("Energy")), country=c("country"), actor_name=c("actor")).alias("fields_after"),
        state(victim_org_name=c("org"), country=F.when(m % 7 == 0, F.lit("Unknown"))).alias("article_returned"),
        state(country=F.when(m % 11 == 0, c("country")), industry=none).alias("web_returned"),
        F.create_map(F.lit("tokens"), (m % 100).cast("double")).alias("article_usage"),
        F.create_map(F.lit("tokens"), (m % 10).cast("double"), F.lit("searches"), F.lit(1.0)).alias("web_usage"),
        F.when(m % 50 == 0, F.lit("timeout")).alias("error"))


@query
def d14_enrichment_audit(t):
    return DQ.audit_fields(_audit(t), t.as_of, 700)


@query
def d14_audit_totals(t):
    return DQ.audit_totals(_audit(t), t.as_of, 700)


@query
def d14_audit_usage(t):
    return DQ.audit_usage(_audit(t), t.as_of, 700)


class StricterRules:
    """A changed rule set for the dry run: more title terms."""
    def __init__(self):
        self.__dict__.update({k: v for k, v in vars(R).items() if k.isupper()})
        self.NEGATIVE_TITLE = R.NEGATIVE_TITLE + ["phishing", "widget"]


@query
def d15_rule_dry_run(t):
    base = t.decided.drop("decision", "relevant")
    return RL.verdict_counts(RL.with_decision(base, StricterRules()))


# -- streaming ----------------------------------------------------------------------------------------------------------
def _scratch(t, name: str) -> str:
    import uuid
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def _table_stream(t, name: str) -> DataFrame:
    """A given table as a file stream; a stream reads a pattern, not one file."""
    return t.spark.readStream.schema(t.table(name).schema).parquet(f"{t.sf_dir.rstrip('/')}/{name}.parque[t]")


def _article_stream(t) -> DataFrame:
    """The corpus as a stream: orders arrive, customers and nations are tables."""
    stream = _table_stream(t, "orders")
    return t.spark.sql(corpus.corpus_text(), orders=stream, customer=t.table("customer"), nation=t.table("nation"))


def _run(t, stream: DataFrame, name: str, **options) -> str:
    out = _scratch(t, name)
    INC.start(stream, out + "-checkpoint", path=out, **options).awaitTermination()
    return out


def _updates(t, stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream in update mode gives."""
    out = _scratch(t, name)
    INC.start(stream, out + "-checkpoint", sink=INC.update_sink(out), mode="update").awaitTermination()
    return t.spark.read.parquet(out)


@query
def x1_stream_dedupe(t):
    """Addresses once each, with the least article that has it."""
    stream = _article_stream(t).select("article_id", "article_url", c("published_at").alias("fetched_at"))
    out = _run(t, INC.first_by_url(stream, "4000 days"), "x1")
    seen = t.spark.read.parquet(out).select("article_url").distinct()
    return _updates(t, INC.least_by_url(stream), "x1-least").groupBy("article_url").agg(F.min("article_id").alias("article_id")).join(
        seen, "article_url")


@query
def x2_stream_extract(t):
    out = _scratch(t, "x2")
    INC.start(_article_stream(t), out + "-checkpoint", sink=INC.extraction_sink(out)).awaitTermination()
    return t.spark.read.parquet(out).select("article_id", "victim_org_name", "attack_type", "industry", "country")


@query
def x3_incremental_cluster(t):
    """Links after two runs of the clustering stream: the older articles land first, then the others."""
    out, landed = _scratch(t, "x3"), _scratch(t, "x3-landed")
    columns = [f.split()[0] for f in INC.FILE_SCHEMA.split(", ")]
    old = c("published_at") < F.lit("1998-06-01").cast("timestamp_ntz")
    articles = t.articles.withColumn("fetched_at", c("published_at")).select(*columns)
    for part in (articles.filter(old), articles.filter(~old)):
        part.write.mode("append").parquet(landed)
        INC.start(INC.article_stream(t.spark, landed), out + "-checkpoint", sink=INC.cluster_sink(out)).awaitTermination()
    return current(t.spark, out, "links").select("article_id", "event_id")


@query
def x4_age_cutoff(t):
    """Both tables of the age-limited stream."""
    out, late = _scratch(t, "x4"), _scratch(t, "x4-late")
    stream = _article_stream(t).withColumn("fetched_at", F.lit("1997-01-01").cast("timestamp_ntz"))
    INC.start(stream, out + "-checkpoint", sink=INC.age_limited_sink(out, late)).awaitTermination()
    return t.spark.read.parquet(out).select("article_id", F.lit("young").alias("side")).unionByName(
        t.spark.read.parquet(late).select("article_id", F.lit("late").alias("side")))


def _last_counts(updates: DataFrame) -> DataFrame:
    """Counts only grow, so the greatest of a window is its last; windows that are still open count too."""
    return updates.groupBy("window_start", "window_end", "label").agg(F.max("n_rows").alias("n_rows"))


@query
def x5_stream_windows(t):
    stream = _table_stream(t, "events").select("event_type", "ts")
    return _last_counts(_updates(t, INC.windowed_counts(stream, "event_type", "ts", "1 day", None, "0 seconds"), "x5")).drop("window_end")


@query
def x5_sliding_windows(t):
    stream = _table_stream(t, "events").select("event_type", "ts")
    return _last_counts(_updates(t, INC.windowed_counts(stream, "event_type", "ts"), "x5-sliding"))


@query
def x6_first_last_seen(t):
    stream = _table_stream(t, "events")
    updates = _updates(t, INC.first_last_seen(stream, "user_id", "ts"), "x6")
    return updates.groupBy("user_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
