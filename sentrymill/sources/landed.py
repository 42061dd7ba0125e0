"""Readers of landed feeds: entries, vulnerability catalogue, filing search, pages.

Fetching is not part of the job; each reader takes a path of landed files (or the
DataFrame read from it) and gives rows of one common article shape.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.matching import extract_first, rstrip, strip
from ..functions.text import (
    advisory_summary, catalogue_content, catalogue_display_name, catalogue_summary, catalogue_title,
    clean_html, company_case, disclosure_excerpt, filing_filename, filing_url, industry_hint,
    opening_summary, sentences, sic_industry, state_hint, url_domain,
)
from ..rules import registry as G
from .registry import source_registry

PAYLOAD_COLUMNS = (
    "source_type", "source_name", "source_url", "publisher", "article_url", "title", "normalized_title",
    "summary", "content", "normalized_domain", "ingestion_batch_id", "published_at", "fetched_at",
    "language", "processing_status",
)


def moment(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def article_payload(rows: DataFrame, fetched_at: datetime | Column, registry: DataFrame | None = None) -> DataFrame:
    """Common article shape with defaults.

    Expects source_name, article_url, title, summary, content, published_at and
    optionally publisher.
    """
    c = F.col
    if registry is None:
        registry = F.broadcast(source_registry(rows.sparkSession))
    known = registry.select("source_name", c("ingest_type").alias("source_type"), c("url").alias("source_url"))
    publisher = F.coalesce(F.nullif("publisher", F.lit("")), "source_name") if "publisher" in rows.columns else c("source_name")
    return rows.join(known, "source_name", "left").select(
        "source_type", "source_name", "source_url", publisher.alias("publisher"), "article_url", "title",
        strip(F.lower("title")).alias("normalized_title"), "summary",
        F.coalesce("content", "summary").alias("content"),
        url_domain(c("source_url")).alias("normalized_domain"),
        F.date_format(moment(fetched_at), "yyyyMMddHHmmss").alias("ingestion_batch_id"),
        F.coalesce(c("published_at"), moment(fetched_at)).alias("published_at"),
        moment(fetched_at).alias("fetched_at"), F.lit("en").alias("language"),
        F.lit("pending").alias("processing_status"))


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FEED_ENTRIES).json(path)


def feed_articles(entries: DataFrame, fetched_at: datetime | Column) -> DataFrame:
    """Feed entries to articles; rows without address or title are dropped."""
    c = F.col
    title = clean_html(c("title"))
    rows = entries.select(
        "source_name", clean_html(F.coalesce(F.nullif("feed_title", F.lit("")), "source_name")).alias("publisher"),
        F.coalesce(F.nullif("link", F.lit("")), F.nullif("id", F.lit(""))).alias("article_url"),
        title.alias("title"),
        F.when(c("source_name") == G.ADVISORY_SOURCE, advisory_summary(title, c("summary")))
        .otherwise(clean_html(c("summary"))).alias("summary"),
        c("published").alias("published_at"))
    rows = rows.filter("article_url is not null and title <> ''").withColumn("content", c("summary"))
    return article_payload(rows, fetched_at)


def young(published: Column, fetched_at: datetime | Column, max_age_days: int = G.MAX_AGE_DAYS) -> Column:
    """At most so many whole days old."""
    return F.floor(F.timestamp_diff("SECOND", published, moment(fetched_at)) / 86400) <= max_age_days


def split_by_age(articles: DataFrame, max_age_days: int = G.MAX_AGE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Articles young enough when they were fetched, and the others for a side table.

    Only the catalogue and filings, which list everything ever published, are cut by age.
    """
    kept = ~F.col("source_name").isin(G.CATALOGUE_SOURCE, G.FILING_SOURCE) | young(F.col("published_at"), F.col("fetched_at"), max_age_days)
    return articles.filter(F.coalesce(kept, F.lit(True))), articles.filter(~F.coalesce(kept, F.lit(True)))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CATALOGUE).option("multiLine", True).json(path)


def catalogue_articles(catalogue: DataFrame, fetched_at: datetime | Column, source: str = G.CATALOGUE_SOURCE,
                       max_age_days: int | None = None) -> DataFrame:
    """Exploited-vulnerability catalogue to articles, one per entry; `max_age_days` limits their age."""
    c = F.col
    rows = catalogue.select("catalogVersion", F.explode("vulnerabilities").alias("v"))

    def part(name: str) -> Column:
        return strip(F.coalesce(c("v." + name), F.lit("")))
    rows = rows.select(
        "catalogVersion", part("cveID").alias("cve"), part("vendorProject").alias("vendor"), part("product").alias("product"),
        part("vulnerabilityName").alias("vulnerability"), clean_html(c("v.shortDescription")).alias("description"),
        F.coalesce(c("v.dateAdded").try_cast("timestamp_ntz"), moment(fetched_at)).alias("published_at"),
    ).filter("cve <> ''")
    rows = rows if max_age_days is None else rows.filter(young(c("published_at"), fetched_at, max_age_days))
    rows = rows.withColumn("display", catalogue_display_name(c("vendor"), c("product")))
    rows = rows.withColumn("summary", catalogue_summary(c("display"), c("cve"), c("description")))
    feed_url = {s[0]: s[5] for s in G.SOURCES}[source]
    return article_payload(rows.select(
        F.lit(source).alias("source_name"), F.lit(G.CATALOGUE_PUBLISHER).alias("publisher"),
        F.concat(F.lit(feed_url + "#"), "cve").alias("article_url"),
        catalogue_title(c("display"), c("vulnerability"), c("cve")).alias("title"), "summary",
        catalogue_content(c("summary"), c("cve"), c("vendor"), c("product"), c("catalogVersion")).alias("content"),
        "published_at"), fetched_at)


def read_filing_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FILING_HITS).option("multiLine", True).json(path)


def valid_accessions(hits: DataFrame) -> DataFrame:
    h = hits.select(F.explode("hits.hits").alias("h")).select("h._source.*")
    return h.filter((F.col("adsh") != "") & F.array_contains("items", G.FILING_ITEM)).select(
        F.col("adsh").alias("accession")).distinct()


def filing_articles(hits: DataFrame, documents: DataFrame, fetched_at: datetime | Column,
                    source: str = G.FILING_SOURCE, max_bytes: int | None = None,
                    max_age_days: int | None = None) -> DataFrame:
    """Filing search hits to articles: one per accession, its first hit.

    `documents` holds landed filing texts.  With `max_bytes` (G.FILING_MAX_BYTES is the
    published limit) larger ones are left out and the article falls back to its
    template.  Filings of any age are kept unless `max_age_days` limits it.
    """
    c = F.col
    rows = hits.select(F.posexplode("hits.hits").alias("position", "h")).select("position", "h._id", "h._source.*")
    rows = rows.filter(
        (F.coalesce(F.size("display_names"), F.lit(0)) > 0) & (c("file_date") != "") & (c("adsh") != "")
        & F.array_contains("items", G.FILING_ITEM))
    rows = rows.groupBy("adsh").agg(F.min_by(
        F.struct("_id", "display_names", "file_date", "ciks", "sics", "biz_states"), "position").alias("h")).select("adsh", "h.*")
    bare = strip(F.regexp_replace(F.get("display_names", F.lit(0)), r"(?U)\s*\([^)]*\)\s*", ""))
    rows = rows.withColumns({
        "company": company_case(strip(F.rtrim(bare, F.lit(".,;:")))),
        "hint_country": state_hint(F.get("biz_states", F.lit(0))),
        "hint_industry": industry_hint(sic_industry(F.get("sics", F.lit(0)))),
        "cik": F.get("ciks", F.lit(0)),
        "filename": filing_filename(c("_id")),
        "published_at": F.coalesce(c("file_date").try_cast("timestamp_ntz"), moment(fetched_at)),
    }).filter("company <> ''")
    rows = rows if max_age_days is None else rows.filter(young(c("published_at"), fetched_at, max_age_days))
    fitting = documents if max_bytes is None else documents.filter(F.octet_length("html") <= max_bytes)
    texts = fitting.select(
        c("cik"), c("accession").alias("adsh"), "filename", disclosure_excerpt(c("html")).alias("body"))
    rows = rows.join(texts, ["cik", "adsh", "filename"], "left")
    template = F.concat_ws(
        " ", F.concat(c("company"), F.lit(" disclosed a data breach in a Form 8-K filing with the SEC on "), c("file_date"), F.lit(".")),
        F.lit(G.FILING_TEMPLATE_MARK), F.nullif("hint_country", F.lit("")), F.nullif("hint_industry", F.lit("")),
        F.lit(G.FILING_CLOSING))
    long_text = F.concat_ws(
        "\n\n", F.concat(c("company"), F.lit(" — cybersecurity disclosure (8-K, filed "), c("file_date"), F.lit("):")),
        c("body"), F.nullif("hint_country", F.lit("")), F.nullif("hint_industry", F.lit("")), F.lit(G.FILING_CLOSING))
    return article_payload(rows.select(
        F.lit(source).alias("source_name"), F.lit(G.FILING_PUBLISHER).alias("publisher"),
        filing_url(c("cik"), c("adsh")).alias("article_url"),
        F.concat(c("company"), F.lit(" discloses breach in SEC 8-K filing")).alias("title"),
        F.coalesce(opening_summary(c("body")), template).alias("summary"),
        F.when(c("body").isNotNull(), long_text).otherwise(template).alias("content"), "published_at"), fetched_at)


def ingest(spark: SparkSession, paths: dict[str, str], fetched_at: datetime | Column,
           registry: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Articles of all active sources that have a landed path, by ingest type.

    Each source is a part of the plan, so the driver walks over the registry, one row
    at a time.  Rows of any age come out; `split_by_age` parts them.
    """
    registry = registry if registry is not None else source_registry(spark)
    parts = []
    for source in registry.filter("active").select("source_name", "ingest_type").toLocalIterator():
        name, kind = source["source_name"], source["ingest_type"]
        if kind not in ("rss", "json", "sec_edgar_cyber") or (kind == "json" and name != G.CATALOGUE_SOURCE):
            raise ValueError(f"Unsupported source ingest_type '{kind}' for source '{name}'")
        if name not in paths:
            continue
        if kind == "rss":
            entries = read_feed_entries(spark, paths[name]).withColumn("source_name", F.lit(name))
            parts.append(feed_articles(entries, fetched_at))
        elif kind == "json":
            parts.append(catalogue_articles(read_catalogue(spark, paths[name]), fetched_at, name))
        else:
            docs = documents if documents is not None else spark.createDataFrame([], schema.FILING_DOCUMENTS)
            parts.append(filing_articles(read_filing_hits(spark, paths[name]), docs, fetched_at, name))
    if not parts:
        return spark.createDataFrame([], schema.RAW_ARTICLES).select(*PAYLOAD_COLUMNS)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


# -- pages ---------------------------------------------------------------------------------
# Parts of a page that carry no article text.
_NO_TEXT = r"(?is)<(script|style|nav|header|footer|aside|table|form|noscript)\b.*?</\1\s*>|<!--.*?-->"


def page_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds page_title, description and body: markup removed, whole text."""
    c = F.col
    html = c(html_col)
    main = F.coalesce(extract_first(html, r"<article\b[^>]*>(.*?)</article\s*>", flags="(?is)"),
                      extract_first(html, r"<body\b[^>]*>(.*?)</body\s*>", flags="(?is)"), html)
    body = clean_html(F.regexp_replace(main, _NO_TEXT, " "))
    meta = extract_first(html, r"<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']*)[\"']", flags="(?is)")
    rows = pages.withColumns({
        "page_title": clean_html(extract_first(html, r"<title\b[^>]*>(.*?)</title\s*>", flags="(?is)")),
        "body": body,
    })
    lead = F.array_join(F.slice(sentences(c("body")), 1, 2), " ")
    return rows.withColumn("description", F.coalesce(F.nullif(clean_html(meta), F.lit("")), lead))


def page_status(pages: DataFrame, max_chars: int | None = None, summary_chars: int | None = None) -> DataFrame:
    """Page texts with their status, article body and summary.

    Both stay whole unless limited (G.BODY_MAX_CHARS and G.SUBMITTED_SUMMARY_CHARS are the published limits).
    """
    def limited(column: str, most: int | None) -> Column:
        return F.col(column) if most is None else F.substring(column, 1, most)
    c = F.col
    enough = (c("page_title") != "") & (F.length("body") >= G.BODY_MIN_CHARS)
    return page_texts(pages).withColumns({
        "status": F.when(enough, F.lit("ok")).otherwise(F.lit("insufficient_content")),
        "content": F.when(enough, strip(limited("body", max_chars))),
        "summary": F.when(enough, limited("description", summary_chars)),
    })
