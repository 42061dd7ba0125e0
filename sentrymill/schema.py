"""Schemas of landed inputs and stored tables."""

# Landed inputs
FEED_ENTRIES = ("source_name string, feed_title string, link string, id string, title string, "
                "summary string, published timestamp_ntz")
CATALOGUE = ("catalogVersion string, vulnerabilities array<struct<cveID:string,vendorProject:string,"
             "product:string,vulnerabilityName:string,shortDescription:string,dateAdded:string>>")
FILING_HITS = ("hits struct<hits:array<struct<_id:string,_source:struct<display_names:array<string>,"
               "file_date:string,adsh:string,ciks:array<string>,items:array<string>,sics:array<string>,"
               "biz_states:array<string>>>>>")
FILING_DOCUMENTS = "cik string, accession string, filename string, html string"

# Stored tables
RAW_ARTICLES = (
    "article_id bigint, source_type string, source_name string, source_url string, publisher string, "
    "article_url string, title string, normalized_title string, summary string, content string, "
    "normalized_domain string, ingestion_batch_id string, published_at timestamp_ntz, "
    "fetched_at timestamp_ntz, language string, processing_status string, content_enriched boolean")
RUNS = ("started_at timestamp_ntz, finished_at timestamp_ntz, success boolean, "
        "stage_seconds map<string,double>, error string")
AUDIT = (
    "event_id bigint, started_at timestamp_ntz, duration_ms int, article_called boolean, web_called boolean, "
    "fields_before map<string,string>, fields_after map<string,string>, article_returned map<string,string>, "
    "web_returned map<string,string>, article_usage map<string,double>, web_usage map<string,double>, error string")
