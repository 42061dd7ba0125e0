import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.plans import pipeline
from sentrymill.sources import actors, landed, store
from sentrymill.sources.registry import source_registry

NOW = datetime(2025, 5, 1, 12)


def write(path, *documents):
    path.write_text("\n".join(json.dumps(d) for d in documents))
    return str(path)


def test_feed_entries(spark, tmp_path):
    path = write(tmp_path / "f.json",
                 dict(link="https://a/1", title="<b>Acme</b> hit", summary="x &amp; y", published="2025-04-30T10:00:00"),
                 dict(id="https://a/2", title="No link", summary=None),
                 dict(link="https://a/3", title="<i></i>"), dict(title="No address"))
    entries = landed.read_feed_entries(spark, path).withColumn("source_name", F.lit("bleepingcomputer"))
    got = {r["article_url"]: r for r in landed.feed_articles(entries, NOW).collect()}
    assert set(got) == {"https://a/1", "https://a/2"}
    one, two = got["https://a/1"], got["https://a/2"]
    assert (one["title"], one["summary"], one["content"], one["publisher"]) == ("Acme hit", "x & y", "x & y", "bleepingcomputer")
    assert (one["source_type"], one["normalized_domain"], one["processing_status"]) == ("rss", "www.bleepingcomputer.com", "pending")
    assert one["published_at"] == datetime(2025, 4, 30, 10) and two["published_at"] == NOW and two["summary"] == ""
    assert one["ingestion_batch_id"] == "20250501120000"


def test_advisory_summaries(spark, tmp_path):
    path = write(tmp_path / "f.json",
                 dict(link="u1", title="ABB X", summary="View CSAF Summary Successful use of this flaw could allow code execution. More."),
                 dict(link="u2", title="ABB Y", summary="Too short."), dict(link="u3", title="ABB Z", summary="no end of sentence in here at all"))
    entries = landed.read_feed_entries(spark, path).withColumn("source_name", F.lit("cisa-alerts-advisories"))
    got = {r["article_url"]: r["summary"] for r in landed.feed_articles(entries, NOW).collect()}
    assert got == {"u1": "Successful use of this flaw could allow code execution.",
                   "u2": "ABB Y vulnerability advisory from CISA.", "u3": "ABB Z vulnerability advisory from CISA."}


def test_catalogue(spark, tmp_path):
    base = dict(cveID="CVE-2025-1", vendorProject="Acme", product="Mail", vulnerabilityName="Acme Mail - Code Injection Vulnerability",
                shortDescription="One. Two! Three.", dateAdded="2025-04-01")
    doc = dict(catalogVersion="7", vulnerabilities=[
        base, {**base, "cveID": "CVE-2025-2", "product": "ACME", "vulnerabilityName": "", "shortDescription": ""},
        {**base, "cveID": "CVE-2025-3", "dateAdded": "2025-01-30"}, {**base, "cveID": "CVE-2025-4", "dateAdded": "2025-01-31"},
        {**base, "cveID": " "}, {**base, "cveID": "CVE-2025-5", "dateAdded": "soon", "shortDescription": "word " * 100, "vendorProject": "", "product": ""}])
    got = {r["title"].split("(")[1][:-1]: r for r in landed.catalogue_articles(landed.read_catalogue(spark, write(tmp_path / "c.json", doc)), NOW).collect()}
    assert set(got) == {f"CVE-2025-{i}" for i in range(1, 6)}
    young, old = landed.split_by_age(landed.catalogue_articles(landed.read_catalogue(spark, str(tmp_path / "c.json")), NOW))
    assert young.count() == 4 and [r["title"][-11:-1] for r in old.collect()] == ["CVE-2025-3"]
    first, second, last = got["CVE-2025-1"], got["CVE-2025-2"], got["CVE-2025-5"]
    assert first["title"] == "Acme Mail Code Injection Vulnerability (CVE-2025-1)" and first["summary"] == "One.  Two!"  # the second match keeps its blank
    assert first["content"] == "One.  Two! CVE: CVE-2025-1 Vendor: Acme Product: Mail Catalog version: 7"
    assert first["article_url"].endswith(".json#CVE-2025-1")
    assert second["title"] == "Acme Vulnerability (CVE-2025-2)"
    assert second["summary"] == "Acme was added to the CISA KEV catalog under CVE-2025-2."
    assert last["title"].startswith("KEV Entry ") and last["published_at"] == NOW
    assert last["summary"].endswith("word.") and len(last["summary"]) <= 320


def hit(adsh, file, items=("1.05",), names=("EQUIFAX INC. (EFX) (CIK 0000033185)",), date="2025-04-20", sics=("7374",), states=("GA",)):
    return dict(_id=f"{adsh}:{file}", _source=dict(display_names=list(names), file_date=date, adsh=adsh, ciks=["0000033185"],
                                                   items=list(items), sics=list(sics), biz_states=list(states)))


def test_filings(spark, tmp_path):
    hits = [hit("0000033185-25-000001", "main.htm"), hit("0000033185-25-000001", "ex99.htm", names=("SECOND HIT",)),
            hit("0000033185-25-000002", "m.htm", items=("9.01",)), hit("0000033185-25-000003", "m.htm", date="2024-01-01"),
            hit("0000033185-25-000004", "m.htm", names=()), hit("0000033185-25-000005", "big.htm", sics=("3317",), states=("X0",))]
    frame = landed.read_filing_hits(spark, write(tmp_path / "h.json", dict(hits=dict(hits=hits))))
    body = "Item 1.05 Material Cybersecurity Incidents On May 1 an unauthorized actor entered our systems. " + "We contained it. " * 8 + "SIGNATURES"
    documents = spark.createDataFrame([("0000033185", "0000033185-25-000001", "main.htm", f"<p>{body}</p>"),
                                       ("0000033185", "0000033185-25-000005", "big.htm", "x" * 750_001)], schema.FILING_DOCUMENTS)
    everything = landed.filing_articles(frame, documents, NOW)
    assert {r["article_url"][-30:-10] for r in everything.collect()} == {f"0000033185-25-00000{i}" for i in (1, 3, 5)}
    young, old = landed.split_by_age(everything)
    assert [r["article_url"][-30:-10] for r in old.collect()] == ["0000033185-25-000003"]
    got = {r["article_url"][-30:-10]: r for r in young.collect()}
    full, template = got["0000033185-25-000001"], got["0000033185-25-000005"]
    assert full["title"] == "Equifax Inc discloses breach in SEC 8-K filing"
    assert full["article_url"] == "https://www.sec.gov/Archives/edgar/data/33185/000003318525000001/0000033185-25-000001-index.htm"
    assert full["summary"].startswith("On May 1") and full["content"].count("\n\n") == 4
    assert "Filer is a technology company." in full["content"] and "based in the United States" in full["content"]
    assert template["content"] == template["summary"] == (
        "Equifax Inc disclosed a data breach in a Form 8-K filing with the SEC on 2025-04-20. Filed in a statement to investors. "
        "Direct primary-source disclosure from the affected company under SEC reporting rules.")
    assert {r[0] for r in landed.valid_accessions(frame).collect()} == {f"0000033185-25-00000{i}" for i in (1, 3, 4, 5)}


def test_ingest_dispatch(spark, tmp_path):
    path = write(tmp_path / "f.json", dict(link="https://a/1", title="Acme hit"))
    got = landed.ingest(spark, {"bleepingcomputer": path, "krebsonsecurity": path}, NOW)
    assert {r["source_name"] for r in got.collect()} == {"bleepingcomputer", "krebsonsecurity"}
    bad = source_registry(spark).withColumn("ingest_type", F.lit("gopher"))
    with pytest.raises(ValueError, match="Unsupported source ingest_type 'gopher'"):
        landed.ingest(spark, {}, NOW, bad)
    assert landed.ingest(spark, {}, NOW).count() == 0


def test_ingest_to_pipeline(spark, tmp_path):
    """Landed feeds run through ids, store and enrichment into the batch pipeline; a failed run is logged too."""
    runs = str(tmp_path / "runs")
    lines = [dict(link=f"https://a/{i}", title=f"Acme{i} Ltd hit by ransomware attack", summary="Hackers stole customer data.", published="2025-04-30T10:00:00")
             for i in range(3)]
    paths = {"bleepingcomputer": write(tmp_path / "f.json", *lines, lines[0])}
    bodies = spark.createDataFrame([("https://a/1", "long body " * 3000)], "article_url string, body string")
    articles, aged = pipeline.collect_articles(spark, paths, NOW, bodies=bodies, max_age_days=90)
    assert articles.count() == 3 and aged.count() == 0
    again, _ = pipeline.collect_articles(spark, paths, NOW, stored=articles)
    assert {r["article_id"] for r in again.collect()} == {r["article_id"] for r in articles.collect()}
    assert max(len(r["content"]) for r in articles.collect()) > 20_000
    result = pipeline.run(articles, runs_path=runs)
    assert result.links.count() == 3 and result.run_row.first()["success"]
    with pytest.raises(Exception):
        pipeline.run(articles.drop("title"), runs_path=runs)
    logged = spark.read.schema(schema.RUNS).parquet(runs).orderBy("started_at").collect()
    assert [(r["success"], r["error"] is None) for r in logged] == [(True, True), (False, False)]


def test_insert_and_enrich(spark):
    stored = spark.createDataFrame([(1, "u1", "rss", "old", False)], "article_id bigint, article_url string, source_type string, content string, content_enriched boolean")
    batch = spark.createDataFrame([(5, "u2", "rss", "five", False), (4, "u2", "rss", "four", False), (6, "u1", "rss", "six", False), (7, "u3", "json", "t", False),
                                   (8, "u4", "rss", "x" * 300, False)], stored.schema)
    table = store.insert_articles(batch, stored)
    assert {r["article_id"] for r in table.collect()} == {1, 4, 7, 8}
    bodies = spark.createDataFrame([("u1", "b" * 6000), ("u2", "short"), ("u3", "c" * 200)], "article_url string, body string")
    done = store.enrich(table, bodies)
    got = {r["article_id"]: (len(r["content"]), r["content_enriched"]) for r in done.collect()}
    assert got == {1: (6000, True), 4: (4, False), 7: (1, False), 8: (300, True)}
    assert tuple(store.enrich_counts(done).first()) == (3, 1)


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    for day, error in ((1, None), (2, None), (3, "boom")):
        store.append_run(store.run_row(spark, datetime(2025, 1, day), datetime(2025, 1, day, 1), {"merge": 1.5}, error), path)
    got = {r["which"]: r["started_at"] for r in store.latest_runs(spark.read.schema(schema.RUNS).parquet(path)).collect()}
    assert got == {"latest": datetime(2025, 1, 3), "latest_success": datetime(2025, 1, 2)}


def test_group_export(spark, tmp_path):
    doc = dict(objects=[dict(type="intrusion-set", name="New  Group", aliases=["New  Group", "NG"]), dict(type="intrusion-set", name="new group", aliases=[]),
                        dict(type="intrusion-set", name="X", aliases=["alphv"]), dict(type="malware", name="M"), dict(type="intrusion-set", name="lockbit")])
    export = actors.read_group_export(spark, write(tmp_path / "g.json", doc))
    got = actors.missing_groups(actors.actor_dictionary(spark), export).collect()
    assert [tuple(r) for r in got] == [("New  Group", ["NG"], "nation_state")]
    path = write(tmp_path / "d.json", dict(position=0, canonical="Solo", actor_type="hacktivist", aliases=["S O"]))
    assert {r["alias"] for r in actors.actor_names(actors.actor_dictionary(spark, path)).collect()} == {"Solo", "S O"}


def test_articles_of_one_row_group_go_to_many_tasks(spark, tmp_path, monkeypatch):
    """A file of more splits than cores, all rows in one row group."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from sentrymill import corpus
    from sentrymill.operators import spread
    from sentrymill.plans import pipeline
    for name in ("orders", "customer", "nation"):
        rows = pq.read_table(f"/root/testdata/sf0.01/{name}.parquet")
        pq.write_table(rows, tmp_path / f"{name}.parquet", row_group_size=rows.num_rows)
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        articles = corpus.articles(spark, str(tmp_path))
        assert spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    processed = spread.staged(pipeline.process(articles), "processed")
    extracted = pipeline.extract(processed)
    for rows in (articles, extracted):
        per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert max(per_task) < 800
    assert articles.count() == pq.read_metadata(tmp_path / "orders.parquet").num_rows
