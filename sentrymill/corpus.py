"""Derived article corpus over orders, customer and nation.

Sample data for queries and tests: one SQL text that Spark and DuckDB both run
and that yields the same rows on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.spread import dealt

CORPUS_SQL = """
SELECT article_id, source_name, article_url, org, country, actor,
  CASE tpl
    WHEN 0 THEN concat(org, ' confirms data breach affecting customers')
    WHEN 1 THEN concat(org, ' hit by ransomware attack')
    WHEN 2 THEN concat(org, ' discloses breach in SEC 8-K filing')
    WHEN 3 THEN concat('Hackers steal data in attack on ', org)
    WHEN 4 THEN concat('Phishing campaign hits hospitals in ', country)
    WHEN 5 THEN concat('Critical ', org, ' flaw exploited in attacks')
    WHEN 6 THEN concat(org, ' Widget Remote Code Execution Vulnerability (CVE-2024-', CAST(10000 + article_id % 5000 AS VARCHAR(10)), ')')
    WHEN 7 THEN concat('Weekly recap: ', org, ' and more')
    WHEN 8 THEN concat('Former ', org, ' engineer sentenced to prison')
    WHEN 9 THEN concat('DDoS attack on ', country, ' government websites')
    ELSE concat(org, ' was hacked, $4 million stolen from crypto bridge') END AS title,
  CASE CAST(article_id % 3 AS INT)
    WHEN 0 THEN concat('The company said systems were taken offline. ', org, ' is based in ', country, '.')
    WHEN 1 THEN concat('Customer data was accessed by attackers in ', country, ' [...]')
    ELSE 'A short note without detail' END AS summary,
  CASE body
    WHEN 0 THEN concat('The ', actor, ' ransomware gang claimed responsibility for the attack on ', org, '.')
    WHEN 1 THEN concat('Officials confirmed that ', actor, ' hackers breached ', org, ' and deployed malware.')
    WHEN 2 THEN concat('Last year ', actor, ' was linked to a separate case.')
    WHEN 3 THEN concat(actor, ' is mentioned here with nothing else.')
    WHEN 4 THEN CAST(NULL AS VARCHAR(10))
    ELSE concat('Actively exploited. Unauthorized access to ', org, ' was seen by many.') END AS content,
  published_at
FROM (
  SELECT o_orderkey AS article_id,
    CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'the-record-cybercrime' WHEN 1 THEN 'bleepingcomputer'
      WHEN 2 THEN 'krebsonsecurity' WHEN 3 THEN 'the-hacker-news' WHEN 4 THEN 'ncsc-uk'
      WHEN 5 THEN 'cisa-alerts-advisories' WHEN 6 THEN 'cisa-kev' WHEN 7 THEN 'sec-edgar-cyber-8k'
      ELSE 'unregistered-blog' END AS source_name,
    concat('https://news.example.com/a/', CAST(CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR(20))) AS article_url,
    concat('Acme', CAST(o_custkey % 400 AS VARCHAR(10)), CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN ' Inc' WHEN 1 THEN ' Corp' WHEN 2 THEN ' Bank' ELSE '' END) AS org,
    CASE CAST(n_nationkey % 8 AS INT) WHEN 0 THEN 'Germany' WHEN 1 THEN 'Brazil' WHEN 2 THEN 'Japan' WHEN 3 THEN 'Kenya'
      WHEN 4 THEN 'Canada' WHEN 5 THEN 'Australia' WHEN 6 THEN 'Qatar' ELSE 'Armenia' END AS country,
    CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'LockBit 3.0' WHEN 1 THEN 'Play' WHEN 2 THEN 'BlackCat' WHEN 3 THEN 'Qilin' ELSE 'Nobody Known' END AS actor,
    CAST((o_orderkey + 5 * o_custkey) % 11 AS INT) AS tpl,
    CAST((o_orderkey + o_custkey) % 7 AS INT) AS body,
    o_orderdate AS published_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) b
"""

CORPUS_JOIN = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

# Status of a submitted or landed row that the corpus does not model itself.
CORPUS_COLUMNS = (
    "article_id", "source_name", "article_url", "org", "country", "actor", "title",
    "summary", "content", "published_at",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_text() -> str:
    """Corpus statement with its three tables as arguments."""
    return (CORPUS_SQL.replace("FROM orders JOIN", "FROM {orders} AS orders JOIN")
            .replace("JOIN customer ON", "JOIN {customer} AS customer ON")
            .replace("JOIN nation ON", "JOIN {nation} AS nation ON"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the corpus, one row per order."""
    orders = table(spark, sf_dir, "orders")
    # Joined and dealt as keys, before the texts are made.
    joined = (orders.select("o_orderkey", "o_custkey", "o_orderdate")
              .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
              .join(table(spark, sf_dir, "nation").select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey")))
    return spark.sql(CORPUS_SQL.replace(CORPUS_JOIN, "FROM {joined}"), joined=dealt(joined, "o_orderkey", orders.count()))
