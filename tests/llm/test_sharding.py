import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sentrymill.llm import sharding
from tests.llm.conftest import DATA


def check(docs, shards=8, slack=0.001):
    got = sharding.shard(docs, shards).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for i, t in (tuple(r) for r in docs.select("doc_id", "text").collect())), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return got, sizes


def test_awkward_rows(documents, no_documents):
    check(documents)
    check(no_documents)


def test_sizes_of_whole_table(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet")
    got, sizes = check(docs)
    mean = sum(sizes.values()) / 8
    assert max(abs(v - mean) for v in sizes.values()) <= 0.002 * mean + max(r.size for r in got)


def test_one_group_of_copies_holds_most_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    _, sizes = check(docs)
    mean = sum(sizes.values()) / 8
    assert max(abs(v - mean) for v in sizes.values()) <= 0.003 * mean


def test_groups_stay_whole_within_the_slack(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 20_000).cast("string")).alias("text"))
    got, _ = check(docs)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    written = sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    assert written.count() == docs.count() and written.select("shard").distinct().count() == 4
