import hashlib
from collections import defaultdict

from sentrymill.llm import exact_dedup
from tests.llm.conftest import DATA


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs, **options):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs, digest_all=True, **options).collect()), key=repr)
    assert got == brute(rows)


def test_awkward_rows(documents, no_documents):
    check(documents)
    check(no_documents)


def test_whole_table_and_a_full_gate(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(docs)
    check(docs, gate_bits=1, prefix_chars=1)  # nothing is held back, the result is the same


def test_full_content_is_hashed_for_survivors_only(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "abc"), (4, "aa")], "doc_id bigint, text string")
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(docs).collect()}
    assert got[1] and got[4] and got[2] is None and got[3] is None


def test_filter(documents, no_documents):
    kept = exact_dedup.exact_dedup(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10, 11, 11]
    assert exact_dedup.exact_dedup(no_documents).count() == 0


def test_rows_that_share_only_an_id_with_a_copy_stay(spark):
    rows = [(None, "copied"), (5, "copied"), (None, "alone"), (None, "alone too"), (1, "twice"), (9, "twice"), (1, "single")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    assert kept == sorted([(5, "copied"), (None, "alone"), (None, "alone too"), (9, "twice"), (1, "single")], key=repr)
