import re
from collections import Counter

from pyspark.sql import functions as F

from sentrymill.llm import quality
from tests.llm.conftest import DATA


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(docs):
    got = sorted(tuple(r) for r in quality.features(docs).na.fill(-1, ["doc_id"]).select("doc_id", *COUNTS).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, *counts(r.text)) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_counts_of_awkward_texts(documents, no_documents):
    check(documents)
    check(no_documents)


def test_counts_of_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_repeats_that_overlap(spark):
    check(spark.createDataFrame([(1, "a a a a a a"), (2, "a b a b a b c"), (3, "x y z q x y z"), (4, "a a a")], "doc_id bigint, text string"))


def test_em_finds_the_good_rules():
    # Rule 2 votes at random; the other two agree on nearly every document.
    patterns = [((1, 1, 1), 400), ((1, 1, -1), 400), ((-1, -1, 1), 90), ((-1, -1, -1), 90), ((1, -1, 1), 10), ((-1, 1, -1), 10)]
    found = quality.fit(patterns, ["a", "b", "c"])
    assert found.accuracy["a"] > 0.9 and found.accuracy["b"] > 0.9 and found.accuracy["c"] < 0.7
    assert abs(found.said["c", 1]) < 0.2


def test_verdicts_agree_with_labels(spark):
    """Held-out labels: EM never sees them."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    joined = quality.quality(docs).join(labels, "doc_id").filter("NOT base_failed")
    right = joined.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.97


def test_filter_keeps_rows_whole(documents, no_documents):
    kept = quality.quality_filter(documents)
    assert kept.columns == documents.columns
    failed = {r.doc_id for r in quality.quality(documents).filter("NOT kept").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - failed
    assert quality.quality(no_documents).count() == 0 and quality.quality_filter(no_documents).count() == 0
