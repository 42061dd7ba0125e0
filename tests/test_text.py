import random
import re
import time

from pyspark.sql import functions as F

from sentrymill.functions import text as T


def summaries(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    out = rows.select("id", T.catalogue_summary(F.lit("Vendor"), F.lit("CVE-2024-1"), F.col("text")).alias("s")).orderBy("id").collect()
    return [r["s"] for r in out]


def test_leading_sentences_equal_a_search_from_every_place(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b.", "!", "c?", "d.e", "...", "f"]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for text, got in zip(texts, summaries(spark, texts)):
        parts = re.findall(r".+?[.!?](?=\s|$)", text)
        assert got == (" ".join(parts[:2]).strip() if parts else text)


def test_long_text_without_a_sentence_is_read_once(spark):
    summaries(spark, ["x"])
    began = time.monotonic()
    got = summaries(spark, ["Short. " + "word " * 60_000, "word " * 60_000])
    assert got[0] == "Short." and got[1] == "word " * 62 + "word."
    assert time.monotonic() - began < 10
