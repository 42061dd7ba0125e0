import random

from pyspark.sql import functions as F

from sentrymill.operators import attribute as AT

from test_name_trie import brute


def test_long_dictionary_finds_what_a_search_per_name_finds(spark):
    rng = random.Random(5)
    names = list({"".join(rng.choice("ab .-é") for _ in range(rng.randrange(1, 6))).lower() for _ in range(40)})
    names += ["LockBit 3.0", "C++", "#one", "a b a", "Øyx"]
    texts = ["".join(rng.choice("aabB .-é") for _ in range(rng.randrange(0, 50))) for _ in range(60)]
    texts += ["lockbit 3.0, LockBit 3.01", "ØYX xøyx", "c++ C+++ c++x xc++", "#one x#one ##one", "a b a b a b a", ""]
    dictionary = spark.createDataFrame([(i, n, "c", []) for i, n in enumerate(names)], "position int, canonical string, actor_type string, aliases array<string>")
    prepared = AT.prepare_names(dictionary, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    hits = docs.select("t", F.explode(AT.name_places(F.col("text"), prepared)).alias("hit")).select("t", "hit.at", "hit.name_key")
    got = sorted((r["t"], r["at"], names.index(r["alias"])) for r in hits.join(prepared.table, "name_key").collect())
    assert got == sorted(brute(names, texts)) and len(got) > 100
    seen = {r["t"] for r in docs.filter(AT.mentions(F.col("text"), prepared)).collect()}
    assert {t for t, _, _ in got} <= seen


def test_a_longer_dictionary_is_no_more_walks(spark):
    """What a task does with a text grows with the lengths of names, not with their number."""
    def parts(n):
        rows = spark.range(n).select(F.col("id").cast("int").alias("position"), F.format_string("Crew %d of the North", "id").alias("canonical"),
                                     F.lit("c").alias("actor_type"), F.array(F.format_string("acme%d", "id")).alias("aliases"))
        return len(AT.prepare_names(rows, 10).parts)
    assert parts(20) == parts(400) == 3
