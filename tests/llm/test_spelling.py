import random
import re
import zlib
from collections import Counter, defaultdict

from sentrymill.llm import gram_index, spelling
from tests.llm.conftest import DATA


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_counts(rows, plant=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if plant and h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """Neighbours by letters left out: equal remains are one edit apart or two."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1:]
            holes[i, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_variants(counts):
    near = brute_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def check(spark, counts, **options):
    words = spark.createDataFrame(sorted(counts.items()), "word string, n bigint")
    assert sorted(tuple(r) for r in spelling.spelling_variants(words, **options).collect()) == brute_variants(counts)


def test_counts_of_awkward_rows(documents, no_documents):
    docs = documents.union(documents).union(documents)
    for plant in (True, False):
        got = {r.word: r.n for r in spelling.word_counts(docs, plant=plant).collect()}
        assert got == brute_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plant)
    assert spelling.spelling_variants(spelling.word_counts(no_documents)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    got = spelling.spelling_variants(spelling.word_counts(docs, plant=True))
    want = brute_variants(brute_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == want


def dense_words(seed, many):
    """Words of few letters, so that nearly all have near ones, and words with a common beginning or ending."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(many)}
    words |= {"inter" + "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 5))) for _ in range(many)}
    words |= {"".join(rng.choice("stuvwxyz") for _ in range(rng.randrange(2, 5))) + "ation" for _ in range(many)}
    return {w: rng.choice((5, 6, 7, 30, 200, 1000)) for w in words}


def test_every_dictionary_gives_the_same(spark):
    counts = dense_words(1, 400)
    check(spark, counts)
    check(spark, counts, prune_count=0, long_list=0)
    check(spark, counts, prune_count=1000, long_list=10 ** 9)
    check(spark, counts, prune_count=3, max_grams=40, long_list=20)


def test_no_word_loses_all_its_grams():
    """The theorem behind the index: one edit leaves all but `affected` grams where they are or one place on."""
    rng = random.Random(2)
    words = sorted(dense_words(3, 300))
    counts = gram_index.count_grams(words, 4)
    for limit in (0, 5, 60):
        grams = gram_index.GramDictionary({g: n for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > limit})
        for word in words:
            at, letter = rng.randrange(len(word)), rng.choice("abéginrtxyz")
            for other, step in ((word[:at] + letter + word[at + 1:], 0), (word[:at] + letter + word[at:], 1), (word[:at] + word[at + 1:], -1)):
                longest = min(4, min(len(word), len(other)) // 2)
                own, theirs = grams.decompose(word, longest), set(grams.decompose(other, longest))
                stays = [(p, g) for p, g in own if (p, g) in theirs and p + len(g) <= at + (step > 0) or (p + step, g) in theirs and p >= at]
                lost = grams.affected(word, own, longest)
                assert len(stays) >= len(own) - lost
                assert lost < len(own) or len(word) < 2 * longest


def test_chains(spark):
    check(spark, {"abcdefghij": 5, "abcdefghi": 30, "abcdefgh": 200, "abcdefg": 1000, "abcdef": 6000, "zbcdef": 6000, "xyzxyz": 9})
