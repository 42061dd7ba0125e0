import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np

from sentrymill.llm import runs
from tests.llm.conftest import DATA


def brute_runs(words, min_length=6, min_powers=4):
    """Every maximal stretch of every period, smallest period of equal stretches."""
    numbers = {w: i for i, w in enumerate(set(words))}
    text, found = np.array([numbers[w] for w in words]), {}
    for q in range(1, len(text) // min_powers + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], text[q:] == text[:-q], [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j + q - i >= max(min_length, min_powers * q):
                found.setdefault((i, j + q - i), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = planted(doc_id, text)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def check(docs):
    got = [tuple(r) for r in runs.digests(runs.periodic_runs(runs.plant_runs(docs))).collect()]
    want = [brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_awkward_rows(documents, no_documents):
    check(documents)
    check(no_documents)


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_small_alphabets():
    """Many runs, nested and overlapping, several texts in one array, few grid places at a time."""
    rng = random.Random(5)
    texts = [[bytes([97 + rng.randrange(rng.choice((1, 2, 2, 3)))]) for _ in range(rng.randrange(140))] for _ in range(300)]
    assert runs.find_runs(texts) == [brute_runs(t) for t in texts]
    runs.GRID_PLACES, before = 50, runs.GRID_PLACES
    try:
        assert runs.find_runs(texts[:40]) == [brute_runs(t) for t in texts[:40]]
    finally:
        runs.GRID_PLACES = before
    assert runs.find_runs(texts[:60], 3, 3) == [brute_runs(t, 3, 3) for t in texts[:60]]


def test_long_periods():
    """Extensions far beyond the cover: periods of up to hundreds of words, words of the period repeated or broken once."""
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        unit = [b"%d" % rng.randrange(50) for _ in range(rng.choice((1, 7, 31, 62, 200, 333)))]
        text = [b"x%d" % i for i in range(rng.randrange(40))] + unit * rng.choice((4, 5, 9)) + unit[:rng.randrange(len(unit))]
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = b"broken"
        texts.append(text)
    assert runs.find_runs(texts) == [brute_runs(t) for t in texts]


def test_one_word_many_times():
    assert runs.find_runs([[b"a"] * 30_000]) == [[(0, 30_000, 1)]]


def test_too_short():
    assert runs.find_runs([[b"a"] * 5, [], [b"b"]]) == [[], [], []]


def test_collapse():
    text = b"x a b a b a b a b y".split()
    (found,) = runs.find_runs([text])
    assert found == [(1, 8, 2)] and runs.collapse(text, found) == b"x a b y".split()
