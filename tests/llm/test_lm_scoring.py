import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.llm import gru, lm_scoring
from tests.llm.conftest import DATA


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute_base(rows):
    counts = Counter(w for i, t in rows if not is_held_out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {(i, t): (is_held_out(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n,
                     sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def check_base(docs, **options):
    got = lm_scoring.lm_scores(docs, **options).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_base(rows)
    want_rows = sorted((repr(i), *want[i, t]) for i, t in rows)
    got_rows = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [w[:5] for w in want_rows] == [g[:5] for g in got_rows]
    assert all(abs(w[5] - g[5]) < 1e-6 * max(1, -w[5]) for w, g in zip(want_rows, got_rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_awkward_rows(documents, no_documents):
    got = check_base(documents, share=50_000)
    same = [r.score for r in got if r.doc_id in (4, 5)]
    assert same[0] == pytest.approx(same[1], rel=1e-5)
    check_base(documents, head=3)  # nearly all words meet their counts in the join
    assert lm_scoring.lm_scores(no_documents).count() == 0
    check_base(documents.filter("doc_id IN (1, 6)").withColumn("doc_id", F.lit(8).cast("bigint")))


def test_held_out_documents_are_likelier_than_under_unigrams(spark):
    """Several workers and rounds; the words unknown to the model are paid for in both."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    total = lm_scoring.lm_scores(docs, share=40_000).filter("held_out").agg(
        F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert total.model / total.n > total.base / total.n + 0.15


def small(seed=1, words=300, size=4000):
    """Texts in which a word decides the next one, so a model that remembers does better than counts."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < size:
        at, text = rng.integers(2, words), []
        for _ in range(rng.integers(1, 60)):
            text.append(at)
            at = 2 + (at * 7 + rng.integers(0, 2)) % (words - 2)
        out.append(np.array([*text, gru.END], np.uint16))
    return out


def test_chances_sum_to_one():
    texts = small()
    counts = np.bincount(np.concatenate(texts), minlength=gru.VOCABULARY)
    flat = gru.train(gru.initial(counts), np.concatenate(texts), lanes=4)
    state = np.tanh(np.random.default_rng(3).normal(size=(1, gru.STATE))).astype(np.float32)
    logs = gru.Model(flat).log_chances(np.repeat(state, gru.VOCABULARY, axis=0), np.arange(gru.VOCABULARY))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    """Backpropagation against differences, over a window with an end of text in it."""
    rng = np.random.default_rng(5)
    flat = gru.initial(np.ones(gru.VOCABULARY)) + rng.normal(0, 0.2, gru.PARAMETERS).astype(np.float32)
    previous = rng.integers(1, 90, (6, 3))
    previous[3, 1] = gru.END
    now = np.concatenate([previous[1:], rng.integers(1, 90, (1, 3))])
    start = rng.normal(0, 0.5, (3, gru.STATE)).astype(np.float32)

    def loss(values):
        model = gru.Model(values)
        _, seen = model.read(previous, start)
        return -float(model.log_chances(seen.states.reshape(-1, gru.STATE), now.reshape(-1)).astype(float).sum())

    gradient = np.zeros(gru.PARAMETERS, np.float32)
    model = gru.Model(flat)
    _, seen = model.read(previous, start)
    back = model.log_chances(seen.states.reshape(-1, gru.STATE), now.reshape(-1), gru.views(gradient))
    model.backward(previous, seen, back.reshape(seen.states.shape), gru.views(gradient))
    for name, part in gru.views(np.arange(gru.PARAMETERS)).items():
        own = part.reshape(-1)
        for i in own[np.argsort(-np.abs(gradient[own]))[:6]]:
            step = np.zeros(gru.PARAMETERS, np.float32)
            step[i] = 5e-3
            assert (loss(flat + step) - loss(flat - step)) / 1e-2 == pytest.approx(gradient[i], rel=0.05, abs=0.02), name


def test_texts_are_scored_alone_and_whole():
    """Neither the lanes nor the windows matter: a text has the score that it has alone."""
    texts = small(2) + [np.append(np.full(5000, 9, np.uint16), np.uint16(gru.END)), np.array([gru.END], np.uint16)]
    flat = gru.train(gru.initial(np.bincount(np.concatenate(texts), minlength=gru.VOCABULARY)), np.concatenate(texts), lanes=4)
    alone = np.array([gru.score(flat, [t])[0] for t in texts])
    for lanes in (1, 3, 200):
        assert np.allclose(gru.score(flat, texts, lanes), alone, rtol=1e-4)
    assert len(gru.score(flat, [])) == 0


def test_memory_beats_counts():
    texts, unseen = small(3, size=60_000), small(4)
    flat = gru.initial(np.bincount(np.concatenate(texts), minlength=gru.VOCABULARY))
    before = gru.score(flat, unseen).sum()
    for _ in range(6):
        flat = gru.train(flat, np.concatenate(texts), lanes=8)
    assert gru.score(flat, unseen).sum() > 0.8 * before
