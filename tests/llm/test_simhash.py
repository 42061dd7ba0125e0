import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentrymill.llm import components, simhash
from tests.llm.conftest import DATA


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    values = np.array(list(dict.fromkeys(p for _, p in prints)), np.uint64)
    label = {int(v): int(v) for v in values}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x
    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= radius]:
            label[root(int(w))] = root(int(v))
    least = defaultdict(list)
    for i, p in prints:
        if i is not None:
            least[root(p)].append(i)
    return [(i, f"{p:016x}", min(least[root(p)], default=None)) for i, p in prints]


def check(docs, **options):
    want = brute_components([(i, brute_print(t)) for i, t in (tuple(r) for r in docs.select("doc_id", "text").collect())], 3)
    got = [(r.doc_id, bytes(r.fingerprint).hex(), r.component_id) for r in simhash.near_groups(docs, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_awkward_rows(documents, no_documents):
    check(documents)
    check(no_documents)


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"))


def test_hot_groups_are_cut_into_tiles(spark):
    """Fingerprints that differ in the low blocks only: one group holds them all."""
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64) | (rng.integers(0, 2, 3000).astype(np.uint64) << np.uint64(50)))
    rows = [(bytearray(int(v).to_bytes(8, "big")), int(v).bit_count(), 1) for v in values]
    distinct = spark.createDataFrame(rows, "fingerprint binary, ones int, shingles bigint")
    want = {f: c for _, f, c in brute_components(list(enumerate(map(int, values))), 3)}
    for tile in (100, 100_000):
        links = simhash.near_links(distinct, simhash.EXACT_RADIUS, tile)
        assert tile < len(values) or links.count() < 4 * len(values)  # a spanning set of each group, not its pairs
        got = {bytes(r.node).hex(): bytes(r.label).hex() for r in components.components(links).collect()}
        groups, wanted = defaultdict(set), defaultdict(set)
        for v in values:
            key = f"{int(v):016x}"
            groups[got.get(key, key)].add(key)
            wanted[want[key]].add(key)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 99), (99, 98)],
                                   [(9, 5), (5, 7), (7, 3), (20, 21), (22, 20)]])
def test_components(spark, links):
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    label = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = label.setdefault(a, a), label.setdefault(b, b)
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert got == label


def test_similar_documents_are_linked_and_others_are_not(spark):
    rng = np.random.default_rng(11)
    rows, base = [], []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((i, " ".join(words)))
        edited = list(words)
        for at in rng.choice(300, 5, replace=False):  # Jaccard similarity of about 0.85
            edited[at] = "changed"
        rows.append((1000 + i, " ".join(edited)))
        base.append(" ".join(words[:100]) + " " + " ".join(f"v{x}" for x in rng.integers(0, 5000, 200)))
    rows += [(2000 + i, t) for i, t in enumerate(base)]  # share a third
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fingerprint string")
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert {i for i in kept if i < 1000} == set(range(60)) and {i for i in kept if i >= 2000} == set(range(2000, 2060))
    assert len([i for i in kept if 1000 <= i < 2000]) <= 2
    assert simhash.near_dedup(docs).columns == docs.columns


def test_linked_texts_join_the_components(spark, tmp_path, monkeypatch):
    """The pairs join what near_groups joins, and the pipeline's near-dedup stage asks for them."""
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    root = {r.doc_id: r.doc_id for r in docs.collect()}
    for r in simhash.linked_texts(docs).collect():
        a, b = root[r.a], root[r.b]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    want = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert root == want and len(set(want.values())) < len(want)
    asked = []
    real = simhash.linked_texts
    monkeypatch.setattr(simhash, "linked_texts", lambda *a, **k: asked.append(1) or real(*a, **k))
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert asked and 0 < out.count() < docs.count()


def test_the_pipeline_drops_what_simhash_links(spark):
    """Texts with near fingerprints and a Jaccard similarity below 0.8 over five-word shingles; op7 puts them into one component."""
    import corpus_pipeline
    from sentrymill.llm.similar_sets import token_sets
    rng, rows = np.random.default_rng(5), []
    for _ in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        other = list(words)
        for at in range(10, 400, 36):
            other[at] = f"v{at}"
        bits, _ = simhash.fingerprints_of([" ".join(words), " ".join(other)], simhash.EXACT_RADIUS)
        a, b = token_sets([" ".join(words).encode(), " ".join(other).encode()])
        both = len(np.intersect1d(a, b))
        if np.bitwise_count(bits[0] ^ bits[1]).sum() <= simhash.EXACT_RADIUS.radius and both < 0.8 * (len(a) + len(b) - both):
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows and {r.component_id for r in simhash.near_groups(docs).collect()} == {i for i, _ in rows[::2]}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {i for i, _ in rows[::2]}
