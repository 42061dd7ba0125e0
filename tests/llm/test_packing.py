import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sentrymill.llm import packing
from tests.llm.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
ORACLE = Tokenizer.from_file(PATH)


def check(docs, size=2048):
    got = packing.pack_documents(docs, PATH, size).collect()
    want, total = [], 0
    for i, text in (tuple(r) for r in docs.select("doc_id", "text").collect()):
        ids = [*ORACLE.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), size):
            own = ids[k:k + size]
            want.append((i, k // size, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(inside), max(-(-total // size), sum(w[3] > size // 2 for w in want))


def test_special_strings(spark):
    texts = ["hello <|startoftext|> <|endoftext|> world", "x<|endoftext|>y", "<|endoftext|>", "<|ENDOFTEXT|> <|end", "plain words", "\x02 <|startoftext|>"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert ORACLE.encode(texts[0], add_special_tokens=False).ids == [3306, 49406, 49407, 1002]


def test_awkward_rows(documents, no_documents):
    check(documents)
    check(documents, 7)
    assert check(no_documents) == (0, 0)


def test_whole_table_is_packed_tightly(spark):
    made, least = check(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"))
    assert made <= least * 1.02 + 1


LETTERS = list("aAsStTdDlLmMrReEvV'\u2019.,-#1 \n\t\x0b\x1c\x00éÉßüñ\u0130\u0131\u01c4\u01f0\u024f\u0301\u030c\u00aa\u00d7²\u0661日\xa0\u03a3\x02")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=12) | st.text(alphabet=LETTERS[:42], max_size=12) | st.text(max_size=8), max_size=5))
def test_ids_of_any_text(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.word_tokens(PATH).encode(texts)]
    assert got == [ORACLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_with_odd_signs(spark):
    texts = ["a\x02b c \x02 d\x02", "e\u0301 \u0301x .\u201d \xa0y\x1cz", "It's 'twas  d'\u00c9t\u00c9 \u0130 \u03a3\u03a3", "<|endoftext|>x", "don't,stop!!"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = random.Random(5)
    for lengths in ([rng.randint(1, 2048) for _ in range(20_000)], [int(rng.paretovariate(0.8) * 40) % 2048 + 1 for _ in range(30_000)],
                    [700] * 5000 + [10] * 3, [2048] * 100, [1] * 5000, []):
        histogram = np.bincount(np.array(lengths, int), minlength=2049)
        chosen = packing.plan(histogram)
        used = Counter()
        for pattern, count in chosen:
            assert sum(pattern) <= 2048
            for length in pattern:
                used[length] += count
        assert used == Counter(lengths)
        least = max(-(-sum(lengths) // 2048), sum(x > 1024 for x in lengths))
        if lengths and lengths[0] != 700:
            assert sum(c for _, c in chosen) <= least * 1.01 + 1


def test_counts_are_fitted_and_not_negative():
    histogram = np.zeros(11, int)
    histogram[[7, 3, 5]] = 40, 40, 20
    x = packing.fit_counts([(7, 3), (5, 5), (5, 3, 2)], histogram)
    assert (x >= 0).all() and abs(x[0] - 40) < 2 and abs(x[1] - 10) < 2


def test_sequences_hold_the_ids(spark, documents):
    got = [r.ids for r in packing.sequences(documents, PATH, 64).collect()]
    assert all(len(ids) <= 64 for ids in got)
    want = Counter()
    for r in documents.collect():
        want.update([*ORACLE.encode(r.text or "", add_special_tokens=False).ids, 0])
    assert Counter(x for ids in got for x in ids) == want
