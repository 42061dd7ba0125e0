import base64
import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrymill.llm import byte_bpe, pretokens
from tests.llm.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = byte_bpe.vocabulary(PATH)
AWKWARD = ["", "'s", "''s's'", " 's", "x's'll've'vest'r", "  a", "\n\n a\n", "  b \t", "  ", "a  ", "'", "'l", "'ll", "l'lll", "1²3 é", "é́ x",
           "\U0001f600\U0001f600 'T's", " a\x1fb", "<|endoftext|>", "a" * 3000, "ab'" * 999, "'re'r e", "!'s !!'s", " \n'd"]


def boundaries(texts):
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points) + 1, bool)
    first[np.cumsum([0, *map(len, texts)])] = True
    return pretokens.starts(points, first[:-1]).tolist()


def by_regex(texts):
    at, out = 0, []
    for t in texts:
        out += [at + m.start() for m in PATTERN.finditer(t)]
        at += len(t)
    return out


def test_boundaries_of_awkward_texts():
    assert boundaries(AWKWARD) == by_regex(AWKWARD)
    assert boundaries(AWKWARD * 300) == by_regex(AWKWARD * 300)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=list("'stmdrevl aA1 \n\t.é ²́")), max_size=6))
def test_boundaries_of_any_text(texts):
    assert boundaries(texts) == by_regex(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_ids_of_any_text(texts):
    ids, counts = WORDS.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] [:len(texts)] == [ORACLE.encode_ordinary(t) for t in texts]


def test_long_and_short_merges_agree():
    for piece in ("supercalifragilisticexpialidocious" * 20, "aaaa" * 60, "\U0001f600" * 40):
        parts = [piece.encode()[i:i + 1] for i in range(len(piece.encode()))]
        assert WORDS._merge_long(list(parts)) == WORDS._merge_short(list(parts))


def check(docs):
    want = sorted(((i, len(ids := ORACLE.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in (tuple(r) for r in docs.select("doc_id", "text").collect())), key=repr)
    assert sorted((tuple(r) for r in byte_bpe.digests(docs, PATH).collect()), key=repr) == want


def test_awkward_rows(spark, documents, no_documents):
    check(documents)
    check(no_documents)
    check(spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id bigint, text string"))


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_decoding_encoded_rows(documents, no_documents):
    for docs in (documents, no_documents):
        encoded = byte_bpe.encode(docs, PATH, decoded=True).withColumnRenamed("decoded", "at_once")
        for r in byte_bpe.decode(encoded, PATH).collect():
            assert r.decoded == r.at_once


def test_offsets_decode_slices(spark):
    docs = spark.createDataFrame([(1, "Été là-bas, l'hiver 2024 \U0001f600!")], "doc_id bigint, text string")
    row = byte_bpe.encode(docs, PATH).first()
    data = docs.first().text.encode()
    for i in range(len(row.ids) - 1):
        assert WORDS.decode(np.array(row.ids[i:]), np.array(row.offsets[i:]) - row.offsets[i]) == data[row.offsets[i]:]
