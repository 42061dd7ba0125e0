import re

from sentrymill.llm import license_rules, licenses
from tests.llm.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Licensed under CC BY-NC 4.0. Mit license? MIT License! gnu general public license, version 3; GNU General Public License",
    "This file: SPDX-License-Identifier: Apache-2.0 / apache\nlicense", "permitted mit licenses cc bypass unlicensed",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "CC BY CC BY CC BY-SA 4.0 é cc by", "mit license mit license", None, "", "mit", "the unlicense. all rights reserved",
]


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    norm = " " + " ".join(words) + " "
    found = []
    for r in license_rules.load():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            start = norm[:m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" "), 5 if r.base else r.priority, r.number, r))
    kept, base = [], [d for d in found if d[4].base]
    for d in found:
        covers = [e for e in found if e is not d and not e[4].base and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2]
                  and ((e[0], e[1]) != (d[0], d[1]) or (e[2], e[3]) < (d[2], d[3]))]
        if d[4].base or not covers:
            kept.append(d)
    trust = [license_rules.CONFIDENCE.get(d[2], license_rules.CONFIDENCE[3]) for d in kept]
    starts = [d[0] for d in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({d[4].label for d in base})), ",".join(sorted({d[4].label for d in kept})), max(trust, default=0.0))


def check(docs):
    want = sorted(((i, *brute(t)) for i, t in [tuple(r) for r in docs.select("doc_id", "text").collect()]), key=repr)
    got = sorted((tuple(r) for r in licenses.license_scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=repr)
    assert got == want


def test_awkward_texts(documents, no_documents):
    check(documents)
    check(no_documents)


def test_phrases(spark):
    docs = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int")
    check(docs)


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_rules_are_gated_by_their_own_text():
    rules = license_rules.load()
    assert len(rules) > 200
    for r in rules:
        assert r.keyword in r.pattern
        assert any(a in f" {r.keyword} " for a in license_rules.ANCHORS)
