import random
import re

from sentrymill.functions.name_trie import NameTrie


def brute(names, texts):
    """Regular expressions, one per name; places of one name do not overlap."""
    return [(t, m.start(), n) for t, text in enumerate(texts) for n, name in enumerate(names) if name
            for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text, re.IGNORECASE)]


def check(names, texts):
    trie = NameTrie(names)
    text, at, name, unfinished = trie.walk(texts)
    assert sorted(zip(text.tolist(), at.tolist(), name.tolist())) == sorted(brute(names, texts))
    return unfinished.tolist()


def test_edges_of_words_and_signs():
    names = ["LockBit", "LockBit 3.0", "Øyx", "C++", "#one", "a b a", "Lock", "", "APT-28", "APT"]
    texts = ["lockbit 3.0, LockBit3 and xLockBit", "ØYX øyx xøyx øyxx", "c++ C+++ c++x xc++", "#one x#one ##one", "a b a b a b a", "", "APT-28 apt-281 apt",
             "LockBit 3.", "the a b"]
    assert check(names, texts) == [False, False, False, False, True, False, True, True, True]


def test_random_names():
    rng = random.Random(4)
    for _ in range(60):
        names = list({"".join(rng.choice("ab .-é") for _ in range(rng.randrange(1, 5))) for _ in range(12)})
        names = list({n.lower(): n for n in names}.values())
        check(names, ["".join(rng.choice("aabB .-é") for _ in range(rng.randrange(0, 40))) for _ in range(20)])


def test_no_names_and_no_texts():
    assert check([], ["some text", ""]) == [False, False]
    assert NameTrie(["a"]).walk([])[0].tolist() == []


def test_many_names_share_a_walk():
    names = [f"Crew {i} {suffix}" for i in range(10_000) for suffix in ("Bears", "of the North")]
    trie = NameTrie(names)
    text, at, name, _ = trie.walk(["Crew 77 of the North and crew 9999 bears", "Crew 77 of the South"])
    assert [(t, a, names[n]) for t, a, n in zip(text, at, name)] == [(0, 0, "Crew 77 of the North"), (0, 25, "Crew 9999 Bears")]
    assert len(trie.keys) == 2 + 8 * 10_000  # of 14 units for every number
