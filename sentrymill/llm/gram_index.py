"""Grams of variable length: a dictionary pruned by frequency, decomposition of words, and what one edit can affect.

The dictionary holds every gram of MIN_GRAM letters that occurs and, for a gram that occurs
more often than a limit, the grams one letter longer.  A word is decomposed into the longest
gram of the dictionary at each place, without those that lie inside an earlier one.  So
frequent beginnings are told apart by longer grams and lists stay short.

`affected` bounds from above how many grams of a word one inserted, deleted or replaced
letter can change: not only those that hold the letter, but also those that a longer gram
across the letter could replace.  All other grams stand in the other word too, moved by one
place at most.  With grams of at most half the word's length some gram always stays.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

MIN_GRAM = 2

Gram = tuple[int, str]


@dataclass(frozen=True)
class GramDictionary:
    """Grams and how often they occur; every beginning of a gram, down to MIN_GRAM letters, is one too."""
    counts: dict[str, int]
    # Longest gram that continues a beginning, or that an ending ends.
    reach_right: dict[str, int] = field(default_factory=dict)
    reach_left: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for gram in self.counts:
            size = len(gram)
            for cut in range(1, size):
                head, tail = gram[:cut], gram[cut:]
                # The shortest continuation decides whether a gram of a limited size can cross the edit.
                if self.reach_right.get(head, size + 1) > size:
                    self.reach_right[head] = size
                if self.reach_left.get(tail, size + 1) > size:
                    self.reach_left[tail] = size

    def decompose(self, word: str, longest: int) -> list[Gram]:
        """(place, gram) of the grams that no earlier gram covers, in order."""
        grams, covered = [], 0
        for place in range(len(word) - MIN_GRAM + 1):
            size = MIN_GRAM
            while size < longest and place + size < len(word) and word[place:place + size + 1] in self.counts:
                size += 1
            if place + size > covered:
                covered = place + size
                grams.append((place, word[place:covered]))
        return grams

    def affected(self, word: str, grams: list[Gram], longest: int) -> int:
        """The most grams that one edit can change."""
        most, n = 0, len(word)
        for at in range(n + 1):
            # Grams that start here or later can be covered by one that crosses the edit from the left.
            left = at
            while left > 0 and self.reach_right.get(word[left - 1:at], longest + 1) <= longest:
                left -= 1
            for after in (at, at + 1):  # a letter inserted in front of `at`; the letter `at` deleted or replaced
                if after > n:
                    continue
                right = after
                while right < n and self.reach_left.get(word[after:right + 1], longest + 1) <= longest:
                    right += 1
                changed = 0
                for place, gram in grams:
                    end = place + len(gram)
                    if end <= at:
                        changed += place >= left
                    elif place >= after:
                        changed += end <= right
                    else:
                        changed += 1
                most = max(most, changed)
        return most

    def rarest(self, word: str, longest: int) -> list[Gram]:
        """The grams among which two words within one edit must agree: all but the most frequent ones that the bound allows."""
        grams = self.decompose(word, longest)
        keep = self.affected(word, grams, longest) + 1
        return sorted(grams, key=lambda g: (self.counts.get(g[1], 0), g[1], g[0]))[:keep]


def count_grams(words: Iterable[str], longest: int) -> dict[str, int]:
    """How often each gram of MIN_GRAM up to `longest` letters occurs."""
    counts: dict[str, int] = {}
    for word in words:
        n = len(word)
        for size in range(MIN_GRAM, min(longest, n) + 1):
            for place in range(n - size + 1):
                gram = word[place:place + size]
                counts[gram] = counts.get(gram, 0) + 1
    return counts
