"""Names of a dictionary in texts: a trie over words and signs, walked once per text.

A text is cut into units: runs of ASCII letters, digits and underscores, and every other
character by itself.  A name is a path of units from the root of the trie, so names that
begin alike share their beginning and a place of a text costs a step only as long as some
name goes on.  The edges are one sorted array, and a step looks up all places of a batch of
texts at once.

A name counts only as whole words: a run of the text is a unit as a whole, and a name that
begins or ends with another sign has no run next to it there.  Letter case does not matter.
Places of one name do not overlap; the first one from the left counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

UNIT = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]")
_WORD = re.compile(r"[A-Za-z0-9_]")
_OTHER, _END = -1, -2


class NameTrie:
    """`names` numbered as given; empty names never occur."""

    def __init__(self, names: Sequence[str]):
        self.units: dict[str, int] = {}
        paths = [[self.units.setdefault(u.lower(), len(self.units)) for u in UNIT.findall(name)] for name in names]
        width = max(len(self.units), 1)
        children: dict[int, int] = {}
        last, size = [], 1
        for path in paths:
            node = 0
            for unit in path:
                key = node * width + unit
                node = children.setdefault(key, size)
                size += node == size
            last.append(node)
        self.width = width
        self.keys = np.array(sorted(children), np.int64)
        self.next = np.array([children[k] for k in self.keys.tolist()], np.int64)
        self.goes_on = np.zeros(size, bool)
        self.goes_on[self.keys // width] = True
        # Names by the node at which they end: a slice of `ending`.  Names that differ in case only end together.
        nodes = np.array([n if p else -1 for n, p in zip(last, paths)], np.int64)
        self.ending = np.argsort(nodes, kind="stable")
        self.first_ending = np.searchsorted(nodes[self.ending], np.arange(size + 1))
        self.length = np.array([len(n) for n in names], np.int64)
        self.open_front = np.array([not _WORD.match(n) for n in names], bool)
        self.open_back = np.array([not (n and _WORD.match(n[-1])) for n in names], bool)

    def _step(self, nodes: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The child of each node, 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(nodes), np.int64)
        key = nodes * self.width + units
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((units >= 0) & (self.keys[place] == key), self.next[place], 0)

    def _cut(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit numbers, places, whether a unit is a run, and its text; every text ends with an end mark."""
        numbers, sizes, runs, owner = [], [], [], []
        get = self.units.get
        for i, text in enumerate(texts):
            parts = UNIT.findall(text)
            numbers += [get(p.lower(), _OTHER) for p in parts]
            sizes += map(len, parts)
            runs += [_WORD.match(p) is not None for p in parts]
            numbers.append(_END)
            sizes.append(0)
            runs.append(False)
            owner.append(len(parts) + 1)
        size = np.array(sizes, np.int64)
        text_of = np.repeat(np.arange(len(texts)), owner)
        begin = np.cumsum(size) - size
        starts = np.concatenate([[0], np.cumsum(owner)[:-1]]).astype(np.int64) if owner else np.zeros(0, np.int64)
        return np.array(numbers, np.int64), begin - begin[starts][text_of] if owner else begin, np.array(runs, bool), text_of

    def walk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hits as (text, place, name), by text, place and name; and per text whether a name may go on behind its end."""
        units, place, runs, text_of = self._cut(texts)
        unfinished = np.zeros(len(texts), bool)
        found = []
        front = np.flatnonzero(units >= 0)
        nodes = self._step(np.zeros(len(front), np.int64), units[front])
        at = front
        while True:
            alive = nodes > 0
            front, nodes, at = front[alive], nodes[alive], at[alive] + 1
            if not len(front):
                break
            ends = self.first_ending[nodes + 1] - self.first_ending[nodes]
            some = np.flatnonzero(ends)
            if len(some):
                many = np.repeat(some, ends[some])
                rank = np.arange(len(many)) - np.repeat(np.cumsum(ends[some]) - ends[some], ends[some])
                name = self.ending[self.first_ending[nodes[many]] + rank]
                before, behind = front[many] - 1, at[many]
                same = (before >= 0) & (text_of[before] == text_of[front[many]])
                whole = ~(self.open_front[name] & same & runs[before]) & ~(self.open_back[name] & runs[behind])
                found.append((front[many][whole], name[whole]))
            mark = units[at] == _END
            unfinished[text_of[front[mark & self.goes_on[nodes]]]] = True
            # A sign at the very end of a name may still meet a run behind the text, so it stays a whole hit either way.
            nodes = self._step(nodes, units[at])
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, unfinished
        front, name = (np.concatenate(x) for x in zip(*found))
        text, start = text_of[front], place[front]
        order = np.lexsort((start, name, text))
        text, start, name = text[order], start[order], name[order]
        keep = self._apart(text, start, name)
        text, start, name = text[keep], start[keep], name[keep]
        order = np.lexsort((name, start, text))
        return text[order], start[order], name[order], unfinished

    def _apart(self, text: np.ndarray, start: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Which places of each name in each text stay if an earlier one must not reach into them."""
        keep = np.ones(len(start), bool)
        close = np.zeros(len(start), bool)
        close[1:] = (text[1:] == text[:-1]) & (name[1:] == name[:-1]) & (start[1:] < start[:-1] + self.length[name[1:]])
        for i in np.flatnonzero(close).tolist():
            j = i - 1
            while not keep[j]:
                j -= 1
            keep[i] = not (text[j] == text[i] and name[j] == name[i] and start[i] < start[j] + self.length[name[i]])
        return keep
