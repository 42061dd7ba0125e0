"""Names of a large dictionary in texts: runs of units looked up in bitmaps of bounded size.

A name of n units (see name_trie) has a hash of its units, and the names of n units share a
bitmap of these.  A text is read once whatever the number of names: only where the first
unit of a name occurs are the next units hashed, up to the longest name, and looked up under
their number.  A bitmap holds back no name and lets a few other runs pass, so what is found
are candidates, which a join with the names has to confirm; they are spelled as `unit_key`
spells a name.  Whole words, letter case and overlaps are as in the trie.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np

from .name_trie import UNIT, _WORD

# Bits of a bitmap: a share for each name, within bounds; 2**27 bits are 16 MB.
NAME_BITS, LEAST_BITS, MOST_BITS = 32, 15, 27
PROBES = ((0, 0), (0, 31), (1, 0), (1, 31))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HELD_UNITS = 500_000
_hashes: dict[str, int] = {}


def unit_hash(unit: str) -> int:
    found = _hashes.get(unit)
    if found is None:
        if len(_hashes) >= _HELD_UNITS:
            _hashes.clear()
        found = _hashes[unit] = int.from_bytes(blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return found


def units_of(text: str) -> list[str]:
    return [u.lower() for u in UNIT.findall(text)]


def unit_key(name: str) -> str:
    return "".join(units_of(name))


def joined(run: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Hash of a run of units with one more unit behind it."""
    return run * _FACTOR + unit


def marks(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 62 bits from which the places of a run in its bitmap are cut."""
    out = []
    for k in (0, 1):
        x = run + np.uint64(k) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(((x ^ (x >> np.uint64(31))) >> np.uint64(2)).view(np.int64))
    return out[0], out[1]


def name_marks(names: Sequence[str]) -> tuple[list[str], np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Key, number of units, marks of the name and marks of its first unit."""
    keys, sizes = [], np.zeros(len(names), np.int32)
    run, first = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64)
    for i, name in enumerate(names):
        units = units_of(name)
        keys.append("".join(units))
        sizes[i] = len(units)
        value = 0
        for k, unit in enumerate(units):
            value = unit_hash(unit) if k == 0 else (value * int(_FACTOR) + unit_hash(unit)) % (1 << 64)
            if k == 0:
                first[i] = value
        run[i] = value
    return keys, sizes, marks(run), marks(first)


def bits_for(n: int) -> int:
    """Bits of the bitmap of n names, as a power of two."""
    return min(max((n * NAME_BITS - 1).bit_length(), LEAST_BITS), MOST_BITS)


class NameFilter:
    """Bitmaps by number of units; that of 0 holds the first units of all names."""

    def __init__(self, bitmaps: dict[int, bytes]):
        self.bitmaps = {n: np.frombuffer(b, np.uint8) for n, b in bitmaps.items()}
        self.longest = max(bitmaps, default=0)

    def _holds(self, n: int, run: np.ndarray) -> np.ndarray:
        if n not in self.bitmaps:
            return np.zeros(len(run), bool)
        bitmap, two = self.bitmaps[n], marks(run)
        found = np.ones(len(run), bool)
        for which, shift in PROBES:
            slot = (two[which] >> shift) & (len(bitmap) * 8 - 1)
            found &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
        return found

    def walk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Candidates as (text, place, key), by text; and per text whether a name may go on behind its end."""
        hashes, units, runs, sizes, begins, text_of, last = [], [], [], [], [], [], []
        for i, text in enumerate(texts):
            parts = UNIT.findall(text)
            at = 0
            for part in parts:
                unit = part.lower()
                units.append(unit)
                hashes.append(unit_hash(unit))
                runs.append(_WORD.match(part) is not None)
                begins.append(at)
                at += len(part)
            sizes.append(len(parts))
            text_of += [i] * len(parts)
            last += [len(units)] * len(parts)
        unfinished = np.zeros(len(texts), bool)
        h, run_unit = np.array(hashes, np.uint64), np.array(runs, bool)
        place, owner, end = np.array(begins, np.int64), np.array(text_of, np.int64), np.array(last, np.int64)
        front = np.flatnonzero(self._holds(0, h)) if len(h) else np.zeros(0, np.int64)
        value, found = h[front], []
        for n in range(1, self.longest + 1):
            if not len(front):
                break
            stop = front + n  # the unit behind
            hit = self._holds(n, value)
            if hit.any():
                own, behind = front[hit], stop[hit]
                before = own - 1
                same = (before >= 0) & (owner[before] == owner[own])
                follows = behind < end[own]
                next_run = follows & run_unit[np.minimum(behind, len(h) - 1)]
                whole = ~(~run_unit[own] & same & run_unit[before]) & ~(~run_unit[behind - 1] & next_run)
                found += [(int(owner[a]), int(place[a]), "".join(units[a:b])) for a, b in zip(own[whole].tolist(), behind[whole].tolist())]
            if n < self.longest:
                goes_on = stop < end[front]
                unfinished[owner[front[~goes_on]]] = True
                front, stop, value = front[goes_on], stop[goes_on], value[goes_on]
                value = joined(value, h[stop])
        found.sort()
        kept, reach = [], {}
        for text, at, key in found:
            if at >= reach.get((text, key), 0):
                reach[text, key] = at + len(key)
                kept.append((text, at, key))
        return (np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64), [k[2] for k in kept], unfinished)
