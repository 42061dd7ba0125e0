"""Boundaries of pre-tokens without regex: classes of codepoints and a scan of transition functions.

An automaton reads one symbol per codepoint and knows at each whether a pre-token
starts there.  A symbol acts as a function from states to states; these functions
form a small finite monoid, so the run over a text is a prefix scan with an
associative operation, worked out for many blocks of the text at once.

The pattern it stands for: the contractions 's 't 're 've 'm 'll 'd, letters or
numbers or other signs each with one blank before, white space up to the last sign
of a run that something follows, and single white space.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, ENDS, HALVES, NUMBER, OTHER, QUOTE, BLANK, LAST, SPACE = range(9)
_SYMBOLS = 9
# States: a token has just ended; inside letters, numbers, other signs; after a blank that the next
# sign joins; inside white space; after a quote that starts a token; inside a two-letter contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, AFTER_QUOTE, IN_HALF = range(8)
_STATES = 8
_BLOCK = 256

# Codepoints of white space outside the categories that Unicode names for letters and numbers.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every codepoint."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state and whether a token starts at this symbol."""
    if state == IN_HALF:
        return FRESH, False
    if symbol in (LETTER, ENDS, HALVES):
        if state == AFTER_QUOTE and symbol != LETTER:
            return (FRESH if symbol == ENDS else IN_HALF), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (OTHER, QUOTE):
        inside = state in (IN_OTHER, AFTER_BLANK, AFTER_QUOTE)
        return (AFTER_QUOTE if symbol == QUOTE and not inside else IN_OTHER), not inside
    if symbol == BLANK:
        return AFTER_BLANK, True
    if symbol == LAST:
        return FRESH, True
    return IN_SPACE, state != IN_SPACE


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol (then of each symbol that starts a text, then the identity), products, images, starts."""
    step = [[_step(q, s) for q in range(_STATES)] for s in range(_SYMBOLS)]
    plain = [tuple(q for q, _ in row) for row in step]
    first = [(row[FRESH][0],) * _STATES for row in step]
    generators = [*plain, *first, tuple(range(_STATES))]
    elements = list(dict.fromkeys(generators))
    known = set(elements)
    for f in elements:  # grows while it is read
        for g in generators:
            h = tuple(g[q] for q in f)
            if h not in known:
                known.add(h)
                elements.append(h)
    number = {f: i for i, f in enumerate(elements)}
    products = np.array([[number[tuple(g[q] for q in f)] for g in elements] for f in elements], np.uint16)
    starts = np.array([[start for _, start in row] for row in step] + [[row[FRESH][1]] * _STATES for row in step])
    return np.array([number[g] for g in generators], np.uint16), products, np.array(elements, np.uint8), starts


def _scan(elements: np.ndarray) -> np.ndarray:
    """Product of everything before each element."""
    identity, products = monoid()[0][-1], monoid()[1]
    n, size = len(elements), products.shape[0]
    flat = products.ravel()
    if n <= _BLOCK:
        out, total = np.empty(n, np.uint16), int(identity)
        for i, e in enumerate(elements.tolist()):
            out[i] = total
            total = int(flat[total * size + e])
        return out
    blocks = -(-n // _BLOCK)
    padded = np.full(blocks * _BLOCK, identity, np.uint16)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    inside = np.empty_like(columns)
    total = np.full(blocks, identity, np.uint16)
    for j in range(_BLOCK):
        inside[j] = total
        total = flat[total.astype(np.int32) * size + columns[j]]
    before = _scan(total).astype(np.int32) * size
    for j in range(_BLOCK):
        inside[j] = flat[before + inside[j]]
    return inside.T.ravel()[:n]


def symbols(codepoints: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each codepoint; `first` marks where texts start."""
    kinds = classes()[codepoints]
    follower = np.append(codepoints[1:], 0)
    ended = np.append(first[1:], True)  # nothing of the same text follows
    out = kinds.copy()
    space = kinds == SPACE
    before_sign = space & ~np.append(space[1:], True) & ~ended
    blank = codepoints == 32
    out[before_sign & blank] = BLANK
    out[before_sign & ~blank] = LAST
    out[codepoints == 39] = QUOTE
    for c in "stmd":
        out[codepoints == ord(c)] = ENDS
    for c, after in ("re", "ve", "ll"):
        out[(codepoints == ord(c)) & (follower == ord(after)) & ~ended] = HALVES
    return out


def starts(codepoints: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts."""
    if not len(codepoints):
        return np.empty(0, np.int64)
    generators, _, images, begins = monoid()
    read = symbols(codepoints, first) + np.where(first, _SYMBOLS, 0).astype(np.uint8)
    before = images[_scan(generators[read]), FRESH]
    return np.flatnonzero(begins[read, before])
