"""A noisy channel for disguised words: character lattices, decoded by Viterbi under a character trigram model.

Symbols are 0 (no letter), a-z and the letters U+00E0 to U+00FF.  What a writer may have done to a letter:

* put a digit or sign in its place (``LEET``);
* repeat it: a run of three or more equal letters stands for one or two;
* put spaces, dots, hyphens, underscores or asterisks between all letters of one or more words.

A sign can also be what it seems, no letter at all; then it ends the word.  Only tokens with such traces are decoded, and
each distinct one once: the lattices of many tokens are walked together in numpy, one unit at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xE0, 0x100)))
N = len(LETTERS) + 1
NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
# Letters that a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
STANDS_FOR, REPEATED, JOINED = math.log(0.05), math.log(0.05), math.log(0.7)
#: A sign that is no letter: common behind words, less so for digits, which rarely touch letters.
NO_LETTER = {c: math.log(1e-5 if c.isdigit() else 0.3 if c in "!(+" else 0.05) for c in LEET}

_SIGN = "".join(map(re.escape, LEET))
_LETTER = "a-zà-ÿ"
TRACE = re.compile(rf"[{_LETTER}][{_SIGN}]|[{_SIGN}][{_LETTER}]|([{_LETTER}])\1\1")
APART = re.compile(rf"(?<![{_LETTER}{_SIGN}])[{_LETTER}{_SIGN}](?:[ .\-_*]{{1,2}}[{_LETTER}{_SIGN}](?![{_LETTER}{_SIGN}])){{2,}}")
WORD = re.compile(rf"[{_LETTER}]+")
_RUN = re.compile(r"(.)\1*", re.S)

Option = tuple[tuple[int, ...], float]


@dataclass
class Characters:
    """Log-probabilities ``table[a, b, c]`` of a symbol c behind a and b."""

    table: np.ndarray


def joined(column: pa.Array, limit: int = 1 << 20) -> Iterator[str]:
    """The texts of a column in strings of about ``limit`` characters, a space between two texts."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= limit:
            yield " ".join(held)
            held, size = [], 0
    yield " ".join(held)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow each other in all texts; the driver gets ``N ** 3`` numbers at most.

    A word begins behind two symbols that are no letters, whatever stood before.
    """
    symbol = np.zeros(0x100, dtype=np.int64)
    for c, i in NUMBER.items():
        symbol[ord(c)] = i
        if c.upper() != c and len(c.upper()) == 1 and ord(c.upper()) < 0x100:
            symbol[ord(c.upper())] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(N**3, dtype=np.int64)
        for batch in batches:
            for text in joined(batch["text"]):
                points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                s = np.zeros(len(points) + 3, dtype=np.int64)
                s[2:-1] = np.where(points < 0x100, symbol[np.minimum(points, 0xFF)], 0)
                one, two, three = s[:-2], s[1:-1], s[2:]
                code = (np.where(two > 0, one, 0) * N + two) * N + three
                held += np.bincount(code[(two > 0) | (three > 0)], minlength=N**3)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["code", "n"])

    out = np.zeros(N**3, dtype=np.int64)
    for code, n in docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out.reshape(N, N, N)


def traced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may hold a ``TRACE``, and which a run of letters ``APART``; found for all of them together, so that others need no search."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    kind = np.zeros(0x101, dtype=np.uint8)  # 1: letter, 2: sign
    for value, some in ((1, LETTERS), (2, LEET)):
        for c in some:
            kind[min(ord(c), 0x100)] |= value
    of = kind[np.minimum(points, 0x100)]
    letter, mark = (of & 1) > 0, of > 0
    beside = np.zeros(len(of), dtype=bool)
    if len(of) > 2:
        beside[:-1] = mark[:-1] & mark[1:] & (letter[:-1] != letter[1:])
        beside[:-2] |= letter[:-2] & (points[:-2] == points[1:-1]) & (points[1:-1] == points[2:])
    lone = mark.copy()  # with no letter or sign beside it
    lone[1:] &= ~mark[:-1]
    lone[:-1] &= ~mark[1:]
    at = np.flatnonzero(lone)
    near = np.diff(at) <= 3
    apart = at[:-2][near[:-1] & near[1:]]
    ends = np.cumsum([len(t) + 1 for t in texts])
    some = np.zeros((2, len(texts)), dtype=bool)
    for row, found in zip(some, (np.flatnonzero(beside), apart)):
        row[np.searchsorted(ends, found, "right")] = True
    return some[0], some[1]


def characters(counts: np.ndarray) -> Characters:
    """Shares of trigrams, smoothed by those of bigrams and these by those of symbols (Witten and Bell)."""
    counts = counts.astype(float)
    lower = np.full(N, 1 / N)
    for level in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        kinds, total = (level > 0).sum(axis=-1, keepdims=True), level.sum(axis=-1, keepdims=True)
        lower = np.where(total > 0, (level + kinds * lower) / np.maximum(total + kinds, 1), lower)
    lower[0, 0, 0] = 1  # several signs in a row end one word
    return Characters(np.log(lower).astype(np.float32))


def lattice(token: str) -> list[list[Option]]:
    """Options of each run of equal characters of a token: the symbols it stands for, and the cost."""
    out = []
    for m in _RUN.finditer(token):
        c, n = m.group(1), len(m.group())
        if c in NUMBER:
            x = NUMBER[c]
            out.append([((x,), 0.0)] if n == 1 else [((x, x), 0.0), ((x,), REPEATED)] if n == 2 else [((x,), REPEATED), ((x, x), REPEATED)])
        elif c in LEET:
            options: list[Option] = [((0,), NO_LETTER[c])]
            for x in LEET[c]:
                options += [((NUMBER[x],), STANDS_FOR)] + [((NUMBER[x], NUMBER[x]), STANDS_FOR)] * (n > 1)
            out.append(options)
        else:
            out.append([((0,), 0.0)])
    return out


def apart_lattice(run: str) -> list[list[Option]]:
    """As above for letters that stand apart: between two of them there may be a space, or nothing."""
    out, new = [], True
    gap = 0
    for c in run:
        if c not in NUMBER and c not in LEET:
            gap += 1
            continue
        seen = [(NUMBER[x], 0.0 if c in NUMBER else STANDS_FOR) for x in (c if c in NUMBER else LEET[c])]
        space, joined = math.log(1 - math.exp(JOINED)), JOINED
        options: list[Option] = [((x,), cost + (0.0 if new else joined)) for x, cost in seen] if gap < 2 else []
        options += [] if new else [((0, x), cost + space) for x, cost in seen]
        out.append(options)
        new, gap = False, 0
    return out


def decode(lattices: list[list[list[Option]]], model: Characters) -> list[str]:
    """The likeliest text of each lattice: words and single spaces."""
    out = [""] * len(lattices)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, units in enumerate(lattices):
        groups.setdefault((len(units), max(map(len, units), default=0)), []).append(i)
    for (length, width), members in groups.items():
        for at in range(0, len(members), 4096):
            some = members[at : at + 4096]
            for i, symbols in zip(some, _viterbi([lattices[i] for i in some], length, width, model.table)):
                out[i] = " ".join("".join(LETTERS[s - 1] if s else " " for s in symbols).split())
    return out


def _viterbi(lattices: list[list[list[Option]]], length: int, width: int, table: np.ndarray) -> list[list[int]]:
    """The state is the pair of the options of the last two units, as no option has more than two symbols."""
    n = len(lattices)
    first, second = np.zeros((length, n, width), np.int64), np.full((length, n, width), -1, np.int64)
    cost = np.full((length, n, width), -np.inf)
    for i, units in enumerate(lattices):
        for u, options in enumerate(units):
            for k, (symbols, c) in enumerate(options):
                first[u, i, k], cost[u, i, k] = symbols[0], c
                if len(symbols) > 1:
                    second[u, i, k] = symbols[1]
    last = np.where(second >= 0, second, first)
    # score[i, j, k]: option k at this unit behind option j
    score = np.full((n, width, width), -np.inf)
    score[:, 0, :] = cost[0] + table[0, 0, first[0]] + np.where(second[0] >= 0, table[0, first[0], np.maximum(second[0], 0)], 0)
    back = []
    for u in range(1, length + 1):
        y = last[u - 1][:, None, :]  # by (before, now)
        before = np.zeros((n, width), np.int64) if u == 1 else last[u - 2]
        x = np.where(second[u - 1][:, None, :] >= 0, first[u - 1][:, None, :], before[:, :, None])
        x = np.where(y == 0, 0, x)
        if u == length:
            final = score + table[x, y, 0]
            break
        a = first[u][:, None, None, :]
        b = second[u][:, None, None, :]
        step = table[x[..., None], y[..., None], a] + np.where(b >= 0, table[np.where(a == 0, 0, y[..., None]), a, np.maximum(b, 0)], 0)
        whole = score[..., None] + step + cost[u][:, None, None, :]
        back.append(whole.argmax(axis=1))
        score = whole.max(axis=1)
    best = final.reshape(n, -1).argmax(axis=1)
    j, k = best // width, best % width
    chosen = [k]
    for u in range(length - 1, 0, -1):
        chosen.append(j)
        j, k = back[u - 1][np.arange(n), j, k] if u > 1 else j, j
    out = []
    chosen = chosen[::-1]
    for i in range(n):
        symbols: list[int] = []
        for u in range(length):
            o = chosen[u][i]
            symbols += [int(first[u, i, o])] + [int(second[u, i, o])] * int(second[u, i, o] >= 0)
        out.append(symbols)
    return out
