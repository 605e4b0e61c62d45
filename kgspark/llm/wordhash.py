"""Vectorised words and hashes over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 these six bytes never occur
inside a longer character, so words can be cut on bytes.  Everything here works on blocks of about
``BLOCK_BYTES`` of text (one longer text is a block of its own), so that the memory of a task depends on
the longest text, not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept between calls."""
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK_BYTES + 4096), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) <= 8 * BLOCK_BYTES:
            _powers[int(base)] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


@dataclass
class Block:
    """Consecutive rows of a batch: ``data[offsets[i]:offsets[i + 1]]`` is the UTF-8 text of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a block: byte ranges, the row of each, and ``bounds[i]:bounds[i + 1]`` as the words of row i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole rows; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(block: Block) -> Words:
    """The words of every row of a block."""
    if not len(block.data):
        nothing = np.zeros(0, np.int64)
        return Words(nothing, nothing, np.zeros(block.rows + 1, np.int64))
    inside = ~_SPACE[block.data]
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    cuts = block.offsets[:-1]
    before[cuts[cuts < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    cuts = block.offsets[1:] - 1
    after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def word_hashes(block: Block, found: Words, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word: equal words have equal hashes wherever they stand.

    ``table`` maps bytes to bytes first, for example to lower case.
    """
    if not len(found.starts):
        return np.zeros(0, np.uint64)
    data = block.data if table is None else table[block.data]
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.multiply(_BYTE_VALUE[data], _power_table(_BASE, len(data)), out=sums[1:])
    np.add.accumulate(sums, out=sums)
    return mix((sums[found.ends] - sums[found.starts]) * _power_table(_BASE_INVERSE, len(data) + 1)[found.starts])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word; the last n - 1 starts have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _U64(0xD6E8FEB86659FD93) + hashes[i : i + len(out)]
    return mix(out)


def whole_grams(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of n words that stay inside a row, and ``bounds`` of the rows among them."""
    per_row = np.maximum(np.diff(bounds) - n + 1, 0)
    to = np.concatenate(([0], np.cumsum(per_row)))
    return np.arange(to[-1]) + np.repeat(bounds[:-1] - to[:-1], per_row), to


def lower_table() -> np.ndarray:
    """Maps the bytes of A-Z to a-z and every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table
