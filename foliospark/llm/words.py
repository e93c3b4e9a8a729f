"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those bytes occur only as the
white space itself, so scanning bytes gives the same words as scanning code points. Work is done in
pieces of about a megabyte that end between words, so memory follows the number of words held, not the
length of a text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Words(NamedTuple):
    """hashes: 64-bit identity of every word in order; bounds: words of text i are bounds[i]:bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd 64-bit base and of its inverse."""
    if not _POW or len(_POW["up"]) < n:
        m = max(n, 2 * PIECE)
        _POW.update(up=_powers(_BASE, m), down=_powers(_INVERSE, m))
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _cuts(raw: np.ndarray, at: np.ndarray) -> list[int]:
    """Piece ends: the last text start before each megabyte, or else the next white space after it."""
    ends, here = [], 0
    while here < len(raw):
        to = here + PIECE
        if to >= len(raw):
            ends.append(len(raw))
            break
        start = at[np.searchsorted(at, to, "right") - 1]
        if start > here:
            to = int(start)
        else:
            stop = int(at[np.searchsorted(at, to, "right")])
            while to < stop and not _SPACE[raw[to]]:
                to += 1
        ends.append(to)
        here = to
    return ends


def _alnum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word bytes, folded bytes) where words are letters and digits only: also the marks of U+0080-00BF and U+2000-207F part words, and letters up to U+00DE fold."""
    solid, folded = ~_PLAIN[x], _LOWER[x]
    for lead, nexts, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3)):
        at = np.flatnonzero(x[: len(x) - width + 1] == lead)
        if nexts:
            at = at[np.isin(x[at + 1], nexts)]
        for k in range(width):
            solid[at + k] = False
    at = np.flatnonzero(x[:-1] == 0xC3) + 1
    at = at[(x[at] >= 0x80) & (x[at] <= 0x9E) & (x[at] != 0x97)]
    folded[at] += 0x20
    return solid, folded


def letters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter bytes, folded bytes): as for words of letters and digits, without the digits."""
    solid, folded = _alnum(x)
    return solid & ((x < 48) | (x > 57)), folded


def scan(column: pa.Array, lower: bool = True, alnum: bool = False) -> Words:
    """Hashes of all words of all texts; lower folds A-Z before hashing; alnum takes runs of letters and digits, folded, instead."""
    raw, at = text_buffer(column)
    starts_of_texts = at[1:-1]
    kept_hashes, kept_starts, here = [], [], 0
    for end in _cuts(raw, at):
        x = raw[here:end]
        up, down = powers(len(x) + 1)
        solid, folded = _alnum(x) if alnum else (~_SPACE[x], _LOWER[x] if lower else x)
        edge = np.empty(len(x), dtype=bool)
        edge[0] = True
        edge[1:] = ~solid[:-1]
        inner = starts_of_texts[(starts_of_texts > here) & (starts_of_texts < end)] - here
        edge[inner] = True
        starts = np.flatnonzero(solid & edge)
        stop = np.empty(len(x), dtype=bool)
        stop[-1] = True
        stop[:-1] = ~solid[1:]
        stop[inner - 1] = True
        ends = np.flatnonzero(solid & stop) + 1
        folded = folded.astype(np.uint64) + np.uint64(1)
        sums = np.empty(len(x) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(folded * up[: len(x)], out=sums[1:])
        kept_hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        kept_starts.append(starts + here)
        here = end
    hashes = np.concatenate(kept_hashes) if kept_hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(kept_starts) if kept_starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(starts, at)
    return Words(hashes, bounds)


def word_hash(word: str) -> int:
    """The hash that scan() gives to one (already folded) word."""
    return int(scan(pa.array([word]), lower=False).hashes[0])


def pieces(batch: pa.RecordBatch, place: int, most: int = 8 << 20):
    """Slices of batch, without copies, whose texts in column `place` have about `most` bytes or are one row."""
    column = batch.column(place)
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    here = 0
    while here < len(sizes):
        to = max(here + 1, int(np.searchsorted(ends, (ends[here - 1] if here else 0) + most, "right")))
        yield batch.slice(here, to - here)
        here = to
