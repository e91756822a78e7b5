"""Vectorised hashing over the texts of an Arrow batch: words, runs of symbols, and anchored pieces of repeated strings.

Two kinds of hashes. `Ranges` (a polynomial modulo 2^64) is quick and only chooses places: strings of two symbols that
follow the Thue-Morse sequence collide in it from some hundred symbols on, whatever the multiplier, so no result may rest
on it. Where equal hashes stand for equal strings, words and other ranges have `Names` (two polynomials modulo the prime
2^31 - 1: two different ranges of n symbols agree in both for at most (n / 2^31)^2 of all pairs of multipliers), and runs
of a fixed size `windows` (a nonlinear step for each doubling).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc



def _keep_freed_memory() -> None:
    """Lets glibc reuse the memory of freed arrays. By default it gives that of arrays over 128 KB back to the system and
    gets it again page by page, which takes several times as long as most operations on them."""
    with contextlib.suppress(AttributeError, OSError):  # another C library
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


_keep_freed_memory()

U = np.uint64
#: Bytes of text that are worked on at once, if no single text is longer.
CHUNK = 1 << 18
_MASK = (1 << 64) - 1


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63, dtype=U)) * 2 % (1 << 64) | 5


#: Two tables with a number for each byte, and a multiplier for each.
BYTES, FACTORS = (_table(11), _table(23)), (_odd(31), _odd(47))
#: A-Z as a-z.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """factor^0 ... factor^(n-1) modulo 2^64."""
    have = _powers.get(factor)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 4096), factor, dtype=U)
        have[0] = 1
        _powers[factor] = have = np.cumprod(have, dtype=U)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Ranges:
    """Hashes of any ranges of a sequence of numbers, from running sums."""

    def __init__(self, values: np.ndarray, factor: int):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * powers(factor, n), dtype=U, out=self.sums[1:])
        self.back = powers(pow(factor, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


PRIME = U((1 << 31) - 1)
_residues: dict[int, np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """A number under 2^32 + 2^31 that is x modulo 2^31 - 1."""
    return (x & PRIME) + (x >> U(31))


def residue(x: np.ndarray) -> np.ndarray:
    x = folded(folded(x))
    return np.where(x >= PRIME, x - PRIME, x)


def residues(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^31 - 1."""
    have = _residues.get(base, np.ones(1, U))
    if len(have) < n:
        while len(have) < max(n, CHUNK + 4096):
            have = np.concatenate([have, residue(have * U(pow(base, len(have), int(PRIME))))])
        _residues[base] = have
    return have[:n]


class Names:
    """62-bit names of any ranges of a sequence of 64-bit numbers: two polynomials modulo the prime 2^31 - 1."""

    BASES = (1_168_352_819, 1_640_531_527 - 97)

    def __init__(self, values: np.ndarray):
        n, self.lanes = len(values), []
        for base, part in zip(self.BASES, (values, values >> U(33)), strict=True):
            sums = np.zeros(n + 1, dtype=U)
            np.cumsum(folded((part & PRIME) * residues(base, n)), dtype=U, out=sums[1:])
            self.lanes.append((sums, residues(pow(base, -1, int(PRIME)), n + 1)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (residue(folded(folded(sums[end] - sums[start])) * back[start]) for sums, back in self.lanes)
        return mixed((one << U(31) | two) * U(0x9E3779B97F4A7C15) + (end - start).astype(U))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U(0xA0761D6478BD642F) + b * U(0xE7037ED1A0B428DB))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name for each `size` successive 64-bit numbers."""
    n, have, at, out = len(values) - size + 1, 1, 0, None
    if n <= 0:
        return np.zeros(0, U)
    while True:
        if size & have:
            part = values[at : at + n]
            out = part if out is None else paired(out, part)
            at += have
        if 2 * have > size:
            return out
        values = paired(values[:-have], values[have:])
        have *= 2


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, n + 1 offsets in these) of the texts, null as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of other bytes than ASCII white space, and n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words' bytes; they are all that isn't white space."""
    plain, offsets = data[~SPACE[data]], np.concatenate([[0], np.cumsum(ends - starts)])
    wide = len(plain) >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(plain)])


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 62-bit name of each word."""
    return Names(BYTES[1][LOWER[data] if lower else data])(starts, ends)


def word_hashes(data, starts, ends, lower: bool = False) -> np.ndarray:
    """A quick hash of each word, for buckets."""
    return Ranges(BYTES[0][LOWER[data] if lower else data], FACTORS[0])(starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, in about log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def pieces(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """All windows of `window` symbols, grouped into pieces.

    A window's anchor is the leftmost of its least-hashed runs of `gram` symbols, so equal windows have their anchor at
    the same place in them, wherever they stand. A piece is a maximal run of successive windows with the same anchor.
    Of each piece: row, at (first window's start in the row), n (windows), lead (symbols before the anchor), anchor (a
    quick hash of its run) and start (the first window's, among all symbols).
    """
    total = int(offsets[-1])
    first, last = offsets[:-1], offsets[1:] - window  # of window starts in each row
    if total < window or not (last >= first).any():
        empty = np.zeros(0, np.int64)
        return dict.fromkeys(("row", "at", "n", "lead", "start"), empty) | {"anchor": empty.astype(U)}
    one = Ranges(symbols, FACTORS[0])
    at = np.arange(total - gram + 1)
    grams = one(at, at + gram)
    bits = max(1, int(total).bit_length())
    keyed = (grams >> U(bits) << U(bits)) | at.astype(U)
    best = (sliding_min(keyed, window - gram + 1) & U((1 << bits) - 1)).astype(np.int64)  # the anchor's place for each window
    row = np.searchsorted(offsets, np.arange(len(best)), side="right") - 1
    good = np.arange(len(best)) <= last[row]
    new = good.copy()
    new[1:] &= (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
    starts = np.flatnonzero(new)
    stop = good.copy()
    stop[:-1] &= new[1:] | ~good[1:]
    n = np.flatnonzero(stop) + 1 - starts
    anchor = best[starts]
    return {"row": row[starts], "at": starts - offsets[row[starts]], "n": n, "lead": anchor - starts, "anchor": grams[anchor], "start": starts}


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def covered(intervals: list[tuple[int, int]], window: int, size: int) -> np.ndarray:
    """Which of `size` symbols lie in a window that starts in one of the intervals (first start, number of starts)."""
    edge = np.zeros(size + 1, dtype=np.int64)
    if len(intervals):
        a = np.asarray(intervals, dtype=np.int64)
        np.add.at(edge, a[:, 0], 1)
        np.add.at(edge, np.minimum(a[:, 0] + a[:, 1] + window - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0
