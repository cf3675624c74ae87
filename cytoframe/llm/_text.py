"""Vectorised hashing of words and windows over a batch of texts laid end to end as UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x):
    """Finaliser of a 64-bit hash (xor-shift and multiply), elementwise."""
    x = np.array(x, U)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(33)
    return x


def byte_values(fold_case: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte; with fold_case, A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    if fold_case:
        values[65:91] = values[97:123]
    return values


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    return _powers(base, 1 << max(16, (max(n, 1) - 1).bit_length()))[:n]


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2**64: out[j] - out[i] stands for values[i:j], up to the factor BASE**i.

    They are quick but weak: there are texts that collide under every base. They may choose anchors
    and guide a search; what they call equal must be checked.
    """
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def rolling_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size values, in order, the same wherever it stands."""
    n = len(prefix) - size
    return mix((prefix[size:] - prefix[:n]) * powers(INVERSE, n) + U(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


#: The modulus of word hashes, and for each of two lanes a random base and an odd factor.
PRIME = (1 << 61) - 1
LANES = ((0x1B6F3A94D2C85E17, 0xD1B54A32D192ED03), (0x0C92E7715FA3D48B, 0x8CB92BA72F3D8DD7))
#: Letters of a word that one polynomial takes; longer words add up their parts.
PART, STEP = 1 << 12, 1 << 14
_LOW = U((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


@lru_cache(4)
def _split_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """High 30 and low 31 bits of the powers of a base modulo PRIME, a table of PART constants."""
    every, now = [], 1
    for _ in range(PART):
        every.append(now)
        now = now * base % PRIME
    every = np.array(every, U)
    return every >> U(31), every & _LOW


def polynomials(values: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, bases: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes modulo PRIME, one a base, of each data[start:end], not empty, with a value of 1 to 256 for each byte.

    Two words collide for fewer than as many bases as they have letters, of 2**61.
    """
    size = end - start
    if len(size) and size.max() > PART:
        parts = -(-size // PART)
        first = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(size)), parts)
        begin = start[owner] + (np.arange(len(owner)) - first[owner]) * PART
        cut = polynomials(values, data, begin, np.minimum(begin + PART, end[owner]), bases)
        out = [x[first] for x in cut]
        for k in np.flatnonzero(parts > 1):
            for base, x, own in zip(bases, cut, out):
                step, total = pow(base, PART, PRIME), 0
                for part in x[first[k] : first[k] + parts[k]][::-1].tolist():
                    total = (total * step + part) % PRIME
                own[k] = total
        return out
    out, ends, at = [np.zeros(len(size), U) for _ in bases], np.cumsum(size), 0
    while at < len(size):  # about STEP bytes at a time, which stay in a core's cache
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        own = size[at:stop]
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        v = values.take(data.take(place + np.repeat(start[at:stop], own)))
        for base, x in zip(bases, out):
            high, low = _split_powers(base)
            h, l = np.add.reduceat(high.take(place) * v, first), np.add.reduceat(low.take(place) * v, first)
            h = _reduced(h)
            x[at:stop] = _reduced(((h << U(31)) & U(PRIME)) + (h >> U(30)) + _reduced(l))  # h times 2**31, and l
        at = stop
    return out


#: Values of bytes, from 1; with letters A-Z as a-z in the second row.
_BYTES = np.tile(np.arange(1, 257, dtype=U), (2, 1))
_BYTES[1, 65:91] = _BYTES[1, 97:123]


def join(left: np.ndarray, right: np.ndarray, factor: int) -> np.ndarray:
    """Hash of a run from the hashes of its two parts; not linear, so no pattern of words cancels out."""
    return mix(left * U(factor) + right)


def window_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of every `size` words in a row, given the words' hashes, from runs of 1, 2, 4 and so on."""
    factor, n = LANES[lane][1], len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    run, width, out, done = words, 1, None, 0
    while True:
        if size & width:
            part = run[done : done + n]
            out = part if out is None else join(out, part, factor)
            done += width
        if (width := 2 * width) > size:
            break
        run = join(run[: len(run) - width // 2], run[width // 2 :], factor)
    return mix(out + U(size))


class Texts:
    """A batch of texts as one byte buffer; null counts as empty."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        self.n = len(column)
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        first, last = (int(self.offsets[0]), int(self.offsets[-1]))
        self.offsets = self.offsets - first
        self.bytes = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)

    def raw(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch, in order, of rows whose texts take `most` bytes together, or of one row."""
    sizes = np.diff(Texts(batch.column(batch.schema.names.index(column))).offsets)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Maximal runs of bytes outside a set of separators, of a batch of texts.

    start, end: byte bounds; first: the first word of each text, and the number of words at the end.
    """

    def __init__(self, texts: Texts, separators: np.ndarray = SPACES):
        inside = ~separators[texts.bytes]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        bounds = texts.offsets
        before[bounds[:-1][bounds[:-1] < n]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self, texts: Texts, fold_case: bool = False) -> np.ndarray:
        return self.lanes(texts, 1, fold_case)[0]

    def lanes(self, texts: Texts, lanes: int, fold_case: bool = False) -> list[np.ndarray]:
        """Independent 64-bit hashes of the words, one array a lane."""
        bases = tuple(base for base, _ in LANES[:lanes])
        return [mix(x) for x in polynomials(_BYTES[int(fold_case)], texts.bytes, self.start, self.end, bases)]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of size words that lie in one text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        here = np.arange(len(self.start))
        return here[here + size <= last]
