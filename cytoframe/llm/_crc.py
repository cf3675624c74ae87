"""CRC-32 of many byte runs at once, and of runs joined, from the CRCs of their parts.

A CRC is linear: that of A followed by B is that of A moved on by as many bytes as B has, xor that
of B. So the CRC of a run of words comes from those of its words, and no joined text is built.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Runs up to so many bytes are hashed column by column and moved by one table; longer ones by powers of two.
NEAR, POWERS = 64, 48


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1)
    return x


_BYTE = _byte_table()
_SPACE = np.uint32(zlib.crc32(b" "))


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, as four tables of 256 entries, one a byte."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


@lru_cache(1)
def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Maps that move a CRC on by 0 to NEAR bytes, and by 2**k bytes."""
    start = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    one = _BYTE[start & 255] ^ (start >> 8)
    near = [start]
    for _ in range(NEAR):
        near.append(_through(one, near[-1]))
    powers = [one]
    for _ in range(POWERS - 1):
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(near), np.stack(powers)


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs moved on by `size` bytes each."""
    near, powers = _moves()
    flat, at = near.reshape(-1), np.minimum(size, NEAR) * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]
    far = np.flatnonzero(size > NEAR)
    if len(far):
        x, rest = crc[far], size[far]
        for k in range(int(rest.max()).bit_length()):
            x = np.where((rest >> k) & 1, _through(powers[k], x), x)
        out[far] = x
    return out


def then_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of the runs, each with a space behind it."""
    return _through(_moves()[0][1], crc) ^ _SPACE


def joined(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """CRCs of runs that follow each other."""
    return moved(left, right_size) ^ right


def crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each data[start : start + size]."""
    order = np.argsort(size, kind="stable")
    place, sizes = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    short = int(np.searchsorted(sizes, NEAR, "right"))
    cuts = np.searchsorted(sizes[:short], np.arange(int(sizes[short - 1]) if short else 0), "right")
    for k, i in enumerate(cuts):
        now = crc[i:short]
        crc[i:short] = _BYTE[(now ^ data[place[i:short] + k]) & 255] ^ (now >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(short, len(order)):
        crc[k] = zlib.crc32(data[place[k] : place[k] + sizes[k]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out
