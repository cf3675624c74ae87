"""Substring dedup over words with difference-cover anchors.

Positions of a document whose remainder modulo PERIOD lies in COVER carry an anchor, a hash of
WINDOW - PERIOD + 1 words. Any two equal windows of WINDOW words have, at some common offset under
PERIOD, positions of the cover in both, so they share an anchor. Anchors that occur in one document
only end the matter. Windows that hold a shared anchor, within a block or across blocks, are extended
to all WINDOW words and compared by two independent 64-bit hashes, for the smallest doc_id in which
each begins; no other window is looked at. Words are hashed modulo a prime and runs of them by a tree
of hashes, so no pattern of letters or words makes two windows collide.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cytoframe.llm import _blocks as B
from cytoframe.llm._text import Texts, Words, window_hashes

U = np.uint64
#: A difference cover; every remainder modulo 7 is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
#: Of anchors to bytes of text, for the sizes of key ranges.
KEYS_PER_BYTE = 0.08
NO_DOC = np.iinfo(np.int64).min


def _anchors(words: Words, hashes: np.ndarray, size: int, period: int, cover: tuple, bits: int):
    """Places and keys of the anchors of a batch."""
    span = size - period + 1
    at = words.windows(span)
    inside = at - np.repeat(words.first[:-1], np.diff(words.first))[at]
    at = at[np.isin(inside % period, cover)]
    return at, window_hashes(hashes, span)[at] >> U(64 - bits)


def _in_two(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Ascending keys that stand in more than one document."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def _around(words: Words, at: np.ndarray, size: int, period: int) -> np.ndarray:
    """First words of the windows that hold one of the anchors at the given places, aligned within a period."""
    marks = np.zeros(len(words.start) + period + 1, np.int64)
    np.add.at(marks, np.maximum(at - period + 1, 0), 1)
    np.add.at(marks, at + 1, -1)
    starts = words.windows(size)
    return starts[np.cumsum(marks)[starts] > 0]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(NO_DOC).to_numpy()


def _least(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray):
    """Distinct (key, check) ascending, their smallest document and the place of each pair among them."""
    order = np.lexsort((docs, checks, keys))
    k, c = keys[order], checks[order]
    head = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(head) - 1
    return k[head], c[head], docs[order][head], place


def remove_repeated_windows(docs: DataFrame, size: int = WINDOW, period: int = PERIOD, cover: tuple = COVER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without the words of windows begun in a smaller doc_id.

    A window is `size` consecutive words (runs outside U+0020 and U+0009-U+000D) of one document.
    It is judged on the input. Null and empty texts have no words; kept_text is then empty. Rows
    with one doc_id count as one document; a null doc_id is smaller than any other. Other columns
    are ignored. Size must be at least the period.
    """
    if size < period:
        raise ValueError("size must be at least the period")
    blocks, plan = B.in_blocks(docs, KEYS_PER_BYTE)
    bits = plan.bits

    def send(key, table):
        texts = Texts(table.column("text"))
        words = Words(texts)
        _, keys = _anchors(words, words.hashes(texts), size, period, cover, bits)
        keys = np.unique(keys)
        return B.packets(key[0].as_py(), keys, [np.ones(len(keys), np.int64)], bits, plan.coarse)

    def read(table, reply, columns):
        """A block's words, its rows' ids by word, window hashes in two lanes, and the windows around anchors of two of its documents or of those in the reply."""
        texts = Texts(table.column("text"))
        words = Words(texts)
        lanes = words.lanes(texts, 2)
        of = _ids(table)[words.text_of()]
        at, keys = _anchors(words, lanes[0], size, period, cover, bits)
        there = B.lookup(_in_two(keys, of[at]), keys)[1]
        if columns == 0:
            there |= B.lookup(B.received(reply, 1)[0], keys)[1]
        return texts, words, of, [window_hashes(x, size, k) for k, x in enumerate(lanes)], _around(words, at[there], size, period)

    def extend(key, table, reply):
        _, _, of, (full, check), starts = read(table, reply, 0)
        keys, checks, least, _ = _least(full[starts], check[starts].view(np.int64), of[starts])
        return B.packets(key[0].as_py(), keys, [checks, least], 64, plan.coarse)

    def cut(key, table, reply):
        texts, words, of, (full, check), starts = read(table, reply, 2)
        check = check.view(np.int64)
        _, _, least, place = _least(full[starts], check[starts], of[starts])
        gone = [starts[least[place] < of[starts]]]
        known, checks, docs = B.received(reply, 2)
        every = words.windows(size)
        low, high = (np.searchsorted(known, full[every], side) for side in ("left", "right"))
        for far in range(int((high - low).max()) if len(every) else 0):  # one step, but for windows that share a key and not a check
            some = np.flatnonzero(low + far < high)
            at = low[some] + far
            gone.append(every[some[(checks[at] == check[every[some]]) & (docs[at] < of[every[some]])]])
        gone = np.unique(np.concatenate(gone))
        cover_ = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(cover_, gone, 1)
        np.add.at(cover_, gone + size, -1)
        removed = np.cumsum(cover_)[:-1] > 0
        kept, n_removed = [], np.zeros(texts.n, np.int64)
        for i in range(texts.n):
            a, b = words.first[i], words.first[i + 1]
            mask = removed[a:b]
            n_removed[i] = mask.sum()
            parts = texts.raw(i).split()
            kept.append((b" ".join(compress(parts, ~mask) if n_removed[i] else parts)).decode("utf-8"))
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": np.diff(words.first).astype(np.int64), "n_removed": n_removed, "kept_text": pa.array(kept, pa.string())})

    told = B.exchange(blocks.groupBy("block").applyInArrow(send, B.PACKET), "+", plan, bits)
    wide = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(extend, B.PACKET)
    least = B.exchange(wide, "=<", plan, 64)
    return blocks.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
