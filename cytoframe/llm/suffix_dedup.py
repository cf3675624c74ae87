"""Substring dedup over bytes with a hash-compared suffix sort.

Every window of LENGTH bytes has an anchor, the least of its grams of GRAM bytes by hash, leftmost
among equals; equal windows have equal anchors at equal places. Consecutive windows with one anchor
form a segment, about one a GRAM bytes of text. Segments whose anchor occurs nowhere else hold no
repeat. The others meet by anchor hash: first segments of one shape, then the windows of what is left,
grouped by anchor and by where they start from it, are sorted by mergesort, where two strings are
compared by a binary search for their longest common extension over prefix polynomial hashes. Every
pair of neighbours is then compared byte by byte: those that are equal are one class, and a group
whose order a collision has spoilt is sorted again by its bytes, so hashes decide nothing. The first
of equals in the order of (doc_id, start) stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from cytoframe.llm import _blocks as B
from cytoframe.llm._text import INVERSE, Texts, byte_values, mix, powers, prefix_hash, rolling_hash

U = np.uint64
LENGTH, GRAM = 100, 24
#: Bits of a position in a block; a block is one document at least, so documents up to 2**32 bytes fit.
PLACE_BITS = 32
KEYS_PER_BYTE, RANGE_BYTES = 0.03, 8 << 20
#: Window starts that are hashed at once.
SLICE = 1 << 20
NO_DOC = np.iinfo(np.int64).min


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values in a row, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Segments:
    """Runs of window starts with one anchor: start, count, place of the anchor from the start, and key of each, in order."""

    def __init__(self, texts: Texts, length: int, gram: int, bits: int):
        n, mask = len(texts.bytes), U((1 << PLACE_BITS) - 1)
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)]
        for a in range(0, n - length + 1, SLICE):  # of window starts, so that a long text takes no more room
            b = min(a + SLICE, n - length + 1)
            grams = rolling_hash(prefix_hash(byte_values(False)[texts.bytes[a : b + length - 1]]), gram)
            anchor = (sliding_least((grams & ~mask) | np.arange(len(grams), dtype=U), length - gram + 1) & mask).astype(np.int64)
            start = np.arange(a, b)
            anchor[start + length > texts.offsets[np.searchsorted(texts.offsets, start, "right")]] = -1
            cuts = np.flatnonzero(np.diff(anchor, prepend=-2))
            count, real = np.diff(np.append(cuts, b - a)), anchor[cuts] >= 0
            cuts, count = cuts[real], count[real]
            parts.append((a + cuts, count, a + anchor[cuts], mix(grams[anchor[cuts]]) >> U(64 - bits)))  # least hashes are small; mixed, they spread over ranges
        start, count, place, key = (np.concatenate(x) for x in zip(*parts))
        new = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + count[:-1])) if len(start) else np.zeros(0, bool)
        self.count = np.add.reduceat(count, np.flatnonzero(new)) if len(start) else count
        self.start, self.rel, self.key = start[new], (place - start)[new], key[new]
        self.text = np.searchsorted(texts.offsets, self.start, "right") - 1


def later(doc, pos, first):
    """Whether an entry stands strictly after the first of its kind."""
    return (doc > doc[first]) | ((doc == doc[first]) & (pos > pos[first]))


def eights(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the order of strings."""
    return sliding_window_view(data, 8)[at].view(">u8").ravel().astype(U) if len(at) else np.zeros(0, U)


def compared(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the bytes at a are less than, equal to or more than those at b."""
    out = np.zeros(len(a), np.int8)
    for d in np.unique(depth).tolist():
        rows, every = np.flatnonzero(depth == d), sliding_window_view(data, d)
        for at in range(0, len(rows), 1 << 14):
            some = rows[at : at + (1 << 14)]
            left, right = every[a[some]], every[b[some]]
            first = (left != right).argmax(1)[:, None]
            left, right = (np.take_along_axis(x, first, 1).ravel() for x in (left, right))
            out[some] = (left > right).astype(np.int8) - (left < right)
    return out


class Suffixes:
    """Strings in a byte buffer, given by start and depth, compared by hashes and checked by bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix, self.back = prefix_hash(byte_values(False)[data]), powers(INVERSE, len(data) + 1)

    def hashed(self, at, size):
        return (self.prefix[at + size] - self.prefix[at]) * self.back[at]

    def common(self, a, b, depth):
        """Longest common extension up to depth, by binary search."""
        low, high = np.zeros(len(a), np.int64), depth.copy()
        whole = self.hashed(a, high) == self.hashed(b, high)
        low[whole] = depth[whole]
        open_ = np.flatnonzero(~whole)
        high[open_] -= 1
        while len(open_):
            x, y = a[open_], b[open_]
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.hashed(x, middle) == self.hashed(y, middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def before(self, a, b, depth, or_equal):
        """Whether the string at a sorts before that at b; or_equal says what equals give."""
        size = self.common(a, b, depth)
        out = or_equal.copy()
        some = np.flatnonzero(size < depth)
        out[some] = self.data[a[some] + size[some]] < self.data[b[some] + size[some]]
        return out

    def merged(self, starts: np.ndarray, group: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Order of the strings by group, then as strings: a mergesort of all groups at once. Depths are alike within a group.

        In each pass an element's new place is its place in its own run plus the number of elements
        of the neighbouring run that go before it, found by binary search.
        """
        head = eights(self.data, starts)  # in a group, strings of other first bytes needn't be compared
        order = np.lexsort((head, group))
        g, h = group[order], head[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(order)))
        base, total = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while width < (size.max() if len(size) else 0):
            at = np.flatnonzero(total > width)
            local = at - base[at]
            run = local // width
            own, right = run * width, run % 2 == 1
            low = np.where(right, own - width, own + width)
            high = np.minimum(low + width, total[at])
            low = np.minimum(low, high)
            begin, mine, deep = low.copy(), starts[order[at]], depth[order[at]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                other = starts[order[base[at[open_]] + middle]]
                goes = self.before(other, mine[open_], deep[open_], right[open_])  # a run's equals stay behind those on its left
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            place = base[at] + np.where(right, own - width, own) + (local - own) + (low - begin)
            new = order.copy()
            new[place] = order[at]
            order = new
            width *= 2
        return order

    def may_repeat(self, starts: np.ndarray, group: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Places of the strings that share their group, first and last eight bytes with another one, by a hash of the three."""
        code = mix(mix(group.astype(U) * U(0x9E3779B97F4A7C15) + eights(self.data, starts)) + eights(self.data, starts + depth - 8))
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        both = np.zeros(len(order), bool)
        both[1:] |= same
        both[:-1] |= same
        return np.sort(order[both])

    def sort(self, starts: np.ndarray, group: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by group and string, and for each but the first whether it equals its predecessor, both as the bytes have it."""
        order = self.merged(starts, group, depth)
        near = np.flatnonzero(group[order[1:]] == group[order[:-1]])
        for again in (True, False):
            a, b = order[near], order[near + 1]
            sign = compared(self.data, starts[a], starts[b], depth[a])
            spoilt = np.unique(group[a[sign > 0]])
            if not again or not len(spoilt):
                break
            for g in spoilt:  # a collision of hashes
                own = np.flatnonzero(group[order] == g)
                order[own] = sorted(order[own], key=lambda k: self.data[starts[k] : starts[k] + depth[k]].tobytes())
        equal = np.zeros(max(len(order) - 1, 0), bool)
        equal[near] = sign == 0
        return order, equal


def least_of_equals(order: np.ndarray, equal: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each element the one of its class that is least by (doc, pos); order and equal as sort gives them."""
    if not len(order):
        return order
    label = np.cumsum(np.append(0, ~equal))
    by = np.lexsort((pos[order], doc[order], label))
    ranked, marks = order[by], label[by]
    head = np.append(True, marks[1:] != marks[:-1])
    out = np.empty(len(order), np.int64)
    out[ranked] = ranked[head][np.cumsum(head) - 1]
    return out


def firsts(data, begin, key, rel, count, doc, pos, length, most: int = 1 << 22):
    """For each segment the first, by (doc, pos), of those equal to it.

    Segments of one key and shape are taken by (doc, pos): one whose bytes are those of the one before it
    is of its class, which settles periodic texts and common passages. The others are sorted, `most` bytes
    of them or so at a time.
    """
    first = np.arange(len(key))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.append(False, same) | np.append(same, False)] if len(order) else order
    if not len(order):
        return first
    order = order[np.lexsort((pos[order], doc[order], count[order], rel[order], key[order]))]
    k, r, c = key[order], rel[order], count[order]
    alike = np.append(False, (k[1:] == k[:-1]) & (r[1:] == r[:-1]) & (c[1:] == c[:-1]))
    at = np.flatnonzero(alike)
    equal = compared(data, begin[order[at - 1]], begin[order[at]], c[at] - 1 + length) == 0
    new = np.ones(len(order), bool)  # heads of runs of equals
    new[at[equal]] = False
    heads, run = order[new], np.cumsum(new) - 1
    shape = np.cumsum(~alike)[new]
    size = np.bincount(shape)
    some = np.flatnonzero(size[shape] > 1)  # what may have an equal further on
    load = np.cumsum(count[heads[some]] - 1 + length)
    whole = np.append(shape[some][1:] != shape[some][:-1], True) if len(some) else np.zeros(0, bool)
    best, at = heads.copy(), 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + most, "right")))
        end = end + int(np.argmax(whole[end - 1 :]))  # to the end of a shape
        m, group = heads[some[at:end]], shape[some[at:end]]
        depth = count[m] - 1 + length
        of, far = _spread(depth)
        strings, start = Suffixes(data[begin[m][of] + far]), np.cumsum(depth) - depth
        may = strings.may_repeat(start, group, depth)
        m = m[may]
        best[some[at:end][may]] = m[least_of_equals(*strings.sort(start[may], group[may], depth[may]), doc[m], pos[m])]
        at = end
    first[order] = best[run]
    return first


def runs(owner: np.ndarray, offset: np.ndarray):
    """Runs of consecutive offsets of each owner: owner, first and last of each; input by owner and offset."""
    cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(owner)) - 1 if len(cut) else cut
    return owner[cut], offset[cut], offset[ends]


def _spread(count: np.ndarray):
    """Owner and offset of each of count[k] elements for each k."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _sorted_repeats(data, begin, key, rel, doc, pos, owner, offset, length):
    """(owner, offset) of the windows, among those given, that have an equal one before them in (doc, pos)."""
    start = begin[owner] + offset
    _, of_key = np.unique(key[owner], return_inverse=True)
    group, depth = of_key.astype(np.int64) << 12 | (rel[owner] - offset), np.full(len(start), length)
    strings = Suffixes(data)
    some = strings.may_repeat(start, group, depth)
    owner, offset = owner[some], offset[some]
    d, p = doc[owner], pos[owner] + offset
    least = least_of_equals(*strings.sort(start[some], group[some], depth[some]), d, p)
    worse = (d > d[least]) | ((d == d[least]) & (p > p[least]))
    return owner[worse], offset[worse]


def _shared(level, of, owner, low, high):
    """The runs of entries `of` as runs of entries `level`; owner ascends."""
    a, b = (np.searchsorted(owner, of, side) for side in ("left", "right"))
    which, far = _spread(b - a)
    at = a[which] + far
    return level[which], low[at], high[at]


def _batches(key: np.ndarray, count: np.ndarray, rel: np.ndarray, most: int):
    """Windows of segments, in (owner, offset), that may be equal and so must meet: `most` of them or so at a time.

    Segments come by key. Whole keys go together; a key with more windows is cut by where they start from the anchor.
    """
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(cuts[1:], len(key))
    load = np.add.reduceat(count, cuts)
    at = 0
    while at < len(cuts):
        end = at + max(1, int(np.searchsorted(np.cumsum(load[at:]), most, "right")))
        owner, a, b = None, cuts[at], ends[end - 1]
        if load[at] <= most:
            owner, offset = _spread(count[a:b])
            yield owner + a, offset
        else:
            own = np.arange(a, b)
            step = max(1, most // len(own))
            for far in range(int((rel[own] - count[own] + 1).min()), int(rel[own].max()) + 1, step):
                place = far + np.arange(step)
                offset = rel[own][:, None] - place
                i, j = np.nonzero((offset >= 0) & (offset < count[own][:, None]))
                yield own[i], offset[i, j]
        at = end


def repeated_windows(data, begin, count, rel, key, doc, pos, length, most: int = 1 << 17):
    """(segment, first, last) of window starts that begin earlier elsewhere, from one segment of each block and content."""
    first = firsts(data, begin, key, rel, count, doc, pos, length)
    gone = later(doc, pos, first)
    heads = np.flatnonzero(first == np.arange(len(first)))
    _, of_key, keys = np.unique(key[heads], return_inverse=True, return_counts=True)
    heads = heads[keys[of_key] > 1]
    heads = heads[np.argsort(key[heads], kind="stable")]
    owners, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for owner, offset in _batches(key[heads], count[heads], rel[heads], most) if len(heads) else ():
        used, owner = np.unique(owner, return_inverse=True)
        m = heads[used]
        size = count[m] - 1 + length
        of, at = _spread(size)
        o, f = _sorted_repeats(data[begin[m][of] + at], np.cumsum(size) - size, key[m], rel[m], doc[m], pos[m], owner, offset, length)
        owners.append(m[o])
        offsets.append(f)
    owner, offset = np.concatenate(owners), np.concatenate(offsets)
    by = np.lexsort((offset, owner))
    owner, low, high = runs(owner[by], offset[by])
    # What holds for the first of a content holds for those that stand at the same place.
    level, whole = np.flatnonzero(~gone & (first != np.arange(len(first)))), np.flatnonzero(gone)
    parts = [(whole, np.zeros(len(whole), np.int64), count[whole] - 1), (owner, low, high), _shared(level, first[level], owner, low, high)]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts))


def _ordered(table: pa.Table) -> pa.Table:
    """A block's rows in an order of their own: a shuffle may bring them in another one each time it is read."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ids(table, segments):
    return table.column("doc_id").cast(pa.int64()).fill_null(NO_DOC).to_numpy()[segments.text]


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without bytes of `length`-byte strings that start earlier.

    Earlier is a smaller doc_id, or a smaller start in the same document; matches never cross
    documents, overlap counts, and strings are judged on the input. kept holds the remaining bytes;
    it may split a code point. Null texts count as empty, null ids as smaller than any other, and of
    rows with one doc_id those at a larger start yield to the others. Other columns are ignored.
    """
    if length <= gram or length - gram >= 4096 or length < 8:
        raise ValueError("length must be 8 at least, over gram and within gram + 4095")
    blocks, plan = B.in_blocks(docs, KEYS_PER_BYTE, RANGE_BYTES)
    bits, ranges = min(plan.bits, 64), plan.ranges

    def send(key, table):
        segments = Segments(Texts(table.column("text")), length, gram, bits)
        keys = np.unique(segments.key)
        return B.packets(key[0].as_py(), keys, [np.ones(len(keys), np.int64)], bits, plan.coarse)

    def offer(key, table, reply):
        table = _ordered(table)
        texts = Texts(table.column("text"))
        s = Segments(texts, length, gram, bits)
        doc, pos = _ids(table, s), s.start - texts.offsets[s.text]
        first = firsts(texts.bytes, s.start, s.key, s.rel, s.count, doc, pos, length)
        mine = np.flatnonzero(first == np.arange(len(first)))
        _, which, times = np.unique(s.key[mine], return_inverse=True, return_counts=True)
        mine = mine[B.lookup(B.received(reply, 1)[0], s.key[mine])[1] | (times[which] > 1)]
        mine = mine[np.argsort(s.key[mine], kind="stable")]
        of = B.range_of(s.key[mine], bits, ranges)
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        packets = []
        for a, b in zip(cuts, np.append(cuts[1:], len(mine))):
            m = mine[a:b]
            owner, offset = _spread(s.count[m] - 1 + length)
            content = texts.bytes[s.start[m][owner] + offset].tobytes()
            head = B.pack(s.key[m], m, doc[m], pos[m], s.count[m], s.rel[m])
            packets.append(len(head).to_bytes(8, "little") + head + len(content).to_bytes(8, "little") + pa.compress(content, codec="zstd", asbytes=True))
        return pa.table({"range": pa.array(of[cuts], pa.int32()), "block": pa.array(np.full(len(cuts), key[0].as_py()), pa.int32()), "packet": pa.array(packets, pa.binary())}, schema=B.PACKETS)

    def decide(table):
        heads, data = [], []
        for packet in table.column("packet"):
            packet = packet.as_py()
            n = int.from_bytes(packet[:8], "little")
            heads.append(packet[8 : 8 + n])
            size = int.from_bytes(packet[8 + n : 16 + n], "little")
            data.append(np.frombuffer(pa.decompress(packet[16 + n :], decompressed_size=size, codec="zstd"), np.uint8))
        block, (key, index, doc, pos, count, rel) = B.gather(pa.table({"block": table.column("block"), "packet": pa.array(heads, pa.binary())}), 5)
        size = count - 1 + length
        owner, low, high = repeated_windows(np.concatenate(data), np.cumsum(size) - size, count, rel, key, doc, pos, length)
        return B.replies(block[owner], index[owner].astype(U), [low, high])

    def cut(key, table, reply):
        table = _ordered(table)
        texts = Texts(table.column("text"))
        s = Segments(texts, length, gram, bits)
        doc, pos = _ids(table, s), s.start - texts.offsets[s.text]
        first = firsts(texts.bytes, s.start, s.key, s.rel, s.count, doc, pos, length)
        late = later(doc, pos, first)
        gone, level = np.flatnonzero(late), np.flatnonzero((first != np.arange(len(first))) & ~late)
        index, low, high = B.received(reply, 2)
        index = index.astype(np.int64)
        parts = [(gone, np.zeros(len(gone), np.int64), s.count[gone] - 1), (index, low, high), _shared(level, first[level], index, low, high)]
        owner, low, high = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        change = np.zeros(len(texts.bytes) + 1, np.int32)
        np.add.at(change, s.start[owner] + low, 1)
        np.add.at(change, s.start[owner] + high + length, -1)
        removed = np.cumsum(change, dtype=np.int32)[:-1] > 0
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        begins = texts.offsets[:-1][texts.offsets[:-1] < len(removed)]
        edge[begins] = removed[begins]
        n_removed, n_spans = (np.diff(np.searchsorted(np.flatnonzero(x), texts.offsets)) for x in (removed, edge))
        kept = [texts.bytes[a:b][~removed[a:b]].tobytes() if n else texts.bytes[a:b].tobytes() for a, b, n in zip(texts.offsets[:-1], texts.offsets[1:], n_removed)]
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_bytes": np.diff(texts.offsets), "n_removed": n_removed, "n_spans": n_spans, "kept": pa.array(kept, pa.binary())})

    told = B.exchange(blocks.groupBy("block").applyInArrow(send, B.PACKET), "+", plan, bits)
    offered = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(offer, B.PACKET)
    decided = offered.groupBy("range").applyInArrow(decide, B.REPLY)
    return blocks.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
