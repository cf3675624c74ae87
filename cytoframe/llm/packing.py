"""Packing of token ids into windows: non-negative least squares over shallow length combinations.

Documents longer than a window are cut at multiples of it; whole windows are sequences of their own.
What is left of each document is a piece shorter than a window. From the histogram of piece lengths
(as many bins as the window is long, whatever the corpus), shallow combinations of lengths that fill
a window are listed, their repeat counts are solved against the histogram by non-negative least
squares and rounded, and the residual is packed greedily. The plan is arithmetic on ranks: the k-th
piece of a length goes where the plan says, so executors place their pieces without a shuffle of
token ids.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.llm._session import durable
from cytoframe.llm._text import slices

LENGTH, END_ID = 2048, 1
#: Combinations listed for each longest length, and steps of the solver.
FILLS, STEPS = 12, 400
#: Bytes of parts and ids that a task keeps at most, but for those of one slice; bytes of texts in a slice, one text at least.
CACHE_BYTES, SLICE_BYTES = 128 << 20, 8 << 20


def combinations(histogram: np.ndarray, window: int, fills: int = FILLS) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a window exactly, or as nearly as one or two more lengths can."""
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    rows = []
    for a in present[present < window]:
        rest = window - a
        fit = present[: np.searchsorted(present, rest, "right")]
        if not len(fit):
            rows.append((a, 0, 0))
            continue
        best = fit[-1]
        if best <= a:
            rows.append((a, best, 0))
        if best != rest or fills > 1:
            seconds = fit[fit < rest]
            for b in seconds[np.unique(np.linspace(0, len(seconds) - 1, min(fills, len(seconds))).astype(int))] if len(seconds) else ():
                third = fit[np.searchsorted(fit, rest - b, "right") - 1] if rest - b >= fit[0] else 0
                if a >= b >= third:
                    rows.append((a, b, third))
    return np.array(sorted(set(rows)), np.int64).reshape(-1, 3)


def solve_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x of the combinations, least squares of what they use against the histogram.

    Multiplicative updates, which keep x non-negative; lengths are weighed alike.
    """
    used = rows > 0
    which = np.where(used, rows, 0)
    target = histogram.astype(np.float64)

    def back(v):
        return (v[which] * used).sum(1)

    def ahead(x):
        return np.bincount(which.ravel(), (x[:, None] * used).ravel(), len(histogram))

    pull = back(target)
    x = pull / np.maximum(back(ahead(np.ones(len(rows)))), 1e-12)
    for _ in range(steps):
        x = x * pull / np.maximum(back(ahead(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = LENGTH) -> list[tuple[np.ndarray, int]]:
    """(lengths, repeats) of sequences that use up the histogram of pieces of 1 to window tokens."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = []
    if left[window]:
        out.append((np.array([window]), int(left[window])))
        left[window] = 0
    rows = combinations(left, window)
    if len(rows):
        x = np.rint(solve_counts(rows, left)).astype(np.int64)
        slack = window - rows.sum(1)
        for k in np.lexsort((-x, slack)):
            lengths = rows[k][rows[k] > 0]
            if slack[k] > window // 64:  # such combinations are left to the greedy step
                continue
            distinct, times = np.unique(lengths, return_counts=True)
            if (n := min(int(x[k]), int((left[distinct] // times).min()))) > 0:
                out.append((lengths, n))
                left[distinct] -= n * times
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        chosen, room = [], window
        free = left.copy()
        while True:
            fit = np.flatnonzero(free[: room + 1])
            if not len(fit):
                break
            a = int(fit[-1])
            n = min(int(free[a]), room // a)
            chosen += [a] * n
            free[a] -= n
            room -= a * n
        lengths = np.array(chosen)
        distinct, times = np.unique(lengths, return_counts=True)
        n = int((left[distinct] // times).min())
        out.append((lengths, n))
        left[distinct] -= n * times


class Placement:
    """For each length, ranges of ranks with the first sequence and the offset there."""

    def __init__(self, sequences: list[tuple[np.ndarray, int]]):
        entries: list[tuple[int, int, int, int]] = []
        at: dict[int, int] = {}
        base = 0
        for lengths, repeats in sequences:
            offset = 0
            for a in map(int, lengths):
                entries.append((a, at.get(a, 0), base, offset))
                at[a] = at.get(a, 0) + repeats
                offset += a
            base += repeats
        table = np.array(sorted(entries), np.int64).reshape(-1, 4)
        self.sequences = base
        self.length, self.rank, self.base, self.offset = table.T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.int64(1) << 44
        at = np.searchsorted(self.length * key + self.rank, length * key + rank, "right") - 1
        return self.base[at] + rank - self.rank[at], self.offset[at]


#: Units made of these alone may be cut into runs of letters, digits and the rest: none of them joins
#: its neighbours on the way to ids. Apostrophes and angle brackets, which may, are missing.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-;=?-@\[-`{{-~]*")
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|\n|[^{_LETTERS}0-9\n]+")
_WORD = re.compile(rf"[{_LETTERS}]+")
#: Stands for the end of a unit among ids.
_CUT = 0xFFFFFFFF


@lru_cache(2)
def _parsed(tokenizer_json: str):
    """The tokenizer; one for lines of words of letters, which spaces alone part; and which ids end a word.

    The second lacks the pattern that parts letters from the rest. It must agree with the first on a
    line of the vocabulary's words, else the first takes its place. Nothing here learns from texts.
    """
    from tokenizers import Tokenizer

    full, rules = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
    vocabulary, suffix = rules["model"]["vocab"], rules["model"].get("end_of_word_suffix")
    ends = np.zeros(max(full.get_vocab().values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
    normal, split = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    if normal.get("type") != "Sequence" or split.get("type") != "Sequence":
        return full, full, ends
    normal["normalizers"] = [x for x in normal["normalizers"] if x["type"] == "Lowercase"]
    split["pretokenizers"] = [x if x["type"] != "Split" else {"type": "WhitespaceSplit"} for x in split["pretokenizers"]]
    light = Tokenizer.from_str(json.dumps(rules))
    words = [w for t in list(vocabulary)[:: 1 + len(vocabulary) // 2000] if _WORD.fullmatch(w := t.removesuffix(suffix or ""))]
    line = " ".join([*words, *map("".join, zip(words, words[::-1])), "\u00c9a", "\u00e7\u00e0", "\u00dcber", "\u00ff"])
    same = light.encode(line, add_special_tokens=False).ids == full.encode(line, add_special_tokens=False).ids
    return full, light if same else full, ends


class Encoder:
    """Ids of texts. Within a task it keeps the ids of the parts of units that it has seen, up to a bound in bytes.

    Units are told apart by a dictionary encoding of the strings themselves, parts by a dictionary.
    """

    def __init__(self, tokenizer_json: str, most: int = CACHE_BYTES):
        self.tokenizer, self.by_space, self.ends = _parsed(tokenizer_json)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, bytes] = {"\n": _CUT.to_bytes(4, "little")}
        self.kept = 0

    def strings(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one call: the token that ends a word shows where to cut."""
        out: list[bytes] = []
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        for group, found in zip(groups, self.by_space.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                data, cuts = ids.tobytes(), (4 * cuts).tolist()
                out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self.strings(group)
        return out

    def of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and where each unit's begin: plain units from the ids of their parts, the others as they are."""
        if self.kept > self.most:
            self.forget()
        odd = [k for k, u in enumerate(units) if not _PLAIN.fullmatch(u)]
        whole = [units[k] for k in odd]
        for k in odd:
            units[k] = ""
        every = _PARTS.findall("\n".join(units) + "\n")
        parts = set(every).difference(self.parts)
        words = list(filter(_WORD.fullmatch, parts))
        rest = list(parts.difference(words))
        for some, ids in ((words, self.words(words)), (rest, self.strings(rest))):
            self.parts.update(zip(some, ids))
            self.kept += sum(map(len, ids)) + 150 * len(some)  # two small objects and their place
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, every)), "<u4")
        ends = np.flatnonzero(ids == _CUT)
        size = np.diff(ends, prepend=-1) - 1
        ids = np.delete(ids, ends)
        if odd:
            at = np.cumsum(size)[odd]
            more = [np.frombuffer(x, "<u4") for x in self.strings(whole)]
            size[odd] = [len(x) for x in more]
            ids = np.insert(ids, np.repeat(at, size[odd]), np.concatenate(more))
        return ids, np.append(0, np.cumsum(size))

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        ids = [np.frombuffer(x, "<u4") for x in self.strings([t or "" for t in texts.to_pylist()])]
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), by units: what stands between ASCII white space, each kind of unit encoded once.

        Right for tokenizers that fold case, drop white space, part letters, single digits and marks
        from each other, and treat a unit alike anywhere.
        """
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens are spelt in one case
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, at = self.of_units(coded.dictionary.to_pylist())
        unit = coded.indices.to_numpy()
        size = np.diff(at)[unit]
        ends = np.append(0, np.cumsum(size))
        source = np.repeat(at[unit] - ends[:-1], size) + np.arange(ends[-1])
        return ids[source], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def cut_pieces(docs: DataFrame, tokenizer_json: str, window: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, chunked: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank[, ids]): the pieces of every document.

    rank numbers the pieces of one length within a partition. A null text counts as empty and so
    gives the end id alone.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer_json)
        encode = encoder.chunked if chunked else encoder.whole
        seen: dict[int, int] = {}
        last = int(end_id).to_bytes(4, "little")
        for big in batches:
            for batch in slices(big, "text", SLICE_BYTES):
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"] + ["ids"] * with_ids
                rows = {n: [] for n in names}
                ids, bounds = encode(batch.column("text"))
                data = ids.tobytes()
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = data[4 * a : 4 * b] + last
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        for name, value in zip(names, (doc_id, start, length, zlib.crc32(piece), n, part, rank, piece)):
                            rows[name].append(value)
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds)], names=names)

    more = ", ids binary" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long{more}")


def pack_tokens(docs: DataFrame, tokenizer_json: str, window: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, chunked: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    Each id of each document (its ids, then end_id) lies in one piece; a sequence's pieces lie end to
    end from offset 0 and hold window ids at most. Repeated rows and ids are documents of their own.
    An empty table gives no rows. The driver holds the histogram of lengths, window + 1 numbers.
    """
    pieces = durable(cut_pieces(docs, tokenizer_json, window, end_id, with_ids, chunked))
    counts = durable(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # window rows at most
        histogram[length] = n
    placement = Placement(plan(histogram, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for batch in batches:
            sequence, offset = placement.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)] + ([batch.column("ids")] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"] + ["ids"] * with_ids)

    more = ", ids binary" if with_ids else ""
    return ranked.mapInArrow(place, f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{more}")
