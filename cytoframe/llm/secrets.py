"""Secret scans: patterns of known kinds, and windows of high Shannon entropy."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: The three base kinds and the least length of what must be found.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Character classes of candidates: least length, window, least bits a character in some window.
CLASSES = {
    "hex": (re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Fa-f])"), 20, 2.9),
    "alnum": (re.compile(r"(?<![0-9A-Za-z])[0-9A-Za-z]{20,}(?![0-9A-Za-z])"), 20, 3.6),
    "base64": (re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}"), 24, 3.9),
}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_CAMEL = r"[a-z]*(?:[A-Z][a-z]{2,}|As|At|By|Id|If|In|Is|No|Of|On|Or|To)+"
_WORD = rf"(?:[a-z]{{1,19}}|[A-Z]{{1,19}}|[A-Z][a-z]|{_CAMEL})"
#: Parts that match one of these are no secrets: words in one case or by their capitals, alone and between marks, UUIDs, dates, digits or letters alone.
ALLOW = (
    re.compile(rf"[-_/+=]*{_WORD}(?:[-_/+=]+{_WORD})*[-_/+=]*"),
    re.compile(_CAMEL),
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"[0-9_/+=-]+"),
    re.compile(r"[A-Z]?[a-z]+|[A-Z]+"),
    re.compile(r"(.)\1*"),
)


def high_entropy(text: str, window: int, bits: float) -> tuple[int, int] | None:
    """First start and last end of windows whose Shannon entropy reaches bits; None without any.

    Sums n*log2(n) over the characters of the window and updates it as one leaves and one enters.
    """
    weight = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    count: dict[str, int] = {}
    total, first, last = 0.0, -1, -1
    most = window * (math.log2(window) - bits) + 1e-9
    for i, c in enumerate(text):
        n = count.get(c, 0)
        total += weight[n + 1] - weight[n]
        count[c] = n + 1
        if i >= window:
            gone = text[i - window]
            n = count[gone]
            total += weight[n - 1] - weight[n]
            count[gone] = n - 1
        if i >= window - 1 and total <= most:
            first = i - window + 1 if first < 0 else first
            last = i + 1
    return None if first < 0 else (first, last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def merged(spans) -> list[tuple[int, int]]:
    """Unions of spans (start, end) that overlap, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def uncovered(text: str, base: list[tuple[int, int, int]]):
    """Parts (start, end) of candidates that no base span covers, in one sweep over both."""
    taken, at = merged((s, e) for s, _, e in base), 0
    for candidate in CANDIDATE.finditer(text):
        a, b = candidate.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        k = at
        while k < len(taken) and taken[k][0] < b:
            if taken[k][0] > a:
                yield a, taken[k][0]
            a = max(a, taken[k][1])
            k += 1
        if a < b:
            yield a, b


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of candidates with a window of high entropy in their class, outside base spans and the allow-list."""
    found = []
    for a, b in uncovered(text, base):
        part = text[a:b]
        if any(x.fullmatch(part) for x in ALLOW):
            continue
        ends = []
        for shape, window, bits in CLASSES.values():
            for m in shape.finditer(part):
                if got := high_entropy(m[0], window, bits):
                    ends.append((a + m.start() + got[0], a + m.start() + got[1]))
        if ends:
            found.append((min(x for x, _ in ends), 3, max(y for _, y in ends)))
    return found


SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(k, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))) for k in ("base", "spans")]
)


def _scan(batches):
    for batch in batches:
        base, every = [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text) if text else []
            more = entropy_spans(text, own) if text else []
            base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
            every.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own + more)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(base, SCHEMA.field("base").type), pa.array(every, SCHEMA.field("spans").type)], schema=SCHEMA)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): spans are arrays of (kind, start, end) by start, then kind; code points, end exclusive.

    base holds the fixed kinds; spans adds `entropy`. Null and empty texts give empty arrays. Rows
    are scanned alone: repeated rows and ids each keep their row; other columns are ignored.
    """
    schema = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def mask(text: str | None, spans, mark: str = "[secret]") -> str | None:
    """The text with every union of overlapping spans replaced by the mark."""
    if not spans:
        return text
    out, at = [], 0
    for s, e in merged((x["start"], x["end"]) for x in spans):
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The columns of docs with all spans of find_secrets masked in text; null stays null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            text = []
            for t in batch.column(at).to_pylist():
                base = base_spans(t) if t else []
                text.append(mask(t, [{"start": s, "end": e} for s, _, e in base + (entropy_spans(t, base) if t else [])], mark))
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)
