"""WARC archives of pages, written and read with Spark's text files.

Writing: a record per page; its block is an HTTP response in chunked transfer framing. A block over
SEGMENT_BYTES goes on in continuation records. Pages with the payload of a page of smaller id are
revisits, which carry no payload. Reading: records are framed by their lengths, segments grouped by the
identifier of the record they continue, put in order of their numbers and checked against the total
length, the framing is decoded, and payloads are held against their digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm._session import durable
from cytoframe.llm._skew import looked_up

#: Bytes of a record's block, of a chunk of the transfer framing, and of the rows that leave a task at once.
SEGMENT_BYTES, CHUNK_BYTES, BATCH_BYTES = 64 << 10, 8 << 10, 4 << 20
#: The version line that begins a record, and the profile of revisits.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

PARSED = (
    "type string, record_id string, page_id long, url string, digest string, refers_to string, origin string, number int, total long,"
    " block binary, payload binary, payload_bytes long, payload_digest string, status string"
)
_PARSED = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in PARSED.split(","))])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(*parts) -> str:
    """A record's identifier, which follows from what it names."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """What a chunked body holds. Chunk extensions and trailer fields are passed over; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk without a size line")
        digits = body[at:line].split(b";")[0].strip()
        if not digits or not all(c in b"0123456789abcdefABCDEF" for c in digits):
            raise ValueError("a chunk size that is no number")
        size = int(digits, 16)
        at = line + 2
        if not size:
            if body[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in body[at:]:
                raise ValueError("no end of the trailer")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk of another size than it says")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as bytes, without its last line feed, which ends the line of the text file; fields without a value are left out."""
    named = [f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return b"".join([VERSION, "".join(named).encode("utf-8"), b"\r\n", block, b"\r\n\r"])


def response_records(page_id, copy: int, url, digest: str, payload: bytes, date: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The response record of a page and, where its block is over segment_bytes, the records that continue it."""
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    own, n = record_id(page_id, url, digest, copy), -(-len(block) // segment_bytes)
    out = []
    for k in range(1, n + 1):
        part = block[(k - 1) * segment_bytes : k * segment_bytes]
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1 if n > 1 else None), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, url, digest, copy, k)), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == n else None)]
        out.append(record([*fields[:2], ("WARC-Date", date), ("WARC-Target-URI", url), *fields[2:]], part))
    return out


def revisit_record(page_id, row: int, url, digest: str, first, first_url, date: str) -> bytes:
    """A revisit of the first page's response, with the head of the answer alone."""
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, url, digest, "revisit", row)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, first_url, digest, 0)), ("X-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    return record(fields, HEAD + b"\r\n")


def _in_batches(rows, schema: pa.Schema, size):
    """Record batches of about BATCH_BYTES from dicts; size gives the bytes of one."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z", codec: str = "gzip"
) -> None:
    """Writes a record for each row of pages (page_id, url, html) to compressed WARC files under path, which must be new.

    A null html is an empty payload, html may be binary, a null url leaves out the target. Of pages
    with equal payloads of at least min_bytes bytes the one with the smallest page_id (null is the
    smallest; of repeated rows one) is the response and the others revisit it; pages with smaller
    payloads are all responses. Payloads are equal by SHA-1, a second 64-bit hash and length. Other
    columns are ignored. Payloads are shuffled once, by page, so that files are even; which page is a
    response is settled on narrow rows. An empty table writes no records.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    same = ["sha1", "hash", "size"]
    # A row's key has no nulls, so that one shuffle of the payloads serves the join and the search for repeated rows.
    key = ["_id", "_null", "_url", *same]
    hashed = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "hash": F.xxhash64("payload"), "size": F.octet_length("payload"), "_id": F.coalesce("page_id", F.lit(0)), "_null": F.col("page_id").isNull(), "_url": F.xxhash64("url")})
    narrow = durable(hashed.drop("payload").withColumn("row", F.monotonically_increasing_id()))
    groups = durable(narrow.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.min(F.struct("page_id", "row", "url")).alias("first"), F.count("*").alias("_n")).where("_n > 1"))
    placed = durable(looked_up(narrow, groups.select(*same, "first"), same, groups.select(*same, "_n"), narrow.count(), "row"))
    revisits = placed.where(F.col("first.row") != F.col("row"))
    copies = placed.where(F.col("first").isNull() | (F.col("first.row") == F.col("row"))).groupBy(*key).agg(F.count("*").alias("copies"))
    bodies = hashed.join(copies, key).dropDuplicates(key).select("page_id", "url", "sha1", "payload", "copies")
    schema = pa.schema([("value", pa.binary())])

    def answer(batches):
        def every():
            for batch in batches:
                for page, url, sha1, body, n in zip(*(batch.column(c) for c in ("page_id", "url", "sha1", "payload", "copies"))):
                    digest = base32(sha1.as_py())
                    for copy in range(n.as_py()):
                        for x in response_records(page.as_py(), copy, url.as_py(), digest, body.as_py(), date, segment_bytes, chunk_bytes):
                            yield {"value": x}

        return _in_batches(every(), schema, lambda r: len(r["value"]))

    def revisit(batches):
        def every():
            for batch in batches:
                for r in batch.to_pylist():
                    yield {"value": revisit_record(r["page_id"], r["row"], r["url"], base32(r["sha1"]), r["first"], r["first_url"], date)}

        return _in_batches(every(), schema, lambda r: len(r["value"]))

    again = revisits.select("page_id", "row", "url", "sha1", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    records = bodies.mapInArrow(answer, "value binary").unionByName(again.mapInArrow(revisit, "value binary"))
    records.select(F.col("value").cast("string").alias("value")).write.option("compression", codec).option("lineSep", "\n").text(path)


def _decoded(block: bytes, digest: str | None, keep: bool) -> dict:
    """Payload, its length and digest, of an HTTP answer; status says whether framing and digest hold."""
    head, mark, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    try:
        if not mark:
            raise ValueError("no end of the head")
        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        if b"content-length" in fields and b"transfer-encoding" not in fields and int(fields[b"content-length"]) != len(body):
            raise ValueError("another length than it says")
    except ValueError:
        return {"status": "damaged"}
    found = base32(hashlib.sha1(payload).digest())
    return {"payload": payload if keep else None, "payload_bytes": len(payload), "payload_digest": found, "status": "ok" if digest in (None, found) else "damaged"}


def _frames(batches):
    """(header fields, block, whether it is all there) of each record.

    The text file is cut at version lines, which a payload may hold too, so pieces are joined until a
    record has the length that it says. A file's end ends its last record.
    """
    fields = block = file = None
    need = have = 0

    def finished():
        body = b"".join(block)
        return fields, body[:need], len(body) >= need

    for batch in batches:
        for name, start, value in zip(*(batch.column(c) for c in ("file", "start", "value"))):
            name, piece = name.as_py(), value.as_py()
            if start.as_py():
                raise ValueError(f"{name} is cut in pieces: archives must be compressed, or smaller than spark.sql.files.maxPartitionBytes")
            if name != file:
                if fields is not None:
                    yield finished()
                file, fields = name, None
                if not piece:
                    continue  # what is before the first version line
            if fields is not None and have < need:
                block += [VERSION, piece]
                have += len(VERSION) + len(piece)
                continue
            if fields is not None:
                yield finished()
            head, mark, rest = piece.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
            length = fields.get("content-length", "")
            need, block, have = int(length) if mark and length.isdigit() else 0, [rest], len(rest)
    if fields is not None:
        yield finished()


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Response and revisit records of the archives under path, each with its full payload's length and digest.

    (page_id, url, record_type, record_id, refers_to, payload, payload_bytes, payload_digest, status);
    refers_to is the page of the response that a revisit names; the payload itself stands at the response alone. status is ok; incomplete, where
    segments miss, clash or don't add up to the total length, or a file ends within a record; damaged,
    where framing or digest don't hold; unresolved, where a revisit's response isn't there or has another
    digest. Other kinds of records are passed over, orphaned segments are incomplete rows without a page.
    With payloads=False the column is null and archives are read once; else once more for segments.
    """
    lines = spark.read.option("lineSep", VERSION.decode("ascii")).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def number(text):
        return int(text) if text is not None and text.lstrip("-").isdigit() else None

    def parse(batches):
        def every():
            for fields, block, whole in _frames(batches):
                kind = fields.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                digest = fields.get("warc-payload-digest")
                row = {
                    "type": kind, "record_id": fields.get("warc-record-id"), "page_id": number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
                    "digest": digest.removeprefix("sha1:") if digest else None, "origin": fields.get("warc-segment-origin-id"), "number": number(fields.get("warc-segment-number")), "total": number(fields.get("warc-segment-total-length")), "status": "ok" if whole else "incomplete",
                }
                if row["number"] is not None or kind == "continuation":
                    row |= {"block": block, "origin": row["origin"] or row["record_id"]}
                elif whole and kind == "response":
                    row |= _decoded(block, row["digest"], payloads)
                yield row

        return _in_batches(every(), _PARSED, lambda r: 200 + len(r.get("block") or b"") + len(r.get("payload") or b""))

    parsed = lines.mapInArrow(parse, PARSED)
    if not payloads:
        parsed = durable(parsed)  # narrow rows, and blocks of segments

    def assemble(table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["number"] is None, r["number"] or 0))
        parts = {r["number"]: r for r in rows}
        first, total = parts.get(1), [r["total"] for r in rows if r["total"] is not None]
        out = dict.fromkeys(_PARSED.names) | ({k: first[k] for k in ("type", "record_id", "page_id", "url", "digest", "refers_to")} if first else {"record_id": rows[0]["origin"]})
        clash = any(r["block"] != parts[r["number"]]["block"] for r in rows) or any(r["status"] != "ok" for r in rows)
        block = b"".join(r["block"] for _, r in sorted((k, r) for k, r in parts.items() if k is not None))
        if clash or set(parts) != set(range(1, len(parts) + 1)) or len(set(total)) != 1 or total[0] != len(block):
            out["status"] = "incomplete"
        else:
            out |= _decoded(block, out["digest"], payloads)
        return pa.Table.from_pylist([out], schema=_PARSED)

    single = parsed.where("origin IS NULL")
    joined = parsed.where("origin IS NOT NULL").groupBy("origin").applyInArrow(assemble, PARSED)
    records = single.unionByName(joined)
    shown = [F.col("page_id"), F.col("url"), F.coalesce("type", F.lit("response")).alias("record_type"), F.col("record_id")]
    answers = records.where("type IS NULL OR type = 'response'")
    revisits = records.where("type = 'revisit'").select(*shown, "digest", F.col("refers_to").alias("target"), F.col("status").alias("_own"))
    targets = answers.where("record_id IS NOT NULL").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", "status").dropDuplicates(["target"])
    counts = durable(revisits.groupBy("target").agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    found = looked_up(revisits, targets, ["target"], counts, total, "record_id")
    good = (F.col("status") == "ok") & (F.col("digest").isNull() | (F.col("digest") == F.col("payload_digest")))
    state = F.when(F.col("_own") != "ok", F.col("_own")).when(F.coalesce(good, F.lit(False)), "ok").otherwise("unresolved")
    columns = ["page_id", "url", "record_type", "record_id", "refers_to", "payload", "payload_bytes", "payload_digest", "status"]
    out = answers.select(*shown, F.lit(None).cast("long").alias("refers_to"), "payload", "payload_bytes", "payload_digest", "status")
    found = found.withColumn("status", state).withColumn("payload", F.lit(None).cast("binary"))
    return out.select(*columns).unionByName(found.select(*columns))
