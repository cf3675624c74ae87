"""WARC archives by a round trip, by a reader of its own over the files, and with records that are cut, lost or broken."""

import base64
import glob
import gzip
import hashlib

import pytest

from cytoframe.llm import _skew, warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(folder):
    """(fields, block) of all files, framed by their lengths."""
    out = []
    for name in sorted(glob.glob(f"{folder}/*.gz")):
        with gzip.open(name) as f:
            data, at = f.read(), 0
        while at < len(data):
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            end = data.index(b"\r\n\r\n", at)
            fields = dict(line.split(": ", 1) for line in data[at + 10 : end].decode().split("\r\n"))
            stop = end + 4 + int(fields["Content-Length"])
            assert data[stop : stop + 4] == b"\r\n\r\n"
            out.append((fields, data[end + 4 : stop]))
            at = stop + 4
    return out


@pytest.fixture(scope="module")
def rows():
    odd = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n é "
    rows = [(i, f"http://h/{i}", f"<p>{i % 7} größe</p>" * (i % 5)) for i in range(40)]
    rows += [(50, "http://odd", odd), (51, None, odd), (52, "http://nul", None), (53, "u", ""), (54, "u", odd * 400), (49, "u", odd * 400), (55, "u", "a\n\r\n\r" * 50)]
    return rows + [(60, "r", "same"), (60, "r", "same"), (60, "other", "same"), (61, "r", "same"), (None, "n", "nameless"), (62, "n", "nameless")]


def wanted(rows, least=0):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            first[body] = min(first.get(body, 1 << 40), -1 if i is None else i)
    taken, out = set(), []
    for i, _, html in rows:
        body = (html or "").encode()
        leads = len(body) < least or (first[body] == (-1 if i is None else i) and body not in taken)
        taken.add(body)
        out.append((i, len(body), b32(body), "response" if leads else "revisit", None if leads or first[body] < 0 else first[body]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, segment, chunk, hot", [(0, 64 << 10, 8 << 10, 1000), (5, 200, 16, 2), (0, 37, 1000, 0)])
@pytest.mark.parametrize("payloads", [True, False])
def test_round_trip(spark, rows, tmp_path, monkeypatch, least, segment, chunk, hot, payloads):
    monkeypatch.setattr(_skew, "HOT_ROWS", hot)
    rows = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, sha1 string")
    warc.write_warc(df.repartition(3), f"{tmp_path}/a", least, segment, chunk)
    got = warc.read_warc(spark, f"{tmp_path}/a", payloads).collect()
    assert all(r.status == "ok" for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == wanted(rows, least)
    bodies = {(i, b32((h or "").encode())): (h or "").encode() for i, _, h in rows}
    assert all((r.payload is None) if r.record_type == "revisit" or not payloads else bytes(r.payload) == bodies[r.page_id, r.payload_digest] for r in got)
    found = records(f"{tmp_path}/a")
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(found) and all(len(b) <= segment for f, b in found if f["WARC-Type"] != "revisit")
    parts = {}
    for f, b in found:
        if "WARC-Segment-Number" in f:
            parts.setdefault(f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), {})[int(f["WARC-Segment-Number"])] = (f, b)
    for origin in parts.values():
        assert sorted(origin) == list(range(1, len(origin) + 1))
        assert int(origin[len(origin)][0]["WARC-Segment-Total-Length"]) == sum(len(b) for _, b in origin.values())
    assert bool(parts) == (segment < 1000 or any(len(h or "") > segment for *_, h in rows))
    assert sorted(f.get("WARC-Target-URI", "") for f, _ in found if f["WARC-Type"] != "continuation") == sorted(u or "" for _, u, _ in rows)


def test_broken_archives(spark, tmp_path):
    long, short = b"0123456789" * 30, b"short"
    digest = b32(long)
    parts = warc.response_records(1, 0, "u", digest, long, "1970-01-01T00:00:00Z", 100, 64)
    assert len(parts) > 3
    lost = warc.response_records(2, 0, "u", digest, long, "1970-01-01T00:00:00Z", 100, 64)
    wrong = warc.response_records(3, 0, "u", b32(b"other"), short, "1970-01-01T00:00:00Z", 1000, 64)
    frame = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<f>"), ("X-Page-ID", 4)], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nabc\r\n0\r\n\r\n")]
    plain = [warc.record([("warc-type", "response"), ("WARC-Record-ID", "<p>"), ("X-Page-ID", 5)], b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nshort"), warc.record([("WARC-Type", "warcinfo")], b"software: x")]
    again = [warc.revisit_record(6, 0, "u", digest, 1, "u", "d"), warc.revisit_record(7, 0, "u", digest, 99, "u", "d"), warc.revisit_record(8, 0, "u", b32(b"no"), 1, "u", "d")]
    cut = warc.response_records(9, 0, "u", b32(long), long, "d", 1000, 64)[0][:-60]
    files = {"a": parts[::2] + lost[:2] + wrong, "b": [*again, lost[-1], *frame, parts[1]], "c": parts[3::2] + plain + [cut]}
    (tmp_path / "w").mkdir()
    for name, some in files.items():
        with gzip.open(tmp_path / "w" / f"{name}.warc.gz", "wb") as f:
            f.write(b"\n".join(some) + b"\n")
    got = {r.page_id: r for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "incomplete", 3: "damaged", 4: "damaged", 5: "ok", 6: "ok", 7: "unresolved", 8: "unresolved", 9: "incomplete"}
    assert bytes(got[1].payload) == long and bytes(got[5].payload) == short and got[6].refers_to == 1 and got[6].payload_bytes == 300


def test_framing():
    for size in (1, 3, 100):
        assert warc.unchunked(warc.chunked(b"hello world", size)) == b"hello world"
    assert warc.unchunked(b"5;name=v\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello" and warc.unchunked(b"0\r\n\r\n") == b""
    for bad in (b"", b"5\r\nhell\r\n0\r\n\r\n", b"-1\r\n\r\n", b"5\r\nhello\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_very_long_and_empty(spark, tmp_path):
    body = "".join(f"<p>{i}</p>" for i in range(300_000))
    df = spark.createDataFrame([(1, "u", body), (2, "u", body)], "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/a")
    assert sorted((r.page_id, r.payload_bytes, r.refers_to, r.status) for r in warc.read_warc(spark, f"{tmp_path}/a").collect()) == [(1, len(body), None, "ok"), (2, len(body), 1, "ok")]
    warc.write_warc(df.limit(0), f"{tmp_path}/b")
    assert warc.read_warc(spark, f"{tmp_path}/b").count() == 0
