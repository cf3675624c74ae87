"""TIFF files of every kind that is read, written here, against their arrays; ranges of bytes; probes of directories."""

import struct
import zlib

import numpy as np
import pytest

from cytoframe.operators import inventory
from cytoframe.sources import tiff


def lzw(data):
    out, width, held, bits = [], 9, 0, 0
    table = {bytes([k]): k for k in range(256)}
    size = 258

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    word = b""
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packbits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
        else:
            run = 1
            out += bytes([0, data[at]])
        at += run
    return out + b"\x80"


PACKED = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def write(path, stack, order="<", big=False, compression=1, predictor=1, tile=None, rows=None, split=False, description=None):
    """A stack (pages, height, width, samples) as a TIFF."""
    kind = stack.dtype.newbyteorder(order)
    count, offset, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8)))
    link = len(out) - struct.calcsize(offset)
    for page in stack:
        height, width, samples = page.shape
        planes = [page[..., k : k + 1] for k in range(samples)] if split else [page]
        high, wide = tile or (rows or height, width)
        offsets, sizes = [], []
        for plane in planes:
            for y in range(0, height, high):
                for x in range(0, width, wide):
                    part = plane[y : y + high, x : x + wide]
                    if tile:
                        full = np.zeros((high, wide, part.shape[2]), part.dtype)
                        full[: part.shape[0], : part.shape[1]] = part
                        part = full
                    if predictor == 2:
                        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                    raw = PACKED[compression](part.astype(kind).tobytes())
                    offsets.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8 * kind.itemsize] * samples), (259, "H", [compression]), (277, "H", [samples]), (284, "H", [2 if split else 1]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * samples)]
        tags += [(322, "I", [wide]), (323, "I", [high]), (324, offset, offsets), (325, "I", sizes)] if tile else [(273, offset, offsets), (278, "I", [high]), (279, "I", sizes)]
        if description is not None:
            tags.append((270, "s", description.encode() + b"\0"))
        entries = b""
        for tag, letter, values in sorted(tags):
            raw = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > struct.calcsize(offset):
                at = len(out)
                out += raw
                raw = struct.pack(order + offset, at)
            entries += struct.pack(order + "HH" + offset, tag, {"s": 2, "H": 3, "I": 4, "Q": 16}[letter], len(values)) + raw.ljust(struct.calcsize(offset), b"\0")
        out[link : link + struct.calcsize(offset)] = struct.pack(order + offset, len(out))
        out += struct.pack(order + count, len(tags)) + entries
        link = len(out)
        out += bytes(struct.calcsize(offset))
    path.write_bytes(bytes(out))


CASES = [
    dict(), dict(order=">"), dict(big=True), dict(big=True, order=">", compression=8), dict(compression=5, rows=3), dict(compression=5, predictor=2), dict(compression=8, predictor=2, tile=(16, 16)), dict(compression=32773, rows=5), dict(tile=(16, 32)),
    dict(tile=(16, 16), compression=5, order=">"), dict(split=True, rows=4), dict(split=True, tile=(16, 16), compression=8, predictor=2),
]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32", "float64", "uint32"])
def test_every_kind_equals_its_array(spark, tmp_path, kind):
    random, stacks = np.random.default_rng(5), {}
    for k, case in enumerate(CASES):
        if case.get("predictor") == 2 and kind.startswith("float"):
            continue
        samples = 3 if k % 3 == 1 or case.get("split") else 1
        stack = (np.cumsum(random.integers(0, 3, (3, 21, 37, samples)), axis=2) * (1 if kind == "uint8" else 7)).astype(kind)
        write(tmp_path / f"{k}.tif", stack, **case)
        stacks[str(tmp_path / f"{k}.tif")] = stack
    (tmp_path / "notes.txt").write_text("no image")
    got = tiff.read_pages(spark, str(tmp_path), slicebytes=3000).collect()
    assert len(got) == 3 * len(stacks)
    for r in got:
        assert r.dtype == kind and np.array_equal(np.frombuffer(r.data, np.dtype(kind).newbyteorder("<")).reshape(r.height, r.width, r.samples), stacks[r.path][r.page]), r.path
    one = next(iter(stacks))
    rows = tiff.pixel_rows(tiff.read_pages(spark, one)).collect()
    assert {(r.z, r.y, r.x): r.v for r in rows} == {(z, y, x): float(stacks[one][z, y, x, 0]) for z, y, x in np.ndindex(3, 21, 37)}


def test_long_codes_of_lzw():
    data = np.random.default_rng(1).integers(0, 40, 60_000).astype(np.uint8).tobytes()
    assert tiff.unpacked_lzw(lzw(data)) == data and tiff.unpacked_lzw(lzw(b"a" * 9000)) == b"a" * 9000
    with pytest.raises(tiff.Unreadable):
        tiff.unpacked_lzw(bytes([0x80, 0x3F, 0xFF, 0xFF]))


def test_a_header_costs_the_same_for_any_size(tmp_path):
    fetched = []
    for n in (64, 1024):
        write(tmp_path / "a.tif", np.zeros((2, n, n, 1), np.uint16), rows=n)
        file, size = tiff.opened(str(tmp_path / "a.tif"))
        data = tiff.Bytes(file, size)
        assert tiff.header(data) == {"height": n, "width": n, "dtype": "uint16", "sizes": {}, "pages": 2}
        fetched.append(data.fetched)
    assert max(fetched) <= 8 * tiff.BLOCK < (tmp_path / "a.tif").stat().st_size


def test_slices_share_out_the_pages(spark, tmp_path):
    write(tmp_path / "a.tif", np.arange(11 * 20 * 20).reshape(11, 20, 20, 1).astype(np.uint16))
    df = tiff.read_pages(spark, str(tmp_path / "a.tif"), slicebytes=2000, pixels="false")
    assert df.rdd.getNumPartitions() > 3 and sorted(r.page for r in df.collect()) == list(range(11)) and df.where("data IS NOT NULL").count() == 0
    with pytest.raises(Exception):
        tiff.read_pages(spark, f"{tmp_path}/none").count()


def test_probe_stops_at_the_first_stack(spark, tmp_path):
    flat, deep = np.zeros((1, 4, 5, 1), np.uint8), np.zeros((12, 4, 5, 1), np.uint16)
    for d in "abcde":
        (tmp_path / d).mkdir()
    for k in range(5):
        (tmp_path / "a" / f"{k}.tif").write_bytes(b"II\x2a\x00" if k % 2 else b"no")
    write(tmp_path / "a" / "7.TIFF", deep)
    write(tmp_path / "a" / "8.tif", deep)
    for k in range(25):
        write(tmp_path / "b" / f"{k:02d}.tif", deep if k > 20 else flat)
    write(tmp_path / "c" / "x.tif", flat, description='<Pixels SizeZ="4" SizeC="2" SizeX="5"/>')
    write(tmp_path / "d" / "x.tif", flat, description='<Pixels SizeZ="1" SizeC="2"/>')
    (tmp_path / "e" / "y.png").write_bytes(b"")
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*.*")], "path string")
    got = tiff.probe_stacks(paths).collect()
    by = {d: sorted((r.path.split("/")[-1], r.kind, r.pages, r.error) for r in got if f"/{d}/" in r.path) for d in "abcde"}
    assert by["a"] == [("0.tif", None, None, "Unreadable"), ("1.tif", None, None, "Unreadable"), ("2.tif", None, None, "Unreadable"), ("7.TIFF", "ambiguous_multipage_tiff", 12, None)]
    assert len(by["b"]) == 20 and all(k == "" for _, k, *_ in by["b"])
    assert by["c"] == [("x.tif", "ome_z_or_t_stack", None, None)] and by["d"] == [("x.tif", "ome_multichannel_single_plane", None, None)] and by["e"] == []
    shown = {r.path.split("/")[-1]: r for r in inventory.stack_profiles(tiff.probe_stacks(paths)).collect()}
    assert shown["a"].n_stacks == 1 and shown["a"].stack_shapes == ["page0:4x5:uint16"] and shown["a"].stack_errors == ["0.tif:Unreadable", "1.tif:Unreadable", "2.tif:Unreadable"]
    assert shown["c"].stack_sizes == ["SizeC=2,SizeZ=4,SizeX=5"] and shown["b"].n_stacks == 0
