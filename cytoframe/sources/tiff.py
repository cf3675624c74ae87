"""TIFF files as a data source: pages read by byte ranges, decoded, in partitions of files and page ranges.

    register(spark); spark.read.format("tiff").load("/share/stacks")

A task opens its file, follows the chain of page headers and decodes the pages of its range, so a stack of
any length is shared out and a header costs the same however large the file is. Any store that pyarrow
can open serves; local paths need no scheme.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one read of headers fetches at least, and of a file to a partition.
BLOCK, SLICE_BYTES = 4096, 64 << 20
#: Struct letters of field types, tags by name, and image sizes in a description.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 266: "fill_order", 270: "description", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_bytes", 284: "planar",
    317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_bytes", 339: "sample_format",
}
SIZES = re.compile(r'\b(Size[ZTCXY])="([^"]+)"')
SUFFIXES = (".tif", ".tiff")
#: Files of a directory that a probe opens at most, and errors that it names at most.
PROBE_FILES, PROBE_ERRORS = 20, 3


class Unreadable(ValueError):
    """What isn't a TIFF, is cut short, or is packed in a way that isn't known."""


def opened(path: str):
    """(file, size) for reads at any place."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "/", path)
    store, name = (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)
    return store.open_input_file(name), store.get_file_info(name).size


class Bytes:
    """Reads of byte ranges that keep one block; `fetched` counts what came from the file."""

    def __init__(self, file, size: int):
        self.file, self.size, self.fetched, self.start, self.held = file, size, 0, 0, b""

    def at(self, start: int, n: int) -> bytes:
        if start < 0 or n < 0 or start + n > self.size:
            raise Unreadable("cut short")
        if n > BLOCK:
            self.fetched += n
            return self.file.read_at(n, start)
        if not self.start <= start or start + n > self.start + len(self.held):
            self.start, self.held = start, self.file.read_at(min(BLOCK, self.size - start), start)
            self.fetched += len(self.held)
        return self.held[start - self.start : start - self.start + n]


def pages(data: Bytes, values: bool = True) -> Iterator[dict]:
    """The fields of each page, in order, by the names of TAGS; without values a page is an empty dict, and only its place in the chain is read."""
    head = data.at(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise Unreadable("not a TIFF")
    big = magic == 43
    count, offset, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    n_size, o_size = struct.calcsize(count), struct.calcsize(offset)
    at, seen = struct.unpack(order + offset, data.at(8, 8) if big else head[4:8])[0], set()
    while at:
        if at in seen:
            raise Unreadable("pages in a circle")
        seen.add(at)
        n = struct.unpack(order + count, data.at(at, n_size))[0]
        fields: dict = {"order": order} if values else {}
        for k in range(n if values else 0):
            e = data.at(at + n_size + k * entry, entry)
            tag, kind = struct.unpack(order + "HH", e[:4])
            if tag not in TAGS or kind not in TYPES:
                continue
            total, letters = struct.unpack(order + offset, e[4 : 4 + o_size])[0], TYPES[kind]
            size = total * struct.calcsize("=" + letters)
            raw = e[4 + o_size : 4 + o_size + size] if size <= o_size else data.at(struct.unpack(order + offset, e[4 + o_size :])[0], size)
            fields[TAGS[tag]] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{order}{total * len(letters)}{letters[0]}", raw)
        yield fields
        at = struct.unpack(order + offset, data.at(at + n_size + n * entry, o_size))[0]


def _one(page: dict, name: str, default: int) -> int:
    return page[name][0] if page.get(name) else default


def dtype_of(page: dict) -> np.dtype:
    bits, kind = set(page.get("bits", (1,))), {1: "u", 2: "i", 3: "f"}.get(_one(page, "sample_format", 1))
    width = bits.pop() if len(bits) == 1 else 0
    if kind is None or width not in (8, 16, 32, 64) or kind == "f" and width == 8:
        raise Unreadable(f"samples of {width} bits")
    return np.dtype(f"{page['order']}{kind}{width // 8}")


def unpacked_bits(data: bytes) -> bytes:
    """Runs of PackBits."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first, each width left one code early; 256 clears the table and 257 ends."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, before = list(single), [], b""
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(single), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise Unreadable("a code that isn't in the table")
        out.append(word)
        if before:
            table.append(before + word[:1])
        before = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


UNPACKED = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32773: unpacked_bits, 32946: zlib.decompress}


def decode(data: Bytes, page: dict) -> np.ndarray:
    """The samples of a page (height, width, samples), from strips or tiles, in native byte order."""
    height, width, samples = _one(page, "height", 0), _one(page, "width", 0), _one(page, "samples", 1)
    kind, packing, split = dtype_of(page), _one(page, "compression", 1), _one(page, "planar", 1) == 2 and samples > 1
    if packing not in UNPACKED or _one(page, "fill_order", 1) != 1:
        raise Unreadable(f"compression {packing}")
    predictor = _one(page, "predictor", 1)
    if predictor not in (1, 2) or predictor == 2 and kind.kind == "f":
        raise Unreadable(f"predictor {predictor}")
    tiled = "tile_offsets" in page
    high, wide = (_one(page, "tile_height", 0), _one(page, "tile_width", 0)) if tiled else (min(_one(page, "rows_per_strip", height), height), width)
    offsets, sizes = page.get("tile_offsets" if tiled else "strip_offsets", ()), page.get("tile_bytes" if tiled else "strip_bytes", ())
    if not (height and width and high and wide):
        raise Unreadable("a page without a size")
    depth, down, across = 1 if split else samples, -(-height // high), -(-width // wide)
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    if len(offsets) != down * across * (samples if split else 1) or len(sizes) != len(offsets):
        raise Unreadable("another number of parts than the page has")
    for k, (start, n) in enumerate(zip(offsets, sizes)):
        plane, rest = divmod(k, down * across)
        row, column = divmod(rest, across)
        rows = high if tiled else min(high, height - row * high)
        try:
            raw = UNPACKED[packing](data.at(start, n))
        except zlib.error as e:
            raise Unreadable(str(e)) from None
        if len(raw) < rows * wide * depth * kind.itemsize:
            raise Unreadable("a part cut short")
        part = np.frombuffer(raw, kind, rows * wide * depth).reshape(rows, wide, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        y, x = row * high, column * wide
        own = part[: height - y, : width - x]
        out[y : y + own.shape[0], x : x + own.shape[1], plane if split else slice(None)] = own[..., 0] if split else own
    return out


def header(data: Bytes) -> dict:
    """Description, shape and type of the first page, and the number of pages where no sizes are declared."""
    first = next(pages(data), None)
    if first is None:
        raise Unreadable("no pages")
    sizes = {k: int(v) for k, v in SIZES.findall(first.get("description", ""))}
    n = None if sizes else sum(1 for _ in pages(data, values=False))
    return {"height": _one(first, "height", 0), "width": _one(first, "width", 0), "dtype": dtype_of(first).newbyteorder("=").name, "sizes": sizes, "pages": n}


def stack_kind(sizes: dict[str, int], n_pages: int | None) -> str:
    """What a header says of stacks: by declared sizes, else by ten pages or more; empty for none."""
    if sizes:
        if max(sizes.get("SizeZ", 1), sizes.get("SizeT", 1)) >= 2:
            return "ome_z_or_t_stack"
        return "ome_multichannel_single_plane" if sizes.get("SizeC", 1) >= 2 else ""
    return "ambiguous_multipage_tiff" if (n_pages or 0) >= 10 else ""


def probe_stacks(files: DataFrame, most_files: int = PROBE_FILES, most_errors: int = PROBE_ERRORS) -> DataFrame:
    """(path, kind, pages, height, width, dtype, sizes, error) of the TIFF files of `path` that a probe of each directory opens.

    In each directory files are opened by name until one is a stack, most_files at most; the first
    most_errors that can't be read are rows with an error. Only headers are read. Other names are left out.
    """
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.endswith(name, F.lit(SUFFIXES[0])) | F.endswith(name, F.lit(SUFFIXES[1]))
    rows = files.select("path").where(suffix).distinct().withColumn("_folder", folder)
    picked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_folder").orderBy("path"))).where(F.col("_rank") <= most_files)
    schema = "path string, kind string, pages long, height long, width long, dtype string, sizes string, error string"
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (c.split() for c in schema.split(","))])

    def probe(table):
        out, errors = [], 0
        for path in sorted(table.column("path").to_pylist()):
            try:
                file, size = opened(path)
                with file:
                    h = header(Bytes(file, size))
            except (OSError, ValueError, struct.error) as e:
                errors += 1
                if errors <= most_errors:
                    out.append({"path": path, "error": type(e).__name__})
                continue
            kind = stack_kind(h["sizes"], h["pages"])
            sizes = ",".join(f"{k}={h['sizes'][k]}" for k in ("SizeC", "SizeT", "SizeZ", "SizeY", "SizeX") if k in h["sizes"])
            out.append({"path": path, "kind": kind, **{k: h[k] for k in ("pages", "height", "width", "dtype")}, "sizes": sizes or None})
            if kind:
                break
        return pa.Table.from_pylist([dict.fromkeys(kinds.names) | r for r in out], schema=kinds)

    return picked.groupBy("_folder").applyInArrow(probe, schema)


@dataclass
class _Slice(InputPartition):
    path: str
    k: int
    of: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.slice_bytes = options["path"], int(options.get("slicebytes", SLICE_BYTES))
        self.decoded = options.get("pixels", "true").lower() == "true"

    def partitions(self) -> list[_Slice]:
        """A slice of its pages for each slice_bytes of a file; only names and sizes are looked at."""
        from pyarrow import fs

        plain = re.sub(r"^file:/+", "/", self.root)
        store, name = (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)
        prefix = plain[: len(plain) - len(name)] if plain.endswith(name) else ""
        found = store.get_file_info(name)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and f.path.lower().endswith(SUFFIXES)]
        return [_Slice(prefix + f.path, k, of) for f in sorted(files, key=lambda f: f.path) for of in [max(1, math.ceil(f.size / self.slice_bytes))] for k in range(of)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        file, size = opened(partition.path)
        with file:
            data = Bytes(file, size)
            total = sum(1 for _ in pages(data, values=False))
            for n, page in enumerate(pages(data)):
                if n * partition.of // total == partition.k:
                    shape = tuple(_one(page, c, d) for c, d in (("height", 0), ("width", 0), ("samples", 1)))
                    raw = decode(data, page).astype(dtype_of(page).newbyteorder("<")).tobytes() if self.decoded else None
                    yield (partition.path, n, *shape, dtype_of(page).newbyteorder("=").name, page.get("description"), raw)


class TiffSource(DataSource):
    """Pages of TIFF files: (path, page, height, width, samples, dtype, description, data); data are the samples, little-endian, by row, column and sample.

    Options: slicebytes, bytes of a file to a partition; pixels=false leaves data null. path is a file or a
    folder, whose .tif and .tiff files count at any depth. A file that can't be read fails the query.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return "path string, page int, height int, width int, samples int, dtype string, description string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffSource)


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tiff").options(**options).load(path)


def pixel_rows(read: DataFrame, sample: int = 0) -> DataFrame:
    """(path, z, y, x, v) of one sample of each pixel, with z the page."""
    schema = pa.schema([("path", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("v", pa.float64())])

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                image = np.frombuffer(r["data"], np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["height"], r["width"], r["samples"])[..., sample]
                for top in range(0, r["height"], max(1, (1 << 20) // max(1, r["width"]))):  # about a million pixels at once
                    part = image[top : top + max(1, (1 << 20) // max(1, r["width"]))]
                    y, x = (v.ravel().astype(np.int32) for v in np.indices(part.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(y)), pa.array(np.full(len(y), r["page"], np.int32)), pa.array(y + np.int32(top)), pa.array(x), pa.array(part.ravel().astype(np.float64))], schema=schema)

    return read.select("path", "page", "height", "width", "samples", "dtype", "data").mapInArrow(rows, "path string, z int, y int, x int, v double")
