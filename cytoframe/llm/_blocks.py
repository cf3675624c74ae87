"""Blocks of documents that trade sorted hash keys with key ranges.

A block is about a MiB of documents. Every block sends its distinct keys, packed by key range; the
range answers each block for the keys that concern it. A key that a third of all rows holds is sent
once a block, not once a row. A block sends to so few ranges that a full block's packets hold LEAST_KEYS
keys each; a larger corpus has more ranges than that, and keys go to them by way of units, each a coarse
range of GROUP blocks, which add up what their blocks say of a key and pass answers on. The exchange that
forms the blocks is the same subtree in each round, so Spark shuffles the texts once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm._session import partitions

U = np.uint64
BLOCK_BYTES = 1 << 20
#: Keys of a full block to a packet, at least, and blocks to a unit.
LEAST_KEYS, GROUP = 256, 1024
PACKET = "range int, block int, packet binary"
REPLY = "block int, packet binary"
PACKETS = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("packet", pa.binary())])
REPLIES = pa.schema([("block", pa.int32()), ("packet", pa.binary())])


class Plan:
    """How many blocks and key ranges a corpus gets; all in proportion to its bytes. coarse: the ranges that a block sends to."""

    def __init__(self, spark, total_bytes: int, keys_per_byte: float, range_bytes: int):
        self.blocks = max(1, math.ceil(total_bytes / BLOCK_BYTES))
        keys = max(1, int(total_bytes * keys_per_byte))
        self.bits = min(64, max(40, keys.bit_length() + 14))
        ranges = max(2 * partitions(spark), math.ceil(total_bytes / range_bytes))
        self.coarse = min(ranges, max(2 * partitions(spark), int(BLOCK_BYTES * keys_per_byte) // LEAST_KEYS))
        self.ranges = self.coarse * math.ceil(ranges / self.coarse)  # each coarse range is cut in as many


def in_blocks(docs: DataFrame, keys_per_byte: float, range_bytes: int = 32 << 20, **more) -> tuple[DataFrame, Plan]:
    """(doc_id, text, block) and the plan; one narrow pass measures the corpus. range_bytes: of text to a key range; more: further columns.

    A row's block follows from its id and text, so that a task that runs again meets the same rows; rows alike in both share a block.
    """
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    plan = Plan(docs.sparkSession, total, keys_per_byte, range_bytes)
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.blocks)).cast("int")
    return docs.select("doc_id", "text", salt.alias("block"), *[c.alias(n) for n, c in more.items()]), plan


def range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return (((keys >> U(bits - 32)) * U(ranges)) >> U(32)).astype(np.int32)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, then columns of the same length, byte by byte planes, compressed."""
    planes = [np.diff(keys, prepend=U(0)).astype(U)] + [np.asarray(c).astype(np.int64).view(U) for c in columns]
    flat = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes() for p in planes)
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def unpack(packet: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(packet[:8], "little")
    flat = np.frombuffer(pa.decompress(packet[8:], decompressed_size=size, codec="zstd"), np.uint8)
    planes = flat.reshape(columns + 1, 8, -1)
    out = [np.ascontiguousarray(p.T).view(U).ravel() for p in planes]
    return [np.cumsum(out[0], dtype=U)] + [x.view(np.int64) for x in out[1:]]


def packets(block: int, keys: np.ndarray, columns: list[np.ndarray], bits: int, ranges: int) -> pa.Table:
    """The rows that a block sends: its ascending keys cut by range."""
    of = range_of(keys, bits, ranges)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(cuts[1:], len(keys))
    return pa.table(
        {
            "range": pa.array(of[cuts], pa.int32()),
            "block": pa.array(np.full(len(cuts), block), pa.int32()),
            "packet": pa.array([pack(keys[a:b], *[c[a:b] for c in columns]) for a, b in zip(cuts, ends)], pa.binary()),
        },
        schema=PACKETS,
    )


def gather(table: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each entry, and the entries' keys and columns, of all packets of a range or a reply."""
    got = [unpack(x.as_py(), columns) for x in table.column("packet")]
    blocks = np.repeat(table.column("block").to_numpy().astype(np.int64), [len(g[0]) for g in got])
    if not got:
        return blocks, [np.zeros(0, U)] + [np.zeros(0, np.int64)] * columns
    return blocks, [np.concatenate(parts) for parts in zip(*got)]


def replies(blocks: np.ndarray, keys: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """One packet a block, with its entries by key."""
    order = np.lexsort((keys, blocks))
    blocks, keys, columns = blocks[order], keys[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
    ends = np.append(cuts[1:], len(keys))
    return pa.table(
        {
            "block": pa.array(blocks[cuts], pa.int32()),
            "packet": pa.array([pack(keys[a:b], *[c[a:b] for c in columns]) for a, b in zip(cuts, ends)], pa.binary()),
        },
        schema=REPLIES,
    )


def received(table: pa.Table, columns: int) -> list[np.ndarray]:
    """A block's replies as one ascending list of keys with their columns."""
    _, got = gather(table.select(["block", "packet"]), columns)
    order = np.argsort(got[0], kind="stable")
    return [x[order] for x in got]


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted_keys, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def _same(keys: np.ndarray, columns: list[np.ndarray], ops: str) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by key (and checks, where ops begins with one), and the number of each entry's key in it."""
    parts = [keys, *[c for c, op in zip(columns, ops) if op == "="]]
    order = np.lexsort(parts[::-1]) if len(parts) > 1 else np.argsort(keys, kind="stable")
    new = np.zeros(len(keys), bool)
    new[:1] = True
    for part in parts:
        ordered = part[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.cumsum(new) - 1


def _merged(keys: np.ndarray, columns: list[np.ndarray], ops: str):
    """First entry of each distinct key, the merged columns by key, and the key of each entry."""
    order, number = _same(keys, columns, ops)
    head = np.flatnonzero(np.diff(number, prepend=-1))
    place = np.empty(len(keys), np.int64)
    place[order] = number
    out = []
    for c, op in zip(columns, ops):
        c = c[order]
        out.append(c[head] if op == "=" or not len(c) else (np.add if op == "+" else np.minimum).reduceat(c, head))
    return order[head], out, place


def _more(columns: list[np.ndarray], merged: list[np.ndarray]) -> np.ndarray:
    """Entries whose key means more elsewhere than their block knows."""
    more = np.zeros(len(columns[0]), bool)
    for c, m in zip(columns, merged):
        more |= c != m
    return more


def exchange(sent: DataFrame, ops: str, plan: Plan, bits: int) -> DataFrame:
    """Replies (block, packet) to rows of packets(), from each block its ascending keys of `bits` bits to plan.coarse ranges.

    ops says of each column how entries of one key are merged over blocks: + sums, < takes the least, and
    a leading = makes the column part of the key. A block is told the merged columns of those of its
    keys whose columns aren't its own alone.
    """

    def answer(table):
        owner, (keys, *columns) = gather(table, len(ops))
        _, merged, place = _merged(keys, columns, ops)
        merged = [m[place] for m in merged]
        more = _more(columns, merged)
        return replies(owner[more], keys[more], [m[more] for m in merged])

    if plan.ranges == plan.coarse:
        return sent.groupBy("range").applyInArrow(answer, REPLY)

    units = math.ceil(plan.blocks / GROUP)
    sent = sent.withColumn("unit", F.col("range") * units + F.expr(f"CAST(block DIV {GROUP} AS INT)"))

    def add_up(key, table):
        _, (keys, *columns) = gather(table, len(ops))
        first, merged, _ = _merged(keys, columns, ops)
        return packets(key[0].as_py(), keys[first], merged, bits, plan.ranges)

    def pass_on(key, table, told):
        owner, (keys, *columns) = gather(table, len(ops))
        first, merged, place = _merged(keys, columns, ops)
        unit_keys = keys[first]
        _, (known, *known_columns) = gather(told.select(["block", "packet"]), len(ops))
        # What is told is looked up by key and check together.
        both = [np.concatenate([a, b]) for a, b in zip([unit_keys, *merged], [known, *known_columns])]
        _, number = _same(both[0], both[1:], ops)
        order, _ = _same(both[0], both[1:], ops)
        at = np.empty(len(both[0]), np.int64)
        at[order] = number
        told_of = dict(zip(at[len(first) :].tolist(), range(len(known))))
        where = np.array([told_of.get(k, -1) for k in at[: len(first)].tolist()], np.int64)
        merged = [np.where(where >= 0, k[np.maximum(where, 0)], m) if len(k) else m for k, m in zip(known_columns, merged)]
        merged = [m[place] for m in merged]
        more = _more(columns, merged)
        return replies(owner[more], keys[more], [m[more] for m in merged])

    up = sent.groupBy("unit").applyInArrow(add_up, PACKET)
    told = up.groupBy("range").applyInArrow(answer, REPLY).withColumnRenamed("block", "unit")
    return sent.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(lambda key, table, t: pass_on(key, table, t.rename_columns(["block" if n == "unit" else n for n in t.schema.names])), REPLY)
