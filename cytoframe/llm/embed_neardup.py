"""Embedding near-dedup: Euclidean p-stable hashing of unit vectors, then exact cosines.

Blocks of vectors send their distinct bucket keys to key ranges, which answer with the size and the least
member of buckets that other blocks share. A vector travels only for buckets that hold another one:
unrelated vectors rarely share all projections of a table, so most don't travel at all. Small buckets
with one least member meet in one place, whatever their tables, so a vector goes there once; the
tables in which it does are sent as bits, and its keys are worked out again where it arrives.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm import _blocks as B
from cytoframe.llm._graph import components, least_reached
from cytoframe.llm._session import durable, partitions
from cytoframe.llm._skew import looked_up
from cytoframe.llm._text import mix

U = np.uint64
#: Tables, projections a table and the width of a quantised step: two unit vectors at cosine 0.93
#: (distance 0.374) share one of a table's keys with probability 0.045 and some table with 0.994;
#: unrelated ones (distance 1.41) share a table's key with 0.000002.
TABLES, PROJECTIONS, WIDTH, SEED = 112, 14, 1.5, 11
#: Rows of a bucket that meet at once; larger buckets are cut in chunks that meet two by two. Rows to a task, and to a key range.
CHUNK, BYTES_PER_TASK, ROWS_PER_RANGE = 2048, 8 << 20, 16384
#: Rows of a bucket that meets with others of its least member; rows of a meeting that is compared together with others.
SMALL = 64


@lru_cache(4)
def _projections(dim: int, tables: int, per_table: int, width: float, seed: int):
    """Axes and shifts in units of a step, and a random odd number for each axis."""
    random = np.random.default_rng(seed)
    axes, shift = random.standard_normal((dim, tables * per_table)), random.uniform(0, width, tables * per_table)
    return axes / width, shift / width, mix(np.arange(1, tables * per_table + 1)) | U(1)


def _keys(unit: np.ndarray, labels: np.ndarray, tables: int, per_table: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit key of each vector in each table, of its label and quantised projections."""
    axes, shift, factors = _projections(unit.shape[1], tables, per_table, width, seed)
    own = mix(labels.astype(np.int64))[:, None] + mix(np.arange(tables) + 1)
    out = np.empty((len(unit), tables), U)
    for at in range(0, len(unit), 256):  # what a core's cache holds
        steps = unit[at : at + 256] @ axes
        steps += shift
        steps = np.floor(steps, out=steps).astype(np.int64).view(U)
        steps *= factors
        out[at : at + 256] = steps.reshape(-1, tables, per_table).sum(2, dtype=U)
    return mix(out + own)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision and without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _counted(i: np.ndarray, j: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) count here: those whose first table with a common key is one of the tables that i came for."""
    out, open_ = np.zeros(len(i), bool), np.arange(len(i))
    for tab in range(keys.shape[1]):
        same = keys[i[open_], tab] == keys[j[open_], tab]
        met = open_[same]
        out[met] = bits[i[met], tab]
        open_ = open_[~same]
        if not len(open_):
            break
    return out


def _small_links(x, chunk, across, end, keys, bits, threshold):
    """Linked pairs of rows in the small meetings, each where it counts.

    Rows stand by meeting; end is the end of each row's meeting, or 0 where that is large. Rows at one
    distance are compared at once, for all meetings.
    """
    here, found = np.flatnonzero(end), [(np.zeros(0, np.int64),) * 2]
    for far in range(1, SMALL):
        here = here[here + far < end[here]]
        if not len(here):
            break
        for at in range(0, len(here), 1 << 13):
            i = here[at : at + (1 << 13)]
            j = i + far
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            near &= ~across[i] | (chunk[i] != chunk[j])
            i, j = i[near], j[near]
            if len(i):
                counts = _counted(i, j, keys, bits)
                found.append((i[counts], j[counts]))
    return (np.concatenate(p) for p in zip(*found))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, per_table: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links hold between equal, non-null labels at cosine >= threshold.

    Cosines are of double precision. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, and vectors of different lengths are never compared. Labels may be of
    any type. Vectors equal in label and components are one class with a count and a number of its
    own, so copies cost one row; n_links counts each of them. Rows with one vec_id are vectors of
    their own: each has its own links, and its component is that of its vector. A component is named by
    its least vec_id; null ids name one only where it has no other. A pair is counted in the first table in which
    it meets, so nothing is capped and no pair is emitted. Rows find their class by 128 bits of hash,
    labels are told apart by 64. Other columns are ignored.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    kind, number = ("float", np.float32) if single else ("double", np.float64)
    e = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("e", F.transform("e", lambda x: x + F.lit(0.0).cast(kind)))  # no negative zeros
    digest = [F.xxhash64("label", "e").alias("h1"), F.xxhash64(F.lit(seed), "e", "label").alias("h2")]
    narrow = durable(rows.select("vec_id", "usable", *digest).withColumn("row", F.monotonically_increasing_id()))
    classes = durable(rows.where("usable").groupBy("label", "e").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "first", "copies", F.xxhash64("label").alias("label"), "e", *digest)  # numbers of written rows
    size = classes.agg(F.count("*"), F.sum(F.size("e"))).first()
    n_rows, n_bytes = size[0], (size[1] or 0) * np.dtype(number).itemsize
    # Ranges see the leading bits of keys: one in 16,384 of them falls in with another, whose rows then meet for nothing.
    plan = B.Plan(spark, n_bytes, n_rows * tables / max(1, n_bytes), max(1, ROWS_PER_RANGE * n_bytes // max(1, n_rows)))
    tasks = max(2 * partitions(spark), math.ceil(4 * n_bytes / BYTES_PER_TASK))
    placed = classes.select("id", "copies", "label", "e", F.pmod(F.xxhash64("id"), F.lit(plan.blocks)).cast("int").alias("block"))

    def hashed(table):
        """Vectors of a block, by length, and their keys."""
        e, labels = table.column("e").combine_chunks(), table.column("label").to_numpy()
        offsets = e.offsets.to_numpy()
        flat, sizes = e.values.to_numpy(zero_copy_only=False), np.diff(offsets)
        keys, data = np.zeros((len(sizes), tables), U), [b""] * len(sizes)
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            x = flat[offsets[own][:, None] + np.arange(dim)]
            keys[own] = _keys(_units(x), labels[own] * 65537 + dim, tables, per_table, width, seed)
            for k, row in zip(own, x):
                data[k] = row.astype(number).tobytes()
        return keys, data

    def by_key(keys, ids):
        """The block's ascending keys, how many of its rows hold each, and the least of them."""
        flat = (keys >> U(64 - plan.bits)).ravel()
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], np.repeat(ids, keys.shape[1])[order]
        head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        return flat[head], [np.diff(np.append(head, len(flat))), np.minimum.reduceat(who, head)]

    def send(key, table):
        return B.packets(key[0].as_py(), *by_key(hashed(table)[0], table.column("id").to_numpy()), plan.bits, plan.coarse)

    def emit(key, table, reply):
        (keys, data), ids = hashed(table), table.column("id").to_numpy()
        own, (n, least) = by_key(keys, ids)
        known, total, first = B.received(reply, 2)
        at, there = B.lookup(known, own)
        if len(known):
            n, least = np.where(there, total[at], n), np.where(there, first[at], least)
        keys = keys >> U(64 - plan.bits)
        place = np.searchsorted(own, keys)
        n, least = n[place], least[place]
        row, tab = np.nonzero(n > 1)
        size, few = n[row, tab], n[row, tab] <= SMALL
        meeting = np.where(few, mix(least[row, tab]), mix(keys[row, tab] + U(seed)))
        # A row goes once to each meeting, with a bit for every table that brings it there.
        order = np.lexsort((tab, meeting, row))
        row, tab, size, few, meeting = (v[order] for v in (row, tab, size, few, meeting))
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (meeting[1:] != meeting[:-1]))) if len(row) else np.zeros(0, np.int64)
        bits = np.zeros((len(head), tables), bool)
        bits[np.repeat(np.arange(len(head)), np.diff(np.append(head, len(row)))), tab] = True
        row, meeting, chunks = row[head], meeting[head], np.where(few[head], 1, -(-size[head] // CHUNK))
        chunk = (mix(ids)[row] % chunks.astype(U)).astype(np.int64)
        copy = np.repeat(np.arange(len(row)), chunks)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        row, meeting, chunk = row[copy], meeting[copy], chunk[copy]
        a, b = np.minimum(chunk, other), np.maximum(chunk, other)
        task = mix(meeting + mix(a.astype(U) * U(1 << 32) + b.astype(U))) % U(tasks)
        packed, labels = [x.tobytes() for x in np.packbits(bits, axis=1)], table.column("label").to_numpy()
        return pa.table(
            {
                "task": task.astype(np.int32), "meeting": meeting.view(np.int64), "a": a.astype(np.int32), "b": b.astype(np.int32), "chunk": chunk.astype(np.int32), "id": ids[row], "label": labels[row],
                "copies": table.column("copies").to_numpy()[row], "vector": pa.array([data[k] for k in row], pa.binary()), "bits": pa.array([packed[k] for k in copy], pa.binary()),
            }
        )

    def compare(table):
        table = table.combine_chunks()
        dims = np.array([len(x.as_buffer()) // np.dtype(number).itemsize for x in table.column("vector")])
        meeting = table.column("meeting").to_numpy()
        a, b, ids = (table.column(c).to_numpy() for c in ("a", "b", "id"))
        parts = []
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            parts.append(linked(table.take(own[np.lexsort((ids[own], b[own], a[own], meeting[own]))]), dim))
        return pa.concat_tables(parts)

    def linked(table, dim):
        """Links of rows of one length, which stand by meeting."""
        meeting, a, b, chunk = (table.column(c).to_numpy().astype(np.int64) for c in ("meeting", "a", "b", "chunk"))
        ids, copies, labels = (table.column(c).to_numpy() for c in ("id", "copies", "label"))
        x = _units(np.frombuffer(b"".join(table.column("vector").to_pylist()), number).reshape(-1, dim))
        bits = np.unpackbits(np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)[:, :tables].astype(bool)
        _, one, which = np.unique(ids, return_index=True, return_inverse=True)
        keys = _keys(x[one], labels[one] * 65537 + dim, tables, per_table, width, seed)[which]
        cuts = np.flatnonzero(np.any([np.diff(v, prepend=v[0] - 1) != 0 for v in (meeting, a, b)], axis=0))
        ends = np.append(cuts[1:], len(ids))
        size = ends - cuts
        links, root = np.zeros(len(ids), np.int64), ids.copy()

        def tie(i, j):
            """Counts pairs and names each of their rows by the least row, and so id, that they tie it to."""
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            root[rows] = ids[rows[least_reached(len(rows), at[: len(i)], at[len(i) :])]]

        i, j = _small_links(x, chunk, a != b, np.where(np.repeat(size, size) <= SMALL, np.repeat(ends, size), 0), keys, bits, threshold)
        if len(i):
            tie(i, j)
        for start, end in zip(cuts[size > SMALL], ends[size > SMALL]):
            found = []
            for at in range(start, end, 512):
                i, j = np.nonzero(x[at : min(end, at + 512)] @ x[start:end].T >= threshold)
                i, j = i + at, j + start
                i, j = i[i < j], j[i < j]
                if a[start] != b[start]:
                    other = chunk[i] != chunk[j]
                    i, j = i[other], j[other]
                counts = _counted(i, j, keys, bits)
                found.append((i[counts], j[counts]))
            i, j = (np.concatenate(side) for side in zip(*found))
            if len(i):
                tie(i, j)
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": root[some]})

    told = B.exchange(placed.groupBy("block").applyInArrow(send, B.PACKET), "+<", plan, plan.bits)
    met = placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(emit, "task int, meeting long, a int, b int, chunk int, id long, label long, copies long, vector binary, bits binary")
    found = durable(met.groupBy("task").applyInArrow(compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    tied = classes.select("id", "first", "copies", "h1", "h2").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    tied = durable(tied.withColumn("root", F.coalesce("root", "id")))
    names = durable(tied.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n")))
    named = looked_up(tied, names.select("root", "component_id"), ["root"], names.select("root", "_n"), n_rows, "id")
    named = durable(named.select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("_n")))
    linked_rows = looked_up(narrow.where("usable"), named.drop("_n"), ["h1", "h2"], named.select("h1", "h2", "_n"), narrow.count(), "row").select("vec_id", "n_links", "component_id")
    alone = narrow.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
