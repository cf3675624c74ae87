"""Sharding: contiguous shards of near equal bytes by global prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm._session import durable, partitions

ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), with size the UTF-8 bytes of the text and row_bytes more.

    Rows stand in the order of doc_id, size and checksum (null ids first); rows alike in all three
    are interchangeable. A row belongs to the shard in which the middle of its bytes lies when the
    total is cut into equal targets, so shards are contiguous and gapless, and differ from the target
    by one row at most. A null text counts as empty. Only these narrow rows are shuffled and written;
    the driver sees a total per partition and, per partition and shard, a count. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    empty = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(empty) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(empty.cast("binary")).alias("text_crc32"))
    # The last column spreads a doc_id that many rows share over several partitions.
    ranged = slim.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), "doc_id", "size", "text_crc32", "_spread")
    rows = durable(ranged.drop("_spread").sortWithinPartitions("doc_id", "size", "text_crc32").withColumn("part", F.spark_partition_id()))
    totals = sorted(map(tuple, rows.groupBy("part").agg(F.sum("size"), F.count("*")).collect()))
    before, total = {}, 0
    for part, size, _ in totals:
        before[part] = total
        total += size

    def place(batches):
        done: dict[int, int] = {}
        for batch in batches:
            part, size = (batch.column(c).to_numpy() for c in ("part", "size"))
            shard = np.zeros(len(size), np.int32)
            for p in np.unique(part):
                own = part == p
                ends = before[int(p)] + done.get(int(p), 0) + np.cumsum(size[own])
                done[int(p)] = int(ends[-1]) - before[int(p)]
                middle = 2 * ends - size[own]
                middle = middle if 2 * total * shards < 1 << 62 else middle.astype(object)  # exact whatever the size
                shard[own] = np.minimum(middle * shards // (2 * total), shards - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, part int, shard int")
    counts = sorted(map(tuple, placed.groupBy("shard", "part").count().collect()))
    begins, at, now = {}, 0, None
    for shard, part, n in counts:  # partitions follow each other within a shard
        at, now = (0, shard) if shard != now else (at, now)
        begins[shard, part] = at
        at += n

    def number(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            part, shard = (batch.column(c).to_numpy() for c in ("part", "shard"))
            slot = np.zeros(len(part), np.int64)
            key = part.astype(np.int64) << 32 | shard
            for k in np.unique(key):
                own = np.flatnonzero(key == k)
                k = (int(k >> 32), int(k & 0xFFFFFFFF))
                slot[own] = begins[k[1], k[0]] + seen.get(k, 0) + np.arange(len(own))
                seen[k] = seen.get(k, 0) + len(own)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")] + [pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return placed.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, slot long")
