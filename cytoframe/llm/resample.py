"""Importance resampling towards a target corpus by hashed n-grams, with long texts in overlapping chunks.

A text over CHUNK_BYTES is split at word boundaries. A chunk owns the words it begins with and carries the
n - 1 words behind them, so each n-gram starts in exactly one chunk. Chunks are dealt out by a hash, counted
and weighed alone and summed by document, so that one text of any length never holds up a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm import _crc as C
from cytoframe.llm._session import durable, partitions
from cytoframe.llm._text import Texts, Words, slices
from cytoframe.operators.summaries import ranked

#: Longest run of words of a feature, hash buckets, least words of a document that may be drawn, its share in percent, seed of the draw.
GRAMS, BUCKETS, MIN_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Bytes of text that a chunk owns at most, unless one word alone is longer.
CHUNK_BYTES = 1 << 18

_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPLIT = "row long, doc_id long, text_hash long, chunk int, owned long, text binary"


def buckets_of(texts: Texts, owned: np.ndarray | None = None, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1, 2 and so on words, the text and the bucket of each; and the words of each text.

    owned: how many words of each text may start a run; None for all.
    """
    words = Words(texts, _BREAKS)
    size, of, n = words.end - words.start, words.text_of(), np.diff(words.first)
    own = n if owned is None else np.minimum(owned, n)
    starts = np.flatnonzero(np.arange(len(of)) - words.first[of] < own[of]) if len(of) else of
    word = C.crc32(_LOWER[texts.bytes], words.start, size)
    crc, rows, out = word[starts], [], []
    for k in range(grams):
        if k:
            inside = starts + k < words.first[1:][of[starts]]
            starts, crc = starts[inside], crc[inside]
            crc = C.joined(C.then_space(crc), word[starts + k], size[starts + k])
        rows.append(of[starts])
        out.append((crc % np.uint32(buckets)).astype(np.int64))
    return rows, out, own


def split_text(text: bytes, grams: int, most: int):
    """(owned words, bytes) of the chunks of one text; each carries grams - 1 words of the next ones. A text without words is one empty chunk."""
    words = Words(Texts(pa.array([text], pa.large_binary())), _BREAKS)
    n, at = len(words.start), 0
    if not n:
        yield 0, b""
    while at < n:
        to = max(at + 1, int(np.searchsorted(words.end, words.start[at] + most, "right")))
        yield to - at, text[words.start[at] : words.end[min(to + grams - 1, n) - 1]]
        at = to


def _parts(texts: DataFrame, grams: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Texts of up to `most` bytes as they stand, and the chunks of longer ones, written once and dealt out by a hash."""
    length = F.octet_length(F.coalesce("text", F.lit("")))

    def split(batches):
        for batch in batches:
            for row, doc, digest, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text_hash", "text"))):
                one = [row.as_py(), doc.as_py(), digest.as_py()]
                for k, (owned, part) in enumerate(split_text(text.as_py(), grams, most)):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*one, k, owned, part]))], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("chunk", pa.int32()), ("owned", pa.int64()), ("text", pa.binary())])
    long = texts.where(length > most).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    chunks = durable(long.mapInArrow(split, SPLIT))
    return texts.where(length <= most), chunks.repartition(partitions(texts.sparkSession), "row", "chunk")


def _batches(batches):
    """Texts and owned words of parts of about a MiB, with the parts."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        owned = batch.column("owned").to_numpy() if "owned" in batch.schema.names else None
        yield batch, Texts(batch.column("text")), owned


def bucket_counts(texts: DataFrame, chunks: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task sends each of its buckets once."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, part, owned in _batches(batches):
            for found in buckets_of(part, owned, grams, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").unionByName(chunks.select("owned", "text").mapInArrow(count, "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares of each bucket in the target and in the corpus, rounded down."""
    s, t, size = float(counts.sum()), float(target.sum()), len(counts)
    ratio = ((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)) for a, b in zip(map(float, counts), map(float, target)))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(texts: DataFrame, chunks: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) of every document, chunks summed."""

    def weigh(batches):
        for batch, part, owned in _batches(batches):
            rows, found, n_words = buckets_of(part, owned, grams, len(gain))
            n, total = np.zeros(part.n, np.int64), np.zeros(part.n, np.int64)
            for row, bucket in zip(rows, found):  # rows ascend
                cuts = np.searchsorted(row, np.arange(part.n + 1))
                n += np.diff(cuts)
                total += np.diff(np.append(0, np.cumsum(gain[bucket]))[cuts])
            names = [c for c in ("row", "doc_id", "text_hash") if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(total)], names=[*names, "n_words", "n_features", "weight"])

    kind = "doc_id long, text_hash long, n_words long, n_features long, weight long"
    whole = texts.select("doc_id", "text_hash", "text").mapInArrow(weigh, kind)
    parts = chunks.drop("chunk").mapInArrow(weigh, f"row long, {kind}")
    summed = parts.groupBy("row", "doc_id", "text_hash").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]).drop("row")
    return whole.unionByName(summed)


def draw_noise(doc_id: str = "doc_id", seed: int = SEED):
    """Thousandths of a Gumbel draw that depends on the seed and the id alone, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_scores(
    docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score, rank) of every row of docs, against the texts of target.

    Words are runs of letters, digits and bytes over 127 of the text with A-Z folded; features are all
    runs of 1 to `grams` words, counted each time. Of the N documents with at least min_words words the
    floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to the smaller doc_id
    (null first), then by a hash of the text; rank is null for all others. Repeated rows are documents
    of their own with one score. A null or empty text has no features and weight 0; a null id draws as the
    word `null`. An empty corpus gives no rows; an empty target is legal. Other columns are ignored.
    The driver sees one count a bucket; everything else stays in narrow rows that Spark sorts by range.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    other = target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("text_hash"))
    texts, chunks = _parts(own, grams, chunk_bytes)
    wanted = bucket_counts(*_parts(other, grams, chunk_bytes), grams, buckets)
    gain = gains(bucket_counts(texts, chunks, grams, buckets), wanted)
    rows = durable(weights(texts, chunks, gain, grams).withColumn("score", F.col("weight") + draw_noise("doc_id", seed)))
    long_enough = F.col("n_words") >= min_words
    drawn = rows.where(long_enough).count() * percent // 100
    order = ranked(rows.where(long_enough), [F.col("score").desc(), "doc_id", "text_hash"])
    placed = order.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")).drop("total")
    return placed.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs with all their columns; rows alike in id and text are drawn together. Options as for importance_scores."""
    drawn = importance_scores(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("_drawn")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_semi")
