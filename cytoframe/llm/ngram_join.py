"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is its set of word shingles. Equal sets are one class. Tokens are counted over all sets,
and each of ORDERS global orders puts rarer tokens first and breaks ties by a hash of its own. Two
sets at the threshold share a token among the first n - ceil(t * n) + 1 of each under every order.
Sets that share such a token under the first order, directly or through others, form a group; a set
whose rarest tokens are its own, as those of most texts are, is in none, so groups are of texts that
share nearly all they say. Within a group the filters of all orders and of length are intersected, by
products of matrices over prefix tokens, and only sets that pass them all are compared.

Groups meet in chunks, two by two, so a group of any size is spread over tasks; a chunk pair gives
each member the least one it is tied to, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm import _blocks as B
from cytoframe.llm._graph import components, least_reached
from cytoframe.llm._session import durable, partitions
from cytoframe.llm._text import Texts, Words, mix, window_hashes

U = np.uint64
SHINGLE, PERCENT = 5, 80
ORDERS = 3
#: Sets of a group that meet at once, tokens compared in one step, and about how many rows go to a task.
CHUNK, COLUMNS, ROWS_PER_TASK = 512, 4096, 4096
KEYS_PER_BYTE, RANGE_BYTES = 0.2, 16 << 20
SIGNATURE = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, lead boolean, masks array<binary>, tokens binary"


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles; fewer words than size are one shingle."""
    words = Words(texts)
    folded = words.hashes(texts, fold_case=True)
    starts = words.windows(size)
    hashes = window_hashes(folded, size)[starts]
    cuts = np.searchsorted(starts, words.first)
    counts = np.diff(words.first)
    whole: dict[int, np.uint64] = {}
    for n in np.unique(counts[(counts > 0) & (counts < size)]).tolist():
        own = np.flatnonzero(counts == n)
        whole |= zip(own.tolist(), window_hashes(folded, n)[words.first[own]])
    return [np.array([whole[i]], U) if i in whole else np.unique(hashes[cuts[i] : cuts[i + 1]]) for i in range(texts.n)]


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(tokens).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(tokens + U(0x5BD1E995))).view(np.int64)) if len(tokens) else 0


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def orders_of(tokens: np.ndarray, counts: np.ndarray, orders: int) -> list[np.ndarray]:
    """Permutations of tokens under each global order: by count, then by a hash of the order's own."""
    return [np.lexsort((mix(tokens ^ U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), counts)) for k in range(orders)]


def signatures(docs: DataFrame, shingle: int, percent: int, orders: int) -> DataFrame:
    """A row per document: set size, digest, whether it leads its set in its block, and for leaders that
    may have partners the tokens that some other set holds too, and which of them are the prefix under each order."""
    blocks, plan = B.in_blocks(docs, KEYS_PER_BYTE, RANGE_BYTES, text_hash=F.xxhash64("text"))
    bits = plan.bits
    cut = U(64 - bits)

    def distinct_sets(table):
        sets = shingle_sets(Texts(table.column("text")), shingle)
        marks = [(*digest(s), len(s)) for s in sets]
        lead, seen = np.zeros(len(sets), bool), set()
        for i, m in enumerate(marks):
            if m not in seen and m[2]:
                seen.add(m)
                lead[i] = True
        return sets, marks, lead

    def count(sets, lead):
        every = np.concatenate([sets[i] for i in np.flatnonzero(lead)] or [np.zeros(0, U)]) >> cut
        return np.unique(every, return_counts=True)

    def send(key, table):
        sets, _, lead = distinct_sets(table)
        keys, counts = count(sets, lead)
        return B.packets(key[0].as_py(), keys, [counts], bits, plan.coarse)

    def sign(key, table, reply):
        sets, marks, lead = distinct_sets(table)
        keys, counts = count(sets, lead)
        known, total = B.received(reply, 1)
        at, there = B.lookup(known, keys)
        if len(known):
            counts = np.where(there, total[at], counts)
        masks, tokens = [], []
        for s, own in zip(sets, lead):
            row = (None, None)
            if own:
                df = counts[B.lookup(keys, s >> cut)[0]]
                shared = df > 1  # tokens that no other set holds match nothing
                heads = [np.zeros(len(s), bool) for _ in range(orders)]
                for head, order in zip(heads, orders_of(s, df, orders)):
                    head[order[: prefix_size(len(s), percent)]] = True
                heads = [h[shared] for h in heads]
                if all(h.any() for h in heads):
                    row = ([np.packbits(h).tobytes() for h in heads], B.pack(s[shared]))
            masks.append(row[0])
            tokens.append(row[1])
        d1, d2, n = (np.array(x, np.int64) for x in zip(*marks))
        return pa.table(
            {
                "doc_id": table.column("doc_id").cast(pa.int64()),
                "text_hash": table.column("text_hash"),
                "n_shingles": n,
                "d1": d1,
                "d2": d2,
                "lead": lead,
                "masks": pa.array(masks, pa.list_(pa.binary())),
                "tokens": pa.array(tokens, pa.binary()),
            }
        )

    told = B.exchange(blocks.groupBy("block").applyInArrow(send, B.PACKET), "+", plan, bits)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(sign, SIGNATURE)


def _shared_counts(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Rows as a dense 0/1 matrix over the given ascending tokens."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    for i, row in enumerate(rows):
        at, there = B.lookup(columns, row)
        out[i, at[there]] = 1
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set of ascending tokens, COLUMNS tokens at a time."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), COLUMNS):
        some = both[at : at + COLUMNS]
        out += _shared_counts(left, some) @ _shared_counts(right, some).T
    return out.astype(np.int64)


def linked(left, right, n_left: np.ndarray, n_right: np.ndarray, percent: int):
    """Indices (i, j) of left and right entries (prefixes, tokens) that link.

    The candidates fit by length and share a prefix token under every order; their sets are compared then.
    """
    small, large = np.minimum(n_left[:, None], n_right), np.maximum(n_left[:, None], n_right)
    open_ = 100 * small >= percent * large
    for k in range(len(left[0][0])):
        if not open_.any():
            break
        open_ &= intersections([x[0][k] for x in left], [x[0][k] for x in right]) > 0
    rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(rows):
        return rows, rows
    both = intersections([left[i][1] for i in rows], [right[j][1] for j in columns])
    union = n_left[rows][:, None] + n_right[columns] - both
    i, j = np.nonzero(open_[np.ix_(rows, columns)] & (100 * both >= percent * union))
    return rows[i], columns[j]


def unpacked(tokens: bytes, masks) -> tuple[list[np.ndarray], np.ndarray]:
    """The prefixes under each order and the tokens of a set, ascending."""
    every = B.unpack(tokens, 0)[0]
    return [every[np.unpackbits(np.frombuffer(m, np.uint8), count=len(every)).astype(bool)] for m in masks], every


def _first_prefix(batches):
    for batch in batches:
        heads = [unpacked(t, m[:1])[0][0] for t, m in zip(batch.column("tokens").to_pylist(), batch.column("masks").to_pylist())]
        rows = np.repeat(batch.column("row").to_numpy(), [len(h) for h in heads])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate(heads or [np.zeros(0, U)]).view(np.int64), pa.int64())], names=["row", "token"])


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, kept) of every row of docs.

    Words are runs outside U+0020 and U+0009-U+000D with A-Z folded. A set holds the distinct
    shingles of `shingle` words; fewer words are one shingle; without words or text the set is empty
    and links with nothing. Two documents link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable by links, the document's own included. Rows with
    one doc_id share a component only if they link; null ids stand for -2**63 within and get a null
    component_id if nothing else is there. kept marks the row that stands for its component: the least
    doc_id and, among its rows, the least hash of the text; rows alike in both are marked together. An
    empty set is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    signed = signatures(docs, shingle, percent, orders).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    signed = durable(signed.withColumn("row", F.monotonically_increasing_id()))
    key = ["d1", "d2", "n_shingles"]
    sent = F.col("lead") & F.col("tokens").isNotNull()
    # Classes of equal sets, with a number each, named by their least document, and one row that speaks for each.
    named = signed.where("n_shingles > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.min(F.when(sent, F.col("row"))).alias("row"))
    named = durable(named.withColumn("id", F.monotonically_increasing_id()))
    speakers = named.where("row IS NOT NULL").select("id", "row")
    entries = durable(signed.where(sent).select("row", "masks", "tokens").mapInArrow(_first_prefix, "row long, token long").join(speakers, "row").select("id", "token"))
    hubs = entries.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("token", "hub")
    groups = components(entries.join(hubs, "token").select(F.col("id").alias("u"), F.col("hub").alias("v")))
    groups = groups.withColumnsRenamed({"node": "id", "root": "part"})
    sizes = groups.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    tasks = max(2 * partitions(spark), math.ceil(groups.count() / ROWS_PER_TASK))
    met = groups.join(sizes, "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumns({"a": F.least("chunk", "_other"), "b": F.greatest("chunk", "_other")})
    met = met.withColumn("task", F.pmod(F.xxhash64("part", "a", "b"), F.lit(tasks)).cast("int"))
    sets = signed.where(sent).select("row", F.col("n_shingles").alias("n"), "masks", "tokens")
    met = met.join(speakers, "id").join(sets, "row")

    def compare(table):
        table = table.combine_chunks()
        part, a, b, chunk, n, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("part", "a", "b", "chunk", "n", "id"))
        masks, tokens = table.column("masks"), table.column("tokens")
        order = np.lexsort((ids, chunk, b, a, part))
        cuts = np.flatnonzero(np.any([np.diff(x[order], prepend=x[order[0]] - 1) != 0 for x in (part, a, b)], axis=0))
        nodes, roots = [], []
        for own in np.split(order, cuts[1:]):
            entry = [unpacked(tokens[int(k)].as_py(), masks[int(k)].as_py()) for k in own]
            middle = int((chunk[own] == a[own[0]]).sum())
            if a[own[0]] == b[own[0]]:
                i, j = linked(entry, entry, n[own], n[own], percent)
            elif 0 < middle < len(own):
                i, j = linked(entry[:middle], entry[middle:], n[own[:middle]], n[own[middle:]], percent)
                j = j + middle
            else:
                continue
            if len(i):
                tied = least_reached(len(own), i, j)
                some = tied != np.arange(len(own))
                nodes.append(ids[own[some]])
                roots.append(ids[own[tied[some]]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": np.concatenate(nodes or none), "v": np.concatenate(roots or none)})

    columns = ["task", "part", "a", "b", "chunk", "id", "n", "masks", "tokens"]
    links = durable(met.select(*columns).groupBy("task").applyInArrow(compare, "u long, v long"))
    parts = components(links).withColumnsRenamed({"node": "id", "root": "part"})
    grouped = named.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    least = grouped.groupBy("part").agg(F.min("least").alias("least"))
    grouped = grouped.drop("least").join(least, "part").select(*key, "least")
    out = signed.select("doc_id", "text_hash", *key)
    stands = F.struct("doc_id", "text_hash") == F.col("least")
    full = out.where("n_shingles > 0").join(grouped, key).select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "text_hash", stands.alias("kept"))
    empty = out.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("kept"))

    def restored(column):
        return F.when(F.col(column) != -(2**63), F.col(column)).alias(column)

    return full.unionByName(empty).select(restored("doc_id"), "n_shingles", restored("component_id"), "text_hash", "kept")
