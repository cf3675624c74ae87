"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark window (WINDOW item words, or all of a shorter item) is the set of its word shingles,
and occurs only where all of them do; of a set that must be contained whole, one token is a necessary
prefix. The token is the window's rarest shingle over all documents. A document position that holds
it fixes where the window would start; positional and length bounds drop what doesn't fit, and the
words themselves are compared last, so hashes decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.llm._session import durable

WINDOW, SHINGLE = 13, 5
#: Rows of benchmark tables up to which they are broadcast; joined by shuffle beyond.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words, after folding A-Z: U+0000-002F, 003A-0060, 007B-007F.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Words of a text: one pass folds letters and turns separators to spaces, so the split needs no pattern."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " ", -1), "")


def _shingles(words: Column, n: Column, size: int) -> Column:
    """Array of (pos, shingle) of size words, hashed; empty where there are fewer."""

    def at(i):
        return F.struct(i.alias("pos"), F.xxhash64(F.slice(words, i + 1, size)).alias("shingle"))

    none = F.array().cast("array<struct<pos:int,shingle:bigint>>")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at)).otherwise(none)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, win): the distinct windows of each item, win joined by spaces; items without words have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    items = items.withColumn("n", F.size("w")).where("n > 0").withColumn("m", F.least("n", F.lit(window)))
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("m")), lambda i: F.slice("w", i + 1, F.col("m")))
    return items.select("item_id", F.explode(spans).alias("words")).withColumn("win", F.array_join("words", " ")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, contaminated; _row tells rows apart, _text (a hash) texts.

    n_hit counts the document's words inside any occurrence of a window; items are the sorted ids
    (as strings) of benchmark items with an occurring window; contaminated is n_hit > 0 and
    20 * n_hit >= n_words. Null and empty texts have no words and are clean; empty items match
    nothing; items with null ids mark words but aren't listed. Rows that share a doc_id are judged
    each for itself.
    """
    owned = durable(benchmark_windows(benchmark, window))
    wins = owned.select("win", "words").distinct().withColumn("m", F.size("words"))
    wins = wins.withColumn("q", F.least(F.col("m"), F.lit(shingle)))
    sizes = sorted(r[0] for r in wins.select("q").distinct().collect())  # `shingle` values at most
    tokens = None
    for q in sizes:
        some = wins.where(F.col("q") == q).select("win", "m", F.explode(_shingles(F.col("words"), F.col("m"), q)).alias("s"))
        some = some.select("win", "m", F.col("s.pos").alias("offset"), F.col("s.shingle").alias("shingle"))
        tokens = some if tokens is None else tokens.unionByName(some)
    base = docs.select("doc_id", F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("w")).withColumn("_row", F.monotonically_increasing_id())
    base = base.withColumn("n_words", F.size("w"))
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("shingle")))
    if not sizes:
        none = F.lit(0).cast("long")
        return base.select("doc_id", "_text", "_row", F.col("n_words").cast("long"), none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    tokens = durable(tokens)
    distinct = tokens.select("shingle").distinct()
    n_tokens = tokens.count()
    every = F.concat(head, *[_shingles(F.col("w"), F.col("n_words"), q) for q in sizes])
    known = distinct.withColumn("known", F.lit(True))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    near = F.when(F.col("pos") >= 0, F.slice("w", first + 1, 2 * window)).alias("near")
    row = ["doc_id", "_text", "_row", "n_words"]
    if n_tokens <= BROADCAST_ROWS:
        spread = base.select(*row, "w", F.explode(every).alias("s")).select(*row, "w", "s.pos", "s.shingle")
        hits = spread.join(F.broadcast(known), "shingle", "left").where("pos < 0 OR known").select(*row, "pos", "shingle", near, first.alias("near_at"))
    else:  # only positions and shingles travel to the tokens; a row's words are fetched for its hits, on a table of fixed rows
        base = durable(base)
        spread = base.select("_row", F.explode(every).alias("s")).select("_row", "s.pos", "s.shingle").where("pos >= 0")
        met = spread.join(known, "shingle").groupBy("_row").agg(F.collect_list(F.struct("pos", "shingle")).alias("s"))
        full = base.join(met, "_row", "left").withColumn("s", F.concat(head, F.coalesce("s", F.array().cast("array<struct<pos:int,shingle:bigint>>"))))
        hits = full.select(*row, "w", F.explode("s").alias("s")).select(*row, "w", "s.pos", "s.shingle").select(*row, "pos", "shingle", near, first.alias("near_at"))
    hits = durable(hits)

    # The rarest shingle of each window over all documents; a window with one that no document holds occurs nowhere.
    counts = hits.where("pos >= 0").groupBy("shingle").agg(F.count("*").alias("n"))
    rated = tokens.join(counts, "shingle", "left").groupBy("win", "m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("r"))
    prefix = rated.where("r.n > 0").select("win", "m", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"))
    start = F.col("pos") - F.col("offset")
    found = hits.where("pos >= 0").join(_bounded(prefix, n_tokens), "shingle").withColumn("start", start)
    found = found.where("start >= 0 AND start + m <= n_words").where(F.array_join(F.slice("near", F.col("start") - F.col("near_at") + 1, F.col("m")), " ") == F.col("win"))
    found = durable(found.select("_row", "start", "m", "win").distinct())

    by_start = Window.partitionBy("_row").orderBy("start", "m").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("m")).over(by_start), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("m") - F.greatest(F.col("start"), reach))
    covered = found.select("_row", "start", "m").distinct().withColumn("fresh", fresh).groupBy("_row").agg(F.sum("fresh").alias("n_hit"))
    listed = found.select("_row", "win").distinct().join(_bounded(owned.select("win", "item_id"), n_tokens), "win").groupBy("_row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = hits.where("pos < 0").select("doc_id", "_text", "_row", F.col("n_words").cast("long")).join(covered, "_row", "left").join(listed, "_row", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "_text", "_row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
