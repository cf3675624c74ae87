"""Summaries by group: means with standard errors, weighted means, quantiles, contrasts, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.session import durable, partitions


def finite(column: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)


def mean_se(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, se (sample standard deviation over the root of n) and n of finite values by group."""
    v = finite(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"), F.count(v).alias("n"))


def weighted_mean_se(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, se by the effective n = (sum w)^2 / sum w^2, effective n and n, in one pass of sums.

    Rows without a finite value or with a weight that isn't finite and positive are left out.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    rows = df.where(finite(v).isNotNull() & finite(w).isNotNull() & (w > 0))
    sums = rows.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wv2"), F.count("*").alias("n"))
    mean = F.col("_wv") / F.col("_w")
    n_eff = F.col("_w") * F.col("_w") / F.col("_w2")
    spread = F.greatest(F.col("_wv2") / F.col("_w") - mean * mean, F.lit(0.0))
    return sums.select(*keys, mean.alias("mean"), F.sqrt(spread / n_eff).alias("se"), n_eff.alias("n_effective"), "n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles by group, one column each."""
    names = list(shares)
    got = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(shares[n]) for n in names])).alias("_q"), F.count(value).alias("n"))
    return got.select(*keys, *[F.get("_q", i).alias(n) for i, n in enumerate(names)], "n")


def contrast(df: DataFrame, keys: Sequence[str], arm: str, arms: tuple[str, str]) -> DataFrame:
    """mean, se and n of two arms side by side, their difference with its se, and their ratio (NULL over zero)."""
    wide = df.groupBy(*keys).pivot(arm, list(arms)).agg(F.first("mean").alias("mean"), F.first("se").alias("se"), F.first("n").alias("n"))
    a, b = arms
    out = [F.col(f"{x}_{c}").alias(f"{c}_{x.lower()}") for x in arms for c in ("mean", "se", "n")]
    difference = F.col(f"{b}_mean") - F.col(f"{a}_mean")
    return wide.select(*keys, *out, difference.alias("difference"), F.sqrt(F.col(f"{a}_se") * F.col(f"{a}_se") + F.col(f"{b}_se") * F.col(f"{b}_se")).alias("difference_se"), F.try_divide(f"{b}_mean", f"{a}_mean").alias("ratio"))


def tiles(df: DataFrame, value: str, n: int, name: str, tie: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds an n-tile of the value, ranked among non-NULL rows; NULL where the value is NULL.

    Without keys the ranks are global, so row counts of value ranges are taken first and only those meet
    in one task; with keys each group is ranked by itself.
    """
    if keys:
        w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value, *tie)
        return df.withColumn(name, F.when(F.col(value).isNotNull(), F.ntile(n).over(w)))
    return ranked(df.where(F.col(value).isNotNull()), [value, *tie]).withColumn(name, _tile(F.col("rank"), F.col("total"), n)).drop("rank", "total").unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("int")))


def _tile(rank: Column, total: Column, n: int) -> Column:
    """ntile of a 0-based rank: the first total % n tiles hold one row more."""
    small = F.floor(total / n)
    wide = (total % n) * (small + 1)
    return F.when(rank < wide, F.floor(rank / (small + 1)) + 1).otherwise(F.floor((rank - wide) / F.greatest(small, F.lit(1))) + total % n + 1).cast("int")


def ranked(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds the 0-based rank in a total order, over all rows or within keys, and the total, without one task for all rows of a key.

    Rows are cut by range into partitions; each is ranked alone and shifted by the counts before it.
    """
    cut = durable(df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    local = cut.withColumn("_local", F.row_number().over(own) - 1)
    counts = cut.groupBy("_part", *keys).agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", *keys, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(Window.partitionBy(*keys)).alias("total"))
    if not keys:
        return local.join(F.broadcast(shifts), "_part").withColumn("rank", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")  # a row per partition
    same = shifts.withColumnsRenamed({c: f"_k_{c}" for c in ("_part", *keys)})
    met = local.join(same, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("_part", *keys)])
    return met.withColumn("rank", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before", *[f"_k_{c}" for c in ("_part", *keys)])


def global_quantiles(df: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one column each: a row for all rows (NULL without a value), or one for each key that has a value.

    Values are counted first and cut by range; each range adds up its counts from those of the ranges
    before it, so no task holds all distinct values of a key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cut = durable(counted.repartitionByRange(partitions(df.sparkSession), *keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = cut.groupBy("_part", *keys).agg(F.sum("_n").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("_part", *keys, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(Window.partitionBy(*keys)).alias("_total"))
    so_far = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = cut.withColumn("_end", so_far)
    if keys:
        shifts = shifts.withColumnsRenamed({c: f"_k_{c}" for c in ("_part", *keys)})
        rows = rows.join(shifts, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("_part", *keys)])
    else:
        rows = rows.join(F.broadcast(shifts), "_part")  # a row per partition
    rows = rows.withColumn("_end", F.col("_before") + F.col("_end"))
    out = {}
    for name, share in shares.items():
        place = share * (F.col("_total") - 1)

        def at(rank):
            return F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_n") <= rank), F.col("_v")))

        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out[name] = F.when(low == high, low).otherwise(low * (1 - part) + high * part)
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])


def capped(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """Adds the value cut at a quantile of all rows."""
    limit = global_quantiles(df, value, {"_cap": share})
    return df.crossJoin(F.broadcast(limit)).withColumn(name, F.least(value, "_cap")).drop("_cap")  # one row


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds z_<column> by the mean and sample deviation over all rows; 0 where the deviation is 0."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {f"z_{c}": F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def unit_hash(key: Column, seed: int) -> Column:
    """A uniform draw in [0, 1) that depends on the key and the seed alone, so it survives any partitioning."""
    text = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fine_hash(key: Column, seed: int) -> Column:
    """As unit_hash, with 52 bits, for draws from pools of over a few million rows."""
    text = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scaled_with(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds z_<column> by centres and scales from a table (term, center, scale), as an artifact keeps them; 0 where a scale is 0."""
    wide = scaler.where(F.col("term").isin(*columns)).groupBy().pivot("term", list(columns)).agg(F.first("center").alias("c"), F.first("scale").alias("s"))
    out = df.crossJoin(F.broadcast(wide))  # one row
    return out.withColumns({f"z_{c}": F.when(F.col(f"{c}_s") == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}_c")) / F.col(f"{c}_s")) for c in columns}).drop(*[f"{c}_{k}" for c in columns for k in "cs"])


def scaler_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(term, center, scale) of columns: mean and sample deviation over all rows."""
    one = df.agg(*[F.struct(F.lit(c).alias("term"), F.avg(c).alias("center"), F.stddev_samp(c).alias("scale")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*columns)))


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, seed: int | None = None) -> DataFrame:
    """n rows of each group at equal steps of rank, both ends in; all of a smaller group.

    With a seed and n = 1, groups of five or more give a row from between their ends, by a hash of the key.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_rank": F.row_number().over(w.orderBy(*order)) - 1, "_total": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_total") - 1) / max(1, n - 1)).cast("int"))
    if n == 1 and seed is not None:
        drawn = F.floor(unit_hash(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), seed) * (F.col("_total") - 2)).cast("int") + 1
        wanted = F.when(F.col("_total") > 4, F.array(drawn)).otherwise(wanted)
    return rows.where((F.col("_total") <= n) | F.array_contains(wanted, F.col("_rank"))).drop("_rank", "_total")


def listed_order(column: str, listed: Sequence[str]) -> list[Column]:
    """Sort keys that put listed values first, as listed, then the others by name."""
    at = F.array_position(F.array(*map(F.lit, listed)), F.col(column))
    return [F.when(at > 0, at).otherwise(len(listed) + 1), F.col(column)]
