"""At-risk rows of tracks: point flags, next-frame states, censor reasons, survival products and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.operators.summaries import fine_hash, finite, global_quantiles, ranked, unit_hash
from cytoframe.operators.tracks import keep_first, lag_pairs

FLAGS = ("passes_link", "passes_object", "passes_area_ratio", "passes_track_id", "passes_numeric")
#: What ends a track, by the first flag that fails in the next frame.
FAILURES = ("next_link_failure", "next_object_not_single_or_touching", "next_area_ratio_failure", "next_track_id_filter", "next_nonfinite_detection")


def object_status(touching: str = "touching", n_tracks: str = "n_tracks") -> Column:
    """touching before multi_track before no_track before single_track; unknown contact counts as none."""
    n = F.coalesce(n_tracks, F.lit(0))
    return F.when(F.coalesce(touching, F.lit(False)), "touching").when(n > 1, "multi_track").when(n == 0, "no_track").otherwise("single_track")


def link_status(label: str = "label") -> Column:
    return F.when(F.col(label).isNull(), "no_mask_at_track_point").otherwise("linked_one_mask")


def point_flags(df: DataFrame, area_ratio: float = 2.0) -> DataFrame:
    """Adds the flags of a point and passes_point, all of them; NULLs pass nothing but touching, which NULL doesn't."""
    ratio = F.try_divide(F.col("area").cast("double"), F.col("track_area").cast("double"))
    flags = {
        "passes_link": (F.col("link_status") == "linked_one_mask") & F.col("label").isNotNull(),
        "passes_object": F.coalesce((F.col("object_status") == "single_track") & ~F.coalesce("touching", F.lit(False)), F.lit(False)),
        "passes_area_ratio": F.coalesce(finite(ratio) >= area_ratio, F.lit(False)),
        "passes_track_id": F.coalesce(F.col("track_id") >= 0, F.lit(False)),
        "passes_numeric": finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull() & F.col("frame").isNotNull(),
    }
    out = df.withColumns(flags)
    every = F.col(FLAGS[0])
    for flag in FLAGS[1:]:
        every = every & F.col(flag)
    return out.withColumn("passes_point", every)


def neighbours_in_time(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds what the same track shows one frame on and one frame back.

    next_point and has_previous_point say whether some passing row is there; raw_next_exists and
    next_<flag> describe the first row of the next frame in the given order. Rows may repeat a frame and
    frames may be missing; a NULL key or frame has no neighbours. All come from one sort by track and
    frame, over windows of the frames beside.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    ahead, behind = w.rangeBetween(1, 1), w.rangeBetween(-1, -1)
    placed = F.col("frame").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    shown = [*FLAGS, "passes_point"]
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*shown).alias("_f"))).over(ahead)
    passes = F.coalesce(F.col("passes_point"), F.lit(False))
    out = df.withColumns({"_next": F.when(placed, first), "next_point": placed & F.coalesce(F.max(passes).over(ahead), F.lit(False)), "has_previous_point": placed & F.coalesce(F.max(passes).over(behind), F.lit(False))})
    out = out.withColumns({"raw_next_exists": F.col("_next").isNotNull(), **{f"next_{c}": F.col(f"_next._f.{c}") for c in shown}})
    return out.drop("_next")


def censor_reason() -> Column:
    """Why a passing point has no passing successor: the first of the ordered reasons that holds."""
    reason = F.when(F.col("next_point"), "observed_next_point").when(~F.col("raw_next_exists"), "no_raw_next_detection")
    for flag, text in zip(FLAGS, FAILURES):
        reason = reason.when(~F.col(f"next_{flag}"), text)
    return reason.when(~F.col("next_passes_point"), "next_not_passing").otherwise("unknown")


def edge_distance(width: float, height: float) -> Column:
    """Distance to the nearest image edge; NULL where a coordinate is, unlike a plain least()."""
    x, y = F.col("x"), F.col("y")
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, width - x, y, height - y))


def leaves_box(radius: float, width: float, height: float) -> Column:
    """Whether a disc of the radius around the point leaves the box."""
    return (F.col("x") < radius) | (F.col("x") > width - radius) | (F.col("y") < radius) | (F.col("y") > height - radius)


def draw_censoring(df: DataFrame, keys: Sequence[str], probability: str, seed: int) -> DataFrame:
    """Rows up to the first frame whose draw falls under its probability; draws follow from track and frame alone."""
    draw = unit_hash(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("frame").cast("string")), seed)
    marked = df.withColumn("_end", F.when(draw < F.col(probability), F.col("frame")))
    first = marked.groupBy(*keys).agg(F.min("_end").alias("_first"))
    return marked.join(first, list(keys)).where(F.col("_first").isNull() | (F.col("frame") <= F.col("_first"))).drop("_end", "_first")


def model_quality(df: DataFrame, keys: Sequence[str], outcome: str, predicted: str) -> DataFrame:
    """Rows, event rate, mean prediction, Brier score and log loss (predictions clipped by 1e-6)."""
    p = F.least(F.greatest(predicted, F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col(outcome)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("event_rate"), F.avg(predicted).alias("mean_predicted"), F.avg((y - F.col(predicted)) ** 2).alias("brier"), (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def survival_weights(pairs: DataFrame, survival: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A weight for each (keys, frame, lag): the product over the links frame .. frame + lag - 1 of numerator over denominator.

    survival has keys, frame, numer and denom; a pair with a link that is missing or has no positive,
    finite denominator has no weight.
    """
    usable = survival.where(finite(F.col("numer")).isNotNull() & finite(F.col("denom")).isNotNull() & (F.col("denom") > 0))
    usable = keep_first(usable, [*keys, "frame"], ["numer", "denom"])
    # Running sums turn a product over links into a difference of two rows: of the log ratio's size, of signs, of zeros, and of links.
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.col("numer") / F.col("denom")
    own = {"l": F.when(ratio != 0, F.log(F.abs(ratio))).otherwise(0.0), "s": (ratio < 0).cast("int"), "z": (ratio == 0).cast("int"), "n": F.lit(1)}
    sums = usable.select(*keys, F.col("frame").cast("bigint").alias("_at"), *[c.alias(f"_{k}") for k, c in own.items()], *[F.sum(c).over(w).alias(f"_{k}_sum") for k, c in own.items()])
    first = sums.select(*keys, F.col("_at").alias("_first"), *[(F.col(f"_{k}_sum") - F.col(f"_{k}")).alias(f"_{k}_a") for k in own])
    last = sums.select(*keys, F.col("_at").alias("_last"), *[F.col(f"_{k}_sum").alias(f"_{k}_b") for k in own])
    wanted = pairs.select(*keys, "frame", "lag").distinct().withColumns({"_first": F.col("frame").cast("bigint"), "_last": (F.col("frame") + F.col("lag") - 1).cast("bigint")})
    got = wanted.join(first, [*keys, "_first"]).join(last, [*keys, "_last"])
    among = {k: F.col(f"_{k}_b") - F.col(f"_{k}_a") for k in own}
    weight = F.when(among["z"] > 0, 0.0).otherwise(F.exp(among["l"]) * F.when(among["s"] % 2 == 1, -1).otherwise(1))
    return got.where(among["n"] == F.col("lag")).select(*keys, "frame", "lag", weight.alias("weight"))


def weighted_pairs(df: DataFrame, keys: Sequence[str], max_lag: int, numer: Column, denom: Column, kept: Column, values: Sequence[str] = ("x", "y")) -> DataFrame:
    """lag_pairs of the rows where kept holds, each with the weight that survival_weights gives it, in one sort of each track.

    numer and denom are those of the link that begins at a row, null where there is none. Rows hold the
    running sums of the links before them, so a pair's links are the difference of its two rows. df has
    a frame once in a track.
    """
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    usable = finite(numer).isNotNull() & finite(denom).isNotNull() & (denom > 0)
    ratio = F.when(usable, numer / denom)
    own = {"_l": F.when(ratio != 0, F.log(F.abs(ratio))), "_s": (ratio < 0).cast("int"), "_z": (ratio == 0).cast("int"), "_n": F.when(ratio.isNotNull(), 1)}
    rows = df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in own.items()}).where(kept)
    pairs = lag_pairs(rows, keys, max_lag, [*values, *own])
    among = {n: F.col(f"{n}_later") - F.col(n) for n in own}
    weight = F.when(among["_z"] > 0, 0.0).otherwise(F.exp(among["_l"]) * F.when(among["_s"] % 2 == 1, -1).otherwise(1))
    return pairs.where(among["_n"] == F.col("lag")).withColumn("weight", weight).drop(*own, *[f"{n}_later" for n in own])


def cap_weights(df: DataFrame, share: float, most: float, name: str = "capped_weight") -> DataFrame:
    """Weights cut at the lesser of a quantile of them all and a fixed cap."""
    limit = global_quantiles(df, "weight", {"_share": share}).select(F.least("_share", F.lit(most)).alias("_cap"))
    return df.crossJoin(F.broadcast(limit)).withColumn(name, F.least("weight", "_cap")).drop("_cap")  # one row


def with_total(df: DataFrame, name: str, sums: Sequence[str], weighted: dict[str, str]) -> DataFrame:
    """Appends a row named ALL: sums of counts, and means weighed by one of the counts."""
    totals = df.agg(*[F.sum(c).alias(c) for c in sums], *[F.try_divide(F.sum(F.col(c) * F.col(w)), F.sum(F.when(F.col(c).isNotNull(), F.col(w)))).alias(c) for c, w in weighted.items()])
    return df.withColumn(name, F.col(name).cast("string")).unionByName(totals.withColumn(name, F.lit("ALL")))


def holdout(df: DataFrame, key: Column, share: float, seed: int, least: int = 100) -> DataFrame:
    """Adds role train or test by a hash of the key; all rows are both ('all') where either side has under `least`."""
    drawn = df.withColumn("_test", unit_hash(key, seed) < share)
    enough = drawn.agg((F.count_if(F.col("_test")) >= least).alias("_a"), (F.count_if(~F.col("_test")) >= least).alias("_b"))
    out = drawn.crossJoin(F.broadcast(enough))  # one row
    return out.withColumn("role", F.when(~(F.col("_a") & F.col("_b")), "all").when(F.col("_test"), "test").otherwise("train")).drop("_test", "_a", "_b")


def per_group_sample(df: DataFrame, keys: Sequence[str], ident: Column, n: int, seed: int) -> DataFrame:
    """n rows of each group, the first by a hash of an identifying column."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}"))), ident)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def resample(pool: DataFrame, wanted: DataFrame, ladder: Sequence[Sequence[str]], ident: str, values: Sequence[str], seed: int) -> DataFrame:
    """For each wanted row, a pool row by a hash of `ident` from the first key set of the ladder that has any.

    Pools are numbered within their key by ranges, so no task holds a whole key; a draw is an index and the
    join an equi-join.
    """
    drawn = wanted.withColumn("_u", fine_hash(F.col(ident), seed))
    out = drawn
    for level, keys in enumerate(ladder):
        numbered = ranked(pool.select(*keys, *values), values, keys).select(*keys, *values, F.col("rank").cast("bigint").alias("_i"))
        counts = numbered.groupBy(*keys).agg(F.count("*").alias(f"_n{level}")) if keys else numbered.agg(F.count("*").alias(f"_n{level}"))
        out = out.join(counts, list(keys), "left") if keys else out.crossJoin(F.broadcast(counts))
        out = out.withColumn("_i", F.floor(F.col("_u") * F.coalesce(F.col(f"_n{level}"), F.lit(0))).cast("bigint"))
        renamed = numbered.select(*keys, "_i", *[F.col(v).alias(f"_{v}{level}") for v in values], F.lit(level).alias(f"_l{level}"))
        out = out.join(renamed, [*keys, "_i"], "left").drop("_i", f"_n{level}")
    best = F.coalesce(*[F.col(f"_l{k}") for k in range(len(ladder))])
    chosen = {v: F.coalesce(*[F.when(best == k, F.col(f"_{v}{k}")) for k in range(len(ladder))]) for v in values}
    return out.select(*wanted.columns, *[c.alias(v) for v, c in chosen.items()], best.alias("ladder_level"))
