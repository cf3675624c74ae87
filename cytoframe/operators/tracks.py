"""Tracks as rows (key, frame, x, y): first rows, runs, segments, steps, displacements and lag pairs.

Every function takes the columns that tell tracks apart, so that one shuffle on them serves all the
windows of a query. Frames are integers; nothing assumes that they are consecutive or distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a total order; NULL keys are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("frame",), min_frames: int = 1) -> DataFrame:
    """Adds run_index, run_frames, run_start and run_end of maximal runs of consecutive frames.

    A run starts where a frame isn't the one before plus 1, so a repeated frame starts a run. Its
    length is the number of its distinct frames; runs with fewer than min_frames go.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.coalesce((F.col("frame") != F.lag("frame").over(w) + 1).cast("int"), F.lit(1))
    marked = df.withColumn("_starts", starts)
    marked = marked.withColumn("run_index", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")
    run = Window.partitionBy(*keys, "run_index")
    # Within a run frames rise by one, so its rows and its distinct frames are as many.
    out = marked.withColumns({"run_frames": F.count("*").over(run), "run_start": F.min("frame").over(run), "run_end": F.max("frame").over(run)})
    return out.where(F.col("run_frames") >= min_frames)


def run_id(site: str = "site_id", track: str = "track_id") -> Column:
    return F.format_string("%s::%s::run%03d", F.col(site).cast("string"), F.col(track).cast("string"), F.col("run_index"))


def sliding_segments(df: DataFrame, keys: Sequence[str], size: int = 3) -> DataFrame:
    """All windows of `size` consecutive rows inside each run: one row per window and position.

    Needs runs(); adds segment_start, segment_end and segment_position (1 to size).
    """
    w = Window.partitionBy(*keys, "run_index").orderBy("frame")
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("run_frames") >= size)
    first = F.greatest(F.lit(1), F.col("_rank") - (size - 1))
    last = F.least(F.col("_rank"), F.col("run_frames").cast("int") - (size - 1))
    out = ranked.withColumn("_window", F.explode(F.sequence(first, last)))
    start = (F.col("run_start") + F.col("_window") - 1).cast("int")
    return out.withColumns({"segment_start": start, "segment_end": (start + size - 1).cast("int"), "segment_position": F.col("_rank") - F.col("_window") + 1}).drop("_rank", "_window")


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def previous_step(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("frame",)) -> DataFrame:
    """Adds step_speed: the distance from the row before, NULL unless that is one frame earlier."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = distance(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return df.withColumn("step_speed", F.when(F.col("frame") == F.lag("frame").over(w) + 1, step))


def forward_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("frame",)) -> DataFrame:
    """Rows whose next row is one frame later, with dx, dy, step_distance and squared_step."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({"_next": F.lead("frame").over(w), "dx": F.lead("x").over(w) - F.col("x"), "dy": F.lead("y").over(w) - F.col("y")})
    out = out.where(F.col("_next") == F.col("frame") + 1).drop("_next")
    return out.withColumns({"step_distance": distance(F.col("dx"), F.col("dy")), "squared_step": F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")})


def frame_window(frame: str = "frame", labels: Sequence[str] = ("frames 0-9", "frames 10-19", "frames 20-40")) -> Column:
    """Window label of a frame, bounds 10, 20 and 40; later frames have none."""
    f = F.col(frame)
    return F.when(f < 10, labels[0]).when(f < 20, labels[1]).when(f <= 40, labels[2])


def origin_displacement(df: DataFrame, keys: Sequence[str], max_step: int | None = None) -> DataFrame:
    """Adds track_step (0 for a track's first row) and the squared displacement from there."""
    w = Window.partitionBy(*keys).orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    dx, dy = (F.col(c) - F.first(c).over(whole) for c in ("x", "y"))
    out = df.withColumns({"track_step": F.row_number().over(w) - 1, "squared_displacement": dx * dx + dy * dy})
    return out if max_step is None else out.where(F.col("track_step") <= max_step)


def centred_segments(df: DataFrame, keys: Sequence[str], size: int = 10) -> DataFrame:
    """The first `size` rows of tracks that have as many, with x and y relative to the first."""
    w = Window.partitionBy(*keys).orderBy("frame")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys)), "segment_step": F.row_number().over(w) - 1, "x_centred": F.col("x") - F.first("x").over(before), "y_centred": F.col("y") - F.first("y").over(before)})
    return out.where((F.col("_n") >= size) & (F.col("segment_step") < size)).drop("_n")


def lag_pairs(df: DataFrame, keys: Sequence[str], max_lag: int, values: Sequence[str] = ("x", "y")) -> DataFrame:
    """Pairs of rows of one track at frames f and f + lag, for lags 1 to max_lag, in one sort of each track.

    Repeated frames on the later side count once, the first by value order; columns of the later row end
    in _later. Rows without a frame or a key have no pairs.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in dict.fromkeys([*keys, "frame"])))
    later = F.struct(*[F.col(v).alias(f"{v}_later") for v in values])
    ahead = rows.withColumns({f"_lag_{k}": F.min(later).over(w.rangeBetween(k, k)) for k in range(1, max_lag + 1)})
    pairs = F.array(*[F.when(F.col(f"_lag_{k}").isNotNull(), F.struct(F.lit(k).alias("lag"), *[F.col(f"_lag_{k}.{v}_later") for v in values])) for k in range(1, max_lag + 1)])
    return ahead.select(*df.columns, F.inline(F.array_compact(pairs)))


def turning(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps followed by a step one frame on, with the next one rotated into the current heading, and the length bin."""
    w = Window.partitionBy(*keys).orderBy("frame")
    out = df.withColumns({"_next": F.lead("frame").over(w), "_dx": F.lead("dx").over(w), "_dy": F.lead("dy").over(w), "heading": F.atan2("dy", "dx")})
    c, s = F.cos("heading"), F.sin("heading")
    out = out.where(F.col("_next") == F.col("frame") + 1)
    return out.withColumns({"next_along": c * F.col("_dx") + s * F.col("_dy"), "next_across": c * F.col("_dy") - s * F.col("_dx"), "step_bin": step_bin()}).drop("_next", "_dx", "_dy")


def step_bin(column: str = "step_distance") -> Column:
    """Right-closed bins; the last label says >= as the reports do."""
    d = F.col(column)
    return F.when(d <= 5, "0-5 px").when(d <= 10, "5-10 px").when(d <= 20, "10-20 px").when(d.isNotNull(), ">=20 px")


def length_bin(column: str = "n_frames") -> Column:
    n = F.col(column)
    return F.when(n >= 10, ">=10").when(n >= 7, "7-9").when(n >= 5, "5-6").otherwise("3-4")


def step_cosine(floor: float = 1e-9) -> Column:
    """Cosine between a step and a later one, with a floor under the product of their lengths."""
    dot = F.col("dx") * F.col("dx_later") + F.col("dy") * F.col("dy_later")
    return dot / F.greatest(distance(F.col("dx"), F.col("dy")) * distance(F.col("dx_later"), F.col("dy_later")), F.lit(floor))


def path_lengths(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per track: rows, path length over all its rows in frame order, and net displacement."""
    w = Window.partitionBy(*keys).orderBy("frame")
    step = distance(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = df.withColumn("_step", step).groupBy(*keys).agg(
        F.count("*").alias("n_frames"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_length"),
        distance(F.max_by("x", "frame") - F.min_by("x", "frame"), F.max_by("y", "frame") - F.min_by("y", "frame")).alias("net_displacement"),
    )
    return out
