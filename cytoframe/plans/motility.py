"""Registered motility queries over detections, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cytoframe.functions import sql as Q
from cytoframe.operators import summaries as S
from cytoframe.operators import tracks as T
from cytoframe.sources import adapters as A

TRACK = ["site_id", "track_id"]
COND = ["ploidy", "dose"]
ALL = [*COND, *TRACK]

#: Runs of at least three frames of each track, as the queries below start from.
RUNS_SQL = A.TRACKS_SQL + """,
marked AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS starts FROM tracks
           WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame)),
indexed AS (SELECT * EXCLUDE (starts), CAST(sum(starts) OVER (PARTITION BY site_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_index FROM marked),
runs AS (SELECT * FROM (SELECT *, count(*) OVER r AS run_frames, min(frame) OVER r AS run_start, max(frame) OVER r AS run_end FROM indexed
         WINDOW r AS (PARTITION BY site_id, track_id, run_index)) WHERE run_frames >= 3)"""
STEPS_SQL = RUNS_SQL + """,
steps AS (SELECT *, sqrt(dx * dx + dy * dy) AS step_distance, dx * dx + dy * dy AS squared_step FROM (
  SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM runs
  WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame)) WHERE nf = frame + 1)"""
MEAN_SE = "round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS se, count(v) AS n"


def _runs(spark, sf_dir):
    return T.runs(A.tracks(spark, sf_dir), TRACK, min_frames=3)


def _steps(spark, sf_dir):
    return T.forward_steps(_runs(spark, sf_dir), TRACK)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def msd_by_lag(spark, sf_dir):
    """Mean squared displacement over all pairs of frames up to five apart, by condition."""
    pairs = T.lag_pairs(_runs(spark, sf_dir).select(*ALL, "frame", "x", "y"), ALL, 5)
    squared = (F.col("x_later") - F.col("x")) ** 2 + (F.col("y_later") - F.col("y")) ** 2
    return _rounded(S.mean_se(pairs.withColumn("v", squared), [*COND, "lag"], "v"), "mean", "se")


MSD_SQL = RUNS_SQL + """,
pairs AS (SELECT a.ploidy, a.dose, a.site_id, a.track_id, b.frame - a.frame AS lag, power(b.x - a.x, 2) + power(b.y - a.y, 2) AS v
  FROM runs a JOIN runs b ON a.site_id = b.site_id AND a.track_id = b.track_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 5)"""


def track_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("site_id", "track_id", "frame", F.col("run_index").cast("long"), F.col("run_frames").cast("long"), "run_start", "run_end", T.run_id().alias("run_id"))


def raw_track_runs(spark, sf_dir):
    """Runs of raw detections, where a repeated frame starts a run."""
    rows = T.runs(A.trackpoints(spark, sf_dir), TRACK, ["frame", "ts", "event_id"])
    return rows.groupBy("site_id", "track_id", "run_index").agg(F.count("*").alias("n_rows"), F.count_distinct("frame").alias("n_frames"), F.min("frame").alias("run_start"))


def sliding_segments(spark, sf_dir):
    out = T.sliding_segments(_runs(spark, sf_dir), TRACK)
    return out.select("site_id", "track_id", "frame", "segment_start", "segment_end", "segment_position", F.format_string("%s_%s_%03d_%03d", F.col("site_id").cast("string"), F.col("track_id").cast("string"), "segment_start", "segment_end").alias("segment_id"))


def segments_by_sql(spark, sf_dir):
    """The sliding segments as a query in SQL."""
    Q.register(spark)
    return spark.sql(
        """SELECT site_id, track_id, frame, segment_start, segment_end, segment_position, format_string('%s_%s_%03d_%03d', CAST(site_id AS STRING), CAST(track_id AS STRING), segment_start, segment_end) AS segment_id
        FROM sliding_segments(TABLE(SELECT site_id, track_id, run_index, frame FROM {runs}) PARTITION BY (site_id, track_id, run_index) ORDER BY (frame), 3)""",
        runs=_runs(spark, sf_dir),
    )


def steps_by_sql(spark, sf_dir):
    """Plain and weighted means of steps by condition as a query in SQL, by the library's functions."""
    Q.register(spark)
    return spark.sql(
        """WITH rows AS (SELECT ploidy, dose, step_bin(step_distance) AS step_bin, finite_or_null(step_distance) AS v, CAST(1 + frame AS DOUBLE) AS w FROM {steps}),
        sums AS (SELECT ploidy, dose, step_bin, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n, sum(w) AS w, sum(w * w) AS w2, sum(w * v) AS wv, sum(w * v * v) AS wv2 FROM rows GROUP BY ALL),
        found AS (SELECT *, standard_error(sd, n) AS se, weighted_standard_error(w, w2, wv, wv2) AS weighted_se, effective_n(w, w2) AS n_effective FROM sums)
        SELECT ploidy, dose, step_bin, round(mean, 6) AS mean, round(se, 6) AS se, round(wv / w, 6) AS weighted_mean, round(weighted_se, 6) AS weighted_se, round(n_effective, 6) AS n_effective FROM found""",
        steps=_steps(spark, sf_dir),
    )


def previous_steps(spark, sf_dir):
    """Step speed, the track's mean and early mean, and the first of the three that is there."""
    rows = T.previous_step(A.tracks(spark, sf_dir), TRACK)
    w = Window.partitionBy(*TRACK)
    early = F.avg(F.when(F.col("frame") <= F.col("first_frame") + 3, F.col("step_speed"))).over(w)
    rows = rows.withColumns({"mean_speed": F.avg("step_speed").over(w), "first_frame": F.min("frame").over(w)}).withColumn("early_speed", early)
    rows = rows.withColumn("model_speed", F.coalesce("step_speed", "early_speed", "mean_speed"))
    return _rounded(rows.select(*TRACK, "frame", "step_speed", "mean_speed", "early_speed", "model_speed"), "step_speed", "mean_speed", "early_speed", "model_speed")


def forward_steps(spark, sf_dir):
    out = _steps(spark, sf_dir).withColumn("frame_window", T.frame_window())
    return _rounded(out.select(*ALL, "frame", "dx", "dy", "step_distance", "squared_step", "frame_window"), "dx", "dy", "step_distance", "squared_step")


def origin_msd(spark, sf_dir):
    """Mean squared displacement from a run's first detection by step, in three statistics."""
    rows = T.origin_displacement(_runs(spark, sf_dir), [*ALL, "run_index"], 10)
    return _rounded(S.mean_se(rows, [*COND, "track_step"], "squared_displacement"), "mean", "se").withColumn("track_step", F.col("track_step").cast("long"))


def windowed_msd(spark, sf_dir, max_lag=10):
    """All-pairs displacement by lag and by the window of the earlier frame."""
    pairs = T.lag_pairs(_runs(spark, sf_dir).select(*ALL, "frame", "x", "y"), ALL, max_lag).withColumn("frame_window", T.frame_window())
    squared = (F.col("x_later") - F.col("x")) ** 2 + (F.col("y_later") - F.col("y")) ** 2
    return _rounded(S.mean_se(pairs.withColumn("v", squared), [*COND, "frame_window", "lag"], "v"), "mean", "se")


def centred_segments(spark, sf_dir):
    out = T.centred_segments(A.tracks(spark, sf_dir), TRACK)
    return out.select(*TRACK, "frame", F.col("segment_step").cast("long"), F.round("x_centred", 6).alias("x_centred"), F.round("y_centred", 6).alias("y_centred"))


def _step_pairs(spark, sf_dir, max_lag=5):
    return T.lag_pairs(_steps(spark, sf_dir).select(*ALL, "frame", "dx", "dy"), ALL, max_lag, ("dx", "dy"))


def acf_cosine(spark, sf_dir, max_lag=10):
    """Mean cosine between steps by lag."""
    return _rounded(S.mean_se(_step_pairs(spark, sf_dir, max_lag).withColumn("v", T.step_cosine()), [*COND, "lag"], "v"), "mean", "se")


def acf_dot(spark, sf_dir):
    """Mean dot product of steps by lag over the mean squared step of the condition."""
    base = _steps(spark, sf_dir).groupBy(*COND).agg(F.avg("squared_step").alias("base"))
    dots = _step_pairs(spark, sf_dir).groupBy(*COND, "lag").agg(F.avg(F.col("dx") * F.col("dx_later") + F.col("dy") * F.col("dy_later")).alias("dot"), F.count("*").alias("n_pairs"))
    return dots.join(base, COND, "left").select(*COND, "lag", F.round(F.try_divide("dot", "base"), 6).alias("acf"), "n_pairs")


def turning(spark, sf_dir):
    """Next steps in the frame of the current heading, by length bin."""
    out = T.turning(_steps(spark, sf_dir), TRACK).groupBy(*COND, "step_bin").agg(F.avg("next_along").alias("along"), F.avg("next_across").alias("across"), F.count("*").alias("n"))
    return _rounded(out, "along", "across")


def _track_msd(spark, sf_dir):
    pairs = T.lag_pairs(_runs(spark, sf_dir).select(*ALL, "frame", "x", "y"), ALL, 5)
    return pairs.withColumn("v", (F.col("x_later") - F.col("x")) ** 2 + (F.col("y_later") - F.col("y")) ** 2)


def msd_auc(spark, sf_dir):
    """Mean over lags of each track's displacement by lag, then by condition."""
    by_lag = _track_msd(spark, sf_dir).groupBy(*ALL, "lag").agg(F.avg("v").alias("v"))
    return _rounded(S.mean_se(by_lag.groupBy(*ALL).agg(F.avg("v").alias("v")), COND, "v"), "mean", "se")


def ploidy_contrast(spark, sf_dir):
    """Mean steps of the two ploidies side by side, by dose."""
    means = S.mean_se(_steps(spark, sf_dir), COND, "step_distance")
    out = S.contrast(means, ["dose"], "ploidy", ("2N", "4N"))
    return _rounded(out, "mean_2n", "se_2n", "mean_4n", "se_4n", "difference", "difference_se", "ratio")


def track_lengths(spark, sf_dir):
    """Quantiles of track lengths in frames, by condition."""
    lengths = A.tracks(spark, sf_dir).groupBy(*ALL).agg(F.count_distinct("frame").alias("n_frames"))
    return _rounded(S.quantiles(lengths, COND, "n_frames", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "q25", "median", "q75")


def length_distribution(spark, sf_dir):
    """Runs by length bin, one column a bin, 0 where there are none."""
    one = _runs(spark, sf_dir).groupBy(*ALL, "run_index").agg(F.count("*").alias("n_frames")).withColumn("bin", T.length_bin())
    bins = ["3-4", "5-6", "7-9", ">=10"]
    out = one.groupBy(*COND).pivot("bin", bins).count().fillna(0, bins)
    return out.select(*COND, *[F.col(f"`{b}`").alias(n) for b, n in zip(bins, ("n_3_4", "n_5_6", "n_7_9", "n_10_up"))])


def threshold_sensitivity(spark, sf_dir):
    """Track and step statistics for several least track lengths at once."""
    w = Window.partitionBy(*TRACK, "run_index").orderBy("frame")
    start = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _runs(spark, sf_dir).withColumns({
        "step": T.distance(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")), "k": F.row_number().over(w) - 1,
        "squared": F.pow(F.col("x") - F.first("x").over(start), 2) + F.pow(F.col("y") - F.first("y").over(start), 2),
    })
    # A row counts for each threshold that its run reaches; the first row of a run stands for the run.
    rows = rows.withColumn("min_frames", F.explode(F.filter(F.array(*map(F.lit, (3, 4, 5))), lambda t: t <= F.col("run_frames"))))
    length = F.when(F.col("k") == 0, F.col("run_frames"))
    out = rows.groupBy(*COND, "min_frames").agg(
        F.count(length).alias("n_tracks"), F.percentile(length, F.lit(0.5)).alias("median_frames"), F.percentile(length, F.lit(0.9)).alias("p90_frames"), F.count("step").alias("n_steps"), F.avg("step").alias("mean_step"),
        *[F.avg(F.when(F.col("k") == k, F.col("squared"))).alias(f"msd_step_{k}") for k in (3, 5, 10)],
    )
    return out.withColumns({c: F.round(c, 2) for c in ("median_frames", "p90_frames", "mean_step", "msd_step_3", "msd_step_5", "msd_step_10")})


def step_metrics_long(spark, sf_dir):
    """Step metrics of each condition, one row a metric."""
    wide = _steps(spark, sf_dir).groupBy(*COND).agg(F.avg("step_distance").alias("mean_step"), F.max("step_distance").alias("max_step"), F.avg("squared_step").alias("mean_squared_step"))
    return _rounded(wide.unpivot(COND, ["mean_step", "max_step", "mean_squared_step"], "metric", "value"), "value")


def track_paths(spark, sf_dir):
    return _rounded(T.path_lengths(A.tracks(spark, sf_dir), TRACK), "path_length", "net_displacement")


def crop_size(spark, sf_dir):
    """The crop that holds every track: most of ceil(range + 1 + 2 * 10), per axis."""
    ranges = A.tracks(spark, sf_dir).groupBy(*TRACK).agg(*[F.ceil(F.max(c) - F.min(c) + 1 + 20).alias(c) for c in "xy"])
    return ranges.agg(F.max("x").alias("crop_x"), F.max("y").alias("crop_y"))


def weighted_steps(spark, sf_dir):
    """Mean step by condition, weighed by 1 + frame."""
    rows = _steps(spark, sf_dir).withColumn("w", (1 + F.col("frame")).cast("double"))
    return _rounded(S.weighted_mean_se(rows, COND, "step_distance", "w"), "mean", "se", "n_effective")


def speed_quartiles(spark, sf_dir):
    """Steps by quartile of their length, over all steps."""
    out = S.tiles(_steps(spark, sf_dir).select(*TRACK, "frame", "step_distance"), "step_distance", 4, "quartile", ["site_id", "track_id", "frame"])
    return _rounded(out.groupBy("quartile").agg(F.count("*").alias("n"), F.min("step_distance").alias("least"), F.max("step_distance").alias("most")), "least", "most")


def capped_steps(spark, sf_dir):
    out = S.capped(_steps(spark, sf_dir), "step_distance", 0.99, "capped")
    return _rounded(out.groupBy(*COND).agg(F.avg("capped").alias("mean_capped"), F.max("capped").alias("max_capped")), "mean_capped", "max_capped")


def best_step(spark, sf_dir):
    """The longest step of each track, the three longest of each condition flagged by rank."""
    rows = _steps(spark, sf_dir)
    best = T.keep_first(rows, TRACK, [F.col("step_distance").desc(), "frame"])
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*COND).orderBy(F.col("step_distance").desc(), *TRACK))).where("rank <= 3")
    return _rounded(ranked.select(*COND, *TRACK, "frame", "step_distance", F.col("rank").cast("long")), "step_distance")


def latest_detection(spark, sf_dir):
    """The last detection of each track to arrive."""
    rows = A.trackpoints(spark, sf_dir)
    return T.keep_first(rows, ["track_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("track_id", "event_id", "frame")


QUERIES = {
    f.__name__: f
    for f in (
        msd_by_lag, track_runs, raw_track_runs, sliding_segments, segments_by_sql, steps_by_sql, previous_steps, forward_steps, origin_msd, windowed_msd,
        centred_segments, acf_cosine, acf_dot, turning, msd_auc, ploidy_contrast, track_lengths, length_distribution,
        threshold_sensitivity, step_metrics_long, track_paths, crop_size, weighted_steps, speed_quartiles, capped_steps,
        best_step, latest_detection,
    )
}

_WINDOW = "CASE WHEN frame < 10 THEN 'frames 0-9' WHEN frame < 20 THEN 'frames 10-19' WHEN frame <= 40 THEN 'frames 20-40' END"
_STEP_PAIRS = STEPS_SQL + """,
sp AS (SELECT a.ploidy, a.dose, b.frame - a.frame AS lag, a.dx AS dx, a.dy AS dy, b.dx AS ex, b.dy AS ey
  FROM steps a JOIN steps b ON a.site_id = b.site_id AND a.track_id = b.track_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 5)"""

ORACLE_SQL = {
    "msd_by_lag": A.sql(MSD_SQL, f"SELECT ploidy, dose, lag, {MEAN_SE} FROM pairs GROUP BY ALL"),
    "track_runs": A.sql(RUNS_SQL, "SELECT site_id, track_id, frame, run_index, run_frames, run_start, run_end, printf('%s::%s::run%03d', site_id::VARCHAR, track_id::VARCHAR, run_index) AS run_id FROM runs"),
    "raw_track_runs": A.sql(
        A.TRACKPOINTS_SQL,
        """, m AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS s FROM trackpoints WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame, ts, event_id)),
        i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY site_id, track_id ORDER BY frame, ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_index FROM m)
        SELECT site_id, track_id, run_index, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, min(frame) AS run_start FROM i GROUP BY ALL""",
    ),
    "sliding_segments": A.sql(RUNS_SQL, """SELECT r.site_id, r.track_id, r.frame, CAST(s AS INTEGER) AS segment_start, CAST(s + 2 AS INTEGER) AS segment_end, CAST(r.frame - s + 1 AS INTEGER) AS segment_position,
        printf('%s_%s_%03d_%03d', r.site_id::VARCHAR, r.track_id::VARCHAR, s, s + 2) AS segment_id
        FROM runs r, LATERAL (SELECT unnest(range(greatest(run_start, r.frame - 2), least(r.frame, run_end - 2) + 1)) AS s)"""),
    "previous_steps": A.sql(A.TRACKS_SQL, """, p AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) END AS step_speed, min(frame) OVER (PARTITION BY site_id, track_id) AS f0 FROM tracks WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame)),
        q AS (SELECT *, avg(step_speed) OVER t AS mean_speed, avg(CASE WHEN frame <= f0 + 3 THEN step_speed END) OVER t AS early_speed FROM p WINDOW t AS (PARTITION BY site_id, track_id))
        SELECT site_id, track_id, frame, round(step_speed, 6) AS step_speed, round(mean_speed, 6) AS mean_speed, round(early_speed, 6) AS early_speed, round(coalesce(step_speed, early_speed, mean_speed), 6) AS model_speed FROM q"""),
    "forward_steps": A.sql(STEPS_SQL, f"SELECT ploidy, dose, site_id, track_id, frame, round(dx, 6) AS dx, round(dy, 6) AS dy, round(step_distance, 6) AS step_distance, round(squared_step, 6) AS squared_step, {_WINDOW} AS frame_window FROM steps"),
    "origin_msd": A.sql(RUNS_SQL, f""", o AS (SELECT ploidy, dose, row_number() OVER w - 1 AS track_step, power(x - first_value(x) OVER w, 2) + power(y - first_value(y) OVER w, 2) AS v FROM runs WINDOW w AS (PARTITION BY ploidy, dose, site_id, track_id, run_index ORDER BY frame))
        SELECT ploidy, dose, track_step, {MEAN_SE} FROM o WHERE track_step <= 10 GROUP BY ALL"""),
    "windowed_msd": A.sql(MSD_SQL.replace("a.frame + 5", "a.frame + 10").replace("b.frame - a.frame AS lag", "a.frame AS frame, b.frame - a.frame AS lag"), f"SELECT ploidy, dose, {_WINDOW} AS frame_window, lag, {MEAN_SE} FROM pairs GROUP BY ALL"),
    "centred_segments": A.sql(A.TRACKS_SQL, """SELECT site_id, track_id, frame, segment_step, round(xc, 6) AS x_centred, round(yc, 6) AS y_centred FROM (
        SELECT *, count(*) OVER (PARTITION BY site_id, track_id) AS n, row_number() OVER w - 1 AS segment_step, x - first_value(x) OVER w AS xc, y - first_value(y) OVER w AS yc FROM tracks WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame)) WHERE n >= 10 AND segment_step < 10"""),
    "acf_cosine": A.sql(_STEP_PAIRS.replace("a.frame + 5", "a.frame + 10"), f"SELECT ploidy, dose, lag, {MEAN_SE} FROM (SELECT *, (dx * ex + dy * ey) / greatest(sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey), 1e-9) AS v FROM sp) GROUP BY ALL"),
    "acf_dot": A.sql(_STEP_PAIRS, "SELECT ploidy, dose, lag, round(avg(dx * ex + dy * ey) / any_value(base), 6) AS acf, count(*) AS n_pairs FROM sp JOIN (SELECT ploidy, dose, avg(squared_step) AS base FROM steps GROUP BY ALL) USING (ploidy, dose) GROUP BY ALL"),
    "turning": A.sql(STEPS_SQL, """, t AS (SELECT *, lead(frame) OVER w AS n2, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, atan2(dy, dx) AS h FROM steps WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame))
        SELECT ploidy, dose, CASE WHEN step_distance <= 5 THEN '0-5 px' WHEN step_distance <= 10 THEN '5-10 px' WHEN step_distance <= 20 THEN '10-20 px' ELSE '>=20 px' END AS step_bin,
        round(avg(cos(h) * ex + sin(h) * ey), 6) AS along, round(avg(cos(h) * ey - sin(h) * ex), 6) AS across, count(*) AS n FROM t WHERE n2 = frame + 1 GROUP BY ALL"""),
    "msd_auc": A.sql(MSD_SQL, f"SELECT ploidy, dose, {MEAN_SE} FROM (SELECT ploidy, dose, site_id, track_id, avg(v) AS v FROM (SELECT ploidy, dose, site_id, track_id, lag, avg(v) AS v FROM pairs GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"),
    "ploidy_contrast": A.sql(STEPS_SQL, """, m AS (SELECT ploidy, dose, avg(step_distance) AS mean, stddev_samp(step_distance) / sqrt(count(*)) AS se, count(*) AS n FROM steps GROUP BY ALL),
        w AS (SELECT dose, any_value(mean) FILTER (ploidy = '2N') AS mean_2n, any_value(se) FILTER (ploidy = '2N') AS se_2n, any_value(n) FILTER (ploidy = '2N') AS n_2n, any_value(mean) FILTER (ploidy = '4N') AS mean_4n, any_value(se) FILTER (ploidy = '4N') AS se_4n, any_value(n) FILTER (ploidy = '4N') AS n_4n FROM m GROUP BY dose)
        SELECT dose, round(mean_2n, 6) AS mean_2n, round(se_2n, 6) AS se_2n, n_2n, round(mean_4n, 6) AS mean_4n, round(se_4n, 6) AS se_4n, n_4n, round(mean_4n - mean_2n, 6) AS difference, round(sqrt(se_2n * se_2n + se_4n * se_4n), 6) AS difference_se, round(mean_4n / mean_2n, 6) AS ratio FROM w"""),
    "track_lengths": A.sql(A.TRACKS_SQL, "SELECT ploidy, dose, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q75, count(*) AS n FROM (SELECT ploidy, dose, site_id, track_id, count(DISTINCT frame) AS n FROM tracks GROUP BY ALL) GROUP BY ploidy, dose"),
    "length_distribution": A.sql(RUNS_SQL, "SELECT ploidy, dose, count(*) FILTER (n < 5) AS n_3_4, count(*) FILTER (n BETWEEN 5 AND 6) AS n_5_6, count(*) FILTER (n BETWEEN 7 AND 9) AS n_7_9, count(*) FILTER (n >= 10) AS n_10_up FROM (SELECT ploidy, dose, site_id, track_id, run_index, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ploidy, dose"),
    "threshold_sensitivity": A.sql(RUNS_SQL, """, l AS (SELECT ploidy, dose, site_id, track_id, run_index, count(*) AS n FROM runs GROUP BY ALL),
        e AS (SELECT l.*, m AS min_frames FROM l, (VALUES (3), (4), (5)) t(m) WHERE n >= m),
        c AS (SELECT ploidy, dose, min_frames, count(*) AS n_tracks, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM e GROUP BY ALL),
        s AS (SELECT * FROM (SELECT *, lead(frame) OVER w AS nf, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS d FROM runs WINDOW w AS (PARTITION BY ploidy, dose, site_id, track_id, run_index ORDER BY frame)) WHERE nf = frame + 1),
        t AS (SELECT e.ploidy, e.dose, min_frames, count(*) AS n_steps, avg(d) AS mean_step FROM s JOIN e USING (ploidy, dose, site_id, track_id, run_index) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER w - 1 AS k, power(x - first_value(x) OVER w, 2) + power(y - first_value(y) OVER w, 2) AS v FROM runs WINDOW w AS (PARTITION BY ploidy, dose, site_id, track_id, run_index ORDER BY frame)),
        g AS (SELECT e.ploidy, e.dose, min_frames, avg(v) FILTER (k = 3) AS m3, avg(v) FILTER (k = 5) AS m5, avg(v) FILTER (k = 10) AS m10 FROM o JOIN e USING (ploidy, dose, site_id, track_id, run_index) WHERE k IN (3, 5, 10) GROUP BY ALL)
        SELECT c.ploidy, c.dose, c.min_frames, n_tracks, round(p50, 2) AS median_frames, round(p90, 2) AS p90_frames, n_steps, round(mean_step, 2) AS mean_step, round(m3, 2) AS msd_step_3, round(m5, 2) AS msd_step_5, round(m10, 2) AS msd_step_10
        FROM c LEFT JOIN t USING (ploidy, dose, min_frames) LEFT JOIN g USING (ploidy, dose, min_frames)"""),
    "step_metrics_long": A.sql(STEPS_SQL, """SELECT ploidy, dose, 'mean_step' AS metric, round(avg(step_distance), 6) AS value FROM steps GROUP BY ALL
        UNION ALL SELECT ploidy, dose, 'max_step', round(max(step_distance), 6) FROM steps GROUP BY ALL
        UNION ALL SELECT ploidy, dose, 'mean_squared_step', round(avg(squared_step), 6) FROM steps GROUP BY ALL"""),
    "track_paths": A.sql(A.TRACKS_SQL, """, s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM tracks WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame))
        SELECT site_id, track_id, count(*) AS n_frames, round(coalesce(sum(d), 0.0), 6) AS path_length, round(sqrt(power(arg_max(x, frame) - arg_min(x, frame), 2) + power(arg_max(y, frame) - arg_min(y, frame), 2)), 6) AS net_displacement FROM s GROUP BY ALL"""),
    "crop_size": A.sql(A.TRACKS_SQL, "SELECT CAST(max(ceil(cx)) AS BIGINT) AS crop_x, CAST(max(ceil(cy)) AS BIGINT) AS crop_y FROM (SELECT max(x) - min(x) + 21 AS cx, max(y) - min(y) + 21 AS cy FROM tracks GROUP BY site_id, track_id)"),
    "weighted_steps": A.sql(STEPS_SQL, """, z AS (SELECT ploidy, dose, sum(1.0 + frame) AS w, sum(power(1.0 + frame, 2)) AS w2, sum((1.0 + frame) * step_distance) AS wv, sum((1.0 + frame) * step_distance * step_distance) AS wv2, count(*) AS n FROM steps GROUP BY ALL)
        SELECT ploidy, dose, round(wv / w, 6) AS mean, round(sqrt(greatest(wv2 / w - power(wv / w, 2), 0) / (w * w / w2)), 6) AS se, round(w * w / w2, 6) AS n_effective, n FROM z"""),
    "speed_quartiles": A.sql(STEPS_SQL, "SELECT CAST(q AS INTEGER) AS quartile, count(*) AS n, round(min(step_distance), 6) AS least, round(max(step_distance), 6) AS most FROM (SELECT *, ntile(4) OVER (ORDER BY step_distance, site_id, track_id, frame) AS q FROM steps) GROUP BY ALL"),
    "capped_steps": A.sql(STEPS_SQL, "SELECT ploidy, dose, round(avg(least(step_distance, c)), 6) AS mean_capped, round(max(least(step_distance, c)), 6) AS max_capped FROM steps, (SELECT quantile_cont(step_distance, 0.99) AS c FROM steps) GROUP BY ALL"),
    "best_step": A.sql(STEPS_SQL, """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, track_id ORDER BY step_distance DESC, frame) AS k FROM steps) WHERE k = 1)
        SELECT ploidy, dose, site_id, track_id, frame, round(step_distance, 6) AS step_distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY ploidy, dose ORDER BY step_distance DESC, site_id, track_id) AS rank FROM b) WHERE rank <= 3"""),
    "latest_detection": A.sql(A.TRACKPOINTS_SQL, "SELECT track_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(frame, (ts, event_id)) AS frame FROM trackpoints GROUP BY ALL"),
}
ORACLE_SQL["segments_by_sql"] = ORACLE_SQL["sliding_segments"]
ORACLE_SQL["steps_by_sql"] = A.sql(STEPS_SQL, """, z AS (SELECT *, 1.0::DOUBLE + frame AS w, CASE WHEN step_distance <= 5 THEN '0-5 px' WHEN step_distance <= 10 THEN '5-10 px' WHEN step_distance <= 20 THEN '10-20 px' ELSE '>=20 px' END AS step_bin FROM steps)
    SELECT ploidy, dose, step_bin, round(avg(step_distance), 6) AS mean, round(stddev_samp(step_distance) / sqrt(count(*)), 6) AS se, round(sum(w * step_distance) / sum(w), 6) AS weighted_mean,
      round(sqrt(greatest(sum(w * step_distance * step_distance) / sum(w) - power(sum(w * step_distance) / sum(w), 2), 0) / (sum(w) * sum(w) / sum(w * w))), 6) AS weighted_se, round(sum(w) * sum(w) / sum(w * w), 6) AS n_effective FROM z GROUP BY ALL""")
