"""Registered at-risk, survival and weight queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cytoframe.functions.session import durable
from cytoframe.operators import censoring as C
from cytoframe.operators import raster as R
from cytoframe.operators import summaries as S
from cytoframe.operators import tracks as T
from cytoframe.plans import motility as M
from cytoframe.sources import adapters as A
from cytoframe.streaming import sampling

TRACK = ["site_id", "track_id"]
COND = ["ploidy", "dose"]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def at_risk_points(spark, sf_dir):
    """Detections with the object under them, its contacts, flags, next-frame states and reason."""
    px = durable(A.pixels(spark, sf_dir))
    pts = A.trackpoints(spark, sf_dir).withColumn("day", F.col("frame"))
    spots = pts.select("event_id", (F.col("frame") % 7 + 1).alias("frame"), (F.rint("y") % 128 + 1).alias("y"), (F.rint("x") % 128 + 1).alias("x"))
    under = R.lookup(spots, px).select("event_id", F.col("frame").alias("plane"), "label")
    areas = px.groupBy("label").agg(F.count("*").alias("area"))
    contact = R.touching(px)
    contact = contact.select(F.col("label_a").alias("label")).unionByName(contact.select(F.col("label_b").alias("label"))).distinct().withColumn("touching", F.lit(True))
    rows = pts.drop("day").join(under, "event_id")
    shared = rows.where("label IS NOT NULL").groupBy("label", "frame").agg(F.count_distinct("track_id").alias("n_tracks"))
    rows = rows.join(areas, "label", "left").join(contact, "label", "left").join(shared, ["label", "frame"], "left")
    rows = rows.withColumns({"track_area": (20 + F.col("event_id") % 60).cast("double"), "link_status": C.link_status(), "object_status": C.object_status()})
    rows = C.point_flags(rows)
    rows = C.neighbours_in_time(rows, TRACK, ["ts", "event_id"])
    last = pts.groupBy("site_id").agg(F.max("frame").alias("site_last_frame"))  # a row per site, so no site's rows need to meet
    return rows.withColumns({"censor_reason": C.censor_reason(), "end_next": (~F.col("next_point")).cast("int"), "is_start": F.col("passes_point") & ~F.col("has_previous_point"), "edge_distance": C.edge_distance(560.0, 100.0)}).join(last, "site_id")


def at_risk(spark, sf_dir):
    rows = at_risk_points(spark, sf_dir)
    rows = rows.where("frame < site_last_frame AND passes_point AND edge_distance IS NOT NULL")
    return _rounded(rows.select("event_id", *TRACK, *COND, "frame", "label", "censor_reason", "end_next", "is_start", "edge_distance"), "edge_distance")


def point_flags(spark, sf_dir):
    return at_risk_points(spark, sf_dir).select("event_id", "link_status", "object_status", *C.FLAGS, "passes_point", "next_point", "raw_next_exists", "has_previous_point", "censor_reason")


def censor_reasons(spark, sf_dir):
    rows = at_risk_points(spark, sf_dir).where("frame < site_last_frame")
    return rows.groupBy("site_id", "censor_reason").agg(F.count("*").alias("n_rows"), F.count_distinct("track_id").alias("n_tracks"))


def stage_counts(spark, sf_dir):
    """How many rows of each site pass one flag after the other, and a row ALL."""
    rows = at_risk_points(spark, sf_dir)
    every, counts = F.lit(True), {}
    for flag in C.FLAGS:
        every = every & F.col(flag)
        counts[f"rows_{flag}"] = F.count_if(every)
    risk = F.col("passes_point") & (F.col("frame") < F.col("site_last_frame"))
    by_site = rows.groupBy("site_id").agg(F.count("*").alias("raw_rows"), F.count_distinct("track_id").alias("raw_tracks"), *[c.alias(n) for n, c in counts.items()], F.count_if(risk).alias("at_risk_rows"), F.avg(F.when(risk, F.col("end_next"))).alias("event_rate"))
    out = C.with_total(by_site, "site_id", ["raw_rows", "raw_tracks", *counts, "at_risk_rows"], {"event_rate": "at_risk_rows"})
    return _rounded(out, "event_rate")


def track_summary(spark, sf_dir):
    """First and last frame, length, speeds and the place of the first detection of each track."""
    rows = T.previous_step(A.tracks(spark, sf_dir), TRACK)
    first = F.min("frame").over(Window.partitionBy(*TRACK))
    rows = rows.withColumn("_first", first)
    out = rows.groupBy(*TRACK).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count_distinct("frame").alias("track_length"), F.avg("step_speed").alias("mean_speed"),
        F.avg(F.when(F.col("frame") <= F.col("_first") + 3, F.col("step_speed"))).alias("early_speed"), F.min_by("x", "frame").alias("start_x"), F.min_by("y", "frame").alias("start_y"),
    )
    return _rounded(out, "mean_speed", "early_speed", "start_x", "start_y")


def _predicted(spark, sf_dir):
    """Tracks with a dropout outcome and a prediction from fixed coefficients."""
    rows = A.tracks(spark, sf_dir)
    w = Window.partitionBy(*TRACK)
    rows = rows.withColumn("last", F.max("frame").over(w)).withColumn("ended", (F.col("frame") == F.col("last")).cast("int")).where("frame < 29")
    return rows.withColumns({"p": S.logistic(F.lit(-3.0) + 0.05 * F.col("frame") + 0.002 * F.col("x")), "p0": S.logistic(F.lit(-2.5) + 0.05 * F.col("frame"))})


_PREDICTED_SQL = A.TRACKS_SQL + """,
pred AS (SELECT * FROM (SELECT *, CASE WHEN frame = max(frame) OVER (PARTITION BY site_id, track_id) THEN 1 ELSE 0 END AS ended,
  1 / (1 + exp(-(-3.0 + 0.05 * frame + 0.002 * x))) AS p, 1 / (1 + exp(-(-2.5 + 0.05 * frame))) AS p0 FROM tracks) WHERE frame < 29)"""


def model_quality(spark, sf_dir):
    return _rounded(C.model_quality(_predicted(spark, sf_dir), COND, "ended", "p"), "event_rate", "mean_predicted", "brier", "log_loss")


def calibration(spark, sf_dir):
    """Mean prediction and outcome in twenty bins of the prediction."""
    rows = S.tiles(_predicted(spark, sf_dir).select(*TRACK, "frame", "p", "ended"), "p", 20, "bin", ["site_id", "track_id", "frame"])
    return _rounded(rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("ended").alias("observed")), "predicted", "observed")


def covariate_checks(spark, sf_dir):
    """Predicted and observed dropout and survival in the quartiles of each covariate."""
    rows = _predicted(spark, sf_dir).select(*TRACK, "frame", "p", "ended", F.col("frame").cast("double").alias("frame_bin"), F.col("x").alias("x_bin"), F.least("y", 100 - F.col("y")).alias("edge_bin"))
    names = ["frame_bin", "x_bin", "edge_bin"]
    for c in names:
        rows = S.tiles(rows, c, 4, f"_{c}", ["site_id", "track_id", "frame"])
    rows = rows.select("p", "ended", *[F.col(f"_{c}").alias(c) for c in names]).unpivot(["p", "ended"], names, "diagnostic", "k")
    out = rows.groupBy("diagnostic", F.concat(F.lit("quartile "), F.col("k").cast("string")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted_dropout"), F.avg("ended").alias("observed_dropout"), F.avg(1 - F.col("p")).alias("predicted_survival"), F.avg(1 - F.col("ended")).alias("observed_survival"))
    return _rounded(out, "predicted_dropout", "observed_dropout", "predicted_survival", "observed_survival")


def survival_by_condition(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    return _rounded(rows.groupBy(*COND).agg(F.count("*").alias("n"), F.count_distinct("site_id", "track_id").alias("n_tracks"), F.avg("ended").alias("dropout"), F.avg(1 - F.col("p")).alias("survival")), "dropout", "survival")


def _weights(spark, sf_dir, max_lag):
    """Squared displacements of all pairs of frames in runs of three frames and more, with their survival weights."""
    rows = T.runs(A.tracks(spark, sf_dir), TRACK)
    p, p0 = S.logistic(F.lit(-3.0) + 0.05 * F.col("frame") + 0.002 * F.col("x")), S.logistic(F.lit(-2.5) + 0.05 * F.col("frame"))
    scored = F.col("frame") < 29
    pairs = C.weighted_pairs(rows, TRACK, max_lag, F.when(scored, 1 - p0), F.when(scored, 1 - p), F.col("run_frames") >= 3)
    squared = (F.col("x_later") - F.col("x")) ** 2 + (F.col("y_later") - F.col("y")) ** 2
    return durable(pairs.select(*COND, "lag", squared.alias("v"), "weight"))


_WEIGHTS_SQL = M.RUNS_SQL + "," + _PREDICTED_SQL.split("\ntracks AS", 1)[1].split("WHERE rn = 1),", 1)[1] + """,
prs AS (SELECT a.ploidy, a.dose, a.site_id, a.track_id, a.frame, b.frame - a.frame AS lag, power(b.x - a.x, 2) + power(b.y - a.y, 2) AS v
  FROM runs a JOIN runs b ON a.site_id = b.site_id AND a.track_id = b.track_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 5),
wts AS (SELECT s.ploidy, s.dose, s.site_id, s.track_id, s.frame, lag, any_value(v) AS v, product(1 - p0) / product(1 - p) AS weight
  FROM prs s JOIN pred d ON d.site_id = s.site_id AND d.track_id = s.track_id AND d.frame BETWEEN s.frame AND s.frame + lag - 1
  GROUP BY ALL HAVING count(*) = lag)"""


def survival_weights(spark, sf_dir, max_lag=5):
    """Quantiles of the weights by lag, and their caps."""
    rows = _weights(spark, sf_dir, max_lag)
    shares = S.global_quantiles(rows, "weight", {"median": 0.5, "p95": 0.95, "p99": 0.99}, ["lag"])
    out = rows.groupBy("lag").agg(F.count("*").alias("n"), F.max("weight").alias("most")).join(shares, "lag")
    return _rounded(out.withColumn("cap", F.least("p95", F.lit(20.0))), "median", "p95", "p99", "most", "cap")


def weighted_msd(spark, sf_dir, max_lag=5):
    """Displacements by lag and condition, weighed by capped survival weights."""
    rows = C.cap_weights(_weights(spark, sf_dir, max_lag), 0.99, 20.0)
    return _rounded(S.weighted_mean_se(rows, [*COND, "lag"], "v", "capped_weight"), "mean", "se", "n_effective").withColumns({c: F.round(c, 3) for c in ("mean", "se", "n_effective")})


def drawn_censoring(spark, sf_dir):
    out = C.draw_censoring(_predicted(spark, sf_dir), TRACK, "p", 17)
    return out.groupBy(*TRACK).agg(F.count("*").alias("n"), F.max("frame").alias("last_frame"))


def boundary_censoring(spark, sf_dir):
    rows = A.tracks(spark, sf_dir).withColumn("leaves", C.leaves_box(8.0, 560.0, 100.0))
    return rows.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(F.col("leaves")).alias("n_leaving"))


def holdout_roles(spark, sf_dir):
    rows = C.holdout(A.tracks(spark, sf_dir), F.concat_ws(":", F.col("track_id").cast("string"), F.col("frame").cast("string")), 0.2, 17)
    return rows.groupBy("role").agg(F.count("*").alias("n"))


def group_sample(spark, sf_dir):
    """Five detections of each condition, by a hash of their id."""
    return C.per_group_sample(A.trackpoints(spark, sf_dir), COND, F.col("event_id"), 5, 17).select(*COND, "event_id")


def row_cap(spark, sf_dir):
    """A sample of a thousand detections, the first by a hash of their id."""
    rows = A.trackpoints(spark, sf_dir).select("event_id", "track_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":17"))).alias("_h"))
    return rows.orderBy("_h", "event_id").limit(1000).select("event_id", "track_id")


def track_sample(spark, sf_dir):
    """All detections of forty tracks, the first by a hash of their id."""
    rows = A.tracks(spark, sf_dir)
    ids = rows.select("track_id").distinct().orderBy(F.md5(F.concat(F.col("track_id").cast("string"), F.lit(":17"))), "track_id").limit(40)
    return rows.join(ids, "track_id", "left_semi").select("track_id", "frame", F.round("x", 6).alias("x"))


def first_tracks(spark, sf_dir):
    """The first five tracks of each condition over batches of ten frames."""
    rows = A.trackpoints(spark, sf_dir).withColumn("batch", F.floor(F.col("frame") / 10).cast("int"))
    return sampling.first_tracks(rows, COND, 5, order="event_id").withColumn("place", F.col("place").cast("long"))


CONTEXT_LADDER = [[*COND, "frame"], COND, ["frame"], []]


def context_resample(spark, sf_dir):
    """A context value for each detection, drawn from all detections: of its condition and frame, else its condition, else its frame, else any."""
    rows = A.tracks(spark, sf_dir)
    wanted = rows.select(F.col("event_id").alias("wanted_id"), *COND, "frame")
    return C.resample(rows.select(*COND, "frame", "event_id"), wanted, CONTEXT_LADDER, "wanted_id", ["event_id"], 17)


def standardised_covariates(spark, sf_dir):
    out = S.standardised(A.tracks(spark, sf_dir).withColumn("fixed", F.lit(1.0)), ["frame", "x", "fixed"])
    return _rounded(out.groupBy("ploidy").agg(F.avg("z_frame").alias("z_frame"), F.avg("z_x").alias("z_x"), F.max("z_fixed").alias("z_fixed")), "z_frame", "z_x", "z_fixed")


def uncensored_tracks(spark, sf_dir):
    """Tracks without flagged detections, and what is left of the others."""
    rows = A.tracks(spark, sf_dir).withColumn("flag", C.leaves_box(8.0, 560.0, 100.0))
    kept = T.runs(rows.where(~F.col("flag")), TRACK, min_frames=3)
    return kept.groupBy("site_id").agg(F.count("*").alias("n_rows"), F.count_distinct("track_id", "run_index").alias("n_runs"))


QUERIES = {
    f.__name__: f
    for f in (
        at_risk, point_flags, censor_reasons, stage_counts, track_summary, model_quality, calibration, covariate_checks, survival_by_condition, survival_weights, weighted_msd,
        drawn_censoring, boundary_censoring, holdout_roles, group_sample, row_cap, track_sample, first_tracks, context_resample, standardised_covariates, uncensored_tracks,
    )
}

RISK_SQL = A.TRACKPOINTS_SQL + ",\n" + A.PIXELS_SQL + """,
areas AS (SELECT label, count(*) AS area FROM pixels GROUP BY label),
contact AS (SELECT DISTINCT a.label FROM pixels a JOIN pixels b ON a.frame = b.frame AND a.label <> b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  AND a.y // 16 BETWEEN b.y // 16 - 1 AND b.y // 16 + 1),
u AS (SELECT t.*, p.label FROM trackpoints t LEFT JOIN pixels p ON p.frame = t.frame % 7 + 1 AND p.y = round_even(t.y, 0) % 128 AND p.x = round_even(t.x, 0) % 128),
n AS (SELECT label, frame, count(DISTINCT track_id) AS n_tracks FROM u WHERE label IS NOT NULL GROUP BY ALL),
f AS (SELECT u.*, CASE WHEN u.label IS NULL THEN 'no_mask_at_track_point' ELSE 'linked_one_mask' END AS link_status,
    CASE WHEN c.label IS NOT NULL THEN 'touching' WHEN coalesce(n_tracks, 0) > 1 THEN 'multi_track' WHEN coalesce(n_tracks, 0) = 0 THEN 'no_track' ELSE 'single_track' END AS object_status,
    u.label IS NOT NULL AS passes_link, c.label IS NULL AND coalesce(n_tracks, 0) = 1 AS passes_object, coalesce(area / (20 + event_id % 60) >= 2, false) AS passes_area_ratio,
    track_id >= 0 AS passes_track_id, true AS passes_numeric
  FROM u LEFT JOIN areas USING (label) LEFT JOIN contact c USING (label) LEFT JOIN n ON n.label = u.label AND n.frame = u.frame),
g AS (SELECT *, passes_link AND passes_object AND passes_area_ratio AND passes_track_id AND passes_numeric AS passes_point FROM f),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, track_id, frame ORDER BY ts, event_id) AS k FROM g) WHERE k = 1),
pp AS (SELECT DISTINCT site_id, track_id, frame FROM g WHERE passes_point),
risk AS (SELECT g.*, a.frame IS NOT NULL AS next_point, r.frame IS NOT NULL AS raw_next_exists, b.frame IS NOT NULL AS has_previous_point,
    CASE WHEN a.frame IS NOT NULL THEN 'observed_next_point' WHEN r.frame IS NULL THEN 'no_raw_next_detection' WHEN NOT r.passes_link THEN 'next_link_failure'
      WHEN NOT r.passes_object THEN 'next_object_not_single_or_touching' WHEN NOT r.passes_area_ratio THEN 'next_area_ratio_failure' WHEN NOT r.passes_point THEN 'next_not_passing' ELSE 'unknown' END AS censor_reason,
    CASE WHEN a.frame IS NULL THEN 1 ELSE 0 END AS end_next, g.passes_point AND b.frame IS NULL AS is_start, max(g.frame) OVER (PARTITION BY g.site_id) AS site_last_frame,
    least(g.x, 560 - g.x, g.y, 100 - g.y) AS edge_distance
  FROM g LEFT JOIN pp a ON a.site_id = g.site_id AND a.track_id = g.track_id AND a.frame = g.frame + 1
  LEFT JOIN pp b ON b.site_id = g.site_id AND b.track_id = g.track_id AND b.frame = g.frame - 1
  LEFT JOIN r ON r.site_id = g.site_id AND r.track_id = g.track_id AND r.frame = g.frame + 1)"""
_U = "CAST(('0x' || substr(md5({} || ':17'), 1, 8)) AS BIGINT) / 4294967296.0"

ORACLE_SQL = {
    "at_risk": A.sql(RISK_SQL, "SELECT event_id, site_id, track_id, ploidy, dose, frame, label, censor_reason, end_next, is_start, round(edge_distance, 6) AS edge_distance FROM risk WHERE frame < site_last_frame AND passes_point"),
    "point_flags": A.sql(RISK_SQL, "SELECT event_id, link_status, object_status, passes_link, passes_object, passes_area_ratio, passes_track_id, passes_numeric, passes_point, next_point, raw_next_exists, has_previous_point, censor_reason FROM risk"),
    "censor_reasons": A.sql(RISK_SQL, "SELECT site_id, censor_reason, count(*) AS n_rows, count(DISTINCT track_id) AS n_tracks FROM risk WHERE frame < site_last_frame GROUP BY ALL"),
    "stage_counts": A.sql(RISK_SQL, """, st AS (SELECT site_id::VARCHAR AS site_id, count(*) AS raw_rows, count(DISTINCT track_id) AS raw_tracks, count(*) FILTER (passes_link) AS rows_passes_link, count(*) FILTER (passes_link AND passes_object) AS rows_passes_object,
        count(*) FILTER (passes_link AND passes_object AND passes_area_ratio) AS rows_passes_area_ratio, count(*) FILTER (passes_point) AS rows_passes_track_id, count(*) FILTER (passes_point) AS rows_passes_numeric,
        count(*) FILTER (passes_point AND frame < site_last_frame) AS at_risk_rows, avg(end_next) FILTER (passes_point AND frame < site_last_frame) AS event_rate FROM risk GROUP BY site_id)
        SELECT * REPLACE (round(event_rate, 6) AS event_rate) FROM st UNION ALL SELECT 'ALL', sum(raw_rows)::BIGINT, sum(raw_tracks)::BIGINT, sum(rows_passes_link)::BIGINT, sum(rows_passes_object)::BIGINT, sum(rows_passes_area_ratio)::BIGINT, sum(rows_passes_track_id)::BIGINT, sum(rows_passes_numeric)::BIGINT, sum(at_risk_rows)::BIGINT, round(sum(event_rate * at_risk_rows) / sum(at_risk_rows), 6) FROM st"""),
    "track_summary": A.sql(A.TRACKS_SQL, """, p AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) END AS s, min(frame) OVER (PARTITION BY site_id, track_id) AS f0 FROM tracks WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame))
        SELECT site_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS track_length, round(avg(s), 6) AS mean_speed, round(avg(s) FILTER (frame <= f0 + 3), 6) AS early_speed, round(arg_min(x, frame), 6) AS start_x, round(arg_min(y, frame), 6) AS start_y FROM p GROUP BY site_id, track_id"""),
    "model_quality": A.sql(_PREDICTED_SQL, "SELECT ploidy, dose, count(*) AS n, round(avg(ended), 6) AS event_rate, round(avg(p), 6) AS mean_predicted, round(avg(power(ended - p, 2)), 6) AS brier, round(-avg(ended * ln(p) + (1 - ended) * ln(1 - p)), 6) AS log_loss FROM pred GROUP BY ALL"),
    "covariate_checks": A.sql(_PREDICTED_SQL, """, q AS (SELECT p, ended, ntile(4) OVER (ORDER BY frame, site_id, track_id) AS frame_bin, ntile(4) OVER (ORDER BY x, site_id, track_id, frame) AS x_bin, ntile(4) OVER (ORDER BY least(y, 100 - y), site_id, track_id, frame) AS edge_bin FROM pred)
        SELECT diagnostic, 'quartile ' || k AS bin, count(*) AS n, round(avg(p), 6) AS predicted_dropout, round(avg(ended), 6) AS observed_dropout, round(avg(1 - p), 6) AS predicted_survival, round(avg(1 - ended), 6) AS observed_survival FROM (UNPIVOT q ON frame_bin, x_bin, edge_bin INTO NAME diagnostic VALUE k) GROUP BY ALL"""),
    "calibration": A.sql(_PREDICTED_SQL, "SELECT CAST(b AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(ended), 6) AS observed FROM (SELECT *, ntile(20) OVER (ORDER BY p, site_id, track_id, frame) AS b FROM pred) GROUP BY ALL"),
    "survival_by_condition": A.sql(_PREDICTED_SQL, "SELECT ploidy, dose, count(*) AS n, count(DISTINCT (site_id, track_id)) AS n_tracks, round(avg(ended), 6) AS dropout, round(avg(1 - p), 6) AS survival FROM pred GROUP BY ALL"),
    "survival_weights": A.sql(_WEIGHTS_SQL, "SELECT lag, count(*) AS n, round(quantile_cont(weight, 0.5), 6) AS median, round(quantile_cont(weight, 0.95), 6) AS p95, round(quantile_cont(weight, 0.99), 6) AS p99, round(max(weight), 6) AS most, round(least(quantile_cont(weight, 0.95), 20), 6) AS cap FROM wts GROUP BY lag"),
    "weighted_msd": A.sql(_WEIGHTS_SQL, """, c AS (SELECT *, least(weight, (SELECT least(quantile_cont(weight, 0.99), 20) FROM wts)) AS w FROM wts),
        z AS (SELECT ploidy, dose, lag, sum(w) AS sw, sum(w * w) AS sw2, sum(w * v) AS wv, sum(w * v * v) AS wv2, count(*) AS n FROM c GROUP BY ALL)
        SELECT ploidy, dose, lag, round(wv / sw, 3) AS mean, round(sqrt(greatest(wv2 / sw - power(wv / sw, 2), 0) / (sw * sw / sw2)), 3) AS se, round(sw * sw / sw2, 3) AS n_effective, n FROM z"""),
    "drawn_censoring": A.sql(_PREDICTED_SQL, f""", d AS (SELECT *, CASE WHEN {_U.format("site_id::VARCHAR || ':' || track_id::VARCHAR || ':' || frame::VARCHAR")} < p THEN frame END AS e FROM pred),
        m AS (SELECT *, min(e) OVER (PARTITION BY site_id, track_id) AS m FROM d)
        SELECT site_id, track_id, count(*) AS n, max(frame) AS last_frame FROM m WHERE m IS NULL OR frame <= m GROUP BY ALL"""),
    "boundary_censoring": A.sql(A.TRACKS_SQL, "SELECT site_id, count(*) AS n, count(*) FILTER (x < 8 OR x > 552 OR y < 8 OR y > 92) AS n_leaving FROM tracks GROUP BY ALL"),
    "holdout_roles": A.sql(A.TRACKS_SQL, f""", h AS (SELECT {_U.format("track_id::VARCHAR || ':' || frame::VARCHAR")} < 0.2 AS t FROM tracks),
        k AS (SELECT count(*) FILTER (t) >= 100 AND count(*) FILTER (NOT t) >= 100 AS ok FROM h)
        SELECT CASE WHEN NOT ok THEN 'all' WHEN t THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM h, k GROUP BY ALL"""),
    "group_sample": A.sql(A.TRACKPOINTS_SQL, "SELECT ploidy, dose, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ploidy, dose ORDER BY md5(event_id::VARCHAR || ':17'), event_id) AS k FROM trackpoints) WHERE k <= 5"),
    "row_cap": "SELECT event_id, user_id AS track_id FROM events ORDER BY md5(event_id::VARCHAR || ':17'), event_id LIMIT 1000",
    "track_sample": A.sql(A.TRACKS_SQL, "SELECT track_id, frame, round(x, 6) AS x FROM tracks WHERE track_id IN (SELECT track_id FROM (SELECT DISTINCT track_id FROM tracks) ORDER BY md5(track_id::VARCHAR || ':17'), track_id LIMIT 40)"),
    "first_tracks": A.sql(A.TRACKPOINTS_SQL, """, f AS (SELECT ploidy, dose, track_id, min((frame // 10, event_id)) AS k FROM trackpoints GROUP BY ALL)
        SELECT ploidy, dose, track_id, place FROM (SELECT *, row_number() OVER (PARTITION BY ploidy, dose ORDER BY k, track_id) AS place FROM f) WHERE place <= 5"""),
    "context_resample": A.sql(A.TRACKS_SQL, f""", pool AS (SELECT ploidy, dose, frame, event_id FROM tracks),
        want AS (SELECT event_id AS wanted_id, ploidy, dose, frame, CAST(('0x' || substr(md5(event_id::VARCHAR || ':17'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM tracks),
        l0 AS (SELECT *, row_number() OVER (PARTITION BY ploidy, dose, frame ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY ploidy, dose, frame) AS n FROM pool),
        l1 AS (SELECT *, row_number() OVER (PARTITION BY ploidy, dose ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY ploidy, dose) AS n FROM pool),
        l2 AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY frame) AS n FROM pool),
        l3 AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM pool)
        SELECT wanted_id, want.ploidy, want.dose, want.frame, coalesce(l0.event_id, l1.event_id, l2.event_id, l3.event_id) AS event_id, CASE WHEN l0.event_id IS NOT NULL THEN 0 WHEN l1.event_id IS NOT NULL THEN 1 WHEN l2.event_id IS NOT NULL THEN 2 WHEN l3.event_id IS NOT NULL THEN 3 END AS ladder_level
        FROM want LEFT JOIN l0 ON l0.ploidy = want.ploidy AND l0.dose = want.dose AND l0.frame = want.frame AND l0.i = floor(u * l0.n)
        LEFT JOIN l1 ON l1.ploidy = want.ploidy AND l1.dose = want.dose AND l1.i = floor(u * l1.n) LEFT JOIN l2 ON l2.frame = want.frame AND l2.i = floor(u * l2.n) LEFT JOIN l3 ON l3.i = floor(u * l3.n)"""),
    "standardised_covariates": A.sql(A.TRACKS_SQL, """, k AS (SELECT avg(frame) AS mf, stddev_samp(frame) AS sf, avg(x) AS mx, stddev_samp(x) AS sx FROM tracks)
        SELECT ploidy, round(avg((frame - mf) / sf), 6) AS z_frame, round(avg((x - mx) / sx), 6) AS z_x, 0.0::DOUBLE AS z_fixed FROM tracks, k GROUP BY ploidy"""),
    "uncensored_tracks": A.sql(A.TRACKS_SQL, """, q AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS s FROM tracks WHERE NOT (x < 8 OR x > 552 OR y < 8 OR y > 92) WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame)),
        i AS (SELECT *, sum(s) OVER (PARTITION BY site_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM q),
        c AS (SELECT *, count(*) OVER (PARTITION BY site_id, track_id, k) AS n FROM i)
        SELECT site_id, count(*) AS n_rows, count(DISTINCT (track_id, k)) AS n_runs FROM c WHERE n >= 3 GROUP BY site_id"""),
}
