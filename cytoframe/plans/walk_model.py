"""Registered queries of the random-walk model and of model scoring."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cytoframe.functions.session import durable
from cytoframe.operators import censoring as C
from cytoframe.operators import imaging as G
from cytoframe.operators import linking as L
from cytoframe.operators import mixed_logistic as ML
from cytoframe.operators import raster as R
from cytoframe.operators import summaries as S
from cytoframe.operators import tracks as T
from cytoframe.operators import walk_model as W
from cytoframe.plans import censoring as PC
from cytoframe.plans import motility as M
from cytoframe.sources import adapters as A

COND = ["ploidy", "dose"]
SEGMENT = ["site_id", "track_id", "run_index"]


def expected_msd(spark, sf_dir):
    """Model displacement by step for the tau and scale that a condition's medians suggest."""
    steps = S.global_quantiles(M._steps(spark, sf_dir), "step_distance", {"median": 0.5}, COND).select(*COND, (F.col("median") / F.sqrt(F.lit(2.0))).alias("v"))
    grid = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumns({"tau": F.lit(3.0), "noise": F.lit(0.5)})
    out = grid.withColumns({"msd": W.expected_msd(F.col("step"), F.col("tau"), F.col("v"), F.col("noise")), "diffusivity": W.diffusivity(F.col("v"), F.col("tau")), "step_variance": W.position_variance(F.col("step"), F.col("tau"), F.col("v"))})
    return out.select(*COND, "step", *[F.round(c, 4).alias(c) for c in ("msd", "diffusivity", "step_variance")])


def walk_segments(spark, sf_dir):
    rows = W.segments(M._runs(spark, sf_dir), COND, SEGMENT)
    return rows.select(*COND, *SEGMENT, F.size("frames").alias("n"), F.get("frames", F.lit(0)).alias("first"), F.round(F.aggregate("xs", F.lit(0.0), lambda a, b: a + b), 4).alias("sum_x")).withColumn("run_index", F.col("run_index").cast("long"))


def walk_fits(spark, sf_dir):
    """Best of 25 starts for each condition, over all of its segments."""
    fitted = durable(W.fits(M._runs(spark, sf_dir).select(*COND, *SEGMENT, "frame", "x", "y"), COND, SEGMENT, n_starts=25))
    return W.best_fits(fitted, COND)


def simulated_msd(spark, sf_dir):
    """Origin displacements by step of tracks simulated to the observed lengths."""
    lengths = A.tracks(spark, sf_dir).groupBy("track_id").agg(F.count("*").cast("int").alias("n_frames"))
    sim = W.simulate(lengths.withColumns({"tau": F.lit(4.0), "velocity_scale": F.lit(3.0), "obs_noise": F.lit(0.5)}))
    return S.mean_se(T.origin_displacement(sim, ["track_id"], 10), ["track_step"], "squared_displacement")


def box_check(spark, sf_dir):
    """Simulated tracks started in a box: how many points leave it, how many discs overlap, and what is left in runs."""
    lengths = A.tracks(spark, sf_dir).groupBy("track_id").agg(F.count("*").cast("int").alias("n_frames"))
    sim = W.simulate(lengths.withColumns({"tau": F.lit(4.0), "velocity_scale": F.lit(3.0), "obs_noise": F.lit(0.5)}))
    moved = {"x": F.col("x") + S.unit_hash(F.col("track_id"), 3) * 512, "y": F.col("y") + S.unit_hash(F.col("track_id"), 4) * 512}
    placed = durable(sim.withColumns(moved).withColumn("box", F.col("track_id") % 16))
    near = R.near_pairs(placed, 16.0, ["box", "frame"], "track_id")
    hit = near.select("box", "frame", F.col("ident_a").alias("track_id")).unionByName(near.select("box", "frame", F.col("ident_b").alias("track_id"))).distinct().withColumn("overlaps", F.lit(True))
    flagged = placed.withColumn("leaves", C.leaves_box(8.0, 512.0, 512.0)).join(hit, ["box", "frame", "track_id"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))
    kept = T.runs(flagged.where("NOT leaves AND NOT overlaps"), ["box", "track_id"], min_frames=3)
    counts = flagged.groupBy("box").agg(F.count("*").alias("n"), F.count_if("leaves").alias("n_leaving"), F.count_if("overlaps").alias("n_overlapping"))
    return counts.join(kept.groupBy("box").agg(F.count("*").alias("n_kept")), "box", "left")


#: Terms of the two dropout models, of standardised covariates; the full one adds the condition and its interactions.
CONTEXT = ("z_speed", "z_edge", "z_near", "z_frame")
FULL = (*CONTEXT, "ploidy", "z_dose", "z_speed:ploidy", "z_speed:z_dose", "ploidy:z_dose")


def at_risk_covariates(spark, sf_dir):
    """Detections with a later one in their track; it ends a track where it is an error. Site, condition, and covariates by their mean and deviation."""
    w = Window.partitionBy("site_id", "track_id").orderBy("frame")
    step = T.distance(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    raw = {"speed": F.coalesce(step, F.lit(0.0)), "edge": C.edge_distance(560.0, 100.0), "near": F.abs(F.lead("frame").over(w) - F.col("frame") - 1).cast("double"), "frame": F.col("frame").cast("double"), "dose": F.log10(F.col("dose") + 1)}
    rows = A.tracks(spark, sf_dir).withColumn("ended", (F.lead("event_type").over(w) == "error").cast("int"))
    rows = rows.select("site_id", "ploidy", "ended", *[c.alias(n) for n, c in raw.items()]).where("ended IS NOT NULL")
    return durable(S.standardised(rows, ["speed", "edge", "near", "frame", "dose"]))


def dropout_model(spark, sf_dir):
    """Coefficients of the full dropout model with a random intercept per site, their errors and the intercepts' variance."""
    got = ML.fit(at_risk_covariates(spark, sf_dir), "ended", FULL, "site_id")
    rows = [(n, float(b), float(e)) for n, b, e in zip(got.names, got.coefficients, got.errors)] + [("(group variance)", got.variance, None)]
    return spark.createDataFrame([(*r, got.converged) for r in rows], "term string, estimate double, error double, converged boolean")


def dropout_comparison(spark, sf_dir):
    """The context and the full dropout model, both fitted to all rows: log likelihood, AIC, distance to the best, gain, convergence."""
    rows = at_risk_covariates(spark, sf_dir)
    return ML.comparison(spark, {name: ML.fit(rows, "ended", terms, "site_id") for name, terms in (("context", CONTEXT), ("full", FULL))})


def dropout_scores(spark, sf_dir):
    """Scores of a fixed model by condition; group intercepts don't enter."""
    rows = A.tracks(spark, sf_dir).withColumn("p", W.score_logistic({"(intercept)": -3.0, "frame": 0.05, "x": 0.002}))
    return rows.groupBy(*COND).agg(F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.max("p"), 6).alias("max_p"))


def model_comparison(spark, sf_dir):
    """Two fixed models against the outcome: log likelihood, AIC and the distance to the best."""
    rows = PC._predicted(spark, sf_dir)

    def part(name, p, df):
        ll = F.sum(F.col("ended") * F.log(p) + (1 - F.col("ended")) * F.log(1 - F.col(p)))
        return rows.agg(F.lit(name).alias("model"), F.lit(df).alias("df"), ll.alias("log_likelihood"))

    both = part("frame", "p0", 2).unionByName(part("frame_and_x", "p", 3)).withColumn("aic", 2 * F.col("df") - 2 * F.col("log_likelihood"))
    every = Window.partitionBy()
    return both.select("model", "df", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("aic", 3).alias("aic"), F.round(F.col("aic") - F.min("aic").over(every), 3).alias("delta_aic"))


def object_tracks(spark, sf_dir):
    """Objects linked over frames by place and size, per column of tiles."""
    rows = R.objects(A.pixels(spark, sf_dir)).withColumns({"log_area": F.log("area"), "log_diameter": F.log(F.sqrt(4 * F.col("area") / math.pi))})
    sized = G.unit_scaled(rows, ["log_area", "log_diameter"], 0.01, 0.99)
    centres = sized.select("frame", "label", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"), F.floor(F.col("centroid_x") / 16).alias("band"), "u_log_area", "u_log_diameter")
    return L.track_objects(centres, ["band"], mode="motion-visual", features=["u_log_area", "u_log_diameter"])


QUERIES = {f.__name__: f for f in (expected_msd, walk_segments, walk_fits, simulated_msd, box_check, dropout_model, dropout_comparison, dropout_scores, model_comparison, object_tracks)}

ORACLE_SQL = {
    "expected_msd": A.sql(M.STEPS_SQL, """, v AS (SELECT ploidy, dose, quantile_cont(step_distance, 0.5) / sqrt(2.0) AS v FROM steps GROUP BY ALL), g AS (SELECT *, CAST(unnest(range(1, 11)) AS INTEGER) AS step FROM v)
        SELECT ploidy, dose, step, round(4 * v * v * 9 * (step / 3.0 - 1 + exp(-step / 3.0)) + 4 * 0.25, 4) AS msd, round(v * v * 3, 4) AS diffusivity, round(2 * v * v * 9 * (step / 3.0 - 2 * (1 - exp(-step / 3.0)) + 0.5 * (1 - exp(-2 * step / 3.0))), 4) AS step_variance FROM g"""),
    "walk_segments": A.sql(M.RUNS_SQL, "SELECT ploidy, dose, site_id, track_id, run_index, CAST(count(*) AS INTEGER) AS n, min(frame) AS first, round(sum(x), 4) AS sum_x FROM runs GROUP BY ALL"),
    "dropout_scores": A.sql(A.TRACKS_SQL, "SELECT ploidy, dose, round(avg(1 / (1 + exp(-(-3.0 + 0.05 * frame + 0.002 * x)))), 6) AS mean_p, round(max(1 / (1 + exp(-(-3.0 + 0.05 * frame + 0.002 * x)))), 6) AS max_p FROM tracks GROUP BY ALL"),
    "model_comparison": A.sql(PC._PREDICTED_SQL, """, m AS (SELECT 'frame' AS model, 2 AS df, sum(ended * ln(p0) + (1 - ended) * ln(1 - p0)) AS ll FROM pred UNION ALL SELECT 'frame_and_x', 3, sum(ended * ln(p) + (1 - ended) * ln(1 - p)) FROM pred)
        SELECT model, df, round(ll, 3) AS log_likelihood, round(2 * df - 2 * ll, 3) AS aic, round(2 * df - 2 * ll - min(2 * df - 2 * ll) OVER (), 3) AS delta_aic FROM m"""),
}
