"""Motility by condition from a table of detections: lengths of tracks, steps, displacements and turning.

    python -m jobs.motility_report --config jobs/motility_report.json --events PATH --out DIR

Under --out: tracks/ploidy=P/dose=D, the first detection of each track and frame in its run of
consecutive frames; statistics/statistic=S/ploidy=P, one row for each value by dose, lag and window.
Both tables are replaced as wholes, so a run again, also one after a failure, gives the same tables.
"""

from __future__ import annotations

import uuid

from jobs._run import command_line, logger
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions.session import shared_dir
from cytoframe.operators import summaries as S
from cytoframe.operators import tracks as T
from cytoframe.plans import motility as M
from cytoframe.sources import adapters as A

log = logger("motility_report")
#: max_lag: frames between two detections of a pair; min_frames: frames of a run that counts; max_step: steps from a run's start.
DEFAULTS = {"max_lag": 5, "min_frames": 3, "max_step": 10}
COLUMNS = ("statistic", "ploidy", "dose", "lag", "mean", "se", "n")


def report(spark: SparkSession, events: str, out: str, max_lag: int = 5, min_frames: int = 3, max_step: int = 10) -> DataFrame:
    """Writes the tables and returns the statistics; lag is the number of frames or steps, null where there is none."""
    detections = A.detections(spark.read.parquet(events))
    runs = T.runs(A.first_detections(detections), M.TRACK, min_frames=min_frames).select(*M.ALL, "run_index", "run_frames", "frame", "x", "y")
    runs.write.mode("overwrite").partitionBy(*M.COND).parquet(f"{out}/tracks")
    log.info("read %d detections of %s", detections.count(), events)
    kept = spark.read.schema(runs.schema).parquet(f"{out}/tracks")
    log.info("wrote %d detections in runs of %d frames and more to %s/tracks", kept.count(), min_frames, out)

    none = F.lit(None).cast("int")
    steps = T.forward_steps(kept, M.TRACK)
    pairs = T.lag_pairs(kept.select(*M.ALL, "frame", "x", "y"), M.ALL, max_lag)
    turns = T.lag_pairs(steps.select(*M.ALL, "frame", "dx", "dy"), M.ALL, max_lag, ("dx", "dy"))
    origin = T.origin_displacement(kept, [*M.ALL, "run_index"], max_step)
    lengths = kept.groupBy(*M.ALL, "run_index").agg(F.count("*").cast("double").alias("v"))
    squared = F.pow(F.col("x_later") - F.col("x"), 2) + F.pow(F.col("y_later") - F.col("y"), 2)
    rows = {
        "run_frames": lengths.select(*M.COND, none.alias("lag"), "v"),
        "step_distance": steps.select(*M.COND, none.alias("lag"), F.col("step_distance").alias("v")),
        "squared_displacement": pairs.select(*M.COND, "lag", squared.alias("v")),
        "origin_displacement": origin.select(*M.COND, F.col("track_step").cast("int").alias("lag"), F.col("squared_displacement").alias("v")),
        "step_cosine": turns.select(*M.COND, "lag", T.step_cosine().alias("v")),
    }
    every = None
    for name, df in rows.items():
        one = S.mean_se(df, [*M.COND, "lag"], "v").select(F.lit(name).alias("statistic"), *M.COND, "lag", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), "n")
        every = one if every is None else every.unionByName(one)
    every.repartition("statistic", "ploidy").write.mode("overwrite").partitionBy("statistic", "ploidy").parquet(f"{out}/statistics")
    found = spark.read.schema(every.schema).parquet(f"{out}/statistics").select(*COLUMNS)
    log.info("wrote %d rows to %s/statistics", found.count(), out)
    return found


def job2_motility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all events, run twice into one new folder."""
    folder = f"{shared_dir(spark)}/motility-{uuid.uuid4()}"
    for _ in range(2):
        found = report(spark, f"{sf_dir}/events.parquet", folder)
    return found


_MEAN = "ploidy, dose, {lag} AS lag, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS se, count(v) AS n"


def _part(name: str, source: str, lag: str = "CAST(NULL AS INTEGER)") -> str:
    return f"SELECT '{name}' AS statistic, {_MEAN.format(lag=lag)} FROM ({source}) GROUP BY ALL"


SQL = A.sql(M.STEPS_SQL, ", " + """pairs AS (SELECT a.ploidy, a.dose, CAST(b.frame - a.frame AS INTEGER) AS k, power(b.x - a.x, 2) + power(b.y - a.y, 2) AS v
  FROM runs a JOIN runs b ON a.site_id = b.site_id AND a.track_id = b.track_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 5),
turns AS (SELECT a.ploidy, a.dose, CAST(b.frame - a.frame AS INTEGER) AS k, (a.dx * b.dx + a.dy * b.dy) / greatest(a.step_distance * b.step_distance, 1e-9) AS v
  FROM steps a JOIN steps b ON a.site_id = b.site_id AND a.track_id = b.track_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 5),
origin AS (SELECT ploidy, dose, CAST(row_number() OVER w - 1 AS INTEGER) AS k, power(x - first_value(x) OVER w, 2) + power(y - first_value(y) OVER w, 2) AS v FROM runs WINDOW w AS (PARTITION BY site_id, track_id, run_index ORDER BY frame))
""" + " UNION ALL ".join([
    _part("run_frames", "SELECT ploidy, dose, count(*) AS v FROM runs GROUP BY ploidy, dose, site_id, track_id, run_index"), _part("step_distance", "SELECT ploidy, dose, step_distance AS v FROM steps"),
    _part("squared_displacement", "SELECT * FROM pairs", "k"), _part("origin_displacement", "SELECT * FROM origin WHERE k <= 10", "k"), _part("step_cosine", "SELECT * FROM turns", "k"),
]))

if __name__ == "__main__":
    command_line(__doc__, ("events", "out"), DEFAULTS, report)
