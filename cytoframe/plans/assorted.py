"""Registered queries of sampling, ordering, plate and shape operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoframe.operators import imaging as G
from cytoframe.operators import inventory as I
from cytoframe.operators import raster as R
from cytoframe.operators import summaries as S
from cytoframe.operators import tracks as T
from cytoframe.operators import walk_model as W
from cytoframe.plans import inventory as PI
from cytoframe.plans import motility as M
from cytoframe.sources import adapters as A
from cytoframe.sources import tables

COND = ["ploidy", "dose"]


def plate_layout(spark, sf_dir):
    """The wells of the default plate with the tracks and detections of their condition; control wells have none."""
    found = A.trackpoints(spark, sf_dir).groupBy(*COND).agg(F.count_distinct("track_id").alias("n_tracks"), F.count("*").alias("n_detections"))
    return tables.plate_layout(spark).join(found, COND, "left").select("plate_row", "plate_col", "well", *COND, "condition_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tracks", "n_detections")])


def condition_jobs(spark, sf_dir):
    """One numbered job for each condition that tracks have, with its id and label."""
    out = tables.fit_manifest(A.tracks(spark, sf_dir), {"n_starts": 25})
    return out.select("job_id", *COND, "n_starts", tables.condition_id().alias("condition_id"), tables.dose_label().alias("dose_label"))


def evenly_spaced_frames(spark, sf_dir):
    return S.evenly_spaced(A.tracks(spark, sf_dir), ["track_id"], ["frame"], 5).select("track_id", "frame")


def custom_order(spark, sf_dir):
    """Kinds of events in a listed order, unlisted ones last by name, numbered."""
    from pyspark.sql import Window

    kinds = A.trackpoints(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    w = Window.orderBy(*S.listed_order("event_type", ("purchase", "click")))  # a row per kind
    return kinds.select("event_type", "n", F.row_number().over(w).alias("place"))


def root_suffixes(spark, sf_dir):
    """Directories under the root of their tracking experiment, by the path below it."""
    rows = A.inventory(spark, sf_dir).select("path").distinct().withColumn("root", I.tracking_root())
    return rows.select("path", "root", I.below_root().alias("suffix"), I.safe_id(F.col("path")).alias("safe"))


def candidate_table(spark, sf_dir):
    return I.candidate_rows(I.scored(A.inventory(spark, sf_dir)), "z_score").where("score >= 4")


def object_shapes(spark, sf_dir):
    out = R.shapes(A.pixels(spark, sf_dir))
    return out.select("frame", "label", "area", "perimeter", *[F.round(c, 4).alias(c) for c in ("major_axis", "minor_axis", "eccentricity", "circularity")])


def external_scaling(spark, sf_dir):
    """Tracks scaled by centres and scales of the even tracks alone."""
    rows = A.tracks(spark, sf_dir)
    scaler = S.scaler_of(rows.where("track_id % 2 = 0"), ["frame", "x"])
    return S.scaled_with(rows, scaler, ["frame", "x"]).groupBy(*COND).agg(F.round(F.avg("z_frame"), 6).alias("z_frame"), F.round(F.avg("z_x"), 6).alias("z_x"))


def object_intensity(spark, sf_dir):
    """Pixels kept by Otsu within each quadrant of each image, by how far they are from its mean."""
    px = A.images(spark, sf_dir)
    labels = px.select("image_id", "y", "x", F.expr("CAST(y DIV 4 * 2 + x DIV 4 AS INT)").alias("label"))
    return G.within_objects(px, labels).groupBy("image_id", "label").agg(F.count_if("kept").alias("n_kept"), F.round(F.avg("abs_zscore"), 4).alias("mean_abs_z"))


def parameter_levels(spark, sf_dir):
    """Low and high step scales over conditions, and the model displacement after five steps of each pair with a time constant."""
    v = S.global_quantiles(M._steps(spark, sf_dir), "step_distance", {"median": 0.5}, COND).select(*COND, (F.col("median") / F.sqrt(F.lit(2.0))).alias("v"))
    q = v.agg(F.percentile("v", F.lit(0.1)).alias("low"), F.percentile("v", F.lit(0.9)).alias("high")).unpivot([], ["low", "high"], "level", "v")
    grid = q.crossJoin(spark.createDataFrame([("short", 2.0), ("long", 8.0)], "persistence string, tau double"))  # 2 x 2
    return grid.select("level", "persistence", F.round("v", 4).alias("v"), F.round(W.expected_msd(F.lit(5.0), F.col("tau"), F.col("v"), F.lit(0.0)), 3).alias("msd"))


def grid_simulation(spark, sf_dir):
    """Displacements of tracks simulated to the observed lengths on a 2 x 2 grid of parameters."""
    lengths = A.tracks(spark, sf_dir).groupBy("track_id").agg(F.count("*").cast("int").alias("n_frames"))
    grid = lengths.select("track_id", "n_frames", F.when(F.floor(F.col("track_id") / 4) % 2 == 0, 2.0).otherwise(8.0).alias("tau"), F.when(F.col("track_id") % 4 < 2, 1.0).otherwise(3.0).alias("velocity_scale"), F.lit(0.2).alias("obs_noise"))
    rows = T.origin_displacement(W.simulate(grid), ["track_id"], 10).join(grid, "track_id")
    return S.mean_se(rows, ["tau", "velocity_scale", "track_step"], "squared_displacement")


QUERIES = {f.__name__: f for f in (plate_layout, condition_jobs, evenly_spaced_frames, custom_order, root_suffixes, candidate_table, object_shapes, external_scaling, object_intensity, parameter_levels, grid_simulation)}

_LABEL = "regexp_replace(printf('%.6f', dose), '\\.?0+$', '')"
_EDGE = A.PIXELS_SQL + """,
reach AS (SELECT frame, label, y + dy AS y, x + dx AS x FROM pixels, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)),
filled AS (SELECT frame, label, y, x FROM reach GROUP BY ALL HAVING count(*) = 4),
per AS (SELECT frame, label, count(*) AS perimeter FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.frame = p.frame AND f.label = p.label AND f.y = p.y AND f.x = p.x) GROUP BY ALL)"""

ORACLE_SQL = {
    "plate_layout": f"""WITH g AS (SELECT chr(CAST(65 + r AS INTEGER)) AS plate_row, CAST(c AS INTEGER) AS plate_col, r FROM range(8) a(r), range(1, 13) b(c)),
        d AS (SELECT *, plate_row || plate_col AS well, CASE WHEN plate_col IN (1, 12) THEN NULL WHEN r < 4 THEN '2N' ELSE '4N' END AS ploidy, CASE WHEN plate_col BETWEEN 2 AND 11 THEN list_extract([{", ".join(map(str, A.DOSES))}]::DOUBLE[], plate_col - 1) END AS dose FROM g)
        , n AS (SELECT CASE WHEN user_id % 2 = 0 THEN '2N' ELSE '4N' END AS ploidy, list_extract([{", ".join(map(str, A.DOSES))}]::DOUBLE[], CAST(user_id % 10 + 1 AS INTEGER)) AS dose, count(DISTINCT user_id) AS n_tracks, count(*) AS n_detections FROM events GROUP BY ALL)
        SELECT plate_row, plate_col, well, ploidy, dose, CASE WHEN ploidy IS NOT NULL THEN ploidy || '_gem_' || replace({_LABEL}, '.', 'p') || 'nM' END AS condition_id, coalesce(n_tracks, 0) AS n_tracks, coalesce(n_detections, 0) AS n_detections FROM d LEFT JOIN n USING (ploidy, dose)""",
    "condition_jobs": A.sql(A.TRACKS_SQL, f"SELECT CAST(row_number() OVER (ORDER BY ploidy, dose) AS INTEGER) AS job_id, ploidy, dose, 25 AS n_starts, ploidy || '_gem_' || replace({_LABEL}, '.', 'p') || 'nM' AS condition_id, {_LABEL} || ' nM' AS dose_label FROM (SELECT DISTINCT ploidy, dose FROM tracks)"),
    "evenly_spaced_frames": A.sql(A.TRACKS_SQL, "SELECT track_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM tracks) WHERE n <= 5 OR list_contains([k * (n - 1) // 4 for k in range(5)], r)"),
    "custom_order": "SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type) AS INTEGER) AS place FROM events GROUP BY event_type",
    "root_suffixes": A.sql(A.INVENTORY_SQL, """, r AS (SELECT DISTINCT path, CASE WHEN path LIKE '/share/Migration_assay/%' THEN '/share/Migration_assay' WHEN path LIKE '/share/tracking/%' THEN '/share/tracking' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS root FROM inventory)
        SELECT path, root, substr(path, length(root) + 2) AS suffix, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM r"""),
    "object_shapes": A.sql(_EDGE, """, m AS (SELECT frame, label, count(*) AS area, (var_pop(y) + var_pop(x)) / 2 AS mid, sqrt(power((var_pop(y) - var_pop(x)) / 2, 2) + power(covar_pop(y, x), 2)) AS half FROM pixels GROUP BY ALL)
        SELECT frame, label, area, perimeter, round(4 * sqrt(mid + half), 4) AS major_axis, round(4 * sqrt(greatest(mid - half, 0)), 4) AS minor_axis, round(CASE WHEN mid + half > 0 THEN sqrt(greatest(1 - greatest(mid - half, 0) / (mid + half), 0)) ELSE 0 END, 4) AS eccentricity, round(least(4 * pi() * area / (perimeter * perimeter), 1), 4) AS circularity FROM m JOIN per USING (frame, label)"""),
    "external_scaling": A.sql(A.TRACKS_SQL, ", k AS (SELECT avg(frame) AS mf, stddev_samp(frame) AS sf, avg(x) AS mx, stddev_samp(x) AS sx FROM tracks WHERE track_id % 2 = 0) SELECT ploidy, dose, round(avg((frame - mf) / sf), 6) AS z_frame, round(avg((x - mx) / sx), 6) AS z_x FROM tracks, k GROUP BY ploidy, dose"),
    "parameter_levels": A.sql(M.STEPS_SQL, """, v AS (SELECT quantile_cont(step_distance, 0.5) / sqrt(2.0) AS v FROM steps GROUP BY ploidy, dose), q AS (SELECT 'low' AS level, quantile_cont(v, 0.1) AS v FROM v UNION ALL SELECT 'high', quantile_cont(v, 0.9) FROM v)
        SELECT level, persistence, round(v, 4) AS v, round(4 * v * v * tau * tau * (5 / tau - 1 + exp(-5 / tau)), 3) AS msd FROM q, (VALUES ('short', 2.0), ('long', 8.0)) t(persistence, tau)"""),
    "object_intensity": A.sql(A.IMAGES_SQL, """, o AS (SELECT image_id, CAST(y // 4 * 2 + x // 4 AS INTEGER) AS label, v FROM images),
        z AS (SELECT image_id, label, abs((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6)) AS z FROM o WINDOW w AS (PARTITION BY image_id, label)),
        e AS (SELECT image_id, label, min(z) AS a, max(z) AS b FROM z GROUP BY ALL),
        h AS (SELECT image_id, label, CAST(least(floor((z - a) / ((b - a) / 256)), 255) AS BIGINT) AS k, count(*) AS n FROM z JOIN e USING (image_id, label) WHERE b > a GROUP BY ALL),
        r AS (SELECT g.image_id, g.label, g.k, coalesce(n, 0) AS n, a + (g.k + 0.5) * ((b - a) / 256) AS c FROM (SELECT image_id, label, a, b, unnest(range(256)) AS k FROM e WHERE b > a) g LEFT JOIN h ON h.image_id = g.image_id AND h.label = g.label AND h.k = g.k),
        s AS (SELECT *, sum(n) OVER u AS w1, sum(n) OVER d AS w2, sum(n * c) OVER u AS s1, sum(n * c) OVER d AS s2 FROM r WINDOW u AS (PARTITION BY image_id, label ORDER BY k ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY image_id, label ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        t AS (SELECT image_id, label, arg_max(c, (w1 * w2 * power(s1 / greatest(w1, 1) - s2 / greatest(w2, 1), 2), -k)) AS threshold FROM s WHERE k < 255 AND n > 0 GROUP BY ALL UNION ALL SELECT image_id, label, a FROM e WHERE b <= a)
        SELECT image_id, label, count(*) FILTER (z >= threshold) AS n_kept, round(avg(z), 4) AS mean_abs_z FROM z JOIN t USING (image_id, label) GROUP BY ALL"""),
    "candidate_table": A.sql(PI.SCORED_SQL, """, few AS (SELECT path, list(DISTINCT name ORDER BY name) FILTER (z IS NOT NULL) AS zn, list(DISTINCT name ORDER BY name) FILTER (img) AS im,
          list_sort(list_distinct(list_concat(coalesce(list(t) FILTER (t IS NOT NULL), []), coalesce(list(elapsed::VARCHAR) FILTER (elapsed IS NOT NULL), []), coalesce(list(strftime(acquired, '%Y-%m-%d %H:%M')) FILTER (acquired IS NOT NULL), [])))) AS ts FROM pr GROUP BY path)
        SELECT z_score AS score, path, '' AS status, origin AS raw_or_derived, NULL::BIGINT AS Nentries, NULL::BIGINT AS Nfiles, n_images AS image_like_count, n_images AS sample_image_count,
          0 AS stack_tiff_count_sampled, '' AS stack_tiff_kind, '' AS stack_tiff_ome_sizes, '' AS stack_tiff_pages, '' AS stack_tiff_shapes, n_z AS distinct_z, n_planes AS distinct_planes, n_timepoints AS distinct_timepoints,
          least AS min_time_spacing_minutes, upper_median AS median_time_spacing_minutes, unit AS time_spacing_unit, n_wells AS distinct_wells, n_fields AS distinct_fields_or_sites, coalesce(channel_text, '') AS channels, n_channels AS distinct_channels, CAST(n_channels >= 2 AS INTEGER) AS has_multiple_channels,
          coalesce(coverage, '') AS channel_z_or_plane_coverage, cell_lines AS cell_line_hits, '' AS tracking_focus_score, '' AS tracking_focus_best_match, '' AS tracking_focus_matches, array_to_string(parts[greatest(len(parts) - 4, 1):], ' / ') AS path_context,
          array_to_string(list_concat(zs[1:12], CASE WHEN len(zs) > 12 THEN ['...(+' || (len(zs) - 12) || ')'] ELSE [] END), '; ') AS z_values, array_to_string(list_concat(ts[1:12], CASE WHEN len(ts) > 12 THEN ['...(+' || (len(ts) - 12) || ')'] ELSE [] END), '; ') AS time_values,
          '' AS stack_tiff_examples, '' AS stack_tiff_errors, array_to_string(CASE WHEN len(zn) > 0 THEN zn ELSE coalesce(im, []) END[1:8], '; ') AS examples
        FROM scd LEFT JOIN chs USING (path) JOIN few USING (path) WHERE z_score >= 4"""),
}
