"""Registered inventory queries over derived file names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoframe.operators import inventory as I
from cytoframe.sources import adapters as A


def _names(spark, sf_dir):
    return A.inventory(spark, sf_dir)


def name_profiles(spark, sf_dir):
    """What each directory's names say, as counts and rendered lists."""
    rows = I.profiles(_names(spark, sf_dir))
    counts = {"n_z": "z_values", "n_planes": "planes", "n_wells": "wells", "n_fields": "fields", "n_channels": "channels"}
    return rows.select("path", "n_names", "n_images", *[F.size(c).alias(n) for n, c in counts.items()], "n_timepoints", I.compact(F.col("z_values"), 3).alias("z_text"), I.compact(F.col("elapsed_minutes")).alias("elapsed_text"), I.coverage_text().alias("coverage"))


def time_spacings(spark, sf_dir):
    rows = I.profiles(_names(spark, sf_dir)).withColumn("s", I.time_spacing())
    return rows.select("path", F.col("s.least").alias("least"), F.col("s.upper_median").alias("upper_median"), F.col("s.unit").alias("unit"))


def directory_scores(spark, sf_dir):
    rows = I.scored(_names(spark, sf_dir))
    return rows.select("path", "origin", F.array_join("cell_lines", "; ").alias("cell_lines"), F.array_join("context", " / ").alias("context"), "z_score", "tracking_score").where("z_score >= 4 OR tracking_score >= 4")


def tracking_experiments(spark, sf_dir):
    rows = I.tracking_groups(I.scored(_names(spark, sf_dir)))
    return rows.select("root", "n_dirs", "n_images", "least_spacing", "best_median_spacing", "n_timepoints", "group_score", "best_dir", F.array_join("modalities", "; ").alias("modalities"), F.size("examples").alias("n_examples"))


def volume_experiments(spark, sf_dir):
    rows = I.volume_groups(I.scored(_names(spark, sf_dir)))
    return rows.select("root", "n_dirs", "n_images", "best_score", "n_z", "n_planes", "most_channels", "n_multi_channel", F.array_join("channels", "; ").alias("channels"), "group_score", "best_dir")


def focused_directories(spark, sf_dir):
    """Directories whose path holds a focus term or a token close to one."""
    rows = I.focus_matches(_names(spark, sf_dir).select("path").distinct())
    return rows.where(F.size("focus") > 0).select("path", F.array_join(F.transform("focus", lambda m: F.concat_ws(":", m["term"], m["token"])), "; ").alias("focus"), F.round(F.array_max(F.transform("focus", lambda m: m["ratio"])), 2).alias("ratio"))


def extension_counts(spark, sf_dir):
    """Names by extension of each directory, as one sorted text, and the image-like count of the map."""
    rows = _names(spark, sf_dir).withColumn("e", F.coalesce(I.extension(), F.lit("[no extension]"))).groupBy("path", "e").agg(F.count("*").alias("n"))
    maps = rows.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "n")))).alias("m"))
    maps = maps.withColumn("none", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    return maps.select("path", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), "; ").alias("extensions"), I.map_count("m", "none").alias("n_images"))


def stack_fields(spark, sf_dir):
    return I.stack_fields(_names(spark, sf_dir))


def tracking_qc(spark, sf_dir):
    """Quality of detections as text tables, one a site, with marks that no integer and missing values."""
    e = A.trackpoints(spark, sf_dir)
    text = e.select(
        "site_id",
        F.when(F.col("event_id") % 50 == 0, "").when(F.col("event_id") % 51 == 0, "nan").otherwise(F.col("frame").cast("string")).alias("frame"),
        F.when(F.col("event_id") % 40 == 0, "-1").otherwise(F.col("track_id").cast("string")).alias("track"),
        F.when(F.col("event_id") % 9 == 0, "").otherwise((F.col("track_id") % 30).cast("string")).alias("lineage"),
        (F.col("event_id") % 4 - 1).cast("string").alias("parent"),
        (F.col("event_id") % 6).cast("string").alias("merger"),
    )
    out = I.tracking_qc(text, ["site_id"], columns=("frame", "lineage"))
    return out.withColumns({c: F.round(c, 6) for c in ("median_length", "median_objects")})


def ranked_directories(spark, sf_dir):
    """Directories by images, the most first, then by path: the twenty first."""
    rows = I.profiles(_names(spark, sf_dir)).where("n_images >= 2")
    return rows.orderBy(F.col("n_images").desc(), F.col("path").asc_nulls_last()).limit(20).select("path", "n_images")


QUERIES = {f.__name__: f for f in (name_profiles, time_spacings, directory_scores, tracking_experiments, volume_experiments, focused_directories, extension_counts, stack_fields, tracking_qc, ranked_directories)}

# DuckDB's patterns know no lookarounds, so marks around a token are matched with it.
_A = r"(^|[^A-Za-z0-9])"
_B = r"([^A-Za-z0-9]|$)"


def _x(pattern: str, k: int, flags: str = "i") -> str:
    return f"nullif(regexp_extract(name, '{pattern}', {k}, '{flags}'), '')"


PARSED_SQL = A.INVENTORY_SQL + f""",
parsed AS (SELECT *, lower(nullif(regexp_extract(name, '^.+(\\.[^./]+)$', 1), '')) AS ext, {_x(_A + "z([0-9]{1,4})" + _B, 2)} AS z, {_x(_A + "t([0-9]{1,5})" + _B, 2)} AS t,
  CAST({_x("([0-9]{1,3})d([0-9]{1,2})h([0-9]{1,2})m", 1)} AS INTEGER) * 1440 + CAST({_x("([0-9]{1,3})d([0-9]{1,2})h([0-9]{1,2})m", 2)} AS INTEGER) * 60 + CAST({_x("([0-9]{1,3})d([0-9]{1,2})h([0-9]{1,2})m", 3)} AS INTEGER) AS elapsed,
  try_strptime({_x("([0-9]{4}y[0-9]{1,2}m[0-9]{1,2}d_[0-9]{1,2}h[0-9]{1,2}m)", 1)}, '%Yy%mm%dd_%Hh%Mm') AS acquired,
  {_x("r([0-9]{1,2})c([0-9]{1,2})f([0-9]{1,3})p([0-9]{1,4})", 4)} AS plane, {_x("r([0-9]{1,2})c([0-9]{1,2})f([0-9]{1,3})p([0-9]{1,4})", 3)} AS rfield, {_x("r[0-9]{1,2}c[0-9]{1,2}f[0-9]{1,3}p[0-9]{1,4}-ch([0-9]{1,2})", 1)} AS rch,
  upper({_x(_A + "([A-H][0-9]{1,2})_([0-9]{1,3})" + _B, 2, "c")}) AS well, {_x(_A + "([A-H][0-9]{1,2})_([0-9]{1,3})" + _B, 3, "c")} AS site, {_x(_A + "ch([0-9]{1,2})" + _B, 2)} AS ch FROM inventory),
pr AS (SELECT *, coalesce(ext IN ('.bmp', '.czi', '.gif', '.jpg', '.jpeg', '.lif', '.png', '.svs', '.tif', '.tiff'), false) AS img, CAST(epoch(acquired) // 60 AS BIGINT) AS minute FROM parsed),
vals AS (SELECT path, 'c' AS k, ch AS v FROM pr WHERE ch IS NOT NULL UNION SELECT path, 'c', rch FROM pr WHERE rch IS NOT NULL UNION SELECT path, 'f', rfield FROM pr WHERE rfield IS NOT NULL UNION SELECT path, 'f', site FROM pr WHERE site IS NOT NULL),
ch AS (SELECT path, v AS c, (SELECT count(DISTINCT z) FROM pr p WHERE p.path = vals.path AND p.ch = v) AS nz, (SELECT count(DISTINCT plane) FROM pr p WHERE p.path = vals.path AND p.rch = v) AS np FROM vals WHERE k = 'c'),
chs AS (SELECT path, string_agg(c || ':' || CASE WHEN nz > 0 AND np > 0 THEN 'z' || nz || '/p' || np WHEN nz > 0 THEN 'z' || nz WHEN np > 0 THEN 'p' || np ELSE 'unquantified' END, '; ' ORDER BY c) AS coverage, string_agg(c, '; ' ORDER BY c) AS channel_text FROM ch GROUP BY path),
nv AS (SELECT path, count(*) FILTER (k = 'f') AS n_fields, count(*) FILTER (k = 'c') AS n_channels FROM vals GROUP BY path),
pf AS (SELECT path, count(*) AS n_names, count(*) FILTER (img) AS n_images, count(DISTINCT z) AS n_z, count(DISTINCT plane) AS n_planes, count(DISTINCT well) AS n_wells, coalesce(any_value(n_fields), 0) AS n_fields, coalesce(any_value(n_channels), 0) AS n_channels,
  count(DISTINCT t) + count(DISTINCT elapsed) + count(DISTINCT acquired) AS n_timepoints, list_sort(list_distinct(list(z))) AS zs, list_sort(list_distinct(list(elapsed))) AS es, list_sort(list_distinct(list(minute))) AS ms,
  string_agg(name, ' ' ORDER BY name) FILTER (img) AS names FROM pr LEFT JOIN nv USING (path) GROUP BY path),
sp AS (SELECT *, CASE WHEN len(es) >= 2 THEN 'elapsed_minutes' WHEN len(ms) >= 2 THEN 'absolute_minutes' END AS unit, CASE WHEN len(es) >= 2 THEN es::BIGINT[] WHEN len(ms) >= 2 THEN ms END AS vs FROM pf),
spc AS (SELECT * EXCLUDE (vs), gaps[1] AS least, gaps[len(gaps) // 2 + 1] AS upper_median FROM (SELECT *, list_sort([vs[i + 1] - vs[i] for i in range(1, len(vs))]) AS gaps FROM sp))"""
SCORED_SQL = PARSED_SQL + """,
st AS (SELECT *, [trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') for x in regexp_split_to_array(path || ' ' || coalesce(names, ''), '[/\\s;]+')] AS toks, CASE WHEN path LIKE '%SNU-668%' THEN 'SNU-668' ELSE '' END AS cell_lines,
  [x for x in string_split(path, '/') if x NOT IN ('', 'share', 'andor_lab')] AS parts FROM spc),
sc AS (SELECT *, CASE WHEN list_has_any(toks, ['bounding_boxes', 'cell_segmentation_results', 'cellpose', 'cp_masks', 'flattened', 'flattenedimages', 'log_transforms', 'masks', 'objectimages', 'processed', 'processed_images', 'results', 'segmentation']) THEN 'derived'
    WHEN list_has_any(toks, ['brightfield', 'fluorescence', 'images', 'phase', 'phasecontrast', 'raw', 'raw_images']) THEN 'raw_hint' ELSE 'unknown' END AS origin FROM st),
scd AS (SELECT *, CASE WHEN n_images > 0 THEN 1 ELSE 0 END + CASE WHEN n_z >= 2 THEN 5 WHEN n_z = 1 THEN 2 ELSE 0 END + CASE WHEN n_planes >= 5 THEN 2 WHEN n_planes >= 2 THEN 1 ELSE 0 END + CASE WHEN n_channels >= 2 THEN 2 WHEN n_channels = 1 THEN 1 ELSE 0 END
    + CASE WHEN n_wells + n_fields > 0 THEN 1 ELSE 0 END + CASE WHEN cell_lines <> '' THEN 1 ELSE 0 END - CASE WHEN origin = 'derived' THEN 3 ELSE 0 END AS z_score,
  CASE WHEN n_images > 0 THEN 1 ELSE 0 END + CASE WHEN n_timepoints >= 5 THEN 5 WHEN n_timepoints >= 2 THEN 3 WHEN n_timepoints = 1 THEN 1 ELSE 0 END + CASE WHEN n_wells >= 2 THEN 2 WHEN n_wells = 1 THEN 1 ELSE 0 END
    + CASE WHEN n_fields >= 2 THEN 1 ELSE 0 END + CASE WHEN n_channels > 0 THEN 1 ELSE 0 END + CASE WHEN cell_lines <> '' THEN 1 ELSE 0 END - CASE WHEN origin = 'derived' THEN 2 ELSE 0 END AS tracking_score FROM sc)"""



def with_names(cte: str, body: str) -> str:
    """A query over scored directories (scd) whose names come from another CTE `inventory` (path, name)."""
    return A.sql(SCORED_SQL.replace(A.INVENTORY_SQL, cte), body)


ORACLE_SQL = {
    "name_profiles": A.sql(PARSED_SQL, """SELECT path, n_names, n_images, n_z, n_planes, n_wells, n_fields, n_channels, n_timepoints,
        array_to_string(list_concat(zs[1:3], CASE WHEN len(zs) > 3 THEN ['...(+' || (len(zs) - 3) || ')'] ELSE [] END), '; ') AS z_text, array_to_string(list_concat(es[1:12]::VARCHAR[], CASE WHEN len(es) > 12 THEN ['...(+' || (len(es) - 12) || ')'] ELSE [] END), '; ') AS elapsed_text, coalesce(coverage, '') AS coverage FROM pf LEFT JOIN chs USING (path)"""),
    "time_spacings": A.sql(PARSED_SQL, "SELECT path, least, upper_median, unit FROM spc"),
    "directory_scores": A.sql(SCORED_SQL, "SELECT path, origin, cell_lines, array_to_string(parts[greatest(len(parts) - 4, 1):], ' / ') AS context, z_score, tracking_score FROM scd WHERE z_score >= 4 OR tracking_score >= 4"),
    "tracking_experiments": A.sql(SCORED_SQL, """, ro AS (SELECT *, CASE WHEN path LIKE '/share/Migration_assay/%' THEN '/share/Migration_assay' WHEN path LIKE '/share/tracking/%' THEN '/share/tracking' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS root,
        [x for x in parts[greatest(len(parts) - 2, 1):] if regexp_matches(regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'), 'brightfield|dead|fluorescence|green|live|phase|red')] AS mods FROM scd),
        g AS (SELECT root, count(*) AS n_dirs, CAST(sum(n_images) AS BIGINT) AS n_images, min(least) AS least_spacing, min(upper_median) AS best_median_spacing, max(n_timepoints) AS n_timepoints, arg_min(path, (least IS NULL, coalesce(least, 1000000000), -n_timepoints, -n_images, path)) AS best_dir,
          bool_or(len([m for m in mods if regexp_matches(lower(m), 'phase|brightfield')]) > 0) AS ph, list_sort(list_distinct(flatten(list(mods[greatest(len(mods) - 1, 1):])))) AS ml FROM ro GROUP BY root)
        SELECT root, n_dirs, n_images, least_spacing, best_median_spacing, n_timepoints, CAST(CASE WHEN least_spacing IS NULL THEN 0 ELSE greatest(0, 6 - least_spacing // 60) END + least(n_timepoints, 10) + least(n_dirs, 10) + CASE WHEN ph THEN 3 ELSE 0 END AS BIGINT) AS group_score, best_dir, array_to_string(ml, '; ') AS modalities, CAST(least(n_dirs, 5) AS INTEGER) AS n_examples FROM g"""),
    "volume_experiments": A.sql(SCORED_SQL, """, ro AS (SELECT *, CASE WHEN path LIKE '/share/plain/measurement_1/%' THEN '/share/plain/measurement_1' ELSE path END AS root FROM scd),
        cl AS (SELECT root, string_agg(DISTINCT c, '; ' ORDER BY c) AS channels, count(DISTINCT c) AS nc FROM ro JOIN ch USING (path) GROUP BY root),
        g AS (SELECT root, count(*) AS n_dirs, CAST(sum(n_images) AS BIGINT) AS n_images, max(z_score) AS best_score, max(n_z) AS n_z, max(n_planes) AS n_planes, max(n_channels) AS most_channels, count(*) FILTER (n_channels >= 2) AS n_multi_channel,
          bool_or(origin = 'raw_hint') AS r, bool_or(origin = 'derived') AS d, arg_min(path, (-z_score, -greatest(n_z, n_planes), origin = 'derived', -n_images, path)) AS best_dir FROM ro GROUP BY root)
        SELECT root, n_dirs, n_images, best_score, n_z, n_planes, most_channels, n_multi_channel, coalesce(channels, '') AS channels, CAST(best_score + least(n_dirs, 12) + least(n_z, 10) + least(n_planes, 10) + CASE WHEN r THEN 3 ELSE 0 END - CASE WHEN d THEN 3 ELSE 0 END + CASE WHEN coalesce(nc, 0) >= 2 THEN 2 ELSE 0 END AS BIGINT) AS group_score, best_dir FROM g LEFT JOIN cl USING (root)"""),
    "extension_counts": A.sql(PARSED_SQL, ", e AS (SELECT path, coalesce(ext, '[no extension]') AS e, count(*) AS n, count(*) FILTER (img) AS i FROM pr GROUP BY ALL) SELECT path, string_agg(e || '=' || n, '; ' ORDER BY e) AS extensions, CAST(sum(i) AS BIGINT) AS n_images FROM e GROUP BY path"),
    "stack_fields": A.sql(A.INVENTORY_SQL, """, f AS (SELECT path, regexp_extract(name, '^(.*)_z(\\d+)_ch(\\d+)\\.tif$', 1) AS prefix, CAST(regexp_extract(name, '^(.*)_z(\\d+)_ch(\\d+)\\.tif$', 2) AS INTEGER) AS z, count(DISTINCT regexp_extract(name, '^(.*)_z(\\d+)_ch(\\d+)\\.tif$', 3)) AS n FROM inventory WHERE regexp_matches(name, '_z\\d+_ch0[012]\\.tif$') GROUP BY ALL)
        SELECT path, prefix, count(*) AS n_z, min(z) AS z_min, max(z) AS z_max FROM f WHERE n = 3 GROUP BY ALL"""),
    "tracking_qc": A.sql(A.TRACKPOINTS_SQL, """, t AS (SELECT site_id, CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 51 = 0 THEN 'nan' ELSE frame::VARCHAR END AS frame, CASE WHEN event_id % 40 = 0 THEN '-1' ELSE track_id::VARCHAR END AS track, CASE WHEN event_id % 9 = 0 THEN '' ELSE (track_id % 30)::VARCHAR END AS lineage, (event_id % 4 - 1)::VARCHAR AS parent, (event_id % 6)::VARCHAR AS merger FROM trackpoints),
        u AS (SELECT *, try_cast(frame AS BIGINT) AS f FROM t),
        b AS (SELECT site_id, count(*) AS n_rows, count(DISTINCT f) AS n_frames, min(f) AS min_frame, max(f) AS max_frame, count(DISTINCT nullif(lineage, '')) AS n_lineages, count(DISTINCT (track, parent)) FILTER (parent NOT IN ('', '0', '-1')) AS n_parent_links, count(DISTINCT merger) FILTER (merger NOT IN ('', '0', '-1')) AS n_mergers, count(*) FILTER (frame IN ('', 'nan')) AS missing_frame, count(*) FILTER (lineage = '') AS missing_lineage FROM u GROUP BY site_id),
        l AS (SELECT site_id, count(*) AS n_tracks, round(median(n), 6) AS median_length, max(n) AS max_length, count(*) FILTER (n >= 3) AS n_tracks_3, count(*) FILTER (n >= 5) AS n_tracks_5, count(*) FILTER (n >= 10) AS n_tracks_10, count(*) FILTER (n >= 25) AS n_tracks_25 FROM (SELECT site_id, track, count(DISTINCT f) AS n FROM u WHERE f IS NOT NULL GROUP BY ALL) GROUP BY site_id),
        o AS (SELECT site_id, round(median(n), 6) AS median_objects, min(n) AS min_objects, max(n) AS max_objects FROM (SELECT site_id, f, count(*) AS n FROM u WHERE f IS NOT NULL GROUP BY ALL) GROUP BY site_id)
        SELECT * FROM b JOIN l USING (site_id) JOIN o USING (site_id)"""),
    "ranked_directories": A.sql(PARSED_SQL, "SELECT path, n_images FROM pf WHERE n_images >= 2 ORDER BY n_images DESC, path LIMIT 20"),
}
