"""Registered raster queries over labelled pixels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoframe.functions.session import durable
from cytoframe.operators import imaging as G
from cytoframe.operators import raster as R
from cytoframe.operators.summaries import global_quantiles
from cytoframe.sources import adapters as A


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def object_table(spark, sf_dir):
    return _rounded(R.objects(A.pixels(spark, sf_dir)), "centroid_y", "centroid_x")


def frame_object_counts(spark, sf_dir):
    """Objects, labelled area and confluency of each frame of 128 x 128 pixels."""
    rows = A.pixels(spark, sf_dir).groupBy("frame").agg(F.count_distinct("label").alias("n_objects"), F.count("*").alias("total_area"))
    return rows.withColumn("confluency_percent", F.round(100 * F.col("total_area") / (128 * 128), 6))


def volume_summary(spark, sf_dir):
    """Objects, greatest label, sizes, size quantiles and counts under thresholds, of the whole stack."""
    sizes = A.pixels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    counts = sizes.agg(F.count("*").alias("n_objects"), F.max("label").alias("max_label"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.count_if(F.col("n") < 50).alias("under_50"), F.count_if(F.col("n") < 100).alias("under_100"))
    return _rounded(counts.crossJoin(global_quantiles(sizes, "n", {"median_size": 0.5, "q10": 0.1, "q90": 0.9})), "median_size", "q10", "q90")  # one row each


def boundary_pixels(spark, sf_dir):
    return R.boundary(A.pixels(spark, sf_dir)).groupBy("frame", "label").agg(F.count("*").alias("perimeter"))


def touching_objects(spark, sf_dir):
    return R.touching(A.pixels(spark, sf_dir))


def overlap_links(spark, sf_dir):
    return _rounded(R.overlap_links(A.pixels(spark, sf_dir)), "overlap_fraction", "iou")


def stitched_objects(spark, sf_dir):
    px = durable(A.pixels(spark, sf_dir))
    owner = R.stitch(px, R.overlap_links(px))
    return _rounded(R.stitched_objects(px, owner), "centroid_y", "centroid_x")


def stitch_summary(spark, sf_dir):
    px = durable(A.pixels(spark, sf_dir))
    links = durable(R.overlap_links(px))
    owner = R.stitch(px, links)
    return px.agg(F.count_distinct("label").alias("n_masks")).crossJoin(links.agg(F.count("*").alias("n_links"))).crossJoin(owner.agg(F.count_distinct("object_id").alias("n_objects")))


def relabelled(spark, sf_dir):
    return R.relabel(A.pixels(spark, sf_dir))


def _points(spark, sf_dir):
    """Detections on the raster: frames folded to 1 to 7, coordinates to 1 to 128."""
    rows = A.trackpoints(spark, sf_dir)
    return rows.select("event_id", "track_id", (F.col("frame") % 7 + 1).alias("frame"), (F.rint("y") % 128 + 1).alias("y"), (F.rint("x") % 128 + 1).alias("x"))


def mask_under_point(spark, sf_dir):
    """Label under each detection, with its area and how many tracks share the object in the frame."""
    px = durable(A.pixels(spark, sf_dir))
    linked = durable(R.lookup(_points(spark, sf_dir), px))
    return R.with_owners(linked, px, "track_id").select("frame", "label", "event_id", "area", "n_tracks", "tracks")


def _centres(spark, sf_dir):
    return R.objects(A.pixels(spark, sf_dir)).select("frame", "label", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"))


def disc_overlaps(spark, sf_dir):
    """Pairs of object centres of a frame closer than 18 pixels."""
    return _rounded(R.near_pairs(_centres(spark, sf_dir), 18.0, ["frame"], "label"), "distance")


def nearest_centres(spark, sf_dir):
    return _rounded(R.nearest_points(_centres(spark, sf_dir), ["frame"], "label", 16.0).select("frame", "label", "distance"), "distance")


def nearest_masks(spark, sf_dir):
    return _rounded(R.nearest_masks(A.pixels(spark, sf_dir)).select("frame", "label", "distance", "gap"), "distance", "gap")


def nearest_mask_pairs(spark, sf_dir):
    """A closest pair of pixels of each object and its nearest other object."""
    return R.nearest_masks(A.pixels(spark, sf_dir)).select("frame", "label", "nearest", "y", "x", "nearest_y", "nearest_x")


def nearest_mask_pixels(spark, sf_dir):
    """The nearest object of every pixel of the 128 x 128 frames, with the nearest of its pixels."""
    return _rounded(R.nearest_mask_pixels(A.pixels(spark, sf_dir), 128, 128), "distance")


def farthest_object(spark, sf_dir):
    """The object of each frame that is farthest from its nearest other one, with the closest pair of pixels."""
    pairs = R.nearest_masks(A.pixels(spark, sf_dir))
    best = pairs.groupBy("frame").agg(F.max_by(F.struct("label", "nearest", "distance", "y", "x", "nearest_y", "nearest_x"), F.struct("distance", -F.col("label"))).alias("m"))
    return _rounded(best.select("frame", "m.*"), "distance")


def nearest_summary(spark, sf_dir):
    """Objects, objects without a neighbour and distance quantiles of each frame."""
    px = durable(A.pixels(spark, sf_dir))
    every = px.select("frame", F.col("label").cast("long").alias("label")).distinct().join(R.nearest_masks(px), ["frame", "label"], "left")
    out = every.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("distance").isNull()).alias("n_missing"), F.percentile("distance", F.lit(0.5)).alias("median"), F.percentile("distance", F.lit(0.9)).alias("p90"), F.percentile("distance", F.lit(0.99)).alias("p99"), F.max("distance").alias("most"))
    return out.withColumns({c: F.round(c, 4) for c in ("median", "p90", "p99", "most")})


def largest_object(spark, sf_dir):
    """The five largest objects, by size and then label."""
    sizes = A.pixels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return sizes.where("n >= 20").orderBy(F.col("n").desc(), "label").limit(5)


#: Factor and shift of each colour, modulo 255.
COLOURS = {"red": (37, 41), "green": (67, 89), "blue": (97, 131)}


def label_colours(spark, sf_dir):
    """A colour of each label, from its number alone."""
    label = F.col("label")
    return A.pixels(spark, sf_dir).select("label").distinct().select("label", *[F.pmod(label * m + k, F.lit(255)).cast("long").alias(c) for c, (m, k) in COLOURS.items()])


#: Shares of the size quantiles and thresholds under which objects are counted.
SIZE_SHARES, SIZE_LIMITS = (0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1), (100, 500, 1000, 2000, 5000, 10000)


def size_quantiles(spark, sf_dir):
    """Quantiles of the sizes of all objects of the stack, and how many are under each threshold."""
    sizes = A.pixels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    names = {f"q{round(100 * q)}": q for q in SIZE_SHARES}
    under = sizes.agg(*[F.count_if(F.col("n") < t).alias(f"under_{t}") for t in SIZE_LIMITS])
    return global_quantiles(sizes, "n", names).select(*[F.round(n, 4).alias(n) for n in names]).crossJoin(under)  # one row each


def padded_crops(spark, sf_dir):
    """Of the crop around each object, two pixels wider: its pixels, those of the object, and its size."""
    px = durable(A.pixels(spark, sf_dir))
    boxes = R.objects(px).withColumnRenamed("label", "box").select("frame", "box", "y_min", "y_end", "x_min", "x_end")
    rows = G.padded_crops(px, boxes, 2)
    return rows.groupBy("frame", "box").agg(F.count("*").alias("n_pixels"), F.count_if(F.col("label") == F.col("box")).alias("n_own"), (F.max("crop_y") + 1).cast("long").alias("height"), (F.max("crop_x") + 1).cast("long").alias("width"))


QUERIES = {
    f.__name__: f
    for f in (
        object_table, frame_object_counts, volume_summary, boundary_pixels, touching_objects, overlap_links, stitched_objects, stitch_summary,
        relabelled, mask_under_point, disc_overlaps, nearest_centres, nearest_masks, nearest_mask_pairs, nearest_mask_pixels, farthest_object, nearest_summary, largest_object, label_colours, size_quantiles, padded_crops,
    )
}

LINKS_SQL = A.PIXELS_SQL + """,
areas AS (SELECT label, count(*) AS area FROM pixels GROUP BY label),
links AS (SELECT * FROM (SELECT z_from, z_to, z_to - z_from AS dz, label_from, label_to, n AS intersection, f.area AS area_from, t.area AS area_to,
    n / least(f.area, t.area) AS overlap_fraction, n / (f.area + t.area - n) AS iou
  FROM (SELECT a.frame AS z_from, b.frame AS z_to, a.label AS label_from, b.label AS label_to, count(*) AS n
        FROM pixels a JOIN pixels b ON a.y = b.y AND a.x = b.x AND b.frame = a.frame + 1 GROUP BY ALL)
  JOIN areas f ON f.label = label_from JOIN areas t ON t.label = label_to) WHERE overlap_fraction >= 0.35)"""
STITCH_SQL = LINKS_SQL.replace("pixels AS (", "RECURSIVE pixels AS (", 1) + """,
e AS (SELECT label_from AS u, label_to AS v FROM links UNION SELECT label_to, label_from FROM links),
reach AS (SELECT label AS u, label AS v FROM areas UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
roots AS (SELECT u AS label, min(v) AS root FROM reach GROUP BY u),
owner AS (SELECT label, dense_rank() OVER (ORDER BY root) AS object_id FROM roots)"""
CENTRES_SQL = A.PIXELS_SQL + ",\ncentres AS (SELECT frame, label, avg(y) AS y, avg(x) AS x FROM pixels GROUP BY ALL)"
EDGE_SQL = A.PIXELS_SQL + """,
reach AS (SELECT frame, label, y + dy AS y, x + dx AS x FROM pixels, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)),
filled AS (SELECT frame, label, y, x FROM reach GROUP BY ALL HAVING count(*) = 4),
edge AS (SELECT * FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.frame = p.frame AND f.label = p.label AND f.y = p.y AND f.x = p.x))"""
NEAREST_SQL = EDGE_SQL + """,
near AS (SELECT a.frame, a.label, sqrt(min(power(a.y - b.y, 2) + power(a.x - b.x, 2))) AS distance FROM edge a JOIN edge b ON a.frame = b.frame AND a.label <> b.label GROUP BY ALL)"""
PAIRS_SQL = EDGE_SQL + """,
pairs AS (SELECT a.frame, a.label, min((CAST(power(a.y - b.y, 2) + power(a.x - b.x, 2) AS BIGINT), b.label, a.y, a.x, b.y, b.x)) AS m FROM edge a JOIN edge b ON a.frame = b.frame AND a.label <> b.label GROUP BY ALL),
named AS (SELECT frame, label, m[2] AS nearest, sqrt(m[1]) AS distance, CAST(m[3] AS BIGINT) AS y, CAST(m[4] AS BIGINT) AS x, CAST(m[5] AS BIGINT) AS nearest_y, CAST(m[6] AS BIGINT) AS nearest_x FROM pairs)"""

ORACLE_SQL = {
    "nearest_mask_pairs": A.sql(PAIRS_SQL, "SELECT frame, label, nearest, y, x, nearest_y, nearest_x FROM named"),
    "farthest_object": A.sql(PAIRS_SQL, "SELECT frame, m.label, m.nearest, round(m.distance, 6) AS distance, m.y, m.x, m.nearest_y, m.nearest_x FROM (SELECT frame, arg_max(n, (distance, -label)) AS m FROM named n GROUP BY frame)"),
    "nearest_mask_pixels": A.sql(A.PIXELS_SQL, """, grid AS (SELECT frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT frame FROM pixels), range(128) a(y), range(128) b(x)),
        marked AS (SELECT g.*, p.label, CASE WHEN p.label IS NOT NULL THEN g.y END AS own FROM grid g LEFT JOIN pixels p USING (frame, y, x)),
        sides AS (SELECT frame, y, x, max(own) OVER (PARTITION BY frame, x ORDER BY y) AS up, min(own) OVER (PARTITION BY frame, x ORDER BY y DESC) AS down FROM marked),
        seen AS (SELECT s.frame, s.y, p.y AS ny, p.x AS nx, p.label FROM (SELECT frame, y, x, up AS ny FROM sides UNION SELECT frame, y, x, down FROM sides) s JOIN pixels p ON p.frame = s.frame AND p.y = s.ny AND p.x = s.x),
        open AS (SELECT g.frame, g.y, g.x, min((CAST(power(g.y - e.ny, 2) + power(g.x - e.nx, 2) AS BIGINT), e.label, e.ny, e.nx)) AS m FROM marked g JOIN seen e ON e.frame = g.frame AND e.y = g.y WHERE g.label IS NULL GROUP BY ALL)
        SELECT frame, y, x, m[2] AS nearest, round(sqrt(m[1]), 6) AS distance, CAST(m[3] AS BIGINT) AS nearest_y, CAST(m[4] AS BIGINT) AS nearest_x FROM open
        UNION ALL SELECT frame, y, x, label, 0, y, x FROM pixels"""),
    "object_table": A.sql(A.PIXELS_SQL, "SELECT frame, label, count(*) AS area, min(y) AS y_min, max(y) + 1 AS y_end, min(x) AS x_min, max(x) + 1 AS x_end, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x FROM pixels GROUP BY ALL"),
    "frame_object_counts": A.sql(A.PIXELS_SQL, "SELECT frame, count(DISTINCT label) AS n_objects, count(*) AS total_area, round(100 * count(*) / (128 * 128), 6) AS confluency_percent FROM pixels GROUP BY ALL"),
    "volume_summary": A.sql(A.PIXELS_SQL, "SELECT count(*) AS n_objects, max(label) AS max_label, min(n) AS min_size, round(median(n), 6) AS median_size, max(n) AS max_size, round(quantile_cont(n, 0.1), 6) AS q10, round(quantile_cont(n, 0.9), 6) AS q90, count(*) FILTER (n < 50) AS under_50, count(*) FILTER (n < 100) AS under_100 FROM (SELECT label, count(*) AS n FROM pixels GROUP BY label)"),
    "boundary_pixels": A.sql(EDGE_SQL, "SELECT frame, label, count(*) AS perimeter FROM edge GROUP BY ALL"),
    "touching_objects": A.sql(A.PIXELS_SQL, "SELECT a.frame, least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, count(*) AS contacts FROM pixels a, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) o(dy, dx), pixels b WHERE a.frame = b.frame AND b.y = a.y + dy AND b.x = a.x + dx AND a.label <> b.label GROUP BY ALL"),
    "overlap_links": A.sql(LINKS_SQL, "SELECT * REPLACE (round(overlap_fraction, 6) AS overlap_fraction, round(iou, 6) AS iou) FROM links"),
    "stitched_objects": A.sql(STITCH_SQL, "SELECT object_id, count(DISTINCT label) AS n_masks, count(DISTINCT frame) AS n_slices, min(frame) AS z_min, max(frame) AS z_max, string_agg(DISTINCT (frame + 1)::VARCHAR, ';' ORDER BY (frame + 1)::VARCHAR) AS z_list, count(*) AS area, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x, array_to_string(list_transform(list_sort(list_distinct(list(label))), lambda l: l::VARCHAR), ';') AS source_labels FROM pixels JOIN owner USING (label) GROUP BY object_id"),
    "stitch_summary": A.sql(STITCH_SQL, "SELECT (SELECT count(*) FROM areas) AS n_masks, (SELECT count(*) FROM links) AS n_links, (SELECT max(object_id) FROM owner) AS n_objects"),
    "relabelled": A.sql(A.PIXELS_SQL, "SELECT frame, label, row_number() OVER (ORDER BY frame, label) AS new_label FROM (SELECT DISTINCT frame, label FROM pixels)"),
    "mask_under_point": A.sql(A.TRACKPOINTS_SQL + ",\n" + A.PIXELS_SQL, """, l AS (SELECT event_id, track_id, t.frame % 7 + 1 AS frame, p.label FROM trackpoints t LEFT JOIN pixels p ON p.frame = t.frame % 7 + 1 AND p.y = round_even(t.y, 0) % 128 AND p.x = round_even(t.x, 0) % 128),
        a AS (SELECT frame, label, count(*) AS area FROM pixels GROUP BY ALL),
        o AS (SELECT frame, label, count(DISTINCT track_id) AS n_tracks, array_to_string(list_transform(list_sort(list_distinct(list(track_id))), lambda t: t::VARCHAR), ';') AS tracks FROM l WHERE label IS NOT NULL GROUP BY ALL)
        SELECT frame, label, event_id, area, n_tracks, tracks FROM l LEFT JOIN a USING (frame, label) LEFT JOIN o USING (frame, label)"""),
    "disc_overlaps": A.sql(CENTRES_SQL, "SELECT a.frame, a.label AS ident_a, b.label AS ident_b, round(sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2)), 6) AS distance FROM centres a JOIN centres b ON a.frame = b.frame AND a.label < b.label WHERE sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2)) < 18"),
    "nearest_centres": A.sql(CENTRES_SQL, "SELECT a.frame, a.label, round(min(sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2))), 6) AS distance FROM centres a JOIN centres b ON a.frame = b.frame AND a.label <> b.label GROUP BY ALL"),
    "nearest_masks": A.sql(NEAREST_SQL, "SELECT frame, label, round(distance, 6) AS distance, round(greatest(distance - 1, 0), 6) AS gap FROM near"),
    "nearest_summary": A.sql(NEAREST_SQL, "SELECT frame, count(*) AS n, count(*) FILTER (distance IS NULL) AS n_missing, round(quantile_cont(distance, 0.5), 4) AS median, round(quantile_cont(distance, 0.9), 4) AS p90, round(quantile_cont(distance, 0.99), 4) AS p99, round(max(distance), 4) AS most FROM (SELECT DISTINCT frame, label FROM pixels) LEFT JOIN near USING (frame, label) GROUP BY frame"),
    "largest_object": A.sql(A.PIXELS_SQL, "SELECT label, count(*) AS n FROM pixels GROUP BY label HAVING count(*) >= 20 ORDER BY n DESC, label LIMIT 5"),
    "label_colours": A.sql(A.PIXELS_SQL, "SELECT DISTINCT label, CAST((label * 37 + 41) % 255 AS BIGINT) AS red, CAST((label * 67 + 89) % 255 AS BIGINT) AS green, CAST((label * 97 + 131) % 255 AS BIGINT) AS blue FROM pixels"),
    "size_quantiles": A.sql(A.PIXELS_SQL, "SELECT " + ", ".join(f"round(quantile_cont(n, {q}), 4) AS q{round(100 * q)}" for q in SIZE_SHARES) + ", " + ", ".join(f"count(*) FILTER (n < {t}) AS under_{t}" for t in SIZE_LIMITS) + " FROM (SELECT label, count(*) AS n FROM pixels GROUP BY label)"),
    "padded_crops": A.sql(A.PIXELS_SQL, """, e AS (SELECT frame, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY frame),
        b AS (SELECT frame, label AS box, greatest(min(y) - 2, 0) AS y0, least(max(y) + 3, any_value(h)) AS y1, greatest(min(x) - 2, 0) AS x0, least(max(x) + 3, any_value(w)) AS x1 FROM pixels JOIN e USING (frame) GROUP BY ALL)
        SELECT p.frame, box, count(*) AS n_pixels, count(*) FILTER (label = box) AS n_own, CAST(max(y - y0) + 1 AS BIGINT) AS height, CAST(max(x - x0) + 1 AS BIGINT) AS width FROM pixels p JOIN b ON p.frame = b.frame AND y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL"""),
}
