"""Registered image queries over 8 x 8 images and volumes of eight of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoframe.operators import imaging as G
from cytoframe.sources import adapters as A


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def scaled_images(spark, sf_dir):
    return _rounded(G.percentile_scaled(A.images(spark, sf_dir)).select("image_id", "y", "x", "scaled"), "scaled", digits=4)


def z_scores(spark, sf_dir):
    return _rounded(G.z_scored(A.images(spark, sf_dir)).select("image_id", "y", "x", "abs_zscore"), "abs_zscore", digits=4)


def focus_confidences(spark, sf_dir):
    return _rounded(G.confidences(A.volume(spark, sf_dir)).select("image_id", "z", "y", "x", "relative", "softmax"), "relative", "softmax", digits=4)


def otsu_thresholds(spark, sf_dir):
    return _rounded(G.otsu(A.images(spark, sf_dir), bins=16), "threshold", digits=4)


def projections(spark, sf_dir):
    return _rounded(G.projection(A.volume(spark, sf_dir)), "v", digits=4)


def central_slices(spark, sf_dir):
    return _rounded(G.central_slice(A.volume(spark, sf_dir)), "v", digits=4)


def crops(spark, sf_dir):
    return _rounded(G.cropped(A.images(spark, sf_dir), 4), "v", digits=4)


def thumbnails(spark, sf_dir):
    return _rounded(G.resized(A.images(spark, sf_dir), 3, 3), "v", digits=4)


def channel_views(spark, sf_dir):
    """Gray and fused views of images read as three channels of shifted values, as display bytes."""
    px = A.images(spark, sf_dir).withColumns({"r": F.col("v"), "g": F.col("v") / 2, "b": -F.col("v")})
    px = G.fused(G.channel(px, "gray"), ["r", "g", "b"])
    return px.select("image_id", "y", "x", F.round("v", 4).alias("gray"), F.round("fused", 4).alias("fused"), G.display_bytes(F.col("fused")).alias("shown"))


def variant_means(spark, sf_dir):
    """Mean of the artificial channel of each variant of each volume, beside those of the channels it is stacked with."""
    px = G.confidences(G.z_scored(A.volume(spark, sf_dir))).withColumns({"bright": F.col("v"), "fluorescence": F.abs("v")})
    px = G.rescaled(px, ["abs_zscore", "relative", "bright", "fluorescence"])
    px = G.channel_stacks(G.artificial_channels(px, "abs_zscore", "relative"), "fluorescence", "bright")
    means = []
    for n in G.ARTIFICIAL:
        two, three = F.col(f"fucci_{n}"), F.col(f"fucci_bf_{n}")
        means += [F.round(F.avg(two[1]), 4).alias(n), F.round(F.avg((two[0] + two[1]) / 2), 4).alias(f"fucci_{n}"), F.round(F.avg((three[0] + three[1] + three[2]) / 3), 4).alias(f"fucci_bf_{n}")]
    return px.groupBy("image_id").agg(*means)


def unit_scaled_objects(spark, sf_dir):
    from cytoframe.operators import raster as R

    rows = R.objects(A.pixels(spark, sf_dir)).withColumns({"log_area": F.log1p("area"), "one": F.lit(1.0)})
    return _rounded(G.unit_scaled(rows, ["area", "log_area", "one"]).select("label", "u_area", "u_log_area", "u_one"), "u_area", "u_log_area", "u_one")


def focus_scores(spark, sf_dir):
    """Mean and greatest composite focus of each plane of each volume."""
    rows = G.focus_on_tiles(A.volume(spark, sf_dir))
    return _rounded(rows.groupBy("image_id", "z").agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score")), "mean_score", "max_score", digits=4)


def deviation_log_products(spark, sf_dir):
    rows = G.apply_preset(A.volume(spark, sf_dir), "sd_log")
    return rows.groupBy("image_id").agg(F.avg("combined").alias("combined"), F.avg("otsu_product").alias("otsu_product"))


QUERIES = {f.__name__: f for f in (scaled_images, z_scores, focus_confidences, otsu_thresholds, projections, central_slices, crops, thumbnails, channel_views, variant_means, unit_scaled_objects, focus_scores, deviation_log_products)}

VOLUME_SQL = A.IMAGES_SQL + ",\nvolume AS (SELECT image_id // 8 AS image_id, CAST(image_id % 8 AS INTEGER) AS z, y, x, v FROM images)"
_CHANNELS = {"absz": "a", "sd_w10": "d", "absz_sd_mean": "(a + d) * 0.5", "absz_sd_geom": "sqrt(a * d)", "absz_sd_product": "a * d", "absz_sd_min": "least(a, d)", "absz_sd_max": "greatest(a, d)", "absz2_sd_product": "a * a * d", "absz_sd2_product": "a * d * d"}


def _percentiles(*columns):
    return ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.998) AS hi_{c}" for c in columns)


def _scaled(c):
    return f"least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c} + 1e-6), 0), 1)"


ORACLE_SQL = {
    "scaled_images": A.sql(A.IMAGES_SQL, "SELECT image_id, y, x, round(least(greatest((v - a) / (b - a + 1e-6), 0), 1), 4) AS scaled FROM images JOIN (SELECT image_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.995) AS b FROM images GROUP BY 1) USING (image_id)"),
    "z_scores": A.sql(A.IMAGES_SQL, "SELECT image_id, y, x, round(abs((v - m) / (s + 1e-6)), 4) AS abs_zscore FROM images JOIN (SELECT image_id, avg(v) AS m, stddev_pop(v) AS s FROM images GROUP BY 1) USING (image_id)"),
    "focus_confidences": A.sql(VOLUME_SQL, """, m AS (SELECT *, v - min(v) OVER w AS a, exp(v - max(v) OVER w) AS e FROM volume WINDOW w AS (PARTITION BY image_id, y, x))
        SELECT image_id, z, y, x, round(a / (max(a) OVER w + 1e-6), 4) AS relative, round(e / sum(e) OVER w, 4) AS softmax FROM m WINDOW w AS (PARTITION BY image_id, y, x)"""),
    "otsu_thresholds": A.sql(A.IMAGES_SQL, """, e AS (SELECT image_id, min(v) AS a, max(v) AS b FROM images GROUP BY 1), h AS (SELECT image_id, CAST(least(floor((v - a) / ((b - a) / 16)), 15) AS BIGINT) AS k, count(*) AS n FROM images JOIN e USING (image_id) GROUP BY ALL),
        g AS (SELECT image_id, a, b, unnest(range(16)) AS k FROM e), r AS (SELECT g.image_id, g.k, coalesce(n, 0) AS n, a + (g.k + 0.5) * ((b - a) / 16) AS c FROM g LEFT JOIN h ON h.image_id = g.image_id AND h.k = g.k),
        s AS (SELECT *, sum(n) OVER u AS w1, sum(n) OVER d AS w2, sum(n * c) OVER u AS s1, sum(n * c) OVER d AS s2 FROM r WINDOW u AS (PARTITION BY image_id ORDER BY k ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY image_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        SELECT image_id, round(arg_max(c, (w1 * w2 * power(s1 / greatest(w1, 1) - s2 / greatest(w2, 1), 2), -k)), 4) AS threshold FROM s WHERE k < 15 GROUP BY 1"""),
    "projections": A.sql(VOLUME_SQL, "SELECT image_id, y, x, round(sum(v), 4) AS v FROM volume GROUP BY ALL"),
    "central_slices": A.sql(VOLUME_SQL, "SELECT image_id, z, y, x, round(v, 4) AS v FROM (SELECT *, max(z) OVER (PARTITION BY image_id) + 1 AS n FROM volume) WHERE z = n // 2"),
    "crops": A.sql(A.IMAGES_SQL, "SELECT image_id, CAST(y - 2 AS INTEGER) AS y, CAST(x - 2 AS INTEGER) AS x, round(v, 4) AS v FROM images WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"),
    "thumbnails": A.sql(A.IMAGES_SQL, "SELECT image_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, round(v, 4) AS v FROM images, range(3) a(i), range(3) b(j) WHERE y = i * 7 // 2 AND x = j * 7 // 2"),
    "channel_views": A.sql(A.IMAGES_SQL, "SELECT image_id, y, x, round((v + v / 2 - v) / 3, 4) AS gray, round(greatest(v, v / 2, -v), 4) AS fused, CAST(floor(least(greatest(greatest(v, v / 2, -v), 0), 1) * 255) AS INTEGER) AS shown FROM images"),
    "variant_means": A.sql(VOLUME_SQL, f""", s AS (SELECT *, abs((v - avg(v) OVER i) / (stddev_pop(v) OVER i + 1e-6)) AS z0, v - min(v) OVER w AS q FROM volume WINDOW i AS (PARTITION BY image_id), w AS (PARTITION BY image_id, y, x)),
        t AS (SELECT image_id, z0, q / (max(q) OVER w + 1e-6) AS d0, v AS b0, abs(v) AS f0 FROM s WINDOW w AS (PARTITION BY image_id, y, x)),
        p AS (SELECT image_id, {_scaled("z0")} AS a, {_scaled("d0")} AS d, {_scaled("b0")} AS b, {_scaled("f0")} AS f FROM t JOIN (SELECT image_id, {_percentiles("z0", "d0", "b0", "f0")} FROM t GROUP BY 1) USING (image_id)),
        c AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _CHANNELS.items())} FROM p),
        g AS (SELECT image_id, {_percentiles(*list(_CHANNELS)[2:])} FROM c GROUP BY 1),
        k AS (SELECT image_id, f, b, absz, sd_w10, {", ".join(f"{_scaled(n)} AS {n}" for n in list(_CHANNELS)[2:])} FROM c JOIN g USING (image_id))
        SELECT image_id, {", ".join(f"round(avg({n}), 4) AS {n}, round(avg((f + {n}) / 2), 4) AS fucci_{n}, round(avg((f + b + {n}) / 3), 4) AS fucci_bf_{n}" for n in _CHANNELS)} FROM k GROUP BY 1"""),
    "unit_scaled_objects": A.sql(A.PIXELS_SQL, """, o AS (SELECT label, count(*) AS area, ln(1 + count(*)) AS la FROM pixels GROUP BY label), q AS (SELECT quantile_cont(area, 0.05) AS a, quantile_cont(area, 0.95) AS b, quantile_cont(la, 0.05) AS c, quantile_cont(la, 0.95) AS d FROM o)
        SELECT label, round(least(greatest((area - a) / (b - a), 0), 1), 6) AS u_area, round(least(greatest((la - c) / (d - c), 0), 1), 6) AS u_log_area, 0.5::DOUBLE AS u_one FROM o, q"""),
}
