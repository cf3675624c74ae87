"""Views of the driver's tables as assay tables, each with the DuckDB CTEs that define the same rows.

trackpoints: events as detections (track_id, frame, x, y), with repeated frames;
tracks: the first detection of each track and frame; conditions join ploidy, dose and site to both;
pixels: lineitem cells as a labelled raster (frame, y, x, label); images: embeddings as 8 x 8 images;
inventory: file names derived from lineitem and part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dose levels of the plate layout, in nM, by column 2 to 11.
DOSES = (0.0, 3.125, 6.25, 12.5, 25.0, 50.0, 100.0, 200.0, 400.0, 800.0)

#: Folders that the derived file inventory stands under.
TOP_FOLDERS = ("Migration_assay/col3", "raw_images", "SNU-668_scan/cellpose", "tracking/phase", "plain/measurement_1")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_condition(df: DataFrame, key: str = "track_id") -> DataFrame:
    """Adds ploidy, dose and site_id, which follow from the track."""
    dose = F.element_at(F.array(*map(F.lit, DOSES)), (F.col(key) % 10 + 1).cast("int"))
    return df.withColumns({"ploidy": F.when(F.col(key) % 2 == 0, "2N").otherwise("4N"), "dose": dose, "site_id": F.col(key) % 20})


def trackpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(read(spark, sf_dir, "events"))


def detections(events: DataFrame) -> DataFrame:
    """Detections with repeated frames; order of arrival is (ts, event_id)."""
    rows = events.select(
        F.col("user_id").alias("track_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        "event_id",
        "ts",
        "event_type",
    )
    return with_condition(rows)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_detections(trackpoints(spark, sf_dir))


def first_detections(rows: DataFrame) -> DataFrame:
    """One detection of each track and frame, the first to arrive; rows stand by track, so that windows over tracks need no further shuffle."""
    from cytoframe.operators.tracks import keep_first

    return keep_first(rows.repartition("track_id"), ["track_id", "frame"], ["ts", "event_id"]).drop("ts")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pixels (frame, y, x, label); labels are unique over frames."""
    p = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("frame"), (F.col("l_partkey") % 128).cast("int").alias("y"), (F.col("l_orderkey") % 128).cast("int").alias("x")).distinct()
    tile = F.expr("CAST(y DIV 16 * 8 + x DIV 16 AS INT)")
    core = F.expr("y % 16 BETWEEN 3 AND 12 AND x % 16 BETWEEN 3 AND 12")
    return p.withColumn("tile", tile).where((F.col("tile") % 3 != 0) | core).select("frame", "y", "x", (F.col("frame") * 1000 + F.col("tile") + 1).alias("label"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel rows (image_id, y, x, v) of 8 x 8 images."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("image_id", F.expr("CAST(i DIV 8 AS INT)").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images as planes of volumes of eight: (image_id, z, y, x, v)."""
    rows = images(spark, sf_dir)
    return rows.select(F.expr("image_id DIV 8").alias("image_id"), (F.col("image_id") % 8).cast("int").alias("z"), "y", "x", "v")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (path, name) of image files in directories."""
    joined = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").join(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    top = F.element_at(F.array(*map(F.lit, TOP_FOLDERS)), F.col("p_size").cast("int") % len(TOP_FOLDERS) + 1)
    path = F.concat_ws("/", F.lit(""), F.lit("share"), top, F.translate("p_type", " ", "_"), F.translate("p_brand", "#", "_"))
    n = F.col("l_suppkey") % 5
    plain = F.format_string("FoF%d_z%02d_ch%02d.tif", n, F.col("l_linenumber"), F.col("l_suppkey") % 3)
    timed = F.concat(F.format_string("A%d_%d_", n + 1, F.col("l_linenumber")), F.date_format("l_shipdate", "yyyy'y'MM'm'dd'd'"), F.lit("_06h30m.png"))
    elapsed = F.format_string("phase_B%d_1_%02dd%02dh00m.jpg", n + 1, F.col("l_linenumber"), F.col("l_suppkey") % 24)
    phenix = F.format_string("r%02dc%02df%02dp%02d-ch%d.tiff", n + 1, F.col("l_linenumber"), F.lit(1), F.col("l_suppkey") % 7, F.lit(1))
    name = F.when(F.col("l_partkey") % 4 == 0, plain).when(F.col("l_partkey") % 4 == 1, timed).when(F.col("l_partkey") % 4 == 2, elapsed).otherwise(phenix)
    return joined.select(path.alias("path"), name.alias("name")).distinct()


_DOSE_LIST = ", ".join(map(str, DOSES))
CONDITION_SQL = f"CASE WHEN track_id % 2 = 0 THEN '2N' ELSE '4N' END AS ploidy, list_extract([{_DOSE_LIST}]::DOUBLE[], CAST(track_id % 10 + 1 AS INTEGER)) AS dose, track_id % 20 AS site_id"
TRACKPOINTS_SQL = f"""trackpoints AS (
  SELECT *, {CONDITION_SQL} FROM (
    SELECT user_id AS track_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame,
           value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_id, ts, event_type FROM events))"""
TRACKS_SQL = TRACKPOINTS_SQL + """,
tracks AS (SELECT * EXCLUDE (rn, ts) FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY ts, event_id) AS rn FROM trackpoints) WHERE rn = 1)"""
PIXELS_SQL = """pixels AS (
  SELECT frame, y, x, frame * 1000 + tile + 1 AS label FROM (
    SELECT *, CAST(y // 16 * 8 + x // 16 AS INTEGER) AS tile FROM (
      SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS frame, CAST(l_partkey % 128 AS INTEGER) AS y, CAST(l_orderkey % 128 AS INTEGER) AS x FROM lineitem))
  WHERE tile % 3 <> 0 OR (y % 16 BETWEEN 3 AND 12 AND x % 16 BETWEEN 3 AND 12))"""
IMAGES_SQL = """images AS (
  SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"""
_TOP_LIST = ", ".join(f"'{t}'" for t in TOP_FOLDERS)
INVENTORY_SQL = f"""inventory AS (
  SELECT DISTINCT '/share/' || list_extract([{_TOP_LIST}], CAST(p_size % 5 + 1 AS INTEGER)) || '/' || translate(p_type, ' ', '_') || '/' || translate(p_brand, '#', '_') AS path,
    CASE l_partkey % 4
      WHEN 0 THEN printf('FoF%d_z%02d_ch%02d.tif', l_suppkey % 5, l_linenumber, l_suppkey % 3)
      WHEN 1 THEN printf('A%d_%d_', l_suppkey % 5 + 1, l_linenumber) || strftime(l_shipdate, '%Yy%mm%dd') || '_06h30m.png'
      WHEN 2 THEN printf('phase_B%d_1_%02dd%02dh00m.jpg', l_suppkey % 5 + 1, l_linenumber, l_suppkey % 24)
      ELSE printf('r%02dc%02df%02dp%02d-ch%d.tiff', l_suppkey % 5 + 1, l_linenumber, 1, l_suppkey % 7, 1) END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sql(prefix: str, body: str) -> str:
    """A query from CTEs; a body that begins with a comma goes on with more of them."""
    return f"WITH {prefix}{'' if body.startswith(',') else chr(10)}{body}"

