"""Small cases behind the findings of the fourth review."""

import math

import duckdb
from pyspark.sql import functions as F

from cytoframe.operators import raster as R
from cytoframe.plans import imaging

#: Two bins part this image equally well but for the last digit of a power, which the product of a number with itself doesn't have.
TIED = [
    0.004765018820762634, 0.0635760948061943, -0.0005505584413185716, 0.020628975704312325, 0.012752324342727661, 0.05856473371386528, 0.05631835386157036, -0.009799230843782425,
    0.06957296282052994, -0.009753900580108166, -0.013876398093998432, 0.0031370341312140226, -0.005784379318356514, 0.004534060601145029, 0.06774745881557465, 0.06501001119613647,
    0.00563683221116662, 0.02642461657524109, -0.011395560577511787, -0.031006990000605583, -0.03957188129425049, -0.04309871792793274, -0.008172199130058289, -0.005329895298928022,
    0.014656894840300083, -0.009753900580108166, -0.008068747818470001, 0.01120895054191351, 0.03138456866145134, -0.04579029604792595, -0.022892674431204796, 0.002015884267166257,
    -0.05015716329216957, -0.0013193469494581223, -0.011771743185818195, 0.017434190958738327, -0.07062093168497086, 0.004990017972886562, -0.01119602844119072, -0.005911851767450571,
    -0.03708646446466446, -0.014892371371388435, -0.001226147054694593, -0.006479092873632908, 0.011179391294717789, 0.059020690619945526, -0.04235311970114708, 0.005909316707402468,
    0.002430008491501212, 0.02642461657524109, 0.04178595915436745, -0.05622311308979988, 0.01217580121010542, -0.01498469803482294, -0.010808587074279785, -0.028125958517193794,
    -0.013333309441804886, -0.014892371371388435, -0.018294086679816246, -0.014836622402071953, 0.025087833404541016, -0.012293120846152306, -0.032158415764570236, -0.0799049437046051,
]
NAN, INF = math.nan, math.inf


def test_thresholds_of_ties_and_odd_images_are_those_of_the_sql(spark, tmp_path):
    rows = [(0, TIED), (1, [None] * 64), (2, [INF] * 64), (3, [NAN, *TIED[1:]]), (4, [None, None, *TIED[2:]]), (5, [-INF, *TIED[1:]]), (6, [0.0] * 64), (7, []), (8, None), (9, [1.5]), (None, TIED)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = imaging.otsu_thresholds(spark, str(tmp_path)).select("image_id", "threshold").collect()
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = duck.sql(f"SELECT image_id, threshold FROM ({imaging.ORACLE_SQL['otsu_thresholds']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == 9


def test_a_long_list_of_tracks_shares_its_task_with_no_other(spark):
    px = spark.createDataFrame([(1, 0, x, 1001 + x) for x in range(6)], "frame int, y int, x int, label int")
    points = spark.range(15000).selectExpr("id AS event_id", "1000000 + id DIV 6 AS track_id", "1 AS frame", "CAST(IF(id % 50 = 0, NULL, 1001 + id % 6) AS INT) AS label")
    rows = R.with_owners(points, px, "track_id")
    held = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("tracks").alias("lists"), F.min(F.octet_length("tracks")).alias("bytes"), F.count_if(F.col("tracks").isNull()).alias("background")).collect()
    assert max(r.lists for r in held) == 1 and min(r.bytes or 16384 for r in held) >= 16384 and not any(r.lists and r.background for r in held)
    lists = {r.label: ";".join(map(str, sorted({p.track_id for p in r.p}))) for r in points.where("label IS NOT NULL").groupBy("label").agg(F.collect_list(F.struct("track_id")).alias("p")).collect()}
    got = rows.collect()
    assert len(got) == 15000 and all(r.tracks == lists.get(r.label) and r.area == (r.label and 1) for r in got)
