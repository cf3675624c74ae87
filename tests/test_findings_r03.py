"""Small cases behind the findings of the third review."""

import duckdb
from pyspark.sql import functions as F

from cytoframe.operators import mixed_logistic as ML
from cytoframe.operators import raster as R
from cytoframe.plans import assorted, raster

#: A quadrant whose Otsu histogram has two bins that part it equally well, as exact fractions; rounding alone tells them apart.
TIED = [
    [0.11908048391342163, -0.17196083068847656, 0.02356812357902527, 0.026183126494288445],
    [0.08383945375680923, -0.16309227049350739, -0.12768591940402985, -0.07404418289661407],
    [-0.15414626896381378, -0.1391335278749466, -0.05456746742129326, -0.02494596317410469],
    [-0.03331833705306053, -0.11062425374984741, -0.11558768153190613, 0.06531175225973129],
]


def test_thresholds_of_tied_bins_are_those_of_the_sql(spark, tmp_path):
    image = [TIED[y % 4][x % 4] for y in range(8) for x in range(8)]
    spark.createDataFrame([(0, image)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = assorted.object_intensity(spark, str(tmp_path)).select("image_id", "label", "n_kept").collect()
    with duckdb.connect(config={"threads": 1}) as duck:  # over several threads rows may be added in another order
        duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = duck.sql(f"SELECT image_id, label, n_kept FROM ({assorted.ORACLE_SQL['object_intensity']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 4


def test_lists_of_tracks_are_joined_in_several_tasks(spark, sf):
    rows = raster.mask_under_point(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in rows) <= 0.6 * sum(r["count"] for r in rows)


def test_points_in_parts_get_the_whole_list(spark, monkeypatch):
    monkeypatch.setattr(R, "POINTS_PER_COPY", 3)
    px = spark.createDataFrame([(1, 0, x, 1001 + x // 2) for x in range(4)], "frame int, y int, x int, label int")
    points = [(k, k % 7, 1, None if k % 5 == 0 else 1001 + k % 2) for k in range(60)]
    got = R.with_owners(spark.createDataFrame(points, "event_id long, track_id long, frame int, label int"), px, "track_id").collect()
    lists = {v: sorted({t for _, t, _, label in points if label == v}) for v in (1001, 1002)}
    want = [(k, t, v, *((2, len(lists[v]), ";".join(map(str, lists[v]))) if v else (None,) * 3)) for k, t, _, v in points]
    assert sorted((r.event_id, r.track_id, r.label, r.area, r.n_tracks, r.tracks) for r in got) == want


def test_few_groups_take_few_jobs_and_fit_as_many_do(spark, monkeypatch):
    rows = [(k % 5, ((k * 37) % 101) / 50 - 1, int((k * 53) % 97 < 30 + 8 * (k % 5))) for k in range(300)]
    df, fits, jobs = spark.createDataFrame(rows, "g long, x double, y int"), [], []
    for groups in (ML.LOCAL_GROUPS, 0):
        monkeypatch.setattr(ML, "LOCAL_GROUPS", groups)
        spark.sparkContext.setJobGroup(f"fit{groups}", "fit")
        fits.append(ML.fit(df, "y", ["x"], "g", variance=0.3))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{groups}")))
    few, many = fits
    assert max(abs(few.coefficients - many.coefficients)) < 1e-9 and abs(few.log_likelihood - many.log_likelihood) < 1e-9 and few.passes == many.passes
    assert {r[0]: round(r[1], 9) for r in few.offsets.select("_g", "_u").collect()} == {r[0]: round(r[1], 9) for r in many.offsets.select("_g", "_u").collect()}
    assert jobs[0] < jobs[1]
