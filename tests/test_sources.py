"""Readers and writers: round trips and broken inputs."""


import pytest
from pyspark.sql import functions as F

from cytoframe.sources import files, tables
from cytoframe.streaming import landing


def test_walk_lists_a_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.tif").write_text("")
    (tmp_path / "a" / "link").symlink_to(tmp_path)
    rows = {r.relative_path: r for r in files.walk(spark, str(tmp_path)).collect()}
    assert set(rows) == {".", "a", "a/b"} and rows["a"].Nfiles == 1 and rows["a"].extension_counts == {".tif": 1} and rows["a"].depth == 1
    assert files.list_directory(str(tmp_path / "missing"))[0]["status"] == "read_error"
    assert tables.directory_failure("p", "timeout_blackhole", ["a.TIF", "b"], None)["sampleExtensions"] == {".tif": 1, "[no extension]": 1}


def test_delimited_round_trip_and_binding(spark, tmp_path):
    df = spark.createDataFrame([("s1", ["a", "b"], None), ("s2", [], 2)], "site string, names array<string>, n int")
    tables.write_delimited(df, str(tmp_path / "t"), ["n", "site", "names"])
    back = tables.read_delimited(spark, str(tmp_path / "t"))
    assert back.columns == ["n", "site", "names"] and {(r.n, r.site, r.names) for r in back.collect()} == {(None, "s1", "a; b"), ("2", "s2", None)}
    (tmp_path / "p.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "q.tsv").write_text("a\n3\n")
    bound = tables.bind_with_source(spark, [str(tmp_path / "p.tsv"), str(tmp_path / "q.tsv")])
    assert {(r.a, r.b, r.source_file) for r in bound.collect()} == {("1", "2", "p.tsv"), ("3", None, "q.tsv")}


def test_field_tables_take_columns_from_the_path(spark, tmp_path):
    for line, name in (("NCI", "F1_CSV-Table_2.csv"), ("SUM", "plain.csv")):
        (tmp_path / line / "csv").mkdir(parents=True)
        (tmp_path / line / "csv" / name).write_text("frame,trackId\n1,2\n")
    rows = tables.read_field_tables(spark, f"{tmp_path}/*/csv/*.csv", str(tmp_path))
    assert {(r.cell_line, r.field_id) for r in rows.collect()} == {("NCI", "F1"), ("SUM", "plain")}


def test_bundles_appends_and_resume(spark, tmp_path):
    a, b = spark.range(3), spark.createDataFrame([(1, "x")], "id long, note string")
    tables.write_bundle(str(tmp_path / "w"), one=a, two=b)
    assert tables.read_bundle(spark, str(tmp_path / "w"), ["one", "two"])["two"].first().note == "x"
    tables.append_rows(a, str(tmp_path / "log"))
    tables.append_rows(b, str(tmp_path / "log"))
    assert sorted(tables.read_appended(spark, str(tmp_path / "log")).columns) == ["id", "note"]
    log = spark.createDataFrame([(1, "ok"), (2, "error")], "id long, status string")
    assert {r.id for r in tables.still_to_do(spark.range(4), log, ["id"]).collect()} == {0, 2, 3}
    assert {r.id for r in tables.usable_results(log, spark.range(2), ["id"]).collect()} == {1}
    assert {r.id for r in tables.usable_results(log, spark.range(5, 7), ["id"]).collect()} == {5, 6}


def test_plate_and_conditions(spark):
    plate = {r.well: r for r in tables.plate_layout(spark).collect()}
    assert len(plate) == 96 and plate["A1"].ploidy is None and plate["A1"].dose is None
    assert (plate["B5"].ploidy, plate["B5"].dose, plate["B5"].condition_id) == ("2N", 12.5, "2N_gem_12p5nM") and plate["H7"].condition_id == "4N_gem_50nM" and plate["E8"].condition_id == "4N_gem_100nM"
    assert tables.condition_grid(spark).count() == 20
    jobs = tables.fit_manifest(tables.plate_layout(spark), {"n_starts": 25}).orderBy("job_id").collect()
    assert len(jobs) == 20 and (jobs[0].ploidy, jobs[0].dose, jobs[0].n_starts) == ("2N", 0.0, 25)
    grid = spark.createDataFrame([("A", "2N: 12.5 nM", ""), ("B", "4N:100nM", "blank")], "r string, `1` string, `2` string")
    ploidy, dose = tables.parse_treatment()
    got = {r.well: (r.p, r.d) for r in tables.melt_plate(grid, "r").select("well", ploidy.alias("p"), dose.alias("d")).collect()}
    assert got == {"A1": ("2N", 12.5), "B1": ("4N", 100.0), "B2": (None, None)}


def test_small_parsers(spark):
    df = spark.range(6).withColumn("frame", F.col("id"))
    assert [df.where(tables.frames_in(t)).count() for t in ("all", "1:3", "0,5")] == [6, 3, 2]
    assert tables.number_list("5, 3,3,", int) == [3, 5]
    with pytest.raises(ValueError, match="missing columns: b"):
        tables.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"])
    row = spark.createDataFrame([("x/A1_2_cpsam_masks.tiff", "it's", ["a; b", "b;c ;d"])], "name string, q string, v array<string>").select(tables.site_id(F.col("name")).alias("s"), tables.command("run", {"in": "q"}).alias("c"), tables.join_distinct("v", 3).alias("j")).first()
    assert row.s == "A1_2" and row.c == "run --in 'it'\"'\"'s'" and row.j == "a; b; c; ...(+1)"
    assert tables.parse_conditions(spark, "2N:0,4N:25").count() == 2
    flat = tables.flat_tracks(spark.createDataFrame([(1, [0, 1], [5.0, 6.0])], "id int, t array<int>, x array<double>"), ["t", "x"]).collect()
    assert [(r.id, r.t, r.x) for r in flat] == [(1, 0, 5.0), (1, 1, 6.0)]
    sites = tables.site_manifest(spark.createDataFrame([("B_1.tif",), ("A_1.tif",), ("notes.txt",)], "name string"), [spark.createDataFrame([("A_1.csv",), ("B_1.csv",)], "name string")]).collect()
    assert [(r.site_id, r.file_index) for r in sorted(sites, key=lambda r: r.file_index)] == [("A_1", 1), ("B_1", 2)]


def test_landing_records_are_scored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text('{"path": "/share/raw/x", "status": "ok", "sampleNames": ["a_z01_ch00.tif", "a_z02_ch00.tif"]}\n')
    query = landing.score_landing(landing.landing_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.z_score == 7 and row.origin == "raw_hint"


def test_tracks_labels_and_batches(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("file\twell\tsite\tsplit_track_id\tframe\tx\ty\nB03_run\t\t1\t7\t0\t1.5\t2\nB03_run\tC01\t1\t\t0\t1\t2\n")
    (tmp_path / "b.tsv").write_text("file\twell\tsite\tsplit_track_id\tframe\tx\ty\textra\nrun\tD04\tq\t9\t1\t3\t4\tz\nB11_r\t\t2\t1\t2\tNA\t1\tz\n")
    paths = [str(tmp_path / n) for n in ("a.tsv", "b.tsv")]
    got = {r.split_track_id: r for r in tables.isolated_tracks(spark, paths).collect()}
    assert set(got) == {"B03_run::7", "run::9"} and got["B03_run::7"].well == "B03" and got["run::9"].site is None and got["run::9"].well_from_file is None
    assert got["B03_run::7"].source_file == "a.tsv" and got["B03_run::7"].x == 1.5
    assert [r.split_track_id for r in tables.isolated_tracks(spark, paths, ["D04"]).collect()] == ["run::9"]
    frames = spark.createDataFrame([(0,), (13,), (25,)], "frame int")
    assert [r[0] for r in frames.orderBy("frame").select(tables.elapsed_label()).collect()] == ["00d00h00m", "01d02h00m", "02d02h00m"]
    assert tables.light_tracks(spark, frames).count() == 0 and len(tables.light_tracks(spark, None).columns) == 10
    rows = spark.createDataFrame([(g, k) for g in "ab" for k in range(7)], "g string, k int")
    batches = {(r.g, r.k): r.batch for r in tables.in_batches(rows, ["g"], ["k"], 3).collect()}
    assert all(b == k // 3 + 1 for (_, k), b in batches.items())
    from cytoframe.operators.summaries import evenly_spaced

    one = {r.g: r.k for r in evenly_spaced(rows, ["g"], ["k"], 1, seed=3).collect()}
    assert set(one) == {"a", "b"} and all(0 < k < 6 for k in one.values())
