"""The jobs over growing and repeated input, after failures, and from the command line."""

import json
import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from jobs import _run, directory_inventory, motility_report

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return Counter(map(repr, df.collect()))


def batches(folder):
    return sorted(p.name for p in (folder / "names").glob("batch=*"))


def split(spark, sf, folder, n):
    """The pages as n files in a folder of their own, to be landed one by one."""
    spark.read.parquet(f"{sf}/pages.parquet").repartition(n, "page_id").write.parquet(str(folder))
    return sorted(folder.glob("*.parquet"))


def test_inventory_takes_only_what_is_new(spark, sf, tmp_path):
    files = split(spark, sf, tmp_path / "all", 4)
    (tmp_path / "landing").mkdir()

    def run(**more):
        return directory_inventory.inventory(spark, f"{tmp_path}/landing", f"{tmp_path}/out", f"{tmp_path}/checkpoint", parts=5, **more)

    assert run().count() == 0 and not (tmp_path / "out").exists()
    for name in files[:2]:
        shutil.copy(name, tmp_path / "landing")
    first = rows(run())
    assert batches(tmp_path / "out") == ["batch=0"]
    assert first == rows(directory_inventory.describe(directory_inventory.names_of(spark.read.parquet(*map(str, files[:2]))).selectExpr("0 part", "*")).select(*directory_inventory.COLUMNS))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert rows(run()) == first and {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == before
    for name in files[2:]:
        shutil.copy(name, tmp_path / "landing")
    second = rows(run(files_per_batch=1))
    assert batches(tmp_path / "out") == ["batch=0", "batch=1", "batch=2"]
    assert sum(spark.read.parquet(f"{tmp_path}/out/summarised").groupBy("batch").count().select("count").toPandas()["count"]) == 3
    whole = directory_inventory.inventory(spark, f"{sf}/pages.parque[t]", f"{tmp_path}/whole", f"{tmp_path}/checkpoint2")
    assert rows(whole) == second and sum(second.values()) > sum(first.values())


def test_inventory_is_made_good_after_a_failure(spark, sf, tmp_path, monkeypatch):
    args = (spark, f"{sf}/pages.parque[t]", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    with monkeypatch.context() as m:
        m.setattr(directory_inventory, "describe", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            directory_inventory.inventory(*args)
    assert batches(tmp_path / "out") == ["batch=0"] and not (tmp_path / "out" / "directories").exists()
    found = rows(directory_inventory.inventory(*args))
    shutil.rmtree(tmp_path / "out" / "summarised")  # as if it stopped before the batch counted as done
    assert rows(directory_inventory.inventory(*args)) == found
    with monkeypatch.context() as m:  # a batch that failed after it wrote runs again under its number
        write = directory_inventory.names_of

        def fails(batch):
            if not (tmp_path / "b" / "failed").exists():
                (tmp_path / "b" / "failed").mkdir(parents=True)
                raise RuntimeError("lost")
            return write(batch)

        m.setattr(directory_inventory, "names_of", fails)
        other = (spark, f"{sf}/pages.parque[t]", f"{tmp_path}/b/out", f"{tmp_path}/b/checkpoint")
        with pytest.raises(Exception):
            directory_inventory.inventory(*other)
        assert rows(directory_inventory.inventory(*other)) == found


def test_addresses_as_directories(spark):
    urls = ["https://h/a/b/c.TIF?x=/y#z", "http://h/a/b/", "h/a", "http://h", "http://h/", "", None, "/share//raw/i.png", "http://h/a/b/c.TIF"]
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, name int")
    got = {tuple(r) for r in directory_inventory.names_of(df).collect()}
    assert got == {("/h/a/b", "c.TIF"), ("/h/a", "b"), ("/h", "a"), ("/h", ""), ("/share/raw", "i.png")}
    shown = {r.path: r for r in directory_inventory.describe(directory_inventory.names_of(df).selectExpr("0 part", "*")).collect()}
    assert shown["/h/a/b"].extensions == ".tif=1" and shown["/share/raw"].origin == "raw_hint" and shown["/h"].drive == "h" and shown["/h"].extensions == "[no extension]=2"


def test_report_again_gives_the_same_tables(spark, sf, tmp_path):
    first = rows(motility_report.report(spark, f"{sf}/events.parquet", f"{tmp_path}/out"))
    assert rows(motility_report.report(spark, f"{sf}/events.parquet", f"{tmp_path}/out")) == first
    assert {p.name for p in (tmp_path / "out" / "statistics").glob("statistic=*")} == {f"statistic={s}" for s in ("run_frames", "step_distance", "squared_displacement", "origin_displacement", "step_cosine")}
    longer = motility_report.report(spark, f"{sf}/events.parquet", f"{tmp_path}/out", max_lag=7)
    assert longer.where("lag > 5 AND statistic = 'step_cosine'").count() > 0
    assert rows(motility_report.report(spark, f"{sf}/events.parquet", f"{tmp_path}/out")) == first


def test_report_without_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/none")
    assert motility_report.report(spark, f"{tmp_path}/none", f"{tmp_path}/out").count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"parts": 3}))
    assert _run.read_config(spark, str(tmp_path / "c.json"), directory_inventory.DEFAULTS) == directory_inventory.DEFAULTS | {"parts": 3}
    (tmp_path / "c.json").write_text(json.dumps({"part": 3}))
    with pytest.raises(ValueError, match="part"):
        _run.read_config(spark, str(tmp_path / "c.json"), directory_inventory.DEFAULTS)
    for job in (directory_inventory, motility_report):
        name = job.__name__.split(".")[-1]
        assert _run.read_config(spark, f"{REPO}/jobs/{name}.json", job.DEFAULTS) == job.DEFAULTS


def test_command_lines(sf, tmp_path):
    shutil.copytree(f"{sf}/pages.parquet", tmp_path / "pages") if os.path.isdir(f"{sf}/pages.parquet") else (os.mkdir(tmp_path / "pages"), shutil.copy(f"{sf}/pages.parquet", tmp_path / "pages"))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for args in (
        ["jobs.directory_inventory", "--config", "jobs/directory_inventory.json", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/a", "--checkpoint", f"{tmp_path}/c"],
        ["jobs.motility_report", "--config", "jobs/motility_report.json", "--events", f"{sf}/events.parquet", "--out", f"{tmp_path}/b"],
    ):
        done = subprocess.run([sys.executable, "-m", *args], cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read" in done.stderr and "wrote" in done.stderr
    assert list((tmp_path / "a" / "directories").glob("part=*")) and list((tmp_path / "b" / "statistics").glob("statistic=*"))
