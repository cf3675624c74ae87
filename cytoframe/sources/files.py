"""Listings of directory trees."""

from __future__ import annotations

import os
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.sources.tables import DIRECTORY

def suffix(name: str) -> str:
    return "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else "[no extension]"


def list_directory(path: str, timeout: float = 2.0, sample: int = 50) -> tuple[dict, list[str]]:
    """A directory's record and its subfolders; links are not followed.

    The listing runs in a process of its own, so that a dead mount costs the timeout and no more; it is
    then `timeout_blackhole` with a sample of names, as far as one comes in the same time, and isn't
    descended into. Any other failure is `read_error`.
    """
    record = {"path": path, "status": "ok", "stderr": None}
    command = ["find", path, "-mindepth", "1", "-maxdepth", "1", "-printf", "%y\\t%f\\0"]
    try:
        got = subprocess.run(command, capture_output=True, timeout=timeout)
    except subprocess.TimeoutExpired as late:
        names = [p.split("\t", 1)[1] for p in (late.stdout or b"").decode("utf-8", "replace").split("\0")[:sample] if "\t" in p]
        return record | {"status": "timeout_blackhole", "sampleNames": names, "sampleExtensions": _counts(map(suffix, names))}, []
    if got.returncode:
        return record | {"status": "read_error", "sampleNames": [], "sampleExtensions": {}, "stderr": got.stderr.decode("utf-8", "replace")[:500]}, []
    entries = sorted(tuple(p.split("\t", 1)) for p in got.stdout.decode("utf-8", "replace").split("\0") if p)
    names = sorted(n for _, n in entries)
    files = [n for t, n in entries if t == "f"]
    folders = sorted(n for t, n in entries if t == "d")
    record |= {"Nentries": len(entries), "Ndirs": len(folders), "Nfiles": len(files), "type_counts": _counts(t for t, _ in entries), "extension_counts": _counts(map(suffix, files)), "sampleNames": names[:sample], "sampleExtensions": _counts(map(suffix, names[:sample]))}
    return record, [os.path.join(path, f) for f in folders]


def _counts(values) -> dict[str, int]:
    out: dict[str, int] = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return dict(sorted(out.items()))


def walk(spark: SparkSession, root: str, timeout: float = 2.0, sample: int = 50) -> DataFrame:
    """Records of every directory under a root that all executors mount, level by level.

    A level is one job over its folders; only the record table and the folders of the next level exist between
    jobs. It ends where a level has no folders; links to folders are not followed.
    """
    from cytoframe.functions.session import durable, partitions

    schema = f"{DIRECTORY}, children array<string>"
    names = [f.strip().split(" ")[0] for f in re.sub(r"<[^>]*>", "", DIRECTORY).split(",")]

    def visit(parts):
        for part in parts:
            rows = []
            for path, depth in zip(part["path"], part["depth"]):
                record, children = list_directory(path, timeout, sample)
                record |= {"relative_path": os.path.relpath(path, root), "depth": int(depth)}
                rows.append({**{n: record.get(n) for n in names}, "children": children})
            yield pd.DataFrame(rows, columns=[*names, "children"]).astype({c: "Int64" for c in ("depth", "Nentries", "Ndirs", "Nfiles")})

    level = spark.createDataFrame([(root, 0)], "path string, depth int")
    out = None
    while True:
        found = durable(level.repartition(partitions(spark), "path").mapInPandas(visit, schema))
        out = found if out is None else out.unionByName(found)
        level = found.select(F.explode("children").alias("path"), (F.col("depth") + 1).cast("int").alias("depth"))
        if level.isEmpty():
            break
    return out.drop("children")
