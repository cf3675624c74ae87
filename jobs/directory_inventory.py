"""Inventory of directories from records that keep landing.

Pages land as Parquet files. Each run takes the files that its checkpoint hasn't seen, writes their
distinct (directory, name) rows, and describes again the directories of the parts that got rows:
names, images, extensions, origin and both scores. Run again without new files it changes nothing.

    python -m jobs.directory_inventory --config jobs/directory_inventory.json --pages DIR --out DIR --checkpoint DIR

Under --out: names/batch=N/part=P, the names of each micro-batch; directories/part=P, the inventory;
summarised, the batches that the inventory holds. A run that stopped anywhere is made good by the next:
a batch writes its own folder, an unfinished part is written anew, and a batch counts as done only at the end.
"""

from __future__ import annotations

import uuid

from jobs._run import command_line, logger, read_if_there
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions.session import shared_dir
from cytoframe.operators import inventory as I
from cytoframe.plans import inventory as PI

log = logger("directory_inventory")
#: parts: folders that directories are dealt to by a hash; files_per_batch: landed files of a micro-batch; min_names: names of a directory that is listed.
DEFAULTS = {"parts": 16, "files_per_batch": 64, "min_names": 1}
COLUMNS = ("path", "drive", "n_names", "n_images", "extensions", "origin", "context", "z_score", "tracking_score")


def place(url: str = "url") -> tuple[Column, Column]:
    """(directory, name) of an address: host and folders as a path, and its last part, without query, fragment or a slash at the end."""
    plain = F.regexp_replace(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "/")
    parts = F.filter(F.split(plain, "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.concat(F.lit("/"), F.array_join(folders, "/")), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def names_of(pages: DataFrame) -> DataFrame:
    """Distinct (path, name) of pages (url); addresses that are null or hold nothing are left out, a host alone is a directory with an empty name."""
    path, name = place()
    return pages.select(path.alias("path"), name.alias("name")).where("path <> '/'").distinct()


def describe(names: DataFrame, min_names: int = 1) -> DataFrame:
    """One row a directory of distinct (part, path, name) rows."""
    found = names.select("part", "path", F.coalesce(I.extension(), F.lit("[no extension]")).alias("e")).groupBy("part", "path", "e").agg(F.count("*").alias("n"))
    texts = found.groupBy("part", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "n"))), lambda x: F.concat_ws("=", x["e"], x["n"].cast("string"))), "; ").alias("extensions"))
    scored = I.scored(names.select("path", "name"), min_names)
    drive = F.get(F.split("path", "/"), F.lit(1)).alias("drive")
    kept = scored.select("path", drive, "n_names", "n_images", "origin", F.array_join("context", " / ").alias("context"), "z_score", "tracking_score")
    return kept.join(texts, "path").select("part", *COLUMNS)


def inventory(spark: SparkSession, pages: str, out: str, checkpoint: str, parts: int = 16, files_per_batch: int = 64, min_names: int = 1) -> DataFrame:
    """Takes what has landed under `pages`, a folder or a pattern, since the last run and returns the whole inventory. parts must stay as it was."""
    landed = read_if_there(spark, pages)
    if landed is None:
        log.info("nothing has landed under %s", pages)
        return _whole(spark, out)

    def write(batch: DataFrame, number: int) -> None:
        dealt = names_of(batch).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
        dealt.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/names/batch={number}")

    stream = spark.readStream.schema(landed.select("url").schema).option("maxFilesPerTrigger", files_per_batch).parquet(pages)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new pages of %s in %d batches", sum(p.numInputRows for p in query.recentProgress), pages, sum(p.numInputRows > 0 for p in query.recentProgress))

    names, done = read_if_there(spark, f"{out}/names"), read_if_there(spark, f"{out}/summarised")
    if names is not None:
        fresh = names.select("batch", "part").distinct() if done is None else names.select("batch", "part").distinct().join(done, "batch", "left_anti")
        fresh = fresh.collect()  # a row for each new batch and part
        if fresh:
            touched = sorted({r["part"] for r in fresh})
            rows = describe(names.where(F.col("part").isin(touched)).select("part", "path", "name").distinct(), min_names)
            rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/directories")
            spark.createDataFrame([(b,) for b in sorted({r["batch"] for r in fresh})], "batch int").coalesce(1).write.mode("append").parquet(f"{out}/summarised")
            log.info("wrote %d of %d parts of %s/directories", len(touched), parts, out)
    return _whole(spark, out)


def _whole(spark: SparkSession, out: str) -> DataFrame:
    table = read_if_there(spark, f"{out}/directories")
    if table is None:
        return spark.createDataFrame([], "path string, drive string, n_names long, n_images long, extensions string, origin string, context string, z_score int, tracking_score int")
    return table.select(*COLUMNS)


def job1_directory_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all pages, run twice into one new folder. A stream reads one file by a pattern only."""
    folder = f"{shared_dir(spark)}/inventory-{uuid.uuid4()}"
    for _ in range(2):
        found = inventory(spark, f"{sf_dir}/pages.parque[t]", f"{folder}/out", f"{folder}/checkpoint")
    return found


_PAGES_SQL = r"""inventory AS (
  SELECT DISTINCT '/' || array_to_string(ps[1 : greatest(len(ps) - 1, 1)], '/') AS path, CASE WHEN len(ps) > 1 THEN ps[-1] ELSE '' END AS name
  FROM (SELECT [x for x in string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '/'), '/') if x <> ''] AS ps FROM pages) WHERE len(ps) > 0)"""
SQL = PI.with_names(_PAGES_SQL, """, xs AS (SELECT path, string_agg(e || '=' || n, '; ' ORDER BY e) AS extensions FROM (SELECT path, coalesce(ext, '[no extension]') AS e, count(*) AS n FROM pr GROUP BY ALL) GROUP BY path)
  SELECT path, parts[1] AS drive, n_names, n_images, extensions, origin, array_to_string(parts[greatest(len(parts) - 4, 1):], ' / ') AS context, z_score, tracking_score FROM scd JOIN xs USING (path)""")

if __name__ == "__main__":
    command_line(__doc__, ("pages", "out", "checkpoint"), DEFAULTS, inventory)
