"""Readers and writers of assay tables: JSONL records, delimited text, manifests, plate maps, bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoframe.sources.adapters import DOSES

#: A directory record; maps are declared, as inference would make them structs.
DIRECTORY = (
    "path string, relative_path string, depth bigint, status string, Nentries bigint, Ndirs bigint, Nfiles bigint, type_counts map<string,bigint>,"
    " sampleNames array<string>, sampleExtensions map<string,bigint>, extension_counts map<string,bigint>, stderr string"
)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, or an error that lists what is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).json(path)


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """All columns as text, an empty field as NULL."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def read_field_tables(spark: SparkSession, pattern: str, root: str) -> DataFrame:
    """CSV files under root with cell_line (the first folder below root) and field_id (the name before `_CSV-Table_`, else its stem)."""
    rows = read_delimited(spark, pattern, ",").withColumn("_file", F.col("_metadata.file_path"))
    below = F.split(F.regexp_replace("_file", r"^.*?" + root.strip("/").replace(".", r"\.") + "/", ""), "/")
    name = F.element_at(F.split("_file", "/"), -1)
    field = F.when(name.contains("_CSV-Table_"), F.substring_index(name, "_CSV-Table_", 1)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return rows.withColumns({"cell_line": F.get(below, F.lit(0)), "field_id": field}).drop("_file")


def bind_with_source(spark: SparkSession, paths: Sequence[str], sep: str = "\t") -> DataFrame:
    """Tables bound by column name, missing columns NULL, with source_file, the base name of each row's file."""
    out = None
    for path in paths:
        one = read_delimited(spark, path, sep).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_manifests(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    return require_columns(read_delimited(spark, path, ","), columns).select(*columns).distinct()


def object_context(distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object distances under common names, and per (site_id, frame) the labelled area and number of objects."""
    rows = distances.select("site_id", F.col("frame").cast("int").alias("frame"), F.col("cpsam_label").cast("bigint").alias("label"), F.col("nearest_empty_gap_px").cast("double").alias("nearest_gap"), F.col("nearest_mask_center_distance_px").cast("double").alias("nearest_distance"), F.col("cpsam_area_px").cast("double").alias("area"))
    return rows, rows.groupBy("site_id", "frame").agg(F.sum("area").alias("total_area"), F.count("*").alias("n_objects"))


def directory_failure(path: str, status: str, sample: Sequence[str], stderr: str | None) -> dict:
    """A record of a directory that could not be listed: no counts, only what a sample shows."""
    extensions: dict[str, int] = {}
    for name in sample:
        suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else "[no extension]"
        extensions[suffix] = extensions.get(suffix, 0) + 1
    return {"path": path, "status": status, "sampleNames": list(sample), "sampleExtensions": extensions, "stderr": stderr}


def plate_layout(spark: SparkSession) -> DataFrame:
    """The 96 wells of the default plate: ploidy by row, dose by column; outer columns have neither."""
    grid = spark.range(8).select(F.col("id").alias("r")).crossJoin(spark.range(1, 13).select(F.col("id").cast("int").alias("plate_col")))  # 8 x 12
    row = F.char(F.col("r") + 65)
    inner = F.col("plate_col").between(2, 11)
    dose = F.when(inner, F.element_at(F.array(*map(F.lit, DOSES)), F.when(inner, F.col("plate_col") - 1).otherwise(1)))
    ploidy = F.when(inner & (F.col("r") < 4), "2N").when(inner, "4N")
    out = grid.select(row.alias("plate_row"), "plate_col", F.concat(row, F.col("plate_col").cast("string")).alias("well"), ploidy.alias("ploidy"), dose.alias("dose"))
    return out.withColumn("condition_id", F.when(F.col("ploidy").isNotNull(), condition_id()))


def plain_number(column: Column) -> Column:
    """A number as text without trailing zeros: 100, 12.5, 3.125."""
    return F.regexp_replace(F.format_string("%.6f", column), r"\.?0+$", "")


def condition_id(ploidy: str = "ploidy", dose: str = "dose") -> Column:
    return F.concat(F.col(ploidy), F.lit("_gem_"), F.replace(plain_number(F.col(dose)), F.lit("."), F.lit("p")), F.lit("nM"))


def dose_label(dose: str = "dose") -> Column:
    return F.concat(plain_number(F.col(dose)), F.lit(" nM"))


def melt_plate(grid: DataFrame, row: str) -> DataFrame:
    """(well, value) of a plate grid with a column of row letters and a column for each number; empty cells go."""
    columns = [c for c in grid.columns if c != row]
    return grid.unpivot([row], columns, "column", "value").where("value IS NOT NULL AND value <> ''").select(F.concat(row, "column").alias("well"), "value")


def parse_treatment(value: str = "value") -> tuple[Column, Column]:
    """(ploidy, dose) of a cell such as `2N: 12.5 nM`; NULL where the text says neither."""
    ploidy, dose = F.regexp_extract(value, r"^(2N|4N):", 1), F.regexp_extract(value, r":\s*([0-9.]+)\s*nM", 1)
    return F.when(ploidy != "", ploidy), dose.try_cast("double")


def condition_grid(spark: SparkSession) -> DataFrame:
    ploidies = spark.createDataFrame([("2N",), ("4N",)], "ploidy string")
    doses = spark.createDataFrame([(d,) for d in DOSES], "dose double")
    return ploidies.crossJoin(doses).withColumn("token", F.concat_ws(":", "ploidy", plain_number(F.col("dose"))))  # 2 x 10


def fit_manifest(df: DataFrame, constants: dict | None = None) -> DataFrame:
    """One numbered job per known condition, in the order of ploidy and dose, with constant columns."""
    jobs = df.select("ploidy", "dose").where("ploidy IS NOT NULL AND dose IS NOT NULL").distinct()
    out = jobs.withColumn("job_id", F.row_number().over(Window.orderBy("ploidy", "dose")))  # conditions, not rows
    return out.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


def parse_conditions(spark: SparkSession, text: str) -> DataFrame:
    """`2N:0,4N:25` as rows (ploidy, dose)."""
    rows = [t.split(":") for t in text.split(",") if t.strip()]
    return spark.createDataFrame([(p.strip(), float(d)) for p, d in rows], "ploidy string, dose double")


def frames_in(text: str, column: str = "frame") -> Column:
    """A filter from `all`, `a:b` (both ends in) or `a,b,c`."""
    if text == "all":
        return F.lit(True)
    if ":" in text:
        a, b = map(int, text.split(":"))
        return F.col(column).between(a, b)
    return F.col(column).isin(*map(int, text.split(",")))


def number_list(text: str, kind=int) -> list:
    return sorted({kind(t) for t in text.split(",") if t.strip()})


def site_id(name: Column) -> Column:
    """The site of a mask or stack file name; NULL if it is no TIFF."""
    base = F.element_at(F.split(name, "/"), -1)
    got = F.regexp_extract(base, r"^(.+?)(_cpsam_masks)?\.tiff?$", 1)
    return F.when(got != "", got)


def well_order(name: Column) -> list[Column]:
    """Keys that sort names by well, then by position as a number, then by name."""
    return [F.regexp_extract(name, r"^([A-H]\d{1,2})_", 1), F.regexp_extract(name, r"^[A-H]\d{1,2}_(\d+)", 1).try_cast("int"), name]


def site_manifest(files: DataFrame, partners: Sequence[DataFrame]) -> DataFrame:
    """Sites of `name` for which every partner table of names has a file too, numbered from 1 by name."""
    from cytoframe.operators.summaries import ranked

    rows = files.select("name", site_id(F.col("name")).alias("site_id")).where("site_id IS NOT NULL")
    for other in partners:
        rows = rows.join(other.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("site_id")).distinct(), "site_id", "left_semi")
    return ranked(rows, ["name"]).withColumn("file_index", (F.col("rank") + 1).cast("int")).drop("rank", "total")


def split_list(column: str, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(column, sep), lambda t: F.trim(t)), lambda t: t != "")


def join_distinct(column: str, limit: int = 16) -> Column:
    """Items of an array of `;` lists in order of first sight, at most `limit`, then how many more."""
    items = F.array_distinct(F.flatten(F.transform(column, lambda v: F.filter(F.transform(F.split(v, ";"), lambda t: F.trim(t)), lambda t: t != ""))))
    more = F.when(F.size(items) > limit, F.array(F.format_string("...(+%d)", F.size(items) - limit))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(items, 1, limit), more), "; ")


def write_delimited(df: DataFrame, path: str, columns: Sequence[str], sep: str = "\t") -> None:
    """Columns in the given order; arrays are joined by '; ' and NULL is an empty field."""
    shown = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.select(*columns).dtypes]
    df.select(*shown).write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="", emptyValue="")


def write_records(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """JSON lines of whole records and a table of some of their columns, beside each other."""
    df.write.mode("overwrite").json(f"{path}/records")
    write_delimited(df, f"{path}/table", columns)


def write_bundle(path: str, **members: DataFrame) -> None:
    """Named tables as one folder of Parquet folders."""
    for name, df in members.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows; files of other columns stay as they are and are united when read."""
    df.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def still_to_do(jobs: DataFrame, done: DataFrame, keys: Sequence[str], statuses: Sequence[str] = ("ok", "skipped_existing")) -> DataFrame:
    """Jobs without a finished run in the log."""
    return jobs.join(done.where(F.col("status").isin(*statuses)).select(*keys).distinct(), list(keys), "left_anti")


def usable_results(log: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finished runs whose output is among the files; where no run is, the keys of the files themselves."""
    kept = log.where(F.col("status").isin("ok", "skipped_existing")).join(files.select(*keys).distinct(), list(keys), "left_semi")
    return kept.select(*keys) if not kept.isEmpty() else files.select(*keys).distinct()


def shell_quoted(column: str) -> Column:
    """Text as one shell word."""
    c = F.col(column).cast("string")
    return F.when(c.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def command(program: str, options: dict[str, str]) -> Column:
    """A command line from option names and the columns that hold their values."""
    return F.concat_ws(" ", F.lit(program), *[F.concat(F.lit(f"--{k} "), shell_quoted(c)) for k, c in options.items()])


def flat_tracks(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row per point of tracks with parallel arrays; the other columns repeat."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("_p")).select(*rest, *[F.col(f"_p.{a}").alias(a) for a in arrays])


def elapsed_label(frame: str = "frame", hours: float = 2, base: int = 0) -> Column:
    """Time since the first frame as `01d04h00m`; frames are `hours` apart and count from `base`."""
    since = ((F.col(frame) - base) * hours).cast("bigint")
    return F.format_string("%02dd%02dh00m", F.floor(since / 24).cast("bigint"), F.pmod(since, F.lit(24)))


def isolated_tracks(spark: SparkSession, paths: Sequence[str], wells: Sequence[str] | None = None, sep: str = "\t") -> DataFrame:
    """Tables of isolated tracks bound by name, each row with source_file.

    split_track_id gets the name in `file` before it; a missing well is read from that name; rows without
    a frame, a place or a track are left out; wells keeps rows of those wells by either. Numbers are cast.
    """
    rows = require_columns(bind_with_source(spark, paths, sep), ["file", "well", "site", "split_track_id", "frame", "x", "y"])
    named = F.regexp_extract("file", r"^[A-H][0-9]{1,2}", 0)
    rows = rows.withColumn("well_from_file", F.when(named != "", named))
    rows = rows.withColumns({
        "well": F.coalesce("well", "well_from_file"), "site": F.col("site").try_cast("int"), "split_track_id": F.when(F.col("split_track_id").isNotNull(), F.concat_ws("::", "file", "split_track_id")),
        **{c: F.col(c).try_cast("double") for c in ("frame", "x", "y")},
    })
    rows = rows.dropna(subset=["frame", "x", "y", "split_track_id"])
    return rows if wells is None else rows.where(F.col("well_from_file").isin(*wells) | F.col("well").isin(*wells))


#: Columns that combined tracks keep, with their kinds.
LIGHT = "source string, ploidy string, dose double, dose_label string, site_id string, track_id string, frame int, track_step int, x double, y double"


def light_tracks(spark: SparkSession, df: DataFrame | None, kinds: str = LIGHT) -> DataFrame:
    """The light columns of tracks; a typed empty table where there are none or a column is missing."""
    names = [c.strip().split(" ")[0] for c in kinds.split(",")]
    if df is None or not set(names) <= set(df.columns):
        return spark.createDataFrame([], kinds)
    return df.select(*[F.col(n).cast(k.strip().split(" ")[1]).alias(n) for n, k in zip(names, kinds.split(","))])


def in_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Adds batch, from 1: rows of each key cut in batches of `size` in the given order; rows of a batch share a partition."""
    from cytoframe.operators.summaries import ranked

    rows = ranked(df, order, keys).withColumn("batch", (F.floor(F.col("rank") / size) + 1).cast("int")).drop("rank", "total")
    return rows.repartition(*keys, "batch")
