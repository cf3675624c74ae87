"""Image inventories from paths and file names: profiles, scores and experiment groups of directories.

Names are rows until a directory is described by one aggregation over them; sets stay arrays and are
rendered as text only on request.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions, folder words, focus terms and file-name patterns that the inventory goes by.
IMAGE_EXTENSIONS = (".bmp", ".czi", ".gif", ".jpg", ".jpeg", ".lif", ".png", ".svs", ".tif", ".tiff")
RAW_HINTS = ("brightfield", "fluorescence", "images", "phase", "phasecontrast", "raw", "raw_images")
DERIVED_HINTS = ("bounding_boxes", "cell_segmentation_results", "cellpose", "cp_masks", "flattened", "flattenedimages", "log_transforms", "masks", "objectimages", "processed", "processed_images", "results", "segmentation")
FOCUS_TERMS = ("chemotaxis", "migration", "motility", "tracking")
EXCLUDED_TERMS = ("myco",)
MODALITIES = ("brightfield", "dead", "deadbottom", "deadtop", "fluorescence", "green", "live", "livebottom", "livetop", "phase", "phasebottom", "phasecontrast", "phasetop", "red")
NOT_EXPERIMENTS = ("digitalprojections", "metadata", "output", "processedframes")
IMAGE_CONTAINERS = ("images", "imagesorganized", "raw", "rawimages", "raw_images")
VOLUME_EXPERIMENTS = ("3dbrightfieldimages", "sum159volumetricanalysis")
FIELD_PATTERN = r"fof\d+|r\d{1,2}c\d{1,2}f\d{1,3}(?:p\d{1,4})?|sk\d{1,3}"
CELL_LINES = r"(?i)(?<![A-Za-z0-9])(?:SNU[-_]?\d+[A-Za-z0-9]*|SUM[-_]?\d+[A-Za-z0-9]*|NCI[-_]?[A-Z]{1,3}\d+[A-Za-z0-9]*|NUGC[-_]?\d+|MCF[-_]?\d+|MDA[-_]?[A-Z]{2}[-_]?\d+|HEK[-_]?\d+|U2OS|A549|HeLa|HCT[-_]?\d+)(?![A-Za-z0-9])"
Z_PLANE = r"(?i)(?<![A-Za-z0-9])z(\d{1,4})(?![A-Za-z0-9])"
TIME_POINT = r"(?i)(?<![A-Za-z0-9])t(\d{1,5})(?![A-Za-z0-9])"
ELAPSED = r"(?i)(\d{1,3})d(\d{1,2})h(\d{1,2})m"
ACQUIRED = r"(?i)(\d{4})y(\d{1,2})m(\d{1,2})d_(\d{1,2})h(\d{1,2})m"
PLATE_READER = r"(?i)r(\d{1,2})c(\d{1,2})f(\d{1,3})p(\d{1,4})(?:-ch(\d{1,2}))?"
WELL_SITE = r"(?<![A-Za-z0-9])([A-H]\d{1,2})_(\d{1,3})(?![A-Za-z0-9])"
CHANNEL = r"(?i)(?<![A-Za-z0-9])ch(\d{1,2})(?![A-Za-z0-9])"
SKIPPED_PARTS = ("", "share", "andor_lab")


def normal_token(text: Column, glue: str = "_") -> Column:
    """Lower case with runs of anything but a-z and 0-9 replaced by `glue`, none at the ends."""
    out = F.regexp_replace(F.lower(text), "[^a-z0-9]+", glue)
    return F.trim(out, F.lit(glue)) if glue else out


def _group(pattern: str, k: int) -> Column:
    got = F.regexp_extract("name", pattern, k)
    return F.when(got != "", got)


def extension() -> Column:
    """The lower-case suffix of `name` with its dot; NULL without one, or where the name only begins with a dot."""
    got = F.lower(F.regexp_extract("name", r"^.+(\.[^./]+)$", 1))
    return F.when(got != "", got)


def parsed_names(names: DataFrame) -> DataFrame:
    """(path, name) rows with what each name says; patterns that don't match give NULL.

    Instruments name their files alike in every directory, so each distinct name is parsed once.
    """
    known = _parsed(names.select(F.col("name")).distinct()).withColumnRenamed("name", "_name")
    return names.join(known, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")


def _parsed(names: DataFrame) -> DataFrame:
    """What each name says. The further groups of a pattern are looked for only where its first one is there."""

    def groups(pattern, first, *more):
        head = _group(pattern, first)
        return head, *[F.when(head.isNotNull(), _group(pattern, k)) for k in more]

    year, *rest = groups(ACQUIRED, 1, 2, 3, 4, 5)
    date = F.when(year.isNotNull(), F.format_string("%s-%s-%s %s:%s", year, *[F.lpad(x, 2, "0") for x in rest]))
    days, hours, minutes = groups(ELAPSED, 1, 2, 3)
    elapsed = F.when(days.isNotNull(), days.try_cast("int") * 1440 + hours.try_cast("int") * 60 + minutes.try_cast("int"))
    plane, reader_field, reader_channel = groups(PLATE_READER, 4, 3, 5)
    well, site = groups(WELL_SITE, 1, 2)
    channels = F.regexp_extract_all("name", F.lit(CHANNEL), 1)
    out = names.withColumns({
        "extension": extension(), "z": _group(Z_PLANE, 1), "t": _group(TIME_POINT, 1), "elapsed": elapsed, "acquired": date,
        "plane": plane, "reader_field": reader_field, "reader_channel": reader_channel, "well": F.upper(well), "site": site, "channels": channels,
    })
    # Wall-clock minutes of the date alone, so that no time zone moves a gap; a date that doesn't exist gives NULL.
    since = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(try_to_timestamp(acquired, 'yyyy-MM-dd HH:mm') AS TIMESTAMP_NTZ))")
    return out.withColumns({"minute": since.cast("bigint"), "is_image": F.coalesce(F.col("extension").isin(*IMAGE_EXTENSIONS), F.lit(False))}).withColumn("_hint", F.when(F.col("is_image"), _hints(F.col("name"))))


#: Image names of a directory that its profile keeps, the first by name.
KEPT_NAMES = 8


def _hints(text: Column) -> Column:
    """struct(derived, raw): whether a whole token of the text is a word of either list."""
    tokens = F.transform(F.split(text, r"[/\s;]+"), lambda p: normal_token(p))
    return F.struct(F.arrays_overlap(tokens, F.array(*map(F.lit, DERIVED_HINTS))).alias("derived"), F.arrays_overlap(tokens, F.array(*map(F.lit, RAW_HINTS))).alias("raw"))


def profiles(names: DataFrame) -> DataFrame:
    """One row per path: sorted distinct values of every kind, counts of names and images, and coverage of channels.

    n_timepoints adds the distinct counts of three kinds of time. image_names, z_names and t_names are the
    distinct ones among the first KEPT_NAMES rows of images and of names with a plane or a time; hints tells
    whether any image name holds a word of the two lists of origins.
    """
    rows = parsed_names(names)
    rules = {"image_names": F.col("is_image"), "z_names": F.col("z").isNotNull(), "t_names": F.coalesce(F.col("t"), F.col("elapsed").cast("string"), F.col("acquired")).isNotNull()}
    # Ranks up to KEPT_NAMES are cut before the shuffle, so a directory of any size sends a few names.
    kinds = F.explode(F.array_compact(F.array(*[F.when(rule, n) for n, rule in rules.items()])))
    placed = rows.select("path", "name", kinds.alias("_kind")).withColumn("_rank", F.row_number().over(Window.partitionBy("path", "_kind").orderBy("name"))).where(F.col("_rank") <= KEPT_NAMES)
    kept = placed.groupBy(F.col("path").alias("_path")).agg(*[F.array_sort(F.collect_set(F.when(F.col("_kind") == n, F.col("name")))).alias(n) for n in rules])
    sets = {"z_values": "z", "t_values": "t", "elapsed_minutes": "elapsed", "acquired_at": "acquired", "acquired_minutes": "minute", "planes": "plane", "wells": "well"}
    fields = F.array_compact(F.array("reader_field", "site"))
    seen = F.array_compact(F.concat("channels", F.array("reader_channel")))
    pairs = F.array_compact(F.concat(F.transform("channels", lambda c: F.when(F.col("z").isNotNull(), F.struct(c.alias("c"), F.lit("z").alias("k"), F.col("z").alias("v")))), F.array(F.when(F.col("reader_channel").isNotNull(), F.struct(F.col("reader_channel").alias("c"), F.lit("p").alias("k"), F.col("plane").alias("v"))))))
    out = rows.groupBy("path").agg(
        F.count("*").alias("n_names"), F.count_if("is_image").alias("n_images"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(fields)))).alias("fields"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(seen)))).alias("channels"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("coverage"),
        F.struct(*[F.coalesce(F.bool_or(f"_hint.{k}"), F.lit(False)).alias(k) for k in ("derived", "raw")]).alias("hints"),
    )
    out = out.join(kept, F.col("path").eqNullSafe(F.col("_path")), "left").drop("_path")
    out = out.withColumns({n: F.coalesce(F.col(n), F.array().cast("array<string>")) for n in rules})
    return out.withColumn("n_timepoints", F.size("t_values") + F.size("elapsed_minutes") + F.size("acquired_at"))


def compact(values: Column, limit: int = 12) -> Column:
    """Values joined by '; ', at most `limit` of them and then how many more there are."""
    shown = F.transform(F.slice(values, 1, limit), lambda v: v.cast("string"))
    more = F.when(F.size(values) > limit, F.array(F.format_string("...(+%d)", F.size(values) - limit))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(shown, more), "; ")


def coverage_text(limit: int = 12) -> Column:
    """channel:zN/pN of each channel, by the distinct z values and planes seen with it."""

    def one(c):
        def n(kind):
            return F.size(F.filter("coverage", lambda p: (p["c"] == c) & (p["k"] == kind)))

        z, p = F.format_string("z%d", n("z")), F.format_string("p%d", n("p"))
        return F.concat(c, F.lit(":"), F.when((n("z") > 0) & (n("p") > 0), F.concat(z, F.lit("/"), p)).when(n("z") > 0, z).when(n("p") > 0, p).otherwise("unquantified"))

    return compact(F.transform("channels", one), limit)


def spacing(values: str) -> Column:
    """struct(least, upper_median) of the gaps between ascending distinct values; NULL without a gap."""
    v = F.col(values).cast("array<bigint>")
    n = F.size(v)
    gaps = F.array_sort(F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))
    return F.when(n >= 2, F.struct(F.get(gaps, F.lit(0)).alias("least"), F.get(gaps, F.floor((n - 1) / 2).cast("int")).alias("upper_median")))


def time_spacing() -> Column:
    """struct(least, upper_median, unit): elapsed minutes where two are known, else wall-clock minutes."""
    a, b = spacing("elapsed_minutes"), spacing("acquired_minutes")
    unit = F.when(F.size("elapsed_minutes") >= 2, "elapsed_minutes").when(F.size("acquired_minutes") >= 2, "absolute_minutes")
    got = F.coalesce(a, b)
    return F.struct(got["least"].alias("least"), got["upper_median"].alias("upper_median"), unit.alias("unit"))


def origin_status(path: str = "path", hints: str = "hints") -> Column:
    """derived, raw_hint or unknown, by whole tokens of the path and of the image names."""
    own = _hints(F.col(path))
    return F.when(own["derived"] | F.col(f"{hints}.derived"), "derived").when(own["raw"] | F.col(f"{hints}.raw"), "raw_hint").otherwise("unknown")


def cell_lines(path: str = "path") -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(path, F.lit(CELL_LINES), 0), lambda c: F.translate(c, "_", "-"))))


def path_context(path: str = "path", n: int = 5) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin(*SKIPPED_PARTS))
    return F.slice(parts, F.greatest(F.size(parts) - n, F.lit(0)) + 1, n)


def excluded(path: str = "path") -> Column:
    out = F.lit(False)
    for term in EXCLUDED_TERMS:
        out = out | F.lower(path).contains(term)
    return out


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for rule, points in rules:
        total = total + F.when(rule, points).otherwise(0)
    return total


def _stepped(value: Column, *steps: tuple[int, int]) -> Column:
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def z_score(status: str = "origin", stacks: str = "n_stacks") -> Column:
    """Points for evidence of volumes."""
    n = {c: F.size(c) for c in ("z_values", "planes", "channels", "wells", "fields", "cell_lines")}
    return _stepped(n["z_values"], (2, 5), (1, 2)) + _stepped(n["planes"], (5, 2), (2, 1)) + _stepped(n["channels"], (2, 2), (1, 1)) + _points((F.col("n_images") > 0, 1), (n["wells"] + n["fields"] > 0, 1), (n["cell_lines"] > 0, 1), (F.col(stacks) > 0, 4), (F.col(status) == "derived", -3))


def tracking_score(status: str = "origin", stacks: str = "n_stacks") -> Column:
    """Points for evidence of time series."""
    n = {c: F.size(c) for c in ("channels", "wells", "fields", "cell_lines")}
    return _stepped(F.col("n_timepoints"), (5, 5), (2, 3), (1, 1)) + _stepped(n["wells"], (2, 2), (1, 1)) + _points((F.col("n_images") > 0, 1), (n["fields"] >= 2, 1), (n["channels"] > 0, 1), (n["cell_lines"] > 0, 1), (F.col(stacks) > 0, 2), (F.col(status) == "derived", -2))


STACK_LISTS = ("stack_kinds", "stack_sizes", "stack_pages", "stack_shapes", "stack_examples", "stack_errors")


def stack_profiles(probed: DataFrame) -> DataFrame:
    """Rows of probe_stacks by directory: n_stacks, the files with a stack kind, and sorted lists of what they show; errors by file name."""
    stack = F.coalesce(F.col("kind"), F.lit("")) != ""
    cut = F.element_at(F.split("path", "/"), -1)
    text = {"stack_kinds": F.col("kind"), "stack_sizes": F.col("sizes"), "stack_pages": F.col("pages").cast("string"), "stack_shapes": F.format_string("page0:%dx%d:%s", "height", "width", "dtype"), "stack_examples": cut}
    lists = [F.array_sort(F.collect_set(F.when(stack, c))).alias(n) for n, c in text.items()]
    errors = F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.concat_ws(":", cut, "error")))).alias("stack_errors")
    return probed.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.count_if(stack).cast("int").alias("n_stacks"), *lists, errors)


def scored(names: DataFrame, min_names: int = 1, stacks: DataFrame | None = None) -> DataFrame:
    """Profiles of directories that aren't excluded and have min_names names, with both scores.

    stacks: rows of stack_profiles with the paths of names; without them, or without a path's row, it has no stacks.
    """
    rows = profiles(names.where(~excluded())).where(F.col("n_names") >= min_names)
    none = F.array().cast("array<string>")
    if stacks is None:
        rows = rows.withColumns({"n_stacks": F.lit(0), **{c: none for c in STACK_LISTS}})
    else:
        rows = rows.join(stacks.select("path", "n_stacks", *STACK_LISTS), "path", "left")
        rows = rows.withColumns({"n_stacks": F.coalesce("n_stacks", F.lit(0)), **{c: F.coalesce(F.col(c), none) for c in STACK_LISTS}})
    rows = rows.withColumns({"origin": origin_status(), "cell_lines": cell_lines(), "context": path_context(), "spacing": time_spacing()})
    return rows.withColumns({"z_score": z_score(), "tracking_score": tracking_score()})


def map_count(counts: str, fallback: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    """Sum of a map's counts over image extensions; another map serves where the first is NULL or empty."""
    m = F.when(F.coalesce(F.size(counts), F.lit(0)) > 0, F.col(counts)).otherwise(F.col(fallback))
    return F.aggregate(F.transform(F.array(*map(F.lit, extensions)), lambda e: F.coalesce(F.try_element_at(m, e), F.lit(0)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)


def tracking_root(path: str = "path") -> Column:
    """The folder of the last part with a focus term and one more, unless that is a column or a modality; else the parent."""
    parts = F.split(path, "/")
    tokens = F.transform(parts, lambda p: normal_token(p, ""))
    hits = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike("|".join(FOCUS_TERMS)), i + 1)), lambda i: i.isNotNull())
    last = F.array_max(hits)
    after = F.get(tokens, last)
    keep = F.when(last.isNull(), F.size(parts) - 1).when(last >= F.size(parts), F.size(parts)).when(after.rlike(r"^col\d+$") | after.isin(*MODALITIES), last).otherwise(last + 1)
    return F.array_join(F.slice(parts, 1, keep), "/")


def volume_root(path: str = "path") -> Column:
    """The experiment folder of a volume: measurement or dated part, volume project and one more, image container, or a field's parent."""
    every = F.split(path, "/")
    plain = F.transform(every, lambda p: normal_token(p, ""))
    kept = F.coalesce(F.array_max(F.filter(F.transform(plain, lambda t, i: F.when(~t.isin(*NOT_EXPERIMENTS), i + 1)), lambda i: i.isNotNull())), F.lit(0))
    tokens = F.slice(plain, 1, kept)

    def last(rule):
        return F.array_max(F.filter(F.transform(tokens, lambda t, i: F.when(rule(t), i + 1)), lambda i: i.isNotNull()))

    dated, project, container = last(lambda t: t.rlike(r"measurement|t\d{8}")), last(lambda t: t.isin(*VOLUME_EXPERIMENTS)), last(lambda t: t.isin(*IMAGE_CONTAINERS))
    leaf = F.coalesce(F.get(tokens, kept - 1).rlike(FIELD_PATTERN), F.lit(False))

    def first_parts(n):
        return F.array_join(F.slice(every, 1, n), "/")

    return (
        F.when(dated.isNotNull(), first_parts(dated))
        .when(project.isNotNull(), first_parts(F.least(project + 1, kept)))
        .when(container.isNotNull() & ((container >= kept) | leaf), first_parts(container))
        .when(leaf, first_parts(kept - 1))
        .otherwise(F.col(path))
    )


def modality(path: str = "path") -> Column:
    """The last two of the path's last three parts that name a modality."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin(*SKIPPED_PARTS))
    tail = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3)
    hits = F.filter(tail, lambda p: normal_token(p, "").rlike("|".join(MODALITIES)))
    return F.slice(hits, F.greatest(F.size(hits) - 1, F.lit(1)), 2)


#: Directories that an experiment names as examples, the best first.
EXAMPLES = 5


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds _place, the place of each directory in its experiment."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("root").orderBy(*order)))


def _examples() -> Column:
    """The first EXAMPLES paths of an experiment, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= EXAMPLES, F.struct("_place", "path")))), lambda r: r["path"])


def tracking_groups(rows: DataFrame) -> DataFrame:
    """Experiments of scored directories (with focus: matched terms), scored by spacing, time points, size and modality."""
    rows = rows.withColumns({"root": tracking_root(), "modality": modality()})
    least = F.col("spacing.least")
    best = (least.isNull(), F.coalesce(least, F.lit(10**9)), -F.col("n_timepoints"), -F.col("n_images"), F.col("path"))
    phase = F.exists("modality", lambda m: normal_token(m, "").rlike("phase|brightfield"))
    out = _placed(rows, *best).groupBy("root").agg(
        F.count("*").alias("n_dirs"), F.sum("n_images").alias("n_images"), F.max("tracking_score").alias("best_score"), F.min(least).alias("least_spacing"), F.min("spacing.upper_median").alias("best_median_spacing"),
        F.max("n_timepoints").alias("n_timepoints"), F.bool_or(phase).alias("_phase"), F.bool_or(F.coalesce(F.lower("path").contains("chemotaxis"), F.lit(False))).alias("_chemotaxis"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("modality")))).alias("modalities"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("cell_lines")))).alias("cell_lines"), F.array_sort(F.collect_set("origin")).alias("origins"),
        _examples().alias("examples"),
    )
    quick = F.when(F.col("least_spacing").isNotNull(), F.greatest(F.lit(0), 6 - F.floor(F.col("least_spacing") / 60))).otherwise(0)
    score = quick + F.least("n_timepoints", F.lit(10)) + F.least("n_dirs", F.lit(10)) + F.when(F.col("_phase"), 3).otherwise(0) + F.when(F.col("_chemotaxis"), 2).otherwise(0)
    return out.withColumns({"group_score": score.cast("bigint"), "best_dir": F.get("examples", F.lit(0))}).drop("_phase", "_chemotaxis")


def volume_groups(rows: DataFrame) -> DataFrame:
    """Experiments of scored directories, scored by their best directory, size, planes, origin and channels."""
    rows = rows.withColumn("root", volume_root())
    best = (-F.col("z_score"), -F.greatest(F.size("z_values"), F.size("planes")), F.col("origin") == "derived", -F.col("n_images"), F.col("path"))
    out = _placed(rows, *best).groupBy("root").agg(
        F.count("*").alias("n_dirs"), F.sum("n_images").alias("n_images"), F.max("z_score").alias("best_score"), F.max(F.size("z_values")).alias("n_z"), F.max(F.size("planes")).alias("n_planes"), F.max(F.size("channels")).alias("most_channels"),
        F.count_if(F.size("channels") >= 2).alias("n_multi_channel"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"), F.array_sort(F.collect_set("origin")).alias("origins"),
        _examples().alias("examples"),
    )
    project = normal_token(F.col("root"), "").rlike("volumetricanalysis|3dbrightfield")
    score = F.col("best_score") + F.least("n_dirs", F.lit(12)) + F.least("n_z", F.lit(10)) + F.least("n_planes", F.lit(10)) + _points((F.array_contains("origins", "raw_hint"), 3), (F.array_contains("origins", "derived"), -3), (project, 4), (F.size("channels") >= 2, 2))
    return out.withColumns({"group_score": score.cast("bigint"), "best_dir": F.get("examples", F.lit(0))})


def focus_matches(paths: DataFrame, cutoff: float = 0.78) -> DataFrame:
    """Adds focus: array of struct(term, token, ratio), exact where the path holds a term, else its closest token.

    Closeness is the ratio of matching blocks of the two strings; tokens below the cutoff don't count, of
    equally close ones the last by name does. A ratio bounds the edit distance and the lengths, so only
    distinct tokens near a term are compared block by block.
    """
    terms = F.explode(F.array(*map(F.lit, FOCUS_TERMS))).alias("term")
    tokens = paths.select("path", F.explode(F.array_distinct(F.filter(F.split(F.lower("path"), "[^a-z0-9]+"), lambda t: t != ""))).alias("token"))
    pairs = tokens.select("token").distinct().select("token", terms)
    both = F.length("token") + F.length("term")
    near = (2 * F.least(F.length("token"), F.length("term")) >= cutoff * both) & (F.levenshtein("token", "term") <= (1 - cutoff) * both + 1e-9)

    def ratios(parts):
        for part in parts:
            both = list(zip(part["token"], part["term"]))
            yield part.assign(score=[difflib.SequenceMatcher(a=a, b=b).ratio() for a, b in both], ratio=[difflib.SequenceMatcher(a=b, b=a).ratio() for a, b in both])

    # Blocks depend a little on which string is first: tokens are chosen by one way and shown by the other.
    close = pairs.where(near).mapInPandas(ratios, "token string, term string, score double, ratio double").where(F.col("score") >= cutoff)
    best = tokens.join(close, "token").groupBy("path", "term").agg(F.max(F.struct("score", "token", "ratio")).alias("_b"))
    found = best.groupBy(F.col("path").alias("_path")).agg(F.map_from_entries(F.collect_list(F.struct("term", "_b"))).alias("_soft"))
    out = paths.join(found, F.col("path") == F.col("_path"), "left").drop("_path")

    def one(term):
        soft = F.try_element_at("_soft", F.lit(term))
        exact = F.struct(F.lit(term).alias("term"), F.lit(term).alias("token"), F.lit(1.0).alias("ratio"))
        return F.when(F.lower("path").contains(term), exact).when(soft.isNotNull(), F.struct(F.lit(term).alias("term"), soft["token"].alias("token"), soft["ratio"].alias("ratio")))

    return out.withColumn("focus", F.array_compact(F.array(*[one(t) for t in FOCUS_TERMS]))).drop("_soft")


def tracking_qc(rows: DataFrame, keys: Sequence[str], thresholds: Sequence[int] = (3, 5, 10, 25), columns: Sequence[str] = ()) -> DataFrame:
    """Quality of tracking tables of text columns frame, track, lineage, parent and merger, by key.

    A frame that is no integer counts as a row without a frame; track -1 counts as a track; parents and
    mergers leave out '', '0' and '-1'; missing_<column> counts NULL, '' and nan.
    """
    frame = F.expr("try_cast(frame AS BIGINT)")
    rows = rows.withColumn("_f", frame)

    def real(c):
        return F.col(c).isNotNull() & (F.col(c) != "")

    def named(c):
        return real(c) & ~F.col(c).isin("0", "-1")

    missing = {c: F.col(c).isNull() | F.col(c).isin("", "nan", "NaN") for c in columns}
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_distinct("_f").alias("n_frames"), F.min("_f").alias("min_frame"), F.max("_f").alias("max_frame"), F.count_distinct(F.when(real("lineage"), F.col("lineage"))).alias("n_lineages"),
        F.count_distinct(F.when(real("track") & named("parent"), F.struct("track", "parent"))).alias("n_parent_links"), F.count_distinct(F.when(named("merger"), F.col("merger"))).alias("n_mergers"), *[F.count_if(m).alias(f"missing_{c}") for c, m in missing.items()],
    )
    lengths = rows.where(real("track") & F.col("_f").isNotNull()).groupBy(*keys, "track").agg(F.count_distinct("_f").alias("n"))
    lengths = lengths.groupBy(*keys).agg(F.count("*").alias("n_tracks"), F.percentile("n", F.lit(0.5)).alias("median_length"), F.max("n").alias("max_length"), *[F.count_if(F.col("n") >= t).alias(f"n_tracks_{t}") for t in thresholds])
    per_frame = rows.where("_f IS NOT NULL").groupBy(*keys, "_f").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.percentile("n", F.lit(0.5)).alias("median_objects"), F.min("n").alias("min_objects"), F.max("n").alias("max_objects"))
    return base.join(lengths, list(keys), "left").join(per_frame, list(keys), "left").fillna(0, ["n_tracks", *[f"n_tracks_{t}" for t in thresholds]])


def stack_fields(names: DataFrame, channels: Sequence[str] = ("00", "01", "02")) -> DataFrame:
    """Fields of z stacks by path and prefix: planes that every channel has, of names like <prefix>_z<n>_ch<n>.tif."""
    pattern = r"^(.*)_z(\d+)_ch(\d+)\.tif$"
    rows = names.select("path", *[F.regexp_extract("name", pattern, k).alias(c) for k, c in ((1, "prefix"), (2, "z"), (3, "ch"))]).where(F.col("z") != "")
    rows = rows.where(F.col("ch").isin(*channels)).groupBy("path", "prefix", F.col("z").cast("int").alias("z")).agg(F.count_distinct("ch").alias("n"))
    full = rows.where(F.col("n") == len(channels)).groupBy("path", "prefix").agg(F.count("*").alias("n_z"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return full


def below_root(path: str = "path", root: str = "root") -> Column:
    """The path relative to a folder above it; empty for the folder itself or a path elsewhere."""
    inside = F.startswith(F.col(path), F.concat(F.col(root), F.lit("/")))
    return F.when(inside, F.substring(F.col(path), F.length(root) + 2, F.length(path))).otherwise("")


#: Cell lines that sample paths are told apart by.
SAMPLE_LINES = ("nci-n87", "mdamb")


def sample_line(path: str = "path") -> Column:
    """The known cell line that a sample's path names; NULL for another."""
    out = F.when(F.lit(False), "")
    for line in SAMPLE_LINES:
        out = out.when(F.lower(path).contains(line), line)
    return out


def safe_id(column: Column) -> Column:
    """Text with every run of what isn't a letter, digit, dot, dash or underscore made one underscore."""
    return F.regexp_replace(column, "[^A-Za-z0-9._-]+", "_")


def without_suffix(name: Column, suffixes: Sequence[str]) -> Column:
    """A file's base name without the first of the suffixes that it ends with."""
    out = F.element_at(F.split(name, "/"), -1)
    base, chosen = out, out
    for s in reversed(suffixes):
        chosen = F.when(F.endswith(base, F.lit(s)), F.substring(base, F.lit(1), F.length(base) - len(s))).otherwise(chosen)
    return chosen


def focus_texts(focus: str = "focus") -> dict[str, Column]:
    """What focus_matches found as texts: the best ratio, the best term with its token, and all matches."""
    best = F.aggregate(focus, F.lit(None).cast("struct<term:string,token:string,ratio:double>"), lambda a, m: F.when(a.isNull() | (m["ratio"] > a["ratio"]), m).otherwise(a))
    every = F.transform(focus, lambda m: F.when(m["token"] == m["term"], F.concat(m["term"], F.lit(":exact"))).otherwise(F.concat_ws(":", m["term"], F.lit("soft"), m["token"], F.format_string("%.2f", m["ratio"]))))
    return {
        "tracking_focus_score": F.when(best.isNotNull(), F.format_string("%.2f", best["ratio"])), "tracking_focus_best_match": F.when(best.isNotNull(), F.concat_ws(":", best["term"], best["token"])), "tracking_focus_matches": F.array_join(every, "; "),
    }


def candidate_rows(rows: DataFrame, score: str, example_limit: int = KEPT_NAMES, records: DataFrame | None = None) -> DataFrame:
    """Scored directories as flat rows of a candidate table, in the columns and order of its file.

    Counts are numbers, NULL where unknown (blank in a written table). Examples are names with a plane for
    the z score and with a time for the tracking score, else image names. records: directory records, for
    status, entries, files and the image-like count; without one a path has the count of its names. A
    column focus, of focus_matches, fills the focus columns.
    """
    if records is None:
        rows = rows.withColumns({"status": F.lit(""), "Nentries": F.lit(None).cast("bigint"), "Nfiles": F.lit(None).cast("bigint"), "_like": F.lit(None).cast("bigint")})
    else:
        known = records.select("path", F.coalesce("status", F.lit("")).alias("status"), "Nentries", "Nfiles", map_count("extension_counts", "sampleExtensions").alias("_like")).dropDuplicates(["path"])
        rows = rows.join(known, "path", "left").withColumn("status", F.coalesce("status", F.lit("")))
    named = F.col("z_names" if score == "z_score" else "t_names")
    examples = F.when(F.size(named) > 0, named).otherwise(F.col("image_names"))
    times = F.array_sort(F.concat(F.col("t_values"), F.transform("elapsed_minutes", lambda v: v.cast("string")), F.col("acquired_at")))
    focus = focus_texts() if "focus" in rows.columns else {c: F.lit("") for c in ("tracking_focus_score", "tracking_focus_best_match", "tracking_focus_matches")}
    out = {
        "score": F.col(score), "path": F.col("path"), "status": F.col("status"), "raw_or_derived": F.col("origin"), "Nentries": F.col("Nentries"), "Nfiles": F.col("Nfiles"), "image_like_count": F.coalesce("_like", "n_images"), "sample_image_count": F.col("n_images"),
        "stack_tiff_count_sampled": F.col("n_stacks"), "stack_tiff_kind": compact(F.col("stack_kinds")), "stack_tiff_ome_sizes": compact(F.col("stack_sizes")), "stack_tiff_pages": compact(F.col("stack_pages")), "stack_tiff_shapes": compact(F.col("stack_shapes")),
        "distinct_z": F.size("z_values"), "distinct_planes": F.size("planes"), "distinct_timepoints": F.col("n_timepoints"), "min_time_spacing_minutes": F.col("spacing.least"), "median_time_spacing_minutes": F.col("spacing.upper_median"), "time_spacing_unit": F.col("spacing.unit"),
        "distinct_wells": F.size("wells"), "distinct_fields_or_sites": F.size("fields"), "channels": compact(F.col("channels")), "distinct_channels": F.size("channels"), "has_multiple_channels": (F.size("channels") >= 2).cast("int"), "channel_z_or_plane_coverage": coverage_text(),
        "cell_line_hits": F.array_join("cell_lines", "; "), **focus, "path_context": F.array_join("context", " / "), "z_values": compact(F.col("z_values")), "time_values": compact(times),
        "stack_tiff_examples": F.array_join(F.slice("stack_examples", 1, example_limit), "; "), "stack_tiff_errors": F.array_join("stack_errors", "; "), "examples": F.array_join(F.slice(examples, 1, example_limit), "; "),
    }
    return rows.select(*[c.alias(n) for n, c in out.items()])
