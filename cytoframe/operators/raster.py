"""Label rasters as pixel rows (frame, y, x, label): objects, boundaries, contacts, overlaps, stitching.

Only labelled pixels are rows; background is the absence of one. Contacts and overlaps are equi-joins
of shifted pixels, so the work follows the labelled area and each frame may span many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.session import durable, partitions
from cytoframe.operators.graph import components
from cytoframe.operators.summaries import ranked

#: Neighbours looked at from a pixel; the reversed ones follow by symmetry.
OFFSETS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}


def objects(px: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Area, half-open bounding box and centroid of each object."""
    return px.groupBy(*keys, "label").agg(
        F.count("*").alias("area"),
        F.min("y").alias("y_min"),
        (F.max("y") + 1).alias("y_end"),
        F.min("x").alias("x_min"),
        (F.max("x") + 1).alias("x_end"),
        F.avg("y").alias("centroid_y"),
        F.avg("x").alias("centroid_x"),
    )


def boundary(px: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Pixels with one of their four neighbours outside the object; the raster's own edge doesn't count as inside."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    reach = px.select(*keys, "label", "y", "x", steps.alias("_s")).select(*keys, "label", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    # A pixel is inner when all four neighbours of its label reach it.
    inner = reach.groupBy(*keys, "label", "y", "x").agg(F.count("*").alias("_n")).where("_n = 4")
    return px.join(inner, [*keys, "label", "y", "x"], "left_anti")


def touching(px: DataFrame, connectivity: int = 8, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, label_a, label_b, contacts): pairs of objects with adjacent pixels, label_a < label_b."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in OFFSETS[connectivity]]))
    shifted = px.select(*keys, F.col("label").alias("_other"), "y", "x", steps.alias("_s")).select(*keys, "_other", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    met = px.join(shifted, [*keys, "y", "x"]).where("label <> _other")
    return met.groupBy(*keys, F.least("label", "_other").alias("label_a"), F.greatest("label", "_other").alias("label_b")).agg(F.count("*").alias("contacts"))


def overlap_links(px: DataFrame, plane: str = "frame", max_dz: int = 1, min_fraction: float = 0.35) -> DataFrame:
    """Links between objects of planes up to max_dz apart whose overlap is min_fraction of the smaller one.

    Areas count the pixels of a label over the whole stack, as labels are unique in it.
    """
    areas = px.groupBy("label").agg(F.count("*").alias("area"))
    ahead = px.select(F.col(plane).alias("z_from"), "y", "x", F.col("label").alias("label_from"), F.explode(F.sequence(F.lit(1), F.lit(max_dz))).alias("dz")).withColumn("z_to", F.col("z_from") + F.col("dz"))
    later = px.select(F.col(plane).alias("z_to"), "y", "x", F.col("label").alias("label_to"))
    shared = ahead.join(later, ["z_to", "y", "x"]).groupBy("z_from", "z_to", "dz", "label_from", "label_to").agg(F.count("*").alias("intersection"))
    for side in ("from", "to"):
        shared = shared.join(areas.select(F.col("label").alias(f"label_{side}"), F.col("area").alias(f"area_{side}")), f"label_{side}")
    small = F.least("area_from", "area_to")
    shared = shared.withColumns({"overlap_fraction": F.col("intersection") / small, "iou": F.col("intersection") / (F.col("area_from") + F.col("area_to") - F.col("intersection"))})
    return shared.where(F.col("overlap_fraction") >= min_fraction)


def stitch(px: DataFrame, links: DataFrame) -> DataFrame:
    """(label, object_id) of every label: components of the links, numbered from 1 by their smallest label."""
    labels = px.select("label").distinct()
    roots = components(links.select(F.col("label_from").alias("u"), F.col("label_to").alias("v")))
    owned = labels.join(roots.withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.coalesce("root", "label"))
    numbers = ranked(owned.select("root").distinct(), ["root"]).select("root", (F.col("rank") + 1).alias("object_id"))
    return owned.join(numbers, "root").select("label", "object_id")


def stitched_objects(px: DataFrame, owner: DataFrame, plane: str = "frame") -> DataFrame:
    """Area, planes, centroid and source labels of each stitched object; planes are listed from 1."""
    rows = px.join(owner, "label")
    return rows.groupBy("object_id").agg(
        F.count_distinct("label").alias("n_masks"),
        F.count_distinct(plane).alias("n_slices"),
        F.min(plane).alias("z_min"),
        F.max(plane).alias("z_max"),
        F.array_join(F.transform(F.array_sort(F.collect_set(plane)), lambda z: (z + 1).cast("string")), ";").alias("z_list"),
        F.count("*").alias("area"),
        F.avg("y").alias("centroid_y"),
        F.avg("x").alias("centroid_x"),
        F.array_join(F.transform(F.array_sort(F.collect_set("label")), lambda x: x.cast("string")), ";").alias("source_labels"),
    )


def relabel(px: DataFrame, plane: str = "frame") -> DataFrame:
    """(plane, label, new_label): labels numbered from 1 without gaps, plane after plane."""
    numbered = ranked(px.select(plane, "label").distinct(), [plane, "label"])
    return numbered.select(plane, "label", (F.col("rank") + 1).alias("new_label"))


def lookup(points: DataFrame, px: DataFrame, keys: Sequence[str] = ("frame",), base: int = 1) -> DataFrame:
    """Adds the label of the pixel under each point, NULL on background.

    Coordinates are rounded half to even and count from `base`; rasters count from 0.
    """
    spot = {"_y": (F.rint("y") - base).cast("int"), "_x": (F.rint("x") - base).cast("int")}
    cells = px.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), "label")
    return points.withColumns(spot).join(cells, [*keys, "_y", "_x"], "left").drop("_y", "_x")


#: Points of one object that meet a copy of its list of tracks.
POINTS_PER_COPY = 8192
#: Bytes of a list of tracks from which each copy of it has a task of its own.
LONG_LIST = 16384


def with_owners(points: DataFrame, px: DataFrame, track: str, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Adds area, n_tracks and tracks (joined by ;) of the object (keys, label) under each point, NULL on background.

    A list of tracks grows with the points of its object and each of them carries it, so the rows weigh far
    more than what is shuffled: the points of an object, and those on the background, are dealt to parts of
    POINTS_PER_COPY rows, and each part gets one copy of the list. A part of a long list is a task of its own:
    a writer that keeps a column by its distinct values, as Parquet's does, then holds the list once, where
    lists that outgrow its dictionary together are written out row by row in memory. Short lists and the
    background share tasks of four parts on average. All rows together still grow with the square of the
    points. The points are read several times.
    """
    own = [*keys, "label"]
    found = points.where(F.col("label").isNotNull())
    tracks = found.select(*own, track).distinct().groupBy(*own).agg(F.array_sort(F.collect_list(track)).alias("_t"))
    lists = durable(tracks.select(*own, F.size("_t").cast("long").alias("n_tracks"), F.array_join(F.transform("_t", lambda t: t.cast("string")), ";").alias("tracks")))
    counts = found.groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / POINTS_PER_COPY).cast("int"))
    objects = durable(lists.select(*own, (F.octet_length("tracks") >= LONG_LIST).alias("_long")).join(counts, own))
    each = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_copy")
    first = ranked(objects.where("_long").select(*own, each), [*own, "_copy"]).where("_copy = 0").select(*own, F.col("rank").alias("_first"))
    long = objects.where("_long").agg(F.coalesce(F.sum("_parts"), F.lit(0)).alias("tasks"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()
    shared = max(partitions(points.sparkSession), math.ceil((points.count() - long.n) / (4 * POINTS_PER_COPY)))
    task = F.coalesce(F.col("_first") + F.col("_copy"), F.lit(long.tasks) + F.pmod(F.xxhash64(*own, "_copy"), F.lit(shared))).cast("int")
    placed = objects.select(*own, "_parts").join(first, own, "left")
    sized = px.groupBy(*own).agg(F.count("*").alias("area")).join(placed, own)
    part = F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(shared))).cast("int")
    dealt = points.join(sized, own, "left").withColumn("_copy", part).withColumn("_task", task).drop("_parts", "_first")
    copies = lists.join(placed, own).select("*", each).withColumn("_task", task).drop("_parts", "_first")
    spread = [side.repartitionById(long.tasks + shared, "_task") for side in (dealt, copies)]
    return spread[0].join(spread[1], [*own, "_copy", "_task"], "left").drop("_copy", "_task")


def near_pairs(points: DataFrame, radius: float, keys: Sequence[str], ident: str) -> DataFrame:
    """Pairs of points of one key closer than `radius`, ident_a < ident_b, by a grid join with cells of that size.

    A point meets the points of its own and the neighbouring cells only.
    """
    cell = points.withColumns({"_i": F.floor(F.col("y") / radius), "_j": F.floor(F.col("x") / radius)})
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    ahead = cell.select(*keys, F.col(ident).alias("ident_a"), F.col("y").alias("_ya"), F.col("x").alias("_xa"), "_i", "_j", F.explode(offsets).alias("_o"))
    ahead = ahead.withColumns({"_i": F.col("_i") + F.col("_o.a"), "_j": F.col("_j") + F.col("_o.b")}).drop("_o")
    other = cell.select(*keys, F.col(ident).alias("ident_b"), F.col("y").alias("_yb"), F.col("x").alias("_xb"), "_i", "_j")
    d = F.sqrt((F.col("_ya") - F.col("_yb")) ** 2 + (F.col("_xa") - F.col("_xb")) ** 2)
    met = ahead.join(other, [*keys, "_i", "_j"]).where("ident_a < ident_b").withColumn("distance", d)
    return met.where(F.col("distance") < radius).select(*keys, "ident_a", "ident_b", "distance")


def nearest_points(points: DataFrame, keys: Sequence[str], ident: str, size: float) -> DataFrame:
    """(keys, ident, nearest, distance) of every point with another one under its key; ties go to the smaller ident.

    Rings of grid cells around a point widen, twice each time, until a found neighbour is nearer than
    any cell not looked at could hold; each round joins only the points that are still open.
    """
    from cytoframe.functions.session import durable

    points = durable(points.select(*keys, ident, "y", "x"))
    several = points.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    open_, done, width = points.join(several, list(keys), "left_semi"), None, size
    while not open_.isEmpty():
        offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        place = {"_i": F.floor(F.col("y") / width), "_j": F.floor(F.col("x") / width)}
        mine = open_.withColumns(place).withColumn("_o", F.explode(offsets)).withColumns({"_i": F.col("_i") + F.col("_o.a"), "_j": F.col("_j") + F.col("_o.b")}).drop("_o")
        other = points.withColumns(place).select(*keys, F.col(ident).alias("_id"), F.col("y").alias("_y"), F.col("x").alias("_x"), "_i", "_j")
        d = F.sqrt((F.col("y") - F.col("_y")) ** 2 + (F.col("x") - F.col("_x")) ** 2)
        met = mine.join(other, [*keys, "_i", "_j"]).where(F.col(ident) != F.col("_id")).groupBy(*keys, ident).agg(F.min(F.struct(d.alias("distance"), F.col("_id").alias("nearest"))).alias("_m"))
        met = durable(met.where(F.col("_m.distance") <= width).select(*keys, ident, "_m.nearest", "_m.distance"))
        done = met if done is None else done.unionByName(met)
        open_ = durable(open_.join(met, [*keys, ident], "left_anti"))
        width *= 2
    return done if done is not None else points.select(*keys, ident, F.col(ident).alias("nearest"), F.lit(0.0).alias("distance")).limit(0)


def _column_neighbours(image: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pixel, above and below it in its column (itself included): row and label of the nearest labelled
    pixel, and of the nearest with another label than that one. Row -1 where there is none; 0 is background."""
    out = []
    for flip in (False, True):
        rows = image[::-1] if flip else image
        near, label, second, other = (np.full(image.shape[1], v, np.int64) for v in (-1, 0, -1, 0))
        kept = [np.empty(image.shape, np.int64) for _ in range(4)]
        for y, line in enumerate(rows):
            new = (line > 0) & (line != label)
            second, other = np.where(new, near, second), np.where(new, label, other)
            near, label = np.where(line > 0, y, near), np.where(line > 0, line, label)
            for x, v in zip(kept, (near, label, second, other)):
                x[y] = v
        if flip:
            kept = [x[::-1] for x in kept]
            kept[0], kept[2] = (np.where(x >= 0, len(image) - 1 - x, -1) for x in (kept[0], kept[2]))
        out += [(kept[0], kept[1]), (kept[2], kept[3])]
    return out


def nearest_labelled(image: np.ndarray, y: np.ndarray, x: np.ndarray, own: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Rows (squared distance, label, y, x, y of the nearest, x of it), one a group; squared distance -1 where there is none.

    The nearest labelled pixel to any of the group's query pixels whose label isn't the query's own; ties
    go to the smaller label, then the smaller places. An exact distance transform in two steps: columns are
    scanned once, then queries look at columns further and further away until none can be nearer.
    """
    columns, width = _column_neighbours(image), image.shape[1]
    far = np.int64(1) << 62
    best = np.full((groups, 6), far, np.int64)
    for dx in range(width):
        open_ = np.flatnonzero(best[group, 0] >= dx * dx)
        found = []
        for step in {dx, -dx}:
            at = open_[(x[open_] + step >= 0) & (x[open_] + step < width)]
            for row, label in columns:
                there, whose = row[y[at], x[at] + step], label[y[at], x[at] + step]
                squared = (there - y[at]) ** 2 + dx * dx
                some = np.flatnonzero((there >= 0) & (whose > 0) & (whose != own[at]) & (squared <= best[group[at], 0]))
                q = at[some]
                found.append(np.stack([group[q], squared[some], whose[some], y[q], x[q], there[some], x[q] + step], 1))
        if not len(open_):
            break
        rows = np.concatenate(found)
        rows = np.concatenate([rows, np.concatenate([np.arange(groups)[:, None], best], 1)[np.unique(rows[:, 0])]])
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        best[rows[first, 0]] = rows[first, 1:]
    best[best[:, 0] == far] = -1
    return best


def _image_of(table) -> tuple[np.ndarray, int, int]:
    """Labels as a dense image, with the place of its first row and column; of repeated pixels the greatest label counts."""
    y, x, label = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "label"))
    top, left = int(y.min()), int(x.min())
    image = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1), np.int64)
    np.maximum.at(image, (y - top, x - left), label)
    return image, top, left


def nearest_masks(px: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, label, nearest, distance, gap, y, x, nearest_y, nearest_x) of each object with another one in its frame.

    Distance runs between pixel centres; gap is the empty way between them, max(distance - 1, 0). The
    pixels are a closest pair, the first by label and place among several. Labels are positive. Frames are
    images of bounded size, so one task takes one frame.
    """
    names = list(keys)

    def kernel(table):
        image, top, left = _image_of(table)
        inside = np.pad(image, 1)
        edge = image > 0
        edge &= ~np.logical_and.reduce([inside[1 + a : inside.shape[0] - 1 + a, 1 + b : inside.shape[1] - 1 + b] == image for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
        y, x = np.nonzero(edge)
        labels, group = np.unique(image[y, x], return_inverse=True)
        squared, nearest, *places = nearest_labelled(image, y, x, image[y, x], group, len(labels)).T
        some = squared >= 0
        far = np.sqrt(squared[some])
        ends = {n: p[some] + start for n, p, start in zip(("y", "x", "nearest_y", "nearest_x"), places, (top, left, top, left))}
        columns = {k: pa.array([table.column(k)[0].as_py()] * int(some.sum()), table.schema.field(k).type) for k in names}
        return pa.table({**columns, "label": labels[some], "nearest": nearest[some], "distance": far, "gap": np.maximum(far - 1, 0), **ends})

    kinds = ", ".join(f"{k} {dict(px.dtypes)[k]}" for k in names)
    places = ", ".join(f"{c} long" for c in ("y", "x", "nearest_y", "nearest_x"))
    return px.select(*names, "y", "x", F.col("label").cast("long").alias("label")).groupBy(*names).applyInArrow(kernel, f"{kinds}, label long, nearest long, distance double, gap double, {places}")


def nearest_mask_pixels(px: DataFrame, height: int, width: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, y, x, nearest, distance, nearest_y, nearest_x) of every pixel of height x width frames.

    A labelled pixel is its own nearest at distance 0; ties go to the smaller label, then place. Frames
    without a labelled pixel have no rows; a pixel outside the frame is a ValueError.
    """
    names = list(keys)

    def kernel(table):
        image, at = np.zeros((height, width), np.int64), [table.column(c).to_numpy() for c in "yx"]
        if any(len(v) and (v.min() < 0 or v.max() >= n) for v, n in zip(at, image.shape)):
            raise ValueError(f"a pixel outside the frame of {height} x {width}")
        np.maximum.at(image, tuple(at), table.column("label").to_numpy())
        y, x = (v.ravel().astype(np.int64) for v in np.indices(image.shape))
        squared, nearest, _, _, ny, nx = nearest_labelled(image, y, x, np.full(len(y), -1), np.arange(len(y)), len(y)).T
        columns = {k: pa.array([table.column(k)[0].as_py()] * len(y), table.schema.field(k).type) for k in names}
        return pa.table({**columns, "y": y.astype(np.int32), "x": x.astype(np.int32), "nearest": nearest, "distance": np.sqrt(squared), "nearest_y": ny, "nearest_x": nx})

    kinds = ", ".join(f"{k} {dict(px.dtypes)[k]}" for k in names)
    return px.select(*names, "y", "x", F.col("label").cast("long").alias("label")).groupBy(*names).applyInArrow(kernel, f"{kinds}, y int, x int, nearest long, distance double, nearest_y long, nearest_x long")


def shapes(px: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Area, perimeter (boundary pixels), circularity, axis lengths, eccentricity and doubled orientation of objects, from second moments.

    Circularity is 4 pi area / perimeter^2, at most 1; cos2 and sin2 of the orientation are scaled to 0 to 1.
    """
    own = [*keys, "label"]
    m = px.groupBy(*own).agg(F.count("*").alias("area"), F.var_pop("y").alias("_yy"), F.var_pop("x").alias("_xx"), F.covar_pop("y", "x").alias("_yx"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"))
    p = boundary(px, keys).groupBy(*own).agg(F.count("*").alias("perimeter"))
    half = F.sqrt(((F.col("_yy") - F.col("_xx")) / 2) ** 2 + F.col("_yx") ** 2)
    middle = (F.col("_yy") + F.col("_xx")) / 2
    out = m.join(p, own, "left").withColumns({"_long": middle + half, "_short": F.greatest(middle - half, F.lit(0.0)), "_angle": 0.5 * F.atan2(2 * F.col("_yx"), F.col("_xx") - F.col("_yy"))})
    out = out.withColumns({
        "major_axis": 4 * F.sqrt("_long"), "minor_axis": 4 * F.sqrt("_short"), "eccentricity": F.when(F.col("_long") > 0, F.sqrt(F.greatest(1 - F.col("_short") / F.col("_long"), F.lit(0.0)))).otherwise(0.0),
        "circularity": F.least(4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")), F.lit(1.0)), "cos2": (F.cos(2 * F.col("_angle")) + 1) / 2, "sin2": (F.sin(2 * F.col("_angle")) + 1) / 2,
    })
    return out.drop("_yy", "_xx", "_yx", "_long", "_short", "_angle")
