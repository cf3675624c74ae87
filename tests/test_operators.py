"""Hand-made cases: NULLs, repeated frames, ties and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import censoring as C
from cytoframe.operators import graph, imaging, raster
from cytoframe.operators import inventory as I
from cytoframe.operators import summaries as S
from cytoframe.operators import tracks as T
from cytoframe.operators import walk_model as W


def test_repeated_frame_starts_a_run(spark):
    df = spark.createDataFrame([(1, f) for f in (1, 2, 2, 3, 5)], "track_id int, frame int")
    rows = T.runs(df, ["track_id"]).groupBy("run_index").agg(F.min("frame").alias("a"), F.count("*").alias("n")).orderBy("run_index").collect()
    assert [(r.a, r.n) for r in rows] == [(1, 2), (2, 2), (5, 1)]


def test_sliding_segments_overlap(spark):
    df = spark.createDataFrame([(1, f) for f in range(5)], "track_id int, frame int")
    got = T.sliding_segments(T.runs(df, ["track_id"]), ["track_id"]).groupBy("segment_start").agg(F.count("*").alias("n")).orderBy("segment_start").collect()
    assert [(r.segment_start, r.n) for r in got] == [(0, 3), (1, 3), (2, 3)]


def test_steps_need_consecutive_frames(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 3, 9.0, 9.0)], "track_id int, frame int, x double, y double")
    assert [r.step_distance for r in T.forward_steps(df, ["track_id"]).collect()] == [5.0]
    assert [r.step_speed for r in T.previous_step(df, ["track_id"]).orderBy("frame").collect()] == [None, 5.0, None]


def test_tiles_leave_nulls_out(spark):
    df = spark.createDataFrame([(i, float(i) if i else None) for i in range(10)], "id int, v double")
    rows = {r.id: r.q for r in S.tiles(df, "v", 4, "q", ["id"]).collect()}
    assert rows[0] is None and [rows[i] for i in range(1, 10)] == [1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_edge_distance_is_null_without_a_coordinate(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "x double, y double")
    assert [r.d for r in df.select(C.edge_distance(10, 10).alias("d")).collect()] == [None, 2.0]


def test_flags_of_unknown_values(spark):
    df = spark.createDataFrame([(None, None, None, None, None, 1, 0.0, 0.0), (5, "single_track", None, 40.0, 10.0, 1, 0.0, 0.0)], "label int, object_status string, touching boolean, area double, track_area double, track_id int, x double, y double").withColumn("frame", F.lit(1)).withColumn("link_status", C.link_status())
    assert [r.passes_point for r in C.point_flags(df).collect()] == [False, True]


@pytest.mark.parametrize("edges_per_task", [500_000, 20])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", edges_per_task)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[k] == 100 for k in range(100, 140))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_masks_and_a_lone_object(spark):
    px = spark.createDataFrame([(0, 0, 0, 1), (0, 3, 4, 2), (0, 9, 9, 3), (1, 0, 0, 4)], "frame int, y int, x int, label long")
    rows = {(r.frame, r.label): (r.nearest, r.distance, r.gap) for r in raster.nearest_masks(px).collect()}
    assert rows[0, 1] == (2, 5.0, 4.0) and (1, 4) not in rows


def test_spacing_takes_the_upper_median(spark):
    df = spark.createDataFrame([([0, 10, 15, 45, 49],), ([5],)], "v array<bigint>")
    rows = df.select(I.spacing("v").alias("s")).collect()
    assert (rows[0].s.least, rows[0].s.upper_median) == (4, 10) and rows[1].s is None


@pytest.mark.parametrize(
    "path, tracking, volume",
    [
        ("/share/Cell_Migration/col3/x", "/share/Cell_Migration", "/share/Cell_Migration/col3/x"),
        ("/share/chemotaxis/run1/a", "/share/chemotaxis/run1", "/share/chemotaxis/run1/a"),
        ("/a/plain/b", "/a/plain", "/a/plain/b"),
        ("/a/exp_measurement 1/Images/metadata", "/a/exp_measurement 1/Images", "/a/exp_measurement 1"),
        ("/a/images/FoF12", "/a/images", "/a/images"),
        ("/a/b/r01c02f03", "/a/b", "/a/b"),
    ],
)
def test_experiment_roots(spark, path, tracking, volume):
    r = spark.createDataFrame([(path,)], "path string").select(I.tracking_root().alias("t"), I.volume_root().alias("v")).first()
    assert (r.t, r.v) == (tracking, volume)


def test_names_and_cell_lines(spark):
    names = spark.createDataFrame([("/d/SNU_668_x", n) for n in ("FoF1_z03_ch00.tif", "A1_2_04d12h00m.png", "B2_1_2024y02m30d_06h30m.jpg", "notes.txt")], "path string, name string")
    r = I.scored(names).first()
    assert r.z_values == ["03"] and r.elapsed_minutes == [6480] and r.acquired_at == ["2024-02-30 06:30"] and r.acquired_minutes == []
    assert r.cell_lines == ["SNU-668"] and r.n_images == 3 and r.wells == ["A1", "B2"]


def test_stack_files_decide_the_cut(spark):
    names = spark.createDataFrame([("/d/plain", "a.tif"), ("/d/other", "b.tif")], "path string, name string")
    kinds = "path string, kind string, pages long, height long, width long, dtype string, sizes string, error string"
    probed = spark.createDataFrame([("/d/plain/a.tif", "ome_z_or_t_stack", None, 64, 32, "uint16", "SizeZ=9", None), ("/d/plain/c.tif", "", 1, 8, 8, "uint8", None, None), ("/d/other/b.tif", None, None, None, None, None, None, "Unreadable")], kinds)
    rows = {r.path: r for r in I.candidate_rows(I.scored(names, stacks=I.stack_profiles(probed)), "z_score").collect()}
    r = rows["/d/plain"]
    assert (r.score, r.stack_tiff_count_sampled, r.stack_tiff_kind, r.stack_tiff_ome_sizes, r.stack_tiff_pages, r.stack_tiff_shapes, r.stack_tiff_examples) == (5, 1, "ome_z_or_t_stack", "SizeZ=9", "", "page0:64x32:uint16", "a.tif")
    assert (rows["/d/other"].score, rows["/d/other"].stack_tiff_count_sampled, rows["/d/other"].stack_tiff_errors) == (1, 0, "b.tif:Unreadable")
    assert I.scored(names).where("z_score >= 4").count() == 0


def test_likelihood_of_two_points_is_a_normal_density():
    y, dt, real = W.padded([[0, 1]], [[0.0, 1.0]], [[0.0, 0.0]], 2.0)
    tau, v, s = 3.0, 1.5, 0.4
    f12, phi, q11, q12, q22 = (float(x) for x in W.transition(2.0, tau, v))
    var = s * s + f12 * f12 * v * v + q11 + s * s
    want = sum(-0.5 * (math.log(2 * math.pi * var) + d * d / var) for d in (1.0, 0.0))
    assert abs(W.log_likelihood(np.log([tau, v, s]), y, dt, real) - want) < 1e-9


def test_fit_recovers_parameters(spark):
    sim = W.simulate(spark.range(60).select(F.col("id").alias("track_id"), F.lit(40).alias("n_frames"), F.lit(5.0).alias("tau"), F.lit(2.0).alias("velocity_scale"), F.lit(0.3).alias("obs_noise")), seed=3)
    best = W.best_fits(W.fits(sim.withColumn("c", F.lit(1)), ["c"], ["track_id"], n_starts=2), ["c"]).first()
    assert best.fit_status == "converged" and 3.5 < best.tau < 7 and 1.6 < best.velocity_scale < 2.4


def test_moments_give_the_likelihood_of_the_segments(spark):
    random = np.random.default_rng(1)
    frames = [[0, 1, 2, 3], [4, 5, 6, 7], [2, 4, 5], [1, 2], [0, 1, 2, 3]]
    rows = [(1, i, f, (50 + random.normal(size=len(f)).cumsum()).tolist(), random.normal(size=len(f)).cumsum().tolist()) for i, f in enumerate(frames)]
    got = W.moments(spark.createDataFrame(rows, "c int, id int, frames array<int>, xs array<double>, ys array<double>").repartition(3), ["c"]).toPandas()
    assert sorted(got["n"]) == [1, 1, 3]
    data = W.padded_moments(got["steps"].tolist(), got["n"].tolist(), got["s"].tolist(), 2.0)
    for point in ([3.0, 1.5, 0.4], [50.0, 0.2, 1e-3]):
        want = W.log_likelihood(np.log(point), *W.padded(frames, [r[3] for r in rows], [r[4] for r in rows], 2.0))
        assert abs(W.moment_log_likelihood(np.log(point), *data) - want) < 1e-8 * max(1, abs(want))


def test_the_score_equals_differences():
    random = np.random.default_rng(1)
    steps, sums, n = [], [], []
    for f in ([0, 1, 2], [0, 1, 2, 3, 4], [0, 1, 4, 5, 9]):
        z = random.normal(size=(6, len(f) - 1)).cumsum(1)
        steps.append(np.diff(f).tolist())
        sums.append((z.T @ z).ravel().tolist())
        n.append(3)
    data = W.padded_moments(steps, n, sums, 2.0)
    for point in ([4.0, 2.0, 0.5], [1e-3, 3.0, 0.2], [5e4, 1.0, 0.3], [2.0, 1e-4, 2.0], [30.0, 0.1, 0.01]):
        at = np.log(point)
        value, slope = W.moment_score(at, *data)
        want = np.array([(W.moment_score(at + e, *data)[0] - W.moment_score(at - e, *data)[0]) / 2e-5 for e in 1e-5 * np.eye(3)])
        assert np.abs(slope - want).max() < 1e-5 * max(1, np.abs(want).max())

    def loss(p):
        value, slope = W.moment_score(p, *data)
        return -value, -slope

    ends = [W.minimise(loss, np.log(p)) for p in ([4.0, 2.0, 0.5], [0.1, 0.1, 5.0], [1e3, 1.0, 1.0])]
    assert max(e["value"] for e in ends) - min(e["value"] for e in ends) < 0.05 and all(e["converged"] and e["evaluations"] < 100 for e in ends)


def test_descent_stays_within_bounds_and_says_so():
    low, high = np.array([-1.0, -1.0]), np.array([1.0, 5.0])

    def bowl(x):
        return float((x[0] - 3) ** 2 + 10 * (x[1] - 2) ** 2 + x[0] * x[1]), np.array([2 * (x[0] - 3) + x[1], 20 * (x[1] - 2) + x[0]])

    got = W.minimise(bowl, np.array([-9.0, 9.0]), low, high)
    assert got["converged"] and np.allclose(got["x"], [1.0, 1.95], atol=1e-4) and got["at_bound"].tolist() == [True, False]
    assert not W.minimise(bowl, np.array([0.0, 0.0]), low, high, steps=1)["converged"]
    assert W.minimise(lambda x: (float(((x - 0.3) ** 2).sum()), 2 * (x - 0.3)), np.array([0.0, 0.0]), low, high)["at_bound"].any() is np.False_


def test_a_fit_takes_every_segment(spark):
    sim = W.simulate(spark.range(450).select(F.col("id").alias("track_id"), F.lit(3).alias("n_frames"), F.lit(5.0).alias("tau"), F.lit(2.0).alias("velocity_scale"), F.lit(0.3).alias("obs_noise")), seed=3)
    r = W.fits(sim.withColumn("c", F.lit(1)), ["c"], ["track_id"], n_starts=1).first()
    assert (r.n_segments, r.total_track_time) == (450, 1800.0)


def test_context_falls_back_to_any_detection(spark):
    from cytoframe.plans.censoring import CONTEXT_LADDER

    kinds = "ploidy string, dose double, frame int"
    pool = spark.createDataFrame([("2N", 0.0, 1, 10), ("2N", 0.0, 2, 11), ("4N", 1.0, 3, 12)], f"{kinds}, event_id long")
    wanted = spark.createDataFrame([("2N", 0.0, 1, 1), ("4N", 1.0, 9, 2), ("8N", 5.0, 2, 3), ("8N", 5.0, 9, 4)], f"{kinds}, wanted_id long")
    rows = {r.wanted_id: (r.event_id, r.ladder_level) for r in C.resample(pool, wanted, CONTEXT_LADDER, "wanted_id", ["event_id"], 17).collect()}
    assert (rows[1], rows[2], rows[3]) == ((10, 0), (12, 1), (11, 2)) and rows[4][1] == 3 and rows[4][0] in (10, 11, 12)


def test_context_is_drawn_from_all_detections(spark, sf):
    from cytoframe.plans import censoring as P
    from cytoframe.sources import adapters as A

    rows = P.context_resample(spark, sf).join(A.tracks(spark, sf).select("event_id", "track_id", F.col("frame").alias("f")), "event_id", "left").collect()
    assert all(r.ladder_level is not None for r in rows) and any(r.f % 3 for r in rows) and any(r.track_id % 4 == 0 for r in rows)


def test_lags_reach_those_of_the_reference(spark, sf):
    from cytoframe.plans import censoring, motility

    for query, most in ((motility.windowed_msd, 10), (motility.acf_cosine, 10), (censoring.survival_weights, 5), (censoring.weighted_msd, 5)):
        assert [r.lag for r in query(spark, sf).select("lag").distinct().orderBy("lag").collect()] == list(range(1, most + 1))


def test_gaussian_keeps_a_constant_and_its_mass():
    flat = np.full((2, 9, 9), 3.0)
    assert np.allclose(imaging.gaussian(flat, (1, 2, 2)), 3.0)
    x = np.zeros((1, 41, 41))
    x[0, 20, 20] = 1
    assert abs(imaging.gaussian(x, (0, 2, 2)).sum() - 1) < 1e-9
    assert np.allclose(imaging.local_deviation(flat), 1e-3)


def test_otsu_parts_two_levels(spark):
    px = spark.createDataFrame([(1, i, 0, 0.0 if i < 20 else 1.0) for i in range(40)] + [(2, 0, 0, 5.0)], "image_id int, y int, x int, v double")
    rows = {r.image_id: r.threshold for r in imaging.otsu(px).collect()}
    assert 0 <= rows[1] < 1 and rows[2] == 5.0
    assert abs(imaging.otsu_of(np.repeat([0.0, 1.0], 20)) - rows[1]) < 1e-9


def test_presets_run_on_a_volume(spark):
    px = spark.createDataFrame([(1, z, y, x, float((z + 1) * y * x % 7)) for z in range(3) for y in range(6) for x in range(6)], "image_id int, z int, y int, x int, v double")
    for name in ("composite", "sd_blur", "abs_z"):
        assert imaging.apply_preset(px, name).count() == 108


def test_nearest_labels_against_all_pairs():
    rnd = np.random.default_rng(3)
    for trial in range(12):
        image = np.where(rnd.random((17, 23)) < (0.02, 0.2, 0.7)[trial % 3], rnd.integers(1, 5, (17, 23)), 0)
        y, x = np.nonzero(image)
        labels, group = np.unique(image[y, x], return_inverse=True)
        got = raster.nearest_labelled(image, y, x, image[y, x], group, len(labels))
        for k, own in enumerate(labels):
            pairs = [((a - c) ** 2 + (b - d) ** 2, image[c, d], a, b, c, d) for a, b in zip(y, x) if image[a, b] == own for c, d in zip(y, x) if image[c, d] != own]
            assert tuple(got[k]) == (min(pairs) if pairs else (-1, *got[k][1:]))
        gy, gx = (v.ravel() for v in np.indices(image.shape))
        each = raster.nearest_labelled(image, gy, gx, np.full(len(gy), -1), np.arange(len(gy)), len(gy))
        for a, b, row in zip(gy, gx, each):
            best = min(((a - c) ** 2 + (b - d) ** 2, image[c, d], a, b, c, d) for c, d in zip(y, x)) if len(y) else (-1,)
            assert tuple(row[: len(best)]) == best
    assert raster.nearest_labelled(np.zeros((3, 4), int), np.array([1]), np.array([2]), np.array([-1]), np.array([0]), 1)[0, 0] == -1


def test_synthetic_volume_is_its_formula(spark):
    depth, height, width = 4, 9, 11
    z, y, x = np.indices((depth, height, width)).astype(float)
    want = 0.08 * z / (depth - 1)
    for cx, cy, cz, r, bright in ((0.35, 0.45, 0.40, 0.18, 1.0), (0.62, 0.58, 0.58, 0.14, 0.8), (0.50, 0.28, 0.70, 0.10, 0.7)):
        want += bright * np.clip(1 - np.sqrt((x - cx * width) ** 2 + (y - cy * height) ** 2 + (z - cz * depth) ** 2) / (r * width), 0, 1)
    want = np.floor(want / want.max() * 65535)
    got = np.zeros_like(want)
    for r in imaging.synthetic_volume(spark, depth, height, width).collect():
        got[r.z, r.y, r.x] = r.v
    assert np.abs(got - want).max() <= 1 and got.max() == 65535


def test_segmentation_inputs_have_their_channels(spark):
    rnd = np.random.default_rng(1)
    rows = [(1, z, y, x, *map(float, rnd.random(3))) for z in range(3) for y in range(6) for x in range(5)]
    px = spark.createDataFrame(rows, "image_id long, z int, y int, x int, r double, g double, b double")
    for mode, n in imaging.INPUTS.items():
        got = imaging.segmentation_input(px, mode).collect()
        assert len(got) == len(rows) and all(len(r.channels) == n and min(r.channels) >= -1e-9 and max(r.channels) <= 1 + 1e-9 for r in got)
    plain, inverted = ({(r.z, r.y, r.x): r.channels[0] for r in imaging.segmentation_input(px, m).collect()} for m in ("raw", "raw_inverted"))
    assert all(abs(plain[k] + inverted[k] - 1) < 1e-9 for k in plain)


def test_presets_fill_missing_pixels(spark):
    rows = [(1, z, y, x, float(x)) for z in range(2) for y in range(4) for x in range(5) if (z, y, x) != (1, 2, 3)]
    assert imaging.apply_preset(spark.createDataFrame(rows, "image_id long, z int, y int, x int, v double"), "abs_z").count() == 40


def test_simulated_tracks_follow_the_model(spark):
    rows = spark.range(3000).selectExpr("id AS track_id", "CAST(6 AS INT) AS n_frames", "4.0D AS tau", "2.0D AS velocity_scale", "0.5D AS obs_noise")
    got = W.simulate(rows).toPandas()
    assert len(got) == 18000 and sorted(got.frame.unique()) == list(range(6))
    last = got[got.frame == 5]
    f = got[got.frame == 0].set_index("track_id")
    msd = (((last.set_index("track_id")[["x", "y"]] - f[["x", "y"]]) ** 2).sum(axis=1)).mean()
    t = 10.0
    want = 4 * 2.0**2 * 4.0**2 * (t / 4.0 - 1 + np.exp(-t / 4.0)) + 4 * 0.25
    assert abs(msd / want - 1) < 0.1
    again = W.simulate(rows.repartition(7)).toPandas().sort_values(["track_id", "frame"])
    assert np.allclose(again[["x", "y"]], got.sort_values(["track_id", "frame"])[["x", "y"]])
    assert W.simulate(rows.where("false")).count() == 0


def test_ranks_within_keys_and_global_quantiles(spark):
    rnd = np.random.default_rng(2)
    rows = [(k, int(k) % 3 if k % 7 else None, float(v)) for k, v in enumerate(rnd.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "i long, g int, v double")
    for r in S.ranked(df, ["v", "i"], ["g"]).collect():
        own = sorted((v, i) for i, g, v in rows if g == r.g)
        assert own[r["rank"]] == (r.v, r.i) and r.total == len(own)
    shares = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.987, "e": 1.0}
    got = S.global_quantiles(df, "v", shares).first()
    assert np.allclose([got[n] for n in shares], np.quantile([v for _, _, v in rows], list(shares.values())))
    assert S.global_quantiles(df.where("false"), "v", shares).first().a is None
    keyed = S.global_quantiles(df, "v", shares, ["g"]).collect()
    assert len(keyed) == 4
    for r in keyed:
        assert np.allclose([r[n] for n in shares], np.quantile([v for _, g, v in rows if g == r.g], list(shares.values())))


def test_neighbours_in_time_of_repeated_missing_and_null_frames(spark):
    rnd = np.random.default_rng(4)
    rows = [(int(t) if t else None, int(f) if f < 9 else None, bool(p), k) for k, (t, f, p) in enumerate(zip(rnd.integers(0, 4, 150), rnd.integers(0, 10, 150), rnd.integers(0, 2, 150)))]
    df = spark.createDataFrame(rows, "t int, frame int, passes_point boolean, k int")
    df = df.withColumns({f: df.k % (i + 2) == 0 for i, f in enumerate(C.FLAGS)})
    for r in C.neighbours_in_time(df, ["t"], ["k"]).collect():
        beside = {d: sorted((k, p) for t, f, p, k in rows if t is not None and f is not None and r.frame is not None and t == r.t and f == r.frame + d) for d in (1, -1)}
        assert r.next_point == any(p for _, p in beside[1]) and r.has_previous_point == any(p for _, p in beside[-1])
        assert r.raw_next_exists == bool(beside[1])
        assert r.next_passes_point == (beside[1][0][1] if beside[1] else None)
        assert r.next_passes_link == (beside[1][0][0] % 2 == 0 if beside[1] else None)


def test_survival_weights_are_products_over_links(spark):
    rnd = np.random.default_rng(6)
    links = [(t, f, float(rnd.choice([0.0, 0.5, 0.9, -0.2])), float(rnd.choice([0.0, 0.4, 0.8]))) for t in range(4) for f in range(20) if rnd.random() < 0.9]
    pairs = [(t, f, lag) for t in range(4) for f in range(20) for lag in (1, 2, 3)]
    survival = spark.createDataFrame(links, "t int, frame int, numer double, denom double")
    got = {(r.t, r.frame, r.lag): r.weight for r in C.survival_weights(spark.createDataFrame(pairs, "t int, frame int, lag int"), survival, ["t"]).collect()}
    usable = {(t, f): n / d for t, f, n, d in links if d > 0}
    want = {}
    for t, f, lag in pairs:
        parts = [usable.get((t, f + k)) for k in range(lag)]
        if None not in parts:
            want[t, f, lag] = float(np.prod(parts))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_weighted_pairs_are_lag_pairs_with_survival_weights(spark):
    rnd = np.random.default_rng(6)
    rows = [(t, f, float(f), float(t), *((float(rnd.choice([0.0, 0.5, 0.9, -0.2])), float(rnd.choice([0.0, 0.4, 0.8]))) if rnd.random() < 0.9 else (None, None)), bool(rnd.random() < 0.9)) for t in range(5) for f in range(20) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "t int, frame int, x double, y double, numer double, denom double, kept boolean")
    got = C.weighted_pairs(df, ["t"], 4, F.col("numer"), F.col("denom"), F.col("kept"))
    pairs = T.lag_pairs(df.where("kept"), ["t"], 4)
    want = pairs.join(C.survival_weights(pairs, df.select("t", "frame", "numer", "denom"), ["t"]), ["t", "frame", "lag"])
    table = lambda d: sorted((r.t, r.frame, r.lag, r.x_later, round(r.weight, 9) + 0.0) for r in d.collect())
    assert table(got) == table(want) and got.count() > 30


def test_lag_pairs_count_a_repeated_frame_once(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 5.0, 1.0), (1, 1, 4.0, 9.0), (1, 3, 7.0, 7.0), (None, 0, 1.0, 1.0), (None, 1, 1.0, 1.0), (1, None, 2.0, 2.0)], "t int, frame int, x double, y double")
    got = sorted(map(tuple, T.lag_pairs(df, ["t"], 3).select("frame", "lag", "x", "x_later", "y_later").collect()))
    assert got == [(0, 1, 0.0, 4.0, 9.0), (0, 3, 0.0, 7.0, 7.0), (1, 2, 4.0, 7.0, 7.0), (1, 2, 5.0, 7.0, 7.0)]


def test_focus_terms_are_those_of_close_matches(spark):
    import difflib
    import re

    random = np.random.default_rng(4)

    def bent(word):
        letters = list(word)
        for _ in range(int(random.integers(0, 4))):
            at = int(random.integers(0, len(letters)))
            letters[at : at + int(random.integers(0, 2))] = [str(random.choice(list("abcdegimnortx")))] * int(random.integers(0, 2))
            letters = letters or ["x"]
        return "".join(letters)

    paths = [None, "", "/", "/a/Tracking/b"] + ["/".join(["", *[bent(str(random.choice(I.FOCUS_TERMS))) for _ in range(int(random.integers(1, 4)))], "plain_x"]) for _ in range(150)]
    got = {r.path: [tuple(m) for m in r.focus] for r in I.focus_matches(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    for path in paths:
        low, want = (path or "").lower(), []
        tokens = [t for t in re.split("[^a-z0-9]+", low) if t]
        for term in I.FOCUS_TERMS:
            if term in low:
                want.append((term, term, 1.0))
            elif close := difflib.get_close_matches(term, tokens, n=1, cutoff=0.78):
                want.append((term, close[0], difflib.SequenceMatcher(a=term, b=close[0]).ratio()))
        assert got[path] == want, path
