"""Object linking: assignments against all matchings, a plain tracker, windows, gaps, looks and odd rows."""

import itertools

import numpy as np
import pytest

from cytoframe.operators import linking as L


def best(i, j, cost, free):
    """The least total of any matching, by trying all."""
    pairs = [(a, b, c - free) for a, b, c in zip(i, j, cost) if c < free]

    def go(k, rows, columns):
        if k == len(pairs):
            return 0.0
        a, b, c = pairs[k]
        out = go(k + 1, rows, columns)
        if a not in rows and b not in columns:
            out = min(out, c + go(k + 1, rows | {a}, columns | {b}))
        return out

    return go(0, frozenset(), frozenset())


def test_assignment_is_the_best_of_all():
    random = np.random.default_rng(1)
    for _ in range(200):
        n = int(random.integers(1, 6))
        m = n + int(random.integers(0, 3))
        cost = random.integers(0, 9, (n, m)).astype(float) if random.random() < 0.5 else random.normal(size=(n, m))
        got = L.assignment(cost)
        assert len(set(got.tolist())) == n
        assert abs(cost[np.arange(n), got].sum() - min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), n))) < 1e-9


def test_matching_leaves_out_what_costs_more():
    random = np.random.default_rng(2)
    for _ in range(150):
        pairs = sorted({(int(a), int(b)) for a, b in random.integers(0, 5, (int(random.integers(0, 12)), 2))})
        i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        cost = random.random(len(pairs)) * 3
        chosen = L.matched(i, j, cost, 2.0)
        assert len(set(i[chosen])) == chosen.sum() == len(set(j[chosen])) and (cost[chosen] < 2.0).all()
        assert abs((cost[chosen] - 2.0).sum() - best(i, j, cost, 2.0)) < 1e-9


def plain(rows, model, max_lost, prob, accuracy, radius):
    """The same rule over one key with loops over all pairs and all matchings by the solver on a full matrix."""
    m = L.MODELS[model]
    step, noise, start, r = (np.array(v) for v in (m.step, m.noise, m.start, m.measured))
    tracks, out, free = {}, {}, -np.log(prob)
    for frame in sorted({f for f, *_ in rows}):
        found = sorted((label, np.array([x, y, 0.0])) for f, label, x, y in rows if f == frame)
        tracks = {t: s for t, s in tracks.items() if frame - s[0] <= max_lost + 1}
        ahead = {}
        for t, (last, x, p) in tracks.items():
            for _ in range(frame - last):
                x, p = step @ x, step @ p @ step.T + noise
            ahead[t] = (x, p)
        names = sorted(tracks)
        full = np.full((len(found), len(names) + len(found)), free)
        for a, (_, at) in enumerate(found):
            for b, t in enumerate(names):
                x, p = ahead[t]
                off = at - x[:3]
                d2 = off @ np.linalg.inv(p[:3, :3] + r) @ off
                full[a, b] = d2 / 2 if d2 <= accuracy**2 and off @ off <= radius**2 and d2 / 2 < free else 1e6
        got = L.assignment(full) if len(found) else []
        for (label, at), column in zip(found, got):
            if column < len(names):
                t = names[column]
                x, p = ahead[t]
                gain = p[:, :3] @ np.linalg.inv(p[:3, :3] + r)
                x, p = x + gain @ (at - x[:3]), p - gain @ p[:3, :]
            else:
                t = 1 + max([0, *out.values()])
                x, p = np.append(at, np.zeros(len(step) - 3)), start
            tracks[t], out[frame, label] = (frame, x, p), t
    return out


@pytest.fixture(scope="module")
def scene():
    """Points that walk, vanish for some frames and come back, in two keys."""
    random = np.random.default_rng(4)
    rows = []
    for key in (0, 1):
        at, speed = random.random((9, 2)) * 60, random.normal(size=(9, 2)) * 2
        for f in range(14):
            at = at + speed + random.normal(size=at.shape)
            rows += [(key, f, k + 1, float(x), float(y)) for k, (x, y) in enumerate(at) if random.random() < 0.85]
    return rows


@pytest.mark.parametrize("model", ["random-walk", "constant-velocity"])
def test_tracks_equal_a_plain_tracker_for_any_window(spark, scene, model):
    df = spark.createDataFrame(scene, "key int, frame int, label int, x double, y double").repartition(3)
    want = {}
    for key in (0, 1):
        for (f, label), t in plain([r[1:] for r in scene if r[0] == key], model, 3, 0.05, 3.0, 40.0).items():
            want[key, f, label] = t
    shown = None
    for window in (1, 4, 5, 100):
        rows = L.track_objects(df, ["key"], model, max_lost=3, prob_not_assign=0.05, accuracy=3.0, window=window).collect()
        assert {(r.key, r.frame, r.label): r.track for r in rows if not r.dummy} == want
        every = sorted((tuple(r) for r in rows), key=repr)
        assert shown in (None, every)
        shown = every
    gaps = [r for r in rows if r.dummy]
    assert gaps and all(r.label is None for r in gaps)
    frames = {}
    for r in rows:
        frames.setdefault((r.key, r.track), []).append(r.frame)
    assert all(sorted(f) == list(range(min(f), max(f) + 1)) for f in frames.values())


def test_speed_carries_tracks_past_each_other(spark):
    rows = [(0, f, 1, 4.0 * f, 0.0) for f in range(12)] + [(0, f, 2, 44.0 - 4.0 * f, 1.0) for f in range(12)]
    df = spark.createDataFrame(rows, "key int, frame int, label int, x double, y double")
    got = L.track_objects(df, ["key"], "constant-velocity", accuracy=3.0).collect()
    assert {(r.label, r.track) for r in got} == {(1, 1), (2, 2)}


def test_looks_decide_between_near_places(spark):
    rows = [(0, 0, 1, 0.0, 0.0, 1.0, 0.0), (0, 0, 2, 3.0, 0.0, 0.0, 1.0), (0, 1, 1, 2.0, 0.0, 1.0, 0.05), (0, 1, 2, 1.0, 0.0, 0.05, 1.0)]
    df = spark.createDataFrame(rows, "key int, frame int, label int, x double, y double, a double, b double")

    def labels(mode, features):
        return {(r.frame, r.label): r.track for r in L.track_objects(df, ["key"], mode=mode, features=features).collect()}

    assert labels("motion", [])[1, 1] == 2 and labels("motion-visual", ["a", "b"])[1, 1] == 1 and labels("visual", ["a", "b"])[1, 1] == 1
    with pytest.raises(ValueError):
        L.track_objects(df, ["key"], mode="visual")


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(None, 0, 1, 0.0, 0.0), (None, 1, 1, 0.5, 0.0), (1, None, 1, 0.0, 0.0), (1, 0, 1, nan, 0.0), (1, 0, 2, None, 0.0), (1, 0, 3, 5.0, 5.0), (1, 0, 3, 5.0, 5.0), (1, 1, 3, 5.0, 6.0), (1, 9, 3, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "key int, frame int, label int, x double, y double")
    got = sorted((tuple(r)[:3] + (r.track,) for r in L.track_objects(df, ["key"]).collect()), key=repr)
    assert got == [(1, 0, 3, 1), (1, 1, 3, 1), (1, 9, 3, 2), (None, 0, 1, 1), (None, 1, 1, 1)]
    assert L.track_objects(df.limit(0), ["key"]).count() == 0
