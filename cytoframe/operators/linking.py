"""Objects linked to tracks over frames: Kalman prediction, an optimal gated assignment a frame, gaps, looks.

Frames follow each other, so a key (a site) is worked through in windows of frames. A task holds the
detections of one window of one key; what it hands on are the states of the tracks still alive. A track
is predicted from its last detection alone, so tracks are the same whatever the length of a window.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.session import durable
from cytoframe.operators.graph import least_reached

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Motion:
    """A linear model of motion: step, start covariance, noise of a step, noise of a measurement; the first three states are the place."""

    step: tuple
    start: tuple
    noise: tuple
    measured: tuple


def _diagonal(*values):
    return tuple(map(tuple, np.diag(np.array(values, float))))


# The two motion models of the workflow. A speed of an axis drifts with its place, so the noise of a step is an outer product.
_DRIFT = np.array([1.5, 1.5, 0.05, 3.0, 3.0, 0.05])
MODELS = {
    "constant-velocity": Motion(tuple(map(tuple, np.eye(6) + np.eye(6, k=3))), _diagonal(9, 9, 1, 16, 16, 1), tuple(map(tuple, np.outer(_DRIFT, _DRIFT))), _diagonal(3, 3, 1)),
    "random-walk": Motion(_diagonal(1, 1, 1), _diagonal(25, 25, 1), _diagonal(36, 36, 1), _diagonal(4, 4, 1)),
}


@lru_cache(64)
def _ahead(model: str, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """The step over so many frames and its noise."""
    m = MODELS[model]
    step, noise = np.array(m.step), np.array(m.noise)
    total, q = np.eye(len(step)), np.zeros_like(noise)
    for _ in range(frames):
        total, q = step @ total, step @ q @ step.T + noise
    return total, q


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least cost; rows are at most as many as columns. Shortest augmenting paths."""
    n, m = cost.shape
    row_of, u, v = np.full(m, -1), np.zeros(n), np.zeros(m)
    for row in range(n):
        far, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, at, base = row, -1, 0.0
        while True:
            open_ = ~done
            way = base + cost[i] - u[i] - v
            closer = open_ & (way < far)
            far[closer], via[closer] = way[closer], at
            at = int(np.flatnonzero(open_)[np.argmin(far[open_])])
            base, done[at] = far[at], True
            if row_of[at] < 0:
                break
            i = row_of[at]
        closed = np.flatnonzero(done & (row_of >= 0))
        u[row_of[closed]] += base - far[closed]
        v[closed] -= base - far[closed]
        u[row] += base
        while at >= 0:  # back along the path
            before = via[at]
            row_of[at] = row if before < 0 else row_of[before]
            at = before
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def matched(i: np.ndarray, j: np.ndarray, cost: np.ndarray, free: float) -> np.ndarray:
    """Which candidate pairs (i, j) make the matching of least total cost, where a pair left out costs `free`.

    Only pairs cheaper than `free` can. Pairs that share no row fall into parts that are solved alone, so
    no matrix of all rows is built.
    """
    chosen = np.zeros(len(i), bool)
    able = np.flatnonzero(cost < free)
    if not len(able):
        return chosen
    left, a = np.unique(i[able], return_inverse=True)
    right, b = np.unique(j[able], return_inverse=True)
    part = least_reached(len(left) + len(right), a, b + len(left))[a]
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(own) == 1:
            chosen[able[own]] = True
            continue
        rows, r = np.unique(a[own], return_inverse=True)
        columns, c = np.unique(b[own], return_inverse=True)
        full = np.full((len(rows), len(columns) + len(rows)), free)  # each row may also stay free
        full[:, : len(columns)] = 1e9
        full[r, c] = cost[able[own]]
        got = assignment(full)
        chosen[able[own[got[r] == c]]] = True
    return chosen


def _near(at: np.ndarray, guess: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a guess and a place nearer than the radius, found by square cells of that size."""
    cell, own = np.floor(at[:, :2] / radius).astype(np.int64), np.floor(guess[:, :2] / radius).astype(np.int64)
    low = np.minimum(cell.min(0), own.min(0)) - 1
    wide = int(max(cell[:, 1].max(), own[:, 1].max()) - low[1] + 3)
    key = (cell[:, 0] - low[0]) * wide + cell[:, 1] - low[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    rows, found = [], []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            wanted = (own[:, 0] - low[0] + dy) * wide + own[:, 1] - low[1] + dx
            first, last = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            n = last - first
            rows.append(np.repeat(np.arange(len(guess)), n))
            found.append(order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
    i, j = np.concatenate(rows), np.concatenate(found)
    near = ((guess[i] - at[j]) ** 2).sum(1) <= radius * radius
    return i[near], j[near]


class _Tracks:
    """Tracks of one key that may still go on: place and speed with their covariance at the last detection."""

    def __init__(self, model: str, state: dict | None, max_lost: int, n_features: int):
        size = len(MODELS[model].step)
        state = state or {"next": 1, "track": [], "frame": [], "x": [], "p": [], "look": []}
        self.model, self.max_lost, self.following = model, max_lost, state["next"]
        self.track, self.frame = np.array(state["track"], np.int64), np.array(state["frame"], np.int64)
        self.x, self.p = np.array(state["x"], float).reshape(-1, size), np.array(state["p"], float).reshape(-1, size, size)
        self.look = np.array(state["look"], float).reshape(len(self.track), n_features)

    def state(self) -> str:
        return json.dumps({"next": int(self.following), "track": self.track.tolist(), "frame": self.frame.tolist(), "x": self.x.tolist(), "p": self.p.tolist(), "look": self.look.tolist()})

    def keep(self, some):
        for name in ("track", "frame", "x", "p", "look"):
            setattr(self, name, getattr(self, name)[some])

    def predicted(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and covariance of each track so many frames after its last detection."""
        x, p = self.x.copy(), self.p.copy()
        for k in np.unique(frames):
            own = frames == k
            step, noise = _ahead(self.model, int(k))
            x[own], p[own] = x[own] @ step.T, step @ p[own] @ step.T + noise
        return x, p

    def take(self, frame: int, at: np.ndarray, look: np.ndarray, free: float, accuracy: float, radius: float, visual: bool, motion: bool):
        """Links the detections of a frame; gives their tracks, and (track, frame, place) of the frames that a found track had missed."""
        self.keep(frame - self.frame <= self.max_lost + 1)
        r = np.array(MODELS[self.model].measured)
        ids, missed = np.zeros(len(at), np.int64), []
        if len(self.track) and len(at):
            x, p = self.predicted(frame - self.frame)
            s = p[:, :3, :3] + r
            i, j = _near(at, x[:, :3], radius)
            off = at[j] - x[i, :3]
            far = np.einsum("na,nab,nb->n", off, np.linalg.inv(s)[i], off)
            cost = far / 2 if motion else np.zeros(len(i))
            if visual:
                a, b = self.look[i], look[j]
                size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
                cost = cost - np.log(np.clip(np.where(size > 0, (a * b).sum(1) / np.where(size > 0, size, 1), 1.0), 1e-12, 1.0))
            gate = far <= accuracy * accuracy
            i, j, cost = i[gate], j[gate], cost[gate]
            order = np.lexsort((i, j))
            i, j, cost = i[order], j[order], cost[order]
            chosen = matched(j, i, cost, free)
            i, j = i[chosen], j[chosen]
            for t in i[frame - self.frame[i] > 1]:
                for f in range(int(self.frame[t]) + 1, frame):
                    step, _ = _ahead(self.model, f - int(self.frame[t]))
                    missed.append((int(self.track[t]), f, *(step @ self.x[t])[:3]))
            gain = p[i][:, :, :3] @ np.linalg.inv(s[i])
            self.x[i] = x[i] + np.einsum("nab,nb->na", gain, at[j] - x[i, :3])
            fresh = p[i] - gain @ p[i][:, :3, :]
            self.p[i] = (fresh + fresh.transpose(0, 2, 1)) / 2
            self.frame[i], self.look[i] = frame, look[j]
            ids[j] = self.track[i]
        begun = np.flatnonzero(ids == 0)
        ids[begun] = self.following + np.arange(len(begun))
        self.following += len(begun)
        size = self.x.shape[1]
        x = np.zeros((len(begun), size))
        x[:, :3] = at[begun]
        self.track, self.frame = np.append(self.track, ids[begun]), np.append(self.frame, np.full(len(begun), frame))
        self.x, self.p = np.concatenate([self.x, x]), np.concatenate([self.p, np.broadcast_to(np.array(MODELS[self.model].start), (len(begun), size, size))])
        self.look = np.concatenate([self.look, look[begun]])
        return ids, missed


def track_objects(
    objects: DataFrame, keys: Sequence[str], model: str = "random-walk", mode: str = "motion", features: Sequence[str] = (), max_lost: int = 1, prob_not_assign: float = 0.1, accuracy: float = 2.0, search_radius: float = 40.0, window: int = 64
) -> DataFrame:
    """(keys, frame, label, x, y, z, track, dummy): objects (keys, frame, label, x, y and maybe z) with the track of each, from 1 within a key.

    In each frame the tracks seen at most max_lost + 1 frames ago are predicted and matched with the
    detections so that the total cost is least. A pair costs minus the log of exp(-d^2 / 2), with d its
    Mahalanobis distance, in the modes motion and motion-visual, and minus the log of the cosine of their
    features in motion-visual and visual; leaving a pair out costs minus the log of prob_not_assign. Pairs
    over `accuracy` in d or over search_radius in distance are none. A detection without a track begins one;
    numbers follow frame and label. Frames that a track missed before it was found again are rows with
    dummy true, no label and the predicted place. Rows whose frame, place or a feature in use is null or not finite are left out;
    of rows with one key, frame and label the first by place counts.
    """
    if model not in MODELS or mode not in ("motion", "motion-visual", "visual"):
        raise ValueError(f"no such model or mode: {model}, {mode}")
    features, visual = list(features) if mode != "motion" else [], mode != "motion"
    if visual and not features:
        raise ValueError(f"mode {mode} needs features")
    z = F.col("z").cast("double") if "z" in objects.columns else F.lit(0.0)
    numbers = {"x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "z": z, **{f"_f{k}": F.col(c).cast("double") for k, c in enumerate(features)}}
    rows = objects.select(*keys, F.col("frame").cast("int").alias("frame"), F.col("label").cast("long").alias("label"), *[c.alias(n) for n, c in numbers.items()])
    good = F.col("frame").isNotNull()
    for n in numbers:
        good = good & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    from cytoframe.operators.tracks import keep_first

    rows = durable(keep_first(rows.where(good), [*keys, "frame", "label"], list(numbers)))
    free = -float(np.log(prob_not_assign))
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    schema = f"{kinds}, frame int, label long, x double, y double, z double, track long, dummy boolean, state string"

    def link(key, states, found):
        tracks = _Tracks(model, json.loads(states.column("state")[0].as_py()) if states.num_rows else None, max_lost, len(features))
        found = found.sort_by([("frame", "ascending"), ("label", "ascending")])
        frames = found.column("frame").to_numpy()
        at, look = (np.stack([found.column(c).to_numpy() for c in some], axis=1) if some else np.zeros((len(frames), 0)) for some in (AXES, [f"_f{k}" for k in range(len(features))]))
        ids, missed = np.zeros(len(frames), np.int64), []
        cuts = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1)) if len(frames) else []
        for start, end in zip(cuts, [*cuts[1:], len(frames)]):
            ids[start:end], more = tracks.take(int(frames[start]), at[start:end], look[start:end], free, accuracy, search_radius, visual, mode != "visual")
            missed += more
        n, one = found.num_rows, missed + [(None, None, None, None, None)]  # the frames that tracks missed, and the state
        columns = {
            "frame": [*frames.tolist(), *[r[1] for r in one]], "label": [*found.column("label").to_pylist(), *[None] * len(one)], **{c: [*at[:, k].tolist(), *[r[2 + k] for r in one]] for k, c in enumerate(AXES)},
            "track": [*ids.tolist(), *[r[0] for r in one]], "dummy": [False] * n + [True] * len(missed) + [None], "state": [None] * (n + len(missed)) + [tracks.state()],
        }
        types = {"frame": pa.int32(), "label": pa.int64(), "track": pa.int64(), "dummy": pa.bool_(), "state": pa.string()}
        named = {k: pa.array([v.as_py()] * (n + len(one)), v.type) for k, v in zip(keys, key)}
        return pa.table({**named, **{c: pa.array(v, types.get(c, pa.float64())) for c, v in columns.items()}})

    low, high = rows.agg(F.min("frame"), F.max("frame")).first()
    spark = objects.sparkSession
    states, done = spark.createDataFrame([], f"{kinds}, state string"), None
    for first in [] if low is None else range(low, high + 1, window):
        found = rows.where(F.col("frame").between(first, first + window - 1))
        step = durable(states.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(link, schema))
        states = step.where("state IS NOT NULL").select(*keys, "state")
        linked = step.where("state IS NULL").drop("state")
        done = linked if done is None else done.unionByName(linked)
    return spark.createDataFrame([], schema).drop("state") if done is None else done

