"""Persistent random walk: expected displacements, likelihood, multistart fits, simulation and scoring.

A velocity that decays with time constant tau and has stationary scale v per axis is integrated and
observed with noise. The likelihood runs a two-state Kalman filter per axis. Its gains depend on the
steps in time alone and its innovations are linear in the positions, so segments with the same steps
enter through their number and the sum of their outer products: a fit needs these moments, not the segments.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.session import durable
from cytoframe.operators.summaries import global_quantiles

#: Bounds of (tau, velocity scale, observation noise).
LOWER, UPPER = np.log([1e-4, 1e-8, 1e-8]), np.log([1e6, 1e6, 1e6])
#: Sums that a task holds before it hands them on.
HELD_MOMENTS = 4000


def expected_msd(t: Column, tau: Column, velocity: Column, noise: Column) -> Column:
    """4 v^2 tau^2 (t / tau - 1 + exp(-t / tau)) + 4 noise^2, over both axes."""
    a = t / tau
    return 4 * velocity * velocity * tau * tau * (a + F.expm1(-a)) + 4 * noise * noise


def diffusivity(velocity: Column, tau: Column) -> Column:
    return velocity * velocity * tau


def position_variance(dt: Column, tau: Column, velocity: Column) -> Column:
    """Variance of the position one step on, given where it starts; a series stands in for small steps."""
    a = dt / tau
    one, two = -F.expm1(-a), -F.expm1(-2 * a)
    unit = F.when(a < 1e-4, a**3 / 3 - a**4 / 4 + 7 * a**5 / 60).otherwise(a - 2 * one + 0.5 * two)
    return 2 * velocity * velocity * tau * tau * unit


def transition(dt, tau: float, velocity: float):
    """(f12, phi, q11, q12, q22) of a step; q is mended where rounding leaves it indefinite."""
    a = np.asarray(dt, float) / tau
    phi, one, two = np.exp(-a), -np.expm1(-a), -np.expm1(-2 * a)
    unit = np.where(a < 1e-4, a**3 / 3 - a**4 / 4 + 7 * a**5 / 60, a - 2 * one + 0.5 * two)
    v2 = velocity * velocity
    q11, q12, q22 = np.maximum(2 * v2 * tau * tau * unit, 0), v2 * tau * one * one, np.maximum(v2 * two, 0)
    short = (q22 > 0) & (q11 * q22 < q12 * q12)
    return tau * one, phi, np.where(short, q12 * q12 / np.where(q22 > 0, q22, 1) + np.finfo(float).eps, q11), q12, q22


def log_likelihood(log_params, y: np.ndarray, dt: np.ndarray, real: np.ndarray) -> float:
    """Sum over padded series y (series, time) with steps dt and mask real (series, time - 1) of true steps."""
    tau, velocity, noise = np.exp(log_params)
    if not np.isfinite([tau, velocity, noise]).all():
        return -np.inf
    r = noise * noise
    f12, phi, q11, q12, q22 = transition(dt, tau, velocity)
    position, speed = y[:, 0].copy(), np.zeros(len(y))
    p11, p12, p22 = np.full(len(y), r), np.zeros(len(y)), np.full(len(y), velocity * velocity)
    total = 0.0
    for k in range(dt.shape[1]):
        on = real[:, k]
        if not on.any():
            break
        f, h = f12[:, k], phi[:, k]
        position = position + f * speed
        speed = h * speed
        a11 = p11 + 2 * f * p12 + f * f * p22 + q11[:, k]
        a12 = h * (p12 + f * p22) + q12[:, k]
        a22 = h * h * p22 + q22[:, k]
        s = a11 + r
        if not (np.isfinite(s[on]).all() and (s[on] > 0).all()):
            return -np.inf
        gap = y[:, k + 1] - position
        total -= 0.5 * (np.log(2 * np.pi) + np.log(s[on]) + gap[on] ** 2 / s[on]).sum()
        k1, k2 = a11 / s, a12 / s
        position, speed = position + k1 * gap, speed + k2 * gap
        keep = 1 - k1
        p11 = keep * keep * a11 + k1 * k1 * r
        p12 = keep * (a12 - k2 * a11) + k1 * k2 * r
        p22 = a22 - 2 * k2 * a12 + k2 * k2 * a11 + k2 * k2 * r
    return float(total)


def padded(frames: Sequence, xs: Sequence, ys: Sequence, interval: float):
    """Both axes of segments as rows padded to one length: values, steps and mask."""
    n = max(map(len, frames))
    m = len(frames)
    y, dt, real = np.zeros((2 * m, n)), np.ones((2 * m, n - 1)), np.zeros((2 * m, n - 1), bool)
    for i, (f, a, b) in enumerate(zip(frames, xs, ys)):
        step = np.diff(np.asarray(f, float)) * interval
        for row, v in ((i, a), (m + i, b)):
            y[row, : len(v)], dt[row, : len(step)], real[row, : len(step)] = v, step, True
    return y, dt, real


def _transition_slopes(dt, tau: float, velocity: float):
    """transition() and, for each of its parts, the derivatives by the logs of tau and of velocity."""
    f12, phi, q11, q12, q22 = transition(dt, tau, velocity)
    a = np.asarray(dt, float) / tau
    one, v2 = -np.expm1(-a), velocity * velocity
    rise = np.where(a < 1e-4, a * a - a**3 + 7 * a**4 / 12, one * one)  # of the unit variance by a
    plain = np.maximum(2 * v2 * tau * tau * np.where(a < 1e-4, a**3 / 3 - a**4 / 4 + 7 * a**5 / 60, a - 2 * one + 0.5 * -np.expm1(-2 * a)), 0)
    d12, d22 = (q12 - 2 * v2 * tau * one * a * phi, 2 * q12), (-2 * v2 * a * phi * phi, 2 * q22)
    mended = q11 != plain
    safe = np.where(q22 > 0, q22, 1)
    d11 = tuple(np.where(mended, (2 * q12 * x * safe - q12 * q12 * y) / (safe * safe), z) for x, y, z in zip(d12, d22, (2 * plain - 2 * v2 * tau * tau * a * rise, 2 * plain)))
    zero = np.zeros_like(a)
    return (f12, phi, q11, q12, q22), ((f12 - dt * phi, zero), (a * phi, zero), d11, d12, d22)


def moment_score(log_params, dt: np.ndarray, real: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
    """log_likelihood of all series and its gradient by the log parameters, from moments.

    dt: rows of steps, with mask real; n: series of each row; s: sums of outer products of positions less
    the first. Derivatives by (tau, velocity, noise) run along with the filter.
    """
    tau, velocity, noise = np.exp(log_params)
    if not np.isfinite([tau, velocity, noise]).all():
        return -np.inf, np.zeros(3)
    r, v2 = noise * noise, velocity * velocity
    parts, slopes = _transition_slopes(dt, tau, velocity)
    rows, steps = dt.shape
    by_three = [np.stack([*d, np.zeros_like(dt)]) for d in slopes]  # nothing of a step depends on the noise
    position, speed = np.zeros((rows, steps)), np.zeros((rows, steps))  # as weights of the positions
    d_position, d_speed = np.zeros((3, rows, steps)), np.zeros((3, rows, steps))
    p11, p12, p22 = np.full(rows, r), np.zeros(rows), np.full(rows, v2)
    d_r = np.array([0, 0, 2 * r])[:, None]
    d11, d12, d22 = np.zeros((3, rows)) + d_r, np.zeros((3, rows)), np.zeros((3, rows)) + np.array([0, 2 * v2, 0])[:, None]
    gaps, variance = np.zeros((rows, steps, steps)), np.ones((rows, steps))
    d_gaps, d_variance = np.zeros((3, rows, steps, steps)), np.zeros((3, rows, steps))
    for k in range(steps):
        f, h, q11, q12, q22 = (x[:, k] for x in parts)
        df, dh, dq11, dq12, dq22 = (x[:, :, k] for x in by_three)
        d_position = d_position + df[..., None] * speed + f[:, None] * d_speed
        d_speed = dh[..., None] * speed + h[:, None] * d_speed
        position, speed = position + f[:, None] * speed, h[:, None] * speed
        a11, a12, a22 = p11 + 2 * f * p12 + f * f * p22 + q11, h * (p12 + f * p22) + q12, h * h * p22 + q22
        e11 = d11 + 2 * (df * p12 + f * d12) + 2 * f * df * p22 + f * f * d22 + dq11
        e12 = dh * (p12 + f * p22) + h * (d12 + df * p22 + f * d22) + dq12
        e22 = 2 * h * dh * p22 + h * h * d22 + dq22
        v = variance[:, k] = a11 + r
        dv = d_variance[:, :, k] = e11 + d_r
        gap = -position
        gap[:, k] += 1
        gaps[:, k], d_gaps[:, :, k] = gap, -d_position
        k1, k2 = a11 / v, a12 / v
        g1, g2 = (e11 - k1 * dv) / v, (e12 - k2 * dv) / v
        d_position, d_speed = d_position + g1[..., None] * gap - k1[:, None] * d_position, d_speed + g2[..., None] * gap - k2[:, None] * d_position
        position, speed = position + k1[:, None] * gap, speed + k2[:, None] * gap
        keep = 1 - k1
        p11 = keep * keep * a11 + k1 * k1 * r
        p12 = keep * (a12 - k2 * a11) + k1 * k2 * r
        p22 = a22 - 2 * k2 * a12 + k2 * k2 * a11 + k2 * k2 * r
        d11 = -2 * keep * g1 * a11 + keep * keep * e11 + 2 * k1 * g1 * r + k1 * k1 * d_r
        d12 = -g1 * (a12 - k2 * a11) + keep * (e12 - g2 * a11 - k2 * e11) + (g1 * k2 + k1 * g2) * r + k1 * k2 * d_r
        d22 = e22 - 2 * (g2 * a12 + k2 * e12) + 2 * k2 * g2 * a11 + k2 * k2 * e11 + 2 * k2 * g2 * r + k2 * k2 * d_r
    if not (np.isfinite(variance[real]).all() and (variance[real] > 0).all()):
        return -np.inf, np.zeros(3)
    variance = np.where(real, variance, 1)
    weighted = gaps @ s
    squares = (weighted * gaps).sum(2)
    d_squares = 2 * (weighted * d_gaps).sum(3)
    squares, d_squares = np.maximum(squares, 0), np.where(squares > 0, d_squares, 0)
    each = n[:, None] * (np.log(2 * np.pi) + np.log(variance)) + squares / variance
    slope = n[:, None] * d_variance / variance + d_squares / variance - squares * d_variance / variance**2
    return float(-0.5 * each[real].sum()), -0.5 * np.array([x[real].sum() for x in slope])


def moment_log_likelihood(log_params, dt: np.ndarray, real: np.ndarray, n: np.ndarray, s: np.ndarray) -> float:
    return moment_score(log_params, dt, real, n, s)[0]


def padded_moments(steps: Sequence, n: Sequence, s: Sequence, interval: float):
    """Moments of segments by their steps in frames, padded to one length: steps, mask, numbers of series, sums."""
    most = max(map(len, steps))
    dt, real, total = np.ones((len(steps), most)), np.zeros((len(steps), most), bool), np.zeros((len(steps), most, most))
    for i, (step, square) in enumerate(zip(steps, s)):
        k = len(step)
        dt[i, :k], real[i, :k] = np.asarray(step, float) * interval, True
        total[i, :k, :k] = np.asarray(square, float).reshape(k, k)
    return dt, real, 2.0 * np.asarray(n, float), total


def empirical_start(scale: dict) -> np.ndarray:
    """(tau, velocity, noise) from medians of steps."""
    velocity = scale["speed"][1] / np.sqrt(2) if scale["speed"] is not None else 1.0
    noise = scale["move"] / 10
    return np.array([max(scale["dt"] * 2, scale["least_dt"]), velocity if velocity > 0 else 1.0, noise if noise > 0 else 0.1])


def _positive_range(values, fallback):
    low, high = (values[0], values[-1]) if values is not None else fallback
    return (low * 0.5, high * 2) if low == high else (low, high)


def starts(scale: dict, n: int, seed: int) -> np.ndarray:
    """n rows of (tau, velocity, noise): the empirical start, then log-uniform draws around the data's scales."""
    first = empirical_start(scale)
    speeds = _positive_range(scale["speed"], first[1] * np.sqrt(2) * np.array([0.25, 4]))
    moves = _positive_range(scale["moves"], first[2] * 10 * np.array([0.25, 4]))
    ranges = np.log([[scale["least_dt"], max(scale["least_dt"] * 2, scale["dt"] * 50)], [speeds[0] / np.sqrt(2), speeds[1] / np.sqrt(2)], [moves[0] * 0.02, moves[1] * 0.5]])
    drawn = np.random.default_rng(seed).uniform(ranges[:, 0], ranges[:, 1], (n - 1, 3))
    return np.vstack([first, np.exp(drawn)])


#: Steps whose changes a descent remembers, its steps at most, and the relative fall in value that ends it.
MEMORY, MOST_STEPS, TOLERANCE = 5, 1000, 1e7 * np.finfo(float).eps


def minimise(f, start: np.ndarray, lower=LOWER, upper=UPPER, steps: int = MOST_STEPS, tolerance: float = TOLERANCE) -> dict:
    """Limited-memory quasi-Newton descent within bounds; f gives (value, gradient).

    Parameters at a bound that the descent would cross stay there for a step; the others move along the
    two-loop direction of the last changes, cut at the bounds, until the value falls enough. Gives the
    point x, its value, whether it converged, the number of evaluations, and at_bound of each parameter.
    """
    x = np.clip(start, lower, upper)
    value, slope = f(x)
    n, changes = 1, []

    def result(done):
        return {"x": x, "value": value, "converged": bool(done and np.isfinite(value)), "evaluations": n, "at_bound": (x <= lower) | (x >= upper)}

    for _ in range(steps):
        free = ~(((x <= lower) & (slope > 0)) | ((x >= upper) & (slope < 0)))
        if not np.isfinite(value) or not free.any() or np.abs(slope[free]).max() == 0:
            return result(True)
        move, undo = np.where(free, slope, 0.0), []
        for s, y in reversed(changes):
            share = (s[free] @ move[free]) / (s[free] @ y[free]) if s[free] @ y[free] > 1e-12 else 0.0
            undo.append(share)
            move = move - share * np.where(free, y, 0)
        if changes and (yy := changes[-1][1][free] @ changes[-1][1][free]) > 0 and (sy := changes[-1][0][free] @ changes[-1][1][free]) > 1e-12:
            move = move * (sy / yy)
        for (s, y), share in zip(changes, reversed(undo)):
            if share or s[free] @ y[free] > 1e-12:
                back = (y[free] @ move[free]) / (s[free] @ y[free])
                move = move + (share - back) * np.where(free, s, 0)
        move = -move
        if move @ slope >= 0:
            move, changes = -np.where(free, slope, 0.0), []
        scale = min(1.0, (2.0 if changes else 1.0) / max(np.abs(move).max(), 1e-300))
        while True:
            new = np.clip(x + scale * move, lower, upper)
            got, fresh = f(new)
            n += 1
            if np.isfinite(got) and got <= value + 1e-4 * ((new - x) @ slope):
                break
            scale *= 0.5
            if scale * np.abs(move).max() < 1e-10:
                return result(True)  # nothing lower in reach
        s, y, fall = new - x, fresh - slope, value - got
        x, value, slope = new, got, fresh
        if fall <= tolerance * max(abs(value + fall), abs(value), 1.0):
            return result(True)
        if s @ y > 1e-12:
            changes = [*changes, (s, y)][-MEMORY:]
    return result(False)


FIT = "tau double, velocity_scale double, obs_noise double, effective_diffusivity double, log_likelihood double, fit_status string, start_tau double, start_velocity_scale double, start_obs_noise double, n_segments long, total_track_time double, n_evaluations int, at_bounds string"


def segments(df: DataFrame, keys: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """Finite points of each segment in frame order, a frame once, two frames at least: arrays frames, xs, ys."""
    from cytoframe.operators.summaries import finite
    from cytoframe.operators.tracks import keep_first

    good = df.where(finite(F.col("x").cast("double")).isNotNull() & finite(F.col("y").cast("double")).isNotNull() & F.col("frame").isNotNull())
    rows = keep_first(good, [*keys, *ident, "frame"], ["x", "y"]).groupBy(*keys, *ident).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    return rows.select(*keys, *ident, F.col("p.frame").alias("frames"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


def step_scales(rows: DataFrame, keys: Sequence[str], interval: float) -> DataFrame:
    """By condition, of the steps of all its segments: dt (median), least_dt, time, move (median), speed and moves (5, 50, 95 % of the positive ones)."""
    at = lambda c, i: F.get(c, i).cast("double")
    step = F.transform(F.sequence(F.lit(1), F.size("frames") - 1), lambda i: F.struct(((at("frames", i) - at("frames", i - 1)) * interval).alias("dt"), F.hypot(at("xs", i) - at("xs", i - 1), at("ys", i) - at("ys", i - 1)).alias("move")))
    each = rows.select(*keys, F.explode(step).alias("s")).select(*keys, "s.dt", "s.move").withColumn("speed", F.col("move") / F.col("dt"))
    each = durable(each)
    shares = {"_low": 0.05, "_middle": 0.5, "_high": 0.95}
    out = each.groupBy(*keys).agg(F.min("dt").alias("least_dt"), F.sum("dt").alias("time"))
    for name, value, rule in (("dt", "dt", None), ("move", "move", None), ("speed", "speed", "speed > 0"), ("moves", "move", "move > 0")):
        q = global_quantiles(each if rule is None else each.where(rule), value, shares, keys)
        q = q.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_middle") if rule is None else F.array(*shares)).alias(name))
        out = out.join(q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])
    return out


def moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, steps, n, s): for segments of a condition with the same steps in frames their number and sums of outer products.

    A task adds up what it reads, so a row per task, condition and steps is shuffled. Runs without gaps
    have one row of steps for each length.
    """
    names = list(keys)
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in names) + ", steps array<double>, n long, s array<double>"

    def collect(batches):
        held, fields = {}, None
        for batch in batches:
            fields = [batch.schema.field(k) for k in names]
            found = {}
            for key, f, x, y in zip(zip(*[batch.column(k).to_pylist() for k in names]), *[batch.column(c).to_pylist() for c in ("frames", "xs", "ys")]):
                place = found.setdefault((key, tuple(np.diff(np.asarray(f, float)).tolist())), [])
                place += [np.asarray(x[1:], float) - x[0], np.asarray(y[1:], float) - y[0]]
            for at, series in found.items():
                z = np.array(series)
                n, s = held.get(at, (0, 0.0))
                held[at] = n + len(z) // 2, s + z.T @ z
            if len(held) > HELD_MOMENTS:
                yield packed(held, fields)
                held = {}
        if held:
            yield packed(held, fields)

    def packed(held, fields):
        columns = [pa.array([key[i] for key, _ in held], f.type) for i, f in enumerate(fields)]
        columns += [pa.array([list(steps) for _, steps in held], pa.list_(pa.float64())), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.ravel().tolist() for _, s in held.values()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "steps", "n", "s"])

    def add(key, table):
        return pd.DataFrame({**dict(zip(names, [[k] for k in key])), "steps": [table["steps"].iloc[0]], "n": [table["n"].sum()], "s": [np.sum(np.stack(table["s"].tolist()), 0)]})

    return rows.select(*names, "frames", "xs", "ys").mapInArrow(collect, kinds).groupBy(*names, "steps").applyInPandas(lambda key, table: add(key[:-1], table), kinds)


def fits(df: DataFrame, keys: Sequence[str], ident: Sequence[str], interval: float = 2.0, n_starts: int = 3, seed: int = 17, max_segments: int = 0) -> DataFrame:
    """One row per condition and start: parameters, log likelihood and status.

    Every segment counts, unless max_segments (0: no bound) keeps a condition's first by a hash of their
    identity. Tasks add up moments; a start is a task of its own over these. A condition without segments
    gives a row `no_valid_segments`, a fit that fails one whose status says why.
    """
    from pyspark.sql import Window

    rows = segments(df, keys, ident)
    if max_segments > 0:
        order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ident])), *ident)
        rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_segments).drop("_rank")
    names = list(keys)
    start_ids = F.explode(F.sequence(F.lit(1), F.lit(n_starts)))
    sums, scales = (part.withColumn("start_id", start_ids).groupBy(*names, "start_id") for part in (moments(rows, keys), step_scales(rows, keys, interval)))

    def fit(key, table, scale):
        n, time = int(table["n"].sum()) if len(table) else 0, float(scale["time"].iloc[0]) if len(scale) else None
        try:
            table = table.assign(_k=[tuple(x) for x in table["steps"]]).sort_values("_k")
            scale = scale.iloc[0].to_dict()
            data = padded_moments(table["steps"].tolist(), table["n"].tolist(), table["s"].tolist(), interval)
            begin = starts(scale, n_starts, seed)[key[-1] - 1]

            def loss(p):
                value, slope = moment_score(p, *data)
                return -value, -slope

            got = minimise(loss, np.log(begin))
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([[*key, *[None] * 5, f"error: {type(e).__name__}: {e}", *[None] * 3, n, time, None, None]])
        tau, velocity, noise = np.exp(got["x"])
        bound = ";".join(name for name, at in zip(("tau", "velocity_scale", "obs_noise"), got["at_bound"]) if at)
        return pd.DataFrame([[*key, tau, velocity, noise, velocity * velocity * tau, -got["value"], "converged" if got["converged"] else "step_limit", *begin, n, time, got["evaluations"], bound]])

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in names)
    done = sums.cogroup(scales).applyInPandas(fit, f"{kinds}, start_id int, {FIT}")
    missing = df.select(*names).distinct().join(rows.select(*names).distinct(), names, "left_anti")
    return done.unionByName(missing.select(*names, F.lit("no_valid_segments").alias("fit_status"), F.lit(0).cast("long").alias("n_segments")), allowMissingColumns=True)


def best_fits(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The start with the greatest likelihood by condition (ties: the least start_id), how many converged and the gap to the next."""
    from cytoframe.operators.tracks import keep_first

    ranked = df.groupBy(*keys).agg(F.sort_array(F.collect_list("log_likelihood"), asc=False).alias("_l"), F.count_if(F.col("fit_status") == "converged").alias("n_converged"), F.count("*").alias("n_starts"))
    summary = ranked.select(*keys, "n_converged", "n_starts", (F.get("_l", F.lit(0)) - F.get("_l", F.lit(1))).alias("gap_to_next"))
    return keep_first(df, keys, [F.col("log_likelihood").desc_nulls_last(), "start_id"]).join(summary, list(keys), "left")


def simulate(tracks: DataFrame, interval: float = 2.0, seed: int = 17) -> DataFrame:
    """Simulated points of rows (track_id, n_frames, tau, velocity_scale, obs_noise): track_id, frame, x, y.

    The state starts at the origin with a stationary velocity; draws follow from the track and the
    seed alone, so any partitioning gives the same tracks.
    """

    def walked(part):
        n, most = part["n_frames"].to_numpy(int), int(part["n_frames"].max())
        noise = np.zeros((len(part), most + 1, 3, 2))  # of the position, of the state's two parts, by frame
        for row, t, m in zip(noise, part["track_id"], n):
            row[: m + 1] = np.random.default_rng([seed, int(t) & 0x7FFFFFFF]).normal(size=(m + 1, 3, 2))
        velocity, seen_by = (part[c].to_numpy(float)[:, None] for c in ("velocity_scale", "obs_noise"))
        f12, phi, q11, q12, q22 = (v[:, None] for v in transition(np.full(len(part), interval), part["tau"].to_numpy(float), velocity[:, 0]))
        a = np.sqrt(q11 + 1e-12)
        b = q12 / a
        c = np.sqrt(np.maximum(q22 + 1e-12 - b * b, 0))
        place, seen = np.zeros((len(part), 2)), np.empty((len(part), most, 2))
        speed = velocity * noise[np.arange(len(part)), n, 0]
        for k in range(most):
            seen[:, k] = place + seen_by * noise[:, k, 0]
            one, two = noise[:, k, 1], noise[:, k, 2]
            place, speed = place + f12 * speed + a * one, phi * speed + b * one + c * two
        real = np.arange(most) < n[:, None]
        frame = np.broadcast_to(np.arange(most, dtype=np.int32), real.shape)[real]
        return pd.DataFrame({"track_id": np.repeat(part["track_id"].to_numpy(), n), "frame": frame, "x": seen[real][:, 0], "y": seen[real][:, 1]})

    def run(parts):
        for part in parts:
            part = part[part["n_frames"] > 0]
            for at in range(0, len(part), 512):  # tracks that walk together
                yield walked(part.iloc[at : at + 512])

    return tracks.select("track_id", "n_frames", "tau", "velocity_scale", "obs_noise").mapInPandas(run, "track_id long, frame int, x double, y double")


def score_logistic(coefficients: dict[str, float]) -> Column:
    """Population-level probability from coefficients; group intercepts and their variance don't enter."""
    eta = F.lit(coefficients["(intercept)"])
    for name, b in coefficients.items():
        if not name.startswith("("):
            eta = eta + b * F.col(name).cast("double")
    return 1 / (1 + F.exp(-eta))
