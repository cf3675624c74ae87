"""Logistic models with a random intercept per group: designs, marginal likelihood, comparison.

The data are passed over by aggregations only: a pass gives sums of products by group, from which the
groups' intercepts are eliminated, so the driver holds a matrix of the terms and, of up to LOCAL_GROUPS groups,
one row of sums each; more groups are eliminated in tables. Rows of few groups are packed in blocks once, so a
pass is one job that reads numbers. For each variance the
coefficients and intercepts are those of greatest penalised likelihood; the variance is the one of
greatest Laplace likelihood, found by a search in one dimension.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.session import durable

#: Groups whose sums a pass brings to the driver.
LOCAL_GROUPS = 10_000

#: Levels that a category may have; groups whose intercepts are broadcast; passes for one variance; bounds of the log of the intercepts' deviation.
MAX_LEVELS, BROADCAST_GROUPS, MAX_PASSES, LOG_DEVIATION = 100, 100_000, 25, (-5.0, 4.0)


@dataclass
class Fit:
    """A fitted model; log_likelihood is marginal (Laplace) with groups and plain without."""

    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    variance: float | None
    log_likelihood: float
    n_rows: int
    n_groups: int
    converged: bool
    passes: int
    categories: dict[str, list[str]]
    offsets: DataFrame | None = field(default=None, repr=False)

    @property
    def df(self) -> int:
        return len(self.names) + (self.variance is not None)

    @property
    def aic(self) -> float:
        return 2 * self.df - 2 * self.log_likelihood

    def estimates(self) -> dict[str, float]:
        found = dict(zip(self.names, self.coefficients.tolist()))
        return found if self.variance is None else found | {"(group variance)": self.variance}


def expanded(df: DataFrame, terms: Sequence[str], categories: dict[str, list[str]] | None = None) -> tuple[dict[str, Column], dict[str, list[str]]]:
    """Named columns of a design, the intercept first: numbers, 0/1 columns of categories against their first level, and products for terms a:b.

    categories: levels by column, as a fit has them; else those of df's text columns in order.
    """
    kinds, categories = dict(df.dtypes), dict(categories or {})
    used = list(dict.fromkeys(itertools.chain(*(t.split(":") for t in terms))))
    for c in used:
        if kinds[c] in ("string", "boolean") and c not in categories:
            found = sorted(str(r[0]) for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 1).collect())
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{c} has over {MAX_LEVELS} levels")
            categories[c] = found

    def own(c):
        if c in categories:
            return {f"{c}{level}": (F.col(c).cast("string") == level).cast("double") for level in categories[c][1:]}
        return {c: F.col(c).cast("double")}

    out = {"(intercept)": F.lit(1.0)}
    for term in terms:
        for parts in itertools.product(*(own(c).items() for c in term.split(":"))):
            column = parts[0][1]
            for _, more in parts[1:]:
                column = column * more
            out[":".join(name for name, _ in parts)] = column
    return out, {c: v for c, v in categories.items() if c in used}


def _dot(values: np.ndarray, columns: Sequence[Column]) -> Column:
    """Sum of products with numbers, which enter as one array so that every pass runs the same compiled code."""
    held = F.lit([float(v) for v in values])
    return sum((F.get(held, i) * c for i, c in enumerate(columns[1:], 1)), F.get(held, 0) * columns[0])


def _log_likelihood(y: Column, eta: Column) -> Column:
    return y * eta - (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))


class _Rows:
    """The rows of a fit: outcome, group and columns of the design, without those that miss any of them."""

    def __init__(self, df: DataFrame, outcome: str, columns: dict[str, Column], group: str | None):
        named = {f"_x{i}": c for i, c in enumerate(columns.values())}
        rows = df.select(F.col(outcome).cast("double").alias("_y"), (F.col(group).cast("string") if group else F.lit("")).alias("_g"), *[c.alias(n) for n, c in named.items()])
        good = F.col("_g").isNotNull()
        for c in ("_y", *named):
            good = good & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
        self.rows, self.columns, self.grouped = durable(rows.where(good)), [F.col(n) for n in named], group is not None
        self.n_rows, self.n_groups = self.rows.agg(F.count("*"), F.count_distinct("_g")).first()
        self.k = len(named)
        self.pairs = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        self.names, self.blocks = None, None
        if self.n_rows and self.n_groups <= LOCAL_GROUPS:
            self.names = np.array(sorted(r[0] for r in self.rows.select("_g").distinct().collect()), dtype=object)
            self.blocks = durable(self._blocks())

    def _blocks(self) -> DataFrame:
        """(codes, numbers): the rows of a batch by group, as the groups' places in names and rows of outcome and design."""
        place, columns = {g: i for i, g in enumerate(self.names.tolist())}, ["_y", *(f"_x{i}" for i in range(self.k))]

        def pack(batches):
            for batch in batches:
                codes = np.array([place[g] for g in batch.column("_g").to_pylist()], np.int32)
                order = np.argsort(codes, kind="stable")
                numbers = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])[order]
                yield pa.RecordBatch.from_pydict({"codes": [codes[order].tobytes()], "numbers": [numbers.tobytes()]}, pa.schema([("codes", pa.binary()), ("numbers", pa.binary())]))

        return self.rows.select("_g", *columns).mapInArrow(pack, "codes binary, numbers binary")

    def local_sums(self, beta: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As sums, on the driver: information (groups, k, k), score (groups, k) and log likelihood (groups); a task adds up its blocks."""
        k, groups, pairs = self.k, len(self.names), np.array(self.pairs)
        first, second, width = pairs[:, 0], pairs[:, 1], len(pairs) + self.k + 1

        def add(batches):
            total = np.zeros((groups, width))
            for batch in batches:
                for c, n in zip(batch.column("codes"), batch.column("numbers")):
                    codes = np.frombuffer(c.as_buffer(), np.int32)
                    if not len(codes):
                        continue
                    numbers = np.frombuffer(n.as_buffer()).reshape(-1, k + 1)
                    y, x = numbers[:, 0], numbers[:, 1:]
                    eta = x @ beta + u[codes]
                    p = np.exp(-np.logaddexp(0, -eta))
                    w = np.maximum(p * (1 - p), 1e-9)
                    parts = np.column_stack([w[:, None] * x[:, first] * x[:, second], (y - p)[:, None] * x, y * eta - np.logaddexp(0, eta)])
                    starts = np.flatnonzero(np.diff(codes, prepend=-1))
                    total[codes[starts]] += np.add.reduceat(parts, starts, axis=0)
            seen = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_pydict({"code": pa.array(seen.astype(np.int32)), **{f"v{i}": total[seen, i] for i in range(width)}})

        found = self.blocks.mapInArrow(add, ", ".join(["code int", *(f"v{i} double" for i in range(width))]))
        rows = np.array(sorted(found.groupBy("code").agg(*[F.sum(f"v{i}") for i in range(width)]).collect()), float)[:, 1:]
        h = np.zeros((groups, k, k))
        h[:, first, second] = h[:, second, first] = rows[:, : len(pairs)]
        return h, rows[:, len(pairs) : -1], rows[:, -1]

    def local_at_variance(self, beta: np.ndarray, u: np.ndarray | None, variance: float | None):
        """As at_variance, with the groups' sums and intercepts on the driver."""
        tight = None if variance is None else 1 / variance
        u = np.zeros(len(self.names)) if u is None else u
        best, full, t = -math.inf, None, 1.0
        for n in range(1, MAX_PASSES + 1):
            h, g, own = self.local_sums(beta, u)
            value, penalty, move_u, largest = own.sum(), 0.0, np.zeros_like(u), 0.0
            across = h[:, 0, :]
            if tight is not None:
                d, back = h[:, 0, 0] + tight, g[:, 0] - tight * u
                value, penalty, largest = value - (u * u).sum() * tight / 2, np.log1p(h[:, 0, 0] / tight).sum() / 2, np.abs(back / d).max()
                h = h - across[:, :, None] * across[:, None, :] / d[:, None, None]
                g = g - across * (back / d)[:, None]
            if value < best - 1e-9 * max(1.0, abs(best)) and t > 1e-6:  # too far: half of the step
                t /= 2
                beta, u = full[0] + t * full[2], full[1] + t * full[3]
                continue
            h, g = h.sum(0), g.sum(0)
            # With full freedom of the intercepts the level is tied to the penalty, so h may be near singular.
            move = np.linalg.lstsq(h, g, rcond=1e-12)[0]
            done = max(np.abs(move).max(), largest) < 1e-6 * (1 + np.abs(beta).max())
            if done or n == MAX_PASSES:
                return beta, u, value - penalty, h, done, n
            if tight is not None:
                move_u = (back - across @ move) / d
            best, t, full = value, 1.0, (beta, u, move, move_u)
            beta, u = beta + move, u + move_u
        raise AssertionError

    def with_offsets(self, offsets: DataFrame | None) -> DataFrame:
        if offsets is None:
            return self.rows.withColumn("_u", F.lit(0.0))
        some = offsets.select("_g", "_u")
        return self.rows.join(F.broadcast(some) if self.n_groups <= BROADCAST_GROUPS else some, "_g")

    def sums(self, beta: np.ndarray, offsets: DataFrame | None) -> DataFrame:
        """By group: information, score and log likelihood at beta and the groups' intercepts."""
        y, eta = F.col("_y"), _dot(beta, self.columns) + F.col("_u")
        p = 1 / (1 + F.exp(-eta))
        rows = self.with_offsets(offsets).withColumns({"_w": F.greatest(p * (1 - p), F.lit(1e-9)), "_s": y - p, "_l": _log_likelihood(y, eta)})
        x = self.columns
        every = [F.sum(F.col("_w") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in self.pairs] + [F.sum(F.col("_s") * c).alias(f"g{i}") for i, c in enumerate(x)]
        return rows.groupBy("_g").agg(*every, F.sum("_l").alias("l"), F.first("_u").alias("_u"))

    def at_variance(self, beta: np.ndarray, offsets: DataFrame | None, variance: float | None):
        """(beta, intercepts, objective, information, converged, passes) of greatest penalised likelihood for one variance, by Newton steps with halving."""
        if self.blocks is not None:
            return self.local_at_variance(beta, offsets, variance)
        tight = None if variance is None else 1 / variance
        best, full, move, t = -math.inf, None, np.zeros(self.k), 1.0
        for n in range(1, MAX_PASSES + 1):
            own = self.sums(beta, offsets)
            if tight is None:
                r = own.agg(*[F.sum(c).alias(c) for c in own.columns if c not in ("_g", "_u")], F.lit(0.0).alias("q"), F.lit(0.0).alias("d"), F.lit(0.0).alias("e")).first()
            else:
                own = durable(own)
                d = F.col("h0_0") + tight
                back = F.col("g0") - tight * F.col("_u")
                folded = [F.sum(F.col(f"h{i}_{j}") - F.col(f"h0_{i}") * F.col(f"h0_{j}") / d).alias(f"h{i}_{j}") for i, j in self.pairs]
                folded += [F.sum(F.col(f"g{i}") - F.col(f"h0_{i}") * back / d).alias(f"g{i}") for i in range(self.k)]
                r = own.agg(*folded, F.sum("l").alias("l"), F.sum(F.col("_u") * F.col("_u") * tight / 2).alias("q"), F.sum(F.log1p(F.col("h0_0") / tight) / 2).alias("d"), F.max(F.abs(back / d)).alias("e")).first()
            now = r["l"] - r["q"]
            if now < best - 1e-9 * max(1.0, abs(best)) and t > 1e-6:  # too far: half of the step
                t /= 2
                beta, offsets = full[0] + t * move, None if tight is None else full[1].select("_g", (F.col("_u") + t * F.col("_du")).alias("_u"))
                continue
            h, g = np.zeros((self.k, self.k)), np.array([r[f"g{i}"] for i in range(self.k)])
            for i, j in self.pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            # With full freedom of the intercepts the level is tied to the penalty, so h may be near singular.
            new = np.linalg.lstsq(h, g, rcond=1e-12)[0]
            done = max(np.abs(new).max(), r["e"]) < 1e-6 * (1 + np.abs(beta).max())
            if done or n == MAX_PASSES:
                return beta, offsets, now - r["d"], h, done, n
            best, t, move = now, 1.0, new
            if tight is not None:
                shift = sum((F.col(f"h0_{i}") * float(m) for i, m in enumerate(move)), F.lit(0.0))
                full = (beta, own.select("_g", "_u", ((back - shift) / d).alias("_du")))
                offsets = full[1].select("_g", (F.col("_u") + F.col("_du")).alias("_u"))
            else:
                full = (beta, None)
            beta = beta + move
        raise AssertionError


def _least(f: Callable[[float], float], low: float, high: float, width: float) -> float:
    """Where f is least between two bounds, to the given width: a bracket around 0, then steps by parabolas and golden cuts."""
    a, b, c = max(low, -0.7), 0.0, min(high, 0.7)
    fa, fb, fc = f(a), f(b), f(c)
    while fa < fb and a > low:
        a, b, c, fb, fc = max(low, a - 1.4 * (b - a)), a, b, fa, fb
        fa = f(a)
    while fc < fb and c < high:
        a, b, c, fa, fb = b, c, min(high, c + 1.4 * (c - b)), fb, fc
        fc = f(c)
    if fa < fb or fc < fb:
        return a if fa < fc else c  # at a bound
    while c - a > width:
        bend = (b - a) * (fb - fc) - (b - c) * (fb - fa)
        x = b - ((b - a) ** 2 * (fb - fc) - (b - c) ** 2 * (fb - fa)) / (2 * bend) if bend else b
        if c - a < 1 and abs(x - b) < width / 4:
            break  # the parabola through the three ends where it stands
        if not a < x < c or abs(x - b) < width / 4:
            x = b + 0.3 * (c - b) if c - b > b - a else b - 0.3 * (b - a)
        fx = f(x)
        if fx < fb:
            a, b, c, fa, fb, fc = (b, x, c, fb, fx, fc) if x > b else (a, x, b, fa, fx, fb)
        else:
            a, c, fa, fc = (a, x, fa, fx) if x > b else (x, c, fx, fc)
    return b


def fit(df: DataFrame, outcome: str, terms: Sequence[str], group: str | None = None, variance: float | None = None) -> Fit:
    """Fits a logistic model of a 0/1 outcome: terms are columns or products a:b, group the column of random intercepts.

    variance fixes that of the intercepts. Rows that miss the outcome, a term or the group are left out.
    converged says whether the fit ended within MAX_PASSES and the variance below its upper bound (at the
    lower one groups don't differ); nothing that did not converge is passed off as a fit.
    """
    columns, categories = expanded(df, terms)
    data = _Rows(df, outcome, columns, group)
    if not data.n_rows:
        raise ValueError("no complete rows to fit")
    start, passes, bound = np.zeros(data.k), 0, False
    if group is None:
        beta, _, value, h, done, passes = data.at_variance(start, None, None)
        offsets = None
    else:
        best: dict = {}

        def least(log_deviation):
            nonlocal passes
            if "fit" in best and not best["fit"][4]:
                return math.inf  # what doesn't converge for one variance isn't tried for others
            from_ = best.get("fit", (start, None))
            got = data.at_variance(*from_[:2], math.exp(2 * log_deviation))
            passes += got[5]
            if "fit" not in best or got[2] > best["fit"][2]:
                best.update(fit=got, at=log_deviation)
            return -got[2]

        if variance is None:
            at = _least(least, *LOG_DEVIATION, 0.02)
            bound, variance = abs(at - LOG_DEVIATION[1]) < 0.02, math.exp(2 * best["at"])
        else:
            least(math.log(variance) / 2)
        beta, offsets, value, h, done, _ = best["fit"]
    if isinstance(offsets, np.ndarray):
        offsets = df.sparkSession.createDataFrame(list(zip(data.names.tolist(), offsets.tolist())), "_g string, _u double")
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0))
    return Fit(list(columns), beta, errors, variance if group else None, float(value), data.n_rows, data.n_groups if group else 0, bool(done and not bound), passes, categories, offsets)


def marginal_log_likelihood(df: DataFrame, model: Fit, outcome: str, terms: Sequence[str], group: str, nodes: int = 15) -> float:
    """The log likelihood with the intercepts integrated out by adaptive Gauss-Hermite nodes: one pass over the rows, a sum for each node and group."""
    columns, _ = expanded(df, terms, model.categories)
    data = _Rows(df, outcome, columns, group)
    own = data.sums(model.coefficients, model.offsets).select("_g", "_u", (1 / F.sqrt(F.col("h0_0") + 1 / model.variance)).alias("_d"))
    z, w = np.polynomial.hermite.hermgauss(nodes)
    rows = data.rows.join(F.broadcast(own) if data.n_groups <= BROADCAST_GROUPS else own, "_g")
    eta = _dot(model.coefficients, data.columns) + F.col("_u")
    spread = math.sqrt(2.0)
    sums = rows.groupBy("_g").agg(F.first("_u").alias("_u"), F.first("_d").alias("_d"), *[F.sum(_log_likelihood(F.col("_y"), eta + F.lit(spread * float(x)) * F.col("_d"))).alias(f"l{k}") for k, x in enumerate(z)])
    at = [F.col("_u") + F.lit(spread * float(x)) * F.col("_d") for x in z]
    logs = [F.col(f"l{k}") - a * a / (2 * model.variance) + float(np.log(w[k]) + z[k] ** 2) for k, a in enumerate(at)]
    most = F.greatest(*logs) if nodes > 1 else logs[0]
    total = F.log(sum((F.exp(v - most) for v in logs[1:]), F.exp(logs[0] - most))) + most + F.log(F.col("_d")) + (0.5 * math.log(2.0) - 0.5 * math.log(2 * math.pi * model.variance))
    return float(sums.agg(F.sum(total)).first()[0])


def population(model: Fit) -> Column:
    """The probability from coefficients alone; the groups' intercepts and their variance don't enter."""
    parts = []
    for name, b in zip(model.names, model.coefficients):
        column = F.lit(float(b))
        for part in [] if name == "(intercept)" else name.split(":"):
            level = next(((c, v) for c, levels in model.categories.items() for v in levels if part == f"{c}{v}"), None)
            column = column * (F.col(part).cast("double") if level is None else (F.col(level[0]).cast("string") == level[1]).cast("double"))
        parts.append(column)
    return 1 / (1 + F.exp(-sum(parts[1:], parts[0])))


def comparison(spark, models: dict[str, Fit]) -> DataFrame:
    """One row a model: degrees of freedom, log likelihood, AIC, its distance to the least and the gain over the first model; whether it converged."""
    least, first = min(m.aic for m in models.values()), next(iter(models.values())).log_likelihood
    rows = [(n, m.df, m.log_likelihood, m.aic, m.aic - least, m.log_likelihood - first, m.variance, m.n_rows, m.n_groups, m.converged) for n, m in models.items()]
    return spark.createDataFrame(rows, "model string, df int, log_likelihood double, aic double, delta_aic double, log_likelihood_gain double, variance double, n_rows long, n_groups long, converged boolean")
