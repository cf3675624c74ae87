"""Mixed logistic models against numeric integration, the plain model and known truth."""

import numpy as np
import pytest

from cytoframe.operators import mixed_logistic as ML


def logistic(x):
    return 1 / (1 + np.exp(-x))


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(9)
    out = []
    for g, u in enumerate(random.normal(0, 1.2, 30)):
        for _ in range(int(random.integers(3, 40))):
            x, kind = float(random.normal()), random.choice(["2N", "4N"])
            eta = -0.4 + 0.8 * x + 0.6 * (kind == "4N") - 0.5 * x * (kind == "4N") + u
            out.append((f"w{g}", x, str(kind), int(random.random() < logistic(eta))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    odd = [(None, 0.0, "2N", 1), ("w1", None, "2N", 1), ("w1", float("nan"), "4N", 0), ("w1", 0.0, None, 0), ("w1", 0.0, "2N", None)]
    return spark.createDataFrame([*rows, *odd], "well string, x double, ploidy string, y int").repartition(3)


def matrix(rows, full=True):
    x = np.array([r[1] for r in rows])
    four = np.array([r[2] == "4N" for r in rows], float)
    return np.column_stack([np.ones(len(rows)), x, four, x * four] if full else [np.ones(len(rows)), x]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows])


def integrated(beta, variance, design, y, groups):
    """The marginal log likelihood by the trapezoid rule on a fine grid."""
    u, total = np.linspace(-12, 12, 6001), 0.0
    for g in np.unique(groups):
        own = groups == g
        eta = (design[own] @ beta)[:, None] + u
        log = (y[own][:, None] * eta - np.logaddexp(0, eta)).sum(0) - u * u / (2 * variance) - 0.5 * np.log(2 * np.pi * variance)
        total += np.log(np.trapezoid(np.exp(log - log.max()), u)) + log.max()
    return total


def laplace(beta, variance, design, y, groups):
    total = 0.0
    for g in np.unique(groups):
        own, u = groups == g, 0.0
        for _ in range(60):
            p = logistic(design[own] @ beta + u)
            u += ((y[own] - p).sum() - u / variance) / ((p * (1 - p)).sum() + 1 / variance)
        eta = design[own] @ beta + u
        p = logistic(eta)
        total += (y[own] * eta - np.logaddexp(0, eta)).sum() - u * u / (2 * variance) - 0.5 * np.log1p(variance * (p * (1 - p)).sum())
    return total


TERMS = ["x", "ploidy", "x:ploidy"]


@pytest.fixture(scope="module")
def model(df):
    return ML.fit(df, "y", TERMS, "well")


def test_likelihoods_equal_numeric_integration(df, rows, model):
    design, y, groups = matrix(rows)
    assert model.names == ["(intercept)", "x", "ploidy4N", "x:ploidy4N"] and model.converged and model.n_rows == len(rows) and model.n_groups == 30
    assert abs(model.log_likelihood - laplace(model.coefficients, model.variance, design, y, groups)) < 1e-6
    assert abs(ML.marginal_log_likelihood(df, model, "y", TERMS, "well") - integrated(model.coefficients, model.variance, design, y, groups)) < 1e-3
    assert abs(ML.marginal_log_likelihood(df, model, "y", TERMS, "well", nodes=1) - model.log_likelihood) < 1e-6


def test_the_variance_is_the_best(df, model):
    for factor in (0.8, 1.25):
        other = ML.fit(df, "y", TERMS, "well", variance=model.variance * factor)
        assert other.variance == model.variance * factor and other.log_likelihood < model.log_likelihood


def test_coefficients_make_the_penalised_likelihood_greatest(rows, model):
    design, y, groups = matrix(rows)
    names = sorted(set(groups))
    full = np.column_stack([design, *[(groups == g).astype(float) for g in names]])
    penalty = np.diag([0.0] * 4 + [1 / model.variance] * len(names))
    b = np.zeros(full.shape[1])
    for _ in range(50):
        p = logistic(full @ b)
        b += np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (y - p) - penalty @ b)
    assert np.allclose(b[:4], model.coefficients, atol=1e-4)
    assert np.allclose(np.sqrt(np.diag(np.linalg.inv(full.T @ (full * (p * (1 - p))[:, None]) + penalty)))[:4], model.errors, rtol=1e-3)


def test_comparison_of_fitted_models(spark, df, rows, model):
    context = ML.fit(df.where("ploidy IS NOT NULL"), "y", ["x"], "well")
    got = {r.model: r for r in ML.comparison(spark, {"context": context, "full": model}).collect()}
    assert got["full"].df == 5 and got["context"].df == 3 and got["context"].log_likelihood_gain == 0
    assert abs(got["full"].aic - (10 - 2 * model.log_likelihood)) < 1e-9 and min(r.delta_aic for r in got.values()) == 0 and got["full"].log_likelihood_gain > 0


def test_plain_model(df, rows):
    design, y, _ = matrix(rows, full=False)
    got, b = ML.fit(df.where("ploidy IS NOT NULL AND well IS NOT NULL"), "y", ["x"]), np.zeros(2)
    for _ in range(50):
        p = logistic(design @ b)
        b += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    assert np.allclose(got.coefficients, b, atol=1e-8) and got.variance is None and got.df == 2 and got.converged
    assert abs(got.log_likelihood - (y * (design @ b) - np.logaddexp(0, design @ b)).sum()) < 1e-8


def test_separable_rows_do_not_pass_for_a_fit(spark):
    df = spark.createDataFrame([(float(k), int(k > 4)) for k in range(10)], "x double, y int")
    assert not ML.fit(df, "y", ["x"]).converged
    with pytest.raises(ValueError):
        ML.fit(df.where("false"), "y", ["x"])


def test_population_prediction(df, rows, model):
    design, *_ = matrix(rows)
    got = sorted(r.p for r in df.dropna().where("x = x").withColumn("p", ML.population(model)).collect())
    assert np.allclose(got, sorted(logistic(design @ model.coefficients)))
