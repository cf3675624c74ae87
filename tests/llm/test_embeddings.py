"""Embedding near-dedup against all cosines, row by row."""

from collections import Counter

import numpy as np
import pytest

from cytoframe.llm import _skew
from cytoframe.llm import embed_neardup as E


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of each row, which is a vector of its own whatever its id."""
    good = [(k, l, np.asarray(v, float)) for k, (_, l, v) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, l, v) in enumerate(good):
        for j, m, w in good[:n]:
            if l == m and len(v) == len(w) and (np.array_equal(v, w) or v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [(i, links[k], names.get(find(k)), i == names.get(find(k))) for k, (i, *_) in enumerate(rows)]


def got(df):
    return Counter(map(tuple, E.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()))


@pytest.mark.parametrize("chunk, small, hot", [(2048, 64, 1000), (3, 64, 0), (2048, 2, 3), (100, 1, 1000), (5, 3, 0)])
def test_links_and_components(spark, monkeypatch, chunk, small, hot):
    monkeypatch.setattr(E, "CHUNK", chunk)
    monkeypatch.setattr(E, "SMALL", small)
    monkeypatch.setattr(_skew, "HOT_ROWS", hot)
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 32))
    rows = [(k, int(k % 3), (centres[k % 12] + random.normal(size=32) * random.choice([0.05, 0.2, 0.35])).tolist()) for k in range(150)]
    rows += [(200 + k, 0, rows[0][2]) for k in range(5)]
    rows += [(300, None, rows[0][2]), (301, 0, None), (302, 0, [0.0] * 32), (303, 0, [float("nan")] + [1.0] * 31), (304, 0, [None] + [1.0] * 31), (305, 0, []), (306, 0, [1.0, 2.0]), (307, 0, [2.0, 4.0]), (308, 0, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    have, want = {r.vec_id: r for r in E.near_duplicates(df).collect()}, {r[0]: r for r in brute(rows)}
    assert set(have) == set(want)
    assert all(have[i].n_links <= want[i][1] for i in want)
    assert sum(r.n_links for r in have.values()) >= 0.97 * sum(r[1] for r in want.values()) > 0
    assert sum(have[i].component_id == want[i][2] for i in want) >= 0.97 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in have.values())
    assert all(have[i].n_links == 0 for i in (300, 301, 302, 303, 304, 305, 308)) and have[306].n_links == 1


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_repeated_null_and_shared_ids(spark, monkeypatch, block):
    monkeypatch.setattr(E.B, "BLOCK_BYTES", block)
    a, c = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = [0.999, 0.02, 0.0, 0.0]
    one = [(1, 0, a), (1, 0, c), (2, 0, near)]
    two = [(1, 0, a), (1, 0, a), (1, 1, a), (5, 1, near)]
    three = [(None, 0, a), (None, 0, a), (7, 0, near), (None, 1, c), (None, None, a), (9, 1, a), (None, 2, a), (None, 2, near)]
    four = [(k % 3, k % 2, [1.0, k / 90, 0.0, 0.0]) for k in range(30)] + [(1, 1, c), (0, 1, c), (0, 0, None), (0, 0, None)]
    for rows in (one, two, three, four):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(2)
        assert got(df) == Counter((i, n, r, k if r is not None else i is None) for i, n, r, k in brute(rows))


def test_labels_of_any_type_and_clashing_columns(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.01]), (3, "y", [1.0, 0.0]), (4, "", [1.0, 0.0]), (5, None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "vec_id int, label string, embedding array<double>, id int, h1 string").withColumnRenamed("h1", "root")
    assert got(df) == Counter(brute(rows))
    assert got(df.withColumn("label", df["label"] == "x")) == Counter(brute([(i, None if l is None else l == "x", v) for i, l, v in rows]))


def test_a_close_group_travels_few_times(spark):
    random = np.random.default_rng(1)
    groups = [random.normal(size=32) for _ in range(40)]
    rows = [(k, 0, (groups[k % 40] + random.normal(size=32) * 0.03).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(df) == Counter(brute(rows))


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
