"""Quantiles within groups and windows over the whole order, however the rows are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.order import grouped_quantiles, neighbourhoods
from tidemark.operators import evaluation

QS = [0.0, 0.25, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("ranges", [1, 7])
def test_quantiles_of_groups(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None]), rng.randrange(2), rng.choice([None, 1.0, 1.0, 7.0, rng.random() * 9])) for _ in range(400)] + [("b", 0, 5.0), ("c", 0, None), ("d", 1, 1.0), ("d", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    found = {(r.g, r.k): r.quantiles for r in grouped_quantiles(df, ["g", "k"], "v", QS, ranges).collect()}
    groups = {}
    for g, k, v in rows:
        if v is not None:
            groups.setdefault((g, k), []).append(v)
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert np.allclose(found[g], np.quantile(values, QS))
    assert grouped_quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("block", [5, 7, 1000])
def test_neighbourhoods_cross_blocks(spark, block):
    x = [random.Random(2).random() for _ in range(3)] + list(range(40))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").repartition(6)
    found = {r.i: r.m for r in neighbourhoods(df, [F.col("i")], {"m": F.col("v")}, 5, block).collect()}
    assert len(found) == len(x) and all(abs(found[i] - np.mean(x[max(0, i - 5) : i + 6])) < 1e-9 for i in range(len(x)))


def test_silhouette_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, i % 3 if i < 60 else (3 if i == 60 else -1), [rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1)]) for i in range(64)]
    found = {r.label: (r.n, r.silhouette) for r in evaluation.squared_silhouette(spark.createDataFrame(rows, "id long, label int, features array<double>")).collect()}
    x, label = np.array([r[2] for r in rows if r[1] >= 0]), np.array([r[1] for r in rows if r[1] >= 0])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for g in range(4):
        out = []
        for i in np.flatnonzero(label == g):
            own = (label == g).sum() - 1
            a = d[i, label == g].sum() / own if own else 0
            b = min(d[i, label == o].mean() for o in range(4) if o != g)
            out.append((b - a) / max(a, b) if own else 0)
        assert found[g][0] == len(out) and abs(found[g][1] - np.mean(out)) < 1e-9


def test_chance_of_shared_counts_is_the_plain_sum():
    from math import comb, log

    for x, y, n in ((3, 4, 10), (50, 70, 100), (1, 1, 1), (10, 10, 10), (400, 3, 900)):
        plain = sum(k / n * log(n * k / (x * y)) * comb(x, k) * comb(n - x, y - k) / comb(n, y) for k in range(max(1, x + y - n), min(x, y) + 1))
        assert abs(evaluation._chance(x, y, n) - plain) < 1e-12
    assert 0 < evaluation._chance(10**7, 10**7, 4 * 10**7) < 1e-6
