"""Spectra of short and long series against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import spectrum


def _peaks(x, share=0.3):
    size = np.abs(np.fft.fft(x))
    size = np.round(size / size.mean(), 9) if size.any() else size
    s, found, k = size[1 : len(x) // 2], 0, 1
    while k < len(s) - 1:
        end = k
        while end < len(s) - 1 and s[end + 1] == s[k]:
            end += 1
        found += s[k] > s[k - 1] and end < len(s) - 1 and s[end + 1] < s[k] and s[k] >= share
        k = end + 1
    return int(found)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    some = {n: rng.exponential(5, n) for n in (1, 2, 3, 5, 8, 9, 17, 64, 100, 257, 1000)}
    some |= {2001: np.ones(40), 2002: np.tile([1.0, 2.0, 4.0], 30), 2003: np.eye(1, 50)[0], 2004: np.zeros(30), 2005: np.sin(np.arange(300) * 2 * math.pi / 12) + rng.normal(0, 0.1, 300)}
    some[None] = rng.normal(0, 1, 77)
    return some


@pytest.mark.parametrize("whole, block", [(1 << 16, 1 << 20), (4, 7)])
def test_peaks_of_short_and_long_series(spark, series, whole, block):
    rows = [(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)] + [(9, -1, None), (3000, 0, None)]
    df = spark.createDataFrame(rows, "k long, at long, x double").orderBy(F.rand(1))
    found = {r.k: (r.n, r.peaks) for r in spectrum.spectral_peaks(df, "k", "x", "at", whole=whole, block=block).collect()}
    assert found == {k: (len(xs), _peaks(xs)) for k, xs in series.items()}
    empty = spectrum.spectral_peaks(df.where("false"), "k", "x", "at", whole=whole)
    assert empty.columns == ["k", "n", "peaks"] and empty.count() == 0


def test_long_spectrum_to_its_digits(spark):
    x = np.random.default_rng(1).normal(3, 1, 997)
    df = spark.createDataFrame([(5, 997, i, float(v)) for i, v in enumerate(x)], "series long, n long, i long, x double")
    found = np.array([r["size"] for r in spectrum._long_spectrum(df).orderBy("i").collect()])
    assert np.abs(found - np.abs(np.fft.fft(x))).max() < 1e-9 * len(x)
