"""The t distribution, intervals, degenerate bootstraps and unbiased draws, against closed forms and exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import splitmix, student
from tidemark.operators import inference


def test_tails_have_their_closed_forms():
    t = np.array([0.0, 1e-9, 0.3, 1.0, 2.5, 12.7, 400.0])
    assert np.allclose(student.two_sided(t, 1), 1 - 2 / math.pi * np.arctan(t), rtol=1e-12, atol=1e-15)
    assert np.allclose(student.two_sided(t, 2), 1 - t / np.sqrt(2 + t * t), rtol=1e-10, atol=1e-15)
    s = t / np.sqrt(4 + t * t)
    assert np.allclose(student.two_sided(t, 4), 1 - s * (1 + (1 - s * s) / 2), rtol=1e-8, atol=1e-14)
    assert np.allclose(student.two_sided(t, np.inf), [math.erfc(x / math.sqrt(2)) for x in t], rtol=1e-12)
    assert np.allclose(student.two_sided(t[:6], 1e7), student.two_sided(t[:6], np.inf), rtol=1e-4, atol=1e-30)
    assert student.two_sided(-2.5, 2) == student.two_sided(2.5, 2) and student.two_sided(np.inf, 3) == 0 and np.isnan(student.two_sided(np.nan, 3))


@pytest.mark.parametrize("df", [0.7, 3.4, 17, 586.3])
def test_tails_are_integrals(df):
    x, w = np.polynomial.legendre.leggauss(400)
    for t in (0.2, 1.7, 6.0):
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + (t * (x + 1) / 2) ** 2 / df) ** (-(df + 1) / 2)
        assert student.two_sided(t, df) == pytest.approx(1 - 2 * float(w @ density) * t / 2, abs=1e-13)


def test_quantiles_invert_tails():
    p, df = np.meshgrid([1e-12, 1e-4, 0.05 / 3, 0.5, 0.999], [0.5, 1, 2, 7.3, 60, 1e5, np.inf])
    t = student.two_sided_quantile(p, df)
    assert np.allclose(student.two_sided(t, df), p, rtol=1e-9)
    assert student.two_sided_quantile(0.05, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-11)
    assert student.two_sided_quantile(1.0, 4) == 0 and np.isnan(student.two_sided_quantile(0.0, 4)) and np.isnan(student.two_sided_quantile(0.5, 0))


def test_intervals_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(rng.normal(0.02 * g, 0.1)), 0.25, float(rng.normal(0, 0.2)) if g else 0.1) for g in range(3) for i in range(8 + g)]
    df = spark.createDataFrame([(f"g{g}", i, *v) for g, i, *v in rows], "scenario string, realisation int, a double, still double, c double")
    got = {r.contrast: r for r in inference.welch_intervals(df, "a", "still", "c").collect()}
    ps = {}
    for k, name in ((2, "a"), (4, "c")):
        cells = [np.array([r[k] for r in rows if r[0] == g]) for g in range(3)]
        part = [0.0 if np.ptp(c) == 0 else c.var(ddof=1) / len(c) for c in cells]
        estimate, se = np.mean([c.mean() for c in cells]), math.sqrt(sum(part)) / 3
        freedom = sum(part) ** 2 / sum(v * v / (len(c) - 1) for v, c in zip(part, cells, strict=True))
        half = float(student.two_sided_quantile(0.05 / 3, freedom)) * se
        ps[name] = float(student.two_sided(estimate / se, freedom))
        r = got[name]
        assert [r.estimate, r.se, r.freedom, r.p, r.low, r.high] == pytest.approx([estimate, se, freedom, ps[name], max(-1, estimate - half), min(1, estimate + half)], abs=2e-9)
        assert not r.fallback
    still = got["still"]
    radius = math.sqrt(2 * math.log(6 / 0.05) / 9 * sum(1 / (8 + g) for g in range(3)))
    assert (still.p, still.fallback, still.freedom) == (1.0, True, None)
    assert [still.low, still.high] == pytest.approx([max(-1, 0.25 - radius), min(1, 0.25 + radius)], abs=2e-9)
    first, second = sorted(ps, key=ps.get)
    steps = [min(1, 3 * ps[first]), min(1, 2 * ps[second]), 1.0]
    assert [got[first].adjusted, got[second].adjusted, still.adjusted] == pytest.approx(np.maximum.accumulate(steps), abs=2e-9)


def test_weighted_radius(spark):
    cells = spark.createDataFrame([("x", 1.0, 10), ("x", 3.0, 40), ("y", 2.0, 7)], "k string, w double, n int")
    got = {r.k: r.radius for r in inference.weighted_hoeffding(cells, F.col("w"), F.col("n"), "k", alpha=0.1, family=2, support=(0.0, 3.0)).collect()}
    assert got["x"] == pytest.approx(math.sqrt(0.5 * 9 * (0.25**2 / 10 + 0.75**2 / 40) * math.log(4 / 0.1)))
    assert got["y"] == pytest.approx(math.sqrt(0.5 * 9 / 7 * math.log(4 / 0.1)))


def test_masses_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("k", g, int(v) if v else None) for g in range(5) for v in rng.integers(0, 3, 12)] + [("one", 1, 5), ("big", 1, 1)] + [("big", 1, i) for i in range(1500)] + [("still", None, 3)] * 7
    got = {r.k: r for r in inference.zero_variance_mass(spark.createDataFrame(rows, "k string, stratum int, v int"), "stratum", "v", "k").collect()}
    for k in ("k", "one", "big", "still"):
        exact = Fraction(1)
        strata = {s for q, s, _ in rows if q == k}
        for s in strata:
            values = [v for q, t, v in rows if q == k and t == s]
            exact *= sum(Fraction(values.count(v), len(values)) ** len(values) for v in set(values))
        log = math.log(exact.numerator) - math.log(exact.denominator)
        assert got[k].strata == len(strata) and got[k].log_mass == pytest.approx(log, rel=1e-12, abs=1e-12)
    assert got["big"].mass == 0.0 and got["big"].log_mass < -9_000
    row = spark.range(1).select(*(inference.no_event_probability(F.lit(n), F.lit(p)).alias(f"p{i}") for i, (n, p) in enumerate([(4480, 0.01), (10**9, 1e-18), (3, 1.0), (0, 0.5)]))).first()
    assert [*row] == pytest.approx([0.99**4480, 1 - 1e-9, 0.0, 1.0], rel=1e-12)


def splitmix_by_hand(seed, bound, draws):
    out, state, least = [], seed % 2**64, 2**64 % bound
    while len(out) < draws:
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        z ^= z >> 31
        if z >= least:
            out.append(z % bound)
    return out


def test_words_are_the_generators(spark):
    df = spark.createDataFrame([(s, p) for s in (0, 1, -1, 2**63 - 1, -(2**63), 1234567) for p in (1, 2, 1000)], "seed long, place long")
    for r in df.withColumn("word", splitmix.word(F.col("seed"), F.col("place"))).collect():
        z = (r.seed + r.place * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        assert r.word % 2**64 == z ^ (z >> 31)


@pytest.mark.parametrize(("draws", "block"), [(1, 1024), (40, 8), (300, 64)])
def test_indices_are_unbiased_draws(spark, monkeypatch, draws, block):
    """Bounds that reject nearly nothing, and up to nearly half of all words."""
    monkeypatch.setattr(splitmix, "BLOCK", block)
    rows = [(i, s, n) for i, (s, n) in enumerate([(0, 7), (5, 1), (-3, 2**62 + 1), (99, 2**63 - 1), (2**63 - 1, 2**62 + 2**61 + 1), (17, 320)])]
    df = spark.createDataFrame([*rows, (90, None, 4), (91, 4, 0), (92, 4, None)], "id int, seed long, bound long")
    got = {}
    for r in splitmix.bounded_indices(df, ["id"], "seed", "bound", draws).collect():
        got.setdefault(r.id, {})[r.draw] = r["index"]
    assert {i: [d[k] for k in range(draws)] for i, d in got.items()} == {i: splitmix_by_hand(s, n, draws) for i, s, n in rows}
