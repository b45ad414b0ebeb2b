import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.functions.statistics import ttest_pvalue
from gridspark.operators import stats


def test_weighted_mean_skips_missing(frame):
    cells = frame([(0, 0.0), (1, 60.0), (2, 60.0)], "cell_id int, lat double")
    x = frame([(0, 2015, 3.0), (1, 2015, 6.0), (2, 2015, None), (2, 2016, None)], "cell_id int, year int, value double")
    out = as_dict(stats.area_weighted_mean(x, cells, ["year"]), "year")
    assert out[2015] == pytest.approx((3 + 6 * 0.5) / 1.5) and out[2016] is None
    assert as_dict(stats.regional_aggregate(x, cells, ["year"], "sum", weighted=False), "year") == {2015: 9.0, 2016: 0.0}
    assert as_dict(stats.regional_aggregate(x, cells, ["year"], "max"), "year") == {2015: 6.0, 2016: None}
    with pytest.raises(ValueError):
        stats.regional_aggregate(x, cells, ["year"], "median")


@pytest.fixture(scope="module")
def noisy(frame):
    rng = random.Random(1)
    rows = [("tas", m, c, y, 280 + c + 0.03 * (y - 2025) + rng.gauss(0, 1)) for m in "ABC" for c in range(4) for y in range(2025, 2060)]
    return rows, frame(rows, "variable string, member string, cell_id int, year int, value double")


def residuals(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
    b, a = np.polyfit(x - 2025, y, 1)
    return dict(zip(x.astype(int), y - a - b * (x - 2025)))


def test_variability_equals_detrending_first(frame, noisy):
    rows, df = noisy
    out = as_dict(stats.regional_variability(df, window=(2010, 2030)), "cell_id")
    for c in range(4):
        pooled = [r for m in "ABC" for y, r in residuals([(y, v) for _, mm, cc, y, v in rows if (mm, cc) == (m, c)]).items() if y <= 2030]
        assert out[c] == pytest.approx(statistics.pstdev(pooled), rel=1e-9)
    cells = frame([(c, 0.0) for c in range(4)], "cell_id int, lat double")
    pooled = []
    for m in "ABC":
        mean = {y: statistics.mean(v for _, mm, _, yy, v in rows if (mm, yy) == (m, y)) for y in range(2025, 2060)}
        pooled += residuals(list(mean.items())).values()
    assert stats.natural_variability(df, cells).first()["value"] == pytest.approx(statistics.pstdev(pooled), rel=1e-9)


def numeric_p(t, df, steps=200000, top=400.0):
    """Two-sided tail of Student's t by numeric integration over an angle."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    theta = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, steps)
    f = np.cos(theta) ** (df - 1)
    return 2 * c * math.sqrt(df) * float(np.sum((f[1:] + f[:-1]) / 2 * np.diff(theta)))


@pytest.mark.parametrize("n", [2, 5, 63])
def test_pvalues(frame, n):
    rows = [(t, t * 2.0 * math.sqrt(2 / n), 0.0, 2.0) for t in (0.0, 0.3, 1.0, 2.0, 4.0)]
    df = frame(rows, "t double, m1 double, m2 double, s double")
    out = as_dict(ttest_pvalue(df, F.col("m1"), F.col("m2"), F.col("s"), n), "t", "p_value")
    for t, p in out.items():
        assert p == pytest.approx(numeric_p(t, 2 * n - 2), abs=1e-8)
    assert out[0.0] == 1.0


def test_pvalues_without_spread(frame):
    df = frame([(1, 1.0, 1.0, 0.0), (2, 1.0, 2.0, 0.0), (3, 1.0, None, 0.0), (4, 1.0, 2.0, None)], "k int, m1 double, m2 double, s double")
    out = as_dict(ttest_pvalue(df, F.col("m1"), F.col("m2"), F.col("s"), 63), "k", "p_value")
    assert out == {1: 1.0, 2: 0.0, 3: None, 4: None}


@pytest.mark.parametrize("per_block", [3, 25])
def test_bootstrap_equals_refitting_the_draws(frame, per_block):
    rng = random.Random(2)
    years = {"a": list(range(2000, 2010)), "b": list(range(2003, 2010)), "c": [2000, 2001]}
    driver = {(s, y): rng.random() for s, ys in years.items() for y in ys}
    value = {(s, y, c): c + 2 * driver[s, y] + rng.gauss(0, 0.1) for s, y in driver for c in (1, 2)}
    value["c", 2000, 1] = None  # the whole scenario is skipped
    maps = frame([("v", "m", s, y, c, v) for (s, y, c), v in value.items()], "variable string, model string, scenario string, year int, cell_id int, value double")
    series = frame([(s, y, d) for (s, y), d in driver.items()], "scenario string, year int, driver double")
    out = {(r["cell_id"], r["replicate"]): (r["slope"], r["intercept"]) for r in stats.bootstrap_ols(maps, series, replicates=10, per_block=per_block).collect()}
    assert len(out) == 20
    for c in (1, 2):
        for rep in range(10):
            picks = []
            for s in ("a", "b"):
                n = len(years[s])
                picks += [(s, years[s][int(hashlib.md5(f"b{rep}-{s}-{i}".encode()).hexdigest()[:8], 16) % n]) for i in range(n)]
            b, a = np.polyfit([driver[p] for p in picks], [value[(*p, c)] for p in picks], 1)
            assert out[c, rep] == pytest.approx((b, a))


def test_slope_through_origin(frame):
    x = frame([("1.5", -1.0), ("1.0", -2.0), ("0.5", -3.0)], "target string, driver double")
    y = frame([("tas", 1, t, 4.0 * d) for t, d in (("1.5", -1), ("1.0", -2), ("0.5", -3))], "variable string, cell_id int, target string, value double")
    assert as_dict(stats.slope_through_origin(y, x), "cell_id", "slope") == {1: 4.0}


@pytest.mark.parametrize("values", [[0.0, 0.1, 0.2, 0.3, 0.7, 1.0], [5.0, 5.0], [float(i) / 7 for i in range(300)], [1e-9, 1.0, 0.02, 0.04, 0.06, 0.98]])
def test_equal_bins_match_numpy(frame, values):
    df = frame([("k", v) for v in [*values, None]], "k string, value double")
    rows = stats.histogram_equal(df, ["k"]).orderBy("bin").collect()
    counts, edges = np.histogram(values, 150)
    assert [r["frac"] * len(values) for r in rows] == pytest.approx(list(counts))
    assert [r["lo"] for r in rows] + [rows[-1]["hi"]] == pytest.approx(list(edges))
    arrays = stats.histogram_arrays(stats.histogram_equal(df, ["k"]), ["k"]).first()
    assert len(arrays["counts"]) == 150 and len(arrays["bin_edges"]) == 151


def test_day_count_bins(frame):
    values = [0.0, 0.5, 1.0, 4.9, 5.0, 50.0, 365.0]
    rows = stats.histogram_edges(frame([("k", v) for v in values], "k string, value double"), ["k"]).orderBy("bin").collect()
    counts, _ = np.histogram(values, [1, 5, 10, 20, 50, np.inf])
    assert [r["frac"] for r in rows] == pytest.approx(list(counts / counts.sum()))
    assert rows[-1]["hi"] is None


@pytest.mark.parametrize("n", [1, 2, 7, 200, 201])
def test_exact_median(frame, n):
    rng = random.Random(n)
    groups = {"a": [rng.random() for _ in range(n)], "b": [float(rng.randrange(3)) for _ in range(n)]}
    df = frame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, value double")
    assert as_dict(stats.exact_median(df, ["k"]), "k") == pytest.approx({k: statistics.median(v) for k, v in groups.items()})


def test_population_variability(frame):
    people = frame([(1, 2e6), (2, 3e6)], "cell_id int, persons double")
    one = frame([("tas", 0.5)], "variable string, value double")
    assert stats.population_variability(one, people).first()["value"] == 2.5
    assert stats.population_variability(one, people, frame([(2,)], "cell_id int")).first()["value"] == 1.5


def test_bootstrap_skips_scenarios_per_variable(frame):
    """A gap in one variable leaves the other variable's fits as they are."""
    rows = [(v, "m", "s", y, 1, None if v == "pr" and y == 2002 else 2.0 * y) for v in ("tas", "pr") for y in range(2000, 2006)]
    df = frame(rows, "variable string, model string, scenario string, year int, cell_id int, value double")
    series = frame([("s", y, float(y)) for y in range(2000, 2006)], "scenario string, year int, driver double")
    got = stats.bootstrap_ols(df, series, replicates=5).collect()
    assert {r["variable"] for r in got} == {"tas"} and len(got) == 5
    assert all(r["slope"] == pytest.approx(2.0, abs=1e-6) for r in got)


def test_bootstrap_of_one_year_is_its_value(frame):
    df = frame([("tas", "m", "s", 2000, 1, 7.5)], "variable string, model string, scenario string, year int, cell_id int, value double")
    series = frame([("s", 2000, 1.3)], "scenario string, year int, driver double")
    assert {(r["slope"], r["intercept"]) for r in stats.bootstrap_ols(df, series, replicates=3).collect()} == {(0.0, 7.5)}
