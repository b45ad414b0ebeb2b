"""Summaries from patterns against the same summaries from whole maps."""

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.plans import products as P
from gridspark.plans import vectors as V
from gridspark.sources import grid

CELLS = [(c, c // 2, c % 2, -30.0 + 20 * (c // 2), 180.0 * (c % 2)) for c in range(8)]
YEARS = range(2015, 2061)
VARIABLES = ["tas", "pr", "tas_above_35", "exposure_above_35"]
KEYS = ["variable", "scenario", "target_tenths"]


@pytest.fixture(scope="module")
def inputs(frame):
    cells = frame(CELLS, "cell_id int, lat_idx int, lon_idx int, lat double, lon double")
    coef = [(v, "m", r, c, 1.0 + 0.1 * r + 0.03 * c, -1.5 + 0.4 * c - (v == "pr")) for v in ("tas", "pr", "tas_above_35") for r in range(2) for c in range(8)]
    base = [(v, c, 0.25 + 0.01 * c) for v in VARIABLES for c in range(8) if (v, c) != ("tas", 6)]  # a cell without a baseline
    return dict(cells=cells, land=frame([(c,) for c in range(5)], "cell_id int"),
                population=frame([(c, 1e6 * (c + 1)) for c in range(8)], "cell_id int, persons double"),
                coef=frame(coef, "variable string, model string, replicate int, cell_id int, slope double, intercept double"),
                series=frame([(s, y, (y - 2000) / d) for s, d in (("a", 50), ("b", 80)) for y in YEARS], "scenario string, year int, driver double"),
                base=frame(base, "variable string, cell_id int, value double"),
                slopes=frame([(v, c, 0.1 + 0.05 * c) for v in ("tas", "pr", "tas_above_35") for c in range(7)], "variable string, cell_id int, slope double"),
                history=frame([(v, y, c, 0.1 * c + (y % 7)) for v in VARIABLES for y in range(1950, 2015) for c in range(8)], "variable string, year int, cell_id int, value double"),
                std=frame([(v, c, 0.5 + c) for v in ("tas", "pr", "tas_above_35") for c in range(8)], "variable string, cell_id int, value double"))


def near(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (v if v is None or isinstance(v, bool) else pytest.approx(v, abs=1e-9)), k


@pytest.mark.parametrize("cut", [False, True])
def test_the_same_summary(frame, inputs, cut):
    i = inputs
    region = frame([(c,) for c in (0, 3, 4, 6)], "cell_id int") if cut else None
    maps = P.predict_map(i["coef"], i["series"], VARIABLES, i["land"], i["population"], i["base"], last_year=2060)
    gap = P.temp_gap(maps.filter("variable = 'tas'"), i["cells"], [5, 15])
    own_gap = P.pattern_gap(i["coef"], i["series"], i["cells"], [5, 15], i["base"], last_year=2060)
    near(as_dict(own_gap, ["scenario", "target_tenths", "year"], "temp_diff"), as_dict(gap, ["scenario", "target_tenths", "year"], "temp_diff"))
    delta = P.regional_delta(i["slopes"], gap, VARIABLES, i["land"], i["population"], 2035, 5, last_year=2060)
    tests = dict(baseline=i["base"], variability=i["std"], land=i["land"], decades=dict(decades=2), decade_end=2060)
    kw = dict(region=region, smooth=False, history_window=(1950, 1952))
    old = P.scenario_summary(maps, delta, i["history"], i["cells"], 2035, (2051, 2060), tests=tests, **kw)
    pushes = i["slopes"].withColumn("component", F.lit("gap"))
    v = V.vectors(i["coef"], i["series"], VARIABLES, i["cells"], i["land"], i["population"], i["base"], pushes, V.target_gates(own_gap, 2035, 5, last_year=2060), last_year=2060)
    new = V.pattern_summary(v, i["cells"], 2035, (2051, 2060), i["history"], tests=tests, **kw)
    for value in ("mean", "delta_mean", "inside"):
        near(as_dict(new.maps, [*KEYS, "cell_id"], value), as_dict(old.maps, [*KEYS, "cell_id"], value))
    near(as_dict(new.series, [*KEYS, "kind", "year"]), as_dict(old.series, [*KEYS, "kind", "year"]))
    for value in ("lo", "hi", "frac"):
        near(as_dict(new.histograms, [*KEYS, "kind", "bin"], value), as_dict(old.histograms, [*KEYS, "kind", "bin"], value))
    near(as_dict(new.pvalues, [*KEYS, "kind", "cell_id"], "p_value"), as_dict(old.pvalues, [*KEYS, "kind", "cell_id"], "p_value"))


def test_gaps_and_means_read_patterns_only(spark, inputs, tmp_path, capsys):
    """No plan of a gap, a map mean or a linear series multiplies cells by years."""
    i = inputs
    gap = P.pattern_gap(i["coef"], i["series"], i["cells"], (5, 25), i["base"], last_year=2060)
    gap.explain("formatted")
    text = capsys.readouterr().out
    assert text.count("Scan parquet") <= 2 and "cell_id" not in text  # one row of means and the drivers
    pushes = i["slopes"].withColumn("component", F.lit("gap"))
    v = V.vectors(i["coef"], i["series"], ["tas", "pr"], i["cells"], i["land"], None, i["base"], pushes, V.target_gates(gap, 2035, 5), last_year=2060)
    V.map_means(v, (2051, 2060)).explain("formatted")
    text = capsys.readouterr().out
    assert "Aggregate" not in text and "inline" not in text  # decades are folded inside a row's arrays
    rows = V.without_rows(v)
    rows.explain("formatted")
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_bucketed_products_meet_without_an_exchange(spark, inputs, capsys):
    i = inputs
    pushes = i["slopes"].withColumn("component", F.lit("gap"))
    names = ["tas", "pr", "exposure_above_35"]
    gates = V.target_gates(P.pattern_gap(i["coef"], i["series"], i["cells"], [5], i["base"], last_year=2060), 2035, 5, last_year=2060)
    own, push = V.own_patterns(i["coef"], names, i["land"], i["population"]), V.push_patterns(pushes, names, i["land"], i["population"])
    stored = [grid.write_bucketed(d, ["variable", "cell_id"], 4, label) for d, label in ((own, "own"), (push, "push"), (i["base"], "base"))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = V.joined_patterns(*stored)
        joined.explain("formatted")
        text = capsys.readouterr().out
        assert text.count("Bucketed: true") == 3 and "Exchange" not in text and "SortMergeJoin" in text
        plain = V.joined_patterns(own, push, i["base"])
        for c in ("slope", "intercept", "base", "push"):
            assert as_dict(joined, ["variable", "cell_id"], c) == as_dict(plain, ["variable", "cell_id"], c)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    a = V.assemble(stored[0], stored[1], stored[2], i["cells"], i["series"], gates, last_year=2060)
    b = V.vectors(i["coef"], i["series"], names, i["cells"], i["land"], i["population"], i["base"], pushes, gates, last_year=2060)
    near(as_dict(V.map_means(a, (2051, 2060)), [*KEYS, "cell_id"], "mean"), as_dict(V.map_means(b, (2051, 2060)), [*KEYS, "cell_id"], "mean"))


def test_the_gap_needs_temperature(frame, inputs):
    i = inputs
    with pytest.raises(ValueError, match="fits of 'tas'"):
        P.pattern_gap(i["coef"].filter("variable <> 'tas'"), i["series"], i["cells"], [5])
    with pytest.raises(ValueError, match="baseline of 'tas'"):
        P.pattern_gap(i["coef"], i["series"], i["cells"], [5], i["base"].filter("variable <> 'tas'"))


BANDS = {"n": (0.3, 0.05, 0.2, 9.0, 0.8), "s": (0.2, 0.1, 0.1, 5.0, 0.5)}


def custom(frame, amounts):
    injection = frame([(b, 2035 + k, v) for b, vs in amounts.items() for k, v in enumerate(vs)], "band string, year int, value double")
    aod = frame([(b, *p[:3]) for b, p in BANDS.items()], "band string, beta double, alpha double, gamma double")
    climate = frame([(v, b, p[3] + k, p[4]) for k, v in enumerate(("tas", "pr", "e")) for b, p in BANDS.items()], "variable string, band string, tau double, mu double")
    patterns = frame([(v, b, c, 0.1 * (c + 1) * (k + 1) * (1 if b == "n" else -2)) for k, v in enumerate(("tas", "pr", "e")) for b in BANDS for c in range(7)],
                     "variable string, band string, cell_id int, slope double")
    return injection, aod, climate, patterns


@pytest.mark.parametrize("amounts", [{"n": [0.0, 0.0, 4.0, 5.0, 1.0], "s": [0.0, 0.0, 0.0, 2.0, 2.0]}, {"n": [0.0] * 5, "s": [0.0] * 5}])
def test_custom_injections(frame, inputs, amounts):
    i = inputs
    injection, aod, climate, patterns = custom(frame, amounts)
    delta = P.custom_injection_delta(injection, aod, climate, patterns, 2035, p_minus_e=True)
    values = as_dict(delta, ["variable", "year", "cell_id"])
    assert all(values["p-e", y, c] == pytest.approx(values["pr", y, c] - values["e", y, c]) for y in range(2035, 2040) for c in range(7))
    extra = i["coef"].filter("variable = 'pr'").withColumns({"variable": F.lit("p-e"), "intercept": F.col("intercept") * 2})
    coef = i["coef"].unionByName(extra)
    base = i["base"].unionByName(i["base"].filter("variable = 'pr'").withColumn("variable", F.lit("p-e")))
    names = ["tas", "pr", "p-e"]
    out = V.custom_summary(coef, i["series"], names, i["cells"], i["land"], base, injection, aod, climate, patterns, 2035, 2035, (2037, 2039), last_year=2060, smooth=False)
    maps = P.predict_map(coef, i["series"], names, i["land"], None, base, last_year=2060)
    on_land = P.land_and_people(delta.filter("variable <> 'e'"), i["land"], None)
    old = P.map_summary(maps, on_land.join(i["series"].select("scenario").distinct(), how="cross"), (2037, 2039), ["variable", "scenario"])
    near(as_dict(out.maps, ["variable", "scenario", "cell_id"], "delta_mean"), as_dict(old, ["variable", "scenario", "cell_id"], "delta_mean"))
    near(as_dict(out.maps, ["variable", "scenario", "cell_id"], "mean"), as_dict(old, ["variable", "scenario", "cell_id"], "mean"))
    series = as_dict(out.series, ["variable", "scenario", "kind", "year"])
    for v in names:
        assert series[v, "a", "with_sai", 2036] == series[v, "a", "no_sai", 2036]  # before the first injection
        changed = any(abs(series[v, "a", "with_sai", y] - series[v, "a", "no_sai", y]) > 1e-6 for y in range(2037, 2040))
        assert changed == any(amounts["n"])
    assert out.injection.count() == injection.count()
    with pytest.raises(ValueError, match="gap"):
        out.gap  # noqa: B018
    with pytest.raises(ValueError, match="tasmax"):
        V.custom_summary(coef, i["series"], ["tasmax"], i["cells"], i["land"], base, injection, aod, climate, patterns, 2035, 2035, (2037, 2039))
