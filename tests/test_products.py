import math

import duckdb
import pytest
from conftest import as_dict
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import stats
from gridspark.plans import load_queries
from gridspark.plans import products as P
from gridspark.plans.registry import ORACLES, QUERIES
from gridspark.scratch import scratch_path
from gridspark.sources import grid

CELLS = [(c, c // 2, c % 2, -30.0 + 20 * (c // 2), 180.0 * (c % 2)) for c in range(8)]
YEARS = range(2015, 2101)


@pytest.fixture(scope="module")
def cells(frame):
    return frame(CELLS, "cell_id int, lat_idx int, lon_idx int, lat double, lon double")


@pytest.fixture(scope="module")
def land(frame):
    return frame([(c,) for c in range(4)], "cell_id int")


@pytest.fixture(scope="module")
def population(frame):
    return frame([(c, 1e6 * (c + 1)) for c in range(8)], "cell_id int, persons double")


@pytest.fixture(scope="module")
def coef(frame):
    rows = [(v, "m", r, c, 1.0 + 0.1 * r, -3.0 + c) for v in ("tas", "pr", "tas_above_35") for r in range(3) for c in range(8)]
    return frame(rows, "variable string, model string, replicate int, cell_id int, slope double, intercept double")


@pytest.fixture(scope="module")
def series(frame):
    return frame([("ssp245", y, (y - 2000) / 50) for y in (2000, *YEARS)], "scenario string, year int, driver double")


VARIABLES = ["tas", "pr", "tas_above_35", "exposure_above_35"]


def test_predicting_once_equals_the_mean_of_predictions(coef, series, land, population):
    out = as_dict(P.predict_map(coef, series, VARIABLES, land, population), ["variable", "year", "cell_id"])
    for (v, y, c), got in out.items():
        each = [(1.0 + 0.1 * r) * (y - 2000) / 50 - 3 + c for r in range(3)]
        raw = sum(each) / 3
        want = {"tas": raw, "pr": raw, "tas_above_35": max(raw, 0), "exposure_above_35": max(raw, 0) * (c + 1)}[v]
        assert got == pytest.approx(want)
    # temperature everywhere, the rest on land only
    assert len(out) == 86 * (8 + 3 * 4)


def test_history_comes_from_each_variables_experiment(frame, land, population):
    rows = [(v, e, y, c, float(i + y - 2000)) for i, e in enumerate(("baseline", "cmip_historical", "1.5")) for v in ("tas", "tas_above_35") for y in (1850, 2014, 2015) for c in (0, 7)]
    annual = frame(rows, "variable string, experiment string, year int, cell_id int, value double")
    out = as_dict(P.historical_map(annual, ["tas", "exposure_above_35"], land, population), ["variable", "year", "cell_id"])
    assert out == {("tas", 1850, 0): -150.0, ("tas", 1850, 7): -150.0, ("tas", 2014, 0): 14.0, ("tas", 2014, 7): 14.0,
                   ("exposure_above_35", 1850, 0): 0.0, ("exposure_above_35", 2014, 0): 15.0}
    assert as_dict(P.baseline_map(P.historical_map(annual, ["tas"], land)), "cell_id") == {0: -150.0, 7: -150.0}


def test_gap_and_delta(frame, cells, land, population, coef, series):
    maps = P.predict_map(coef, series, ["tas"], land)
    gap = P.temp_gap(maps, cells, (5, 25))
    assert gap.count() == 21 * 86
    weights = [math.cos(math.radians(lat)) for *_, lat, _ in CELLS]
    mean = sum(w * (1.1 * 50 / 50 - 3 + c) for c, w in enumerate(weights)) / sum(weights)
    got = as_dict(gap.filter("year = 2050"), "target_tenths", "temp_diff")
    assert got[5] == pytest.approx(0.5 - mean) and got[25] == pytest.approx(2.5 - mean)
    slopes = frame([(v, c, float(c)) for v in ("tas", "pr", "tas_above_35") for c in range(8)], "variable string, cell_id int, slope double")
    delta = P.regional_delta(slopes, gap.filter("target_tenths = 15"), VARIABLES, land, population, 2040, 10)
    rows = as_dict(delta, ["variable", "year", "cell_id"])
    assert len(rows) == 61 * (8 + 3 * 4)
    diff = as_dict(gap.filter("target_tenths = 15"), "year", "temp_diff")
    first = min(y for y in range(2040, 2101) if diff[y] <= 0)
    factor = lambda y: 0 if diff[y] > 0 else min((y - first + 1) / 10, 1)
    for (v, y, c), got in rows.items():
        assert got == pytest.approx(c * diff[y] * factor(y) * ((c + 1) if v.startswith("exposure") else 1))


def test_injection_starts(frame):
    gap = frame([("s", 15, y, 1.0 if y < 2040 else -1.0) for y in range(2030, 2101)], "scenario string, target_tenths int, year int, temp_diff double")
    slopes = frame([(-15.0, 2.0), (15.0, 4.0)], "lat double, slope double")
    out = as_dict(P.injection_by_latitude(slopes, gap, (2035, 2090)), ["start_year", "year", "lat"])
    assert len({k[0] for k in out}) == 56
    assert [out[2035, y, 15.0] for y in (2039, 2040, 2049, 2050)] == [0.0, pytest.approx(-0.4), -4.0, -4.0]
    assert out[2060, 2060, -15.0] == pytest.approx(-0.2) and (2060, 2059, -15.0) not in out


def test_delta_fit(frame, cells):
    rows = []
    for e, change in (("baseline", 0.0), ("1.5", -1.0), ("1.0", -2.0), ("0.5", -3.0)):
        rows += [("tas", e, y, c, 10.0 + change) for y in (2049, 2050, 2069) for c in range(8)]
        rows += [("pr", e, y, c, 3.0 + 0.5 * c * change + (99 if y == 2049 else 0)) for y in (2049, 2050, 2069) for c in range(8)]
    annual = frame(rows, "variable string, experiment string, year int, cell_id int, value double")
    inj = frame([(t, lat, 4.0 * x) for t, x in (("1.5", 1), ("1.0", 2), ("0.5", 3)) for lat in (-30, 15)], "target string, lat int, value double")
    slopes, by_lat = P.fit_delta(annual, cells, injections=inj)
    out = as_dict(slopes, ["variable", "cell_id"], "slope")
    assert all(out["tas", c] == pytest.approx(1) and out["pr", c] == pytest.approx(0.5 * c) for c in range(8))
    assert as_dict(by_lat, "lat", "slope") == pytest.approx({-30: -4.0, 15: -4.0})


def test_annual_response_before_the_pattern_equals_after(frame):
    from test_signal import h
    q = {"a": [1.0, 0.0, 2.0], "b": [0.0, 0.0, 0.0]}
    inj = frame([(b, 2035 + i, v) for b, vs in q.items() for i, v in enumerate(vs)], "band string, year int, value double")
    aod = frame([(b, 0.3, 0.1, 0.2) for b in q], "band string, beta double, alpha double, gamma double")
    climate = frame([("tas", b, 20.0, 0.5) for b in (*q, "co2")], "variable string, band string, tau double, mu double")
    patterns = frame([("tas", b, c, w * (c + 1)) for b, w in (("a", 1.0), ("b", 5.0), ("co2", 2.0)) for c in range(3)], "variable string, band string, cell_id int, slope double")
    out = as_dict(P.custom_injection_delta(inj, aod, climate, patterns, 2035), ["year", "cell_id"])
    months = [v / 12 for v in q["a"] for _ in range(12)]
    depth = [sum(0.3 * math.exp(-(0.1 + 0.2 * months[k - j]) * (j + 1)) * months[k - j] for j in range(k + 1)) for k in range(36)]
    response = [sum(h(j + 1, 20.0, 0.5) * depth[k - j] for j in range(k + 1)) for k in range(36)]
    for i in range(3):
        for c in range(3):
            assert out[2035 + i, c] == pytest.approx((c + 1) * sum(response[12 * i:12 * i + 12]) / 12)
    co2 = frame([(k, 1.0 if k == 0 else 0.0) for k in range(36)], "k int, value double")
    more = as_dict(P.custom_injection_delta(inj, aod, climate, patterns, 2035, co2_forcing=co2), ["year", "cell_id"])
    extra = [sum(h(k + 1, 20.0, 0.5) for k in range(12 * i, 12 * i + 12)) / 12 for i in range(3)]
    assert all(more[2035 + i, c] == pytest.approx(out[2035 + i, c] + 2 * (c + 1) * extra[i]) for i in range(3) for c in range(3))


def test_summary_of_a_region(frame, cells, land, population, coef, series):
    base = frame([(v, c, 0.25) for v in VARIABLES for c in range(8)], "variable string, cell_id int, value double")
    maps = P.predict_map(coef, series, VARIABLES, land, population, base)
    history = frame([(v, y, c, 1.0) for v in VARIABLES for y in range(1950, 2015) for c in range(4)], "variable string, year int, cell_id int, value double")
    slopes = frame([(v, c, 0.1) for v in ("tas", "pr", "tas_above_35") for c in range(8)], "variable string, cell_id int, slope double")
    delta = P.regional_delta(slopes, P.temp_gap(maps, cells, [15]), VARIABLES, land, population, 2040, 5)
    region = frame([(1,), (2,)], "cell_id int")
    out = P.scenario_summary(maps, delta, history, cells, 2040, (2061, 2070), region, smooth=False)
    assert as_dict(out.maps.filter("variable = 'tas'"), "cell_id", "inside") == {c: c in (1, 2) for c in range(8)}
    s = as_dict(out.series, ["variable", "kind", "year"])
    years = lambda kind: sorted(y for v, k, y in s if (v, k) == ("tas", kind))
    assert (years("historical_model")[0], years("historical_model")[-1]) == (1950, 2040)
    assert years("no_sai") == years("with_sai") == list(range(2040, 2101))
    w = [math.cos(math.radians(CELLS[c][3])) for c in (1, 2)]
    tas = sum(x * (1.1 - 3 + c - 0.25) for x, c in zip(w, (1, 2))) / sum(w)
    assert s["tas", "no_sai", 2050] == pytest.approx(tas)
    assert s["exposure_above_35", "no_sai", 2100] == pytest.approx(max(2.2 - 3 + 1, 0) * 2 + max(2.2 - 3 + 2, 0) * 3)
    shares = out.histograms.groupBy("variable", "kind").agg(F.sum("frac").alias("value"))
    shares = as_dict(shares, ["variable", "kind"])
    assert all(shares[v, k] == pytest.approx(1) for v in ("tas", "pr", "exposure_above_35") for k in ("no_sai", "with_sai", "historical") if shares[v, k] is not None)
    assert shares["tas", "no_sai"] == pytest.approx(1)
    assert shares["tas_above_35", "no_sai"] is None  # every value lies below the first edge
    smooth = P.series_summary(maps, delta, history, cells, 2040, ["variable", "scenario", "target_tenths"])
    assert smooth.groupBy("kind").count().count() == 3


def test_pvalues_add_the_baseline_back(frame, land):
    maps = frame([(v, "s", y, c, 0.0) for v in ("tas", "tas_above_35") for y in range(2041, 2101) for c in (0, 6)], "variable string, scenario string, year int, cell_id int, value double")
    base = frame([(v, c, 5.0) for v in ("tas", "tas_above_35") for c in (0, 6)], "variable string, cell_id int, value double")
    std = frame([(v, c, 0.0) for v in ("tas", "tas_above_35") for c in (0, 6)], "variable string, cell_id int, value double")
    out = as_dict(P.pvalue_maps(maps, base, std, land), ["variable", "decade_end", "cell_id"], "p_value")
    assert out == {(v, d, 0): p for v, p in (("tas", 1.0), ("tas_above_35", 0.0)) for d in range(2050, 2101, 10)}


def test_sweep_is_incremental(spark, frame, cells, land, population, coef, series):
    rows = [(v, e, y, c, 1.0) for v in ("tas", "pr", "tas_above_35") for e in ("baseline", "cmip_historical") for y in range(1850, 1901) for c in range(8)]
    annual = frame(rows, "variable string, experiment string, year int, cell_id int, value double")
    slopes = frame([(v, c, 0.1) for v in ("tas", "pr", "tas_above_35") for c in range(8)], "variable string, cell_id int, slope double")
    std = frame([(v, c, 0.5) for v in ("tas", "pr", "tas_above_35") for c in range(8)], "variable string, cell_id int, value double")
    inputs = dict(coef=coef, series=series, slopes=slopes, injection_slopes=frame([(15.0, 2.0)], "lat double, slope double"), annual=annual, variability=std, cells=cells,
                  land=land, population=population, variables=["tas", "exposure_above_35"], target_tenths=[10, 15], start_years=(2035, 2036))
    path = scratch_path(spark, "sweep-test")
    work = frame([("ssp245", v, t) for v in ("tas", "exposure_above_35") for t in (10, 15)], "scenario string, variable string, target_tenths int")
    first = P.sweep_all(spark, path, work.filter("target_tenths = 10"), **inputs)
    assert all(first.values())
    before = grid.read_grid(spark, f"{path}/delta").count()
    second = P.sweep_all(spark, path, work, **inputs)
    assert second == {"maps": False, "pvalues": False, "delta": True, "delta_pvalues": True, "injection": True}
    assert grid.read_grid(spark, f"{path}/delta").count() == 2 * before
    assert not any(P.sweep_all(spark, path, work, **inputs).values())


def test_process_daily_drops_padding(frame):
    import datetime as dt
    rows = [("e", "m", dt.date(2015, 1, d), c, 0.0 if d == 3 else 270.0 + d + c) for d in (1, 2, 3) for c in (0, 1)]
    out = as_dict(P.process_daily(frame(rows, "experiment string, member string, date date, cell_id int, value double"), "tas"), ["variable", "cell_id"])
    assert out["tasmin", 0] == 271.0 and out["tasmax", 1] == 273.0 and out["tas_below_0", 0] == 2.0
    with pytest.raises(ValueError):
        P.process_daily(frame(rows, "experiment string, member string, date date, cell_id int, value double"), "aod")


def test_whole_sweep_is_returned(spark, tmp_path):
    n = 4000
    i = "cast(range as int) as i"
    tables = dict(
        region="select cast(range as int) as r_regionkey, 'R' || range as r_name from range(5)",
        supplier="select range + 1 as s_suppkey from range(100)",
        customer="select range + 1 as c_custkey, cast(100 + range % 37 as double) as c_acctbal from range(300)",
        orders=f"select case i % 3 when 0 then '1-URGENT' when 1 then '2-HIGH' else '5-LOW' end as o_orderpriority, date '1995-01-01' + (i * 7) % 2500 as o_orderdate, "
               f"cast(90000 + (i * 7919) % 40000 as double) as o_totalprice from (select {i} from range({n}))",
        lineitem=f"select case when i % 7 < 4 then 'F' else 'O' end as l_linestatus, case i % 3 when 0 then 'A' when 1 then 'N' else 'R' end as l_returnflag, "
                 f"date '1995-01-01' + (i * 11) % 2500 as l_shipdate, i % 20 as l_suppkey, cast(1 + (i * 31) % 50 as double) as l_quantity, "
                 f"cast(900 + (i * 7919) % 90000 as double) as l_extendedprice from (select {i} from range({5 * n}))")
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    load_queries()
    out = QUERIES["sweep_all"](spark, str(tmp_path))
    cur = con.execute(ORACLES["sweep_all"])
    columns = [c[0] for c in cur.description]
    expected = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in out.select(*columns).collect()) == expected
    assert {r["product"] for r in out.select("product").distinct().collect()} == set(P.SWEPT)
    assert {(r["scenario"], r["first_run"]) for r in out.select("scenario", "first_run").distinct().collect()} == {("1-URGENT", True), ("2-HIGH", True), ("5-LOW", False)}


def test_fits_read_written_tables(spark, tmp_path, monkeypatch):
    """Maps, series and cells are used several times: none may go back to the driver tables."""
    con = duckdb.connect()
    tables = dict(
        region="select cast(range as int) as r_regionkey, 'R' || range as r_name from range(5)",
        supplier="select range as s_suppkey from range(20)",
        customer="select range as c_custkey, 1.0::double as c_acctbal from range(20)",
        orders="select '5-LOW' as o_orderpriority, date '1995-01-01' + cast(range as int) * 300 as o_orderdate, 1e5 as o_totalprice from range(9)",
        lineitem="select 'F' as l_linestatus, 'A' as l_returnflag, date '1995-01-01' + cast(range as int) * 300 as l_shipdate, range as l_suppkey, "
                 "5e0 as l_quantity, 1e3 as l_extendedprice from range(9)")
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    load_queries()

    class Stop(Exception):
        pass

    def seen(*frames, **kw):
        files.extend(f for d in frames if isinstance(d, DataFrame) for f in d.inputFiles())
        raise Stop

    files = []
    monkeypatch.setattr(P, "fit_all", seen)
    monkeypatch.setattr(stats, "bootstrap_ols", seen)
    for name in ("fit_all", "bootstrap_ols"):
        with pytest.raises(Stop):
            QUERIES[name](spark, str(tmp_path))
    assert files and not [f for f in files if str(tmp_path) in f]
