import datetime as dt

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.operators import timeops


def test_daily_indices_skip_missing_and_compare_strictly(frame):
    days = [("m", 1, dt.date(2015, 1, d), v) for d, v in ((1, 313.15), (2, 313.16), (3, None), (4, 273.15), (5, 273.14))]
    out = timeops.daily_indices(frame(days, "member string, cell_id int, date date, value double"), ["member", "cell_id"],
                                [("hot", ">", 313.15), ("cold", "<", 273.15)]).first()
    assert (out["hot"], out["cold"], out["max"], out["min"]) == (1, 1, 313.16, 273.14)


def test_single_precision_thresholds(frame):
    stored = frame([("m", dt.date(2015, 1, 1), 313.15)], "member string, date date, value float")
    both = [timeops.daily_indices(stored, ["member"], [("hot", ">", 313.15)], single=s).first()["hot"] for s in (True, False)]
    assert both == [0, int(float(__import__("numpy").float32(313.15)) > 313.15)]


def test_annual_rule_from_metadata(frame):
    rows = [(v, 2015, float(x)) for v in ("tas", "tasmin", "tasmax", "pr_above_10") for x in (1, 2, 6)]
    out = timeops.monthly_to_annual(frame(rows, "variable string, year int, value double"), ["variable"])
    assert as_dict(out, "variable") == {"tas": 3.0, "tasmin": 1.0, "tasmax": 6.0, "pr_above_10": 9.0}
    with pytest.raises(ValueError):
        timeops.monthly_to_annual(frame(rows, "variable string, year int, value double"), ["variable"], "median")


def test_detrend_of_a_line_is_zero(frame):
    rows = [("a", y, 3.0 * y - 7) for y in range(2000, 2010)] + [("b", 2000, 5.0)]
    out = timeops.detrend_linear(frame(rows, "series string, year int, value double"), ["series"])
    assert all(abs(r["value"]) < 1e-8 for r in out.collect())


def test_rebase_without_baseline_is_missing(frame):
    out = timeops.rebase(frame([("a", 1850, 1.0), ("a", 1950, 4.0), ("b", 1950, 2.0)], "s string, year int, value double"), ["s"])
    assert as_dict(out, ["s", "year"]) == {("a", 1850): 0.0, ("a", 1950): 3.0, ("b", 1950): None}


def test_rebase_of_a_single_series(frame):
    out = timeops.rebase(frame([(1850, 1.0), (1860, 3.0), (1950, 4.0)], "year int, value double"), [])
    assert as_dict(out, "year") == {1850: -1.0, 1860: 1.0, 1950: 2.0}


def test_overlapping_climatology_windows(frame):
    rows = frame([(y, float(y)) for y in range(1993, 2040)], "year int, value double").withColumn("c", F.lit(1))
    assert as_dict(timeops.climatology(rows, ["c"]), "window") == {"1.5": 2029.5, "1.0": 2017.5, "0.5": 2002.5}


def test_decades_are_labelled_by_their_end(frame):
    rows = frame([(y, float(y)) for y in range(2030, 2103)], "year int, value double").withColumn("c", F.lit(1))
    out = as_dict(timeops.decadal_means(rows, ["c"]), "decade_end")
    assert out == {e: e - 4.5 for e in range(2050, 2101, 10)}


def test_contiguous_months(frame):
    rows = frame([("m", 2015, 12), ("m", 2016, 1), ("m", 2016, 3)], "member string, year int, month int")
    out = timeops.assert_monthly_contiguous(rows, ["member"]).collect()
    assert [(r["year"], r["month"], r["gap_months"]) for r in out] == [(2016, 3, 2)]


@pytest.mark.parametrize("block", [1, 2, 4, 100])
def test_interpolation_across_blocks(frame, block):
    values = [None, 1.0, None, None, 4.0, None, 2.0, None, None]
    rows = frame([("a", t, v) for t, v in enumerate(values)] + [("b", t, None) for t in range(3)], "s string, t int, value double")
    out = as_dict(timeops.interpolate_gaps(rows, ["s"], block=block), ["s", "t"])
    assert [out["a", t] for t in range(9)] == [None, 1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 2.0, 2.0]
    assert all(out["b", t] is None for t in range(3))


@pytest.mark.parametrize("block", [1, 3, 100])
def test_resampling_extrapolates_and_blanks(frame, block):
    rows = frame([("a", 10.5, 1.0), ("a", 12.5, 5.0), ("a", 13.5, None), ("a", 14.5, 3.0)], "s string, t double, value double")
    out = as_dict(timeops.resample_axis(rows, ["s"], 9.0, 17.0, 1.0, valid=(10, 16), block=block), "t")
    assert out == {9.0: None, 10.0: 0.0, 11.0: 2.0, 12.0: 4.0, 13.0: 4.5, 14.0: 3.5, 15.0: 2.5, 16.0: 1.5, 17.0: None}


@pytest.mark.parametrize("block", [1, 2, 50])
def test_cumulative_stays_missing_after_a_gap(frame, block):
    rows = frame([("a", t, v) for t, v in enumerate([1.0, 2.0, 3.0])] + [("b", t, v) for t, v in enumerate([1.0, None, 3.0, 4.0])], "s string, t int, value double")
    out = as_dict(timeops.cumulative(rows, ["s"], step=2.0, initial=5.0, block=block), ["s", "t"], "cumulative")
    assert [out["a", t] for t in range(3)] == [7.0, 11.0, 17.0]
    assert [out["b", t] for t in range(4)] == [7.0, None, None, None]


def test_noleap_dates_skip_february_29(frame):
    start = dt.date(2016, 1, 1)
    rows = frame([("m", start + dt.timedelta(days=i)) for i in range(430)], "member string, date date")
    out = [r["noleap_date"] for r in timeops.assign_noleap_dates(rows, ["member"], 2016, 400).orderBy("date").collect()]
    assert len(out) == 400 and out[0] == start
    assert out[58:60] == [dt.date(2016, 2, 28), dt.date(2016, 3, 1)] and out[365] == dt.date(2017, 1, 1)


def ramp(frame, diffs, ramp_years, last_year, first_year=2095):
    rows = frame([("s", first_year + i, float(d), -1.0) for i, d in enumerate(diffs)], "s string, year int, temp_diff double, value double")
    out = as_dict(timeops.gate_and_ramp(rows, ["s"], ramp_years, last_year=last_year), "year")
    return [out[first_year + i] for i in range(len(diffs))]


def test_gate_and_ramp(frame):
    assert ramp(frame, [1, 0.5, -0.1, -0.2, -0.3, -0.4], 2, 2100) == [0, 0, -0.5, -1, -1, -1]
    # the ramp is cut to the years left before the last one
    assert ramp(frame, [1, 1, -1, -1, -1, -1], 10, 2100) == pytest.approx([0, 0, -1 / 3, -2 / 3, -1, -1])
    assert ramp(frame, [1, 1, 1], 5, 2100) == [0, 0, 0]
    assert ramp(frame, [1, 1, 1, 1, 1, -1], 5, 2100) == [0, 0, 0, 0, 0, -1]
    assert ramp(frame, [-1, 1, -1], 0, 2100) == [-1, 0, -1]


def test_months_there_and_back(frame):
    yearly = frame([("b", 2035, 12.0), ("b", 2036, 24.0)], "band string, year int, value double")
    months = timeops.monthly_expand(yearly).withColumn("k", (F.col("year") - 2035) * 12 + F.col("month") - 1)
    assert months.count() == 24
    assert as_dict(timeops.annual_mean_12(months, ["band"], start_year=2035), "year") == {2035: 1.0, 2036: 2.0}
