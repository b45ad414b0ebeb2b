import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.functions import columns as C
from gridspark.operators import align


def test_missing_values(frame):
    x = frame([(1, float("nan")), (2, 41.0), (3, None), (4, -1.0)], "k int, value double")
    assert as_dict(x.withColumn("value", C.known("value")), "k") == {1: None, 2: 41.0, 3: None, 4: -1.0}
    assert as_dict(x.withColumn("value", C.floor_zero(C.known("value"))), "k") == {1: 0.0, 2: 41.0, 3: 0.0, 4: 0.0}


def test_longitudes(frame):
    x = frame([(float(v),) for v in (0, 180, 181.25, 358.75)], "lon double")
    rows = x.select(C.lon_to_180("lon").alias("a"), C.lon_wrap_180("lon").alias("b"), C.population_lon("lon").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 180), (180, -180, 0), (-178.75, -178.75, 1.25), (-1.25, -1.25, 178.75)]


def test_time_slice_ends_are_inclusive(frame):
    x = frame([(y,) for y in range(2000, 2006)], "year int")
    assert align.time_slice(x, 2001, 2003).count() == 3
    assert align.time_slice(x, None, 2003).count() == 4 and align.time_slice(x).count() == 6


def test_align_binary_keeps_unshared_dimensions(frame):
    a = frame([("s", 2000, 6.0), ("s", 2001, 8.0)], "s string, year int, value double")
    b = frame([(2000, 2.0), (2002, 1.0)], "year int, value double")
    assert as_dict(align.align_binary(a, b, "/"), ["s", "year"]) == {("s", 2000): 3.0}
    with pytest.raises(ValueError):
        align.align_binary(a, b, "%")


def test_components_pair_by_key_not_by_position(frame):
    schema = "member string, t int, value double"
    c, l = frame([("2", 1, 1.0), ("1", 1, 10.0)], schema), frame([("1", 1, 5.0), ("3", 1, 7.0)], schema)
    assert as_dict(align.sum_components(c, l, ["member", "t"]), "member") == {"1": 15.0}
    assert sorted(r["member"] for r in align.unpaired_components(c, l, ["member", "t"]).collect()) == ["2", "3"]


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_outer_product_is_whole_for_any_number_of_blocks(frame, blocks):
    pattern = frame([(c, float(c)) for c in range(20)], "cell_id int, slope double")
    series = frame([(y, float(y)) for y in range(5)], "year int, driver double")
    out = as_dict(align.outer_scale(pattern, series, blocks=blocks), ["cell_id", "year"])
    assert out == {(c, y): float(c * y) for c in range(20) for y in range(5)}


def test_no_cartesian_product_in_the_plan(frame, capsys):
    pattern = frame([(1, 1.0)], "cell_id int, slope double")
    align.outer_scale(pattern, frame([(1, 1.0)], "year int, driver double")).explain()
    text = capsys.readouterr().out
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_degenerate_days(frame):
    rows = frame([("m", 1, 0.0), ("m", 1, 0.0), ("m", 2, -1.0), ("m", 2, 1.0), ("m", 3, 5.0), ("n", 1, 2.0)], "member string, date int, value double")
    left = align.drop_degenerate_days(rows, ["member"]).select("member", "date").distinct().collect()
    assert sorted(map(tuple, left)) == [("m", 3), ("n", 1)]


def test_match_time_reports_missing_years(frame):
    x = frame([(2000, 1.0), (2001, 1.0)], "year int, value double")
    assert align.match_time(x, frame([(2001,)], "year int")).count() == 1
    with pytest.raises(ValueError, match="2005"):
        align.match_time(x, frame([(2005,)], "year int"))


def test_sweep_grid_size(spark, frame):
    work = align.sweep_grid(spark, frame([("ssp245",), ("ssp585",)], "scenario string"), ["tas", "pr"])
    assert work.count() == 2 * 2 * 21 * 56
    keys = {r["target_key"] for r in work.select("target_key").distinct().collect()}
    assert keys == {f"{t / 10:.1f}" for t in range(5, 26)}


def test_splice(frame):
    with_ = frame([("a", y, 1.0) for y in range(2035, 2040)] + [("b", y, 1.0) for y in range(2035, 2040)], "s string, year int, value double")
    without = frame([(s, y, 9.0) for s in "ab" for y in range(2035, 2040)], "s string, year int, value double")
    out = as_dict(align.splice_before(with_, without, ["s"], 2037), ["s", "year"])
    assert [out["a", y] for y in range(2035, 2040)] == [9, 9, 1, 1, 1]
    amounts = frame([("a", 2035, 0.0), ("a", 2037, 2.0), ("b", 2036, 0.0)], "s string, year int, value double")
    starts = align.first_nonzero_year(amounts, ["s"])
    out = as_dict(align.splice_before(with_, without, ["s"], starts=starts), ["s", "year"])
    assert [out["a", y] for y in range(2035, 2040)] == [9, 9, 1, 1, 1]
    assert [out["b", y] for y in range(2035, 2040)] == [9] * 5  # no injection at all copies everything


def test_split_overlaps_by_one_year(frame):
    x = frame([(y,) for y in range(2010, 2020)], "year int")
    before, after = align.split_series(x, 2014)
    assert before.agg(F.max("year")).first()[0] == 2015 and after.agg(F.min("year")).first()[0] == 2015


def test_flux_units(frame):
    x = frame([("pr", 1e-8), ("p-e", 1e-5), ("tas", 280.0)], "variable string, value double")
    out = as_dict(x.withColumn("value", C.flux_to_mm_day("variable", "value")), "variable")
    assert out == pytest.approx({"pr": 0.864, "p-e": 0.864, "tas": 280.0})
