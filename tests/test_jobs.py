"""Ledgers of finished keys, batches, and whole jobs from stored files."""

import datetime as dt
import os

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.plans import jobs
from gridspark.plans import products as P
from gridspark.sources import grid, ledger

KEYS = ["variable", "target"]


def build_of(log):
    def build(todo):
        log.append(sorted((r["variable"], r["target"]) for r in todo.collect()))
        return todo.select(*KEYS, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("cell_id")).withColumn("value", F.lit(1.0))
    return build


@pytest.fixture
def work(frame):
    return frame([(v, t) for v in ("pr", "tas") for t in ("0.5", "1.0", "1.5")], "variable string, target string")


def test_finished_keys_are_listed_without_reading_rows(spark, work, tmp_path, capsys):
    path, log = str(tmp_path / "p"), []
    assert grid.write_missing(spark, work.filter("target < '1.5'"), path, KEYS, build_of(log))
    done = ledger.finished(spark, path, {k: work.schema[k].dataType for k in KEYS})
    assert as_dict(done, KEYS, "rows") == {(v, t): 3 for v in ("pr", "tas") for t in ("0.5", "1.0")}
    done.explain("formatted")
    text = capsys.readouterr().out
    assert "Scan parquet" not in text and "Scan json" in text and "Scan binaryFile" in text
    assert "content" not in "".join(x for x in text.splitlines() if "ReadSchema" in x)
    os.chmod(next((tmp_path / "p").rglob("*.parquet")), 0)  # the listing opens none of them
    assert done.count() == 4
    grid.write_missing(spark, work, path, KEYS, build_of(log))
    assert log[1] == [("pr", "1.5"), ("tas", "1.5")]


def test_a_torn_write_counts_as_missing(spark, work, tmp_path):
    path, log = str(tmp_path / "p"), []
    grid.write_missing(spark, work, path, KEYS, build_of(log))
    files = sorted((tmp_path / "p" / "variable=pr" / "target=0.5").rglob("*.parquet"))
    files[0].write_bytes(files[0].read_bytes()[:-4])  # cut short
    # rows of a commit that never came to its ledger entry
    work.filter("target = '1.0'").withColumns({"value": F.lit(9.0), "cell_id": F.lit(9), "commit": F.lit("99999999999999999999-x")}) \
        .write.mode("append").partitionBy(*KEYS, "commit").parquet(path)
    back = grid.read_labels(spark, path, KEYS)
    assert back.columns == [*KEYS, "cell_id", "value"]
    assert {(r["variable"], r["target"]) for r in back.select(*KEYS).distinct().collect()} == {(v, t) for v in ("pr", "tas") for t in ("0.5", "1.0", "1.5")} - {("pr", "0.5")}
    assert back.filter("value = 9").count() == 0
    assert grid.write_missing(spark, work, path, KEYS, build_of(log))
    assert log[1] == [("pr", "0.5")]
    assert grid.read_labels(spark, path, KEYS).count() == 18
    assert not grid.write_missing(spark, work, path, KEYS, build_of(log))


def test_a_new_commit_replaces_a_key_and_empty_keys_are_finished(spark, work, tmp_path):
    path = str(tmp_path / "p")
    grid.write_missing(spark, work, path, KEYS, lambda todo: todo.filter("variable = 'tas'").withColumn("value", F.lit(1.0)))
    assert not grid.write_missing(spark, work, path, KEYS, build_of([]))
    assert grid.write_missing(spark, work.filter("target = '1.0'"), path, KEYS, lambda todo: todo.withColumn("value", F.lit(2.0)), ignore_existing=True)
    assert as_dict(grid.read_labels(spark, path, KEYS), KEYS) == {("tas", "0.5"): 1.0, ("tas", "1.0"): 2.0, ("tas", "1.5"): 1.0, ("pr", "1.0"): 2.0}


def test_names_that_folders_escape(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    odd = frame([("a b+c", "x/y=z%"), ("p-e", "é:1")], "variable string, target string")
    grid.write_missing(spark, odd, path, KEYS, lambda todo: todo.withColumn("value", F.lit(1.0)))
    assert not grid.write_missing(spark, odd, path, KEYS, build_of([]))
    assert grid.read_labels(spark, path, KEYS).count() == 2


def test_a_stopped_run_goes_on_with_the_next_batch(spark, work, tmp_path):
    path, log = str(tmp_path / "p"), []
    rows = F.lit(3)

    def stops(todo):
        if len(log) == 2:
            raise RuntimeError("stopped")
        return build_of(log)(todo)

    with pytest.raises(RuntimeError, match="stopped"):
        grid.write_missing(spark, work, path, KEYS, stops, rows=rows, batch_rows=6)
    assert log == [[("pr", "0.5"), ("pr", "1.0")], [("pr", "1.5")]] or log == [[("pr", "0.5"), ("pr", "1.0")], [("pr", "1.5"), ("tas", "0.5")]] or len(log) == 2
    done = {k for batch in log for k in batch}
    more = []
    assert grid.write_missing(spark, work, path, KEYS, build_of(more), rows=rows, batch_rows=6)
    assert all(len(batch) <= 2 for batch in log + more)
    assert sorted(k for batch in more for k in batch) == sorted({(r["variable"], r["target"]) for r in work.collect()} - done)
    assert grid.read_labels(spark, path, KEYS).count() == 18


# -- graph of products -------------------------------------------------------------------------

def test_products_are_redone_with_what_they_come_from(spark, frame, tmp_path):
    calls = []

    def make(name, value):
        def build(*needed):
            calls.append(name)
            return frame([(value + sum(n.first()["value"] for n in needed),)], "value double")
        return build

    graph = lambda c: [jobs.Product("a", make("a", 1.0)), jobs.Product("b", make("b", 10.0)),
                       jobs.Product("c", c, ("a", "b")), jobs.Product("d", make("d", 1000.0), ("c",))]

    def fails(*needed):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        jobs.run_products(spark, str(tmp_path), graph(fails), "s")
    assert calls == ["a", "b"]
    tables, written = jobs.run_products(spark, str(tmp_path), graph(make("c", 100.0)), "s")
    assert calls == ["a", "b", "c", "d"] and written == {"a": False, "b": False, "c": True, "d": True}
    assert tables["d"].first()["value"] == 1111.0
    assert not any(jobs.run_products(spark, str(tmp_path), graph(fails), "s")[1].values())
    calls.clear()
    assert jobs.run_products(spark, str(tmp_path), graph(make("c", 200.0)), "s", redo=["b"])[1] == {"a": False, "b": True, "c": True, "d": True}
    assert calls == ["b", "c", "d"]
    calls.clear()
    jobs.run_products(spark, str(tmp_path), graph(make("c", 200.0)), "other files")
    assert calls == ["a", "b", "c", "d"]


BASE = "b.e21.BWSSP245.f09_g17.release-cesm2.1.3.WACCM-MA-1deg"
HIST = "b.e21.BWHIST.f09_g17.release-cesm2.1.3.WACCM-MA-1deg"
LOWER = f"{BASE}.SSP245-MA-GAUSS-LOWER-0.5"
FILE = "file string, date date, step int, cell_id int, value double"


def month_rows(case, member, field, years, value, span="201501-209912"):
    return [(f"{case}.{member}.cam.h0.{field}.{span}", dt.date(y, m, 1), None, c, float(value(y, m, c))) for y in years for m in range(1, 13) for c in (0, 1)]


@pytest.fixture
def stored(frame, tmp_path):
    def write(rows):
        path = str(tmp_path / "files")
        grid.write_grid(frame(rows, FILE), path, ["file"])
        return path
    return write


@pytest.fixture
def cells(frame):
    return frame([(0, 0, 0, -30.0, 0.0), (1, 1, 0, 60.0, 0.0)], "cell_id int, lat_idx int, lon_idx int, lat double, lon double")


def model(years=range(2015, 2019)):
    rows = month_rows(BASE, "001", "TREFHT", years, lambda y, m, c: y - 2000 + c + m / 12) + month_rows(HIST, "001", "TREFHT", (2013, 2014), lambda y, m, c: 5 + c, "185001-201412")
    rows += month_rows(HIST, "001", "PRECC", (2014,), lambda y, m, c: 1e-9, "185001-201412") + month_rows(HIST, "001", "PRECL", (2014,), lambda y, m, c: 2e-9, "185001-201412")
    rows += month_rows(BASE, "001", "PRECT", years, lambda y, m, c: 4e-9) + month_rows(BASE, "001", "QFLX", years, lambda y, m, c: 1e-6)
    days = [dt.date(2015, 1, d) for d in (1, 2, 3)]
    rows += [(f"{BASE}.001.cam.h1.TREFHT.20150101-20241231", d, None, c, 0.0 if d.day == 3 else 300.0 + 10 * d.day + c) for d in days for c in (0, 1)]
    rows += [(f"{BASE}.001.cam.h1.PRECT.20150101-20241231", d, None, c, 2e-7) for d in days for c in (0, 1)]
    rows += [(f"{LOWER}.002.cam.h1.{f}.20350201-20350301", None, s, 0, v) for f, v in (("TREFHT", 320.0), ("PRECT", 1e-7)) for s in range(7, 7 + 28 + 31 + 5)]
    return rows


def test_files_to_products_and_back_to_work(spark, stored, cells, tmp_path, monkeypatch):
    root = stored(model())
    kw = dict(fit=(2015, 2018), window=(2015, 2016))
    out, written = jobs.process_files(spark, root, str(tmp_path / "out"), cells, **kw)
    assert all(written.values())
    annual = as_dict(out["annual"], ["variable", "experiment", "year", "cell_id"])
    assert annual["tas", "baseline", 2013, 1] == 6.0 and annual["tas", "baseline", 2015, 0] == pytest.approx(15 + 6.5 / 12)
    assert annual["pr", "baseline", 2014, 0] == pytest.approx(3e-9 * 86400000) and annual["p-e", "baseline", 2016, 0] == pytest.approx(4e-9 * 86400000 - 1e-6 * 86400)
    assert annual["tasmax", "baseline", 2015, 1] == 321.0 and annual["tasmin", "baseline", 2015, 0] == 310.0  # the day of zeros is gone
    assert annual["tas_above_35", "baseline", 2015, 0] == 2.0 and annual["pr_above_10", "baseline", 2015, 0] == 3.0
    # numbered days: February and March of the 365-day calendar, the five beyond are cut
    low = as_dict(out["indices"].filter("experiment = '1.0' and variable = 'tas_above_40'"), ["year", "month"])
    assert low == {(2035, 2): 28.0, (2035, 3): 31.0}
    assert as_dict(out["natural"], "variable")["tas"] == pytest.approx(0, abs=1e-9)
    # one stage is gone: it and what comes from it is made again, the rest is read
    for f in (tmp_path / "out" / "ensemble").rglob("*.parquet"):
        f.unlink()
    again, written = jobs.process_files(spark, root, str(tmp_path / "out"), cells, **kw)
    assert written == {"indices": False, "months": False, "members": False, "natural": False, "regional": False, "ensemble": True, "annual": True}
    assert as_dict(again["annual"], ["variable", "experiment", "year", "cell_id"]) == annual
    target = cells.filter("cell_id = 0").withColumn("lat", F.lit(15.0))
    other = jobs.process_files(spark, root, str(tmp_path / "regridded"), cells, target_cells=target, **kw)[0]
    assert as_dict(other["annual"], ["variable", "experiment", "year"])["tas", "baseline", 2013] == pytest.approx(5.5)


def test_gaps_and_lone_components_are_errors(spark, stored, cells, tmp_path):
    gap = [r for r in model() if not (".QFLX." in r[0] and r[1] == dt.date(2016, 5, 1))]
    with pytest.raises(ValueError, match="2016, 6"):
        jobs.stored_months(spark, stored(gap), ["p-e"])
    alone = [r for r in model() if not (".PRECL." in r[0] and r[1] == dt.date(2014, 2, 1) and r[3] == 1)]
    with pytest.raises(ValueError, match="other part"):
        jobs.total_precipitation(spark, stored(alone))
    with pytest.raises(ValueError):
        jobs.climate_products(spark, str(tmp_path), cells, variables=["humidity"])


def test_years_are_cut_by_kind(frame):
    rows = [(e, y, 1.0) for e in ("historical", "cmip_historical", "baseline", "1.5") for y in (1849, 1850, 2014, 2015, 2099, 2100)]
    out = jobs.keep_years(frame(rows, "experiment string, year int, value double"))
    assert {(r["experiment"], r["year"]) for r in out.collect()} == {(e, y) for e in ("historical", "cmip_historical") for y in (1850, 2014)} | {(e, y) for e in ("baseline", "1.5") for y in (2015, 2099)}


def test_process_daily_still_takes_tables(frame):
    rows = [("e", "m", dt.date(2015, 1, d), 0, 300.0 + d) for d in (1, 2)]
    assert as_dict(P.process_daily(frame(rows, "experiment string, member string, date date, cell_id int, value double"), "tas"), "variable")["tasmax"] == 302.0
