import json

import pytest
from conftest import as_dict

from gridspark import scratch
from gridspark.plans import load_queries
from gridspark.plans.registry import QUERIES
from gridspark.sources import grid, tables

CASE = "b.e21.BWSSP245.f09_g17.release-cesm2.1.3.WACCM-MA-1deg"
NAMES = {
    f"{CASE}.001.cam.h0.TREFHT.201501-206412.nc": ("baseline", "001"),
    f"{CASE}.SSP245-MA-GAUSS-DEFAULT.002.cam.h0.TREFHT.203501-206912.nc": ("1.5", "002"),
    f"{CASE}.SSP245-MA-GAUSS-LOWER-0.5.003.cam.h0.TREFHT.203501-206912.nc": ("1.0", "003"),
    f"{CASE}.SSP245-MA-GAUSS-LOWER-1.0.001.cam.h0.TREFHT.203501-206912.nc": ("0.5", "001"),
    "b.e21.BWHIST.f09_g17.CMIP6-historical-WACCM.001.cam.h0.TREFHT.185001-201412.nc": ("cmip_historical", "001"),
    "b.e21.BWHIST.f09_g17.release-cesm2.1.3.WACCM-MA-1deg.002.cam.h0.TREFHT.185001-201412.nc": ("historical", "002"),
}


def test_file_names(frame):
    rows = grid.file_keys(frame([(n,) for n in NAMES], "file string")).collect()
    assert {r["file"]: (r["experiment"], r["member"]) for r in rows} == NAMES
    assert {r["field"] for r in rows} == {"TREFHT"}


def test_flat_files_are_picked_by_name(spark, frame, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for i, name in enumerate([f"{CASE}.001.cam.h0.TREFHT.201501-206412", f"{CASE}.001.cam.h0.PRECT.201501-206412", f"{CASE}.001.cam.h1.TREFHT.20150101-20241231",
                              f"{CASE}.001.cam.h1.TREFHT.20250102-20341231"]):
        pq.write_table(pa.table({"cell_id": [i], "value": [1.0]}), tmp_path / f"{name}.parquet")
    pick = lambda field, daily: [r["cell_id"] for r in grid.scan_grid(spark, str(tmp_path), field, daily).collect()]
    assert pick("TREFHT", False) == [0] and pick("PRECT", False) == [1]
    assert pick("TREFHT", True) == [2]  # the baseline's other daily files are incomplete
    assert pick("QFLX", False) == []


def test_labels_survive_partitioned_tables(spark, frame, tmp_path):
    df = frame([("1.0", "001", 1.0), ("0.5", "002", 2.0), ("baseline", "001", 3.0)], "experiment string, member string, value double")
    path = str(tmp_path / "grid")
    grid.write_grid(df.filter("experiment <> 'baseline'"), path, ["experiment", "member"])
    grid.write_grid(df.filter("experiment <> '0.5'"), path, ["experiment", "member"])
    back = grid.read_grid(spark, path, df.schema)
    assert as_dict(back, ["experiment", "member"]) == {("1.0", "001"): 1.0, ("0.5", "002"): 2.0, ("baseline", "001"): 3.0}


def test_missing_work(spark, frame, tmp_path):
    work = frame([("tas", "1.0"), ("tas", "1.5"), ("pr", "1.0")], "variable string, target string")
    path = str(tmp_path / "p")
    build = lambda todo: todo.selectExpr("variable", "target", "1D as value")
    assert grid.existing_keys(spark, path, work, ["variable", "target"]) is None
    assert grid.write_missing(spark, work.filter("target = '1.0'"), path, ["variable", "target"], build)
    done = grid.existing_keys(spark, path, work, ["variable", "target"])
    assert [tuple(r) for r in grid.materialize_missing(work, done, ["variable", "target"]).collect()] == [("tas", "1.5")]
    assert grid.materialize_missing(work, done, ["variable", "target"], ignore_existing=True).count() == 3
    assert grid.write_missing(spark, work, path, ["variable", "target"], build)
    assert not grid.write_missing(spark, work, path, ["variable", "target"], build)
    assert spark.read.parquet(path).count() == 3


def test_duplicates(frame):
    df = frame([(1, 2015), (1, 2015), (2, 2015)], "cell_id int, year int")
    assert as_dict(grid.duplicate_keys(df, ["cell_id", "year"]), "cell_id", "n") == {1: 2}


def test_controller_tables(spark, tmp_path):
    head = "Timestamp dT0 30S(Tg) 15S(Tg)\n"
    (tmp_path / "a_001.txt").write_text(head + "2035 0.2 0. 0.602\n2036 0.3 0.05 0.87\n2071 1 1 1\n\n")
    (tmp_path / "a_002.txt").write_text(head + "2035 0.1 1.5e-3 2\n")
    out = tables.scan_ws_table(spark, str(tmp_path), {"15S(Tg)": "s15", "30S(Tg)": "s30"}, years=(2035, 2070))
    rows = sorted((r["file"], r["year"], r["s15"], r["s30"]) for r in out.collect())
    assert rows == [("a_001.txt", 2035, 0.602, 0.0), ("a_001.txt", 2036, 0.87, 0.05), ("a_002.txt", 2035, 2.0, 0.0015)]
    with pytest.raises(ValueError, match="60S"):
        tables.scan_ws_table(spark, str(tmp_path), {"60S": "x"})


def test_natural_forcing_of_every_scenario(spark, frame, tmp_path):
    """Each scenario has its own rows, and its own end of the volcanic file."""
    frame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 3, 5.0), ("c", 3, 7.0)], "scenario string, year int, erf double").write.csv(str(tmp_path / "s"), header=True)
    frame([("a", 2, 10.0), ("b", 3, 20.0), ("b", 4, 30.0)], "scenario string, timebounds int, erf double").write.csv(str(tmp_path / "v"), header=True)
    rows = tables.scan_natural_forcing(spark, str(tmp_path / "s"), str(tmp_path / "v"), ["scenario"]).collect()
    assert {(r.scenario, r.t): (r.volcanic, r.solar) for r in rows} == {
        ("a", 1.0): (None, 1.0), ("a", 2.0): (10.0, None), ("a", 3.0): (0.0, 3.0), ("b", 3.0): (20.0, 5.0), ("b", 4.0): (30.0, None), ("c", 3.0): (None, 7.0)}
    assert len(rows) == 6


def test_queries_cover_every_scenario(spark):
    """Whole-table queries beside those whose SQL keeps one member or scenario."""
    load_queries()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    scenarios = {r[0] for r in orders.select("o_orderpriority").distinct().collect()}
    for name, key in (("scan_natural_forcing_by_scenario", "scenario"), ("overlay_override_by_scenario", "path")):
        assert {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.001").select(key).distinct().collect()} == scenarios
    found = {r.member for r in QUERIES["check_inputs_by_member"](spark, "/root/testdata/sf0.001").select("member").distinct().collect()}
    assert found == {"A", "N", "R"}


def test_observed_series(spark, tmp_path):
    (tmp_path / "obs.txt").write_text("% Year, Anomaly\n%\n \n  1850   -0.461  0.2  NaN\n  1851   NaN  0.2 NaN\n")
    assert as_dict(tables.scan_commented_text(spark, str(tmp_path / "obs.txt")), "year") == {1850: -0.461, 1851: None}


def test_species_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,type,input_mode,greenhouse_gas,molecular_weight\nCO2 FFI,co2 ffi,emissions,0,nan\nCH4,ch4,emissions,1,16.043\n")
    out = tables.scan_species(spark, str(tmp_path / "s.csv"))
    assert out.schema["greenhouse_gas"].dataType.simpleString() == "boolean"
    assert as_dict(out, "specie", "molecular_weight") == {"CO2 FFI": None, "CH4": 16.043}
    assert [r["specie"] for r in tables.scan_species(spark, str(tmp_path / "s.csv"), ["CH4"]).collect()] == ["CH4"]


def test_geojson(spark, tmp_path):
    square = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    hole = [[2, 2], [4, 2], [4, 4], [2, 2]]
    features = [{"type": "Feature", "properties": {"name": "one"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
                {"type": "Feature", "properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [hole]]}}]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = tables.scan_regions(spark, str(tmp_path / "g.geojson")).collect()
    assert len(rows) == 14
    assert {(r["region_id"], r["region"], r["part_id"], r["ring_id"]) for r in rows} == {(0, "one", 0, 0), (0, "one", 0, 1), (1, "two", 0, 0), (1, "two", 1, 0)}
    assert (rows[0]["x1"], rows[0]["y1"], rows[0]["x2"], rows[0]["y2"]) == (0, 0, 10, 0)


def test_scratch_folder_comes_from_the_session(spark, frame, tmp_path, monkeypatch):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    root = scratch.scratch_root(spark)
    df = scratch.settle(frame([(1, None)], "a int, b double"), "t")
    assert df.collect()[0][:] == (1, None) and df.inputFiles()[0].startswith(f"file://{root}/t-")


def test_labels_of_digits_stay_text(spark, tmp_path):
    coef = spark.createDataFrame([("tas", "001", 0, 1, 1.0, 2.0), ("tas", "119", 0, 1, 3.0, 4.0)],
                                 "variable string, model string, replicate int, cell_id int, slope double, intercept double")
    grid.write_coefs(coef, str(tmp_path / "coef"))
    back = grid.read_coefs(spark, str(tmp_path / "coef"))
    assert sorted(r["model"] for r in back.collect()) == ["001", "119"]


def test_baseline_members(spark, tmp_path):
    names = [f"b.e21.BWSSP245.f09.{m}.cam.{h}.TREFHT.{span}" for m in ("001", "003", "004") for h, span in (("h0", "201501-206412"), ("h1", "20150101-20241231"), ("h1", "20250101-20341231"))]
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "cell_id int, file string").write.partitionBy("file").parquet(str(tmp_path / "f"))
    member = lambda d, **kw: sorted({r["file"].split(".")[4] for r in grid.scan_grid(spark, str(tmp_path / "f"), "TREFHT", d, **kw).collect()})
    assert member(False) == ["001", "003"] and member(True) == ["001"]
    assert member(False, members=["004"]) == ["004"]


def test_table_headers_differ_by_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Timestamp x y\n2035 1 2\n")
    (tmp_path / "b.txt").write_text("Timestamp y z x\n2036 5 0 6\n")
    out = tables.scan_ws_table(spark, str(tmp_path), {"x": "x", "y": "y"})
    assert {(r["year"], r["x"], r["y"]) for r in out.collect()} == {(2035, 1.0, 2.0), (2036, 6.0, 5.0)}
    (tmp_path / "c.txt").write_text("2036 5 0 6\n")
    with pytest.raises(ValueError, match="c.txt"):
        tables.scan_ws_table(spark, str(tmp_path), {"x": "x"})


def test_documents_of_regions_are_read_in_blocks(spark, tmp_path):
    """Braces, quotes and escapes in names, other objects, several documents: the same features as a parser finds, by many tasks."""
    import random
    r = random.Random(4)
    names = ['plain', 'a "quoted" one', 'brace } here', 'open { [ there', 'back\\slash\\', 'tail\\\\" }', 'ünï ∑', '', '}{][', '\n']
    want = {}
    for k in range(2):
        features = []
        for i in range(700):
            ring = [[r.randrange(90), r.randrange(90)] for _ in range(r.randrange(3, 30))]
            geometry = {"type": "Polygon", "coordinates": [ring + ring[:1]]} if i % 3 else {"type": "MultiPolygon", "coordinates": [[ring + ring[:1]], [ring + ring[:1]]]}
            properties = {"x": {"y": [1, {"z": "}"}]}, "name": r.choice(names)} if i % 5 == 0 else {"name": r.choice(names), "also": None}
            features.append({"type": "Feature", "properties": properties, "geometry": geometry} if i % 2 else {"geometry": geometry, "properties": properties, "type": "Feature"})
        document = {"type": "FeatureCollection", "name": 'odd "{" name', "crs": {"type": "name", "properties": {"name": "urn:x}"}}, "bbox": [[1, 2], [3, 4]], "features": features,
                    "links": [{"href": "{"}, {"href": "}"}]}
        (tmp_path / f"g{k}.geojson").write_text(json.dumps(document, indent=k or None, ensure_ascii=False))
        for i, f in enumerate(features):
            for part, rings in enumerate([f["geometry"]["coordinates"]] if f["geometry"]["type"] == "Polygon" else f["geometry"]["coordinates"]):
                for j, (a, b) in enumerate(zip(rings[0], rings[0][1:])):
                    key = (i, f["properties"]["name"], part, 0, *map(float, (*a, *b)))
                    want[key] = want.get(key, 0) + 1
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {}
        for row in tables.scan_regions(spark, str(tmp_path)).collect():
            key = (row["region_id"], row["region"], row["part_id"], row["ring_id"], row["x1"], row["y1"], row["x2"], row["y2"])
            got[key] = got.get(key, 0) + 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == want
