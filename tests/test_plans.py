"""Plan shapes that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from gridspark.operators import align, signal, spatial, stats, timeops
from gridspark.plans.adapters import cells, daily, region_edges

SF = "/root/testdata/sf0.001"


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_daily_job_is_one_shuffle_with_partial_aggregates(spark, frame, tmp_path, capsys):
    path = str(tmp_path / "daily")
    daily(spark, SF, "tas").withColumn("unused", F.lit(1)).write.partitionBy("experiment").parquet(path)
    stored = spark.read.parquet(path).filter("experiment = 'O' and date >= DATE'1996-01-01'")
    text = plan(timeops.daily_indices(stored, ["experiment", "member", "cell_id"], [("hot", ">", 300.0)]), capsys)
    assert text.count("Exchange") // 2 == 1 or text.count("(Exchange)") <= 1
    assert "partial_max" in text and "unused" not in text.split("ReadSchema")[1].splitlines()[0]
    assert "PartitionFilters: [isnotnull(experiment" in text and "GreaterThanOrEqual(date" in text


@pytest.mark.parametrize("build", [
    lambda s, c, e: spatial.point_in_polygon(c, e),
    lambda s, c, e: spatial.assign_country(c, e),
    lambda s, c, e: align.outer_scale(c.withColumn("slope", F.lit(1.0)), s.range(5).withColumn("driver", F.lit(1.0))),
    lambda s, c, e: stats.population_variability(s.createDataFrame([(1.0,), (2.0,)], "value double"), c.withColumn("persons", F.lit(1.0))),
    lambda s, c, e: signal.convolve_decay(s.createDataFrame([("a", 1, 1.0)], "band string, k int, value double"),
                                          s.createDataFrame([("a", 1.0, 1.0, 1.0)], "band string, beta double, alpha double, gamma double")),
    lambda s, c, e: signal.convolve_kernel(s.createDataFrame([("a", 1, 1.0)], "band string, k int, value double"),
                                           s.createDataFrame([("a", 1.0, 1.0)], "band string, tau double, mu double")),
])
def test_no_pairwise_joins(spark, capsys, build):
    text = plan(build(spark, cells(spark, SF), region_edges(spark, SF)), capsys)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_reduced_tables_are_broadcast_only_while_small(spark, capsys):
    fits = [("s", y, float(y)) for y in range(10)]
    df = spark.createDataFrame(fits, "s string, year int, value double")
    assert "BroadcastHashJoin" in plan(timeops.detrend_linear(df, ["s"]), capsys)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(timeops.detrend_linear(df, ["s"]), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_no_forced_broadcast_in_the_library():
    import pathlib
    import gridspark
    root = pathlib.Path(gridspark.__file__).parent
    text = "".join(p.read_text() for p in root.rglob("*.py"))
    for word in ("broadcast(", "crossJoin", "localCheckpoint", "toPandas(", ".rdd"):
        assert word not in text


def test_map_products_spread_with_their_size(spark, monkeypatch):
    """A small pattern is dealt out before it is multiplied, by the rows of the product, and nothing shuffles above it."""
    monkeypatch.setattr(align, "ROWS_PER_TASK", 1000)
    pattern = spark.range(500).selectExpr("cast(id as int) as cell_id", "'tas' as variable", "1.0D as slope")
    sizes = []
    for years in (4, 40):
        out = align.outer_scale(pattern, spark.range(years).selectExpr("id as year", "2.0D as driver"))
        sizes.append(out.rdd.getNumPartitions())
        text = out._jdf.queryExecution().toString()
        assert "Semi" not in text and text.split("== Physical Plan ==")[1].split("BroadcastHashJoin")[0].count("Exchange") == 0
    assert sizes == [2, 20]


def test_predictions_take_one_model(spark):
    from pyspark.errors import PySparkException

    from gridspark.plans import products as P
    coef = spark.createDataFrame([("tas", "001", 0, 1, 1.0, 0.0), ("tas", "002", 0, 1, 3.0, 0.0)],
                                 "variable string, model string, replicate int, cell_id int, slope double, intercept double")
    assert P.mean_coefs(coef, "001").first()["slope"] == 1.0
    with pytest.raises(PySparkException, match="several models"):
        P.mean_coefs(coef).collect()
    series = spark.createDataFrame([("s", y, 1.0) for y in (2099, 2100, 2101)], "scenario string, year int, driver double")
    land = spark.createDataFrame([(1,)], "cell_id int")
    assert {r["year"] for r in P.predict_map(coef, series, ["tas"], land, model="002").collect()} == {2099, 2100}
