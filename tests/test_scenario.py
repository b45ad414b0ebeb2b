import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.operators import scenario as S
from gridspark.schema import literal_table


def test_suffix_match_is_exact(frame):
    rows = frame([("Emissions|CO2|MAGICC AFOLU", 1), ("Emissions|CO2", 2), ("Emissions|XCO2", 3), ("CO2", 4), ("Emissions|CFC11", 5)], "variable string, i int")
    names = S.scenario_names(frame([("CO2 AFOLU",), ("CO2",), ("CFC-11",)], "specie string"))
    out = {(r["specie"], r["i"]) for r in S.match_species(rows, names).collect()}
    assert out == {("CO2 AFOLU", 1), ("CO2", 2), ("CFC-11", 5)}


def test_unit_conversion(frame):
    species = frame([("CO2", 44.009), ("CH4", 16.043), ("BC", 12.011), ("VOC", None)], "specie string, molecular_weight double")
    rows = frame([("a", "Gt C/yr", "Gt CO2/yr", 1.0), ("b", "kt CH4/day", "Mt CH4/yr", 1.0), ("c", "Mt NO/yr", "Mt NO2/yr", 1.0), ("d", "ppm", "ppt", 1.0),
                  ("e", "Mt VOC/yr", "Mt VOC/yr", 2.0), ("f", "Mt QQ/yr", "Mt BC/yr", 1.0), ("g", "furlong", "ppt", 1.0), ("h", "kg N/s", "Mt N2O/yr", 1.0)],
                 "k string, unit string, target_unit string, value double")
    weights = S.molecular_weights(species.unionByName(frame([("N2O", 44.013)], "specie string, molecular_weight double")))
    got = S.convert_units(rows, weights)
    out, bad = as_dict(got, "k"), as_dict(got, "k", "unit_error")
    assert [out[k] for k in "abcdeh"] == pytest.approx([44.009 / 12.011, 365.24219 / 1000, 46.006 / 30.006, 1e6, 2.0, 1e-9 * 44.013 / 14.007 * S.SECONDS_PER_YEAR])
    assert [k for k in sorted(bad) if bad[k]] == ["f", "g"] and out["f"] is None


def test_tidy(spark, frame):
    wide = frame([("ssp1", "World", "Emissions|CH4", "Mt CH4/yr", 10.0, None, 14.0, None), ("ssp1", "Asia", "Emissions|CH4", "Mt CH4/yr", 1.0, 1.0, 1.0, 1.0),
                  ("ssp1", "World", "Emissions|CO2|MAGICC AFOLU", "Mt C/yr", 12.011, 12.011, 12.011, 12.011)],
                 "scenario string, region string, variable string, unit string, `2000` double, `2001` double, `2002` double, `2003` double")
    species = frame([("CH4", 16.043), ("CO2 AFOLU", None), ("CO2", 44.009)], "specie string, molecular_weight double")
    got = S.tidy_scenarios(wide, species, "emissions", 1999.5, 2004.5)
    out = as_dict(got, ["specie", "t"])
    assert [out["CH4", 1999.5 + i] for i in range(6)] == [8.0, 10.0, 12.0, 14.0, 14.0, 14.0]
    assert out["CO2 AFOLU", 2001.5] == pytest.approx(0.044009)
    wanted = literal_table(spark, [("ssp1", "CH4"), ("ssp1", "CO2")], ["scenario", "specie"])
    lacking = S.missing_species(got, wanted)
    assert [r["specie"] for r in lacking.collect()] == ["CO2"]
    with pytest.raises(ValueError, match="CO2"):
        S.require(lacking, "no rows found")


def test_overrides_reach_their_species(frame):
    configs = frame([("c1", 2.0, 0.5, 9.0), ("c2", 3.0, 0.6, 8.0)], "config string, fscale_minorGHG double, fscale_CO2 double, aci_beta double")
    over = S.parameter_overrides(configs)
    assert over.count() == 2 * (len(S.MINOR_GASES) + 1 + 1)
    species = frame([("CO2", 1.0, None), ("SF6", 1.0, None), ("CO2 FFI", 1.0, 7.0)], "specie string, forcing_scale double, aci_scale double")
    rows = frame([(c, s) for c in ("c1", "c2") for s in ("CO2", "SF6", "CO2 FFI")], "config string, specie string")
    out = S.attach_species_params(rows, species, over, ["forcing_scale", "aci_scale"])
    assert as_dict(out, ["config", "specie"], "forcing_scale") == {
        ("c1", "CO2"): 0.5, ("c1", "SF6"): 2.0, ("c1", "CO2 FFI"): 1.0, ("c2", "CO2"): 0.6, ("c2", "SF6"): 3.0, ("c2", "CO2 FFI"): 1.0}
    assert set(as_dict(out, ["config", "specie"], "aci_scale").values()) == {9.0, 8.0}


def test_natural_forcing_trend(frame):
    natural = frame([(1750, 1.0, 0.1), (1885, 0.0, 0.1), (2020, 0.0, 0.1), (2100, None, 0.1)], "t int, volcanic double, solar double")
    configs = frame([("c", 2.0, 3.0, 10.0)], "config string, fscale_volcanic double, fscale_solar_amplitude double, fscale_solar_trend double")
    out = S.scale_forcing_by_config(natural, configs)
    assert as_dict(out, "t", "solar") == pytest.approx({1750: 0.3, 1885: 5.3, 2020: 10.3, 2100: 10.3})
    assert as_dict(out, "t", "volcanic") == {1750: 2.0, 1885: 0.0, 2020: 0.0, 2100: None}


def test_sample_does_not_depend_on_partitioning(frame):
    configs = frame([(str(i), float(i)) for i in range(50)], "config string, x double")
    one = {r["config"] for r in S.sample_configs(configs.repartition(7), 10).collect()}
    assert one == {r["config"] for r in S.sample_configs(configs.coalesce(1), 10).collect()} and len(one) == 10
    assert one != {r["config"] for r in S.sample_configs(configs, 10, seed=1).collect()}


def test_calibration_and_median(frame):
    configs = frame([("a", 1.0, 5.0), ("b", 2.0, 1.0), ("c", 6.0, 3.0), ("d", 3.0, 2.0)], "config string, clim_c1 double, x double")
    assert as_dict(S.config_median(configs, ["clim_c1", "x"]), "param") == {"clim_c1": 2.5, "x": 2.5}
    fixed = S.calibrate_configs(configs)
    assert fixed.select("clim_c1", "clim_F_4xCO2").distinct().first()[:] == (4.830712, 8.175245)


def test_checks(frame):
    good = [("CO2", "co2", "calculated"), ("CO2 FFI", "co2 ffi", "emissions"), ("CO2 AFOLU", "co2 afolu", "emissions"), ("CH4", "ch4", "emissions"), ("N2O", "n2o", "emissions")]
    schema = "specie string, type string, input_mode string"
    assert S.check_species(frame(good, schema)).count() == 0
    assert S.check_dependencies(frame(good, schema)).count() == 0
    bad = [*good[:1], ("X", "mystery", "emissions"), ("S", "sulfur", "concentration"), ("EESC", "eesc", "calculated"), ("C2", "co2", "forcing"), ("L", "land use", "calculated")]
    rules = {(r["rule"], r["subject"]) for r in S.check_species(frame(bad, schema), frame([("Q",)], "specie string")).collect()}
    assert rules == {("type", "X"), ("input_mode", "S"), ("repeated", "co2"), ("properties", "Q")}
    deps = lambda **kw: {r["rule"] for r in S.check_dependencies(frame(bad, schema), **kw).collect()}
    assert deps() == {"co2_sources", "land_use_source", "eesc_source", "main_gases"}
    assert deps(ghg_method="leach2021", ch4_method="leach2021") == {"co2_sources", "land_use_source"}
    series = frame([("CH4", "emissions", 1.0), ("N2O", "emissions", None)], "specie string, mode string, value double")
    assert as_dict(S.check_no_missing(series), "specie", "n_missing") == {"N2O": 1}


def test_sectors(frame):
    rows = [("s", 2000, v, 1.0) for v in (*S.BURNING_SECTORS, *S.OTHER_SECTORS, "Emissions|NOx|Other")] + [("s", 2001, S.BURNING_SECTORS[0], None)]
    out = as_dict(S.sector_sum(frame(rows, "scenario string, t int, variable string, value double")), "t")
    assert out == {2000: pytest.approx(4 * 46.006 / 30.006 + 2), 2001: None}


def test_wanted_units(frame):
    x = frame([("HFC-134a",), ("CO2",), ("NOx aviation",)], "specie string")
    units = x.select(S.emission_unit(F.col("specie")), S.mixing_unit(F.col("specie"))).collect()
    assert [tuple(u) for u in units] == [("kt HFC134a/yr", "ppt"), ("Gt CO2/yr", "ppm"), ("Mt NO2/yr", "ppt")]
