import math

import pytest
from conftest import as_dict

from gridspark.operators import forcing as X

GAS = "scenario string, config string, t int, specie string, concentration double, reference_concentration double, baseline_concentration double, scale double, efficiency double"
BASE = {"CO2": 277.15, "CH4": 731.41, "N2O": 273.87}


def gases(frame, co2=560.0, ch4=1800.0, n2o=330.0):
    now = {"CO2": co2, "CH4": ch4, "N2O": n2o}
    rows = [("s", "c", 2020, g, now[g], BASE[g], BASE[g], 1.0, 0.0) for g in BASE] + [("s", "c", 2020, "SF6", 10.0, 0.0, 0.0, 2.0, 0.57)]
    return frame(rows, GAS)


@pytest.mark.parametrize("method", sorted(X.GHG_METHODS))
def test_no_forcing_at_the_reference(frame, method):
    out = as_dict(X.ghg_forcing(gases(frame, *BASE.values()), method), "specie", "forcing")
    assert [out[g] for g in BASE] == pytest.approx([0, 0, 0], abs=1e-12)
    assert out["SF6"] == pytest.approx(10 * 0.57 * 0.001 * 2)


@pytest.mark.parametrize("method,low,high", [("meinshausen2020", 3.6, 4.2), ("etminan2016", 3.6, 4.2), ("myhre1998", 3.7, 3.8), ("leach2021", 3.6, 4.0)])
def test_doubling_co2(frame, method, low, high):
    out = as_dict(X.ghg_forcing(gases(frame, co2=2 * BASE["CO2"]), method), "specie", "forcing")
    assert low < out["CO2"] < high and 0.3 < out["CH4"] < 0.7


def test_co2_branches(frame):
    k = X.MEINSHAUSEN2020
    peak = BASE["CO2"] - k["b1"] / (2 * k["a1"])
    for co2, alpha in ((250.0, k["d1"]), (peak + 100, k["d1"] - k["b1"] ** 2 / (4 * k["a1"]))):
        out = as_dict(X.ghg_forcing(gases(frame, co2=co2)), "specie", "forcing")["CO2"]
        assert out == pytest.approx((alpha + k["c1"] * math.sqrt(330)) * math.log(co2 / BASE["CO2"]))


def test_offset_and_missing_gas(frame):
    rows = [("s", "c", 1, "CO2", 400.0, 277.0, 280.0, 1.0, 0.0), ("s", "c", 1, "CH4", 1800.0, 700.0, 720.0, 1.0, 0.0), ("s", "c", 1, "N2O", None, 270.0, 271.0, 1.0, 0.0)]
    out = X.ghg_forcing(frame(rows, GAS))
    assert as_dict(out, "specie", "forcing") == {"CO2": None, "CH4": None, "N2O": None}  # overlaps need all three
    base = [(*r[:4], r[6], *r[5:]) for r in rows]
    out = as_dict(X.ghg_forcing(frame(base, GAS)), "specie", "forcing")
    assert list(out.values()) == pytest.approx([0, 0, 0])
    with pytest.raises(ValueError):
        X.ghg_forcing(frame(rows, GAS), "guess")


def test_linear_skips_missing_and_ozone_does_not(frame):
    rows = [("s", "c", 1, "a", 5.0, 1.0, 2.0, 1.0, True, False), ("s", "c", 1, "b", None, 1.0, 2.0, 1.0, True, False)]
    df = frame(rows, "scenario string, config string, t int, specie string, emissions double, baseline_emissions double, efficiency double, scale double, from_emissions boolean, from_concentration boolean")
    df = df.selectExpr("*", "emissions as driver", "baseline_emissions as baseline", "0D as concentration", "0D as baseline_concentration")
    assert X.linear_forcing(df).first()["forcing"] == 8.0
    assert X.aerosol_direct(df).first()["forcing"] == 8.0
    assert X.ozone_forcing(df).first()["forcing"] is None
    assert X.ozone_forcing(df.filter("specie = 'a'")).first()["forcing"] == 8.0


def test_concentration_wins_in_direct_but_both_count_in_indirect(frame):
    df = frame([("s", "c", 1, "a", 3.0, 1.0, 7.0, 2.0, 1.0, 1.0, True, True, 0.5, -1.0, 2.0)],
               "scenario string, config string, t int, specie string, emissions double, baseline_emissions double, concentration double, baseline_concentration double,"
               "efficiency double, scale double, from_emissions boolean, from_concentration boolean, sensitivity double, aci_scale double, aci_forcing_scale double")
    assert X.aerosol_direct(df).first()["forcing"] == 5.0
    want = -2 * (math.log(1 + 0.5 * 3 + 0.5 * 7) - math.log(1 + 0.5 * 1 + 0.5 * 2))
    assert X.aerosol_indirect(df).first()["forcing"] == pytest.approx(want)


def test_chlorine(frame):
    df = frame([("s", "c", 1, "CFC-11", 3.0, 0.0, 250.0, 0.47), ("s", "c", 1, "Halon-1301", 0.0, 1.0, 3.0, 0.28), ("s", "d", 1, "Halon-1301", 0.0, 1.0, 3.0, 0.28)],
               "scenario string, config string, t int, specie string, cl_atoms double, br_atoms double, concentration double, release double")
    out = as_dict(X.eesc(df), "config", "eesc")
    assert out == {"c": pytest.approx(3 * 250 * 0.47 + 45 * 3 * 0.28), "d": None}


def test_methane_lifetime(frame):
    df = frame([("s", "c", 1, "NOx", 30.0, 10.0, None, None, True, False, -0.002, 1.0, -0.04), ("s", "c", 1, "CH4", None, None, 1800.0, 800.0, False, True, 0.0003, 1.0, -0.04)],
               "scenario string, config string, t int, specie string, emissions double, baseline_emissions double, concentration double, baseline_concentration double,"
               "from_emissions boolean, from_concentration boolean, sensitivity double, temperature double, temperature_sensitivity double")
    assert X.methane_lifetime_scale(df).first()["lifetime_scale"] == pytest.approx((1 - 0.04) * 1.3 * 0.96)


def test_single_box_species(frame):
    cols = "specie string, molecular_weight double, " + ", ".join(f"partition_fraction{i} double, unperturbed_lifetime{i} double" for i in range(4))
    row = X.species_derived(frame([("CH4", 16.043, 1.0, 8.25, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], cols)).first()
    e = math.exp(-100 / 8.25)
    assert row["iirf_0"] == pytest.approx(8.25 * (1 - e)) and row["g1"] == pytest.approx(8.25 * (1 - (1 + 100 / 8.25) * e))
    assert row["g0"] == pytest.approx(math.exp(-row["iirf_0"] / row["g1"]))
    assert row["concentration_per_emission"] == pytest.approx(28.97 / (5.1352 * 16.043))


def test_temperature_feedback_uses_the_previous_step(frame):
    f = frame([("s", "c", t, g, 1.0, 0.5, 2.0) for t in (1, 2) for g in "ab"], "scenario string, config string, t int, specie string, forcing double, temperature_feedback double, efficacy double")
    temp = frame([("s", "c", 1, 4.0), ("s", "c", 2, 99.0)], "scenario string, config string, t int, temperature double")
    out = X.total_forcing(f, temperature=temp, step=1)
    assert as_dict(out, "t", "forcing_sum") == {1: 2.0, 2: 6.0}
    assert as_dict(out, "t", "forcing_efficacy_sum") == {1: 4.0, 2: 12.0}
    assert as_dict(X.total_forcing(f), "t", "forcing_sum") == {1: 2.0, 2: 2.0}


def test_heat(frame):
    temp = frame([("s", "c", t, layer, float(t + 1) / (layer + 1)) for t in range(3) for layer in range(3)], "scenario string, config string, t int, layer int, temperature double")
    forcing = frame([("s", "c", t, 2.0 * t) for t in range(3)], "scenario string, config string, t int, forcing_sum double")
    configs = frame([("c", 0.6, 0.9, 1.7)], "config string, kappa1 double, kappa3 double, efficacy double")
    n = as_dict(X.toa_imbalance(temp, forcing, configs), "t", "toa_imbalance")
    want = [2.0 * t - 0.6 * (t + 1) + (1 - 1.7) * 0.9 * ((t + 1) / 2 - (t + 1) / 3) for t in range(3)]
    assert [n[t] for t in range(3)] == pytest.approx(want)
    heat = as_dict(X.ocean_heat(X.toa_imbalance(temp, forcing, configs)), "t", "ocean_heat")
    assert [heat[t] for t in range(3)] == pytest.approx([0, want[1] * X.EARTH_RADIUS ** 2 * 4 * math.pi * X.SECONDS_PER_YEAR, (want[1] + want[2]) * X.EARTH_RADIUS ** 2 * 4 * math.pi * X.SECONDS_PER_YEAR])
