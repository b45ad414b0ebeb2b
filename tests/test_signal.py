import math

import numpy as np
import pytest
from conftest import as_dict

from gridspark.functions.kernels import lowpass_coefficients, zero_phase_lowpass
from gridspark.operators import signal

SERIES = [3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0, 6.0, -5.0, 3.0, 5.0, 8.0, 9.0, 7.0]


def yearly(frame, values, name="s"):
    return frame([(name, 2000 + i, float(v)) for i, v in enumerate(values)], "s string, year int, value double")


@pytest.mark.parametrize("kind,mode", [("min_slope", "reflect"), ("min_roughness", "symmetric")])
@pytest.mark.parametrize("n", [14, 6, 2])
def test_padding_matches_numpy(frame, kind, mode, n):
    out = as_dict(signal.pad_series(yearly(frame, SERIES[:n]), ["s"], kind), "year")
    assert [out[y] for y in sorted(out)] == list(np.pad(SERIES[:n], 10, mode))
    assert min(out) == 1990


def test_mean_padding(frame):
    out = as_dict(signal.pad_series(yearly(frame, SERIES), ["s"], "min_norm"), "year")
    assert out[1990] == out[2023] == pytest.approx(sum(SERIES) / len(SERIES)) and out[2000] == 3.0
    with pytest.raises(ValueError):
        signal.pad_series(yearly(frame, SERIES), ["s"], "min_energy")


def test_lowpass_design():
    b, a, z = lowpass_coefficients()
    # published coefficients of this design
    assert b == pytest.approx([0.00289819, 0.00869458, 0.00869458, 0.00289819], abs=1e-8)
    assert a == pytest.approx([1, -2.37409474, 1.92935567, -0.53207537], abs=1e-8)
    assert z == pytest.approx([0.99710181, -1.38568752, 0.53497356], abs=1e-7)
    response = lambda w: abs(np.polyval(b[::-1], np.exp(-1j * w)) / np.polyval(a[::-1], np.exp(-1j * w)))
    assert response(0) == pytest.approx(1) and response(0.1 * math.pi) == pytest.approx(math.sqrt(0.5))


def test_smoothing_keeps_constants_and_lines(frame):
    line = yearly(frame, [2.0 * i + 1 for i in range(60)])
    flat = yearly(frame, [7.0] * 60, "t")
    out = signal.smooth_lowpass(line.unionByName(flat), ["s"], "min_roughness")
    rows = out.collect()
    assert len(rows) == 120 and {r["year"] for r in rows} == set(range(2000, 2060))
    assert all(r["value"] == pytest.approx(7.0) for r in rows if r["s"] == "t")
    middle = [r for r in rows if r["s"] == "s" and 2025 <= r["year"] < 2035]
    assert all(r["value"] == pytest.approx(2.0 * (r["year"] - 2000) + 1, abs=0.05) for r in middle)


def test_smoothing_is_linear_and_symmetric():
    x, y = np.random.default_rng(0).normal(size=(2, 80))
    assert zero_phase_lowpass(2 * x - y) == pytest.approx(2 * zero_phase_lowpass(x) - zero_phase_lowpass(y))
    pulse = np.zeros(401)
    pulse[200] = 1
    out = zero_phase_lowpass(pulse)
    assert out == pytest.approx(out[::-1], abs=1e-9) and out.sum() == pytest.approx(1)


def injections(frame, q):
    return frame([("n", k, float(v)) for k, v in enumerate(q)] + [("zero", k, 0.0) for k in range(len(q))], "band string, k int, value double")


PARAMS = [("n", 0.3, 0.05, 0.2, 9.0, 0.8), ("zero", 0.3, 0.05, 0.2, 9.0, 0.8)]


@pytest.mark.parametrize("block", [1, 4, 7, 500])
def test_decay_convolution_matches_brute_force(frame, block):
    q = [0, 0, 1.5, 0.2, 0, 3, 0, 0, 0.7, 2, 1, 0, 5, 0.1, 0, 1]
    params = frame(PARAMS, "band string, beta double, alpha double, gamma double, tau double, mu double")
    out = as_dict(signal.convolve_decay(injections(frame, q), params, block=block), ["band", "k"])
    for k in range(len(q)):
        want = sum(0.3 * math.exp(-(0.05 + 0.2 * q[k - j]) * (j + 1)) * q[k - j] for j in range(k + 1))
        assert out["n", k] == pytest.approx(want, abs=1e-12) and out["zero", k] == 0.0


def h(t, tau, mu):
    u = t / tau
    return mu * (1 / math.sqrt(math.pi * u) - math.exp(u) * math.erfc(math.sqrt(u)))


@pytest.mark.parametrize("block", [1, 2, 3, 5, 500])
def test_kernel_convolution_matches_brute_force(frame, block):
    q = [0, 1.5, 0.2, 0, 3, 0, 0, 0.7, 2, 1, 0, 5, 0.1]
    params = frame(PARAMS, "band string, beta double, alpha double, gamma double, tau double, mu double")
    out = as_dict(signal.convolve_kernel(injections(frame, q), params, block=block), ["band", "k"])
    for k in range(len(q)):
        want = sum(h(j + 1, 9.0, 0.8) * q[k - j] for j in range(k + 1))
        assert out["n", k] == pytest.approx(want, abs=1e-12) and out["zero", k] == 0.0


def test_impulse_returns_the_kernel_and_long_lags_stay_finite(frame):
    params = frame([("n", 0.5, 2.0)], "band string, tau double, mu double")
    pulse = frame([("n", k, 1.0 if k == 0 else 0.0) for k in range(600)], "band string, k int, value double")
    out = as_dict(signal.convolve_kernel(pulse, params), "k")
    assert out[0] == pytest.approx(h(1, 0.5, 2.0))
    for k in (400, 599):  # exp overflows: the asymptotic form takes over
        u = (k + 1) / 0.5
        smooth = 2 / math.sqrt(math.pi) / (math.sqrt(u) + math.sqrt(u + 2))
        assert out[k] == pytest.approx(2.0 * (1 / math.sqrt(math.pi * u) - smooth), abs=1e-15)
