"""Numerical pieces Spark has no built-in for: a diffusion kernel and a low-pass filter."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def semi_infinite_kernel(lag: pd.Series, tau: pd.Series, mu: pd.Series) -> pd.Series:
    """Response of a semi-infinite diffusive body ``lag`` steps after a unit forcing."""
    u = lag.to_numpy(float) / tau.to_numpy(float)
    root = np.sqrt(u)
    with np.errstate(over="ignore", invalid="ignore"):
        decay = np.exp(u) * np.array([math.erfc(x) for x in root])
    # beyond the range of exp the product is replaced by its asymptotic form
    smooth = 2 / math.sqrt(math.pi) / (root + np.sqrt(u + 2))
    decay = np.where(np.isfinite(decay), decay, smooth)
    return pd.Series(mu.to_numpy(float) * (1 / np.sqrt(math.pi * u) - decay))


def lowpass_coefficients(order: int = 3, cutoff: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Butterworth low-pass (cutoff as a share of the Nyquist rate): numerator, denominator, step state."""
    warped = 4 * math.tan(math.pi * cutoff / 2)
    angles = math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    poles = warped * np.exp(1j * angles)
    digital = (4 + poles) / (4 - poles)
    a = np.real(np.poly(digital))
    b = np.poly(-np.ones(order)) * a.sum() / 2 ** order
    # state z of the transposed filter that leaves a constant input unchanged
    z = np.zeros(order)
    z[-1] = b[-1] - a[-1]
    for i in range(order - 2, -1, -1):
        z[i] = b[i + 1] - a[i + 1] + z[i + 1]
    return b, a, z


def _run_filter(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> np.ndarray:
    out, s = np.empty_like(x), np.append(state * x[0], 0.0)
    for i, value in enumerate(x):
        out[i] = y = s[0] + b[0] * value
        s[:-1] = s[1:] + b[1:] * value - a[1:] * y
    return out


def zero_phase_lowpass(x: np.ndarray, order: int = 3, cutoff: float = 0.1) -> np.ndarray:
    """Forward and backward pass over the series extended oddly at both ends."""
    b, a, state = lowpass_coefficients(order, cutoff)
    edge = 3 * (order + 1)
    if len(x) <= edge:
        raise ValueError(f"the series must be longer than {edge} points")
    ext = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2:-edge - 2:-1]])
    ahead = _run_filter(ext, b, a, state)
    return _run_filter(ahead[::-1], b, a, state)[::-1][edge:-edge]
