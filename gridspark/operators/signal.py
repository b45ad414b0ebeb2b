"""Padding, smoothing and convolution of series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.kernels import lowpass_coefficients, semi_infinite_kernel
from gridspark.scratch import settle

PAD_KINDS = ("min_norm", "min_slope", "min_roughness")


def pad_series(df: DataFrame, keys: Sequence[str], kind: str, width: int = 10, t: str = "year",
               value: str = "value") -> DataFrame:
    """Extend each series (consecutive integer times) by ``width`` points on both sides.

    min_norm repeats the mean, min_slope reflects about the end points, min_roughness reflects about
    the edges.  Every padded position is mapped to the position it copies.
    """
    if kind not in PAD_KINDS:
        raise ValueError(f"unknown padding {kind!r}")
    span = df.groupBy(*keys).agg(F.min(t).alias("_t0"), (F.max(t) - F.min(t) + 1).alias("_n"), F.avg(value).alias("_mean"))
    pos = F.explode(F.sequence(F.lit(-width).cast("bigint"), F.col("_n").cast("bigint") - 1 + width))
    frame = span.select(*keys, "_t0", "_n", "_mean", pos.alias("_p"))
    p, n = F.col("_p"), F.col("_n")
    if kind == "min_slope":
        turn = F.coalesce(F.pmod(p, F.nullif(2 * (n - 1), F.lit(0))), F.lit(0))
        source = F.least(turn, 2 * (n - 1) - turn)
    elif kind == "min_roughness":
        turn = F.pmod(p, 2 * n)
        source = F.least(turn, 2 * n - 1 - turn)
    else:
        source = p
    frame = frame.withColumn("_src", (F.col("_t0") + source).cast("bigint"))
    points = df.select(*keys, F.col(t).cast("bigint").alias("_src"), value)
    out = frame.join(points, [*keys, "_src"], "left")
    if kind == "min_norm":
        out = out.withColumn(value, F.when(p.between(0, n - 1), F.col(value)).otherwise(F.col("_mean")))
    return out.select(*keys, (F.col("_t0") + p).cast("int").alias(t), value)


def smooth_lowpass(df: DataFrame, keys: Sequence[str], kind: str = "min_roughness", width: int = 10, order: int = 3,
                   cutoff: float = 0.1, t: str = "year", value: str = "value", block: int = 256) -> DataFrame:
    """Zero-phase Butterworth low-pass of each padded series, cropped to its own times.

    The recursion s' = A s + g x is a chain of affine maps.  A series is cut into blocks; every block is folded once from
    a zero state, the end states are carried to the blocks behind them by powers of A, and every block is folded again
    from its own start.  ``A`` to the power of a block's length has all but died out, so a block's state only reaches a
    few blocks (``reach``, from the filter's poles) and rows of a long series spread over all tasks.  A series with a
    missing point has no smooth value.
    """
    b, a, rest = lowpass_coefficients(order, cutoff)
    edge = 3 * (order + 1)
    if 2 * width + 1 <= edge:
        raise ValueError(f"the padded series must be longer than {edge} points")
    blocks = _extended_blocks(pad_series(df, keys, kind, width, t, value), keys, edge, t, value, block)
    ahead = _filter_blocks(blocks, keys, b, a, rest, block, forward=True)
    back = _filter_blocks(ahead, keys, b, a, rest, block, forward=False)
    at = F.posexplode("_x").alias("_i", value)
    rows = back.select(*keys, "_t0", "_n", "_b", "_ok", at).withColumn("_p", F.col("_b") * block + F.col("_i") - edge)
    rows = rows.filter(F.col("_p").between(width, F.col("_n") - 1 - width))
    return rows.select(*keys, (F.col("_t0") + F.col("_p")).cast("int").alias(t), F.when(F.col("_ok"), F.col(value)).alias(value))


def _extended_blocks(padded: DataFrame, keys: Sequence[str], edge: int, t: str, value: str, block: int) -> DataFrame:
    """(keys, _t0, _n, _ok, _b, _x): the series extended oddly by ``edge`` points on both sides, as arrays of blocks."""
    ends = settle(padded.groupBy(*keys).agg(
        F.min(t).alias("_t0"), F.count("*").alias("_n"), F.min_by(value, t).alias("_first"), F.max_by(value, t).alias("_last"),
        (F.count(value) == F.count("*")).alias("_ok")), "ends")
    j, n, v = F.col("_j"), F.col("_n"), F.col(value)
    points = padded.join(ends, list(keys)).withColumn("_j", (F.col(t) - F.col("_t0")).cast("bigint"))
    here = F.struct(j.alias("p"), v.alias("v"))
    before = F.when(j.between(1, edge), F.struct((-j).alias("p"), (2 * F.col("_first") - v).alias("v")))
    after = F.when(j.between(n - 1 - edge, n - 2), F.struct((2 * (n - 1) - j).alias("p"), (2 * F.col("_last") - v).alias("v")))
    rows = points.select(*keys, "_t0", "_n", "_ok", F.explode(F.array_compact(F.array(here, before, after))).alias("_x"))
    place = F.struct((F.col("_x.p") + edge).alias("p"), F.col("_x.v").alias("v"))
    cut = rows.groupBy(*keys, "_t0", "_n", "_ok", F.floor((F.col("_x.p") + edge) / block).cast("int").alias("_b")) \
        .agg(F.array_sort(F.collect_list(place)).alias("_x"))
    return cut.withColumn("_x", F.col("_x.v")).withColumn("_blocks", F.ceil((F.col("_n") + 2 * edge) / block).cast("int"))


def _filter_blocks(blocks: DataFrame, keys: Sequence[str], b: np.ndarray, a: np.ndarray, rest: np.ndarray, block: int, forward: bool) -> DataFrame:
    """One direction of the recursive filter over (keys, _b, _x); the arrays are replaced by the filter's output."""
    order = len(rest)
    step = np.diag(np.ones(order - 1), 1)
    step[:, 0] = -a[1:]
    gain = b[1:] - a[1:] * b[0]
    reach = _reach(step, block)
    # the chain ends nowhere: every table is written, as both folds and the carried states read it
    blocks = settle(blocks, "blocks")
    first = F.col("_b") == (F.lit(0) if forward else F.col("_blocks") - 1)
    x = F.col("_x") if forward else F.reverse("_x")
    names = [f"s{i}" for i in range(order)]
    state = lambda values: F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])
    own = [F.when(first, float(r) * x[0]).otherwise(F.lit(0.0)) for r in rest]

    def move(s: Column, v: Column) -> list[Column]:
        """The state after input ``v``."""
        return [(s[names[i + 1]] if i + 1 < order else F.lit(0.0)) - float(a[i + 1]) * s[names[0]] + float(gain[i]) * v for i in range(order)]

    # end states, carried to each of the next blocks
    ends = blocks.select(*keys, "_b", "_blocks", F.aggregate(x, state(own), lambda s, v: state(move(s, v))).alias("_e"))
    carried = []
    for k in range(reach):
        m = np.linalg.matrix_power(step, k * block)
        to = F.col("_b") + (k + 1 if forward else -k - 1)
        carried.append(F.struct(to.alias("_b"), *[reduce(Column.__add__, [float(m[i, j]) * F.col("_e")[names[j]] for j in range(order)]).alias(names[i]) for i in range(order)]))
    starts = ends.select(*keys, F.inline(F.array(*carried))).groupBy(*keys, "_b").agg(*[F.sum(n).alias(n) for n in names])
    begin = blocks.join(starts, [*keys, "_b"], "left")
    begin = begin.withColumn("_s", state([F.when(first, float(r) * x[0]).otherwise(F.col(n)) for r, n in zip(rest, names, strict=True)])).drop(*names)
    none = F.array().cast("array<double>")
    fold = F.aggregate(x, F.struct(F.col("_s").alias("s"), none.alias("y")), lambda acc, v: F.struct(
        state(move(acc["s"], v)).alias("s"), F.concat(acc["y"], F.array(acc["s"][names[0]] + float(b[0]) * v)).alias("y")), lambda acc: acc["y"])
    return begin.withColumn("_x", fold if forward else F.reverse(fold)).drop("_s")


def _reach(step: np.ndarray, block: int) -> int:
    """Over how many blocks a state matters to double precision."""
    k, power, whole = 1, np.linalg.matrix_power(step, block), np.linalg.matrix_power(step, block)
    while np.abs(power).max() > 1e-18 and k < 10_000:
        power, k = power @ whole, k + 1
    return k


def convolve_decay(df: DataFrame, params: DataFrame, keys: Sequence[str] = ("band",), k: str = "k",
                   value: str = "value", block: int = 256) -> DataFrame:
    """Decaying response to injections: q[m] * beta * exp(-(alpha + gamma q[m]) (k - m + 1)), summed over m <= k.

    ``params`` holds beta, alpha, gamma per key; a series of zeros stays zero.
    """
    shared = [c for c in keys if c in params.columns]
    rows = df.join(params.select(*shared, "beta", "alpha", "gamma"), shared)
    # each source step carries its own amplitude and decay rate, so the fold only needs the step distance
    q = F.col(value)
    cut = rows.withColumn("_b", F.floor(F.col(k) / block).cast("int"))
    step = F.struct(F.col(k).alias("k"), (F.col("beta") * q).alias("amp"), (F.col("alpha") + F.col("gamma") * q).alias("rate"))
    source = cut.filter(q != 0).groupBy(*keys, "_b").agg(F.collect_list(step).alias("_src"))
    return _fold_blocks(cut, source, keys, k, value, lambda s, at: s["amp"] * F.exp(-s["rate"] * (at - s["k"] + 1)))


def diffusion_kernel(params: DataFrame, keys: Sequence[str], n_lags: int | Column) -> DataFrame:
    """(keys, lag, h) for lags 1..n, from tau and mu per key."""
    n = F.lit(n_lags) if isinstance(n_lags, int) else n_lags
    lags = params.withColumn("lag", F.explode(F.sequence(F.lit(1), n)))
    return lags.select(*keys, "lag", semi_infinite_kernel(F.col("lag"), F.col("tau"), F.col("mu")).alias("h"))


def convolve_kernel(df: DataFrame, params: DataFrame, keys: Sequence[str] = ("band",), k: str = "k",
                    value: str = "value", block: int = 256) -> DataFrame:
    """Diffusive response: forcing[m] * h(k - m + 1), summed over m <= k; tau and mu per key in ``params``."""
    shared = [c for c in keys if c in params.columns]
    steps = df.groupBy(*shared).agg((F.max(k).cast("int") + 1).alias("_n"))
    kernel = diffusion_kernel(params.join(steps, shared), shared, F.col("_n"))
    # lag block d serves target and source blocks d apart: lags (d-1)*block+2 .. (d+1)*block
    lag = F.col("lag")
    first = F.greatest(F.lit(0), F.ceil(lag / block).cast("int") - 1)
    last = F.floor((lag - 2) / block).cast("int") + 1
    tiles = kernel.withColumn("_d", F.explode(F.sequence(first, F.greatest(first, last)))) \
        .groupBy(*shared, "_d").agg(F.array_sort(F.collect_list(F.struct("lag", "h"))).alias("_h"))
    tiles = tiles.select(*shared, "_d", F.col("_h.h").alias("_h"), F.element_at("_h.lag", 1).alias("_lag0"))
    cut = df.withColumn("_b", F.floor(F.col(k) / block).cast("int"))
    source = cut.filter(F.col(value) != 0).groupBy(*keys, "_b") \
        .agg(F.collect_list(F.struct(F.col(k).alias("k"), F.col(value).alias("v"))).alias("_src"))
    term = lambda s, at: s["v"] * F.element_at("_h", (at - s["k"] + 2 - F.col("_lag0")).cast("int"))
    return _fold_blocks(cut, source, keys, k, value, term, tiles, shared)


def _fold_blocks(cut: DataFrame, source: DataFrame, keys: Sequence[str], k: str, value: str, term,
                 tiles: DataFrame | None = None, tile_keys: Sequence[str] = ()) -> DataFrame:
    """sum over m <= k of term(source m, k), by blocks of steps.

    A target block meets every earlier source block once (an equi-join on series and block), and each
    target step folds over the block's array.  Step pairs are never rows, and the blocks of one long
    series spread over all tasks.
    """
    target = cut.groupBy(*keys, F.col("_b").alias("_tb")).agg(F.collect_list(F.col(k)).alias("_ks"))
    target = target.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_tb"))))
    pairs = target.join(source, [*keys, "_b"])
    if tiles is not None:
        pairs = pairs.withColumn("_d", F.col("_tb") - F.col("_b")).join(tiles, [*tile_keys, "_d"])
    # the fold runs over a block's arrays where they are; only its results are exploded
    fold = lambda at: F.aggregate("_src", F.lit(0.0), lambda acc, s: acc + F.when(s["k"] <= at, term(s, at)).otherwise(F.lit(0.0)))
    done = F.transform("_ks", lambda at: F.struct(at.alias(k), fold(at).alias(value)))
    partial = pairs.select(*keys, F.inline(done))
    zero = cut.select(*keys, k, F.lit(0.0).alias(value))
    return partial.unionByName(zero).groupBy(*keys, k).agg(F.sum(value).alias(value))
