"""Random draws a row: closed forms in the JVM from a seed or a given uniform column, the rest vectorised.

Algorithms are chosen by parameter range.  Draws with a seed repeat for the same plan and partitions;
those from a uniform column are functions of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(mean: Column | float, std: Column | float, seed: int) -> Column:
    return F.randn(seed) * std + mean


def exponential(rate: Column | float, u: Column) -> Column:
    """-ln(1 - u) / rate for u in [0, 1)."""
    return -F.log(F.lit(1.0) - u) / rate


def geometric(p: Column | float, u: Column) -> Column:
    """Failures before the first success: floor(ln u / ln(1 - p)) for u in (0, 1)."""
    q = F.lit(1.0) - (F.lit(p) if isinstance(p, float) else p)
    return F.floor(F.log(u) / F.log(q)).cast("long")


def poisson_inverse(rate: float, u: Column, most: int = 400) -> Column:
    """Inverse of the distribution function at u, for rates below 30, as a fold."""
    if not 0 <= rate < 30:
        raise ValueError("the inverse serves rates from 0 to below 30")

    def step(s: Column, _: Column) -> Column:
        on = u > s["s"]
        p = F.when(on, s["p"] * rate / (s["x"] + 1.0)).otherwise(s["p"])
        return F.struct(p.alias("p"), F.when(on, s["s"] + p).otherwise(s["s"]).alias("s"), F.when(on, s["x"] + 1.0).otherwise(s["x"]).alias("x"))

    p0 = float(np.exp(-rate))
    first = F.struct(F.lit(p0).alias("p"), F.lit(p0).alias("s"), F.lit(0.0).alias("x"))
    # beyond this many terms a double holds no more of the sum
    terms = min(most, int(rate + 12 * np.sqrt(rate + 1) + 40))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, step, lambda s: s["x"]).cast("long")


def _drawn(draw, seed: int, kind: str, *columns: Column) -> Column:
    """One vectorised draw a row; each batch's generator is seeded by the rows it holds."""
    @F.pandas_udf(kind)
    def run(key: pd.Series, *given: pd.Series) -> pd.Series:
        rng = np.random.default_rng([seed, int(pd.util.hash_array(key.to_numpy()).sum() & np.uint64((1 << 63) - 1))])
        return pd.Series(draw(rng, *(g.to_numpy(float) for g in given)))

    key, *rest = columns
    return run(key, *rest)


def poisson(key: Column, rate: Column, seed: int) -> Column:
    """Below 30 by inversion, below 700 by products of uniforms, beyond by rescaled products."""
    def draw(rng: np.random.Generator, lam: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lam), dtype=np.int64)
        low = np.flatnonzero(lam < 30)
        if len(low):
            p = np.exp(-lam[low])
            s, u, x = p.copy(), rng.random(len(low)), np.zeros(len(low))
            live = u > s
            while live.any():
                x[live] += 1
                p[live] *= lam[low][live] / x[live]
                s[live] += p[live]
                live &= (u > s) & (p > 0)
            out[low] = x
        high = np.flatnonzero(lam >= 30)
        if len(high):
            left = lam[high].copy()  # sums of logarithms serve both product forms without underflow
            k, total, live = np.zeros(len(high), np.int64), np.zeros(len(high)), np.ones(len(high), bool)
            while live.any():
                total[live] += np.log(1.0 - rng.random(int(live.sum())))
                k[live] += 1
                live &= total > -left
            out[high] = k - 1
        return out

    return _drawn(draw, seed, "long", key, rate)


def binomial(key: Column, n: Column, p: Column, seed: int, *, clamp: bool = False) -> Column:
    """Trials below 30, inversion for few successes, else a rounded normal, which may leave [0, n] unless clamped."""
    def draw(rng: np.random.Generator, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n))
        sure = (n > 0) & (p >= 1)
        out[sure] = n[sure]
        open_ = (n > 0) & (p > 0) & (p < 1)
        few = np.flatnonzero(open_ & (n < 30))
        for t in range(30):
            on = few[n[few] > t]
            out[on] += rng.random(len(on)) < p[on]
        inv = np.flatnonzero(open_ & (n >= 30) & (n * p < 30))
        if len(inv):
            q, m, pp = 1 - p[inv], n[inv], p[inv]
            prob = q**m
            s, u, x = prob.copy(), rng.random(len(inv)), np.zeros(len(inv))
            live = (u > s) & (x < m)
            while live.any():
                prob[live] *= (m[live] - x[live]) * pp[live] / ((x[live] + 1) * q[live])
                s[live] += prob[live]
                x[live] += 1
                live &= (u > s) & (x < m)
            out[inv] = x
        big = np.flatnonzero(open_ & (n >= 30) & (n * p >= 30))
        out[big] = np.floor(n[big] * p[big] + np.sqrt(n[big] * p[big] * (1 - p[big])) * rng.standard_normal(len(big)) + 0.5)
        return (np.clip(out, 0, np.maximum(n, 0)) if clamp else out).astype(np.int64)

    return _drawn(draw, seed, "long", key, n, p)


def _gamma(rng: np.random.Generator, shape: np.ndarray, rate: np.ndarray) -> np.ndarray:
    boost = np.where(shape < 1, rng.random(len(shape)) ** (1 / np.where(shape < 1, shape, 1.0)), 1.0)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, live = np.zeros(len(shape)), np.arange(len(shape))
    while len(live):
        x = rng.standard_normal(len(live))
        v = (1 + c[live] * x) ** 3
        ok = v > 0
        u = rng.random(len(live))
        ok[ok] &= np.log(u[ok]) < 0.5 * x[ok] ** 2 + d[live][ok] * (1 - v[ok] + np.log(v[ok]))
        out[live[ok]] = d[live[ok]] * v[ok]
        live = live[~ok]
    return out * boost / rate


def gamma(key: Column, shape: Column, rate: Column, seed: int) -> Column:
    """By squeezed rejection; shapes below 1 are boosted."""
    return _drawn(_gamma, seed, "double", key, shape, rate)


def beta(key: Column, alpha: Column, beta_: Column, seed: int) -> Column:
    def draw(rng: np.random.Generator, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = _gamma(rng, a, np.ones(len(a))), _gamma(rng, b, np.ones(len(b)))
        return x / (x + y)

    return _drawn(draw, seed, "double", key, alpha, beta_)
