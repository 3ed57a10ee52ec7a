"""Scalar equations over columns: bisection and descent as higher-order folds, cubics in closed form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Function = Callable[[Column], Column]


def _given(value: Column, then: Function) -> Column:
    """``then(value)`` with the value computed once, however often it stands in there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bisect(f: Function, low: Column, high: Column, eps: float, *, steps: int = 64, strict: bool = True) -> Column:
    """A root of ``f`` between two columns, halving while they are more than ``eps`` apart.

    Stays in the JVM: a fold over ``steps`` numbers (64 halvings exhaust a double), or over as many as the ends'
    distance takes to halve to ``eps``; a step computes ``f`` once.  Ends of equal sign, or NaN there, raise in strict
    mode and give null otherwise; a null there gives null.  A NaN in the middle moves toward the end whose value is a
    number, keeping the sign of the low end as it was.
    """
    state = lambda a, b, fa: F.struct(a.alias("a"), b.alias("b"), fa.alias("fa"))

    def moved(s: Column, m: Column, fm: Column) -> Column:
        left = state(s["a"], m, s["fa"])
        bad = F.when(F.isnan(f(s["a"])), state(m, s["b"], s["fa"])).otherwise(left)
        return F.when(fm.isNull(), s).when(F.isnan(fm), bad).when(fm == 0, state(m, m, s["fa"])).when(s["fa"] * fm > 0, state(m, s["b"], fm)).otherwise(left)

    def halve(s: Column, _: Column) -> Column:
        half = _given((s["a"] + s["b"]) / 2.0, lambda m: _given(f(m).cast("double"), lambda fm: moved(s, m, fm)))
        return F.when(F.abs(s["b"] - s["a"]) > F.lit(eps), half).otherwise(s)

    fa, fb = f(low), f(high)
    wrong = F.isnan(fa) | F.isnan(fb) | (fa * fb > 0)
    first = state(low.cast("double"), high.cast("double"), fa.cast("double"))
    # two more than the halvings: rounding may leave the distance just above
    many = F.lit(float(steps)) if eps <= 0 else F.greatest(F.lit(1.0), F.least(F.lit(float(steps)), F.ceil(F.log2(F.least(F.abs(high - low) / F.lit(float(eps)), F.lit(2.0**steps)))) + 2.0))
    found = F.aggregate(F.sequence(F.lit(1), many.cast("int")), first, halve, lambda s: (s["a"] + s["b"]) / 2.0)
    error = F.raise_error("bisect: no change of sign between the ends") if strict else F.lit(None)
    return F.when(fa.isNull() | fb.isNull(), None).when(wrong, error.cast("double")).otherwise(found)


def descend(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: Column, parameter: Column, step: float, dx: float, *, tolerance: float = 1e-6, most: int = 10_000) -> Column:
    """The minimum of ``f(x, parameter)`` that central-difference descent from ``start`` finds, or NaN.

    The step grows by 1.05 where it helps and shrinks to 0.9 where not; below 1e-6, or at a flat place,
    a row is done.  Whole Arrow batches are stepped at once with numpy; finished rows drop out.
    """
    @F.pandas_udf("double")
    def run(begin: pd.Series, given: pd.Series) -> pd.Series:
        x, p = begin.to_numpy(float).copy(), given.to_numpy(float)
        out = np.full(len(x), np.nan)
        rate, live = np.full(len(x), step), np.arange(len(x))
        for _ in range(most):
            if not len(live):
                break
            at, own = x[live], p[live]
            slope = (f(at + dx, own) - f(at - dx, own)) / (2 * dx)
            new = at - rate[live] * slope
            better = f(new, own) < f(at, own)
            x[live] = np.where(better, new, at)
            rate[live] *= np.where(better, 1.05, 0.9)
            done = (~better & (rate[live] < 1e-6)) | (np.abs(slope) < tolerance)
            out[live[done]] = x[live[done]]
            live = live[~done]
        return pd.Series(out)

    return run(start.cast("double"), parameter.cast("double"))


def cubic_roots(a: Column, b: Column, c: Column, d: Column) -> Column:
    """array(r0, r1, r2) of a x^3 + b x^2 + c x + d: one root and two NaN, or three in trigonometric order.

    A triple root gives three NaN; a leading 0 gives nulls.
    """
    b, c, d = (F.try_divide(v, a) for v in (b, c, d))
    q = (3.0 * c - b * b) / 9.0
    r = (9.0 * b * c - 27.0 * d - 2.0 * b * b * b) / 54.0
    disc = q * q * q + r * r
    root = F.sqrt(F.when(disc > 0, disc))
    one = -b / 3.0 + (F.cbrt(r + root) + F.cbrt(r - root))
    scale = F.sqrt(-q * q * q)
    theta = F.when(scale == 0, F.lit(float("nan"))).otherwise(F.acos(r / F.when(scale != 0, scale)))
    nan = F.lit(float("nan"))
    three = [2.0 * F.sqrt(-q) * F.cos((theta + k * 2.0 * F.pi()) / 3.0) - b / 3.0 for k in range(3)]
    return F.when(disc > 0, F.array(one, nan, nan)).otherwise(F.array(*three))
