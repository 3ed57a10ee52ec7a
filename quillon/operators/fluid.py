"""Real-fluid state changes from property tables.

Tables are two-variable point tables with fn_id ``hp_t``, ``hp_s``, ``hp_x`` (x = enthalpy, y = pressure) and
``sp_h`` (x = entropy, y = pressure).  States: temperature, pressure, specific_enthalpy, vapor_quality.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.tables import evaluate_2d

# What a property is where its table is missing.
DEFAULTS = {"hp_s": 1000.0, "sp_h": 112665.0, "hp_t": 300.0, "hp_x": 0.0}
STATE = ("temperature", "pressure", "specific_enthalpy", "vapor_quality")


def clamped(t: Column, p: Column, h: Column, x: Column) -> list[Column]:
    """The columns of a state: no negative temperature or pressure, quality within 0 and 1; NaN stays."""
    floor = lambda v: F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(0.0)))
    return [floor(t).alias("temperature"), floor(p).alias("pressure"), h.alias("specific_enthalpy"), F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).alias("vapor_quality")]


def encoded() -> Column:
    """A state's columns as one JSON text of four named numbers; nulls are left out."""
    return F.to_json(F.struct(*STATE))


def decoded(text: Column) -> list[Column]:
    """The columns of a state kept as JSON: numbers that are missing are 0, the others are clamped.

    A null text, or one that is no JSON object of numbers, gives nulls.
    """
    read = F.from_json(text, ", ".join(f"{c} double" for c in STATE) + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    good = read.isNotNull() & read["_corrupt_record"].isNull()
    state = clamped(*(F.coalesce(read[c], F.lit(0.0)) for c in STATE))
    return [F.when(good, v).alias(c) for c, v in zip(STATE, state, strict=True)]


def prop(queries: DataFrame, tables: DataFrame, fn_id: str, a: str, b: str, out: str, *, clamp: bool = True) -> DataFrame:
    """``queries`` with a property at (a, b); the default where the table has no points."""
    loaded = tables.where(F.col("fn_id") == fn_id)
    met = evaluate_2d(queries.withColumn("fn_id", F.lit(fn_id)), loaded, at_x=a, at_y=b, out=out, clamp=clamp)
    return met.withColumn(out, F.coalesce(out, F.lit(DEFAULTS[fn_id]))).drop("fn_id")


def isobaric(states: DataFrame, tables: DataFrame, q: Column) -> DataFrame:
    """``states`` after heat ``q`` at constant pressure; no heat leaves a state as it is."""
    keep = [c for c in states.columns if c not in STATE]
    moved = states.withColumn("__q", q).withColumn("__h", F.col("specific_enthalpy") + F.col("__q"))
    moved = prop(prop(moved, tables, "hp_t", "__h", "pressure", "__t"), tables, "hp_x", "__h", "pressure", "__x")
    new = clamped(F.col("__t"), F.col("pressure"), F.col("__h"), F.col("__x"))
    return moved.select(*keep, *(F.when(F.col("__q") == 0, F.col(c)).otherwise(v).alias(c) for c, v in zip(STATE, new, strict=True)))


def mix(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Mixtures of (m1, h1, p1, t1, x1) and (m2, h2, p2, t2, x2), weighted by mass.

    A zero amount gives the other state as it is; a NaN or too hot input gives the default state.
    """
    keep = [c for c in pairs.columns if c not in {f"{k}{n}" for k in "mhptx" for n in "12"}]
    total = F.col("m1") + F.col("m2")
    mean = lambda k: (F.col(f"{k}1") * F.col("m1") + F.col(f"{k}2") * F.col("m2")) / F.when(total != 0, total)
    met = pairs.withColumn("__h", mean("h")).withColumn("__p", mean("p"))
    met = prop(prop(met, tables, "hp_t", "__h", "__p", "__t"), tables, "hp_x", "__h", "__p", "__x")
    bad = F.isnan("t1") | F.isnan("t2") | (F.col("t1") > 20000) | (F.col("t2") > 20000)
    fallback = clamped(F.lit(300.0), F.lit(101300.0), F.lit(DEFAULTS["sp_h"]), F.lit(0.0))
    new = clamped(F.col("__t"), F.col("__p"), F.col("__h"), F.col("__x"))
    second, first = (clamped(F.col(f"t{n}"), F.col(f"p{n}"), F.col(f"h{n}"), F.col(f"x{n}")) for n in "21")
    return met.select(*keep, *(F.when(F.col("m1") == 0, s).when(F.col("m2") == 0, f).when(bad, d).otherwise(v).alias(c) for c, s, f, d, v in zip(STATE, second, first, fallback, new, strict=True)))


class _Grid:
    """A ragged point table in memory, read at arrays of places with the rules of ``evaluate_2d``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, v: np.ndarray) -> None:
        order = np.lexsort((y, x))
        x, self.y, self.v = x[order], y[order], v[order]
        self.rows, self.start = np.unique(x, return_index=True)
        self.end = np.append(self.start[1:], len(x))

    def _row(self, r: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(len(y), np.nan)
        for k in np.unique(r):
            here = r == k
            out[here] = np.interp(y[here], self.y[self.start[k] : self.end[k]], self.v[self.start[k] : self.end[k]])
        return out

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.rows[0], self.rows[-1])
        hi = np.clip(np.searchsorted(self.rows, x), 0, len(self.rows) - 1)
        lo = np.where(self.rows[hi] == x, hi, np.maximum(hi - 1, 0))
        wide = self.rows[hi] - self.rows[lo]
        t = np.where(wide > 0, (x - self.rows[lo]) / np.where(wide > 0, wide, 1.0), 0.0)
        return self._row(lo, y) * (1 - t) + self._row(hi, y) * t


def isentropic(states: DataFrame, tables: DataFrame, factor: Column, *, compress: bool = False, max_points: int = 2_000_000, compat_quality_arg: bool = False) -> DataFrame:
    """``states`` after an isentropic change to pressure / factor, or pressure * factor with ``compress``.

    Newton steps (20 at most) on entropy at the new pressure, over whole Arrow batches.  The tables are
    broadcast once their points are counted to be within ``max_points``; larger ones raise.
    ``compat_quality_arg`` reads the quality at (h, T) instead of (h, p).
    """
    points = tables.where(F.col("fn_id").isin(*DEFAULTS)).select("fn_id", "x", "y", "v")
    if points.count() > max_points:
        raise ValueError(f"property tables have more than {max_points} points")
    frame = points.toPandas()
    grids = {k: _Grid(*(g[c].to_numpy(float) for c in ("x", "y", "v"))) for k, g in frame.groupby("fn_id")}
    shipped = states.sparkSession.sparkContext.broadcast(grids)

    @F.pandas_udf("struct<temperature double, pressure double, specific_enthalpy double, vapor_quality double>")
    def run(h1: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
        def read(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return shipped.value[name].at(x, y) if name in shipped.value else np.full(len(x), DEFAULTS[name])

        h0, a, b = (s.to_numpy(float) for s in (h1, p1, p2))
        s = read("hp_s", h0, a)
        h, eps = read("sp_h", s, b), 1e-4 * a
        live = np.ones(len(h), dtype=bool)
        for _ in range(20):
            f = read("hp_s", h, b) - s
            live &= ~(np.abs(f) < 0.1)
            slope = (read("hp_s", h + eps, b) - read("hp_s", h, b)) / np.where(eps != 0, eps, 1.0)
            live &= ~(np.abs(slope) < 1e-8)
            if not live.any():
                break
            h = np.where(live, h - f / np.where(live, slope, 1.0), h)
        t = read("hp_t", h, b)
        x = read("hp_x", h, t if compat_quality_arg else b)
        return pd.DataFrame({"temperature": np.maximum(t, 0), "pressure": np.maximum(b, 0), "specific_enthalpy": h, "vapor_quality": np.clip(x, 0, 1)})

    keep = [c for c in states.columns if c not in STATE]
    goal = F.col("pressure") * factor if compress else F.col("pressure") / factor
    return states.withColumn("__n", run("specific_enthalpy", "pressure", goal)).select(*keep, *(F.col(f"__n.{c}").alias(c) for c in STATE))


def isentropes(entropies: DataFrame, tables: DataFrame, p_min: float, p_max: float, ratio: float = 1.01) -> DataFrame:
    """(s, p, h, t) along lines of equal entropy: pressures grow by ``ratio`` while within ``p_max``."""
    n = int(np.floor(np.log(p_max / p_min) / np.log(ratio) + 1e-9))
    swept = entropies.select("s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(p_min) * F.pow(F.lit(ratio), k.cast("double")))).alias("p"))
    met = evaluate_2d(swept.withColumn("fn_id", F.lit("sp_h")), tables.where("fn_id = 'sp_h'"), at_x="s", at_y="p", out="h", clamp=True).drop("fn_id")
    met = prop(met, tables, "hp_t", "h", "p", "t")
    return met.where("h is not null and t is not null and not isnan(h) and not isnan(t)")
