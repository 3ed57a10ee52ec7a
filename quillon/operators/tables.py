"""Tabulated functions of one and two variables: lookup, construction, inversion, merge, split.

Points are rows: (fn_id, x, y) or (fn_id, x, y, v).  Lookups are equi-joins on a function's key and a bin
number, so the planner may hash, sort-merge or broadcast by size; nothing is a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINEAR, LOGARITHMIC = "LINEAR", "LOGARITHMIC"
#: Points of two-variable tables that come to the driver and go to all tasks; more meet their places by joins.
FEW_POINTS = 100_000


def forward(x: Column, mode: str) -> Column:
    """The axis transform; null where a logarithm has no value."""
    return x if mode == LINEAR else F.log(F.when(x > 0, x))


def inverse(t: Column, mode: str) -> Column:
    return t if mode == LINEAR else F.exp(t)


def _lerp(y1: Column | np.ndarray, y2: Column | np.ndarray, t: Column | np.ndarray) -> Column | np.ndarray:
    return y1 * (1.0 - t) + y2 * t


def curves(points: DataFrame, keys: Sequence[str], x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(bounds by key, segments by key and bin) of piecewise linear curves.

    Bounds carry both ends, the lines through the first and the last two points, and the bin width; a
    segment is listed under every bin it overlaps, at most twice as many rows as points in all.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    numbered = points.select(*keys, F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1")).withColumn("x2", F.lead("x1").over(w.orderBy("x1"))).withColumn("y2", F.lead("y1").over(w.orderBy("x1")))
    ends = F.struct("x1", "y1", "x2", "y2")
    bounds = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x1").alias("lo"),
        F.max("x1").alias("hi"),
        F.min_by("y1", "x1").alias("y_lo"),
        F.max_by("y1", "x1").alias("y_hi"),
        F.min_by(ends, "x1").alias("first"),
        F.max_by(ends, F.when(F.col("x2").isNotNull(), F.col("x1"))).alias("last"),
    ).withColumn("width", F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1)))
    spread = numbered.where("x2 is not null").join(bounds.select(*keys, "lo", "width", "n"), [*keys])
    spread = spread.withColumn("bin", F.explode(F.sequence(bin_of(F.col("x1"), F.col("lo"), F.col("width"), F.col("n")), bin_of(F.col("x2"), F.col("lo"), F.col("width"), F.col("n")))))
    return bounds, spread.select(*keys, "bin", "x1", "y1", "x2", "y2")


def bin_of(x: Column, lo: Column, width: Column, n: Column) -> Column:
    """The bin of a place inside the bounds; places outside have the nearest."""
    t = F.when(width > 0, (x - lo) / F.when(width > 0, width)).otherwise(F.lit(0.0))
    safe = F.when(t.isNull() | F.isnan(t), F.lit(0.0)).otherwise(F.least(F.greatest(t, F.lit(0.0)), (n - 1).cast("double")))
    return F.floor(safe).cast("long")


def evaluate(queries: DataFrame, points: DataFrame, *, keys: Sequence[str] = ("fn_id",), at: str = "x", x: str = "x", y: str = "y", out: str = "value", clamp: bool = False) -> DataFrame:
    """``queries`` with the value of their function at ``at``: linear between neighbours.

    Beyond the ends a clamped function keeps its end value; others go on along the line through the two
    end points.  One point is a constant.  A function without points, a null or a NaN place give null.
    """
    bounds, segments = curves(points, keys, x, y)
    b = bounds.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("n", "lo", "hi", "y_lo", "y_hi", "first", "last", "width")))
    q = queries.withColumn("__at", F.col(at).cast("double")).join(b, [*keys], "left")
    q = q.withColumn("__bin", bin_of(F.col("__at"), F.col("__lo"), F.col("__width"), F.col("__n")))
    s = segments.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("bin").alias("__sbin"), *(F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")))
    on = F.col("__bin") == F.col("__sbin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    met = q.join(s, on & (F.col("__at") > F.col("__lo")) & (F.col("__at") < F.col("__hi")) & (F.col("__at") >= F.col("__x1")) & (F.col("__at") < F.col("__x2")), "left")

    def line(end: str) -> Column:
        e = F.col(end)
        return _lerp(e["y1"], e["y2"], (F.col("__at") - e["x1"]) / (e["x2"] - e["x1"]))

    low = F.col("__y_lo") if clamp else F.when(F.col("__n") > 1, line("__first")).otherwise(F.col("__y_lo"))
    high = F.col("__y_hi") if clamp else F.when(F.col("__n") > 1, line("__last")).otherwise(F.col("__y_hi"))
    inside = _lerp(F.col("__y1"), F.col("__y2"), (F.col("__at") - F.col("__x1")) / (F.col("__x2") - F.col("__x1")))
    value = F.when(F.isnan("__at") | F.col("__n").isNull(), None).when(F.col("__at") == F.col("__lo"), F.col("__y_lo")).when(F.col("__at") == F.col("__hi"), F.col("__y_hi")).when(F.col("__at") < F.col("__lo"), low).when(F.col("__at") > F.col("__hi"), high).otherwise(inside)
    return met.select(*queries.columns, value.alias(out))


def evaluate_1d(queries: DataFrame, points: DataFrame, *, step: float, mode: str = LINEAR, clamp: bool = False, interp: str = "auto", keys: Sequence[str] = ("fn_id",), at: str = "x", out: str = "value") -> DataFrame:
    """One-dimensional lookup with a grid step.

    ``auto``: where both grid keys ``inverse(k * step)`` around a place exist exactly, interpolation is
    linear in the transformed axis between them (points between are passed over); elsewhere, and with
    ``raw``, linear in x between the nearest points.
    """
    raw = evaluate(queries, points, keys=keys, at=at, out="__raw", clamp=clamp)
    if interp == "raw":
        return raw.withColumnRenamed("__raw", out)
    k = F.round(forward(F.col("x"), mode) / step).cast("long")
    grid = points.select(*keys, F.col("x").alias("__gx"), F.col("y").alias("__gy"), k.alias("__k")).where(inverse(F.col("__k") * step, mode) == F.col("__gx"))
    after = grid.select(*keys, (F.col("__k") - 1).alias("__k"), F.col("__gy").alias("__gy2"))
    cells = grid.join(after, [*keys, "__k"]).select(*keys, "__k", "__gy", "__gy2")
    ends = points.groupBy(*keys).agg(F.min("x").alias("__min"), F.max("x").alias("__max"))
    place = forward(F.col(at).cast("double"), mode) / step
    safe = F.when(place.isNull() | F.isnan(place) | (F.abs(place) > 1e15), None).otherwise(place)
    met = raw.join(ends, [*keys], "left").withColumn("__p", safe).withColumn("__k", F.floor("__p").cast("long")).join(cells, [*keys, "__k"], "left")
    on_grid = F.col("__gy").isNotNull() & (F.col(at) > F.col("__min")) & (F.col(at) < F.col("__max"))
    value = F.when(on_grid, _lerp(F.col("__gy"), F.col("__gy2"), F.col("__p") - F.col("__k"))).otherwise(F.col("__raw"))
    return met.select(*queries.columns, value.alias(out))


def evaluate_2d(queries: DataFrame, points: DataFrame, *, keys: Sequence[str] = ("fn_id",), at_x: str = "x", at_y: str = "y", out: str = "value", clamp: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """Two-dimensional lookup over ragged rows: the rows around x, each read at y, then linear in x.

    x beyond the first or last row takes that row, clamped or not; y beyond a row's ends is clamped or goes
    on along the line through its two end points.  ``rows`` (keys, x) adds rows without cells, at which a
    lookup is null.  Grid steps and axis modes play no part.

    At most ``FEW_POINTS`` distinct points, all of them numbers, are computed once and read in memory by Arrow
    batches, so that no place is shuffled; others meet the places by joins.
    """
    held = None if rows is not None else points.select(*keys, *(F.col(c).cast("double").alias(f"__{c}") for c in "xyv")).limit(FEW_POINTS + 1).toArrow()
    grids = None if held is None or held.num_rows > FEW_POINTS else _grids(held, len(keys))
    if grids is not None:
        place = _place(grids, clamp)
        return queries.select(*queries.columns, place(*(F.col(k) for k in keys), F.col(at_x).cast("double"), F.col(at_y).cast("double")).alias(out))
    axis = points.select(*keys, "x").distinct()
    if rows is not None:
        axis = axis.unionByName(rows.select(*keys, "x")).distinct()
    axis = axis.withColumn("row_at", F.col("x").cast("double"))
    # the brackets of x are a curve whose values are the rows themselves
    bounds, segments = curves(axis, keys, "x", "row_at")
    b = bounds.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("n", "lo", "hi", "width")))
    s = segments.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("bin").alias("__sbin"), F.col("x1").alias("__x1"), F.col("x2").alias("__x2"))
    q = queries.withColumn("__id", F.monotonically_increasing_id()).join(b, [*keys], "left")
    q = q.withColumn("__x", F.least(F.greatest(F.col(at_x).cast("double"), F.col("__lo")), F.col("__hi"))).withColumn("__bin", bin_of(F.col("__x"), F.col("__lo"), F.col("__width"), F.col("__n")))
    on = F.col("__bin") == F.col("__sbin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    met = q.join(s, on & (F.col("__x") >= F.col("__x1")) & (F.col("__x") < F.col("__x2")), "left")
    met = met.withColumn("__r1", F.coalesce("__x1", "__x")).withColumn("__r2", F.when(F.col("__x") == F.col("__r1"), F.col("__r1")).otherwise(F.coalesce("__x2", "__x")))
    met = met.select(*queries.columns, "__x", "__r1", "__r2")
    cells = points.select(*keys, F.col("x").cast("double").alias("__row"), F.col("y").cast("double").alias("__y"), F.col("v").cast("double").alias("__v"))
    for n in (1, 2):
        met = met.withColumn("__row", F.col(f"__r{n}"))
        met = evaluate(met, cells, keys=[*keys, "__row"], at=at_y, x="__y", y="__v", out=f"__v{n}", clamp=clamp).drop("__row")
    t = F.when(F.col("__r2") > F.col("__r1"), (F.col("__x") - F.col("__r1")) / F.when(F.col("__r2") > F.col("__r1"), F.col("__r2") - F.col("__r1"))).otherwise(F.lit(0.0))
    value = F.when(F.isnan(F.col(at_x).cast("double")), None).when(F.col("__r1") == F.col("__r2"), F.col("__v1")).otherwise(_lerp(F.col("__v1"), F.col("__v2"), t))
    return met.select(*queries.columns, value.alias(out))


def _grids(held: pa.Table, n: int) -> dict[tuple, tuple[np.ndarray, ...]] | None:
    """Rows, where their cells begin (and the last ends), y and v by the first ``n`` columns; None for cells without a number or two in one place."""
    x, y, v = (held.column(n + k).to_numpy() for k in range(3))
    if any(c.null_count for c in held.columns[n:]) or np.isnan(np.concatenate([x, y, v])).any():
        return None
    x, y = x + 0.0, y + 0.0  # one zero
    owners: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(*(held.column(k).to_pylist() for k in range(n)), strict=True) if n else [()] * held.num_rows):
        owners.setdefault(key, []).append(k)
    out = {}
    for key, own in owners.items():
        if any(k is None or k != k for k in key):
            return None
        order = np.array(own)[np.lexsort((y[own], x[own]))]
        gx, gy = x[order], y[order]
        if ((gx[1:] == gx[:-1]) & (gy[1:] == gy[:-1])).any():
            return None
        at, start = np.unique(gx, return_index=True)
        out[key] = at, np.append(start, len(gx)), gy, v[order]
    return out


def _along(y: np.ndarray, v: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, clamp: bool) -> np.ndarray:
    """Values of the rows ``start`` to ``end`` at places, by the rules of ``evaluate``."""
    low, high = start, end
    while (wide := high - low > 1).any():
        middle = (low + high) // 2
        right = wide & (y[middle] <= at)
        low, high = np.where(right, middle, low), np.where(wide & ~right, middle, high)
    one, last = np.maximum(np.minimum(low, end - 2), start), end - 1
    two = np.minimum(one + 1, last)
    value = _lerp(v[one], v[two], (at - y[one]) / (y[two] - y[one]))
    first_end, last_end = (at <= y[start], at >= y[last]) if clamp else (at == y[start], at == y[last])
    alone = start == last
    return np.where(first_end | alone, v[start], np.where(last_end, v[last], value))


def _place(grids: dict[tuple, tuple[np.ndarray, ...]], clamp: bool) -> Callable[..., Column]:
    def read(grid: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rows, start, ys, vs = grid
        x = np.minimum(np.maximum(x, rows[0]), rows[-1])
        one = np.clip(np.searchsorted(rows, x, side="right") - 1, 0, len(rows) - 1)
        two = np.where(x > rows[one], np.minimum(one + 1, len(rows) - 1), one)
        a = _along(ys, vs, start[one], start[one + 1], y, clamp)
        b = _along(ys, vs, start[two], start[two + 1], y, clamp)
        return np.where(one == two, a, _lerp(a, b, (x - rows[one]) / (rows[two] - rows[one])))

    @F.arrow_udf("double")
    def place(*columns: pa.Array) -> pa.Array:
        *given, x, y = columns
        with np.errstate(all="ignore"):
            # a null x takes the first row, as the least of numbers
            none = y.is_null().to_numpy(zero_copy_only=False)
            x, y = x.fill_null(-np.inf).to_numpy(), y.fill_null(np.nan).to_numpy()
            none = none | np.isnan(x) | np.isnan(y)
            out = np.full(len(x), np.nan)
            codes = [c.dictionary_encode() for c in given]
            if all(len(c.dictionary) == 1 and not c.null_count for c in codes):
                shares = [(tuple(c.dictionary[0].as_py() for c in codes), slice(None))]
            else:
                names, which = np.unique(np.column_stack([c.indices.fill_null(-1).to_numpy() for c in codes]), axis=0, return_inverse=True)
                shares = [(tuple(None if k < 0 else c.dictionary[int(k)].as_py() for c, k in zip(codes, name, strict=True)), np.flatnonzero(which.ravel() == n)) for n, name in enumerate(names)]
            for key, here in shares:
                if key in grids:
                    out[here] = read(grids[key], x[here], y[here])
                else:
                    none[here] = True
        return pa.array(out, mask=none)

    return place


# ---- construction ---------------------------------------------------------------------------------------


def grid_keys(low: float, high: float, step: float, mode: str = LINEAR, *, float32: bool = False) -> list[float]:
    """Axis keys from ``low`` to below ``high``, each made from the one before; rounding adds up on purpose."""
    if mode == LOGARITHMIC and low <= 0:
        raise ValueError("a logarithmic axis begins above 0")
    kind = np.float32 if float32 else np.float64
    fwd, inv = (np.log, np.exp) if mode == LOGARITHMIC else (kind, kind)
    out, x = [], kind(low)
    while x < kind(high):
        out.append(float(x))
        x = kind(inv(kind(fwd(x)) + kind(step)))
    return out


def populate_1d(spark: SparkSession, fn_id: str, f: Callable[[Column], Column], low: float, high: float, step: float, mode: str = LINEAR, **options) -> DataFrame:
    """(fn_id, x, y) on the keys of ``grid_keys``; points at which ``f`` is null or NaN are left out."""
    axis = spark.createDataFrame([(x,) for x in grid_keys(low, high, step, mode, **options)], "x double")
    made = axis.select(F.lit(fn_id).alias("fn_id"), "x", f(F.col("x")).cast("double").alias("y"))
    return made.where(F.col("y").isNotNull() & ~F.isnan("y"))


def axis_points(spark: SparkSession, start: float, end: float, n: int, mode: str = LINEAR) -> DataFrame:
    """(i, t) of ``n`` places from start to end, both included, evenly apart in the transformed axis."""
    fwd = (lambda v: v) if mode == LINEAR else np.log
    step = (fwd(end) - fwd(start)) / (n - 1) if n > 1 else 0.0
    place = F.lit(float(fwd(start))) + F.col("id") * F.lit(float(step))
    return spark.range(n).select(F.col("id").cast("int").alias("i"), inverse(place, mode).alias("t"))


def populate_2d(spark: SparkSession, fn_id: str, f: Callable[[Column, Column], Column], xs: tuple[float, float, int], ys: tuple[float, float, int], x_mode: str = LINEAR, y_mode: str = LINEAR) -> tuple[DataFrame, DataFrame]:
    """(points, rows): all cells of the grid at which ``f`` is a number, and its rows, the empty ones too.

    Each row is exploded over the y axis (an array of stated length), so no join makes the grid.
    """
    fwd = (lambda v: v) if y_mode == LINEAR else np.log
    step = (fwd(ys[1]) - fwd(ys[0])) / (ys[2] - 1) if ys[2] > 1 else 0.0
    rows = axis_points(spark, *xs, x_mode).select(F.lit(fn_id).alias("fn_id"), F.col("t").alias("x"))
    places = F.transform(F.sequence(F.lit(0), F.lit(ys[2] - 1)), lambda k: inverse(F.lit(float(fwd(ys[0]))) + k * F.lit(float(step)), y_mode))
    cells = rows.select("fn_id", "x", F.explode(places).alias("y")).withColumn("v", f(F.col("x"), F.col("y")).cast("double"))
    return cells.where(F.col("v").isNotNull() & ~F.isnan("v")), rows


def invert(points: DataFrame, *, step: float, mode: str = LINEAR) -> DataFrame:
    """(fn_id, x, y) of the inverse functions: even steps of forward(y) from the first value to below the last.

    Each target takes the first pair of neighbours around it (by equi-join on a bin, then the least x);
    flat pairs are passed over.  A function that falls from first to last has an empty inverse.
    """
    t = points.select("fn_id", F.col("x").cast("double").alias("x1"), forward(F.col("y").cast("double"), mode).alias("t1"))
    w = Window.partitionBy("fn_id").orderBy("x1")
    pairs = t.withColumn("x2", F.lead("x1").over(w)).withColumn("t2", F.lead("t1").over(w)).where("x2 is not null and t2 > t1")
    ends = t.groupBy("fn_id").agg(F.min_by("t1", "x1").alias("start"), F.max_by("t1", "x1").alias("end"))
    ends = ends.withColumn("steps", F.when(F.col("end") > F.col("start"), F.floor((F.col("end") - F.col("start")) / step)).otherwise(F.lit(0)).cast("int"))
    targets = ends.where("steps > 0").select("fn_id", "start", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("i")).select("fn_id", "i", (F.col("start") + F.col("i") * step).alias("t"))
    low = F.ceil((F.col("t1") - F.col("start")) / step - 1e-9).cast("int")
    high = F.floor((F.col("t2") - F.col("start")) / step + 1e-9).cast("int")
    spread = pairs.join(ends, "fn_id").withColumn("low", F.greatest(low, F.lit(0))).withColumn("high", F.least(high, F.col("steps") - 1)).where("low <= high")
    spread = spread.select("fn_id", F.explode(F.sequence("low", "high")).alias("i"), "x1", "t1", "x2", "t2")
    met = targets.join(spread, ["fn_id", "i"]).where("t1 <= t and t <= t2").groupBy("fn_id", "i", "t").agg(F.min_by(F.struct("x1", "t1", "x2", "t2"), "x1").alias("p"))
    s = (F.col("t") - F.col("p.t1")) / (F.col("p.t2") - F.col("p.t1"))
    return met.select("fn_id", inverse(F.col("t"), mode).alias("x"), _lerp(F.col("p.x1"), F.col("p.x2"), s).alias("y"))


def merge(mine: DataFrame, other: DataFrame, *, keys: Sequence[str] = ("fn_id", "x", "y"), value: str = "v", overwrite: bool = True) -> DataFrame:
    """Cells of both tables; where both have one, the other's with ``overwrite``, else mine."""
    a, b = mine.select(*keys, F.col(value).alias("__a")), other.select(*keys, F.col(value).alias("__b"))
    first, second = ("__b", "__a") if overwrite else ("__a", "__b")
    return a.join(b, [*keys], "full").select(*keys, F.coalesce(first, second).alias(value))


def split(points: DataFrame, most: int, *, key: str = "fn_id", x: str = "x") -> DataFrame:
    """``points`` with ``chunk_id``: whole rows in order of x; a chunk closes once it has ``most`` cells or more.

    The greedy rule is a fold over the row sizes of each table, which are few and small beside its cells.
    """
    sizes = points.groupBy(key, x).agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col("n").alias("n")))).alias("rows"))
    first = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("ids"))

    def step(s: Column, r: Column) -> Column:
        full = s["held"] + r["n"] >= most
        return F.struct((s["chunk"] + F.when(full, 1).otherwise(0)).alias("chunk"), F.when(full, F.lit(0).cast("long")).otherwise(s["held"] + r["n"]).alias("held"), F.concat(s["ids"], F.array(s["chunk"])).alias("ids"))

    ids = F.aggregate("rows", first, step, lambda s: s["ids"])
    placed = ordered.select(key, F.explode(F.arrays_zip(F.col("rows").alias("r"), ids.alias("c"))).alias("z")).select(key, F.col("z.r.x").alias(x), F.col("z.c").alias("chunk_id"))
    return points.join(placed, [key, x])


def clear(points: DataFrame) -> DataFrame:
    return points.limit(0)
