"""Preparation of plot series: extents, pixels, ticks, labels and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.units import axis_number


def extents(series: DataFrame, by: tuple[str, ...] = ("plot_id",)) -> DataFrame:
    """(x_min, x_max, y_min, y_max) over all series of a plot; NaN is passed over axis by axis."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    return series.groupBy(*by).agg(F.min(number("x")).alias("x_min"), F.max(number("x")).alias("x_max"), F.min(number("y")).alias("y_min"), F.max(number("y")).alias("y_max"))


def normalized(value: Column, low: Column, high: Column, log: bool = False) -> Column:
    if log:
        value, low, high = (F.log10(F.when(v > 0, v)) for v in (value, low, high))
    return (value - low) / F.when(high != low, high - low)


def pixels(series: DataFrame, bounds: DataFrame, *, width: int = 800, height: int = 600, margin: int = 50, x_log: bool = False, y_log: bool = False, by: tuple[str, ...] = ("plot_id",)) -> DataFrame:
    """``series`` with px and py, y growing upward; points with a NaN go."""
    met = series.where(~F.isnan("x") & ~F.isnan("y")).join(bounds, [*by])
    px = F.lit(margin) + (F.lit(float(width - 2 * margin)) * normalized(F.col("x"), F.col("x_min"), F.col("x_max"), x_log)).cast("int")
    py = F.lit(height - margin) - (F.lit(float(height - 2 * margin)) * normalized(F.col("y"), F.col("y_min"), F.col("y_max"), y_log)).cast("int")
    return met.select(*series.columns, px.alias("px"), py.alias("py"))


def ticks(bounds: DataFrame, low: str, high: str, *, n: int = 10, log: bool = False) -> DataFrame:
    """``bounds`` with n + 1 rows each: tick, value and label, evenly apart on the axis."""
    a, b = F.col(low), F.col(high)
    t = bounds.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(n))))
    if log:
        la, lb = F.log10(F.when(a > 0, a)), F.log10(F.when(b > 0, b))
        value = F.pow(F.lit(10.0), la + F.col("tick") * (lb - la) / float(n))
    else:
        value = a + F.col("tick") * (b - a) / float(n)
    return t.withColumn("value", value).withColumn("label", axis_number(F.col("value")))


def colors(seed: Column) -> list[Column]:
    """(red, green, blue) from a number, the same each time."""
    def part(wave: Column) -> Column:
        return F.abs((wave * 10000.0 % 255.0).cast("int"))

    return [part(F.sin(seed + 1)).alias("red"), part(F.cos(seed + 2)).alias("green"), part(F.sin(seed + 3)).alias("blue")]


def heatmap(cells: DataFrame, *, scale: int = 4, by: str = "plot_id") -> DataFrame:
    """(plot_id, u, v, level) of a grid (plot_id, i, j, value): Catmull-Rom bicubic samples, ``scale`` a cell side.

    Sixteen neighbours with indices kept inside the grid meet each sample through one equi-join; levels
    run from 0 to 1 after 5 % of the range is trimmed at both ends, with a square-root gamma.
    """
    box = cells.groupBy(by).agg(F.max("i").alias("ni"), F.max("j").alias("nj"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = box.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("ni") * scale))).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("nj") * scale)))

    def weight(t: Column, k: Column) -> Column:
        a, b, c, d = -0.5 * t + t * t - 0.5 * t**3, 1 - 2.5 * t * t + 1.5 * t**3, 0.5 * t + 2 * t * t - 1.5 * t**3, -0.5 * t * t + 0.5 * t**3
        return F.when(k == -1, a).when(k == 0, b).when(k == 1, c).otherwise(d)

    steps = F.sequence(F.lit(-1), F.lit(2))
    near = at.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    fu, fv = F.col("u") / float(scale), F.col("v") / float(scale)
    near = near.withColumn("w", weight(fu - F.floor(fu), F.col("a")) * weight(fv - F.floor(fv), F.col("b")))
    inside = lambda base, k, top: F.least(F.greatest(F.floor(base) + k, F.lit(0)), top).cast("int")
    near = near.withColumn("i", inside(fu, F.col("a"), F.col("ni"))).withColumn("j", inside(fv, F.col("b"), F.col("nj")))
    met = near.join(cells.select(by, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value"), [by, "i", "j"]).groupBy(by, "u", "v").agg(F.sum(F.col("w") * F.col("value")).alias("z"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    span = F.col("hi") - F.col("lo")
    low, wide = F.col("lo") + 0.05 * span, 0.9 * span
    level = F.when(wide > 0, F.least(F.greatest((F.col("z") - low) / F.when(wide > 0, wide), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return met.select(by, "u", "v", F.sqrt(level).alias("level"))
