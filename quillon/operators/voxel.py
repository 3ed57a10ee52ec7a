"""Structures of cells on a grid: (grid_id, x, y, z, kind, facing); facing points to a neighbour cell."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillon.operators.grouped import listed

# Unit steps of the six directions, in the order in which neighbours are visited.
STEPS = (("down", 0, -1, 0), ("up", 0, 1, 0), ("north", 0, 0, -1), ("south", 0, 0, 1), ("west", -1, 0, 0), ("east", 1, 0, 0))
OPPOSITE = {"down": "up", "up": "down", "north": "south", "south": "north", "west": "east", "east": "west"}
#: Pointers of the predefined shapes, as (dx, facing) along the first axis from the controller at 0.
SHAPES = {"3x1x1": ((-1, "east"), (1, "west")), "2x1x1": ((1, "west"),)}


#: Cells of walks and of what stands in their way that a task keeps.
HELD = 300_000


def _along(facing: Column, axis: int) -> Column:
    return reduce(lambda c, s: F.when(facing == s[0], F.lit(s[1 + axis])).otherwise(c), STEPS, F.lit(0))


def masters(cells: DataFrame, *, hops: int = 10) -> DataFrame:
    """Structure cells with (mx, my, mz, found): pointers are followed to a controller, ``hops`` looks at most.

    Without one, the last place reached is returned.  A fixed number of equi-joins, on places alone.
    """
    at = cells.where("kind = 'structure'").select("grid_id", "x", "y", "z", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("z").alias("mz"))
    at = at.withColumn("found", F.lit(False))
    look = cells.select("grid_id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("z").alias("mz"), F.col("kind").alias("__kind"), F.col("facing").alias("__facing"))
    for _ in range(hops):
        met = at.join(look, ["grid_id", "mx", "my", "mz"], "left")
        moves = (F.col("__kind") == "structure") & ~F.col("found")
        step = lambda c, k: F.when(moves, F.col(c) + _along(F.col("__facing"), k)).otherwise(F.col(c)).alias(c)
        at = met.select("grid_id", "x", "y", "z", step("mx", 0), step("my", 1), step("mz", 2), (F.col("found") | F.coalesce(F.col("__kind") == "controller", F.lit(False))).alias("found"))
    return at


def valid(cells: DataFrame) -> DataFrame:
    """Structure cells with ``valid``: they point to a structure cell or to a controller of their own structure."""
    own = cells.where("kind = 'structure'")
    to = cells.select("grid_id", F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("z").alias("__z"), F.col("kind").alias("__kind"), F.col("structure").alias("__structure"))
    here = own.withColumn("__x", F.col("x") + _along(F.col("facing"), 0)).withColumn("__y", F.col("y") + _along(F.col("facing"), 1)).withColumn("__z", F.col("z") + _along(F.col("facing"), 2))
    met = here.join(to, ["grid_id", "__x", "__y", "__z"], "left")
    ok = (F.col("__kind") == "structure") | ((F.col("__kind") == "controller") & (F.col("__structure") == F.col("structure")))
    return met.select(*cells.columns, F.coalesce(ok, F.lit(False)).alias("valid"))


def fill(boxes: DataFrame, cells: DataFrame | None = None, *, polls: int = 101) -> DataFrame:
    """(grid_id, x, y, z, depth, facing): cells of a box reached from its controller, pointing back to where they came from.

    Boxes: (grid_id, cx, cy, cz, x0, y0, z0, sx, sy, sz), the box lying below its corner (x0, y0, z0).  Structure
    cells of ``cells`` stay as they are and let no walk through.  A walk ends after ``polls`` places taken from its
    queue, where a place may stand more than once, so no closed form gives its end: boxes are walked, in constant time
    and memory, and those that look alike from their controllers share a walk while a task keeps it.  Only cells that a
    walk can meet, at most ``polls`` steps away, are gathered for a box.  A box without room, or with a null, gives no
    rows; repeated boxes are walked alike.
    """
    inside = (F.col("x0") - F.col("x") >= 0) & (F.col("x0") - F.col("x") < F.col("sx")) & (F.col("y0") - F.col("y") >= 0) & (F.col("y0") - F.col("y") < F.col("sy")) & (F.col("z0") - F.col("z") >= 0) & (F.col("z0") - F.col("z") < F.col("sz"))
    box = ["cx", "cy", "cz", "x0", "y0", "z0", "sx", "sy", "sz"]
    given = boxes.select("grid_id", *box)
    if cells is None:
        given = given.withColumn("taken", F.lit(None).cast("array<struct<x:int,y:int,z:int>>"))
    else:
        near = F.abs(F.col("x") - F.col("cx")) + F.abs(F.col("y") - F.col("cy")) + F.abs(F.col("z") - F.col("cz")) <= polls
        built = cells.where("kind = 'structure'").select("grid_id", "x", "y", "z")
        met = given.distinct().join(built, "grid_id").where(inside & near).groupBy("grid_id", *box).agg(F.collect_set(F.struct(*[F.col(c).cast("int").alias(c) for c in "xyz"])).alias("taken"))
        given = given.join(met, ["grid_id", *box], "left")

    def rows(grids: pa.Array, met: list[tuple[int, tuple, np.ndarray]]) -> pa.RecordBatch:
        many = [len(found) for *_, found in met]
        cells = np.concatenate([found for *_, found in met])
        cells[:, :3] += np.repeat(np.array([start for _, start, _ in met], dtype=np.int32), many, axis=0)
        ids = grids.take(pa.array(np.repeat([k for k, *_ in met], many)))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(4)), pa.array(facings).take(pa.array(cells[:, 4]))], names=["grid_id", "x", "y", "z", "depth", "facing"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            met, waiting = [], 0
            for k, (*sides, taken) in enumerate(zip(*(listed(c) for c in batch.columns[1:]), strict=True)):
                if None in sides:
                    continue
                start, high, size = sides[:3], sides[3:6], sides[6:]
                shape = (*_seen(start, high, size, polls), frozenset((c["x"] - start[0], c["y"] - start[1], c["z"] - start[2]) for c in taken or ()))
                if shape not in walks:
                    if held > HELD:
                        walks, held = {}, 0
                    walks[shape] = np.array([(*to, depth, facings.index(facing)) for *to, depth, facing in _walk((0, 0, 0), *shape, polls)], dtype=np.int32).reshape(-1, 5)
                    held += len(shape[2]) + len(walks[shape])
                met.append((k, start, walks[shape]))
                waiting += len(walks[shape])
                if waiting >= 100_000:
                    yield rows(batch.column(0), met)
                    met, waiting = [], 0
            if waiting:
                yield rows(batch.column(0), met)

    facings = list(OPPOSITE)
    # a walk takes time that the few bytes of a box do not show: the tasks are the session's shuffle partitions
    spread = given.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, StructType([StructField("grid_id", boxes.schema["grid_id"].dataType)] + [StructField(c, IntegerType()) for c in ("x", "y", "z", "depth")] + [StructField("facing", StringType())]))


def _seen(start: tuple, high: tuple, size: tuple, polls: int) -> tuple[tuple, tuple]:
    """Corner and size, from ``start``, of the part of a box that ``polls`` steps can reach."""
    far = [c - s for c, s in zip(high, start, strict=True)]
    top = tuple(min(c, polls) for c in far)
    return top, tuple(max(t - max(c - n + 1, -polls) + 1, 0) for t, c, n in zip(top, far, size, strict=True))


def _walk(start: tuple, corner: tuple, size: tuple, taken: set, polls: int) -> list[tuple]:
    """Places of one box in the order of a breadth-first walk of at most ``polls`` queue entries."""
    found: dict[tuple, tuple] = {}
    queue: list[tuple] = []

    def look(at: tuple, depth: int) -> None:
        for name, *step in STEPS:
            to = tuple(a + d for a, d in zip(at, step, strict=True))
            if to != start and to not in found and all(0 <= c - t < n for c, t, n in zip(corner, to, size, strict=True)):
                queue.append((to, depth, OPPOSITE[name]))

    look(tuple(start), 1)
    for k in range(polls):
        if k >= len(queue):
            break
        at, depth, facing = queue[k]
        if at not in found and at not in taken:
            found[at] = (*at, depth, facing)
            look(at, depth + 1)
    return list(found.values())


def mismatches(cells: DataFrame, template: DataFrame) -> DataFrame:
    """Template cells (grid_id, x, y, z, kind, facing) that the grid does not have so: what a repair rewrites."""
    have = cells.select("grid_id", "x", "y", "z", F.col("kind").alias("__kind"), F.col("facing").alias("__facing"))
    met = template.join(have, ["grid_id", "x", "y", "z"], "left")
    return met.where(~(F.col("kind").eqNullSafe(F.col("__kind")) & F.col("facing").eqNullSafe(F.col("__facing")))).select("grid_id", "x", "y", "z", "kind", "facing")


def oriented(x: Column, y: Column, z: Column, facing: Column, sign: Column | None = None) -> list[Column]:
    """A default (x, y, z) turned to the axis of a direction; ``sign`` turns its first part."""
    first = x if sign is None else x * sign
    flat, tall = facing.isin("north", "south"), facing.isin("up", "down")
    return [F.when(flat, z).when(tall, y).otherwise(first).alias("x"), F.when(tall, first).otherwise(y).alias("y"), F.when(flat, first).otherwise(z).alias("z")]


def placeable(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """``boxes`` (box_id, grid_id, x0, y0, z0, sx, sy, sz) with ``free``: no cell other than air inside."""
    axis = lambda c, n: F.explode(F.sequence(F.col(c), F.col(c) + F.col(n) - 1))
    places = boxes.withColumn("x", axis("x0", "sx")).withColumn("y", axis("y0", "sy")).withColumn("z", axis("z0", "sz"))
    taken = places.join(cells.where("kind <> 'air'").select("grid_id", "x", "y", "z").distinct(), ["grid_id", "x", "y", "z"]).select("box_id").distinct().withColumn("__t", F.lit(True))
    return boxes.join(taken, "box_id", "left").select(*boxes.columns, F.col("__t").isNull().alias("free"))


def shape(name: str, facing: str) -> list[tuple[int, int, int, str]]:
    """(dx, dy, dz, facing) of a predefined shape's cells, its first axis turned to a direction."""
    axis = {"east": 0, "west": 0, "up": 1, "down": 1, "south": 2, "north": 2}[facing]
    plus = ("east", "up", "south")[axis]
    out = []
    for offset, to in SHAPES[name]:
        place = [0, 0, 0]
        place[axis] = offset
        out.append((*place, plus if to == "east" else OPPOSITE[plus]))
    return out
