import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import fluid, lookup, tables, voxel
from quillon.sources import table_json


def points1d(spark, rows):
    return spark.createDataFrame([("f", float(x), float(y)) for x, y in rows], "fn_id string, x double, y double")


def at1d(spark, points, places, **options):
    q = spark.createDataFrame([("f", x) for x in places], "fn_id string, x double")
    got = {r.x: r.value for r in tables.evaluate_1d(q, points, step=1.0, **options).collect()}
    return [got[x] for x in places]


def test_one_dimension(spark):
    full = points1d(spark, [(x, 2 * x) for x in range(11)])
    places = [0.0, 0.5, 3.5, 10.0, -1.0, -10.0, 11.0, 20.0]
    assert at1d(spark, full, places) == pytest.approx([2 * x for x in places], abs=1e-6)
    assert at1d(spark, full, [-10.0, 10.0, 15.0], clamp=True) == [0.0, 20.0, 20.0]
    holes = points1d(spark, [(x, 2 * x) for x in range(11) if x not in (3, 4, 7)])
    assert at1d(spark, holes, [3.0, 4.0, 7.0, 3.5]) == pytest.approx([6, 8, 14, 7], abs=1e-6)


def test_one_point_is_a_constant_and_nothing_is_null(spark):
    assert at1d(spark, points1d(spark, [(1, 5)]), [0.0, 1.0, 9.0]) == [5.0, 5.0, 5.0]
    assert at1d(spark, points1d(spark, []), [1.0]) == [None]
    q = spark.createDataFrame([("f", None), ("f", float("nan"))], "fn_id string, x double")
    assert [r.value for r in tables.evaluate_1d(q, points1d(spark, [(1, 5), (2, 6)]), step=1.0).collect()] == [None, None]


def points2d(spark, keep=lambda x, y: True):
    return spark.createDataFrame([("f", float(x), float(y), float(x + y)) for x in range(6) for y in range(6) if keep(x, y)], "fn_id string, x double, y double, v double")


def at2d(spark, points, places, **options):
    q = spark.createDataFrame([("f", float(x), float(y)) for x, y in places], "fn_id string, x double, y double")
    got = {(r.x, r.y): r.value for r in tables.evaluate_2d(q, points, **options).collect()}
    return [got[float(x), float(y)] for x, y in places]


def test_two_dimensions(spark):
    full = points2d(spark)
    assert at2d(spark, full, [(2, 3), (2.5, 3.5), (5, 6), (-1, 0)]) == pytest.approx([5, 6, 11, 0])
    assert at2d(spark, full, [(-10, 0), (5, -10), (5, 5), (100, 100)], clamp=True) == pytest.approx([0, 5, 10, 10])
    holed = points2d(spark, lambda x, y: x != 2 and y != 3)
    assert at2d(spark, holed, [(2, 4), (4, 3)]) == pytest.approx([6, 7])
    rows = spark.createDataFrame([("f", 2.0)], "fn_id string, x double")
    assert at2d(spark, holed, [(2, 4)], rows=rows) == [None]


@pytest.mark.parametrize("clamp", [True, False])
def test_few_points_are_read_in_memory_and_equal_the_joins(spark, monkeypatch, clamp):
    cells = [(g, x * 1.5, y + 0.1 * x, math.sin(3 * x + y) + len(g)) for g in ("f", "g") for x in range(-2, 5) for y in range(6) if (x * 7 + y * 3) % 4 or (x, y) == (4, 0)] + [("one", 1.0, 2.0, 5.0)]
    points = spark.createDataFrame(cells, "fn_id string, x double, y double, v double")
    ends = [None, float("nan"), float("inf"), float("-inf"), -3.0, -0.0, 0.0, 1.0, 1.5, 2.2, 6.0, 7.5, 3.1]
    places = [(k, g, x, y) for k, (g, x, y) in enumerate((g, x, y) for g in ("f", "g", "one", "none", None) for x in ends for y in ends)]
    q = spark.createDataFrame(places, "id int, fn_id string, x double, y double")
    quick = tables.evaluate_2d(q, points, clamp=clamp)
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(tables, "FEW_POINTS", 10)
    slow = tables.evaluate_2d(q, points, clamp=clamp)
    got, want = ({r.id: r.value for r in df.collect()} for df in (quick, slow))
    assert len(got) == len(places) and {k: str(v) for k, v in got.items() if v is None or v != v} == {k: str(v) for k, v in want.items() if v is None or v != v}
    assert [got[k] for k in want if want[k] is not None] == pytest.approx([v for v in want.values() if v is not None], nan_ok=True, rel=1e-12)
    assert tables.evaluate_2d(q, points.where("false"), clamp=clamp).where("value is not null").count() == 0


def test_build_merge_split_json(spark):
    assert tables.grid_keys(0.0, 1.0, 0.25) == [0.0, 0.25, 0.5, 0.75]
    with pytest.raises(ValueError):
        tables.grid_keys(0.0, 1.0, 0.1, tables.LOGARITHMIC)
    made, rows = tables.populate_2d(spark, "f", lambda x, y: x + y, (0.0, 1.0, 3), (1.0, 100.0, 3), y_mode=tables.LOGARITHMIC)
    assert made.count() == 9 and sorted(r.y for r in made.select("y").distinct().collect()) == pytest.approx([1, 10, 100])
    assert rows.count() == 3
    a = spark.createDataFrame([("f", 0.0, 0.0, 1.0), ("f", 0.0, 1.0, 2.0)], "fn_id string, x double, y double, v double")
    b = spark.createDataFrame([("f", 0.0, 1.0, 9.0), ("f", 1.0, 1.0, 3.0)], "fn_id string, x double, y double, v double")
    assert sorted(r.v for r in tables.merge(a, b).collect()) == [1.0, 3.0, 9.0]
    assert sorted(r.v for r in tables.merge(a, b, overwrite=False).collect()) == [1.0, 2.0, 3.0]
    sizes = tables.split(points2d(spark, lambda x, y: y <= x), 4).groupBy("chunk_id").count().collect()
    assert {r.chunk_id: r["count"] for r in sizes} == {0: 6, 1: 4, 2: 5, 3: 6}
    meta = spark.createDataFrame([("f", 1.0, 1.0, "LINEAR", "LINEAR", True)], "fn_id string, x_step double, y_step double, x_mode string, y_mode string, clamp boolean")
    back, _ = table_json.decode_tables(table_json.encode_tables(points2d(spark), meta))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points2d(spark).collect()))
    assert table_json.decode_tables(spark.createDataFrame([("f", "{bad"), ("g", '{"table":{}}')], "fn_id string, json string"))[0].count() == 0


def test_files_and_inverse(spark, tmp_path):
    meta = spark.createDataFrame([("f", 1.0, 1.0, "LINEAR", "LINEAR", True)], "fn_id string, x_step double, y_step double, x_mode string, y_mode string, clamp boolean")
    table_json.write_tables(points2d(spark), meta, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    odd = "a b+c%d=é"
    named = lambda df: df.unionByName(df.withColumn("fn_id", F.lit(odd)))
    table_json.write_tables(named(points2d(spark)), named(meta), str(tmp_path / "two"))
    back, about = table_json.read_tables(spark, str(tmp_path / "two"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, named(points2d(spark)).collect()))
    assert sorted(map(tuple, about.collect())) == sorted(map(tuple, named(meta).collect()))
    (tmp_path / "three" / "deep").mkdir(parents=True)
    (tmp_path / "three" / "deep" / "g h.json").write_text('{"table": {"1.0": {"2.0": 3.0}}, "clamp": true}')
    assert table_json.read_tables(spark, str(tmp_path / "three"))[0].collect() == [("g h", 1.0, 2.0, 3.0)]
    square = points1d(spark, [(x, x * x) for x in range(5)])
    got = {r.x: r.y for r in tables.invert(square, step=4.0).collect()}
    assert got == pytest.approx({0.0: 0.0, 4.0: 2.0, 8.0: 2.8, 12.0: 3 + 3 / 7})
    assert tables.invert(points1d(spark, [(0, 3), (1, 1)]), step=1.0).count() == 0
    grown = tables.populate_1d(spark, "f", lambda x: x * 2, 1.0, 3.0, 0.5)
    assert [round(r.y, 6) for r in grown.orderBy("x").collect()] == [2.0, 3.0, 4.0, 5.0]


def test_tagged_values(spark):
    values = spark.createDataFrame([("a", False, 1.0), ("t", True, 5.0), ("s", True, 6.0)], "key string, is_tag boolean, value double")
    members = spark.createDataFrame([("t", "a"), ("t", "b"), ("s", "b"), ("x", "c")], "tag string, id string")
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r.k: r.value for r in lookup.lookup(q, values, members, key="k", default=-1.0).collect()}
    assert got == {"a": 1.0, "b": 6.0, "c": -1.0} and not math.isnan(got["a"])
    new = spark.createDataFrame([("n", False, 2.0)], "key string, is_tag boolean, value double")
    assert sorted(r.key for r in lookup.reload(values, new, replace=True).collect()) == ["n", "s", "t"]


def plain_fill(size, corner, built=()):
    """Cells of a walk from place 0 that takes at most 101 entries off its queue, written out."""
    from collections import deque

    steps = [(0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1), (-1, 0, 0), (1, 0, 0)]
    inside = lambda p: all(0 <= c - v < n for c, v, n in zip(corner, p, size, strict=True))
    placed, left = set(), deque(s for s in steps if inside(s))
    for _ in range(101):
        if not left:
            break
        at = left.popleft()
        if at in placed or at in built:
            continue
        placed.add(at)
        around = [tuple(a + b for a, b in zip(at, s, strict=True)) for s in steps]
        left.extend(p for p in around if inside(p) and p != (0, 0, 0) and p not in placed)
    return placed


def test_fill_stops_where_the_walk_stops(spark):
    shapes = {"corner": ((4, 4, 4), (0, 0, 0)), "middle": ((5, 5, 5), (2, 2, 2)), "flat": ((9, 1, 30), (4, 0, 9)), "none": ((0, 3, 3), (0, 0, 0)), "wall": ((4, 3, 6), (1, 1, 2))}
    boxes = spark.createDataFrame([(g, 0, 0, 0, *c, *n) for g, (n, c) in shapes.items()], "grid_id string, cx int, cy int, cz int, x0 int, y0 int, z0 int, sx int, sy int, sz int")
    built = [(x, y, -1) for x in range(-2, 2) for y in range(-1, 2)]
    cells = spark.createDataFrame([("wall", *p, "structure") for p in built] + [("corner", -1, 0, 0, "air"), ("wall", 0, 0, 0, "controller")], "grid_id string, x int, y int, z int, kind string")
    rows = voxel.fill(boxes, cells).collect()
    for g, (n, c) in shapes.items():
        mine = [(r.x, r.y, r.z) for r in rows if r.grid_id == g]
        assert len(mine) == len(set(mine)) and set(mine) == plain_fill(n, c, built if g == "wall" else ())
    assert sum(r.grid_id == "corner" for r in rows) == 50 and sum(r.grid_id == "middle" for r in rows) == 56
    free = [r for r in rows if r.grid_id != "wall"]
    assert all(r.depth == abs(r.x) + abs(r.y) + abs(r.z) for r in free)


def test_fill_walks_alike_boxes_once(spark):
    sides = [(g, *at, *(a + c for a, c in zip(at, corner, strict=True)), *size) for g, (at, corner, size) in enumerate([((0, 0, 0), (1, 1, 1), (3, 3, 3)), ((70, -8, 5), (1, 1, 1), (3, 3, 3)), ((7, 7, 7), (0, 0, 0), (500, 1, 1)), ((-7, 0, 0), (0, 0, 0), (102, 1, 1)), ((0, 0, 0), (300, 0, 0), (602, 1, 1)), ((0, 0, 0), (-3, 0, 0), (2, 1, 1))])]
    boxes = spark.createDataFrame([*sides, (9, None, 0, 0, 0, 0, 0, 4, 1, 1)], "grid_id long, cx int, cy int, cz int, x0 int, y0 int, z0 int, sx int, sy int, sz int")
    got = voxel.fill(boxes)
    assert got.schema["grid_id"].dataType.simpleString() == "bigint" and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = got.collect()
    for g, cx, cy, cz, x0, y0, z0, *size in sides:
        mine = [(r.x - cx, r.y - cy, r.z - cz) for r in rows if r.grid_id == g]
        assert len(mine) == len(set(mine)) and set(mine) == plain_fill(tuple(size), (x0 - cx, y0 - cy, z0 - cz))
    assert not [r for r in rows if r.grid_id == 9]
    assert voxel._seen((7, 7, 7), (7, 7, 7), (500, 1, 1), 101) == voxel._seen((-7, 0, 0), (-7, 0, 0), (102, 1, 1), 101) == ((0, 0, 0), (102, 1, 1))


def test_states_as_text(spark):
    rows = [(1, 300.5, 1e5, -2.0, 0.25), (2, -1.0, -2.0, 0.1 + 0.2, 7.0), (3, float("nan"), 1.0, None, None), (4, None, None, None, None)]
    states = spark.createDataFrame(rows, "id long, temperature double, pressure double, specific_enthalpy double, vapor_quality double")
    back = {r.id: tuple(r)[1:] for r in states.select("id", fluid.encoded().alias("t")).select("id", *fluid.decoded(F.col("t"))).collect()}
    assert back[1] == rows[0][1:] and back[2] == (0.0, 0.0, 0.1 + 0.2, 1.0) and back[4] == (0.0,) * 4
    assert math.isnan(back[3][0]) and back[3][1:] == (1.0, 0.0, 0.0)
    texts = spark.createDataFrame([(None,), ("{bad",), ('{"pressure": "much"}',), ("",)], "t string")
    assert all(tuple(r) == (None,) * 4 for r in texts.select(*fluid.decoded(F.col("t"))).collect())
