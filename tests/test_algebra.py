import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import distributions, scalar, units
from quillon.operators import matrix, network, solvers
from quillon.plans import queries as plans


def coo(dense):
    dense = np.array(dense, dtype=float)
    r, c = np.nonzero(dense)
    return solvers.Coo(r, c, dense[r, c], *dense.shape)


SPD = [[4, -1, 0], [-1, 4, -1], [0, -1, 3]]


def test_products(spark):
    a = spark.createDataFrame([("m", r, c, float(SPD[r][c])) for r in range(3) for c in range(3)], "matrix_id string, row int, col int, value double")
    dims = spark.createDataFrame([("m", 4, 3)], "matrix_id string, n_rows int, n_cols int")
    x = spark.createDataFrame([("m", k, float(k + 1)) for k in range(3)], "matrix_id string, idx int, value double")
    got = matrix.multiply(matrix.assemble(a), x, dims).orderBy("idx").collect()
    assert [r.value for r in got] == [2.0, 4.0, 7.0, 0.0]
    with pytest.raises(ValueError):
        matrix.check_vector(x, dims, "n_rows")
    matrix.check_vector(x, dims)


def test_conjugate_gradient():
    x, _, left = solvers.conjugate_gradient(coo(SPD), np.array([15.0, 10, 10]))
    assert x == pytest.approx([5, 5, 5], abs=1e-6) and left < 1e-9
    with pytest.raises(ArithmeticError):
        solvers.conjugate_gradient(coo(SPD), np.array([15.0, 10, 10]), guess=np.array([5.0, 5, 5]), strict=True)
    assert solvers.conjugate_gradient(coo(SPD), np.array([15.0, 10, 10]), guess=np.array([5.0, 5, 5]))[1] == 0
    with pytest.raises(ValueError):
        solvers.conjugate_gradient(coo([[1, 0]]), np.array([1.0]))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (np.eye(3), [3, 7, 2], [3, 7, 2]),
        (np.diag([2, 4, 8]), [4, 8, 16], [2, 2, 2]),
        ([[2, 1, -1], [-3, -1, 2], [-2, 1, 2]], [1, 1, 6], [1, 2, 3]),
        ([[1, 0], [0, 1], [1, 1]], [3, 5, 8], [3, 5]),
        ([[1, 1], [1, 2], [1, 3], [1, 4]], [6, 5, 7, 10], [3.5, 1.4]),
        ([[5]], [15], [3]),
        ([[3, 1], [1, 2]], [0, 0], [0, 0]),
    ],
)
def test_least_squares(a, b, want):
    x, _, _ = solvers.least_squares(coo(a), np.array(b, dtype=float))
    assert x == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        solvers.least_squares(coo(a), np.ones(len(b) + 1))


def _solve(spark, rows, comps, **options):
    base = spark.createDataFrame([("m",)], "model_id string")
    return {(r.node_id, r.domain): r for r in network.steady_state(plans._nodes(base, *rows), plans._components(base, *comps), **options).collect()}


M, T = network.MECHANICAL, network.THERMAL


def test_networks(spark):
    v = F.lit
    got = _solve(spark, [("g", M, "fixed", v(0.0)), ("a", M, "unknown", None)], [("link", M, ("a", "g"), {"g": v(2.0)}), ("source", M, ("a",), {"q": v(6.0)})])
    assert got["a", M].value == pytest.approx(3.0, abs=1e-6) and got["a", M].converged
    chain = [("t", M, "fixed", v(12.0)), *((n, M, "unknown", None) for n in "abc"), ("e", M, "fixed", v(0.0))]
    links = [("link", M, p, {"g": v(g)}) for p, g in ((("t", "a"), 4.0), (("a", "b"), 3.0), (("b", "c"), 2.0), (("c", "e"), 6.0))]
    for method in ("auto", "cgnr"):
        got = _solve(spark, chain, links, method=method)
        assert [got[n, M].value for n in "abc"] == pytest.approx([9.6, 6.4, 1.6], abs=1e-3)
    got = _solve(spark, [("i", M, "fixed", v(10.0)), ("o", M, "unknown", None), ("k", M, "constraint", None), ("g", M, "fixed", v(0.0)), ("h", T, "unknown", None), ("air", T, "fixed", v(0.0))], [("gear", M, ("i", "o", "k"), {"r": v(3.0)}), ("damper", M, ("o", "g", "h"), {"g": v(4.0)}), ("link", T, ("h", "air"), {"g": v(2.0)})])
    assert got["o", M].value == pytest.approx(30, abs=1e-3) and got["h", T].value == pytest.approx(1800, abs=1e-3)


def test_layered_plate_has_twice_linked_seams(spark):
    layers = spark.createDataFrame([("p", 0, "STEEL", 0.5, 0.05, 10, 2), ("p", 1, "COPPER", 0.5, 0.1, 10, 2)], "model_id string, layer int, material string, length double, thickness double, nx int, ny int")
    got = {r.part: r["count"] for r in network.plate_links(layers).groupBy("part").count().collect()}
    assert got == {"vertical": 40, "horizontal": 45, "interface": 9}


def test_scalars(spark):
    one = spark.range(1)
    roots = one.select(scalar.cubic_roots(F.lit(1.0), F.lit(-6.0), F.lit(11.0), F.lit(-6.0)).alias("r"), scalar.cubic_roots(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(-8.0)).alias("s"), scalar.cubic_roots(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("t")).first()
    assert roots.r == pytest.approx([3, 1, 2]) and roots.s[0] == pytest.approx(2) and np.isnan(roots.s[1:]).all() and np.isnan(roots.t).all()
    down = one.select(scalar.descend(lambda x, p: x * x, F.lit(-1.0), F.lit(0.0), 0.1, 0.01).alias("a"), scalar.descend(lambda x, p: np.abs(np.cos(x)), F.lit(1e-3), F.lit(0.0), 0.1, 0.01).alias("b")).first()
    assert down.a == pytest.approx(0, abs=1e-5) and down.b == pytest.approx(np.pi / 2, abs=1e-4)
    with pytest.raises(Exception, match="change of sign"):
        one.select(scalar.bisect(lambda x: x * x + 1.0, F.lit(0.0), F.lit(1.0), 1e-6)).collect()
    shown = one.select(*(units.axis_number(F.lit(x)) for x in (12345.0, 0.001, 42.4, 1.5))).first()
    assert list(shown) == ["1.2e+04", "1.0e-03", "42", "1.500"]


def test_bisection_computes_its_function_once_a_step(spark):
    p = F.col("p")
    rows = spark.createDataFrame([(2.0,), (None,), (0.0,), (250000.0,), (float("nan"),)], "p double")
    root = scalar.bisect(lambda x: x * x - p * 1.0625, F.lit(0.0), F.lit(1024.0), 1e-10, strict=False)
    got = [r[0] for r in rows.select(root).collect()]
    assert got == [pytest.approx(2.125**0.5, abs=1e-9), None, pytest.approx(0, abs=1e-9), pytest.approx(515.388203, abs=1e-6), None]
    # seven times at the ends, once in a step, and once more there for a NaN
    assert str(root).count("1.0625") == 9
    nan = scalar.bisect(lambda x: F.when(x > 3, F.lit(float("nan"))).otherwise(x - 2), F.lit(0.0), F.lit(2.5), 1e-9)
    away = scalar.bisect(lambda x: F.when(F.abs(x - 5) < 1, F.lit(float("nan"))).otherwise(x - 2), F.lit(0.0), F.lit(10.0), 1e-9)
    assert [spark.range(1).select(c).first()[0] for c in (nan, away)] == pytest.approx([2, 2])


def test_moments(spark):
    n = 20_000
    ids = spark.range(n)
    draws = ids.select(
        distributions.poisson(F.col("id"), F.lit(4.0), 1).alias("p"), distributions.poisson(F.col("id"), F.lit(800.0), 1).alias("q"), distributions.binomial(F.col("id"), F.lit(100.0), F.lit(0.4), 2).alias("b"),
        distributions.gamma(F.col("id"), F.lit(0.5), F.lit(2.0), 3).alias("g"), distributions.beta(F.col("id"), F.lit(2.0), F.lit(3.0), 4).alias("t"),
    ).toPandas()
    for c, mean, var in (("p", 4, 4), ("q", 800, 800), ("b", 40, 24), ("g", 0.25, 0.125), ("t", 0.4, 0.04)):
        assert abs(draws[c].mean() - mean) < 5 * (var / n) ** 0.5
        assert abs(draws[c].var() / var - 1) < 0.15


def test_every_supplier_has_an_exchanger(spark, tmp_path):
    from quillon.plans import queries as plans

    spark.range(1, 31).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = plans.QUERIES["net_heat_exchanger"](spark, str(tmp_path)).collect()
    assert {r.model_id for r in rows} == {str(k) for k in range(1, 31)} and len(rows) % 30 == 0


def test_stacked_models_are_solved_as_each_alone():
    nodes = [("in", M, "fixed"), ("out", M, "unknown"), ("k", M, "constraint"), ("wall", T, "unknown"), ("body", T, "unknown"), ("lone", T, "unknown"), ("air", T, "fixed"), ("air", network.HYDRAULIC, "fixed"), ("a", network.HYDRAULIC, "unknown"), ("b", network.HYDRAULIC, "unknown")]
    comps = [("c0", M, "gear", ("in", "out", "k"), ("r",)), ("c1", M, "damper", ("out", "in", "wall"), ("g",)), ("c2", T, "link", ("wall", "body"), ("g",)), ("c3", T, "link", ("lone", "air"), ("g",)), ("c4", T, "radiation", ("body", "air"), ("area", "emissivity")), ("c5", T, "convection", ("wall", "air"), ("cp", "h0", "h1")), ("c6", network.HYDRAULIC, "link", ("a", "b"), ("g",)), ("c7", network.HYDRAULIC, "source", ("a",), ("q",))]
    rng = np.random.default_rng(3)
    many = 40
    now = np.column_stack([rng.uniform(1, 9, (many, 3)), rng.uniform(280, 400, (many, 4)), rng.choice([-2.0, 0.0, 2.0], many), rng.uniform(0, 1, (many, 2))])
    given = np.column_stack([rng.uniform(1, 3, (many, 3)), rng.choice([0.0, 1.5], many), rng.uniform(0.1, 1, (many, 2)), rng.uniform(0, 2, (many, 3)), rng.uniform(1, 3, many), rng.choice([0.0, 4.0], many)])
    stack = network._Models(nodes, comps, np.hstack([now, given]))
    for domain in network.DOMAINS:
        got = network._solve_domain(stack, domain, "auto", 5000, 1e-3)
        alone = np.vstack([network._solve_domain(stack.of(np.array([k])), domain, "auto", 5000, 1e-3) for k in range(many)])
        assert np.isfinite(got).all() and got == pytest.approx(alone, rel=1e-9, abs=1e-9)


def test_each_model_ends_by_itself_and_is_solved_once(spark):
    base = spark.createDataFrame([("x", 400.0), ("y", 290.0), (None, 350.0), ("z", 440.0)], "model_id string, hot double")
    nodes = plans._nodes(base, ("hot", T, "fixed", F.col("hot")), ("body", T, "unknown", None, 300.0), ("air", T, "fixed", F.lit(290.0)))
    comps = plans._components(base, ("radiation", T, ("hot", "body"), {"area": F.lit(2.0), "emissivity": F.lit(0.9)}), ("link", T, ("body", "air"), {"g": F.lit(5.0)}))
    rows = {r.model_id: r for r in network.steady_state(nodes, comps, tol=1e-7).where("node_id = 'body'").collect()}
    for key, row in rows.items():
        one = F.col("model_id").eqNullSafe(F.lit(key))
        assert tuple(network.steady_state(nodes.where(one), comps.where(one), tol=1e-7).where("node_id = 'body'").first()) == pytest.approx(tuple(row))
    assert len(rows) == 4 and all(r.converged for r in rows.values()) and rows["y"].outer_iters < rows["z"].outer_iters
    plan = plans.QUERIES["net_gear_damper"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
