"""Queries of the numerical operators over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import distributions as dist
from quillon.functions import scalar, units
from quillon.operators import fluid, lookup, matrix, network, plot, solvers, tables, voxel
from quillon.sources import table_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- units and scalars ----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal + 1000 AS k, (c_acctbal + 1000) * 1.0 + -273.15 AS celsius, (c_acctbal + 1000) * CAST(1.8 AS DOUBLE) + -459.67 AS fahrenheit FROM customer")
def unit_temperature(spark, d):
    k = F.col("c_acctbal") + 1000
    return read(spark, d, "customer").select("c_custkey", k.alias("k"), units.convert(k, "temperature", "celsius").alias("celsius"), units.convert(k, "temperature", "fahrenheit").alias("fahrenheit"))


@query("SELECT o_orderkey, round(o_totalprice / 100000, 8) AS bar, round(o_totalprice / 101300, 8) AS atm, round(o_totalprice / 6895, 8) AS psi FROM orders")
def unit_pressure(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", *(F.round(units.convert(p, "pressure", u), 8).alias(a) for u, a in (("bar", "bar"), ("atmosphere", "atm"), ("psi", "psi"))))


@query("SELECT event_id, value * 1e6 AS bq, round(value / 37e9 * 1e9, 8) AS nano_ci, round(value * 1.602e-13 * 1e13, 8) AS gy, round(value * 1.602e-11 * 1e11, 8) AS rad, round(value * 1.602e-13 * 1e13, 8) AS sv FROM events")
def unit_irradiation(spark, d):
    c = lambda u, s: F.round(units.convert(F.col("value"), "irradiation", u) * s, 8)
    return read(spark, d, "events").select("event_id", units.convert(F.col("value"), "irradiation", "becquerel").alias("bq"), c("curie", 1e9).alias("nano_ci"), c("gray_per_second", 1e13).alias("gy"), c("rad_per_second", 1e11).alias("rad"), c("sievert_per_second", 1e13).alias("sv"))


_SI = "CASE " + " ".join(f"WHEN v >= 1e{e} THEN '{s}'" for e, s in reversed(units.PREFIXES)) + " ELSE 'a' END"
_SIP = "CASE " + " ".join(f"WHEN v >= 1e{e} THEN {e}" for e, s in reversed(units.PREFIXES)) + " ELSE -18 END"


@query(f"SELECT o_orderkey, {_SI} AS prefix, round(v / pow(10.0, {_SIP}), 6) AS scaled FROM (SELECT o_orderkey, (o_totalprice - 200000) * pow(10.0, o_orderkey % 25 - 16) * 1.000000123 AS v FROM orders) WHERE v > 0")
def si_prefix(spark, d):
    v = read(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 200000) * F.pow(F.lit(10.0), F.col("o_orderkey") % 25 - 16) * 1.000000123).alias("v")).where("v > 0")
    scaled, prefix = units.prefix(F.col("v"))
    return v.select("o_orderkey", prefix.alias("prefix"), F.round(scaled, 6).alias("scaled"))


@query("SELECT s_suppkey, 'a' AS zero_prefix, CASE WHEN abs(s_acctbal) >= 1000 THEN 'k' WHEN abs(s_acctbal) >= 1 THEN '' ELSE 'm' END AS size_prefix, 'Balance: ' || printf('%.2f', s_acctbal / 100000.0 * 1.0) || ' bar' AS label, CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT) AS state FROM supplier")
def quantity_format(spark, d):
    b = F.col("s_acctbal")
    return read(spark, d, "supplier").select("s_suppkey", units.prefix(b * 0.0)[1].alias("zero_prefix"), units.prefix(b, abs_value=True)[1].alias("size_prefix"), units.quantity_text(b, "pressure", "bar", "Balance").alias("label"), units.to_fixed_point(b, 2).alias("state"))


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders")
def bisection_sqrt(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.round(scalar.bisect(lambda x: x * x - p, F.lit(0.0), F.lit(1024.0), 1e-10), 6).alias("root"))


@query("SELECT s_suppkey, round(s_acctbal / 1000 + 0.00012345, 3) AS best FROM supplier")
def descent_min(spark, d):
    found = scalar.descend(lambda x, p: (x - p) ** 2, F.lit(0.0), F.col("s_acctbal") / 1000, 0.1, 0.01)
    return read(spark, d, "supplier").select("s_suppkey", F.round(found + 0.00012345, 3).alias("best"))


_CUBIC = "SELECT p_partkey, p_size * 1.0 AS r, CAST((p_partkey % 7) + 60 AS DOUBLE) AS s, -1.0 * (p_partkey % 5) - 1 AS t FROM part"


@query(f"SELECT p_partkey, round(greatest(r, s, t), 5) AS r0, round(least(r, s, t), 5) AS r1, round(r + s + t - greatest(r, s, t) - least(r, s, t), 5) AS r2 FROM ({_CUBIC})")
def cubic_roots(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("r"), ((F.col("p_partkey") % 7) + 60).cast("double").alias("s"), (-1.0 * (F.col("p_partkey") % 5) - 1).alias("t"))
    r, s, t = (F.col(c) for c in "rst")
    roots = scalar.cubic_roots(F.lit(1.0), -(r + s + t), r * s + r * t + s * t, -(r * s * t))
    return p.select("p_partkey", roots.alias("x")).select("p_partkey", *(F.round(F.element_at("x", k + 1), 5).alias(f"r{k}") for k in range(3)))


# ---- distributions --------------------------------------------------------------------------------------

_U = "((event_id * 7919 % 10007) + 0.5) / 10007"


def _u():
    return ((F.col("event_id") * 7919 % 10007) + 0.5) / 10007


@query(f"SELECT event_id, round(-ln(1 - u) / 2.5, 9) AS draw FROM (SELECT event_id, {_U} AS u FROM events)")
def dist_exponential(spark, d):
    return read(spark, d, "events").select("event_id", F.round(dist.exponential(2.5, _u()), 9).alias("draw"))


@query(f"SELECT event_id, CAST(floor(ln(u) / ln(CAST(1 AS DOUBLE) - 0.3)) AS BIGINT) AS draw FROM (SELECT event_id, {_U} AS u FROM events)")
def dist_geometric(spark, d):
    return read(spark, d, "events").select("event_id", dist.geometric(0.3, _u()).alias("draw"))


@query(f"""WITH RECURSIVE t AS (SELECT 0 AS k, exp(-3.0) AS p, exp(-3.0) AS s UNION ALL SELECT k + 1, p * 3.0 / (k + 1), s + p * 3.0 / (k + 1) FROM t WHERE k < 40)
SELECT event_id, (SELECT min(k) FROM t WHERE s >= u)::BIGINT AS draw FROM (SELECT event_id, {_U} AS u FROM events)""")
def dist_poisson_inverse(spark, d):
    return read(spark, d, "events").select("event_id", dist.poisson_inverse(3.0, _u()).alias("draw"))


@query()
def dist_poisson(spark, d):
    rate = F.when(F.col("event_id") % 3 == 0, 5.0).when(F.col("event_id") % 3 == 1, 100.0).otherwise(900.0)
    return read(spark, d, "events").select("event_id", dist.poisson(F.col("event_id"), rate, 11).alias("draw"))


@query()
def dist_binomial(spark, d):
    n = F.when(F.col("event_id") % 3 == 0, 20.0).when(F.col("event_id") % 3 == 1, 100.0).otherwise(1000.0)
    return read(spark, d, "events").select("event_id", dist.binomial(F.col("event_id"), n, F.lit(0.1), 12).alias("draw"))


@query()
def dist_normal(spark, d):
    return read(spark, d, "events").select("event_id", dist.normal(F.lit(2.0), F.lit(3.0), 13).alias("draw"))


@query()
def dist_gamma(spark, d):
    return read(spark, d, "events").select("event_id", dist.gamma(F.col("event_id"), F.lit(2.5), F.lit(0.5), 14).alias("draw"))


@query()
def dist_beta(spark, d):
    return read(spark, d, "events").select("event_id", dist.beta(F.col("event_id"), F.lit(2.0), F.lit(3.0), 15).alias("draw"))


# ---- tables ---------------------------------------------------------------------------------------------

_PTS = "pts AS (SELECT CAST(p_size AS DOUBLE) AS x, round(avg(p_retailprice), 4) AS y FROM part WHERE p_size % 2 = 0 AND p_size BETWEEN 10 AND 40 GROUP BY p_size)"
_SEG = "seg AS (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM pts), e AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM pts)"
_Q = "q AS (SELECT l_orderkey, l_linenumber, l_quantity + 0.5 AS x FROM lineitem)"
_LERP = "seg.y1 * (1 - (q.x - seg.x1) / (seg.x2 - seg.x1)) + seg.y2 * ((q.x - seg.x1) / (seg.x2 - seg.x1))"


def _size_prices(spark, d):
    part = read(spark, d, "part").where("p_size % 2 = 0 and p_size between 10 and 40")
    return part.groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("y")).select(F.lit("price").alias("fn_id"), F.col("p_size").cast("double").alias("x"), "y")


def _quantities(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 0.5).alias("x"), F.lit("price").alias("fn_id"))


@query(f"WITH {_PTS}, {_SEG}, {_Q} SELECT l_orderkey, l_linenumber, round(CASE WHEN q.x <= lo THEN ylo WHEN q.x >= hi THEN yhi ELSE {_LERP} END + 0.0000123, 4) AS value FROM q CROSS JOIN e LEFT JOIN seg ON q.x >= seg.x1 AND q.x < seg.x2")
def table1d_clamp(spark, d):
    met = tables.evaluate_1d(_quantities(spark, d), _size_prices(spark, d), step=2.0, clamp=True)
    return met.select("l_orderkey", "l_linenumber", F.round(F.col("value") + 0.0000123, 4).alias("value"))


@query(f"""WITH {_PTS}, {_SEG}, {_Q}, f AS (SELECT * FROM seg WHERE x2 IS NOT NULL ORDER BY x1 LIMIT 1), g AS (SELECT * FROM seg WHERE x2 IS NOT NULL ORDER BY x1 DESC LIMIT 1)
SELECT l_orderkey, l_linenumber, round({_LERP} + 0.0000123, 4) AS value FROM q CROSS JOIN e CROSS JOIN f CROSS JOIN g JOIN seg ON seg.x1 = CASE WHEN q.x < lo THEN f.x1 WHEN q.x >= hi THEN g.x1 ELSE (SELECT max(s.x1) FROM seg s WHERE s.x1 <= q.x) END""")
def table1d_extrapolate(spark, d):
    met = tables.evaluate_1d(_quantities(spark, d), _size_prices(spark, d), step=2.0, clamp=False)
    return met.select("l_orderkey", "l_linenumber", F.round(F.col("value") + 0.0000123, 4).alias("value"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, floor(ln(l_quantity) / 0.25) AS k FROM lineitem WHERE l_quantity < 50)
SELECT l_orderkey, l_linenumber, round((3 * k + 1) * (1 - (ln(x) / 0.25 - k)) + (3 * (k + 1) + 1) * (ln(x) / 0.25 - k), 6) AS value FROM k""")
def table1d_log(spark, d):
    points = spark.range(0, 18).select(F.lit("log").alias("fn_id"), F.exp(F.col("id") * 0.25).alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    q = read(spark, d, "lineitem").where("l_quantity < 50").select("l_orderkey", "l_linenumber", F.lit("log").alias("fn_id"), F.col("l_quantity").alias("x"))
    met = tables.evaluate_1d(q, points, step=0.25, mode=tables.LOGARITHMIC)
    return met.select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


_MONO = "pts AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(sum(sum(p_size)) OVER (ORDER BY p_size) AS DOUBLE) AS y FROM part GROUP BY p_size)"
_INV = f"""{_MONO}, seg AS (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM pts),
e AS (SELECT arg_min(y, x) AS a, arg_max(y, x) AS b FROM pts), t AS (SELECT a + i * 25.0 AS t FROM e, unnest(range(0, CAST(floor((b - a) / 25.0) AS BIGINT))) u(i)),
m AS (SELECT t, x1, y1, x2, y2, row_number() OVER (PARTITION BY t ORDER BY x1) AS r FROM t JOIN seg ON y1 <= t AND t <= y2 AND y2 > y1)"""


def _cumulative(spark, d):
    from pyspark.sql import Window

    sizes = read(spark, d, "part").groupBy("p_size").agg(F.sum("p_size").alias("s"))
    return sizes.select(F.lit("cum").alias("fn_id"), F.col("p_size").cast("double").alias("x"), F.sum("s").over(Window.orderBy("p_size")).cast("double").alias("y"))


@query(f"WITH {_INV} SELECT t AS x, round(x1 * (1 - (t - y1) / (y2 - y1)) + x2 * ((t - y1) / (y2 - y1)), 6) AS y FROM m WHERE r = 1")
def table1d_invert(spark, d):
    return tables.invert(_cumulative(spark, d), step=25.0).select("x", F.round("y", 6).alias("y"))


@query(f"WITH {_INV} SELECT t AS x, round(t, 5) AS back FROM m WHERE r = 1")
def table1d_roundtrip(spark, d):
    points = _cumulative(spark, d)
    inverse = tables.invert(points, step=25.0).select("fn_id", F.col("x").alias("t"), "y")
    return tables.evaluate(inverse, points, at="y", out="back", clamp=True).select(F.col("t").alias("x"), F.round("back", 5).alias("back"))


_CELLS = """cells AS (SELECT l_quantity AS x, l_discount AS y, round(avg(l_extendedprice) + 0.00001234, 4) AS v FROM lineitem
WHERE CAST(l_quantity AS INT) % 5 = 0 AND NOT (CAST(l_quantity AS INT) = 25 AND l_discount > 0.055) AND CAST(round(l_discount * 100) AS INT) % 3 <> 1 GROUP BY 1, 2)"""


def _price_cells(spark, d):
    li = read(spark, d, "lineitem").where("cast(l_quantity as int) % 5 = 0 and not (cast(l_quantity as int) = 25 and l_discount > 0.055) and cast(round(l_discount * 100) as int) % 3 <> 1")
    return li.groupBy(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")).agg(F.round(F.avg("l_extendedprice") + 0.00001234, 4).alias("v")).select(F.lit("p").alias("fn_id"), "x", "y", "v")


def _table2d_sql(clamp: bool) -> str:
    low = "f.v1" if clamp else "f.v1 * (1 - (q.y - f.y1) / (f.y2 - f.y1)) + f.v2 * ((q.y - f.y1) / (f.y2 - f.y1))"
    high = "l.v2" if clamp else "l.v1 * (1 - (q.y - l.y1) / (l.y2 - l.y1)) + l.v2 * ((q.y - l.y1) / (l.y2 - l.y1))"
    return f"""WITH {_CELLS}, rows AS (SELECT DISTINCT x FROM cells), rb AS (SELECT min(x) AS lo, max(x) AS hi FROM rows),
s AS (SELECT x, y AS y1, v AS v1, lead(y) OVER w AS y2, lead(v) OVER w AS v2, row_number() OVER w AS n, count(*) OVER (PARTITION BY x) AS c FROM cells WINDOW w AS (PARTITION BY x ORDER BY y)),
f AS (SELECT * FROM s WHERE n = 1), l AS (SELECT * FROM s WHERE n = c - 1),
q AS (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity + 0.25, lo), hi) AS x, l_tax * 1.5 - 0.005 AS y FROM lineitem, rb),
b AS (SELECT q.*, (SELECT max(x) FROM rows r WHERE r.x <= q.x) AS r1, (SELECT min(x) FROM rows r WHERE r.x >= q.x) AS r2 FROM q),
places AS (SELECT DISTINCT r1 AS r, y FROM b UNION SELECT DISTINCT r2, y FROM b),
ev AS (SELECT q.r, q.y, CASE WHEN q.y <= f.y1 THEN {low} WHEN q.y >= l.y2 THEN {high} ELSE (SELECT any_value(s.v1 * (1 - (q.y - s.y1) / (s.y2 - s.y1)) + s.v2 * ((q.y - s.y1) / (s.y2 - s.y1))) FROM s WHERE s.x = q.r AND s.y1 <= q.y AND q.y < s.y2) END AS v
  FROM places q JOIN f ON f.x = q.r JOIN l ON l.x = q.r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN r1 = r2 THEN e1.v ELSE e1.v * (1 - (b.x - r1) / (r2 - r1)) + e2.v * ((b.x - r1) / (r2 - r1)) END, 3) AS value
FROM b JOIN ev e1 ON e1.r = b.r1 AND e1.y = b.y JOIN ev e2 ON e2.r = b.r2 AND e2.y = b.y"""


def _table2d(spark, d, clamp):
    q = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("p").alias("fn_id"), (F.col("l_quantity") + 0.25).alias("x"), (F.col("l_tax") * 1.5 - 0.005).alias("y"))
    return tables.evaluate_2d(q, _price_cells(spark, d), clamp=clamp).select("l_orderkey", "l_linenumber", F.round("value", 3).alias("value"))


@query(_table2d_sql(True))
def table2d_clamp(spark, d):
    return _table2d(spark, d, True)


@query(_table2d_sql(False))
def table2d_extrapolate_y(spark, d):
    return _table2d(spark, d, False)


@query("SELECT CAST(i * 0.5 AS DOUBLE) AS x, exp(j * ln(100.0) / 10) AS y_raw, round(i * 0.5 + exp(j * ln(100.0) / 10), 6) AS v FROM range(0, 21) a(i), range(0, 11) b(j)".replace("exp(j * ln(100.0) / 10) AS y_raw", "round(exp(j * ln(100.0) / 10), 6) AS y"))
def table2d_populate(spark, d):
    points, _ = tables.populate_2d(spark, "sum", lambda x, y: x + y, (0.0, 10.0, 21), (1.0, 100.0, 11), y_mode=tables.LOGARITHMIC)
    return points.select("x", F.round("y", 6).alias("y"), F.round("v", 6).alias("v"))


def _balances(spark, d, parity):
    s = read(spark, d, "supplier").where(F.col("s_suppkey") % 3 != parity)
    return s.groupBy(F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 4).cast("double").alias("y")).agg(F.round(F.sum("s_acctbal"), 2).alias("v")).select(F.lit("b").alias("fn_id"), "x", "y", "v")


def _merge_sql(order: str) -> str:
    side = lambda n: f"(SELECT CAST(s_nationkey AS DOUBLE) AS x, CAST(s_suppkey % 4 AS DOUBLE) AS y, round(sum(s_acctbal), 2) AS v FROM supplier WHERE s_suppkey % 3 <> {n} GROUP BY 1, 2)"
    return f"SELECT x, y, coalesce({order}) AS v FROM {side(0)} a FULL JOIN {side(1)} b USING (x, y)"


@query(_merge_sql("a.v, b.v"))
def table_merge_keep(spark, d):
    return tables.merge(_balances(spark, d, 0), _balances(spark, d, 1), overwrite=False).select("x", "y", "v")


@query(_merge_sql("b.v, a.v"))
def table_merge_overwrite(spark, d):
    return tables.merge(_balances(spark, d, 0), _balances(spark, d, 1)).select("x", "y", "v")


@query("""WITH RECURSIVE r AS (SELECT CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE) AS x, count(*) AS n, row_number() OVER (ORDER BY CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE)) AS k FROM orders GROUP BY o_orderdate),
g AS (SELECT k, x, n, 0 AS c, CASE WHEN n >= 50 THEN 0 ELSE n END AS held, CASE WHEN n >= 50 THEN 1 ELSE 0 END AS nxt FROM r WHERE k = 1
UNION ALL SELECT r.k, r.x, r.n, g.nxt, CASE WHEN g.held + r.n >= 50 THEN 0 ELSE g.held + r.n END, g.nxt + CASE WHEN g.held + r.n >= 50 THEN 1 ELSE 0 END FROM g JOIN r ON r.k = g.k + 1)
SELECT c AS chunk_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_cells FROM g GROUP BY c""")
def table_split(spark, d):
    o = read(spark, d, "orders").select(F.lit("o").alias("fn_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("x"), F.col("o_orderkey").cast("double").alias("y"), F.col("o_totalprice").alias("v"))
    return tables.split(o, 50).groupBy("chunk_id").agg(F.countDistinct("x").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"))


@query(f"WITH {_CELLS} SELECT x, y, v, true AS clamp FROM cells")
def table_json_roundtrip(spark, d):
    meta = spark.createDataFrame([("p", 5.0, 0.01, "LINEAR", "LINEAR", True)], "fn_id string, x_step double, y_step double, x_mode string, y_mode string, clamp boolean")
    points, back = table_json.decode_tables(table_json.encode_tables(_price_cells(spark, d), meta))
    return points.join(back.select("fn_id", "clamp"), "fn_id").select("x", "y", "v", "clamp")


# ---- matrices -------------------------------------------------------------------------------------------

_A = "a AS (SELECT l_suppkey % 97 AS r, l_partkey % 50 AS c, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS v FROM lineitem GROUP BY 1, 2 HAVING sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) <> 0)"
_X = "x AS (SELECT p_partkey - 1 AS i, p_retailprice AS xv FROM part WHERE p_partkey <= 50)"
_Y = "y AS (SELECT i, (i % 7) - 3.5 AS yv FROM range(0, 100) t(i))"


def _matrix(spark, d):
    li = read(spark, d, "lineitem")
    one = li.select(F.lit("m").alias("matrix_id"), (F.col("l_suppkey") % 97).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("value"))
    dims = spark.createDataFrame([("m", 100, 50)], "matrix_id string, n_rows int, n_cols int")
    return matrix.assemble(one), dims


def _prices(spark, d):
    return read(spark, d, "part").where("p_partkey <= 50").select(F.lit("m").alias("matrix_id"), (F.col("p_partkey") - 1).cast("int").alias("idx"), F.col("p_retailprice").alias("value"))


@query(f'WITH {_A} SELECT r AS "row", c AS col, v AS value FROM a'.replace('SELECT r AS "row", c AS col', 'SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col'))
def matrix_assemble(spark, d):
    return _matrix(spark, d)[0].select("row", "col", "value")


@query("""SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, v AS value FROM (SELECT l_suppkey % 97 AS r, l_partkey % 50 AS c, arg_max(CASE WHEN l_quantity < 10 THEN 0 ELSE l_quantity END, l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY 1, 2) WHERE v <> 0""")
def matrix_set(spark, d):
    w = read(spark, d, "lineitem").select(F.lit("m").alias("matrix_id"), (F.col("l_suppkey") % 97).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col"), F.when(F.col("l_quantity") < 10, 0.0).otherwise(F.col("l_quantity")).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return matrix.assign(w).select("row", "col", "value")


@query(f'WITH {_A} SELECT CAST(i AS INT) AS "row", CAST(j AS INT) AS col, coalesce(v, 0) AS value FROM range(0, 100) t(i) CROSS JOIN range(0, 3) s(j) LEFT JOIN a ON a.r = i AND a.c = j')
def matrix_get(spark, d):
    a, _ = _matrix(spark, d)
    cells = spark.range(100).select(F.lit("m").alias("matrix_id"), F.col("id").cast("int").alias("row"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("col"))
    return matrix.get(a, cells).select("row", "col", "value")


@query(f"WITH {_A}, {_X} SELECT CAST(t.i AS INT) AS idx, round(coalesce(sum(v * xv), 0), 4) AS value FROM range(0, 100) t(i) LEFT JOIN a ON a.r = t.i LEFT JOIN x ON x.i = a.c GROUP BY t.i")
def spmv(spark, d):
    a, dims = _matrix(spark, d)
    return matrix.multiply(a, _prices(spark, d), dims).select("idx", F.round("value", 4).alias("value"))


@query(f"WITH {_A}, {_Y} SELECT CAST(t.i AS INT) AS idx, round(coalesce(sum(v * yv), 0), 4) AS value FROM range(0, 50) t(i) LEFT JOIN a ON a.c = t.i LEFT JOIN y ON y.i = a.r GROUP BY t.i")
def spmv_t(spark, d):
    a, dims = _matrix(spark, d)
    y = spark.range(100).select(F.lit("m").alias("matrix_id"), F.col("id").cast("int").alias("idx"), ((F.col("id") % 7) - 3.5).alias("value"))
    return matrix.transpose_multiply(a, y, dims).select("idx", F.round("value", 4).alias("value"))


@query("SELECT round(sum(p_retailprice * p_retailprice), 3) AS dot FROM part WHERE p_partkey <= 50")
def dot(spark, d):
    return matrix.dot(_prices(spark, d), _prices(spark, d)).select(F.round("dot", 3).alias("dot"))


@query(f"WITH {_A} SELECT CAST(r AS INT) AS \"row\", CAST(c AS INT) AS col, v AS value, row_number() OVER (ORDER BY r, c) - 1 AS pos FROM a")
def matrix_compress(spark, d):
    return matrix.compressed(_matrix(spark, d)[0]).select("row", "col", "value", F.col("pos").cast("long").alias("pos"))


@query("SELECT l_returnflag AS flag, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY l_returnflag")
def lsq_fit(spark, d):
    sums = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("matrix_id")).agg(*(F.avg(e).alias(n) for e, n in ((F.lit(1.0), "n"), (F.col("l_quantity"), "sx"), (F.col("l_quantity") ** 2, "sxx"), (F.col("l_extendedprice"), "sy"), (F.col("l_quantity") * F.col("l_extendedprice"), "sxy"))))
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.col(v).alias("value"))
    a = sums.select("matrix_id", F.explode(F.array(cell(0, 0, "n"), cell(0, 1, "sx"), cell(1, 0, "sx"), cell(1, 1, "sxx"))).alias("e")).select("matrix_id", "e.*")
    b = sums.select("matrix_id", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.col("sy").alias("value")), F.struct(F.lit(1).alias("idx"), F.col("sxy").alias("value")))).alias("e")).select("matrix_id", "e.*")
    dims = sums.select("matrix_id", F.lit(2).alias("n_rows"), F.lit(2).alias("n_cols"))
    x = solvers.solve_batch(a, b, dims, tol=1e-9)
    return x.groupBy(F.col("matrix_id").alias("flag")).agg(F.round(F.max(F.when(F.col("idx") == 0, F.col("value"))), 2).alias("intercept"), F.round(F.max(F.when(F.col("idx") == 1, F.col("value"))), 3).alias("slope"))


@query("""WITH s AS (SELECT c_nationkey AS k, 4 + count(*) * 1.0 AS p, 1.0 + c_nationkey % 3 AS q, 5 + count(*) * 2.0 AS r, sum(c_acctbal) / 1000 AS u, count(*) * 1.0 AS w FROM customer GROUP BY c_nationkey)
SELECT CAST(k AS VARCHAR) AS nation, round((u * r - q * w) / (p * r - q * q), 6) AS x0, round((p * w - q * u) / (p * r - q * q), 6) AS x1 FROM s""")
def cg_2x2(spark, d):
    s = read(spark, d, "customer").groupBy("c_nationkey").agg((4 + F.count(F.lit(1)) * 1.0).alias("p"), (5 + F.count(F.lit(1)) * 2.0).alias("r"), (F.sum("c_acctbal") / 1000).alias("u"), (F.count(F.lit(1)) * 1.0).alias("w"))
    s = s.withColumn("q", 1.0 + F.col("c_nationkey") % 3).withColumn("matrix_id", F.col("c_nationkey").cast("string"))
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.col(v).cast("double").alias("value"))
    a = s.select("matrix_id", F.explode(F.array(cell(0, 0, "p"), cell(0, 1, "q"), cell(1, 0, "q"), cell(1, 1, "r"))).alias("e")).select("matrix_id", "e.*")
    b = s.select("matrix_id", F.explode(F.array(cell(0, 0, "u"), cell(1, 0, "w"))).alias("e")).select("matrix_id", F.col("e.row").alias("idx"), "e.value")
    x = solvers.solve_batch(a, b, s.select("matrix_id", F.lit(2).alias("n_rows"), F.lit(2).alias("n_cols")), method="cg", tol=1e-12)
    return x.groupBy(F.col("matrix_id").alias("nation")).agg(*(F.round(F.max(F.when(F.col("idx") == k, F.col("value"))), 6).alias(f"x{k}") for k in (0, 1)))


@query("SELECT CAST(i AS INT) AS idx, CAST(i * 0.5 + 1 AS DOUBLE) AS value FROM range(0, 6) t(i)")
def lsq_distributed(spark, d):
    n = 6
    ids = spark.range(n).select(F.lit("t").alias("matrix_id"), F.col("id").cast("int").alias("row"))
    off = lambda k, v: ids.select("matrix_id", "row", (F.col("row") + k).alias("col"), F.lit(v).alias("value")).where(f"col between 0 and {n - 1}")
    a = matrix.assemble(off(0, 4.0), off(1, -1.0), off(-1, -1.0))
    dims = spark.createDataFrame([("t", n, n)], "matrix_id string, n_rows int, n_cols int")
    x = ids.select("matrix_id", F.col("row").alias("idx"), (F.col("row") * 0.5 + 1).alias("value"))
    return solvers.solve_distributed(a, matrix.multiply(a, x, dims), dims, most=12).select("idx", F.round("value", 6).alias("value"))


# ---- networks -------------------------------------------------------------------------------------------

_NODE = "model_id string, node_id string, domain string, kind string, fixed_value double, init_value double, seq long"


def _nodes(base: DataFrame, *rows: tuple) -> DataFrame:
    """rows: (node_id, domain, kind, fixed value column or None[, initial value])."""
    parts = [F.struct(F.lit(n).alias("node_id"), F.lit(dm).alias("domain"), F.lit(k).alias("kind"), (F.lit(None).cast("double") if v is None else v.cast("double")).alias("fixed_value"), F.lit(float(init[0]) if init else 0.0).alias("init_value"), F.lit(s).cast("long").alias("seq")) for s, (n, dm, k, v, *init) in enumerate(rows)]
    return base.select("model_id", F.explode(F.array(*parts)).alias("n")).select("model_id", "n.*")


def _components(base: DataFrame, *rows: tuple) -> DataFrame:
    """rows: (type, domain, ports, {name: column})."""
    parts = [F.struct(F.lit(f"c{s}").alias("comp_id"), F.lit(t).alias("type"), F.array(*[F.lit(p) for p in ports]).alias("ports"), F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v.cast("double"))]).alias("params"), F.lit(dm).alias("domain"), F.lit(s).cast("long").alias("seq")) for s, (t, dm, ports, params) in enumerate(rows)]
    return base.select("model_id", F.explode(F.array(*parts)).alias("c")).select("model_id", "c.*")


def _value(solved: DataFrame, node: str, domain: str, out: str, digits: int = 5, shift: float = 0.0) -> DataFrame:
    return solved.where((F.col("node_id") == node) & (F.col("domain") == domain)).select("model_id", F.round(F.col("value") + shift, digits).alias(out))


M, H, T = network.MECHANICAL, network.HYDRAULIC, network.THERMAL


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS model_id, CAST(n_nationkey AS VARCHAR) AS node_id, round(n_regionkey * 10 + coalesce(q, 0) / (2.0 + n_nationkey), 3) AS t
FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) / 1000 AS q FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def net_star(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("model_id"), F.col("n_nationkey").alias("k"))
    hub = read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("model_id"), F.lit("hub").alias("node_id"), F.lit(T).alias("domain"), F.lit("fixed").alias("kind"), (F.col("r_regionkey") * 10.0).alias("fixed_value"), F.lit(0.0).alias("init_value"), F.lit(0).cast("long").alias("seq"))
    own = nation.select("model_id", F.col("k").cast("string").alias("node_id"), F.lit(T).alias("domain"), F.lit("unknown").alias("kind"), F.lit(None).cast("double").alias("fixed_value"), F.lit(0.0).alias("init_value"), (F.col("k") + 1).cast("long").alias("seq"))
    q = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.sum("c_acctbal") / 1000).alias("q"))
    name = F.col("k").cast("string")
    links = nation.select("model_id", F.concat(F.lit("l"), name).alias("comp_id"), F.lit("link").alias("type"), F.array(name, F.lit("hub")).alias("ports"), F.create_map(F.lit("g"), 2.0 + F.col("k")).alias("params"), F.lit(T).alias("domain"), F.col("k").cast("long").alias("seq"))
    pushes = nation.join(q, "k").select("model_id", F.concat(F.lit("s"), name).alias("comp_id"), F.lit("source").alias("type"), F.array(name).alias("ports"), F.create_map(F.lit("q"), F.col("q")).alias("params"), F.lit(T).alias("domain"), (F.col("k") + 100).cast("long").alias("seq"))
    out = network.steady_state(hub.unionByName(own), links.unionByName(pushes))
    return out.where("node_id <> 'hub'").select("model_id", "node_id", F.round("value", 3).alias("t"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS model_id, round((3 * (c_acctbal / 100) + (1.0 + c_custkey % 4) * 5) / (3 + (1.0 + c_custkey % 4)) + 0.00000123, 5) AS mid FROM customer")
def net_divider(spark, d):
    base = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("model_id"), (F.col("c_acctbal") / 100).alias("v"), (1.0 + F.col("c_custkey") % 4).alias("g"))
    nodes = _nodes(base, ("top", M, "fixed", F.col("v")), ("mid", M, "unknown", None), ("end", M, "fixed", F.lit(5.0)))
    comps = _components(base, ("link", M, ("top", "mid"), {"g": F.lit(3.0)}), ("link", M, ("mid", "end"), {"g": F.col("g")}))
    return _value(network.steady_state(nodes, comps), "mid", M, "mid", shift=0.00000123)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS model_id, round(v - v * (1 / 4.0) / r, 5) AS a, round(v - v * (1 / 4.0 + 1 / 3.0) / r, 5) AS b, round(v * (1 / g) / r, 5) AS c FROM (SELECT s_suppkey, s_acctbal / 100 AS v, 1.0 + s_suppkey % 6 AS g, 1 / 4.0 + 1 / 3.0 + 1 / 2.0 + 1 / (1.0 + s_suppkey % 6) AS r FROM supplier)")
def net_chain(spark, d):
    base = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), (F.col("s_acctbal") / 100).alias("v"), (1.0 + F.col("s_suppkey") % 6).alias("g"))
    nodes = _nodes(base, ("top", H, "fixed", F.col("v")), *((n, H, "unknown", None) for n in "abc"), ("end", H, "fixed", F.lit(0.0)))
    comps = _components(base, *(("link", H, p, {"g": g}) for p, g in ((("top", "a"), F.lit(4.0)), (("a", "b"), F.lit(3.0)), (("b", "c"), F.lit(2.0)), (("c", "end"), F.col("g")))))
    out = network.steady_state(nodes, comps)
    return out.where(F.col("node_id").isin("a", "b", "c")).groupBy("model_id").agg(*(F.round(F.max(F.when(F.col("node_id") == n, F.col("value"))), 5).alias(n) for n in "abc"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_id, CAST(p_size * (1.0 + p_partkey % 3) AS DOUBLE) AS w FROM part")
def net_gear(spark, d):
    base = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("model_id"), F.col("p_size").alias("v"), (1.0 + F.col("p_partkey") % 3).alias("r"))
    nodes = _nodes(base, ("in", M, "fixed", F.col("v")), ("out", M, "unknown", None), ("k", M, "constraint", None))
    comps = _components(base, ("gear", M, ("in", "out", "k"), {"r": F.col("r")}), ("link", M, ("out", "in"), {"g": F.lit(0.0)}))
    return _value(network.steady_state(nodes, comps), "out", M, "w")


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_id, round(2.0 * pow(p_size - 4.0, 2) / 1.5, 4) AS t FROM part")
def net_damper_heat(spark, d):
    base = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("model_id"), F.col("p_size").alias("v"))
    nodes = _nodes(base, ("a", M, "fixed", F.col("v")), ("b", M, "fixed", F.lit(4.0)), ("heat", T, "unknown", None), ("air", T, "fixed", F.lit(0.0)))
    comps = _components(base, ("damper", M, ("a", "b", "heat"), {"g": F.lit(2.0)}), ("link", T, ("heat", "air"), {"g": F.lit(1.5)}))
    return _value(network.steady_state(nodes, comps), "heat", T, "t", 4)


@query("SELECT CAST(p_partkey AS VARCHAR) AS model_id, CAST(3.0 * p_size AS DOUBLE) AS w, round(4.0 * pow(3.0 * p_size, 2) / 2.0, 3) AS t FROM part")
def net_gear_damper(spark, d):
    base = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("model_id"), F.col("p_size").alias("v"))
    nodes = _nodes(base, ("in", M, "fixed", F.col("v")), ("out", M, "unknown", None), ("ground", M, "fixed", F.lit(0.0)), ("k", M, "constraint", None), ("heat", T, "unknown", None), ("air", T, "fixed", F.lit(0.0)))
    comps = _components(base, ("gear", M, ("in", "out", "k"), {"r": F.lit(3.0)}), ("damper", M, ("out", "ground", "heat"), {"g": F.lit(4.0)}), ("link", T, ("heat", "air"), {"g": F.lit(2.0)}))
    out = network.steady_state(nodes, comps)
    of = lambda node, domain: F.max(F.when((F.col("node_id") == node) & (F.col("domain") == domain), F.col("value")))
    return out.where(F.col("node_id").isin("out", "heat")).groupBy("model_id").agg(F.round(of("out", M), 5).alias("w"), F.round(of("heat", T), 3).alias("t"))


_COO = """WITH b AS (SELECT CAST(s_suppkey AS VARCHAR) AS model_id, s_acctbal AS v, 1.0 + s_suppkey % 6 AS g FROM supplier)
SELECT model_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(sum(v) AS DOUBLE) AS value FROM (
SELECT model_id, 0 AS r, 0 AS c, 1.0 AS v FROM b UNION ALL SELECT model_id, 1, 1, g FROM b UNION ALL SELECT model_id, 1, 0, -g FROM b
UNION ALL SELECT model_id, 1, 3, 2.5 FROM b UNION ALL SELECT model_id, 2, 3, -1.0 FROM b UNION ALL SELECT model_id, 3, 1, 2.5 FROM b UNION ALL SELECT model_id, 3, 2, -1.0 FROM b) GROUP BY 1, 2, 3"""


@query(_COO)
def net_assemble_coo(spark, d):
    base = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), F.col("s_acctbal").alias("v"), (1.0 + F.col("s_suppkey") % 6).alias("g"))
    nodes = _nodes(base, ("in", M, "fixed", F.col("v")), ("a", M, "unknown", None), ("b", M, "unknown", None), ("k", M, "constraint", None))
    comps = _components(base, ("link", M, ("in", "a"), {"g": F.col("g")}), ("gear", M, ("a", "b", "k"), {"r": F.lit(2.5)}))
    return network.assemble(nodes, comps)[0].select("model_id", "row", "col", "value")


@query("""WITH RECURSIVE t AS (SELECT CAST(s_suppkey AS VARCHAR) AS m, 400.0 + s_suppkey % 50 AS hot, CAST(300 AS DOUBLE) AS x, 0 AS k FROM supplier
UNION ALL SELECT m, hot, (g * hot + 5.0 * 290) / (g + 5.0), k + 1 FROM (SELECT *, 4 * 5.670374419e-8 * 0.9 * 2.0 * pow((hot + x) / 2, 3) AS g FROM t) WHERE k < 40)
SELECT m AS model_id, round(x, 3) AS t FROM t WHERE k = 40""")
def net_radiation(spark, d):
    base = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), (400.0 + F.col("s_suppkey") % 50).alias("hot"))
    nodes = _nodes(base, ("hot", T, "fixed", F.col("hot")), ("body", T, "unknown", None, 300.0), ("air", T, "fixed", F.lit(290.0)))
    comps = _components(base, ("radiation", T, ("hot", "body"), {"area": F.lit(2.0), "emissivity": F.lit(0.9)}), ("link", T, ("body", "air"), {"g": F.lit(5.0)}))
    return _value(network.steady_state(nodes, comps, tol=1e-7), "body", T, "t", 3)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS model_id, round(((2.0 + 0.5 * m) * 350 + 3.0 * 290) / (2.0 + 0.5 * m + 3.0 + 0.0), 4) AS t FROM (SELECT s_suppkey, CAST(s_suppkey % 5 AS DOUBLE) AS m FROM supplier)")
def net_convection(spark, d):
    # the wall is downstream of nothing: flow leaves the fluid node for the wall with a negative rate
    base = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), (F.col("s_suppkey") % 5).cast("double").alias("m"))
    nodes = _nodes(base, ("wall", T, "unknown", None), ("fluid", T, "fixed", F.lit(350.0)), ("fluid", H, "fixed", F.col("m")), ("air", T, "fixed", F.lit(290.0)))
    comps = _components(base, ("convection", T, ("wall", "fluid"), {"cp": F.lit(0.0), "h0": F.lit(2.0), "h1": F.lit(0.5)}), ("link", T, ("wall", "air"), {"g": F.lit(3.0)}))
    return _value(network.steady_state(nodes, comps), "wall", T, "t", 4)


@query("SELECT part, CAST(n AS BIGINT) AS n, round(g, 4) AS g FROM (VALUES ('vertical', 5000, 50 * 0.005 / (0.05 / 30) * 3000 + 385 * 0.005 / (0.1 / 20) * 2000), ('horizontal', 51 * 99, 99 * (50 * (0.05 / 30) / 0.005 * 29.5 + 385 * (0.1 / 20) / 0.005 * 20)), ('interface', 99, 99 * (1 / (1 / (50 * (0.05 / 60) / 0.005) + 1 / (385 * (0.1 / 40) / 0.005))))) v(part, n, g)")
def plate_links(spark, d):
    layers = spark.createDataFrame([("p", 0, "STEEL", 0.5, 0.05, 100, 30), ("p", 1, "COPPER", 0.5, 0.1, 100, 20)], "model_id string, layer int, material string, length double, thickness double, nx int, ny int")
    return network.plate_links(layers).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("g"), 4).alias("g"))


@query()
def net_heat_exchanger(spark, d):
    base = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model_id"), F.lit("i1").alias("in1"), F.lit("o1").alias("out1"), F.lit("i2").alias("in2"), F.lit("o2").alias("out2"), *(F.lit(v).alias(n) for n, v in (("cp1", 2.0), ("cp2", 2.0), ("ha1", 8.0), ("ha2", 8.0), ("r1", 4.0), ("r2", 4.0))), F.lit(1000).cast("long").alias("seq"))
    inner, comps = network.heat_exchanger(base, 4)
    ends = []
    for s, hot in ((1, 400.0), (2, 300.0)):
        ends += [(f"i{s}", T, "fixed", F.lit(hot)), (f"i{s}", H, "fixed", F.lit(8.0)), (f"o{s}", T, "unknown", None), (f"o{s}", H, "fixed", F.lit(0.0))]
    ground = _components(base, *(("advection", T, (f"o{s}", f"o{s}"), {"cp": F.lit(0.0), "g": F.lit(0.0)}) for s in (1, 2)))
    # an outlet carries on what comes in: its row needs a diagonal of the stream's own rate
    sinks = _components(base, *(("link", T, (f"o{s}", f"i{s}"), {"g": F.lit(0.5)}) for s in (1, 2)))
    out = network.steady_state(_nodes(base, *ends).unionByName(inner), comps.unionByName(sinks).unionByName(ground.where("false")))
    return out.select("model_id", "node_id", "domain", F.round("value", 4).alias("value"), "converged")


# ---- fluids ---------------------------------------------------------------------------------------------


def _fluid_tables(spark):
    """Linear in enthalpy and pressure, so that lookups are exact: T = h / 4000 + p / 1e6, x = h / 4e6, s = h / 300 + 2, h = 300 (s - 2)."""
    grid = lambda fn, f, hi: tables.populate_2d(spark, fn, f, (0.0, hi, 41), (1e5, 5e6, 15))[0]
    return grid("hp_t", lambda h, p: h / 4000 + p / 1e6, 4e6).unionByName(grid("hp_x", lambda h, p: h / 4e6, 4e6)).unionByName(grid("hp_s", lambda h, p: h / 300 + 2.0 - p / 1e5, 4e6)).unionByName(grid("sp_h", lambda s, p: 300 * (s - 2.0 + p / 1e5), 13000.0))


def _states(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.lit(300.0).alias("temperature"), (F.col("o_totalprice") * 4 + 1e5).alias("pressure"), (F.col("o_totalprice") * 5).alias("specific_enthalpy"), F.lit(0.5).alias("vapor_quality"))


@query("""SELECT o_orderkey, round(CASE WHEN q = 0 THEN 300 ELSE (h + q) / 4000 + p / 1e6 END + 0.000000123, 6) AS temperature, round(p, 4) AS pressure, round(h + q, 4) AS specific_enthalpy, round(CASE WHEN q = 0 THEN 0.5 ELSE (h + q) / 4e6 END + 1.23e-9, 8) AS vapor_quality
FROM (SELECT o_orderkey, o_totalprice * 4 + 1e5 AS p, o_totalprice * 5 AS h, (o_orderkey % 3) * 1000.0 AS q FROM orders)""")
def fluid_isobaric(spark, d):
    out = fluid.isobaric(_states(spark, d), _fluid_tables(spark), (F.col("o_orderkey") % 3) * 1000.0)
    return out.select("o_orderkey", F.round(F.col("temperature") + 0.000000123, 6).alias("temperature"), F.round("pressure", 4).alias("pressure"), F.round("specific_enthalpy", 4).alias("specific_enthalpy"), F.round(F.col("vapor_quality") + 1.23e-9, 8).alias("vapor_quality"))


@query("""SELECT o_orderkey, round(CASE WHEN m1 = 0 THEN 350 ELSE h / 4000 + p / 1e6 END + 0.000000123, 6) AS temperature, round(CASE WHEN m1 = 0 THEN 2e5 ELSE p END, 4) AS pressure, round(CASE WHEN m1 = 0 THEN 1e6 ELSE h END, 4) AS specific_enthalpy
FROM (SELECT o_orderkey, CAST(o_orderkey % 4 AS DOUBLE) AS m1, (h1 * (o_orderkey % 4) + 1e6 * 2.0) / ((o_orderkey % 4) + 2.0) AS h, (p1 * (o_orderkey % 4) + 2e5 * 2.0) / ((o_orderkey % 4) + 2.0) AS p FROM (SELECT o_orderkey, o_totalprice * 5 AS h1, o_totalprice * 4 + 1e5 AS p1 FROM orders))""")
def fluid_mix(spark, d):
    s = _states(spark, d)
    pairs = s.select("o_orderkey", (F.col("o_orderkey") % 4).cast("double").alias("m1"), F.col("specific_enthalpy").alias("h1"), F.col("pressure").alias("p1"), F.col("temperature").alias("t1"), F.col("vapor_quality").alias("x1"), F.lit(2.0).alias("m2"), F.lit(1e6).alias("h2"), F.lit(2e5).alias("p2"), F.lit(350.0).alias("t2"), F.lit(0.2).alias("x2"))
    return fluid.mix(pairs, _fluid_tables(spark)).select("o_orderkey", F.round(F.col("temperature") + 0.000000123, 6).alias("temperature"), F.round("pressure", 4).alias("pressure"), F.round("specific_enthalpy", 4).alias("specific_enthalpy"))


@query("""SELECT o_orderkey, round(p / 2.0, 4) AS pressure, round((h / 300 + 2.0 - p / 1e5 - 2.0 + p / 2.0 / 1e5) * 300 + 0.00123, 2) AS specific_enthalpy FROM (SELECT o_orderkey, o_totalprice * 4 + 3e5 AS p, o_totalprice * 5 AS h FROM orders)""")
def fluid_isentropic(spark, d):
    s = _states(spark, d).withColumn("pressure", F.col("pressure") + 2e5)
    out = fluid.isentropic(s, _fluid_tables(spark), F.lit(2.0))
    return out.select("o_orderkey", F.round("pressure", 4).alias("pressure"), F.round(F.col("specific_enthalpy") + 0.00123, 2).alias("specific_enthalpy"))


@query("""SELECT o_orderkey, greatest(o_totalprice - 1e5, 0) AS temperature, o_totalprice AS pressure, -o_totalprice AS specific_enthalpy, CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(least((o_orderkey % 5) / 2.0 - 0.5, 1.0), 0.0) AS DOUBLE) END AS vapor_quality
FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders)""")
def fluid_state_text(spark, d):
    """States written as text and read back: beyond their ranges in part, and without a quality for every seventh order."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    quality = F.when(k % 7 != 0, k % 5 / 2.0 - 0.5)
    states = read(spark, d, "orders").select("o_orderkey", (price - 1e5).alias("temperature"), price.alias("pressure"), (-price).alias("specific_enthalpy"), quality.alias("vapor_quality"))
    return states.select("o_orderkey", fluid.encoded().alias("text")).select("o_orderkey", *fluid.decoded(F.col("text")))


@query("SELECT CAST(s AS DOUBLE) AS s, CAST(k AS INT) AS k, round(300 * (s - 2.0 + p / 1e5), 3) AS h FROM (SELECT 3000.0 + s * 500 AS s, k, 2e5 * pow(CAST(1.01 AS DOUBLE), k) AS p FROM range(0, 8) a(s), range(0, 162) b(k))".replace("CAST(k AS INT) AS k", "CAST(k AS INT) AS k"))
def fluid_isentropes(spark, d):
    lines = spark.range(8).select((3000.0 + F.col("id") * 500).alias("s"))
    out = fluid.isentropes(lines, _fluid_tables(spark), 2e5, 1e6)
    return out.select("s", F.round(F.log(F.col("p") / 2e5) / F.log(F.lit(1.01))).cast("int").alias("k"), F.round("h", 3).alias("h"))


# ---- keyed values, plots, voxels ------------------------------------------------------------------------


@query("""WITH direct AS (SELECT p_brand AS k, round(avg(p_size), 3) AS v FROM part WHERE p_brand LIKE '%1' GROUP BY 1), tags AS (SELECT p_type AS t, round(avg(p_retailprice), 3) AS v FROM part WHERE p_size > 25 GROUP BY 1),
m AS (SELECT DISTINCT p_type AS t, p_brand AS k FROM part), tv AS (SELECT m.k, arg_min(tags.v, m.t) AS v FROM m JOIN tags ON tags.t = m.t GROUP BY m.k)
SELECT p_partkey, coalesce(d.v, tv.v, -1.0) AS value FROM part LEFT JOIN direct d ON d.k = p_brand LEFT JOIN tv ON tv.k = p_brand""")
def floatmap_lookup(spark, d):
    part = read(spark, d, "part")
    direct = part.where("p_brand like '%1'").groupBy(F.col("p_brand").alias("key")).agg(F.round(F.avg("p_size"), 3).alias("value")).select("key", F.lit(False).alias("is_tag"), "value")
    tags = part.where("p_size > 25").groupBy(F.col("p_type").alias("key")).agg(F.round(F.avg("p_retailprice"), 3).alias("value")).select("key", F.lit(True).alias("is_tag"), "value")
    members = part.select(F.col("p_type").alias("tag"), F.col("p_brand").alias("id")).distinct()
    return lookup.lookup(part.select("p_partkey", "p_brand"), direct.unionByName(tags), members, key="p_brand", default=-1.0).select("p_partkey", "value")


@query("SELECT k AS key, tag AS is_tag, CAST(v AS DOUBLE) AS value FROM (VALUES ('a', false, 10.0), ('t', true, 7.0), ('n', false, 4.0)) x(k, tag, v)")
def floatmap_reload(spark, d):
    files = spark.createDataFrame([('{"replace": false, "values": {"a": 1.0, "b": 2.0, "#t": 7.0}}',), ('{"replace": true, "values": {"a": 10.0, "n": 4.0}}',)], "json string")
    values = table_json.decode_values(files)
    old, new = values.where("not replace").select("key", "is_tag", "value"), values.where("replace").select("key", "is_tag", "value")
    return lookup.reload(old, new, replace=True)


_PLOT = "SELECT event_type AS plot_id, CAST(user_id AS DOUBLE) AS x, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS y FROM events"


def _series(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("plot_id"), F.col("user_id").cast("double").alias("x"), F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("y"), "event_id")


@query(f"SELECT plot_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM ({_PLOT}) GROUP BY plot_id")
def plot_extents(spark, d):
    return plot.extents(_series(spark, d).drop("event_id"))


@query(f"""WITH s AS (SELECT event_id, event_type AS plot_id, CAST(user_id AS DOUBLE) AS x, value AS y FROM events WHERE event_id % 50 <> 0), b AS (SELECT plot_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({_PLOT}) GROUP BY plot_id)
SELECT event_id, 50 + CAST(trunc(700.0 * ((x - x0) / (x1 - x0))) AS INT) AS px, 550 - CAST(trunc(500.0 * ((log10(y) - log10(y0)) / (log10(y1) - log10(y0)))) AS INT) AS py FROM s JOIN b USING (plot_id)""")
def plot_normalize(spark, d):
    s = _series(spark, d)
    return plot.pixels(s, plot.extents(s.drop("event_id")), y_log=True).select("event_id", "px", "py")


@query(f"SELECT plot_id, CAST(i AS INT) AS tick, round(y0 + i * (y1 - y0) / 10.0, 8) AS value FROM (SELECT plot_id, min(y) AS y0, max(y) AS y1 FROM ({_PLOT}) GROUP BY plot_id), range(0, 11) t(i)")
def plot_ticks(spark, d):
    return plot.ticks(plot.extents(_series(spark, d).drop("event_id")), "y_min", "y_max").select("plot_id", "tick", F.round("value", 8).alias("value"))


@query("SELECT o_orderkey, CASE WHEN v >= 1e4 OR v < 1e-2 THEN printf('%.1e', v) WHEN v >= 10 THEN printf('%.0f', v) ELSE printf('%.3f', v) END AS label FROM (SELECT o_orderkey, (o_totalprice + 0.123) * pow(10.0, -(o_orderkey % 9)) AS v FROM orders)")
def plot_format(spark, d):
    v = (F.col("o_totalprice") + 0.123) * F.pow(F.lit(10.0), -(F.col("o_orderkey") % 9))
    return read(spark, d, "orders").select("o_orderkey", units.axis_number(v).alias("label"))


@query("SELECT c_custkey, CAST(abs(trunc((sin(c_custkey + 1) * 10000) % 255)) AS INT) AS red, CAST(abs(trunc((cos(c_custkey + 2) * 10000) % 255)) AS INT) AS green, CAST(abs(trunc((sin(c_custkey + 3) * 10000) % 255)) AS INT) AS blue FROM customer")
def plot_colors(spark, d):
    return read(spark, d, "customer").select("c_custkey", *plot.colors(F.col("c_custkey")))


@query()
def plot_heatmap(spark, d):
    cells = read(spark, d, "lineitem").groupBy((F.col("l_quantity") % 10).cast("int").alias("i"), (F.round(F.col("l_discount") * 100) % 11).cast("int").alias("j")).agg(F.avg("l_extendedprice").alias("value"))
    return plot.heatmap(cells.select(F.lit("h").alias("plot_id"), "i", "j", "value"))


def _voxels(spark, d):
    """A column of cells a nation: a controller at height key % 13 and cells above that point down to it."""
    n = read(spark, d, "nation").select(F.lit("g").alias("grid_id"), (F.col("n_nationkey") * 2).alias("x"), F.col("n_nationkey").alias("k"))
    up = n.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") % 13)))
    return up.select("grid_id", "x", "y", F.lit(0).alias("z"), F.when(F.col("y") == 0, "controller").otherwise("structure").alias("kind"), F.when(F.col("y") > 0, "down").alias("facing"), (F.col("k") % 2).cast("string").alias("structure"))


@query("SELECT n_nationkey * 2 AS x, CAST(y AS INT) AS y, n_nationkey * 2 AS mx, CAST(greatest(y - 10, 0) AS INT) AS my, 0 AS mz, y <= 9 AS found FROM nation, unnest(range(1, n_nationkey % 13 + 1)) t(y)")
def voxel_master(spark, d):
    return voxel.masters(_voxels(spark, d)).select("x", "y", "mx", "my", "mz", "found")


@query("SELECT n_nationkey * 2 AS x, CAST(y AS INT) AS y, y > 1 OR n_nationkey % 2 = n_nationkey % 2 AS valid FROM nation, unnest(range(1, n_nationkey % 13 + 1)) t(y)")
def voxel_valid(spark, d):
    return voxel.valid(_voxels(spark, d)).select("x", "y", "valid")


@query("SELECT s_suppkey AS x, s_suppkey % 3 = 0 AND s_suppkey % 2 = s_suppkey % 4 // 2 AS valid FROM supplier")
def voxel_valid_pointers(spark, d):
    """A controller and one cell above it a supplier: only some point down, and some belong to another structure."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("y"))
    facing = F.when(k % 3 == 0, "down").when(k % 3 == 1, "up").otherwise("east")
    other = F.when(F.col("y") == 0, k % 2).otherwise((k % 4 / 2).cast("int")).cast("string")
    cells = s.select(F.lit("g").alias("grid_id"), (k * 2).alias("x"), "y", F.lit(0).alias("z"), F.when(F.col("y") == 0, "controller").otherwise("structure").alias("kind"), facing.alias("facing"), other.alias("structure"))
    return voxel.valid(cells).select((F.col("x") / 2).cast("long").alias("x"), "valid")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS grid_id, CAST(-a AS INT) AS x, CAST(-b AS INT) AS y, CAST(-c AS INT) AS z, CAST(a + b + c AS INT) AS depth, CASE WHEN a > 0 THEN 'east' WHEN c > 0 THEN 'south' ELSE 'up' END AS facing
FROM nation, unnest(range(0, n_nationkey % 3 + 1)) t(a), unnest(range(0, n_nationkey % 4 + 1)) u(b), range(0, 2) v(c) WHERE a + b + c > 0""")
def voxel_fill(spark, d):
    k = F.col("n_nationkey")
    zero = [F.lit(0).alias(n) for n in ("cx", "cy", "cz", "x0", "y0", "z0")]
    boxes = read(spark, d, "nation").select(k.cast("string").alias("grid_id"), *zero, (k % 3 + 1).alias("sx"), (k % 4 + 1).alias("sy"), F.lit(2).alias("sz"))
    return voxel.fill(boxes).select("grid_id", "x", "y", "z", "depth", "facing")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, CAST(-a AS INT) AS x, 0 AS y, 0 AS z, CAST(a AS INT) AS depth, 'east' AS facing FROM supplier, unnest(range(1, least(101, 80 + s_suppkey % 50) + 1)) t(a) WHERE s_suppkey % 7 > 0 OR a < 60")
def voxel_fill_long(spark, d):
    """Corridors longer than a walk, every seventh of them with a cell in the way."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier")
    zero = [F.lit(0).alias(n) for n in ("cx", "cy", "cz", "x0", "y0", "z0")]
    boxes = s.select(k.cast("string").alias("grid_id"), *zero, (k % 50 + 81).cast("int").alias("sx"), F.lit(1).alias("sy"), F.lit(1).alias("sz"))
    walls = s.where(k % 7 == 0).select(k.cast("string").alias("grid_id"), F.lit(-60).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.lit("structure").alias("kind"))
    return voxel.fill(boxes, walls).select("grid_id", "x", "y", "z", "depth", "facing")


@query("""SELECT CAST(n_nationkey AS INT) AS box_id, NOT EXISTS (SELECT 1 FROM nation m, unnest(range(0, m.n_nationkey % 13 + 1)) t(y) WHERE m.n_nationkey * 2 BETWEEN n.n_nationkey AND n.n_nationkey + 1 AND y BETWEEN 5 AND 7) AS free FROM nation n""")
def voxel_placeable(spark, d):
    k = F.col("n_nationkey")
    boxes = read(spark, d, "nation").select(k.cast("int").alias("box_id"), F.lit("g").alias("grid_id"), k.cast("int").alias("x0"), F.lit(5).alias("y0"), F.lit(0).alias("z0"), F.lit(2).alias("sx"), F.lit(3).alias("sy"), F.lit(1).alias("sz"))
    return voxel.placeable(boxes, _voxels(spark, d)).select("box_id", "free")


@query("SELECT n_nationkey * 2 AS x, 1 AS y, 'up' AS facing FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 13 < 1 UNION ALL SELECT n_nationkey * 2, 1, 'down' FROM nation WHERE NOT (n_nationkey % 5 = 0 OR n_nationkey % 13 < 1) AND false")
def voxel_template(spark, d):
    k = F.col("n_nationkey")
    want = read(spark, d, "nation").select(F.lit("g").alias("grid_id"), (k * 2).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("z"), F.lit("structure").alias("kind"), F.when((k % 5 == 0) | (k % 13 < 1), "up").otherwise("down").alias("facing"))
    return voxel.mismatches(_voxels(spark, d), want).select("x", "y", "facing")


@query("SELECT n_nationkey, CASE f WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS x, CASE WHEN f = 1 THEN 1 ELSE 2 END AS y, CASE WHEN f = 0 THEN 1 ELSE 3 END AS z FROM (SELECT n_nationkey, n_nationkey % 3 AS f FROM nation)")
def voxel_orient(spark, d):
    f = F.element_at(F.array(F.lit("north"), F.lit("up"), F.lit("east")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return read(spark, d, "nation").select("n_nationkey", *voxel.oriented(F.lit(1), F.lit(2), F.lit(3), f))
