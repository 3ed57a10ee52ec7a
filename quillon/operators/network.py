"""Steady states of nodal networks in three coupled domains, many models at once.

Nodes: (model_id, node_id, domain, kind, fixed_value, init_value, seq), a row for each domain a node is in;
kind is unknown, fixed or constraint.  Components: (model_id, comp_id, type, ports array<string>, params
map<string,double>, domain, seq).  Types: link (a, b; g), source (n; q), gear (a, b, k; r), damper (a, b,
heat; g), radiation (a, b; area, emissivity), convection (wall, fluid; cp, h or h0, h1).
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.grouped import dealt, groups, listed
from quillon.operators.solvers import Coo, conjugate_gradient, conjugate_gradients, least_squares

MECHANICAL, HYDRAULIC, THERMAL = "MECHANICAL", "HYDRAULIC", "THERMAL"
#: The order in which domains are solved.
DOMAINS = (MECHANICAL, HYDRAULIC, THERMAL)
# Fixed values.
SIGMA = 5.670374419e-8
CONDUCTIVITY = {"ALUMINUM": 205.0, "COPPER": 385.0, "STEEL": 50.0, "WATER": 0.6, "AIR": 0.025}


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``idx``: the place in its model and domain, by seq."""
    w = Window.partitionBy("model_id", "domain").orderBy("seq", "node_id")
    return nodes.withColumn("idx", F.row_number().over(w) - 1)


def assemble(nodes: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model_id, domain, row, col, value) and (model_id, domain, row, value) of the linear stamps.

    Fixed nodes give a unit row; links, sources and gears stamp the rows of nodes that are not fixed; a
    component whose domain a model lacks is left out.  Plain joins, projections and one sum each.
    """
    ids = numbered(nodes).select("model_id", "domain", "node_id", "idx", (F.col("kind") != "fixed").alias("u"))
    comps = components.withColumn("__c", F.monotonically_increasing_id())
    port = lambda k, s: ids.select("model_id", "domain", F.col("node_id").alias(f"n{s}"), F.col("idx").alias(s), F.col("u").alias(f"u{s}"))
    two = comps.where("type in ('link', 'gear', 'damper')").withColumn("domain", F.when(F.col("type") == "link", F.col("domain")).otherwise(F.lit(MECHANICAL)))
    two = two.select("model_id", "domain", "type", "params", F.element_at("ports", 1).alias("ni"), F.element_at("ports", 2).alias("nj"), F.when(F.col("type") == "gear", F.get("ports", F.lit(2))).alias("nk"))
    two = two.join(port(0, "i"), ["model_id", "domain", "ni"]).join(port(1, "j"), ["model_id", "domain", "nj"]).join(port(2, "k"), ["model_id", "domain", "nk"], "left")
    g, r = F.element_at("params", "g"), F.element_at("params", "r")
    cell = lambda row, col, value, on: F.when(on, F.struct(F.col(row).alias("row"), F.col(col).alias("col"), value.alias("value")))
    straight, gear = F.col("type") != "gear", F.col("type") == "gear"
    stamps = F.array(
        cell("i", "i", g, straight & F.col("ui")), cell("i", "j", -g, straight & F.col("ui")),
        cell("j", "j", g, straight & F.col("uj")), cell("j", "i", -g, straight & F.col("uj")),
        cell("i", "k", r, gear & F.col("ui")), cell("j", "k", F.lit(-1.0), gear & F.col("uj")),
        cell("k", "i", r, gear), cell("k", "j", F.lit(-1.0), gear),
    )
    stamped = two.select("model_id", "domain", F.explode(F.filter(stamps, lambda x: x.isNotNull())).alias("s")).select("model_id", "domain", "s.row", "s.col", "s.value")
    fixed = numbered(nodes).where("kind = 'fixed'")
    unit = fixed.select("model_id", "domain", F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(1.0).alias("value"))
    a = stamped.unionByName(unit).where("value <> 0").groupBy("model_id", "domain", "row", "col").agg(F.sum("value").alias("value"))
    sources = comps.where("type = 'source'").select("model_id", "domain", F.element_at("ports", 1).alias("ni"), F.element_at("params", "q").alias("value"))
    pushed = sources.join(port(0, "i"), ["model_id", "domain", "ni"]).where("ui").select("model_id", "domain", F.col("i").alias("row"), "value")
    b = pushed.unionByName(fixed.select("model_id", "domain", F.col("idx").alias("row"), F.col("fixed_value").alias("value"))).groupBy("model_id", "domain", "row").agg(F.sum("value").alias("value"))
    return a, b


class _Models:
    """Models of one structure in memory: places and components once, current values and parameters a row a model."""

    def __init__(self, nodes: list[tuple], components: list[tuple], numbers: np.ndarray) -> None:
        """``nodes``: (node_id, domain, kind); ``components``: (comp_id, domain, type, ports, names of parameters).

        ``numbers`` has a row a model: the nodes' values, then the components' parameters, in order.
        """
        self.place: dict[str, dict[str, int]] = {}
        self.values: dict[str, np.ndarray] = {}
        self.fixed: dict[str, np.ndarray] = {}
        for domain in DOMAINS:
            own = [k for k, x in enumerate(nodes) if x[1] == domain]
            if own:
                self.place[domain] = {nodes[k][0]: p for p, k in enumerate(own)}
                if len(self.place[domain]) < len(own):
                    raise ValueError("a node stands twice in a domain")
                self.fixed[domain] = np.array([nodes[k][2] == "fixed" for k in own])
                self.values[domain] = numbers[:, own]
        # a last column of zeros stands for parameters that are not given
        self.numbers = np.hstack([numbers, np.zeros((len(numbers), 1))])
        self.links: dict[str, list] = {d: [] for d in DOMAINS}
        self.sources: dict[str, list] = {d: [] for d in DOMAINS}
        self.gears, self.dampers, self.radiation, self.convection = [], [], [], []
        first = len(nodes)
        for comp_id, on, kind, ports, names in components:
            params = {name: first + k for k, name in enumerate(names)}
            first += len(names)
            at = lambda port, domain: self.place[domain][port]
            domain = on if kind in ("link", "source") else {"gear": MECHANICAL, "damper": MECHANICAL}.get(kind, THERMAL)
            if domain not in self.place and not (kind == "damper" and THERMAL in self.place):
                continue
            try:
                if kind == "link":
                    self.links[domain].append((at(ports[0], domain), at(ports[1], domain), params["g"]))
                elif kind == "source":
                    self.sources[domain].append((at(ports[0], domain), params["q"]))
                elif kind == "gear":
                    self.gears.append((*(at(p, domain) for p in ports[:3]), params["r"]))
                elif kind == "damper":
                    if (numbers[:, params["g"]] <= 0).any():
                        raise ValueError("a damper's conductance is above 0")
                    self.dampers.append((at(ports[0], MECHANICAL), at(ports[1], MECHANICAL), at(ports[2], THERMAL) if THERMAL in self.place and len(ports) > 2 else -1, params["g"]))
                elif kind == "radiation":
                    self.radiation.append((at(ports[0], THERMAL), at(ports[1], THERMAL), params["emissivity"], params["area"]))
                elif kind == "convection":
                    flow = at(ports[1], HYDRAULIC) if HYDRAULIC in self.place else -1
                    self.convection.append((at(ports[0], THERMAL), at(ports[1], THERMAL), flow, params["cp"], params.get("h0", params.get("h", -1)), params.get("h1", -1)))
                elif kind == "advection":
                    self.convection.append((at(ports[0], THERMAL), at(ports[1], THERMAL), (at(ports[0], HYDRAULIC), at(ports[1], HYDRAULIC)), params["cp"], params["g"], -1))
                else:
                    raise ValueError(f"unknown component type {kind}")
            except KeyError as missing:
                raise ValueError(f"component {comp_id} needs {missing} in its domain") from None

    def of(self, rows: np.ndarray) -> _Models:
        """The models of some rows."""
        out = copy(self)
        out.numbers, out.values = self.numbers[rows], {d: v[rows] for d, v in self.values.items()}
        return out

    def system(self, domain: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, entries by model, right-hand sides, whether the free rows are symmetric) from the current values."""
        fixed, now, many = self.fixed[domain], self.values[domain], len(self.numbers)
        held = np.flatnonzero(fixed)
        rows, cols, vals = [held], [held], [np.ones((many, len(held)))]
        b = np.where(fixed, now, 0.0)
        plain = np.ones(many, dtype=bool)

        def put(at: int, col: int, value: np.ndarray | float) -> None:
            if not fixed[at]:
                rows.append(np.array([at])), cols.append(np.array([col])), vals.append(np.broadcast_to(np.reshape(value, (-1, 1)), (many, 1)))

        def pairs(i: np.ndarray, j: np.ndarray, g: np.ndarray) -> None:
            for p, q in ((i, j), (j, i)):
                on = ~fixed[p]
                rows.extend((p[on], p[on]))
                cols.extend((p[on], q[on]))
                vals.extend((g[:, on], -g[:, on]))

        def columns(items: list, width: int) -> list[np.ndarray]:
            return [np.array([x[k] for x in items]) for k in range(width)]

        if self.links[domain]:
            i, j, g = columns(self.links[domain], 3)
            pairs(i, j, self.numbers[:, g])
        for at, q in self.sources[domain]:
            if not fixed[at]:
                b[:, at] += self.numbers[:, q]
        if domain == MECHANICAL:
            if self.dampers:
                i, j, _, g = columns(self.dampers, 4)
                pairs(i, j, self.numbers[:, g])
            for i, j, k, r in self.gears:
                plain[:] = False
                put(i, k, self.numbers[:, r])
                put(j, k, -1.0)
                rows.append(np.array([k, k])), cols.append(np.array([i, j])), vals.append(np.column_stack([self.numbers[:, r], np.full(many, -1.0)]))
        if domain == THERMAL:
            if MECHANICAL in self.values:
                w = self.values[MECHANICAL]
                for i, j, heat, g in self.dampers:
                    if heat >= 0 and not fixed[heat]:
                        b[:, heat] += self.numbers[:, g] * (w[:, i] - w[:, j]) ** 2
            if self.radiation:
                i, j, e, area = columns(self.radiation, 4)
                pairs(i, j, 4 * (SIGMA * self.numbers[:, e] * self.numbers[:, area]) * ((now[:, i] + now[:, j]) / 2) ** 3)
            for i, j, flow, cp, h0, h1 in self.convection:
                if isinstance(flow, tuple):
                    p = self.values[HYDRAULIC]
                    carried = (p[:, flow[0]] - p[:, flow[1]]) * (self.numbers[:, cp] * self.numbers[:, h0])
                    carried = np.where(np.abs(carried) < 1e-12, 0.0, carried)
                else:
                    rate = self.values[HYDRAULIC][:, flow] if flow >= 0 else np.zeros(many)
                    pairs(np.array([i]), np.array([j]), (self.numbers[:, h0] + self.numbers[:, h1] * np.abs(rate))[:, None])
                    carried = rate * self.numbers[:, cp]
                if carried.any():
                    plain &= carried == 0
                    # what flows from i to j, or from j to i; one of both is 0
                    for up, down, size in ((i, j, np.where(carried > 0, carried, 0.0)), (j, i, np.where(carried > 0, 0.0, -carried))):
                        put(up, up, size)
                        put(down, up, -size)
        return np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64), np.concatenate(vals, axis=1).astype(float), b, plain


def _times(row: np.ndarray, col: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of stacked matrices, entries by model, and their vectors."""
    out = np.zeros_like(x)
    for k, (i, j) in enumerate(zip(row.tolist(), col.tolist(), strict=True)):
        out[:, i] += value[:, k] * x[:, j]
    return out


def _solve_one(a: Coo, b: np.ndarray, plain: bool, now: np.ndarray, fixed: np.ndarray, method: str, inner: int, tol: float) -> np.ndarray:
    if method == "cgnr":
        return least_squares(a, b, most=inner, tol=tol, guess=now)[0]
    free = np.flatnonzero(~fixed)
    at = np.full(a.n_rows, -1)
    at[free] = np.arange(len(free))
    inside = (at[a.row] >= 0) & (at[a.col] >= 0)
    edge = (at[a.row] >= 0) & (at[a.col] < 0)
    rhs = b[free] - np.bincount(at[a.row[edge]], a.value[edge] * now[a.col[edge]], len(free))
    small = Coo(at[a.row[inside]], at[a.col[inside]], a.value[inside], len(free), len(free))
    out = now.copy()
    size = max(1.0, float(np.abs(rhs).max()))
    touched = np.bincount(small.row, np.abs(small.value), len(free)) > 0
    if plain and touched.all():
        x, _, left = conjugate_gradient(small, rhs, most=20 * len(free) + 200, tol=1e-10 * size, guess=now[free], jacobi=True)
        if left <= 1e-6 * size and np.isfinite(x).all():
            out[free] = x
            return out
    if len(free) <= 2000:
        dense = small.dense()
        try:
            x = np.linalg.solve(dense, rhs)
            if not np.isfinite(x).all() or np.abs(dense @ x - rhs).max() > 1e-6 * size:
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            x = now[free] + np.linalg.lstsq(dense, rhs - dense @ now[free], rcond=None)[0]
        out[free] = x
        return out
    out[free] = least_squares(small, rhs, most=20 * inner, tol=1e-10 * size, guess=now[free])[0]
    return out


@np.errstate(all="ignore")
def _solve_domain(models: _Models, domain: str, method: str, inner: int, tol: float) -> np.ndarray:
    """New values of a domain, a row a model: a stack of small systems at once, by the steps that ``_solve_one`` takes for one.

    Systems for which those steps end without a solution go through ``_solve_one`` itself.
    """
    row, col, value, b, plain = models.system(domain)
    now, fixed = models.values[domain], models.fixed[domain]
    many, n = now.shape
    free = np.flatnonzero(~fixed)
    if method != "cgnr" and not len(free):
        return now
    out, solved = now.copy(), np.zeros(many, dtype=bool)
    if method != "cgnr" and many > 1:
        dense, weight = np.zeros((many, n, n)), np.zeros((many, n))
        for k, (i, j) in enumerate(zip(row.tolist(), col.tolist(), strict=True)):
            dense[:, i, j] += value[:, k]
            if not fixed[j]:
                weight[:, i] += np.abs(value[:, k])
        own = dense[:, free]
        a = np.ascontiguousarray(own[:, :, free])
        rhs = b[:, free] - np.einsum("kij,kj->ki", own[:, :, fixed], now[:, fixed])
        size = np.maximum(1.0, np.abs(rhs).max(axis=1))
        x = now[:, free]
        by_steps = np.flatnonzero(plain & (weight[:, free] > 0).all(axis=1))
        if len(by_steps):
            x[by_steps], left = conjugate_gradients(a[by_steps], rhs[by_steps], most=20 * len(free) + 200, tol=1e-10 * size[by_steps], guess=x[by_steps])
            solved[by_steps] = (left <= 1e-6 * size[by_steps]) & np.isfinite(x[by_steps]).all(axis=1)
        rest = np.flatnonzero(~solved)
        if len(rest):
            try:
                x[rest] = np.linalg.solve(a[rest], rhs[rest][:, :, None])[:, :, 0]
                off = np.abs(np.einsum("kij,kj->ki", a[rest], x[rest]) - rhs[rest]).max(axis=1)
                solved[rest] = np.isfinite(x[rest]).all(axis=1) & (off <= 1e-6 * size[rest])
            except np.linalg.LinAlgError:
                pass  # one of them is singular: each on its own
        out[np.ix_(solved, free)] = x[solved]
    for k in np.flatnonzero(~solved):
        out[k] = _solve_one(Coo(row, col, value[k], n, n), b[k], bool(plain[k]), now[k], fixed, method, inner, tol)
    return out


#: Models of at most so many nodes are stacked by structure, so many at once; rows that wait for their stack, in all.
STACKED_NODES, STACK, WAITING = 64, 1000, 50_000

_RESULT = "model_id string, node_id string, domain string, value double, outer_iters int, converged boolean, residual double"


def steady_state(nodes: DataFrame, components: DataFrame, *, method: str = "auto", outer: int = 50, inner: int = 5000, tol: float = 1e-3) -> DataFrame:
    """(model_id, node_id, domain, value, outer_iters, converged, residual): each model whole in one task.

    Rounds: all domains are stamped from the values before the round, then solved in order, until no value
    moves by ``tol``.  Models of the same nodes, components and parameter names are solved in stacks.  ``auto`` eliminates fixed nodes and picks by structure: preconditioned conjugate
    gradient where stamps are symmetric, a direct solve with gears or advection, least squares where the
    system is singular.  ``cgnr`` is least squares on the whole system with ``inner`` steps at most.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = nodes.select(text("model_id"), F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq"), F.col("node_id").alias("name"), "domain", F.col("kind").alias("type"), none("array<string>", "ports"), none("map<string,double>", "params"), F.col("fixed_value").cast("double").alias("fixed_value"), F.col("init_value").cast("double").alias("init_value"))
    right = components.select(text("model_id"), F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), F.col("comp_id").alias("name"), "domain", "type", "ports", F.col("params").cast("map<string,double>").alias("params"), none("double", "fixed_value"), none("double", "init_value"))
    schema = pa.schema([("model_id", pa.string()), ("node_id", pa.string()), ("domain", pa.string()), ("value", pa.float64()), ("outer_iters", pa.int32()), ("converged", pa.bool_()), ("residual", pa.float64())])

    def solve(keys: list, nodes: tuple, comps: tuple, numbers: list[list[float]]) -> pa.RecordBatch:
        models = _Models(nodes, comps, np.array(numbers, dtype=float).reshape(len(keys), -1))
        moved, rounds, live = np.full(len(keys), np.inf), np.zeros(len(keys), dtype=np.int32), np.arange(len(keys))
        for _ in range(outer):
            now = models if len(live) == len(keys) else models.of(live)
            new = {d: _solve_domain(now, d, method, inner, tol) for d in models.values}
            rounds[live] += 1
            moved[live] = np.max([np.abs(new[d] - now.values[d]).max(axis=1) for d in new], axis=0)
            for d, v in new.items():
                models.values[d][live] = np.where(models.fixed[d], now.values[d], v)
            live = live[moved[live] >= tol]
            if not len(live):
                break
        rest = np.zeros(len(keys))
        for d, x in models.values.items():
            row, col, value, b, _ = models.system(d)
            ax = _times(row, col, value, x) if len(keys) > 1 else Coo(row, col, value[0], x.shape[1], x.shape[1]).times(x[0])
            rest = np.maximum(rest, np.abs(ax - b).max(axis=1))
        # all nodes of a model, then the next model
        names = [(node, d) for d in models.values for node in models.place[d]]
        each = lambda x: np.repeat(x, len(names))
        again = np.tile(np.arange(len(names)), len(keys))
        ids = pa.array(keys, pa.string()).take(pa.array(each(np.arange(len(keys)))))
        columns = [ids, *(pa.array([x[k] for x in names], pa.string()).take(pa.array(again)) for k in range(2)), pa.array(np.hstack(list(models.values.values())).ravel()), pa.array(each(rounds)), pa.array(each(moved < tol)), pa.array(each(rest))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[tuple, tuple[list, list]] = {}
        waiting = ready = 0
        out: list[pa.RecordBatch] = []
        for key, (part, _, name, domain, kind, ports, params, fixed, init) in groups(batches, listed):
            n = sum(x == 0 for x in part)  # nodes come first
            if not n:
                raise ValueError(f"model {key} has components and no nodes")
            given = [p or () for p in params[n:]]
            nodes = tuple(zip(name[:n], domain[:n], kind[:n], strict=True))
            comps = tuple(zip(name[n:], domain[n:], kind[n:], (tuple(p or ()) for p in ports[n:]), (tuple(k for k, _ in p) for p in given), strict=True))
            numbers = [(f if k == "fixed" else i) or 0.0 for k, f, i in zip(kind[:n], fixed, init, strict=False)] + [float(v) for p in given for _, v in p]
            keys, rows = stacks.setdefault((nodes, comps), ([], []))
            keys.append(key)
            rows.append(numbers)
            waiting += len(part)
            full = [((nodes, comps), stacks.pop((nodes, comps)))] if len(keys) >= (STACK if n <= STACKED_NODES else 1) else []
            waiting -= len(full) * len(keys) * len(part)
            if waiting >= WAITING:
                full += stacks.items()
                stacks, waiting = {}, 0
            for (nodes, comps), (keys, rows) in full:
                out.append(solve(keys, nodes, comps, rows))
                ready += out[-1].num_rows
            if ready >= 10_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, ready = [], 0
        out += [solve(keys, nodes, comps, rows) for (nodes, comps), (keys, rows) in stacks.items()]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rows = dealt(left.unionByName(right), "model_id", "part", F.asc_nulls_last("seq"), "name")
    return rows.mapInArrow(run, _RESULT)


def plate_links(layers: DataFrame) -> DataFrame:
    """(model_id, i, j, i2, j2, part, g) of layered plates: (model_id, layer, material, length, thickness, nx, ny).

    Vertical links inside layers, horizontal ones on all rows but a layer's top where another follows, half
    as tall on a layer's first and last row, and on interface rows a link more, of both half cells in series.
    """
    k = F.element_at(F.create_map(*[x for name, v in CONDUCTIVITY.items() for x in (F.lit(name), F.lit(v))]), F.col("material"))
    w = Window.partitionBy("model_id").orderBy("layer")
    own = layers.withColumn("k", k).withColumn("dx", F.col("length") / F.col("nx")).withColumn("dy", F.col("thickness") / F.col("ny"))
    own = own.withColumn("j0", F.coalesce(F.sum("ny").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("top_k", F.lead("k").over(w)).withColumn("top_dy", F.lead("dy").over(w))
    nx0 = F.first("nx").over(w)
    own = own.withColumn("nx", F.when(F.col("nx") == nx0, F.col("nx")).otherwise(F.raise_error("all layers of a plate have the same nx").cast("int")))
    cols = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    up = own.withColumn("i", cols(F.col("nx"))).withColumn("j", F.explode(F.sequence(F.col("j0"), F.col("j0") + F.col("ny") - 1)))
    up = up.select("model_id", "i", "j", F.col("i").alias("i2"), (F.col("j") + 1).alias("j2"), F.lit("vertical").alias("part"), (F.col("k") * F.col("dx") / F.col("dy")).alias("g"))
    across = own.where("nx > 1").withColumn("i", cols(F.col("nx") - 1))
    row = across.withColumn("j", F.explode(F.sequence(F.col("j0"), F.col("j0") + F.col("ny"))))
    top = F.col("j") == F.col("j0") + F.col("ny")
    row = row.where(~(top & F.col("top_k").isNotNull()))
    tall = F.when((F.col("j") == F.col("j0")) | (F.col("j") == F.col("j0") + F.col("ny")), 0.5 * F.col("dy")).otherwise(F.col("dy"))
    row = row.select("model_id", "i", "j", (F.col("i") + 1).alias("i2"), F.col("j").alias("j2"), F.lit("horizontal").alias("part"), (F.col("k") * tall / F.col("dx")).alias("g"))
    low, high = F.col("k") * (F.col("dy") / 2.0) / F.col("dx"), F.col("top_k") * (F.col("top_dy") / 2.0) / F.col("dx")
    seam = across.where("top_k is not null").withColumn("j", F.col("j0") + F.col("ny"))
    seam = seam.select("model_id", "i", "j", (F.col("i") + 1).alias("i2"), F.col("j").alias("j2"), F.lit("interface").alias("part"), (1.0 / (1.0 / low + 1.0 / high)).alias("g"))
    return up.unionByName(row).unionByName(seam)


def heat_exchanger(models: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, components) inside exchangers: (model_id, in1, out1, in2, out2, cp1, cp2, ha1, ha2, r1, r2, seq).

    Each stream is a chain from inlet through segments - 1 nodes to outlet: hydraulic links of N / R, and
    advection by each segment's pressure drop; N wall nodes exchange hA / N with the chains' first N nodes.
    Inlets and outlets belong to both domains and are the caller's; outlets need a link of their own.
    """
    n = segments
    if n < 1:
        raise ValueError("segments is 1 or more")
    # a fold over the few segment numbers, written out as literal rows
    node_rows, comp_rows = [], []
    for s in (1, 2):
        chain = [f"in{s}", *(f"x{s}_{k}" for k in range(n - 1)), f"out{s}"]
        for k in range(n - 1):
            node_rows += [(f"x{s}_{k}", THERMAL), (f"x{s}_{k}", HYDRAULIC)]
        for a, b in zip(chain, chain[1:], strict=False):
            comp_rows += [("link", HYDRAULIC, a, b, s, "g"), ("advection", THERMAL, a, b, s, "a")]
        for k in range(n):
            comp_rows.append(("link", THERMAL, f"wall_{k}", chain[k], s, "h"))
    node_rows += [(f"wall_{k}", THERMAL) for k in range(n)]
    name = lambda c: F.when(c == "in1", F.col("in1")).when(c == "out1", F.col("out1")).when(c == "in2", F.col("in2")).when(c == "out2", F.col("out2")).otherwise(F.concat(F.lit("hx:"), c))
    inner = F.array(*[F.struct(F.lit(a).alias("n"), F.lit(d).alias("d"), F.lit(k).alias("k")) for k, (a, d) in enumerate(node_rows)])
    nodes = models.select("model_id", "seq", F.explode(inner).alias("e")).select("model_id", F.concat(F.lit("hx:"), F.col("e.n")).alias("node_id"), F.col("e.d").alias("domain"), F.lit("unknown").alias("kind"), F.lit(None).cast("double").alias("fixed_value"), F.lit(0.0).alias("init_value"), (F.col("seq") + F.col("e.k")).alias("seq"))
    parts = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s"), F.lit(w).alias("w"), F.lit(k).alias("k")) for k, (t, d, a, b, s, w) in enumerate(comp_rows)])
    of = lambda one, two: F.when(F.col("e.s") == 1, F.col(one)).otherwise(F.col(two))
    g = F.lit(float(n)) / of("r1", "r2")
    params = F.when(F.col("e.w") == "h", F.create_map(F.lit("g"), of("ha1", "ha2") / float(n))).when(F.col("e.w") == "g", F.create_map(F.lit("g"), g)).otherwise(F.create_map(F.lit("g"), g, F.lit("cp"), of("cp1", "cp2")))
    comps = models.withColumn("e", F.explode(parts)).select("model_id", F.concat_ws(":", F.lit("hx"), F.col("e.k").cast("string")).alias("comp_id"), F.col("e.t").alias("type"), F.array(name(F.col("e.a")), name(F.col("e.b"))).alias("ports"), params.alias("params"), F.col("e.d").alias("domain"), (F.col("seq") + F.col("e.k")).alias("seq"))
    return nodes, comps
