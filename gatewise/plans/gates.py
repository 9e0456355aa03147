"""Gate trees as boolean Columns, planned on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import forward, forward_value, inverse_value
from ..model import ALL_EVENTS, Gate, Panel, Transform, gate_path, inside, tree_order

DEEPEST = 1000


def polygon_mask(points: list, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges.

    The heights of the vertices part the plane into slabs, each crossed by few edges: a position finds its slab by halving and looks at those alone. Where
    edges cross so many slabs that the expression would grow by more than a few times, all edges are looked at.
    """
    edges = [(xi, yi, xj, yj) for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True) if yi != yj]  # a horizontal edge is crossed by no ray
    heights = sorted({float(v) for _, v in points})
    slabs = [[], *[[e for e in edges if min(e[1], e[3]) <= lo and max(e[1], e[3]) >= hi] for lo, hi in zip(heights, heights[1:], strict=False)], []]

    def odd(crossed: list[Column]) -> Column:
        return sum(crossed, F.lit(0)) % 2 == 1

    def left(e: tuple) -> Column:
        xi, yi, xj, yj = e
        return x < F.lit(float(xj - xi)) * (y - float(yi)) / float(yj - yi) + float(xi)

    if sum(map(len, slabs)) > 4 * len(points):
        return odd([F.when(((F.lit(float(e[1])) > y) != (F.lit(float(e[3])) > y)) & left(e), 1).otherwise(0) for e in edges])

    def among(first: int, last: int) -> Column:
        if last - first == 1:
            return odd([F.when(left(e), 1).otherwise(0) for e in slabs[first]])
        mid = (first + last) // 2
        return F.when(y < heights[mid - 1], among(first, mid)).otherwise(among(mid, last))

    return among(0, len(slabs))


def shape_mask(shape: dict, x: Column, y: Column) -> Column:
    """Whether a display position lies in a shape; NaN and null lie in none."""
    kind = shape["shape"]
    if kind == "rect":
        inside = x.between(shape["x_min"], shape["x_max"]) & y.between(shape["y_min"], shape["y_max"])
    elif kind == "range":
        inside = x.between(shape["x_min"], shape["x_max"])
    elif kind == "ellipse":
        if shape["rx"] <= 0 or shape["ry"] <= 0:
            return F.lit(False)
        cos, sin = math.cos(shape["angle"]), math.sin(shape["angle"])
        dx, dy = x - shape["cx"], y - shape["cy"]
        u, v = (dx * cos + dy * sin) / shape["rx"], (-dx * sin + dy * cos) / shape["ry"]
        inside = (u * u + v * v) <= 1.0
        inside = inside & ~F.isnan(x) & ~F.isnan(y)
    else:
        points = shape["vertices"]
        if len(points) < 3:
            return F.lit(False)
        inside = polygon_mask(points, x, y) & ~F.isnan(x) & ~F.isnan(y)
    return F.coalesce(inside, F.lit(False))


class GatePlan:
    """Own and effective masks of all gates over one panel.

    ``own[id]`` is None for a gate that can't be evaluated: a channel is missing, it is a Boolean gate
    over such gates, or its references are missing or go in a circle. Its mask is false.
    """

    def __init__(self, gates: list[Gate], panel: Panel):
        self.gates, self.panel = gates, panel
        self.known = {g.id: g for g in gates}  # the last of equal ids
        self.own: dict[int, Column | None] = {}
        for g in gates:
            if g.kind != "boolean":
                self.own[g.id] = self._drawn(g)
        waiting = [g for g in gates if g.kind == "boolean"]
        while ready := [g for g in waiting if all(self._settled(r) for r in g.shape["refs"])]:
            for g in ready:
                self.own[g.id] = self._boolean(g)
            waiting = [g for g in waiting if g not in ready]
        for g in waiting:
            self.own[g.id] = None

    def _drawn(self, g: Gate) -> Column | None:
        x, y = self.panel.find(g.x_channel), self.panel.find(g.y_channel)
        if x is None or y is None:
            return None
        return shape_mask(g.shape, forward(F.col(x), g.x_transform), forward(F.col(y), g.y_transform))

    def ancestors(self, id: int) -> list[int]:
        """The gate and those above it, each once: masks in a circle of parents would only repeat."""
        out, at = [], id
        while at is not None and at in self.known and at not in out and len(out) < DEEPEST:
            out.append(at)
            at = self.known[at].parent
        return out

    def _settled(self, id: int) -> bool:
        """Whether the masks of a gate and all its ancestors are known; never below a parent that isn't there, or in a circle of parents."""
        chain = self.ancestors(id)
        return id in self.known and self.known[chain[-1]].parent is None and all(a in self.own for a in chain)

    def evaluable(self, id: int) -> bool:
        return all(self.own.get(a) is not None for a in self.ancestors(id))

    def _boolean(self, g: Gate) -> Column | None:
        refs = g.shape["refs"]
        if not refs:
            return F.lit(False)
        if not all(self.evaluable(r) for r in refs):
            return None
        masks = [self.effective(r) for r in refs]
        if g.shape["op"] == "not":
            return ~masks[0]
        out = masks[0]
        for m in masks[1:]:
            out = (out & m) if g.shape["op"] == "and" else (out | m)
        return out

    def effective(self, id: int) -> Column:
        """Own mask and those of all ancestors; an unknown parent is passed over."""
        out = F.lit(True)
        for a in self.ancestors(id):
            own = self.own.get(a)
            if own is None:
                return F.lit(False)
            out = out & own
        return out

    def add_masks(self, events: DataFrame) -> DataFrame:
        """``events`` with a boolean column ``g<id>`` for each gate."""
        return events.select("*", *[self.effective(i).alias(f"g{i}") for i in self.known])


def gate_channels(gates: list[Gate]) -> list[str]:
    """Channels that gates name, each once, in the order of their first use; Boolean gates name none."""
    return list(dict.fromkeys(c for g in gates if g.kind != "boolean" for c in (g.x_channel, g.y_channel)))


def missing_channels(gates: list[Gate], panel: Panel) -> list[str]:
    """Channels that gates name and the panel hasn't."""
    return [c for c in gate_channels(gates) if panel.find(c) is None]


def missing_by_sample(gates: list[Gate], channels: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, channel): channels that gates name and a sample hasn't; ``channels`` has (sample, name)."""
    wanted = channels.select(sample).distinct().select(sample, F.explode(F.array(*[F.lit(c) for c in gate_channels(gates)]).cast("array<string>")).alias("channel"))
    has = channels.select(sample, F.upper("name").alias("_upper")).distinct()
    return wanted.withColumn("_upper", F.upper("channel")).join(has, [sample, "_upper"], "left_anti").drop("_upper")


def deepest_population(events: DataFrame, gates: list[Gate], panel: Panel) -> DataFrame:
    """``events`` with ``population`` (id of the deepest gate that holds the event with all its ancestors, the first of equals in the list; null in none), its ``depth`` and ``path``.

    Depths are those of the tree, so orphans lie at the top. One scan: labels are a chain of conditions, from the deepest gates on.
    """
    plan, depths = GatePlan(gates, panel), {g.id: d for g, d in tree_order(gates)}
    order = sorted((g for g in gates if plan.known[g.id] is g), key=lambda g: -depths[g.id])
    label = F.lit(None).cast("int")
    for g in reversed(order):
        label = F.when(plan.effective(g.id), g.id).otherwise(label)
    paths = {g.id: gate_path(gates, g.id) for g in order}
    of = lambda table, kind: F.coalesce(*[F.when(F.col("population") == i, value) for i, value in table.items()], F.lit(None).cast(kind))
    told = events.select("*", label.alias("population"))
    path = of({i: F.array(*[F.lit(n) for n in names]) for i, names in paths.items()}, "array<string>")
    return told.select("*", of({g.id: F.lit(depths[g.id] + 1) for g in order}, "int").alias("depth"), F.coalesce(path, F.array(F.lit(ALL_EVENTS))).alias("path"))


def gate_at(gates: list[Gate], x_channel: str, y_channel: str, x: float, y: float, x_transform: Transform = Transform(), y_transform: Transform = Transform()) -> int | None:  # noqa: B008
    """The deepest gate on two channels that holds a display position of these axes, the first of equals; each gate on axes of its own."""
    best, depths = None, {g.id: d for g, d in tree_order(gates)}
    for g in gates:
        if (g.x_channel.upper(), g.y_channel.upper()) == (x_channel.upper(), y_channel.upper()):
            at = forward_value(inverse_value(x, x_transform), g.x_transform), forward_value(inverse_value(y, y_transform), g.y_transform)
            if inside(g.shape, *at) and (best is None or depths[g.id] > depths[best]):
                best = g.id
    return best


def data_bounds(gate: Gate, panel: Panel) -> Column:
    """A wider test on data values, which a scan can use to leave out blocks, for rect and range gates.

    It holds wherever the gate's own test holds; only for queries that want the gate's rows alone.
    """
    if gate.kind not in ("rect", "range"):
        return F.lit(True)
    s = gate.shape
    out = F.lit(True)
    axes = [(gate.x_channel, gate.x_transform, s["x_min"], s["x_max"])]
    axes += [(gate.y_channel, gate.y_transform, s["y_min"], s["y_max"])] if gate.kind == "rect" else []
    for channel, tf, lo, hi in axes:
        column = panel.find(channel)
        if column is None or tf.kind == "log":  # all values below its floor are one there
            continue
        low, high = inverse_value(lo, tf), inverse_value(hi, tf)
        wide = 1e-6 * (1 + abs(low) + abs(high))
        if math.isfinite(low) and math.isfinite(high):
            out = out & F.col(column).between(low - wide, high + wide)
    return out
