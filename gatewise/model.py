"""Transforms, gates and panels as plain data, with their JSON form."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

ALL_EVENTS, NO_PARENT = "All events", "—"
#: A quadrant's edge beyond this is an open side.
OPEN_SIDE = 5e11


@dataclass(frozen=True)
class Transform:
    """An axis: ``linear``, ``log`` (floor), ``asinh`` (cofactor) or ``logicle`` (t, w, m, a)."""

    kind: str = "linear"
    floor: float = 1.0
    cofactor: float = 150.0
    t: float = 262144.0
    w: float = 0.5
    m: float = 4.5
    a: float = 0.0

    @classmethod
    def from_json(cls, data: dict | None) -> Transform:
        return cls(**data) if data else cls()

    def to_json(self) -> dict:
        names = {"linear": (), "log": ("floor",), "asinh": ("cofactor",), "logicle": ("t", "w", "m", "a")}[self.kind]
        return {"kind": self.kind, **{n: getattr(self, n) for n in names}}

    @property
    def key(self) -> str:
        """Tells transforms apart, parameters included."""
        return json.dumps(self.to_json(), sort_keys=True)


    @property
    def label(self) -> str:
        """Short form for people."""
        figures = {"linear": "", "log": f" {self.floor:g}", "asinh": f" {self.cofactor:g}", "logicle": f" T={self.t:g} W={self.w:g} M={self.m:g} A={self.a:g}"}
        return self.kind + figures[self.kind]


@dataclass(frozen=True)
class Gate:
    """A gate; ``shape`` is {"shape": rect | ellipse | polygon | range | boolean, ...}."""

    id: int
    name: str
    shape: dict
    parent: int | None = None
    x_channel: str = ""
    y_channel: str = ""
    x_transform: Transform = field(default_factory=Transform)
    y_transform: Transform = field(default_factory=Transform)
    quad_group: int | None = None

    @property
    def kind(self) -> str:
        return self.shape["shape"]

    @classmethod
    def from_json(cls, data: dict) -> Gate:
        axes = {k: Transform.from_json(data.get(k)) for k in ("x_transform", "y_transform")}
        return cls(**{k: v for k, v in data.items() if k not in axes}, **axes)

    def to_json(self) -> dict:
        out = {"id": self.id, "name": self.name, "parent": self.parent, "x_channel": self.x_channel, "y_channel": self.y_channel}
        out |= {"x_transform": self.x_transform.to_json(), "y_transform": self.y_transform.to_json(), "shape": self.shape}
        return out | ({"quad_group": self.quad_group} if self.quad_group is not None else {})


def load_gates(text: str) -> list[Gate]:
    return [Gate.from_json(x) for x in json.loads(text)]


def dump_gates(gates: list[Gate]) -> str:
    return json.dumps([g.to_json() for g in gates], indent=2)


@dataclass(frozen=True)
class Panel:
    """Channel names of a wide table, in column order; the column of channel i is ``columns[i]``."""

    channels: tuple[str, ...]
    columns: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.columns:
            object.__setattr__(self, "columns", tuple(f"c{i}" for i in range(len(self.channels))))

    def find(self, name: str) -> str | None:
        """Column of the first channel with this name, in any case."""
        return next((c for n, c in zip(self.channels, self.columns, strict=True) if n.upper() == name.upper()), None)

    def stat_channels(self) -> list[tuple[str, str]]:
        return [(n, c) for n, c in zip(self.channels, self.columns, strict=True) if n.upper() != "TIME"]

    def fluorescence(self) -> list[tuple[str, str]]:
        return [(n, c) for n, c in self.stat_channels() if not n.upper().startswith(("FSC", "SSC"))]


def default_transforms(panel: Panel, known: dict[str, Transform] | None = None) -> dict[str, Transform]:
    """Transform of each channel: carried over by name in any case, else linear for scatter and time, logicle for the rest."""
    carried = {k.upper(): v for k, v in (known or {}).items()}
    fluor = {n for n, _ in panel.fluorescence()}
    return {n: carried.get(n.upper(), Transform("logicle") if n in fluor else Transform()) for n in panel.channels}


def quadrant_gates(first_id: int, group: int, x: str, y: str, cx: float, cy: float, parent: int | None = None, tx: Transform = Transform(), ty: Transform = Transform(), far: float = 1e12) -> list[Gate]:  # noqa: B008
    """UR, UL, LL and LR rectangles about a centre; the lower sides end just below it."""
    bx, by = math.nextafter(cx, -math.inf), math.nextafter(cy, -math.inf)
    sides = [("UR", cx, far, cy, far), ("UL", -far, bx, cy, far), ("LL", -far, bx, -far, by), ("LR", cx, far, -far, by)]
    return [
        Gate(first_id + i, f"{x}/{y} {n}", {"shape": "rect", "x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1}, parent, x, y, tx, ty, group)
        for i, (n, x0, x1, y0, y1) in enumerate(sides)
    ]


def move_quadrant(gates: list[Gate], group: int, cx: float, cy: float) -> list[Gate]:
    """The quadrants of a group about another centre, still half open; sides are told by their open ends, so names don't matter."""

    def moved(shape: dict) -> dict:
        out = dict(shape)
        for axis, c in (("x", cx), ("y", cy)):
            upper = shape[f"{axis}_min"] > -OPEN_SIDE
            out[f"{axis}_min" if upper else f"{axis}_max"] = c if upper else math.nextafter(c, -math.inf)
        return out

    return [replace(g, shape=moved(g.shape)) if g.quad_group == group and g.kind == "rect" else g for g in gates]


def boolean_gate(id: int, op: str, refs: list[Gate], parent: int | None = None) -> Gate:
    if op not in ("and", "or", "not") or not refs or (op == "not" and len(refs) != 1):
        raise ValueError("AND and OR take one gate and more, NOT takes one")
    name = f"NOT {refs[0].name}" if op == "not" else f" {op.upper()} ".join(g.name for g in refs)
    return Gate(id, name, {"shape": "boolean", "op": op, "refs": [g.id for g in refs]}, parent)


def delete_gate(gates: list[Gate], id: int) -> list[Gate]:
    """Without one gate: its children go to its parent, Boolean gates lose the reference."""
    gone = next(g for g in gates if g.id == id)
    out = []
    for g in gates:
        if g.id != id:
            shape = g.shape if g.kind != "boolean" else g.shape | {"refs": [r for r in g.shape["refs"] if r != id]}
            out.append(replace(g, parent=gone.parent if g.parent == id else g.parent, shape=shape))
    return out


def reparent(gates: list[Gate], id: int, parent: int | None) -> list[Gate]:
    known, at = {g.id: g for g in gates}, parent
    while at is not None and at in known:
        if at == id:
            raise ValueError("a gate can't be below itself")
        at = known[at].parent
    return [replace(g, parent=parent) if g.id == id else g for g in gates]


def tree_order(gates: list[Gate]) -> list[tuple[Gate, int]]:
    """(gate, depth) depth first; orphans and cycles follow at depth 0."""
    out: list[tuple[Gate, int]] = []
    done: set[int] = set()

    def walk(parent: int | None, depth: int) -> None:
        for g in gates:
            if g.parent == parent and id(g) not in done:
                done.add(id(g))
                out.append((g, depth))
                walk(g.id, depth + 1)

    walk(None, 0)
    return out + [(g, 0) for g in gates if id(g) not in done]


def gate_path(gates: list[Gate], id: int) -> list[str]:
    """Names from the root down to a gate."""
    known, out = {g.id: g for g in gates}, []
    at: int | None = id
    while at is not None and at in known and len(out) < 1000:
        out.append(known[at].name)
        at = known[at].parent
    return [ALL_EVENTS, *out[::-1]]


def inside(shape: dict, x: float, y: float) -> bool:
    """Whether one display position lies in a drawn shape; edges of rectangles, ranges and ellipses are inside."""
    kind = shape["shape"]
    if math.isnan(x) or math.isnan(y) or kind == "boolean":
        return False
    if kind in ("rect", "range"):
        return shape["x_min"] <= x <= shape["x_max"] and (kind == "range" or shape["y_min"] <= y <= shape["y_max"])
    if kind == "ellipse":
        if shape["rx"] <= 0 or shape["ry"] <= 0:
            return False
        turn = complex(math.cos(shape["angle"]), -math.sin(shape["angle"]))
        at = complex(x - shape["cx"], y - shape["cy"]) * turn
        return (at.real / shape["rx"]) ** 2 + (at.imag / shape["ry"]) ** 2 <= 1.0
    points, crossed = shape["vertices"], 0
    for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            crossed += 1
    return len(points) >= 3 and crossed % 2 == 1


@dataclass(frozen=True)
class Session:
    """A workspace: tubes with their groups, axes, gates and compensation; display settings in ``view`` are carried along."""

    paths: tuple[str, ...]
    groups: tuple[str, ...] = ()
    active: int = 0
    compensated: bool = False
    transforms: tuple[Transform, ...] = ()
    gates: tuple[Gate, ...] = ()
    spillover: dict | None = None
    view: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str, found: Iterable[str] | None = None) -> Session:
        """Parse a saved session; with ``found`` (the paths there are), lost files go.

        Groups stay with their files, the active tube is counted among those left, and a matrix that
        isn't square is dropped. Raises ValueError if no file is left.
        """
        data = json.loads(text)
        known = {"sample_paths", "groups", "active_sample", "do_compensate", "channel_tf", "gates", "spill_override"}
        there = None if found is None else set(found)
        tubes = [(i, p, (data.get("groups") or [])[i : i + 1]) for i, p in enumerate(data["sample_paths"]) if there is None or p in there]
        if not tubes:
            raise ValueError("none of the session's files is there")
        active = min(sum(i < data.get("active_sample", 0) for i, *_ in tubes), len(tubes) - 1)
        matrix = data.get("spill_override")
        if matrix and (not matrix["channels"] or [len(r) for r in matrix["rows"]] != [len(matrix["channels"])] * len(matrix["channels"])):
            matrix = None
        groups = tuple(g[0] if g else "" for *_, g in tubes)
        axes = tuple(Transform.from_json(t) for t in data.get("channel_tf", []))
        return cls(tuple(p for _, p, _ in tubes), groups, active, data["do_compensate"], axes, tuple(map(Gate.from_json, data.get("gates", []))), matrix, {k: v for k, v in data.items() if k not in known})

    def dump(self) -> str:
        own = {"sample_paths": self.paths, "groups": self.groups, "active_sample": self.active, "do_compensate": self.compensated}
        own |= {"channel_tf": [t.to_json() for t in self.transforms], "gates": [g.to_json() for g in self.gates], "spill_override": self.spillover}
        return json.dumps({**self.view, **own}, indent=2)

    @property
    def next_gate_id(self) -> int:
        return max((g.id for g in self.gates), default=0) + 1
