"""Gates of a Gating-ML 2.0 document."""

from __future__ import annotations

import math
from xml.etree import ElementTree

from ..model import Gate

_SPACE = "http://www.isac-net.org/std/Gating-ML/v2.0/"
_GATING, _DATA = f"{{{_SPACE}gating}}", f"{{{_SPACE}datatypes}}"


def read_gating_ml(text: str) -> list[Gate]:
    """Rectangles, ranges, polygons and Boolean gates of a document, on linear axes of data values, numbered from 1 in its order.

    Names are the document's ids; open bounds are infinite. A gate whose parent isn't in the document stays an orphan (parent 0).
    Dimensions that refer to a compensation are returned like others: the caller's events have to be compensated.
    Raises ValueError for other kinds of gates, and for transforms.
    """
    found = list(ElementTree.fromstring(text.encode()))
    ids = {e.get(f"{_GATING}id"): i for i, e in enumerate(found, 1)}
    return [_gate(e, ids) for e in found]


def _gate(e: ElementTree.Element, ids: dict[str, int]) -> Gate:
    name, parent, kind = e.get(f"{_GATING}id"), e.get(f"{_GATING}parent_id"), e.tag.removeprefix(_GATING)
    dims = e.findall(f"{_GATING}dimension")
    if any(d.get(f"{_GATING}transformation-ref") for d in dims):
        raise ValueError(f"{name}: transforms aren't read")
    channels = [d.find(f"{_DATA}fcs-dimension").get(f"{_DATA}name") for d in dims]
    bounds = [(float(d.get(f"{_GATING}min", -math.inf)), float(d.get(f"{_GATING}max", math.inf))) for d in dims]
    if kind == "RectangleGate" and len(dims) in (1, 2):
        shape = {"shape": "rect" if len(dims) == 2 else "range"} | {f"{axis}_{end}": v for axis, b in zip("xy", bounds, strict=False) for end, v in zip(("min", "max"), b, strict=True)}
    elif kind == "PolygonGate" and len(dims) == 2:
        points = [[float(c.get(f"{_DATA}value")) for c in v.findall(f"{_GATING}coordinate")] for v in e.findall(f"{_GATING}vertex")]
        shape = {"shape": "polygon", "vertices": points}
    elif kind == "BooleanGate" and len(e) == 1:
        refs = [ids.get(r.get(f"{_GATING}ref"), 0) for r in e[0].findall(f"{_GATING}gateReference")]
        shape = {"shape": "boolean", "op": e[0].tag.removeprefix(_GATING), "refs": refs}
    else:
        raise ValueError(f"{name}: {kind} isn't read")
    x, y = (channels[0], channels[-1]) if channels else ("", "")
    return Gate(ids[name], name, shape, None if parent is None else ids.get(parent, 0), x, y)
