"""The thirteen interval relations as columns, with a tolerance, in time and along either screen axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("precedes", "preceded_by", "meets", "met_by", "overlaps", "overlapped_by", "finished_by", "finishes", "contains", "during", "starts", "started_by", "equals")
#: Relations whose operands are swapped in another one.
INVERSE = {"preceded_by": "precedes", "met_by": "meets", "overlapped_by": "overlaps", "finishes": "finished_by", "during": "contains", "started_by": "starts"}
TOLERANCE = 5.0

# Relation sets of the temporal aggregates and of the screen regions (x relations, y relations).
T_BEFORE = ("precedes", "meets", "overlaps", "finished_by", "contains")
T_WHILE = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
T_AFTER = ("during", "finishes", "overlapped_by", "met_by", "preceded_by")
TEMPORAL = {"t_before": T_BEFORE, "t_while": T_WHILE, "t_after": T_AFTER}
_LOW = ("precedes", "meets", "overlaps", "finished_by")
_HIGH = ("started_by", "overlapped_by", "met_by", "preceded_by")
_INNER = T_WHILE
_EDGE = ("meets", "finished_by", "starts", "equals", "started_by", "finishes", "met_by")
REGIONS = {
    "s_top": ((RELATIONS, ("contains", *_HIGH)),),
    "s_bottom": ((RELATIONS, _LOW),),
    "s_left": ((_LOW, RELATIONS),),
    "s_right": ((_HIGH, RELATIONS),),
    "s_top_left": (((*_LOW, "contains"), ("contains", *_HIGH)),),
    "s_top_right": ((_HIGH, ("contains", *_HIGH)),),
    "s_bottom_left": (((*_LOW, "contains"), _LOW),),
    "s_bottom_right": ((_HIGH, _LOW),),
    "s_intersect": ((_INNER, _INNER),),
    "s_border": ((_EDGE, (*_INNER, "meets", "met_by")), (("overlaps", "contains", "during", "overlapped_by"), _EDGE)),
    "s_top_border": ((RELATIONS, ("finished_by", "equals", "finishes", "met_by")),),
    "s_bottom_border": ((RELATIONS, ("meets", "starts", "equals", "started_by")),),
    "s_left_border": ((("meets", "starts", "equals", "started_by"), RELATIONS),),
    "s_right_border": ((("finished_by", "equals", "finishes", "met_by"), RELATIONS),),
}


def is_close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Whether a lies within the tolerance of the target b; null counts as no."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def relation(name: str, a: tuple[Column, Column], b: tuple[Column, Column], descending: bool = False, gap: float = 0.0) -> Column:
    """One relation between the intervals a and b.

    ``descending``: starts are the greater numbers (the vertical screen axis, read upwards). ``gap``: what must lie between
    intervals that precede each other (1 for frames).
    """
    if name in INVERSE:
        return relation(INVERSE[name], b, a, descending, gap)
    (s, e), (u, v) = a, b
    before = (lambda x, y: x > y) if descending else (lambda x, y: x < y)
    near = lambda x, y: is_close(x, y, TOLERANCE)
    held = {
        "precedes": lambda: before(e + F.lit(gap) if gap else e, u),
        "meets": lambda: near(e, u),
        "overlaps": lambda: before(s, u) & before(u, e) & before(e, v),
        "finished_by": lambda: before(s, u) & near(e, v),
        "contains": lambda: before(s, u) & before(v, e),
        "starts": lambda: near(s, u) & before(e, v),
        "equals": lambda: near(s, u) & near(e, v),
    }[name]()
    return F.coalesce(held, F.lit(False))


def any_relation(names: tuple[str, ...], a: tuple[Column, Column], b: tuple[Column, Column], descending: bool = False, gap: float = 0.0) -> Column:
    """Whether one of the relations holds. All thirteen cover every pair of finite intervals."""
    if len(set(names)) == len(RELATIONS):
        return a[0].isNotNull() & a[1].isNotNull() & b[0].isNotNull() & b[1].isNotNull()
    out = F.lit(False)
    for name in names:
        out = out | relation(name, a, b, descending, gap)
    return out


def region(name: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether box a lies in a region of box b. Boxes have left, right, top and bottom in screen coordinates (y downwards)."""
    x = (a["left"], a["right"]), (b["left"], b["right"])
    y = (a["bottom"], a["top"]), (b["bottom"], b["top"])
    out = F.lit(False)
    for on_x, on_y in REGIONS[name]:
        out = out | (any_relation(on_x, *x) & any_relation(on_y, *y, descending=True))
    return out


def axis_relation(name: str, dim: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """One relation between the projections of two boxes on "x" or "y"."""
    if dim == "x":
        return relation(name, (a["left"], a["right"]), (b["left"], b["right"]))
    if dim == "y":
        return relation(name, (a["bottom"], a["top"]), (b["bottom"], b["top"]), descending=True)
    raise ValueError(f"dimension {dim!r}")
