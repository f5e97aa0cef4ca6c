"""Plane geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: cosine from which a vector lies in the cone of a direction.
CONE = 0.866


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def in_cone(x: Column, y: Column, to: tuple[float, float]) -> Column:
    """Whether a unit vector lies in the cone around a direction; null and zero vectors don't."""
    length = (to[0] ** 2 + to[1] ** 2) ** 0.5
    if not length:
        raise ValueError("a direction needs a length")
    return F.coalesce((x * F.lit(float(to[0])) + y * F.lit(float(to[1]))) / F.lit(length) > CONE, F.lit(False))


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """Unit vector, zero for zero."""
    n = norm(x, y)
    return tuple(F.when(n > 0, F.try_divide(c, n)).otherwise(F.lit(0.0)) for c in (x, y))


def half_plane(x: Column, y: Column, at: tuple[float, float], to: tuple[float, float]) -> Column:
    """Whether a point lies beyond ``at`` in the direction ``to``."""
    return (x - at[0]) * to[0] + (y - at[1]) * to[1] > 0


def point_in_box(x: Column, y: Column, box: dict[str, Column]) -> Column:
    return (x >= box["left"]) & (x <= box["right"]) & (y >= box["top"]) & (y <= box["bottom"])


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["left"] <= b["right"]) & (b["left"] <= a["right"]) & (a["top"] <= b["bottom"]) & (b["top"] <= a["bottom"])


def in_quad(points: list[tuple[Column, Column]], px: float, py: float) -> tuple[Column, Column]:
    """Bilinear point of four corners (top left, top right, bottom right, bottom left) at the shares px, py."""
    weights = ((1 - px) * (1 - py), px * (1 - py), px * py, (1 - px) * py)
    return tuple(sum((p[k] * F.lit(w) for p, w in zip(points, weights)), F.lit(0.0)) for k in (0, 1))


def affine(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the matrix rows ``m[0:3]``, ``m[3:6]``."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
