"""Motion predicates. Frame-local ones are columns over frames; those over tweens give marked frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.allen import is_close
from frameloom.functions.geometry import in_cone, in_quad
from frameloom.functions.motion_types import ROTATE, SCALE, TRANSLATE, atoms
from frameloom.operators.runs import covered

KEYS = ["scene_id", "obj_idx"]


def has_type(mask: int, types: Column) -> Column:
    return F.coalesce(types.bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def _axes(target, values) -> Column:
    """Per-axis comparison in which a target of zero leaves its axis open."""
    out = F.lit(True)
    for t, same in zip(target, values):
        if t:
            out = out & F.coalesce(same, F.lit(False))
    return out


def direction(mask: int, target, types: str = "types", prefix: str = "dir_") -> Column:
    """Whether a frame moves in a direction, for any single type of the mask that the frame has.

    Translation: within the cone around [x, y]. Rotation: "clockwise", anything else the other way. Scaling: the signs of [x, y].
    """
    col, out = lambda n: F.col(prefix + n), F.lit(False)
    for kind in atoms(mask):
        if kind == TRANSLATE and not isinstance(target, str):
            held = in_cone(col("tx"), col("ty"), target)
        elif kind == ROTATE:
            held = col("rot") == (1 if target == "clockwise" else -1)
        elif kind == SCALE and not isinstance(target, str):
            held = _axes(target, (col(n) == F.signum(F.lit(float(t))).cast("int") for n, t in zip(("sx", "sy"), target)))
        else:
            continue
        out = out | (has_type(kind, F.col(types)) & F.coalesce(held, F.lit(False)))
    return out


def magnitude(frames: DataFrame, tweens: DataFrame, scenes: DataFrame, mask: int, target, keys: list[str] = KEYS) -> DataFrame:
    """Marked frames of tweens that reach a magnitude: the frames of :func:`magnitude_spans`."""
    return covered(magnitude_spans(frames, tweens, scenes, mask, target, keys), keys)


def magnitude_spans(frames: DataFrame, tweens: DataFrame, scenes: DataFrame, mask: int, target, keys: list[str] = KEYS) -> DataFrame:
    """``keys, s, e`` of tweens that reach a magnitude.

    From a tween's first frame on, the last frame whose accumulated change is within 0.1 of the target ends the marked frames: before it for
    translation and scaling, with it for rotation. A frame must have the type; the tween's own type doesn't matter. A tween's
    frames are exploded and joined by object and frame, so that a long scene's frames don't meet all tweens.
    """
    wide = tweens.select(*keys, "tween_idx", F.floor("start").cast("int").alias("sf"), F.ceil("end").cast("int").alias("ef"))
    spans = wide.join(scenes.select(keys[0], "steps"), keys[0])
    base = frames.select(*keys, F.col("frame").alias("sf"), *[F.col(c).alias("b_" + c) for c in ("tx_acc", "ty_acc", "rot_acc", "sx_acc", "sy_acc")])
    last_frame = F.least(F.col("ef"), F.col("steps"))
    own = spans.join(base, [*keys, "sf"]).where(F.col("sf") <= last_frame).withColumn("frame", F.explode(F.sequence("sf", last_frame)))
    rows = own.join(frames.select(*keys, "frame", "types", "tx_acc", "ty_acc", "rot_acc", "sx_acc", "sy_acc"), [*keys, "frame"])
    d = lambda c: F.col(c + "_acc") - F.col(f"b_{c}_acc")
    hits = []
    for kind in atoms(mask):
        if kind == SCALE:
            ratio = [F.try_divide(F.col(f"{c}_acc"), F.col(f"b_{c}_acc")) for c in ("sx", "sy")]
            near = _axes(target, (is_close(r, F.lit(float(t)), 0.1) for r, t in zip(ratio, target)))
        else:
            size = F.sqrt(d("tx") ** 2 + d("ty") ** 2) if kind == TRANSLATE else F.abs(d("rot"))
            near = is_close(size, F.lit(float(target)), 0.1)
        end = F.least(F.col("frame") + 1, F.col("steps")) - 1 if kind == ROTATE else F.col("frame") - 1
        hits.append(F.when(has_type(kind, F.col("types")) & near, end))
    last = F.greatest(*hits) if len(hits) > 1 else hits[0]
    spans = rows.groupBy(*keys, "tween_idx", "sf").agg(F.max(last).alias("e")).where("e is not null")
    return spans.select(*keys, F.col("sf").alias("s"), "e")


def duration(tweens: DataFrame, scenes: DataFrame, mask: int, seconds: float, keys: list[str] = KEYS) -> DataFrame:
    """Marked frames of tweens of one of the types that last so long."""
    return covered(duration_spans(tweens, scenes, mask, seconds, keys), keys)


def duration_spans(tweens: DataFrame, scenes: DataFrame, mask: int, seconds: float, keys: list[str] = KEYS) -> DataFrame:
    """``keys, s, e`` of such tweens: from the first frame to the one after the last."""
    names = [n for n, m in (("translate", TRANSLATE), ("rotate", ROTATE), ("scale", SCALE)) if m & mask]
    some = tweens.where(F.col("type").isin(names) & is_close(F.col("duration"), F.lit(float(seconds))))
    end = F.least(F.ceil("end") + 1, F.col("steps")) - 1
    return some.join(scenes.select(keys[0], "steps"), keys[0]).select(*keys, F.floor("start").alias("s"), end.alias("e"))


def post(tweens: DataFrame, scenes: DataFrame, rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Marked frames of tweens at whose end a spatial relation holds."""
    return covered(post_spans(tweens, scenes, rel, keys), keys)


def post_spans(tweens: DataFrame, scenes: DataFrame, rel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys, s, e`` of tweens at whose end a spatial relation (``scene_id, frame, holds``) holds; the type doesn't matter."""
    at = tweens.join(scenes.select(keys[0], "steps"), keys[0]).withColumn("frame", F.least(F.ceil("end"), F.col("steps") - 1).cast("int"))
    held = at.join(rel.where("holds").select(keys[0], "frame"), [keys[0], "frame"], "left_semi")
    return held.select(*keys, F.floor("start").alias("s"), F.least(F.ceil("end") - 1, F.col("steps") - 1).alias("e"))


def origin(target, wld: tuple[Column, Column], corners: list[tuple[Column, Column]]) -> Column:
    """Whether the transform origin is at a point: pixels, columns, or two percentages of the transformed box."""
    if any(isinstance(t, str) and "%" in t for t in target):
        if not all(isinstance(t, str) and "%" in t for t in target):
            raise ValueError("both parts of an origin are percentages, or none")
        at = in_quad(corners, *(float(t.replace("%", "")) / 100 for t in target))
    else:
        at = tuple(t if isinstance(t, Column) else F.lit(float(t)) for t in target)
    return is_close(wld[0], at[0], 0.1) & is_close(wld[1], at[1], 0.1)


def agent(chosen: Column, types: Column) -> Column:
    """Whether a chosen object moves in the frame."""
    return chosen & F.coalesce(types != 0, F.lit(False))
