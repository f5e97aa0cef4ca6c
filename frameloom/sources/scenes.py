"""Scene tables: a sampler that makes frames from tweens, a reader of scene documents, and writers.

Tables: ``scenes`` (scene_id, duration, fps, steps, width, height), ``objects`` (scene_id, obj_idx, obj_id, source_id, shape, fill, stroke, size),
``tweens`` (scene_id, obj_idx, obj_id, tween_idx, type, duration, start, end; the last two in frames) and ``frames`` (a row for each object and frame).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.geometry import affine, unit
from frameloom.functions.motion_types import letters_to_mask
from frameloom.functions.text import px_length

#: Frames a second unless a scene says otherwise.
FPS = 60.0
ACC = ("tx", "ty", "rot", "sx", "sy", "kx", "ky")


@dataclass
class Scenes:
    """The four tables of a set of scenes."""

    scenes: DataFrame
    objects: DataFrame
    tweens: DataFrame
    frames: DataFrame


def clock(duration: Column, fps: Column) -> Column:
    """Number of steps of a finite timeline; a missing or infinite duration is an error."""
    bad = duration.isNull() | F.isnan(duration) | (duration == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("an infinite timeline needs a duration")).cast("int")).otherwise(F.ceil(duration * fps).cast("int"))


def time_of(frame: Column, duration: Column, fps: Column) -> Column:
    return F.least(frame / fps, duration)


def view_size(width: Column, height: Column, view_box: Column) -> tuple[Column, Column]:
    """Scene size: a valid px length, else that of the view box, else null."""
    box = F.split(F.trim(view_box), r"[\s,]+")
    return F.coalesce(px_length(width), F.try_to_number(F.get(box, F.lit(2)), F.lit("999999999.999999")).cast("double")), F.coalesce(px_length(height), F.try_to_number(F.get(box, F.lit(3)), F.lit("999999999.999999")).cast("double"))


def derive(frames: DataFrame) -> DataFrame:
    """Adds per-frame changes, the type mask and directions to accumulated values.

    The first frame's change is its accumulated value (for scales its ratio to 1), so a transform from the start counts as motion. Directions are
    null in the last frame.
    """
    at = Window.partitionBy("scene_id", "obj_idx").orderBy("frame")
    before = lambda c, none: F.coalesce(F.lag(f"{c}_acc").over(at), F.lit(none))
    out = frames.withColumns({c: F.col(f"{c}_acc") - before(c, 0.0) for c in ("tx", "ty", "rot", "kx", "ky")} | {c: F.try_divide(F.col(f"{c}_acc"), before(c, 1.0)) for c in ("sx", "sy")})
    letters = F.concat(*[F.when(held, F.lit(c)).otherwise(F.lit("")) for c, held in (("T", (F.col("tx") != 0) | (F.col("ty") != 0)), ("R", F.col("rot") != 0), ("S", (F.col("sx") != 1) | (F.col("sy") != 1)), ("K", (F.col("kx") != 0) | (F.col("ky") != 0)))])
    ux, uy = unit(F.col("tx"), F.col("ty"))
    inner = lambda c: F.when(F.col("frame") < F.col("steps"), c)
    return out.withColumn("letters", letters).withColumns({
        "types": letters_to_mask(F.col("letters")), "dir_tx": inner(ux), "dir_ty": inner(uy), "dir_rot": inner(F.signum("rot").cast("int")),
        "dir_sx": inner(F.signum(F.col("sx") - 1).cast("int")), "dir_sy": inner(F.signum(F.col("sy") - 1).cast("int")),
    })


def sample(scenes: DataFrame, objects: DataFrame, plan: DataFrame) -> Scenes:
    """Samples linear tweens.

    ``scenes``: scene_id, duration, fps. ``objects``: the objects table with the rest boxes ``x, y, w, h`` (screen, y downwards). ``plan``:
    scene_id, obj_id, tween_idx, type, begin and seconds, and the changes dx, dy (screen), rot, scale_x, scale_y, skew_x, skew_y. One join on the object and a window; a
    frame is a row, whatever its scene's length.
    """
    scenes = scenes.withColumn("steps", clock(F.col("duration"), F.col("fps")))
    tweens = plan.join(objects.select("scene_id", "obj_id", "obj_idx"), ["scene_id", "obj_id"]).join(scenes.select("scene_id", "fps"), "scene_id")
    own = tweens.groupBy("scene_id", "obj_idx").agg(F.collect_list(F.struct("tween_idx", "begin", "seconds", "dx", "dy", "rot", "scale_x", "scale_y", "skew_x", "skew_y")).alias("own"))
    rows = objects.join(scenes, "scene_id").join(own, ["scene_id", "obj_idx"], "left").withColumn("own", F.array_sort(F.coalesce("own", F.expr("cast(array() as array<struct<tween_idx:int,begin:double,seconds:double,dx:double,dy:double,rot:double,scale_x:double,scale_y:double,skew_x:double,skew_y:double>>)"))))
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), "steps"))).withColumn("time", time_of(F.col("frame"), F.col("duration"), F.col("fps")))

    def part(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("time") - x["begin"], x["seconds"]), F.when(F.col("time") >= x["begin"], 1.0).otherwise(0.0))))

    def total(name: str) -> Column:
        return F.aggregate("own", F.lit(0.0), lambda s, x: s + F.coalesce(x[name], F.lit(0.0)) * part(x))

    def product(name: str) -> Column:
        return F.aggregate("own", F.lit(1.0), lambda s, x: s * (1 + (F.coalesce(x[name], F.lit(1.0)) - 1) * part(x)))

    values = {"tx_acc": total("dx"), "down": total("dy"), "rot_acc": total("rot"), "sx_acc": product("scale_x"), "sy_acc": product("scale_y"), "kx_acc": total("skew_x"), "ky_acc": total("skew_y")}
    rows = rows.withColumns(values).withColumn("ty_acc", 0.0 - F.col("down"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    turn, tan = F.radians("rot_acc"), F.tan(F.radians("kx_acc"))
    m = [F.cos(turn) * F.col("sx_acc"), (F.cos(turn) * tan - F.sin(turn)) * F.col("sy_acc"), cx + F.col("tx_acc"), F.sin(turn) * F.col("sx_acc"), (F.sin(turn) * tan + F.cos(turn)) * F.col("sy_acc"), cy + F.col("down")]
    rows = rows.withColumns({f"m{i}": c for i, c in enumerate(m)})
    m = [F.col(f"m{i}") for i in range(6)]
    corner = {}
    for i, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
        corner[f"p{i}x"], corner[f"p{i}y"] = affine(m, F.col("w") * F.lit(sx / 2), F.col("h") * F.lit(sy / 2))
    rows = rows.withColumns(corner)
    xs, ys = [F.col(f"p{i}x") for i in range(4)], [F.col(f"p{i}y") for i in range(4)]
    rows = rows.withColumns({"left": F.least(*xs), "right": F.greatest(*xs), "top": F.least(*ys), "bottom": F.greatest(*ys), "wld_x": F.col("m2"), "wld_y": F.col("m5")})
    keep = ["scene_id", "obj_idx", "obj_id", "frame", "time", "steps", *[f"{c}_acc" for c in ACC], "left", "right", "top", "bottom", *corner, "wld_x", "wld_y", *[f"m{i}" for i in range(6)]]
    table = tweens.select("scene_id", "obj_idx", "obj_id", "tween_idx", "type", F.col("seconds").alias("duration"), (F.col("begin") * F.col("fps")).alias("start"), ((F.col("begin") + F.col("seconds")) * F.col("fps")).alias("end"))
    return Scenes(scenes, objects, table, derive(rows.select(*keep)))


def read_scene_json(spark: SparkSession, path: str) -> Scenes:
    """Reads scene documents: one JSON object a file, with ``info`` and one entry for each element."""
    return from_documents(spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_data)?\.json$", 1).alias("scene_id"), "value"))


def from_documents(texts: DataFrame) -> Scenes:
    """The tables of scene documents (``scene_id, value``).

    Elements are keys, so a document is first a map of texts. Arrays shorter than the longest give nulls in the last frame. Documents are parsed to maps once: the four tables read them from a cache.
    """
    docs = texts.select("scene_id", F.from_json("value", "map<string,string>").alias("m")).persist()
    info = docs.select("scene_id", "m", F.from_json(F.col("m")["info"], "duration double, fps double, steps int, `scene-size` struct<width:double,height:double>, objects array<struct<id:string,sourceId:string,shape:string,fill:string,stroke:string,size:array<double>>>").alias("i"))
    scenes = info.select("scene_id", "i.duration", "i.fps", "i.steps", F.col("i.scene-size.width").alias("width"), F.col("i.scene-size.height").alias("height"))
    objects = info.select("scene_id", F.posexplode("i.objects").alias("obj_idx", "o")).select("scene_id", "obj_idx", F.col("o.id").alias("obj_id"), F.col("o.sourceId").alias("source_id"), "o.shape", "o.fill", "o.stroke", "o.size")
    box = "array<struct<top:double,left:double,bottom:double,right:double,width:double,height:double>>"
    series = {"translateX_acc": "tx_acc", "translateY_acc": "ty_acc", "rotate_acc": "rot_acc", "scaleX_acc": "sx_acc", "scaleY_acc": "sy_acc", "skewX_acc": "kx_acc", "skewY_acc": "ky_acc"}
    kind = ", ".join(f"{k} array<double>" for k in series) + f", AABB {box}, transformedPts array<array<array<double>>>, wldOrigin array<array<double>>, tweens array<struct<type:string,duration:double,start:double,end:double>>"
    elements = info.select("scene_id", F.col("i.steps").alias("steps"), F.explode(F.map_filter("m", lambda k, v: k != "info")).alias("obj_id", "doc")).select("scene_id", "steps", "obj_id", F.from_json("doc", kind).alias("e"))
    elements = elements.join(objects.select("scene_id", "obj_id", "obj_idx"), ["scene_id", "obj_id"])
    tweens = elements.select("scene_id", "obj_idx", "obj_id", F.posexplode("e.tweens").alias("tween_idx", "t")).select("scene_id", "obj_idx", "obj_id", "tween_idx", "t.*")
    zipped = F.arrays_zip(*[F.col(f"e.{k}") for k in series], F.col("e.AABB"), F.col("e.transformedPts"), F.col("e.wldOrigin"))
    long = elements.select("scene_id", "obj_idx", "obj_id", "steps", F.posexplode(zipped).alias("frame", "z"))
    points = {f"p{i}{c}": F.get(F.get("z.transformedPts", F.lit(i)), F.lit(j)) for i in range(4) for j, c in enumerate("xy")}
    frames = long.select("scene_id", "obj_idx", "obj_id", "frame", "steps", *[F.col(f"z.{k}").alias(v) for k, v in series.items()], *[F.col(f"z.AABB.{c}").alias(c) for c in ("left", "right", "top", "bottom")], *[c.alias(n) for n, c in points.items()], F.get("z.wldOrigin", F.lit(0)).alias("wld_x"), F.get("z.wldOrigin", F.lit(1)).alias("wld_y"))
    return Scenes(scenes, objects, tweens, derive(frames))


def object_list(elements: DataFrame) -> DataFrame:
    """Objects of a document's elements (scene_id, doc_idx, obj_id, tag, width, height, r, fill, animated), animated ones first.

    Ids with ``ignore``, definitions and masks are left out; ``custom-<shape>-<fill>`` and ``letter-<x>`` ids name the shape.
    """
    part = F.split("obj_id", "-")
    custom = F.col("obj_id").startswith("custom-")
    shape = (
        F.when(custom, F.get(part, F.lit(1)))
        .when(F.col("tag") == "rect", F.when(F.col("width") == F.col("height"), "square").otherwise("rectangle"))
        .when(F.col("tag") == "path", F.when(F.col("obj_id").startswith("letter-"), F.get(part, F.lit(1))))
        .otherwise(F.col("tag"))
    )
    size = F.when(F.col("tag") == "circle", F.array(F.col("r") * 2, F.col("r") * 2)).when(F.col("tag") == "rect", F.array("width", "height"))
    kept = elements.where(~F.contains(F.col("obj_id"), F.lit("ignore")) & ~F.col("tag").isin("defs", "mask"))
    order = Window.partitionBy("scene_id").orderBy(F.when(F.col("animated"), 0).otherwise(1), "doc_idx")
    return kept.select("scene_id", (F.row_number().over(order) - 1).alias("obj_idx"), "obj_id", F.lit(None).cast("string").alias("source_id"), shape.alias("shape"), F.when(custom & (F.size(part) > 2), F.get(part, F.lit(2))).otherwise(F.lower("fill")).alias("fill"), F.lit(None).cast("string").alias("stroke"), size.alias("size"))


def enumerate_elements(elements: DataFrame, tweens: DataFrame, graphical: list[str]) -> DataFrame:
    """Elements with ``animated``: those of any depth with a tween, and direct children (``depth`` 1) without one.

    ``elements``: scene_id, doc_idx, obj_id, tag, depth and what :func:`object_list` needs. Tweens decide by a semi and an anti join; ids with ``ignore`` and
    tags that aren't graphical (for unanimated ones also masks) are left out.
    """
    moved = tweens.select("scene_id", "obj_id").distinct()
    some = elements.where(F.col("tag").isin(*graphical) & ~F.contains(F.col("obj_id"), F.lit("ignore")))
    animated = some.join(moved, ["scene_id", "obj_id"], "left_semi").withColumn("animated", F.lit(True))
    still = some.where((F.col("depth") == 1) & (F.col("tag") != "mask")).join(moved, ["scene_id", "obj_id"], "left_anti").withColumn("animated", F.lit(False))
    return animated.unionByName(still)


def surrogate_keys(elements: DataFrame, id_col: str, path_col: str, keys: list[str], prefix: str = "__el_") -> DataFrame:
    """Adds ``key``: the id where it is the only one of its kind, else the prefix and the element's path, with as many underscores in front as make it no element's id."""
    many = F.count("*").over(Window.partitionBy(*keys, id_col)) > 1
    lacks = F.col(id_col).isNull() | (F.col(id_col) == "") | many
    path = F.col(path_col).cast("string")
    # ids that are a surrogate behind underscores, by the path they would stand for
    stem = F.regexp_extract(F.col(id_col), f"^_*{prefix.lstrip('_')}(.*)$", 1)
    taken = elements.where(F.col(id_col).rlike(f"^_*{prefix}")).select(*keys, stem.alias("__path"), F.col(id_col).alias("__id")).groupBy(*keys, "__path").agg(F.collect_set("__id").alias("__taken"))
    rows = elements.withColumn("__lacks", lacks).withColumn("__path", path).join(taken, [*keys, "__path"], "left")
    own = F.concat(F.lit(prefix), F.col("__path"))
    free = F.aggregate(F.sequence(F.lit(0), F.size("__taken")), own, lambda k, _: F.when(F.array_contains("__taken", k), F.concat(F.lit("_"), k)).otherwise(k))
    key = F.when(~F.col("__lacks"), F.col(id_col)).when(F.col("__taken").isNull(), own).otherwise(free)
    return rows.withColumn("key", key).select(*[F.col(c) for c in elements.columns], "key")


def keyframe_times(tweens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, type, k, time``: the distinct sorted ends of the tweens of a type."""
    ends = tweens.select(*keys, "type", F.explode(F.array("start", "end")).alias("time")).distinct()
    return ends.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "type").orderBy("time")) - 1)


def property_series(frames: DataFrame, names: list[str]) -> DataFrame:
    """Long form of frame columns: ``scene_id, obj_idx, frame, prop, value``."""
    return frames.unpivot(["scene_id", "obj_idx", "frame"], [F.col(n).cast("string").alias(n) for n in names], "prop", "value")


def animated_properties(declared: DataFrame, aliases: DataFrame) -> DataFrame:
    """``scene_id, obj_id, props``: declared properties under their own names, with the corners if one is spatial.

    ``declared``: scene_id, obj_id, prop. ``aliases``: alias, prop, spatial (a fixed small table).
    """
    named = declared.join(F.broadcast(aliases).withColumnRenamed("prop", "to"), F.col("prop") == F.col("alias"), "left")
    sets = named.groupBy("scene_id", "obj_id").agg(F.collect_set(F.coalesce("to", "prop")).alias("props"), F.coalesce(F.max("spatial"), F.lit(False)).alias("spatial"))
    return sets.select("scene_id", "obj_id", F.array_sort(F.when(F.col("spatial"), F.array_union("props", F.array(F.lit("transformedPts")))).otherwise(F.col("props"))).alias("props"))


def write_scenes(found: Scenes, path: str) -> None:
    """Writes the tables as Parquet, frames in files by scene."""
    for name in ("scenes", "objects", "tweens"):
        getattr(found, name).write.mode("overwrite").parquet(f"{path}/{name}")
    found.frames.repartition("scene_id").sortWithinPartitions("scene_id", "obj_idx", "frame").write.mode("overwrite").parquet(f"{path}/frames")


def read_scenes(spark: SparkSession, path: str) -> Scenes:
    return Scenes(*(spark.read.parquet(f"{path}/{n}") for n in ("scenes", "objects", "tweens", "frames")))
