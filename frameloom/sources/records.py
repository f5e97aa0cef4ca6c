"""Documents around scenes: JSON sinks, data sets of prompts, run logs, configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.ordinal import numbered, running_sum
from frameloom.scratch import written
from frameloom.sources.scenes import ACC, Scenes

#: Names of the accumulated series in scene documents.
SERIES = dict(zip(ACC, ("translateX_acc", "translateY_acc", "rotate_acc", "scaleX_acc", "scaleY_acc", "skewX_acc", "skewY_acc")))
KINDS = ("data", "data_keyframes", "data_rendered", "properties")
#: Bytes of documents in a bundle.
BUNDLE_BYTES = 64 << 20
#: Bundles that a reader names one by one, so that the others' files are not even listed; more of them are met by a join.
FEW_BUNDLES = 10_000


def _element(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _document(elements: DataFrame, first: Column | None = None) -> DataFrame:
    """``scene_id, value``: one JSON object of each scene, its elements' keys in the order of the objects."""
    entry = F.concat(F.to_json(F.struct(F.col("obj_id").alias("k"))).substr(F.lit(6), F.lit(1 << 30)), F.lit(""))
    name = F.substring(entry, F.lit(1), F.length(entry) - 1)  # the id as a JSON text
    line = F.concat(name, F.lit(": "), F.col("doc"))
    rows = elements.groupBy("scene_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("obj_idx", line.alias("l"))))["l"], ", ").alias("body"))
    return rows.select("scene_id", F.concat(F.lit("{"), F.col("body"), F.lit("}")).alias("value")) if first is None else rows


def data_documents(found: Scenes) -> DataFrame:
    """``scene_id, value``: the scene document, as :func:`frameloom.sources.scenes.read_scene_json` reads it.

    A scene's frames meet in one row (a document is one file); scenes are independent.
    """
    box = F.struct("top", "left", "bottom", "right", (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))
    corners = F.array(*[F.array(f"p{i}x", f"p{i}y") for i in range(4)])
    cells = F.struct("frame", *[F.col(f"{c}_acc").alias(n) for c, n in SERIES.items()], box.alias("AABB"), corners.alias("transformedPts"), F.array("wld_x", "wld_y").alias("wldOrigin"))
    frames = found.frames.groupBy("scene_id", "obj_idx", "obj_id").agg(F.array_sort(F.collect_list(cells)).alias("c"))
    tweens = found.tweens.groupBy("scene_id", "obj_idx").agg(F.array_sort(F.collect_list(F.struct("tween_idx", "type", "duration", "start", "end"))).alias("t"))
    rows = frames.join(tweens, ["scene_id", "obj_idx"], "left")
    plain = F.transform(F.coalesce("t", F.array().cast("array<struct<tween_idx:int,type:string,duration:double,start:double,end:double>>")), lambda t: F.struct(t["type"].alias("type"), t["duration"].alias("duration"), t["start"].alias("start"), t["end"].alias("end")))
    docs = rows.select("scene_id", "obj_idx", "obj_id", _element(F.struct(*[F.col("c")[n].alias(n) for n in (*SERIES.values(), "AABB", "transformedPts", "wldOrigin")], plain.alias("tweens"))).alias("doc"))
    columns = {"id": "obj_id", "sourceId": "source_id", "shape": "shape", "fill": "fill", "stroke": "stroke", "size": "size"}
    item = F.struct(*[F.col(c).alias(n) for n, c in columns.items() if c in found.objects.columns])
    objects = found.objects.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("obj_idx", item.alias("o"))))["o"].alias("objects"))
    size = F.struct(*[F.col(c) if c in found.scenes.columns else F.lit(None).cast("double").alias(c) for c in ("width", "height")])
    info = found.scenes.join(objects, "scene_id", "left").select("scene_id", _element(F.struct("duration", "fps", "steps", size.alias("scene-size"), "objects")).alias("info"))
    whole = info.join(_document(docs, F.lit("")), "scene_id", "left")
    return whole.select("scene_id", F.concat(F.lit('{"info": '), F.col("info"), F.coalesce(F.concat(F.lit(", "), F.col("body")), F.lit("")), F.lit("}")).alias("value"))


def keyframe_values(times: DataFrame, frames: DataFrame, scenes: DataFrame, names: Sequence[str], keys: Sequence[str] = ("scene_id", "obj_idx")) -> DataFrame:
    """``keys, type, k, time`` and the sampled ``names`` at each keyframe time (in frames): those of the nearest sampled frame, the last one beyond the end."""
    at = times.join(scenes.select(keys[0], "steps"), keys[0]).withColumn("frame", F.least(F.round("time").cast("int"), F.col("steps")))
    return at.join(frames.select(*keys, "frame", *names), [*keys, "frame"]).select(*keys, "type", "k", "time", *names)


def keyframe_documents(values: DataFrame, objects: DataFrame, names: Sequence[str]) -> DataFrame:
    """``scene_id, value``: for each object its keyframes by type."""
    cells = values.groupBy("scene_id", "obj_idx", "type").agg(F.array_sort(F.collect_list(F.struct("k", "time", *names))).alias("c"))
    per = cells.groupBy("scene_id", "obj_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.struct(F.col("c")["time"].alias("time"), *[F.col("c")[n].alias(n) for n in names]))))).alias("m"))
    return _document(per.join(objects.select("scene_id", "obj_idx", "obj_id"), ["scene_id", "obj_idx"]).select("scene_id", "obj_idx", "obj_id", _element(F.col("m")).alias("doc")))


def rendered_documents(series: DataFrame, objects: DataFrame) -> DataFrame:
    """``scene_id, value``: for each object its recorded properties (``scene_id, obj_idx, frame, prop, value``) as arrays by frame."""
    rows = series.groupBy("scene_id", "obj_idx", "prop").agg(F.array_sort(F.collect_list(F.struct("frame", "value")))["value"].alias("v"))
    per = rows.groupBy("scene_id", "obj_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "v")))).alias("m"))
    return _document(per.join(objects.select("scene_id", "obj_idx", "obj_id"), ["scene_id", "obj_idx"]).select("scene_id", "obj_idx", "obj_id", _element(F.col("m")).alias("doc")))


def property_documents(props: DataFrame) -> DataFrame:
    """``scene_id, value``: for each object the names of its animated properties (``scene_id, obj_id, props``)."""
    return _document(props.withColumn("obj_idx", F.col("obj_id")).select("scene_id", "obj_idx", "obj_id", _element(F.col("props")).alias("doc")))


def write_documents(docs: DataFrame, path: str, kind: str, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes the documents of one kind (``scene_id, value``, one of each scene) in bundles of about ``bundle_bytes``, and an index of where each scene's document lies.

    Documents stand in the order of their scenes; a running sum of their sizes says which bundle each is in, so the number of files follows the bytes, not the scenes, and a rerun makes the same bundles. A document that is larger
    than a bundle has one of its own, or the end of one. ``<path>/bundles/kind=<kind>/bundle=<n>`` and ``<path>/index/kind=<kind>`` are replaced.
    """
    if kind not in KINDS:
        raise ValueError(f"one of {KINDS}")
    named = docs.select(F.col("scene_id").cast("string").alias("scene_id"), "value")
    sizes = named.select("scene_id", F.octet_length("value").cast("bigint").alias("size"))
    index = running_sum(sizes, [F.col("scene_id")], F.col("size"), "offset").withColumn("bundle", F.floor(F.col("offset") / bundle_bytes))
    index.write.mode("overwrite").parquet(f"{path}/index/kind={kind}")
    placed = named.join(docs.sparkSession.read.parquet(f"{path}/index/kind={kind}").select("scene_id", "bundle"), "scene_id")
    placed.repartition("bundle").sortWithinPartitions("bundle", "scene_id").write.mode("overwrite").partitionBy("bundle").parquet(f"{path}/bundles/kind={kind}")


def read_documents(spark: SparkSession, path: str, kind: str, scenes: DataFrame | None = None) -> DataFrame:
    """``scene_id, value`` of the documents of one kind; with ``scenes`` (``scene_id``) only of those, from the bundles that the index names."""
    docs = spark.read.parquet(f"{path}/bundles/kind={kind}")
    if scenes is not None:
        wanted = scenes.select(F.col("scene_id").cast("string").alias("scene_id")).distinct()
        bundles = spark.read.parquet(f"{path}/index/kind={kind}").join(wanted, "scene_id", "left_semi").select("bundle").distinct()  # at most as many as there are bundles
        named = [r.bundle for r in bundles.limit(FEW_BUNDLES + 1).collect()]
        docs = docs.where(F.col("bundle").isin(named)) if len(named) <= FEW_BUNDLES else docs.join(bundles, "bundle", "left_semi")
        docs = docs.join(wanted, "scene_id", "left_semi")
    return docs.select("scene_id", "value")


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A data set of prompts: a JSON list of objects."""
    return spark.read.json(path, schema=schema, multiLine=True)


def write_dataset(entries: DataFrame, path: str, order: Sequence[str]) -> None:
    """Writes a data set as one JSON list of objects in order: an object a line, in files that make the list when they are put together in the order of their names."""
    rows = numbered(entries.select(*[F.col(c).alias(f"at{i}") for i, c in enumerate(order)], _element(F.struct(*entries.columns)).alias("v")), [F.col(f"at{i}") for i in range(len(order))], "n")
    rows = written(rows.select("n", "v"), "dataset")
    last = rows.agg(F.max("n")).first()[0]
    if last is None:
        entries.sparkSession.range(1).select(F.lit("[]").alias("value")).write.mode("overwrite").text(path)
        return
    line = F.concat(F.when(F.col("n") == 0, F.lit("[\n")).otherwise(F.lit("")), "v", F.when(F.col("n") == last, F.lit("\n]")).otherwise(F.lit(",")))
    rows.repartitionByRange("n").sortWithinPartitions("n").select(line.alias("value")).write.mode("overwrite").text(path)


def read_dataset_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A data set as :func:`write_dataset` leaves it, read line by line: no task reads the whole list."""
    lines = spark.read.text(path).where(~F.trim("value").isin("[", "]", "[]", ""))
    return lines.select(F.from_json(F.regexp_replace("value", r",\s*$", ""), schema).alias("v")).select("v.*")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends log rows (``run, kind, seq, role, text``; kind is chat, success, fail or error) to the runs table."""
    rows.select("run", "kind", "seq", "role", "text").write.mode("append").parquet(path)


def read_config(text: str, required: Sequence[str]) -> dict[str, object]:
    """A configuration: ``key: value`` lines, nested by indentation; numbers, booleans, null and quoted texts are read as such. Missing keys raise."""
    root: dict[str, object] = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number}: a key and a colon expected")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = _scalar(value.strip())
        else:
            inner: dict[str, object] = {}
            stack[-1][1][key.strip()] = inner
            stack.append((indent, inner))
    missing = [k for k in required if k not in root]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return root


def _scalar(value: str):
    if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(value.lower())
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value
