"""Registered queries of documents, run tables, element lists, comparisons and point queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.operators import analytics
from frameloom.operators.ordinal import numbered
from frameloom.plans.driver_queries import OBJECTS, PAIRS, TWEENS, day_tweens, load, neighbours, objects, register
from frameloom.plans.program_queries import SCENES, scene_tables
from frameloom.scratch import fresh_path
from frameloom.sources import records
from frameloom.sources import scenes as sc

C = F.col

# run tables

_LOG = """log_ AS (SELECT conv_id, 'chat' AS kind, role FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'success' ELSE 'fail' END, NULL FROM labels UNION ALL SELECT doc_id, 'error', NULL FROM labels WHERE doc_id % 11 = 0)"""


def _log(s, d):
    talk = load(s, d, "conversations").where(C("conv_id") % 7 != 0).select(C("conv_id").alias("run"), F.lit("chat").alias("kind"), "role")
    labels, none = load(s, d, "labels"), F.lit(None).cast("string").alias("role")
    marks = labels.select(C("doc_id").alias("run"), F.when(C("quality") == 1, "success").otherwise("fail").alias("kind"), none)
    return talk.union(marks).union(labels.where(C("doc_id") % 11 == 0).select("doc_id", F.lit("error"), none))


register("q_runs_table", f"WITH {_LOG} SELECT conv_id AS run, nullif(count(*) FILTER (kind = 'chat' AND role = 'assistant'), 0) AS turns, bool_or(kind = 'error') OR NOT bool_or(kind = 'chat') AS has_error, bool_or(kind = 'success') AS has_success, bool_or(kind = 'fail') AS has_fail FROM log_ GROUP BY 1")(
    lambda s, d: analytics.log_runs(_log(s, d))
)
_RUN_NAMES = "names AS (SELECT p_partkey, lower(replace(p_type, ' ', '_')) || '_' || lpad(CAST(p_partkey % 37 AS VARCHAR), 2, '0') || '_' || p_partkey AS name FROM part)"
_names = lambda s, d: load(s, d, "part").select("p_partkey", F.concat_ws("_", F.lower(F.translate("p_type", " ", "_")), F.lpad((C("p_partkey") % 37).cast("string"), 2, "0"), C("p_partkey").cast("string")).alias("name"))
register("q_prompt_filter", f"WITH {_RUN_NAMES}, prompts AS (SELECT name FROM names WHERE p_partkey % 3 = 0) SELECT p_partkey FROM names SEMI JOIN prompts USING (name) WHERE starts_with(name, 's')")(
    lambda s, d: analytics.prompted(_names(s, d), _names(s, d).where(C("p_partkey") % 3 == 0), "name", "s").select("p_partkey")
)
register("q_run_order", f"WITH {_RUN_NAMES} SELECT p_partkey, CAST(row_number() OVER (ORDER BY string_split(name, '_')[3:], name) AS INTEGER) AS place FROM names")(
    lambda s, d: numbered(_names(s, d).withColumn("at", analytics.run_order(C("name"))), [C("at"), C("name")], "n").select("p_partkey", (C("n") + 1).cast("int").alias("place"))
)

# comparison

register("q_prop_compare_equal", f"WITH {OBJECTS} SELECT obj_idx, coalesce(fill = lead(fill) OVER (ORDER BY obj_idx), false) AS same FROM objects")(
    lambda s, d: analytics.equal_values(objects(s, d).select("obj_idx", C("fill").alias("value")), objects(s, d).select((C("obj_idx") - 1).alias("obj_idx"), C("fill").alias("value")), ["obj_idx"]).join(objects(s, d).select("obj_idx"), "obj_idx", "left_semi")
)


@register("q_prop_compare_iou", f"""WITH {PAIRS}, m AS (SELECT *, greatest(0, least(ar, br) - greatest(al, bl)) * greatest(0, least(a_bot, b_bot) - greatest(a_top, b_top)) AS both_ FROM pairs)
  SELECT a, b, frame, round(coalesce(both_ / nullif((ar - al) * (a_bot - a_top) + (br - bl) * (b_bot - b_top) - both_, 0), 0), 6) AS iou FROM m""")
def _iou(s, d):
    rows, a, b = neighbours(s, d)
    return rows.select("a", "b", "frame", F.round(analytics.overlap_ratio(a, b), 6).alias("iou"))


# elements

_ELEMENTS = """els AS (SELECT p_brand AS scene, p_partkey AS doc_idx, CAST(p_partkey AS VARCHAR) || if(p_size % 9 = 0, 'ignore', '') AS id, ['rect', 'circle', 'mask', 'title'][p_size % 4 + 1] AS tag, p_size % 3 + 1 AS depth FROM part),
  moved AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey % 2 = 0)"""


def _elements(s, d):
    tag = F.get(F.array(*map(F.lit, ("rect", "circle", "mask", "title"))), (C("p_size") % 4).cast("int"))
    rows = load(s, d, "part").select(C("p_brand").alias("scene_id"), C("p_partkey").alias("doc_idx"), F.concat(C("p_partkey").cast("string"), F.when(C("p_size") % 9 == 0, "ignore").otherwise("")).alias("obj_id"), tag.alias("tag"), (C("p_size") % 3 + 1).alias("depth"))
    tweens = load(s, d, "lineitem").where(C("l_partkey") % 2 == 0).select(C("l_partkey").cast("string").alias("obj_id")).join(rows.select("scene_id", "obj_id"), "obj_id")
    return sc.enumerate_elements(rows, tweens, ["rect", "circle", "mask"])


for _name, _flag, _sql in (("animated", True, "id IN (SELECT id FROM moved)"), ("static", False, "id NOT IN (SELECT id FROM moved) AND depth = 1 AND tag <> 'mask'")):
    register(f"q_elements_{_name}", f"WITH {_ELEMENTS} SELECT scene AS scene_id, doc_idx, id AS obj_id FROM els WHERE tag <> 'title' AND NOT contains(id, 'ignore') AND {_sql}")(
        lambda s, d, f=_flag: _elements(s, d).where(C("animated") == f).select("scene_id", "doc_idx", "obj_id")
    )
register("q_surrogate_prefix", """WITH e AS (SELECT p_brand, p_partkey, CASE p_size % 3 WHEN 0 THEN '__el_' || (p_partkey - 1) WHEN 1 THEN NULL ELSE 'p' || p_partkey END AS id FROM part),
  n AS (SELECT *, id IS NULL AS lacks, '__el_' || p_partkey AS own FROM e) SELECT p_partkey, CASE WHEN NOT lacks THEN id WHEN EXISTS (SELECT 1 FROM e o WHERE o.p_brand = n.p_brand AND o.id = n.own) THEN '_' || own ELSE own END AS key FROM n""")(
    lambda s, d: sc.surrogate_keys(load(s, d, "part").withColumn("id", F.when(C("p_size") % 3 == 0, F.concat(F.lit("__el_"), (C("p_partkey") - 1).cast("string"))).when(C("p_size") % 3 == 2, F.concat(F.lit("p"), C("p_partkey").cast("string")))), "id", "p_partkey", ["p_brand"]).select("p_partkey", "key")
)

# keyframes and documents


def _keyframes(s, d):
    t = scene_tables(s, d)
    return records.keyframe_values(sc.keyframe_times(t.tweens, ["scene_id", "obj_idx"]), t.frames, t.scenes, ["tx_acc", "rot_acc"])


_KEYED = f"""{SCENES}, ends AS (SELECT DISTINCT scene, obj, unnest([4 * k, least(4 * k + 3, 15)]) AS tick FROM ids, generate_series(0, 3) g(k)), keyed AS (SELECT scene, obj, tick, row_number() OVER (PARTITION BY scene, obj ORDER BY tick) - 1 AS k FROM ends)"""
register("q_keyframe_values", f"WITH {_KEYED} SELECT scene AS scene_id, obj AS obj_idx, CAST(k AS INTEGER) AS k, CAST(tick AS DOUBLE) AS time, tx AS tx_acc, rot AS rot_acc FROM keyed JOIN acc USING (scene, obj) WHERE acc.frame = keyed.tick")(
    lambda s, d: _keyframes(s, d).select("scene_id", "obj_idx", "k", "time", "tx_acc", "rot_acc")
)
register("q_sink_keyframes", f"WITH {_KEYED} SELECT scene AS scene_id, vec_id, k, tx AS x FROM (SELECT scene, obj, k, tx FROM keyed JOIN acc USING (scene, obj) WHERE acc.frame = keyed.tick) JOIN ids USING (scene, obj)")(
    lambda s, d: _written(s, records.keyframe_documents(_keyframes(s, d), scene_tables(s, d).objects, ["tx_acc"]), "data_keyframes", "map<string,map<string,struct<tx_acc:array<double>>>>")
    .select("scene_id", F.explode("m").alias("vec_id", "types")).select("scene_id", C("vec_id").cast("bigint").alias("vec_id"), F.posexplode(C("types")["translate"]["tx_acc"]).alias("k", "x"))
)


def _written(s, docs, kind, schema):
    """Documents written and read back, as maps."""
    path = fresh_path(s, "documents")
    records.write_documents(docs, path, kind)
    return records.read_documents(s, path, kind).select(C("scene_id").cast("bigint").alias("scene_id"), F.from_json("value", schema).alias("m"))


register("q_sink_rendered", f"WITH {SCENES} SELECT scene AS scene_id, vec_id, acc.frame, CAST(tx AS DOUBLE) AS x FROM acc JOIN ids USING (scene, obj)")(
    lambda s, d: _written(s, records.rendered_documents(sc.property_series(scene_tables(s, d).frames, ["tx_acc", "rot_acc"]), scene_tables(s, d).objects), "data_rendered", "map<string,map<string,array<string>>>")
    .select("scene_id", F.explode("m").alias("vec_id", "props")).select("scene_id", C("vec_id").cast("bigint").alias("vec_id"), F.posexplode(C("props")["tx_acc"]).alias("frame", "x")).withColumn("x", C("x").cast("double"))
)
register("q_sink_properties", "SELECT DISTINCT user_id % 5 AS scene_id, user_id, event_type AS prop FROM events")(
    lambda s, d: _written(s, records.property_documents(load(s, d, "events").groupBy((C("user_id") % 5).alias("scene_id"), C("user_id").cast("string").alias("obj_id")).agg(F.array_sort(F.collect_set("event_type")).alias("props"))), "properties", "map<string,array<string>>")
    .select("scene_id", F.explode("m").alias("user_id", "props")).select("scene_id", C("user_id").cast("bigint").alias("user_id"), F.explode("props").alias("prop"))
)


def _data(s, d):
    t = scene_tables(s, d)
    zero = F.lit(0.0)
    frames = t.frames.join(t.objects.select("scene_id", "obj_idx", "obj_id"), ["scene_id", "obj_idx"]).withColumns({f"p{i}{c}": zero for i in range(4) for c in "xy"} | {"wld_x": zero, "wld_y": zero})
    return records.data_documents(sc.Scenes(t.scenes.withColumns({"duration": F.lit(0.25), "fps": F.lit(60.0)}), t.objects, t.tweens, frames))


register("q_sink_data", f"WITH {SCENES} SELECT scene AS scene_id, vec_id, acc.frame, tx AS x FROM acc JOIN ids USING (scene, obj)")(
    lambda s, d: _written(s, _data(s, d), "data", "map<string,struct<translateX_acc:array<double>>>")
    .select("scene_id", F.explode(F.map_filter("m", lambda k, v: k != "info")).alias("vec_id", "e")).select("scene_id", C("vec_id").cast("bigint").alias("vec_id"), F.posexplode("e.translateX_acc").alias("frame", "x"))
)


register("q_read_documents", f"WITH {SCENES} SELECT scene AS scene_id, vec_id, acc.frame, tx AS x, rot FROM acc JOIN ids USING (scene, obj)")(
    lambda s, d: sc.from_documents(_data(s, d)).frames.select("scene_id", C("obj_id").cast("bigint").alias("vec_id"), "frame", C("tx_acc").alias("x"), C("rot_acc").alias("rot"))
)


def _sampled(s, d):
    """Each vector as a scene of one object that two of its numbers move, one after the other, and a third turns."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = load(s, d, "embeddings").select(C("vec_id").alias("scene_id"), "embedding", F.lit("a").alias("obj_id"))
    none = F.lit(0.0)
    objects = rows.select("scene_id", F.lit(0).alias("obj_idx"), "obj_id", none.alias("x"), none.alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    tween = lambda k, begin, dx, rot: F.struct(F.lit(k).alias("tween_idx"), F.lit("other").alias("type"), F.lit(begin).alias("begin"), F.lit(0.5).alias("seconds"), dx.alias("dx"), none.alias("dy"), rot.alias("rot"), F.lit(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y"), none.alias("skew_x"), none.alias("skew_y"))
    plan = rows.select("scene_id", "obj_id", F.explode(F.array(tween(0, 0.0, e(0) * 100, none), tween(1, 0.25, e(1) * 100, e(2) * 90))).alias("t")).select("scene_id", "obj_id", "t.*")
    return sc.sample(rows.select("scene_id", F.lit(1.0).alias("duration"), F.lit(12.0).alias("fps")), objects, plan)


register("q_sampler", """WITH t AS (SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(embedding[1] AS DOUBLE) * 100 AS a, CAST(embedding[2] AS DOUBLE) * 100 AS b, CAST(embedding[3] AS DOUBLE) * 90 AS r, least(1, f / 12.0 / 0.5) AS p, greatest(0, least(1, (f / 12.0 - 0.25) / 0.5)) AS q FROM embeddings, range(13) g(f))
  SELECT vec_id AS scene_id, frame, round(a * p + b * q, 6) AS x, round(r * q, 6) AS rot FROM t""")(
    lambda s, d: _sampled(s, d).frames.select("scene_id", "frame", F.round("tx_acc", 6).alias("x"), F.round("rot_acc", 6).alias("rot"))
)


@register("q_dataset_json", "SELECT item_id, text FROM benchmark")
def _dataset(s, d):
    path = fresh_path(s, "dataset")
    records.write_dataset(load(s, d, "benchmark").select("item_id", "text"), path, ["item_id"])
    return records.read_dataset_lines(s, path, "item_id bigint, text string")


@register("q_sink_pruned", "SELECT user_id % 5 AS scene_id, count(DISTINCT user_id) AS n FROM events WHERE user_id % 5 >= 3 GROUP BY 1")
def _pruned(s, d):
    """Documents of some scenes, out of small bundles by way of the index."""
    rows = load(s, d, "events").groupBy((C("user_id") % 5).alias("scene_id"), C("user_id").cast("string").alias("obj_id")).agg(F.array_sort(F.collect_set("event_type")).alias("props"))
    path = fresh_path(s, "documents")
    records.write_documents(records.property_documents(rows), path, "properties", 1 << 10)
    some = load(s, d, "events").select((C("user_id") % 5).alias("scene_id")).where("scene_id >= 3")
    found = records.read_documents(s, path, "properties", some)
    return found.select(C("scene_id").cast("bigint").alias("scene_id"), F.size(F.from_json("value", "map<string,array<string>>")).cast("bigint").alias("n"))


# point queries

_POINTS = f"""{TWEENS}, asked AS (SELECT DISTINCT cust AS scene, if(cust % 5 = 0, 'none', 'a') AS obj FROM tweens WHERE cust % 20 < 10), moves AS (SELECT cust AS scene, 'a' AS obj, least((s % 5 + 5) % 5, 2) * 0.1 AS b, 0.5 AS secs, CAST(kind + 1 AS DOUBLE) * 10 AS dx FROM tweens WHERE cust % 20 < 10),
  ticks AS (SELECT CAST(i AS BIGINT) AS i, least(i / 2400.0, 1.0) AS t FROM generate_series(0, 2400) g(i))"""


def _points(s, d):
    rows = day_tweens(s, d).where(C("cust") % 20 < 10)
    tweens = rows.select(C("cust").alias("scene_id"), F.lit("a").alias("obj_id"), (F.least(F.pmod(C("s"), F.lit(5)), F.lit(2)) * 0.1).alias("begin"), F.lit(0.5).alias("seconds"), ((C("kind") + 1) * 10.0).alias("dx"), F.lit(0.0).alias("dy"))
    ids = rows.select(C("cust").alias("scene_id")).distinct()
    rest = ids.select("scene_id", F.lit("a").alias("obj_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    targets = ids.select("scene_id", F.when(C("scene_id") % 5 == 0, "none").otherwise("a").alias("obj_id"), F.lit(5.0).alias("x"), F.lit(0.0).alias("y"))
    return analytics.points_in_time(tweens, ids.withColumn("duration", F.lit(1.0)), rest, targets, tolerance=0.1003)


register("q_point_query", f"""WITH {_POINTS}, placed AS (SELECT a.scene, t, sum(dx * greatest(0, least(1, (t - b) / secs))) AS x FROM asked a JOIN moves m ON m.scene = a.scene AND m.obj = a.obj, ticks GROUP BY a.scene, t),
  hits AS (SELECT scene, count(*) FILTER (abs(x - 5) <= 0.1003) AS n FROM placed GROUP BY 1) SELECT scene AS scene_id, obj AS obj_id, CASE WHEN obj = 'a' THEN coalesce(n, 0) END AS n FROM asked LEFT JOIN hits USING (scene)""")(
    lambda s, d: _points(s, d).select("scene_id", "obj_id", F.when(C("matches").isNotNull(), F.size("matches").cast("bigint")).alias("n"))
)

