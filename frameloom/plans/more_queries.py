"""Further registered queries: generation, comparison, streaming form, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions.allen import T_BEFORE, any_relation
from frameloom.operators import analytics, generate
from frameloom.operators import runs as rn
from frameloom.plans import compose_queries, program_queries, record_queries
from frameloom.plans.compiler import color_is
from frameloom.plans.driver_queries import OBJECTS, ORACLE_SQL, QUERIES, SERIES, TWEENS, day_tweens, load, objects, register, relation_sql, series
from frameloom.sources import scenes as sc
from frameloom.streaming.runs import close_runs, stream_runs

register("q_modifier_permutations", """WITH names AS (SELECT ['direction', 'magnitude', 'origin', 'duration', 'post'] AS n), perms AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS ord FROM (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)) WHERE len(list_distinct(p)) = 5)
  SELECT p_partkey, array_to_string(list_transform(p, lambda i: n[i]), ',') AS modifiers FROM part JOIN perms ON ord = p_partkey % 120, names""")(
    lambda s, d: load(s, d, "part").select("p_partkey", (F.col("p_partkey") % 120).cast("int").alias("ord")).join(F.broadcast(generate.modifier_orders(s)), "ord").select("p_partkey", F.array_join("modifiers", ",").alias("modifiers"))
)
register("q_splits", """WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)
  SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, array_to_string(w[1:i], ' ') AS prefix, array_to_string(w[i+1:j], ' ') AS infix, array_to_string(w[j+1:], ' ') AS suffix
  FROM (SELECT *, unnest(generate_series(i, len(w))) AS j FROM (SELECT *, unnest(generate_series(0, len(w))) AS i FROM w))""")(
    lambda s, d: generate.splits(load(s, d, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("w")), "w").select("p_partkey", "i", "j", *[F.array_join(c, " ").alias(c) for c in ("prefix", "infix", "suffix")])
)
register("q_prop_compare_numeric", f"WITH {SERIES} SELECT vec_id, frame, coalesce(abs(acc - lead(acc) OVER (PARTITION BY vec_id ORDER BY frame)) <= 3, false) AS same FROM series")(
    lambda s, d: analytics.property_differences(series(s, d).withColumnRenamed("acc", "value"), series(s, d).select("vec_id", (F.col("frame") - 1).alias("frame"), F.col("acc").alias("value")).where("frame >= 0"), ["vec_id", "frame"], 3.0)
)
register("q_session_runs", """SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 1 HOUR AS e, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""")(
    lambda s, d: stream_runs(load(s, d, "events"), ["user_id"])
)
register("q_closed_runs", """WITH f AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 3600000000 - 473352 AS BIGINT) AS frame FROM events) SELECT user_id, 'run' AS kind, min(frame) AS s, max(frame) AS e FROM (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM f) GROUP BY user_id, g""")(
    lambda s, d: close_runs(load(s, d, "events").select("user_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000)) - 473352).alias("frame")), ["user_id"])
)
register("q_property_series", f"WITH {OBJECTS} SELECT obj_idx, unnest(['fill', 'shape', 'size']) AS prop, unnest([fill, shape, CAST(size AS VARCHAR)]) AS value FROM objects")(
    lambda s, d: sc.property_series(objects(s, d).select(F.lit(0).alias("scene_id"), "obj_idx", F.lit(0).alias("frame"), "fill", "shape", "size"), ["fill", "shape", "size"]).select("obj_idx", "prop", "value")
)
register("q_animated_properties", "SELECT user_id, array_to_string(list_sort(list_distinct(list(CASE event_type WHEN 'view' THEN 'transform' WHEN 'click' THEN 'transform' ELSE event_type END) || CASE WHEN bool_or(event_type IN ('view', 'click')) THEN ['transformedPts'] ELSE [] END)), ',') AS props FROM events GROUP BY user_id")(
    lambda s, d: sc.animated_properties(load(s, d, "events").select(F.lit(0).alias("scene_id"), F.col("user_id").alias("obj_id"), F.col("event_type").alias("prop")), s.createDataFrame([("view", "transform", True), ("click", "transform", True)], "alias string, prop string, spatial boolean")).select(F.col("obj_id").alias("user_id"), F.array_join("props", ",").alias("props"))
)
register("q_object_list", """SELECT p_partkey AS obj_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, p_partkey) - 1 AS INTEGER) AS obj_idx, CASE WHEN p_size % 3 = 0 THEN 'square' ELSE 'rectangle' END AS shape, lower(p_type) AS fill FROM part""")(
    lambda s, d: sc.object_list(load(s, d, "part").select(F.col("p_brand").alias("scene_id"), F.col("p_partkey").alias("doc_idx"), F.col("p_partkey").cast("string").alias("obj_id"), F.lit("rect").alias("tag"), F.lit(3.0).alias("width"), F.when(F.col("p_size") % 3 == 0, 3.0).otherwise(4.0).alias("height"), F.lit(0.0).alias("r"), F.col("p_type").alias("fill"), (F.col("p_size") % 2 == 0).alias("animated"))).select(F.col("obj_id").cast("bigint").alias("obj_id"), "obj_idx", "shape", "fill")
)
register("q_frame_clock", "SELECT o_orderkey, CAST(ceil(o_totalprice / 1000.0 * 60) AS INTEGER) AS steps, round(least(100 / 60.0, o_totalprice / 1000.0), 6) AS at_100 FROM orders")(
    lambda s, d: load(s, d, "orders").select("o_orderkey", sc.clock(F.col("o_totalprice") / 1000, F.lit(60.0)).alias("steps"), F.round(sc.time_of(F.lit(100), F.col("o_totalprice") / 1000, F.lit(60.0)), 6).alias("at_100"))
)
register("q_sentences", """SELECT p_partkey, f.form, replace(replace(f.t, '{o}', p_name), '{r}', lower(p_type)) AS sentence FROM part, (VALUES ('present', 'The {o} moves {r}.'), ('passive', 'The {o} is moved {r}.'), ('imperative', 'Move the {o} {r}.'), ('complement', 'Make the {o} move {r}.'), ('clause', 'Animate the {o} so that it moves {r}.')) f(form, t)""")(
    lambda s, d: generate.sentences(load(s, d, "part").select("p_partkey", F.col("p_name").alias("object"), F.lit("moves").alias("verb"), F.lit("moved").alias("verb_past"), F.lit("move").alias("verb_base"), F.lower("p_type").alias("rest"))).select("p_partkey", "form", "sentence")
)

_FLAG = " OR ".join(relation_sql(n, ("a.s", "a.e"), ("b.s", "b.e"), gap=" + 1") for n in T_BEFORE)


@register("q_flagship", f"""WITH {OBJECTS}, {TWEENS}, red AS (SELECT obj_idx AS cust FROM objects WHERE contains(fill, 'e')), mine AS (SELECT * FROM tweens SEMI JOIN red USING (cust)),
  days AS (SELECT DISTINCT cust, kind, unnest(generate_series(s, e)) AS day FROM mine),
  runs AS (SELECT cust, kind, min(day) AS s, max(day) AS e FROM (SELECT *, day - row_number() OVER (PARTITION BY cust, kind ORDER BY day) AS g FROM days) GROUP BY cust, kind, g)
  SELECT a.cust, count(*) AS n_pairs, CAST(min(a.s) AS INTEGER) AS first_day FROM runs a JOIN runs b ON a.cust = b.cust AND a.kind = 1 AND b.kind = 2 WHERE {_FLAG} GROUP BY a.cust""")
def _flagship(s, d):
    """Objects by colour, their motions as runs of days, and the pairs in which a run of one type comes before one of another."""
    mine = day_tweens(s, d).join(objects(s, d).where(color_is("e")).select(F.col("obj_idx").alias("cust")), "cust", "left_semi")
    found = rn.merged(mine, ["cust", "kind"])
    side = lambda kind, p: found.where(F.col("kind") == kind).select("cust", F.col("s").alias(f"{p}0"), F.col("e").alias(f"{p}1"))
    both = side(1, "a").join(side(2, "b"), "cust").where(any_relation(T_BEFORE, (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), gap=1))
    return both.groupBy("cust").agg(F.count("*").alias("n_pairs"), F.min("a0").alias("first_day"))



__all__ = ["ORACLE_SQL", "QUERIES", "compose_queries", "program_queries", "record_queries"]
