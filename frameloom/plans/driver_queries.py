"""Registered queries: every operator over a whole driver table, with its DuckDB statement.

Bindings: ``part`` as objects (name: adjective is the colour, noun the shape), ``events`` as frames (hour of 2024; view, click, purchase as
translate, rotate, scale), ``orders`` with ``lineitem`` as tweens and runs in days of 1995, ``embeddings`` as value series and as boxes (four
numbers a frame), ``conversations`` with ``labels`` as runs, ``documents`` as texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions.allen import REGIONS, RELATIONS, TEMPORAL, axis_relation, region
from frameloom.functions.geometry import boxes_meet, half_plane, point_in_box, unit
from frameloom.functions.motion_types import parse_types
from frameloom.operators import analytics, motion
from frameloom.operators import runs as rn
from frameloom.operators.intervals import related
from frameloom.plans.compiler import color_is
from frameloom.sources import scenes as sc

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# bindings


def objects(spark, d) -> DataFrame:
    name = F.split("p_name", " ")
    return load(spark, d, "part").select(F.col("p_partkey").alias("obj_idx"), F.col("p_name").alias("obj_id"), F.get(name, F.lit(0)).alias("fill"), F.get(name, F.lit(1)).alias("shape"), F.lit(None).cast("string").alias("stroke"), F.col("p_size").cast("bigint").alias("size"))


OBJECTS = "objects AS (SELECT p_partkey AS obj_idx, p_name AS obj_id, split_part(p_name, ' ', 1) AS fill, split_part(p_name, ' ', 2) AS shape, CAST(p_size AS BIGINT) AS size FROM part)"


def event_frames(spark, d) -> DataFrame:
    hour = (F.floor(F.unix_micros("ts") / F.lit(3600000000)) - 473352).cast("int")
    bit = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 4).otherwise(0)
    ts = F.col("ts").cast("timestamp")
    return load(spark, d, "events").withColumn("ts", ts).groupBy(F.col("user_id").alias("obj_idx"), hour.alias("frame")).agg(F.bit_or(bit).alias("types"))


FRAMES = "frames AS (SELECT user_id AS obj_idx, CAST(epoch_us(ts) // 3600000000 - 473352 AS INTEGER) AS frame, bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END) AS types FROM events GROUP BY 1, 2)"


def day_tweens(spark, d) -> DataFrame:
    """One tween an order: ``cust, ord, kind`` (0-2), ``s, e`` (days)."""
    day = lambda c: F.datediff(F.col(c), F.lit("1995-01-01").cast("date"))
    last = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(day("l_shipdate")).alias("ship"))
    kind = F.expr("cast(substring(o_orderpriority, 1, 1) as int) % 3")
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("s"), kind.alias("kind")).join(last, "o_orderkey")
    return rows.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), "kind", "s", F.greatest("s", "ship").alias("e"))


TWEENS = """tweens AS (SELECT o_custkey AS cust, o_orderkey AS ord, CAST(o_orderpriority[1] AS INTEGER) % 3 AS kind, s, greatest(s, ship) AS e
  FROM (SELECT o_orderkey, o_custkey, o_orderpriority, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders)
  JOIN (SELECT l_orderkey, max(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def series(spark, d) -> DataFrame:
    """``vec_id, frame, acc``: embeddings as value series."""
    rows = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "v"))
    return rows.select("vec_id", "frame", F.round(F.col("v").cast("double") * 100, 6).alias("acc"))


SERIES = "series AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS frame, round(CAST(embedding[i] AS DOUBLE) * 100, 6) AS acc FROM embeddings, generate_series(1, 64) g(i))"
PAIRED = f"""{SERIES}, paths AS (SELECT vec_id, CAST(frame // 2 AS INTEGER) AS frame, max(CASE WHEN frame % 2 = 0 THEN acc END) AS x, max(CASE WHEN frame % 2 = 1 THEN acc END) AS y FROM series GROUP BY 1, 2)"""


def paths(spark, d) -> DataFrame:
    """``vec_id, frame, x, y``: consecutive numbers of a series as points."""
    e = lambda i: F.round(F.get("embedding", i).cast("double") * 100, 6)
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("frame"))
    return rows.select("vec_id", "frame", e(F.col("frame") * 2).alias("x"), e(F.col("frame") * 2 + 1).alias("y"))


SIDES = ("left", "right", "top", "bottom")


def boxes(spark, d) -> DataFrame:
    e = lambda i: F.get("embedding", F.col("frame") * 4 + i).cast("double")
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("frame"))
    rows = rows.select("vec_id", "frame", (e(0) * 100).alias("left"), (e(1) * 100).alias("top"), F.abs(e(2)).alias("w"), F.abs(e(3)).alias("h"))
    return rows.select("vec_id", "frame", "left", "top", (F.col("left") + F.col("w") * 100 + 1).alias("right"), (F.col("top") + F.col("h") * 100 + 1).alias("bottom"))


BOXES = """boxes AS (SELECT vec_id, frame, l AS "left", t AS "top", l + abs(w) * 100 + 1 AS "right", t + abs(h) * 100 + 1 AS "bottom" FROM (
  SELECT vec_id, CAST(i AS INTEGER) AS frame, CAST(embedding[4*i+1] AS DOUBLE) * 100 AS l, CAST(embedding[4*i+2] AS DOUBLE) * 100 AS t, CAST(embedding[4*i+3] AS DOUBLE) AS w, CAST(embedding[4*i+4] AS DOUBLE) AS h
  FROM embeddings, generate_series(0, 15) g(i)))"""


def neighbours(spark, d) -> tuple[DataFrame, dict, dict]:
    """Each box with that of the next vector in the same frame."""
    rows = boxes(spark, d)
    a = rows.select(F.col("vec_id").alias("a"), "frame", *[F.col(c).alias(f"a_{c}") for c in SIDES])
    b = rows.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), "frame", *[F.col(c).alias(f"b_{c}") for c in SIDES])
    return a.join(b, ["a", "frame"]), {c: F.col(f"a_{c}") for c in SIDES}, {c: F.col(f"b_{c}") for c in SIDES}


PAIRS = BOXES + """, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.frame, a."left" AS al, a."right" AS ar, a.top AS a_top, a.bottom AS a_bot, b."left" AS bl, b."right" AS br, b.top AS b_top, b.bottom AS b_bot
  FROM boxes a JOIN boxes b ON b.vec_id = a.vec_id + 1 AND b.frame = a.frame)"""

# objects

register("q_obj_color", f"WITH {OBJECTS} SELECT obj_idx, obj_id FROM objects WHERE contains(fill, 're')")(lambda s, d: objects(s, d).where(color_is("re")).select("obj_idx", "obj_id"))
register("q_obj_shape", f"WITH {OBJECTS}, s AS (SELECT min(shape) AS v FROM objects) SELECT obj_idx, shape FROM objects, s WHERE shape = v")(
    lambda s, d: objects(s, d).join(F.broadcast(objects(s, d).agg(F.min("shape").alias("v"))), F.col("shape").eqNullSafe(F.col("v"))).select("obj_idx", "shape")
)
register("q_obj_id", f"WITH {OBJECTS}, s AS (SELECT min(obj_id) AS v FROM objects) SELECT obj_idx, obj_id FROM objects, s WHERE obj_id = v")(
    lambda s, d: objects(s, d).join(F.broadcast(objects(s, d).agg(F.min("obj_id").alias("v"))), F.col("obj_id") == F.col("v")).select("obj_idx", "obj_id")
)
register("q_obj_iota", f"WITH {OBJECTS} SELECT shape, min(obj_idx) AS obj_idx FROM objects WHERE contains(fill, 'e') GROUP BY shape")(
    lambda s, d: objects(s, d).where(color_is("e")).groupBy("shape").agg(F.min("obj_idx").alias("obj_idx"))
)


@register("q_obj_iota_not", f"WITH {OBJECTS}, one AS (SELECT shape, min(obj_idx) AS obj_idx FROM objects GROUP BY shape) SELECT shape, min(obj_idx) AS obj_idx FROM objects ANTI JOIN one USING (shape, obj_idx) GROUP BY shape")
def _iota_not(s, d):
    rows = objects(s, d)
    first = rows.groupBy("shape").agg(F.min("obj_idx").alias("obj_idx"))
    return rows.join(first, ["shape", "obj_idx"], "left_anti").groupBy("shape").agg(F.min("obj_idx").alias("obj_idx"))


register("q_obj_all", f"WITH {OBJECTS} SELECT obj_idx, fill, shape FROM objects WHERE NOT contains(fill, 'a')")(lambda s, d: objects(s, d).where(~color_is("a")).select("obj_idx", "fill", "shape"))
register("q_get_color_shape", f"WITH {OBJECTS} SELECT obj_idx, fill AS color, shape, obj_id AS id FROM objects")(lambda s, d: objects(s, d).select("obj_idx", F.col("fill").alias("color"), "shape", F.col("obj_id").alias("id")))
register("q_get_size", f"WITH {OBJECTS} SELECT obj_idx, size FROM objects")(lambda s, d: objects(s, d).select("obj_idx", "size"))
register("q_get_pos", f"""WITH {BOXES} SELECT vec_id, round(("left" + "right") / 2, 6) AS x, round((top + bottom) / 2, 6) AS y FROM boxes WHERE frame = 0""")(
    lambda s, d: boxes(s, d).where("frame = 0").select("vec_id", F.round((F.col("left") + F.col("right")) / 2, 6).alias("x"), F.round((F.col("top") + F.col("bottom")) / 2, 6).alias("y"))
)

# derived columns

def _at():
    return Window.partitionBy("vec_id").orderBy("frame")


def _derived(s, d):
    """Paths as accumulated values of one object a scene, with what ``scenes.derive`` makes of them."""
    number = lambda c, v: F.lit(v).alias(c)
    rows = paths(s, d).select(F.col("vec_id").alias("scene_id"), F.lit(0).alias("obj_idx"), "frame", F.lit(31).alias("steps"), F.col("x").alias("tx_acc"), F.col("y").alias("ty_acc"), (F.floor(F.col("x") / 10) * 10.0).alias("rot_acc"), F.col("x").alias("sx_acc"), number("sy_acc", 1.0), number("kx_acc", 0.0), number("ky_acc", 0.0))
    return sc.derive(rows).withColumnRenamed("scene_id", "vec_id")


register("q_delta_translate", f"WITH {PAIRED} SELECT vec_id, frame, round(x - coalesce(lag(x) OVER w, 0), 6) AS dx, round(y - coalesce(lag(y) OVER w, 0), 6) AS dy FROM paths WINDOW w AS (PARTITION BY vec_id ORDER BY frame)")(
    lambda s, d: _derived(s, d).select("vec_id", "frame", F.round("tx", 6).alias("dx"), F.round("ty", 6).alias("dy"))
)
register("q_delta_scale", f"WITH {PAIRED} SELECT vec_id, frame, round(x / nullif(coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY frame), 1), 0), 6) AS ratio FROM paths")(
    lambda s, d: _derived(s, d).select("vec_id", "frame", F.round("sx", 6).alias("ratio"))
)


def _deltas(s, d):
    step = lambda c: F.round(F.col(c) - F.coalesce(F.lag(c).over(_at()), F.lit(0.0)), 6)
    return paths(s, d).select("vec_id", "frame", step("x").alias("dx"), step("y").alias("dy"))


DELTAS = f"{PAIRED}, deltas AS (SELECT vec_id, frame, round(x - coalesce(lag(x) OVER w, 0), 6) AS dx, round(y - coalesce(lag(y) OVER w, 0), 6) AS dy FROM paths WINDOW w AS (PARTITION BY vec_id ORDER BY frame))"
register("q_type_mask", f"WITH {PAIRED}, d AS (SELECT vec_id, frame, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy, floor(x / 10) * 10 - coalesce(lag(floor(x / 10) * 10) OVER w, 0) AS dr, x / nullif(coalesce(lag(x) OVER w, 1), 0) AS ratio FROM paths WINDOW w AS (PARTITION BY vec_id ORDER BY frame)) SELECT vec_id, frame, CASE WHEN dx <> 0 OR dy <> 0 THEN 1 ELSE 0 END + CASE WHEN dr <> 0 THEN 2 ELSE 0 END + CASE WHEN ratio <> 1 THEN 4 ELSE 0 END AS mask FROM d")(
    lambda s, d: _derived(s, d).select("vec_id", "frame", F.col("types").alias("mask"))
)
register("q_dir_sign", f"WITH {DELTAS} SELECT vec_id, frame, CASE WHEN frame < 31 THEN CAST(sign(ratio - 1) AS INTEGER) END AS sx, CASE WHEN frame < 31 THEN CAST(sign(dr) AS INTEGER) END AS rot FROM (SELECT vec_id, frame, floor(x / 10) * 10 - coalesce(lag(floor(x / 10) * 10) OVER w, 0) AS dr, x / nullif(coalesce(lag(x) OVER w, 1), 0) AS ratio FROM paths WINDOW w AS (PARTITION BY vec_id ORDER BY frame))")(
    lambda s, d: _derived(s, d).select("vec_id", "frame", F.col("dir_sx").alias("sx"), F.col("dir_rot").alias("rot"))
)
register("q_dir_unit", f"WITH {DELTAS} SELECT vec_id, frame, round(CASE WHEN sqrt(dx*dx+dy*dy) > 0 THEN dx / sqrt(dx*dx+dy*dy) ELSE 0 END, 6) AS ux, round(CASE WHEN sqrt(dx*dx+dy*dy) > 0 THEN dy / sqrt(dx*dx+dy*dy) ELSE 0 END, 6) AS uy FROM deltas")(
    lambda s, d: _deltas(s, d).select("vec_id", "frame", *[F.round(c, 6).alias(n) for n, c in zip(("ux", "uy"), unit(F.col("dx"), F.col("dy")))])
)

# motion predicates

for _name, _text, _mask in (("", "rotate", 2), ("_compound", "~translate", 6), ("_union", "rotate|scale", 6)):
    register(f"q_motion_type{_name}", f"WITH {FRAMES} SELECT obj_idx, frame FROM frames WHERE types & {_mask} <> 0")(
        lambda s, d, m=_text: event_frames(s, d).where(motion.has_type(parse_types(m), F.col("types"))).select("obj_idx", "frame")
    )


def _directed(s, d):
    ux, uy = unit(F.col("dx"), F.col("dy"))
    return _deltas(s, d).select("vec_id", "frame", F.lit(7).alias("types"), ux.alias("dir_tx"), uy.alias("dir_ty"), F.signum("dx").cast("int").alias("dir_rot"), F.signum("dx").cast("int").alias("dir_sx"), F.signum("dy").cast("int").alias("dir_sy"))


for _name, _mask, _target, _sql in (
    ("t", 1, [1.0, 1.0], "sqrt(dx*dx+dy*dy) > 0 AND (dx + dy) / sqrt(dx*dx+dy*dy) / sqrt(2) > 0.866"),
    ("r", 2, "clockwise", "dx > 0"), ("s", 4, [1.0, -1.0], "dx > 0 AND dy < 0"),
):
    register(f"q_motion_direction_{_name}", f"WITH {DELTAS} SELECT vec_id, frame FROM deltas WHERE {_sql}")(
        lambda s, d, m=_mask, t=_target: _directed(s, d).where(motion.direction(m, t)).select("vec_id", "frame")
    )


def _motion_tables(s, d):
    """Paths as scenes of 31 steps with tweens of eight frames."""
    rows = paths(s, d).select(F.col("vec_id").alias("scene_id"), F.lit(0).alias("obj_idx"), "frame", F.lit(7).alias("types"), F.col("x").alias("tx_acc"), F.col("y").alias("ty_acc"), F.col("x").alias("rot_acc"), F.col("x").alias("sx_acc"), F.col("y").alias("sy_acc"))
    ids = load(s, d, "embeddings").select(F.col("vec_id").alias("scene_id"))
    tweens = ids.select("scene_id", F.lit(0).alias("obj_idx"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tween_idx")).withColumns({"start": F.col("tween_idx") * 8 + 0.5, "end": F.least(F.col("tween_idx") * 8 + 6.5, F.lit(30.0))})
    return rows, tweens, ids.withColumn("steps", F.lit(31))


def _magnitude_sql(near: str, last: str) -> str:
    return f"""WITH {PAIRED}, tw AS (SELECT vec_id, k, 8*k AS sf, CAST(ceil(least(8*k + 6.5, 30)) AS INTEGER) AS ef FROM (SELECT DISTINCT vec_id FROM paths), generate_series(0, 3) g(k)),
      hit AS (SELECT tw.vec_id, k, sf, max({last}) AS e FROM tw JOIN paths b ON b.vec_id = tw.vec_id AND b.frame = sf JOIN paths f ON f.vec_id = tw.vec_id AND f.frame >= sf AND f.frame < least(ef + 1, 32) WHERE {near} GROUP BY ALL)
      SELECT DISTINCT vec_id, CAST(unnest(generate_series(sf, e)) AS INTEGER) AS frame FROM hit WHERE e >= sf"""


for _name, _mask, _target, _near, _last in (
    ("t", 1, 20.0, "abs(sqrt((f.x-b.x)*(f.x-b.x)+(f.y-b.y)*(f.y-b.y)) - 20) <= 0.1 + 1e-5*20", "f.frame - 1"),
    ("r", 2, 15.0, "abs(abs(f.x - b.x) - 15) <= 0.1 + 1e-5*15", "least(f.frame + 1, 31) - 1"),
    ("s", 4, [1.5, 0.0], "b.x <> 0 AND abs(f.x / b.x - 1.5) <= 0.1 + 1e-5*1.5", "f.frame - 1"),
):
    register(f"q_motion_magnitude_{_name}", _magnitude_sql(_near, _last))(
        lambda s, d, m=_mask, t=_target: motion.magnitude(*_motion_tables(s, d), m, t).select(F.col("scene_id").alias("vec_id"), "frame")
    )

register("q_motion_origin_abs", f"""WITH {BOXES} SELECT vec_id, frame FROM boxes WHERE abs("left" - 5) <= 0.1 + 5e-5""")(
    lambda s, d: boxes(s, d).where(motion.origin([5.0, 7.0], (F.col("left"), F.lit(7.0)), [])).select("vec_id", "frame")
)


@register("q_motion_origin_pct", f"""WITH {BOXES} SELECT vec_id, frame FROM boxes WHERE abs("left" + 3 - ("left" + 0.25 * ("right" - "left"))) <= 0.1 + 1e-5 * abs("left" + 0.25 * ("right" - "left")) AND abs(top + 2 - (top + 0.5 * (bottom - top))) <= 0.1 + 1e-5 * abs(top + 0.5 * (bottom - top))""")
def _origin_pct(s, d):
    c = F.col
    corners = [(c("left"), c("top")), (c("right"), c("top")), (c("right"), c("bottom")), (c("left"), c("bottom"))]
    return boxes(s, d).where(motion.origin(["25%", "50%"], (c("left") + 3, c("top") + 2), corners)).select("vec_id", "frame")


register("q_motion_duration", f"WITH {TWEENS} SELECT DISTINCT cust, CAST(unnest(generate_series(s, e)) AS INTEGER) AS frame FROM tweens WHERE kind = 1 AND abs((e - s) - 60) <= 1e-8 + 60e-5")(
    lambda s, d: motion.duration(*_day_tables(s, d), 2, 60.0).select(F.col("scene_id").alias("cust"), "frame")
)


def _day_tables(s, d):
    """Orders as tweens of one object a customer, and the scenes' steps."""
    rows = day_tweens(s, d).select(F.col("cust").alias("scene_id"), F.lit(0).alias("obj_idx"), F.get(F.array(*map(F.lit, ("translate", "rotate", "scale"))), F.col("kind")).alias("type"), (F.col("e") - F.col("s")).cast("double").alias("duration"), F.col("s").cast("double").alias("start"), F.col("e").cast("double").alias("end"))
    return rows, rows.select("scene_id").distinct().withColumn("steps", F.lit(1_000_000))


register("q_motion_agent", f"WITH {OBJECTS}, {FRAMES} SELECT obj_idx, frame FROM frames JOIN objects USING (obj_idx) WHERE contains(fill, 're') AND types <> 0")(
    lambda s, d: event_frames(s, d).join(objects(s, d), "obj_idx").where(motion.agent(color_is("re"), F.col("types"))).select("obj_idx", "frame")
)


@register("q_motion_post", f"""WITH {PAIRS}, tw AS (SELECT DISTINCT a, k, 4 * k AS s, least(4 * k + 3, 15) AS e FROM pairs, generate_series(0, 3) g(k)),
  hit AS (SELECT tw.a, s, e FROM tw JOIN pairs p ON p.a = tw.a AND p.frame = e WHERE (ar < bl OR abs(ar - bl) <= 5 + 1e-5*abs(bl) OR (al < bl AND bl < ar AND ar < br) OR (al < bl AND abs(ar - br) <= 5 + 1e-5*abs(br))))
  SELECT DISTINCT a, CAST(unnest(generate_series(s, e - 1)) AS INTEGER) AS frame FROM hit""")
def _post(s, d):
    rows, a, b = neighbours(s, d)
    rel = rows.select(F.col("a").alias("scene_id"), "frame", region("s_left", a, b).alias("holds"))
    ids = rows.select(F.col("a").alias("scene_id")).distinct()
    tweens = ids.select("scene_id", F.lit(0).alias("obj_idx"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumns({"start": F.col("k") * 4.0, "end": F.least(F.col("k") * 4 + 3.0, F.lit(15.0))})
    return motion.post(tweens, ids.withColumn("steps", F.lit(16)), rel).select(F.col("scene_id").alias("a"), "frame")


# runs and quantifiers

RUNS = f"""{FRAMES}, runs AS (SELECT obj_idx, min(frame) AS s, max(frame) AS e FROM (SELECT obj_idx, frame, frame - row_number() OVER (PARTITION BY obj_idx ORDER BY frame) AS g FROM frames WHERE types & 3 <> 0) GROUP BY obj_idx, g)"""
_moving = lambda s, d: rn.runs(event_frames(s, d), ["obj_idx"], where=motion.has_type(3, F.col("types")))
register("q_runs", f"WITH {RUNS} SELECT obj_idx, s, e FROM runs")(_moving)
register("q_first_run", f"WITH {RUNS} SELECT obj_idx, min(s) AS s, arg_min(e, s) AS e FROM runs GROUP BY obj_idx")(lambda s, d: rn.first_runs(_moving(s, d), ["obj_idx"]))


@register("q_not_run", f"WITH {RUNS}, one AS (SELECT obj_idx, min(s) AS s, arg_min(e, s) AS e FROM runs GROUP BY obj_idx) SELECT f.obj_idx, frame FROM frames f JOIN one USING (obj_idx) WHERE types & 3 <> 0 AND NOT frame BETWEEN s AND e")
def _not_run(s, d):
    rows = event_frames(s, d)
    flagged = rn.with_flag(rows, rn.covered(rn.first_runs(rn.runs(rows, ["obj_idx"], where=motion.has_type(3, F.col("types"))), ["obj_idx"]), ["obj_idx"]), ["obj_idx", "frame"], "first")
    return flagged.where(motion.has_type(3, F.col("types")) & ~F.col("first")).select("obj_idx", "frame")


@register("q_event_runs", """SELECT user_id, event_type, min(rn) AS s, max(rn) AS e FROM (SELECT *, rn - row_number() OVER (PARTITION BY user_id, event_type ORDER BY rn) AS g FROM (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rn FROM events)) GROUP BY user_id, event_type, g""")
def _event_runs(s, d):
    rows = load(s, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("frame"))
    return rn.runs(rows, ["user_id", "event_type"])


register("q_exists", f"WITH {FRAMES} SELECT frame, bool_or(types & 4 <> 0) AS holds FROM frames GROUP BY frame")(lambda s, d: event_frames(s, d).groupBy("frame").agg(F.bool_or(motion.has_type(4, F.col("types"))).alias("holds")))
register("q_forall", f"WITH {FRAMES} SELECT frame, bool_and(types & 1 <> 0) AS holds FROM frames GROUP BY frame")(lambda s, d: event_frames(s, d).groupBy("frame").agg(F.bool_and(motion.has_type(1, F.col("types"))).alias("holds")))

# temporal relations: orders of kind 1 against those of kind 2 of the same customer

CLOSE = "abs({0} - {1}) <= 5 + 1e-5 * abs({1})"


def relation_sql(name: str, a: tuple[str, str], b: tuple[str, str], less: str = "<", gap: str = "") -> str:
    """The relation's definition as text."""
    (s, e), (u, v) = a, b
    near = CLOSE.format
    return "(" + {
        "precedes": f"{e}{gap} {less} {u}", "preceded_by": f"{v}{gap} {less} {s}", "meets": near(e, u), "met_by": near(v, s),
        "overlaps": f"{s} {less} {u} AND {u} {less} {e} AND {e} {less} {v}", "overlapped_by": f"{u} {less} {s} AND {s} {less} {v} AND {v} {less} {e}",
        "finished_by": f"{s} {less} {u} AND {near(e, v)}", "finishes": f"{u} {less} {s} AND {near(v, e)}",
        "contains": f"{s} {less} {u} AND {v} {less} {e}", "during": f"{u} {less} {s} AND {e} {less} {v}",
        "starts": f"{near(s, u)} AND {e} {less} {v}", "started_by": f"{near(u, s)} AND {v} {less} {e}", "equals": f"{near(s, u)} AND {near(e, v)}",
    }[name] + ")"


def _temporal(names):
    def query(s, d):
        rows = day_tweens(s, d)
        return related(rows.where("kind = 1"), rows.where("kind = 2"), ["cust"], names, gap=1).select("cust").distinct()

    return query


def _temporal_sql(names) -> str:
    held = " OR ".join(relation_sql(n, ("a.s", "a.e"), ("b.s", "b.e"), gap=" + 1") for n in names)
    return f"WITH {TWEENS} SELECT DISTINCT a.cust FROM tweens a JOIN tweens b ON a.cust = b.cust AND a.kind = 1 AND b.kind = 2 WHERE {held}"


for _name in RELATIONS:
    register(f"q_allen_{_name}", _temporal_sql([_name]))(_temporal((_name,)))
for _name, _set in TEMPORAL.items():
    register(f"q_{_name}", _temporal_sql(_set))(_temporal(_set))

# spatial relations: each vector's box against the next one's, for each frame

X, Y = (("al", "ar"), ("bl", "br"), "<"), (("a_bot", "a_top"), ("b_bot", "b_top"), ">")


def _spatial(held):
    def query(s, d):
        rows, a, b = neighbours(s, d)
        return rows.where(held(a, b)).select("a", "b", "frame")

    return query


for _name in RELATIONS:
    for _dim, _axis in (("x", X), ("y", Y)):
        register(f"q_s_{_name}_{_dim}", f"WITH {PAIRS} SELECT a, b, frame FROM pairs WHERE {relation_sql(_name, *_axis)}")(_spatial(lambda a, b, n=_name, m=_dim: axis_relation(n, m, a, b)))
for _name, _rects in REGIONS.items():
    _text = " OR ".join("((" + " OR ".join(relation_sql(n, *X) for n in xs) + ") AND (" + " OR ".join(relation_sql(n, *Y) for n in ys) + "))" for xs, ys in _rects)
    register(f"q_region_{_name[2:]}", f"WITH {PAIRS} SELECT a, b, frame FROM pairs WHERE {_text}")(_spatial(lambda a, b, n=_name: region(n, a, b)))

register("q_point_in_rect", f"""WITH {BOXES} SELECT vec_id, frame FROM boxes WHERE 0 BETWEEN "left" AND "right" AND 0 BETWEEN top AND bottom""")(
    lambda s, d: boxes(s, d).where(point_in_box(F.lit(0.0), F.lit(0.0), {c: F.col(c) for c in SIDES})).select("vec_id", "frame")
)
register("q_half_plane", f"WITH {PAIRED} SELECT vec_id, frame FROM paths WHERE (x - 1) * 1 + (y - 2) * -2 > 0")(lambda s, d: paths(s, d).where(half_plane(F.col("x"), F.col("y"), (1.0, 2.0), (1.0, -2.0))).select("vec_id", "frame"))
register("q_aabb_intersect", f"WITH {PAIRS} SELECT a, b, frame FROM pairs WHERE al <= br AND bl <= ar AND a_top <= b_bot AND b_top <= a_bot")(_spatial(boxes_meet))

# point search

_CENTRES = f"""{BOXES}, near AS (SELECT vec_id, frame, sqrt((("left"+"right")/2 - 2)*(("left"+"right")/2 - 2) + ((top+bottom)/2 - 3)*((top+bottom)/2 - 3)) AS error FROM boxes)"""


def _near(s, d):
    at = boxes(s, d).select("vec_id", F.col("frame").alias("time"), ((F.col("left") + F.col("right")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    targets = load(s, d, "embeddings").select("vec_id", F.lit(0).alias("target"), F.lit(2.0).alias("x"), F.lit(3.0).alias("y"))
    return analytics.near_point(at, targets, 12.5, ["vec_id"])


register("q_point_in_time", f"WITH {_CENTRES} SELECT vec_id, frame, round(error, 6) AS error FROM near WHERE error <= 12.5")(lambda s, d: _near(s, d).select("vec_id", F.col("time").alias("frame"), F.round("error", 6).alias("error")))
register("q_point_nearest", f"WITH {_CENTRES} SELECT vec_id, arg_min(frame, (error, frame)) AS frame, round(min(error), 6) AS error FROM near WHERE error <= 12.5 GROUP BY vec_id")(
    lambda s, d: analytics.best_match(_near(s, d), ["vec_id"]).select("vec_id", F.col("time").alias("frame"), F.round("error", 6).alias("error"))
)

# run statistics


def _runs(s, d):
    t = analytics.turns(load(s, d, "conversations"), "conv_id").withColumn("turns", F.when(F.col("turns") > 0, F.col("turns")))
    marks = load(s, d, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").alias("q"))
    rows = t.join(marks, "conv_id", "left")
    return rows.select((F.col("conv_id") % 3).alias("config_id"), "turns", F.col("q").isNull().alias("has_error"), F.coalesce(F.col("q") == 1, F.lit(False)).alias("has_success"), F.coalesce(F.col("q") == 0, F.lit(False)).alias("has_fail"))


_RUNS = """runs AS (SELECT t.conv_id % 3 AS config_id, nullif(turns, 0) AS turns, q IS NULL OR nullif(turns, 0) IS NULL AS bad, coalesce(q = 1, false) AS ok, coalesce(q = 0, false) AS no
  FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS turns FROM conversations GROUP BY 1) t LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = t.conv_id)"""
_PASS = """count(*) FILTER (bad) AS n_error, count(*) FILTER (NOT bad) AS n_total, count(*) FILTER (NOT bad AND turns <= 1) AS pass_0, count(*) FILTER (NOT bad AND ok AND turns > 1) AS pass_1plus,
  count(*) FILTER (NOT bad AND NOT ok AND no) AS n_fail, round(100.0 * count(*) FILTER (NOT bad AND turns <= 1) / nullif(count(*) FILTER (NOT bad), 0), 6) AS pass_0_pct, round(avg(turns) FILTER (NOT bad AND ok AND turns > 1), 6) AS avg_iter,
  coalesce(min(turns) FILTER (NOT bad AND ok AND turns > 1), 0) AS min_iter, coalesce(max(turns) FILTER (NOT bad AND ok AND turns > 1), 0) AS max_iter"""
register("q_stats_passk", f"WITH {_RUNS} SELECT config_id, {_PASS} FROM runs GROUP BY config_id")(lambda s, d: analytics.pass_rates(_runs(s, d), ["config_id"]))


@register("q_stats_rollup", f"WITH {_RUNS} SELECT coalesce(CAST(config_id AS VARCHAR), 'all') AS config, {_PASS} FROM runs GROUP BY GROUPING SETS ((config_id), ())")
def _rollup(s, d):
    total = analytics.grand_total(_runs(s, d), "config_id")
    return total.withColumn("config", F.coalesce(F.col("config_id").cast("string"), F.lit("all"))).drop("config_id")


# keys, keyframes, samples

register("q_keyframe_times", f"WITH {TWEENS}, t AS (SELECT DISTINCT cust, kind AS type, unnest([s, e]) AS time FROM tweens) SELECT cust, type, CAST(row_number() OVER (PARTITION BY cust, type ORDER BY time) - 1 AS INTEGER) AS k, time FROM t")(
    lambda s, d: sc.keyframe_times(day_tweens(s, d).select("cust", F.col("kind").alias("type"), F.col("s").alias("start"), F.col("e").alias("end")), ["cust"]).select("cust", "type", "k", F.col("time").cast("bigint").alias("time"))
)
register("q_surrogate_keys", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN '__el_' || p_partkey ELSE p_name END AS key FROM part")(
    lambda s, d: sc.surrogate_keys(load(s, d, "part"), "p_name", "p_partkey", ["p_brand"]).select("p_partkey", "key")
)
register("q_topk_group_sample", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 7919) % 10007, p_partkey) AS n FROM part) WHERE n <= 2")(
    lambda s, d: analytics.sample_groups(load(s, d, "part"), ["p_brand"], F.col("p_partkey") * 7919 % 10007, 2, "p_partkey").select("p_brand", "p_partkey")
)


@register("q_dataset_mix", """WITH g AS (SELECT p_partkey FROM part ORDER BY (p_partkey * 7919) % 10007, p_partkey LIMIT 80), r AS (SELECT s_suppkey FROM supplier ORDER BY (s_suppkey * 7919) % 10007, s_suppkey LIMIT 20),
  p AS (SELECT p_partkey FROM part ANTI JOIN g USING (p_partkey) ORDER BY (p_partkey * 7919) % 10007, p_partkey LIMIT 20 - (SELECT count(*) FROM r))
  SELECT p_partkey AS id, 'generated' AS kind FROM g UNION ALL SELECT s_suppkey, 'rewritten' FROM r UNION ALL SELECT p_partkey, 'padding' FROM p""")
def _mix(s, d):
    gen, re = load(s, d, "part").select(F.col("p_partkey").alias("id")), load(s, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return analytics.mix(gen, re, 80, 20, F.col("id") * 7919 % 10007, "id").select("id", "kind")



# texts

_CLEAN = "text"
for _pattern, _to in tx.CLEANUP:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_to}', 'g')"
register("q_dedup_keep_first", f"WITH c AS (SELECT doc_id, md5(trim({_CLEAN})) AS h FROM documents) SELECT min(doc_id) AS doc_id, h FROM c GROUP BY h")(
    lambda s, d: analytics.keep_first(load(s, d, "documents").select("doc_id", F.md5(tx.clean_commas(F.col("text"))).alias("h")), ["h"], ["doc_id"]).select("doc_id", "h")
)
register("q_clean_commas", f"SELECT doc_id, md5(trim({_CLEAN})) AS h FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", F.md5(tx.clean_commas(F.col("text"))).alias("h")))


@register("q_join_sentences", """WITH t AS (SELECT item_id, rtrim(text) AS a, trim(text) AS b, item_id % 2 = 0 AS alone FROM benchmark), u AS (SELECT *, CASE WHEN ends_with(a, '.') THEN left(a, length(a) - 1) ELSE a END AS c, lower(left(b, 1)) || substring(b, 2) AS l FROM t)
  SELECT item_id, CASE WHEN alone THEN c || '. Then, ' || l ELSE c || ' then ' || l END AS sentence FROM u""")
def _join(s, d):
    return load(s, d, "benchmark").select("item_id", tx.join_sentences(F.col("text"), F.lit("then"), F.col("text"), F.col("item_id") % 2 == 0).alias("sentence"))


_WORDS = ["the", "of", "und", "que", "of the", "and the", "de la"]
register("q_synonyms", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {'contains(text, ' + repr(w) + ')' if ' ' in w else 'list_contains(list_transform(string_split(text, chr(32)), lambda x: rtrim(x, ' + repr('.,!?;:') + ')), ' + repr(w) + ')'} THEN {w!r} END" for w in _WORDS) + "], lambda x: x IS NOT NULL), '|') AS found FROM documents")(
    lambda s, d: load(s, d, "documents").select("doc_id", F.array_join(tx.synonyms_in(F.col("text"), _WORDS), "|").alias("found"))
)
register("q_code_block", "SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 AND strpos(substring(text, strpos(text, chr(10)) + 1), chr(10)) > 0 THEN md5(trim(split_part(text, chr(10), 2), chr(10))) END AS h FROM documents")(
    lambda s, d: load(s, d, "documents").select("doc_id", F.md5(tx.code_block(F.col("text"), "\n")).alias("h"))
)
register("q_num_format", "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS shown FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", tx.format_number(F.col("p_retailprice")).alias("shown"))
)
