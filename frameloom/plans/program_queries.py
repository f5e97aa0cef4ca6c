"""Registered queries that run programs through the parser and compiler.

Binding: four vectors of ``embeddings`` are one scene. A vector is an object (colour and shape by its id) whose sixteen boxes are its frames; their left and top sides, in coarse
steps, are its accumulated translation and rotation, so that ``scenes.derive`` gives types and directions. A tween spans four frames.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions.allen import REGIONS, T_BEFORE
from frameloom.operators import generate
from frameloom.plans import compiler
from frameloom.plans.driver_queries import BOXES, SIDES, boxes, load, register, relation_sql
from frameloom.plans.program_tables import evaluate_programs
from frameloom.sources import scenes as sc

C = F.col
COLORS, SHAPES = ("red", "green", "blue"), ("square", "circle")


def scene_tables(s, d) -> sc.Scenes:
    ids = load(s, d, "embeddings").select("vec_id", F.floor(C("vec_id") / 4).alias("scene_id"), (C("vec_id") % 4).cast("int").alias("obj_idx"))
    pick = lambda names, of: F.get(F.array(*map(F.lit, names)), of.cast("int"))
    objects = ids.select("scene_id", "obj_idx", C("vec_id").cast("string").alias("obj_id"), pick(SHAPES, C("vec_id") % 2).alias("shape"), pick(COLORS, C("vec_id") % 3).alias("fill"), F.lit(None).cast("string").alias("stroke"))
    step = lambda c: F.floor(F.round(C(c), 6) / 8) * 8.0
    one, none = F.lit(1.0), F.lit(0.0)
    rows = boxes(s, d).join(ids, "vec_id").select("scene_id", "obj_idx", "frame", F.lit(15).alias("steps"), step("left").alias("tx_acc"), none.alias("ty_acc"), step("top").alias("rot_acc"), one.alias("sx_acc"), one.alias("sy_acc"), none.alias("kx_acc"), none.alias("ky_acc"), *SIDES)
    tweens = ids.select("scene_id", "obj_idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tween_idx")).withColumns({"start": C("tween_idx") * 4.0, "end": F.least(C("tween_idx") * 4 + 3.0, F.lit(15.0)), "type": F.lit("translate"), "duration": F.lit(3.0)})
    return sc.Scenes(ids.select("scene_id").distinct().withColumn("steps", F.lit(15)), objects, tweens, sc.derive(rows))


SCENES = BOXES + """, ids AS (SELECT vec_id, vec_id // 4 AS scene, vec_id % 4 AS obj, ['red', 'green', 'blue'][vec_id % 3 + 1] AS fill, ['square', 'circle'][vec_id % 2 + 1] AS shape FROM embeddings), scenes AS (SELECT DISTINCT scene FROM ids),
  acc AS (SELECT scene, obj, fill, shape, frame, "left", "right", top, bottom, floor(round("left", 6) / 8) * 8 AS tx, floor(round(top, 6) / 8) * 8 AS rot FROM boxes JOIN ids USING (vec_id)),
  moved AS (SELECT *, tx - coalesce(lag(tx) OVER w, 0) AS dx, rot - coalesce(lag(rot) OVER w, 0) AS dr FROM acc WINDOW w AS (PARTITION BY scene, obj ORDER BY frame)),
  cells AS (SELECT * FROM moved WHERE frame < 15)"""


def first_runs_sql(name: str, condition: str, source: str = "cells") -> str:
    """CTEs of the first run of each object in which a condition holds."""
    return f"""{name}_all AS (SELECT scene, obj, min(frame) AS s, max(frame) AS e FROM (SELECT scene, obj, frame, frame - row_number() OVER (PARTITION BY scene, obj ORDER BY frame) AS g FROM {source} WHERE {condition}) GROUP BY scene, obj, g),
  {name} AS (SELECT scene, obj, min(s) AS s, arg_min(e, s) AS e FROM {name}_all GROUP BY scene, obj)"""


def report_sql(ctes: str, nodes: list[tuple[int, int, str]], table: str, status: str = "'ok'") -> str:
    """Report rows of a table with one row for each scene, whose columns are the results."""
    rows = " UNION ALL ".join(f"SELECT scene AS scene_id, {n} AS stmt_idx, {i} AS node_idx, coalesce({c}, false) AS result, {status if n == nodes[-1][0] else repr('ok')} AS status FROM {table}" for n, i, c in nodes)
    return f"WITH {ctes} {rows}"


def reported(program: str):
    return lambda s, d: compiler.evaluate(program, scene_tables(s, d)).select("scene_id", "stmt_idx", "node_idx", "result", "status")


register("q_derived", f"WITH {SCENES} SELECT scene AS scene_id, obj AS obj_idx, frame, dx AS tx, dr AS rot, (dx <> 0)::INT + 2 * (dr <> 0)::INT AS types, CASE WHEN frame < 15 THEN sign(dx) END AS dir_tx, CASE WHEN frame < 15 THEN CAST(sign(dr) AS INT) END AS dir_rot FROM moved")(
    lambda s, d: scene_tables(s, d).frames.select("scene_id", "obj_idx", "frame", "tx", "rot", "types", "dir_tx", "dir_rot")
)
EXISTENCE = 'exists(Motion, lambda m: type(m, "translate") and direction(m, [1.0, 0.0]))\nforall(Motion, lambda m: type(m, "translate"))\nexists(Object, lambda o: color(o, "red"))\nforall(Object, lambda o: shape(o, "circle"))'
register("q_program_existence", report_sql(f"""{SCENES}, per AS (SELECT scene, frame, bool_and(dx <> 0) AS every FROM cells GROUP BY ALL), objs AS (SELECT scene, bool_or(fill = 'red') AS red, bool_and(shape = 'circle') AS circles, bool_or(shape = 'circle') AS circle FROM ids GROUP BY 1),
  t AS (SELECT scene, bool_or(dx > 0) AS a, bool_or(dx <> 0) AS b FROM cells GROUP BY 1), r AS (SELECT t.*, red, circles, circle, every FROM t JOIN objs USING (scene) JOIN (SELECT scene, bool_or(every) AS every FROM per GROUP BY 1) USING (scene))""",
    [(0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "every"), (1, 1, "b"), (2, 0, "red"), (2, 1, "red"), (3, 0, "circles"), (3, 1, "circle")], "r"))(reported(EXISTENCE))

OBJECTS_ = 'o_1 = iota(Object, lambda o: color(o, "red") and shape(o, "square"))\no_2 = iota(Object, lambda o: color(o, "blue"))\n'
CHAIN = OBJECTS_ + 'm_1 = iota(Motion, lambda m: type(m, "translate") and agent(m, o_1))\nm_2 = iota(Motion, lambda m: type(m, "rotate") and agent(m, o_2))\nt_before(m_1, m_2)'
_FIRST = f"{SCENES}, o1 AS (SELECT scene, min(obj) AS obj FROM ids WHERE fill = 'red' AND shape = 'square' GROUP BY 1), o2 AS (SELECT scene, min(obj) AS obj FROM ids WHERE fill = 'blue' GROUP BY 1)"
_BEFORE = " OR ".join(relation_sql(n, ("a.s", "a.e"), ("b.s", "b.e"), gap=" + 1") for n in T_BEFORE)
_CHAIN = f"""{_FIRST}, c1 AS (SELECT cells.* FROM cells SEMI JOIN o1 USING (scene, obj)), c2 AS (SELECT cells.* FROM cells SEMI JOIN o2 USING (scene, obj)), {first_runs_sql('m1', 'dx <> 0', 'c1')}, {first_runs_sql('m2', 'dr <> 0', 'c2')},
  any_ AS (SELECT scene, bool_or(dx <> 0) AS t, bool_or(dr <> 0) AS r FROM cells GROUP BY 1), objs AS (SELECT scene, bool_or(fill = 'red') AS red, bool_or(shape = 'square') AS square, bool_or(fill = 'blue') AS blue, bool_or(fill = 'red' AND shape = 'square') AS both_ FROM ids GROUP BY 1),
  a1 AS (SELECT scene, bool_or(dx <> 0) AS t, bool_or(dx <> 0 OR dr <> 0) AS moves FROM c1 GROUP BY 1), a2 AS (SELECT scene, bool_or(dr <> 0) AS r, bool_or(dx <> 0 OR dr <> 0) AS moves FROM c2 GROUP BY 1),
  pairs AS (SELECT DISTINCT a.scene, true AS held FROM m1 a JOIN m2 b ON a.scene = b.scene WHERE {_BEFORE}),
  r AS (SELECT s.scene, both_, red, square, blue, a1.t AS m1, any_.t, a1.moves AS g1, a2.r AS m2, any_.r, a2.moves AS g2, held FROM scenes s LEFT JOIN objs USING (scene) LEFT JOIN any_ USING (scene) LEFT JOIN a1 USING (scene) LEFT JOIN a2 USING (scene) LEFT JOIN pairs USING (scene))"""
_CHAIN_NODES = [(0, 0, "both_"), (0, 1, "red"), (0, 2, "square"), (1, 0, "blue"), (1, 1, "blue"), (2, 0, "m1"), (2, 1, "t"), (2, 2, "g1"), (3, 0, "m2"), (3, 1, "r"), (3, 2, "g2"), (4, 0, "held"), (4, 1, "held")]
register("q_program_chain", report_sql(_CHAIN, _CHAIN_NODES, "r"))(reported(CHAIN))
_ALL = " AND ".join(f"coalesce({c}, false)" for _, _, c in _CHAIN_NODES)
_WHOLE = " AND ".join(f"coalesce({c}, false)" for _, i, c in _CHAIN_NODES if i == 0)
register("q_program_verdict", f"WITH {_CHAIN} SELECT scene AS scene_id, {_ALL} AS strict, {_WHOLE} AS statements FROM r")(lambda s, d: compiler.verdicts(compiler.evaluate(CHAIN, scene_tables(s, d))))
_TEXT = 'exists(Object, lambda o: color(o, "red") and (not shape(o, "circle")))'
register("q_program_report", f"""WITH {SCENES}, r AS (SELECT scene, bool_or(fill = 'red' AND shape <> 'circle') AS h, bool_or(fill = 'red') AS c, bool_or(shape = 'circle') AS s FROM ids GROUP BY 1), v AS (SELECT scene, if(h, 'True', 'False') AS h, if(c, 'True', 'False') AS c, if(s, 'True', 'False') AS s FROM r)
  SELECT scene AS scene_id, '{_TEXT}: ' || h || chr(10) || 'color: ' || c || chr(10) || 'shape: ' || s || chr(10) || chr(10) || 'exists(Object, lambda o: color(o, "red")): ' || c || chr(10) || 'color: ' || c AS report FROM v""")(
    lambda s, d: compiler.report_text(compiler.evaluate(_TEXT + '  # a comment\nexists(Object,\n  lambda o: color(o, "red"))', scene_tables(s, d)))
)
VARIABLES = 'm_1 = iota(Motion, lambda m: type(m, "translate"))\nm_2 = iota(Motion, lambda m: type(m, "translate") and not m_1)\nm_3 = iota(Motion, lambda m: m_2 or type(m, "rotate"))\nt_while(m_1, m_3)'
register("q_program_variables", report_sql(f"""{SCENES}, {first_runs_sql('m1', 'dx <> 0')}, rest AS (SELECT c.* FROM cells c JOIN m1 USING (scene, obj) WHERE dx <> 0 AND NOT frame BETWEEN s AND e), {first_runs_sql('m2', 'true', 'rest')},
  third AS (SELECT c.scene, c.obj, c.frame FROM cells c LEFT JOIN m2 USING (scene, obj) WHERE dr <> 0 OR frame BETWEEN s AND e), {first_runs_sql('m3', 'true', 'third')},
  w AS (SELECT DISTINCT a.scene, true AS held FROM m1 a JOIN m3 b ON a.scene = b.scene WHERE {" OR ".join(relation_sql(n, ("a.s", "a.e"), ("b.s", "b.e"), gap=" + 1") for n in __import__('frameloom.functions.allen', fromlist=['TEMPORAL']).TEMPORAL['t_while'])}),
  r AS (SELECT s.scene, t, rot, scene IN (SELECT scene FROM rest) AS two, scene IN (SELECT scene FROM third) AS three, held FROM scenes s LEFT JOIN (SELECT scene, bool_or(dx <> 0) AS t, bool_or(dr <> 0) AS rot FROM cells GROUP BY 1) USING (scene) LEFT JOIN w USING (scene))""",
    [(0, 0, "t"), (0, 1, "t"), (1, 0, "two"), (1, 1, "t"), (2, 0, "three"), (2, 1, "rot"), (3, 0, "held"), (3, 1, "held")], "r"))(reported(VARIABLES))


def _region_sql(name: str) -> str:
    x, y = (("al", "ar"), ("bl", "br"), "<"), (("a_bot", "a_top"), ("b_bot", "b_top"), ">")
    return " OR ".join("((" + " OR ".join(relation_sql(n, *x) for n in xs) + ") AND (" + " OR ".join(relation_sql(n, *y) for n in ys) + "))" for xs, ys in REGIONS[name])


_SPACE = f"""{_FIRST}, pairs AS (SELECT a.scene, a.frame, a."left" AS al, a."right" AS ar, a.top AS a_top, a.bottom AS a_bot, b."left" AS bl, b."right" AS br, b.top AS b_top, b.bottom AS b_bot
  FROM (SELECT cells.* FROM cells SEMI JOIN o1 USING (scene, obj)) a JOIN (SELECT cells.* FROM cells SEMI JOIN o2 USING (scene, obj)) b ON a.scene = b.scene AND a.frame = b.frame)"""
register("q_program_region", report_sql(f"""{_SPACE}, held AS (SELECT scene, bool_or({_region_sql('s_left')}) AS h FROM pairs GROUP BY 1), objs AS (SELECT scene, bool_or(fill = 'red' AND shape = 'square') AS a, bool_or(fill = 'red') AS b, bool_or(shape = 'square') AS c, bool_or(fill = 'blue') AS d FROM ids GROUP BY 1),
  r AS (SELECT s.scene, a, b, c, d, h, a AND d AS found FROM scenes s LEFT JOIN objs USING (scene) LEFT JOIN held USING (scene))""",
    [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "d"), (1, 1, "d"), (2, 0, "h"), (2, 1, "h")], "r", "if(found, 'ok', 'invalid')"))(reported(OBJECTS_ + "s_left(o_1, o_2)"))
register("q_program_getters", report_sql(f"""{SCENES}, o1 AS (SELECT scene, arg_min(fill, obj) AS fill, min(obj) AS obj FROM ids WHERE shape = 'square' GROUP BY 1),
  r AS (SELECT s.scene, q.h AS sq, g.h AS same, g.other FROM scenes s LEFT JOIN (SELECT scene, bool_or(shape = 'square') AS h FROM ids GROUP BY 1) q USING (scene) LEFT JOIN (SELECT ids.scene, bool_or(ids.fill = o1.fill) AS h, bool_or(ids.fill = o1.fill AND ids.obj <> o1.obj) AS other FROM ids LEFT JOIN o1 USING (scene) GROUP BY 1) g USING (scene))""",
    [(0, 0, "sq"), (0, 1, "sq"), (1, 0, "other"), (1, 1, "same")], "r"))(reported('o_1 = iota(Object, lambda o: shape(o, "square"))\no_2 = all(Object, lambda o: color(o, get_color(o_1)) and not o_1)'))
OWN = 'o_1 = iota(Object, lambda o: color(o, "red"))\no_2 = all(Object, lambda o: shape(o, get_shape(o_1)) and not o_1)\no_3 = all(Object, lambda o: id(o, get_id(o_1)))\nexists(Object, lambda o: id(o, "5"))'
register("q_program_object_getters", report_sql(f"""{SCENES}, o1 AS (SELECT scene, arg_min(shape, obj) AS shape, arg_min(vec_id, obj) AS vec_id, min(obj) AS obj FROM ids WHERE fill = 'red' GROUP BY 1),
  r AS (SELECT ids.scene, bool_or(fill = 'red') AS red, bool_or(ids.shape = o1.shape AND ids.obj <> o1.obj) AS other, bool_or(ids.shape = o1.shape) AS alike, bool_or(ids.vec_id = o1.vec_id) AS same, bool_or(ids.vec_id = 5) AS five FROM ids LEFT JOIN o1 USING (scene) GROUP BY 1)""",
    [(0, 0, "red"), (0, 1, "red"), (1, 0, "other"), (1, 1, "alike"), (2, 0, "same"), (2, 1, "same"), (3, 0, "five"), (3, 1, "five")], "r"))(reported(OWN))
register("q_program_post", f"""WITH {_SPACE}, hit AS (SELECT DISTINCT scene, k FROM pairs, generate_series(0, 3) g(k) WHERE pairs.frame = least(4 * k + 3, 14) AND ({_region_sql('s_left')})),
  marked AS (SELECT DISTINCT scene, CAST(unnest(generate_series(4 * k, least(4 * k + 3, 15) - 1)) AS INT) AS frame FROM hit), c1 AS (SELECT c.* FROM cells c SEMI JOIN o1 USING (scene, obj) SEMI JOIN marked m ON c.scene = m.scene AND c.frame = m.frame)
  SELECT s.scene AS scene_id, coalesce(bool_or(dx <> 0), false) AS result FROM scenes s LEFT JOIN c1 ON c1.scene = s.scene GROUP BY 1""")(
    lambda s, d: compiler.evaluate(OBJECTS_ + 'm_1 = iota(Motion, lambda m: type(m, "translate") and post(m, s_left(o_1, o_2)) and agent(m, o_1))', scene_tables(s, d)).where("stmt_idx = 2 and node_idx = 0").select("scene_id", "result")
)
RECORDED = 'm_1 = iota(Motion, lambda m: type(m, "translate") and direction(m, [1.0, 0.0]) and duration(m, 3.0))\nm_2 = iota(Motion, lambda m: type(m, get_type(m_1)) and direction(m, get_direction(m_1)) and duration(m, get_duration(m_1)) and not m_1)'
register("q_program_motion_getters", report_sql(f"""{SCENES}, {first_runs_sql('m1', 'dx > 0')}, rest AS (SELECT DISTINCT scene FROM cells c JOIN m1 USING (scene, obj) WHERE dx > 0 AND NOT frame BETWEEN s AND e),
  r AS (SELECT scene, bool_or(dx > 0) AS a, bool_or(dx <> 0) AS t, scene IN (SELECT scene FROM rest) AS two, true AS yes FROM cells GROUP BY 1)""",
    [(0, 0, "a"), (0, 1, "t"), (0, 2, "a"), (0, 3, "yes"), (1, 0, "two"), (1, 1, "t"), (1, 2, "a"), (1, 3, "yes")], "r"))(reported(RECORDED))
TAKEN = OBJECTS_ + 'm_1 = iota(Motion, lambda m: type(m, "translate") and post(m, s_left(o_1, o_2)) and agent(m, o_1))\nexists(Motion, lambda m: type(m, get_type(m_1)) and post(m, get_post(m_1)) and agent(m, get_agent(m_1)))\nm_3 = iota(Motion, lambda m: type(m, "translate") and magnitude(m, 16.0))\nexists(Motion, lambda m: type(m, "translate") and magnitude(m, get_magnitude(m_3)) and not m_3)'
register("q_program_taken", f"""WITH {_SPACE}, hit AS (SELECT DISTINCT scene, k FROM pairs, generate_series(0, 3) g(k) WHERE pairs.frame = least(4 * k + 3, 14) AND ({_region_sql('s_left')})),
  marked AS (SELECT DISTINCT scene, CAST(unnest(generate_series(4 * k, least(4 * k + 3, 15) - 1)) AS INT) AS frame FROM hit), c1 AS (SELECT c.* FROM cells c SEMI JOIN o1 USING (scene, obj) SEMI JOIN marked m ON c.scene = m.scene AND c.frame = m.frame),
  ends AS (SELECT b.scene, b.obj, k, 4 * k AS s, max(f.frame) - 1 AS e FROM generate_series(0, 3) g(k) JOIN acc b ON b.frame = 4 * k JOIN moved f ON f.scene = b.scene AND f.obj = b.obj AND f.frame BETWEEN 4 * k AND least(4 * k + 3, 15) WHERE f.dx <> 0 AND abs(abs(f.tx - b.tx) - 16) <= 0.1 + 16e-5 GROUP BY ALL),
  far AS (SELECT DISTINCT cells.scene, cells.obj, cells.frame FROM cells JOIN ends ON cells.scene = ends.scene AND cells.obj = ends.obj AND cells.frame BETWEEN s AND e WHERE dx <> 0), {first_runs_sql('m3', 'true', 'far')},
  r AS (SELECT s.scene, EXISTS (SELECT 1 FROM c1 WHERE c1.scene = s.scene AND dx <> 0) AS taken, EXISTS (SELECT 1 FROM far WHERE far.scene = s.scene) AS far, EXISTS (SELECT 1 FROM far JOIN m3 USING (scene, obj) WHERE far.scene = s.scene AND NOT far.frame BETWEEN m3.s AND m3.e) AS more FROM scenes s)
  SELECT scene AS scene_id, n AS stmt_idx, CASE n WHEN 2 THEN taken WHEN 3 THEN taken WHEN 4 THEN far ELSE more END AS result FROM r, generate_series(2, 5) g(n)""")(
    lambda s, d: compiler.evaluate(TAKEN, scene_tables(s, d)).where("node_idx = 0 and stmt_idx > 1").select("scene_id", "stmt_idx", "result")
)
register("q_program_count", f"WITH {SCENES}, {first_runs_sql('m', 'dx <> 0')} SELECT s.scene AS scene_id, count(m_all.s) AS n FROM scenes s LEFT JOIN m_all ON m_all.scene = s.scene GROUP BY 1")(
    lambda s, d: compiler.count('count(Motion, lambda m: type(m, "translate"))', scene_tables(s, d))
)
register("q_program_trace", f"WITH {SCENES} SELECT scene AS scene_id, obj AS obj_idx, frame, node, CASE node WHEN 1 THEN dx <> 0 WHEN 2 THEN dx > 0 ELSE dx > 0 END AS result FROM cells, (VALUES (0), (1), (2)) n(node)")(
    lambda s, d: compiler.trace('exists(Motion, lambda m: type(m, "translate") and direction(m, [1.0, 0.0]))', scene_tables(s, d)).select("scene_id", "obj_idx", "frame", C("node_idx").alias("node"), "result")
)


def _registered(s, d):
    compiler.register_predicate("wide", "Motion", lambda least: C("right") - C("left") >= float(least))
    return compiler.evaluate('exists(Motion, lambda m: wide(m, 12) and type(m, "translate"))', scene_tables(s, d)).where("node_idx = 0").select("scene_id", "result")


register("q_program_registered_predicate", f"""WITH {SCENES} SELECT scene AS scene_id, bool_or("right" - "left" >= 12 AND dx <> 0) AS result FROM cells GROUP BY 1""")(_registered)


# a table of programs: each scene's own, on that scene and the next two


def _program_table(s, d):
    found = scene_tables(s, d)
    ids = found.scenes.select(C("scene_id").alias("program_id"))
    color, kind = F.get(F.array(*map(F.lit, COLORS)), (C("program_id") % 3).cast("int")), F.when(C("program_id") % 2 == 1, "translate").otherwise("rotate")
    lines = F.concat(
        F.lit('thing = iota(Object, lambda o: color(o, "'), color, F.lit('"))\n'), F.lit('m_1 = iota(Motion, lambda m: type(m, "'), kind, F.lit('") and agent(m, thing))\n'),
        F.lit('m_2 = iota(Motion, lambda m: not m_1 and type(m, "rotate"))\n'), F.when(C("program_id") % 5 == 0, "exists(Object, thing)").otherwise("t_before(m_1, m_2) and not precedes(m_2, m_1)"),
    )
    assigned = ids.select("program_id", F.explode(F.sequence(C("program_id"), C("program_id") + 2)).alias("scene_id"))
    out = evaluate_programs(ids.select("program_id", lines.alias("text")), assigned, found)
    return out.select("program_id", "scene_id", "stmt_idx", "node_idx", "result", "status")


_NODES = [(0, 0, "red"), (0, 1, "red"), (1, 0, "one"), (1, 1, "kind"), (1, 2, "moves"), (2, 0, "two"), (2, 1, "rot"), (3, 0, "bef AND NOT coalesce(pre, false)"), (3, 1, "bef"), (3, 2, "pre")]
_HELD = lambda names: " OR ".join(relation_sql(n, ("a.s", "a.e"), ("b.s", "b.e"), gap=" + 1") for n in names)
register("q_program_table", f"""WITH {SCENES}, asked AS (SELECT p.scene AS p, s.scene, ['red', 'green', 'blue'][p.scene % 3 + 1] AS c, p.scene % 2 = 1 AS tr FROM scenes p JOIN scenes s ON s.scene BETWEEN p.scene AND p.scene + 2),
  one AS (SELECT p, scene, tr, min(obj) AS obj FROM asked JOIN ids USING (scene) WHERE fill = c GROUP BY ALL), mine AS (SELECT p, tr, cells.* FROM one JOIN cells USING (scene, obj)),
  f1 AS (SELECT p, scene, obj, min(frame) AS s, max(frame) AS e FROM (SELECT p, scene, obj, frame, frame - row_number() OVER (PARTITION BY p, scene, obj ORDER BY frame) AS g FROM mine WHERE if(tr, dx <> 0, dr <> 0)) GROUP BY p, scene, obj, g), m1 AS (SELECT p, scene, obj, min(s) AS s, arg_min(e, s) AS e FROM f1 GROUP BY ALL),
  rest AS (SELECT asked.p, cells.* FROM asked JOIN cells USING (scene) LEFT JOIN m1 ON m1.p = asked.p AND m1.scene = cells.scene AND m1.obj = cells.obj WHERE dr <> 0 AND NOT coalesce(cells.frame BETWEEN m1.s AND m1.e, false)),
  f2 AS (SELECT p, scene, obj, min(frame) AS s, max(frame) AS e FROM (SELECT p, scene, obj, frame, frame - row_number() OVER (PARTITION BY p, scene, obj ORDER BY frame) AS g FROM rest) GROUP BY p, scene, obj, g), m2 AS (SELECT p, scene, obj, min(s) AS s, arg_min(e, s) AS e FROM f2 GROUP BY ALL),
  rel AS (SELECT p, scene, bool_or({_HELD(T_BEFORE)}) AS bef, bool_or(b.e + 1 < a.s) AS pre FROM m1 a JOIN m2 b USING (p, scene) GROUP BY ALL),
  r AS (SELECT asked.p, asked.scene, (SELECT bool_or(fill = c) FROM ids WHERE ids.scene = asked.scene) AS red, EXISTS (SELECT 1 FROM m1 WHERE m1.p = asked.p AND m1.scene = asked.scene) AS one, coalesce(if(tr, t, o), false) AS kind, o AS rot,
    EXISTS (SELECT 1 FROM mine WHERE mine.p = asked.p AND mine.scene = asked.scene AND (dx <> 0 OR dr <> 0)) AS moves, EXISTS (SELECT 1 FROM m2 WHERE m2.p = asked.p AND m2.scene = asked.scene) AS two, bef, pre
    FROM asked LEFT JOIN (SELECT scene, bool_or(dx <> 0) AS t, bool_or(dr <> 0) AS o FROM cells GROUP BY 1) USING (scene) LEFT JOIN rel ON rel.p = asked.p AND rel.scene = asked.scene)
  {" UNION ALL ".join(f"SELECT p AS program_id, scene AS scene_id, {n} AS stmt_idx, {i} AS node_idx, coalesce({c}, false) AS result, 'ok' AS status FROM r WHERE p % 5 <> 0" for n, i, c in _NODES)}
  UNION ALL SELECT p, scene, -1, 0, false, 'rejected' FROM asked WHERE p % 5 = 0""")(_program_table)


def _graphs(s, d):
    """Each order as a scene graph of two motions."""
    rows = load(s, d, "orders").select(C("o_orderkey").alias("graph_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("motion_idx"), "o_custkey")
    thing = lambda color, shape: F.struct(F.lit(shape).alias("shape"), color.alias("fill"))
    color = F.get(F.array(*map(F.lit, COLORS)), ((C("o_custkey") + C("motion_idx")) % 3).cast("int"))
    second = C("motion_idx") == 1
    return rows.select(
        "graph_id", "motion_idx", F.when(second, "rotate").otherwise("translate").alias("type"), F.when(second, F.lit('"clockwise"')).otherwise("[0.0, 1.0]").alias("direction"), F.when(~second, "100.0").alias("magnitude"), F.when(second, F.lit('["50%", "50%"]')).alias("origin"),
        F.when(C("o_custkey") % 2 == 0, "2.0").alias("duration"), F.array(thing(color, "square")).alias("agents"), F.when(~second, F.lit("adjacenting")).alias("post"), F.when(~second, F.array(thing(F.lit("gray"), "circle"))).alias("post_reference"), F.when(second, "before").alias("relation"),
    )


register("q_program_text", """WITH g AS (SELECT o_orderkey, ['red', 'green', 'blue'][o_custkey % 3 + 1] AS a, ['red', 'green', 'blue'][(o_custkey + 1) % 3 + 1] AS b, if(o_custkey % 2 = 0, ' and duration(m, 2.0)', '') AS t FROM orders)
  SELECT o_orderkey AS graph_id, 'o_1 = iota(Object, lambda o: color(o, "' || a || '") and shape(o, "square"))' || chr(10) || 'o_2 = iota(Object, lambda o: color(o, "gray") and shape(o, "circle"))' || chr(10) || 'o_3 = iota(Object, lambda o: color(o, "' || b || '") and shape(o, "square"))' || chr(10) || chr(10)
    || 'm_1 = iota(Motion, lambda m: type(m, "translate") and direction(m, [0.0, 1.0]) and magnitude(m, 100.0) and post(m, s_adjacent(o_1, o_2))' || t || ' and agent(m, o_1))' || chr(10) || 'm_2 = iota(Motion, lambda m: type(m, "rotate") and direction(m, "clockwise") and origin(m, ["50%", "50%"])' || t || ' and agent(m, o_3))' || chr(10) || chr(10) || 't_before(m_1, m_2)' AS program FROM g""")(
    lambda s, d: generate.programs(_graphs(s, d))
)

__all__ = ["scene_tables"]
