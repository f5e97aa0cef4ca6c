"""The motion engine against worked fixtures and a dense pure-Python reading of the semantics."""

from __future__ import annotations

import itertools
import json
import random

import program_text
import pytest
from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions.allen import INVERSE, REGIONS, RELATIONS, axis_relation, region, relation
from frameloom.functions.motion_types import parse_types
from frameloom.operators import analytics, generate, motion
from frameloom.plans.compiler import evaluate, report_text, verdicts
from frameloom.plans.lang import ProgramError, parse
from frameloom.sources import scenes as sc

OBJECTS = "scene_id string,obj_idx int,obj_id string,source_id string,shape string,fill string,stroke string,size array<double>,x double,y double,w double,h double"
PLAN = "scene_id string,obj_id string,tween_idx int,type string,begin double,seconds double,dx double,dy double,rot double,scale_x double,scale_y double,skew_x double,skew_y double"
PALETTE = [("black-square", "square", "black", 68.0), ("black-circle", "circle", "black", 150.0), ("blue-square", "square", "royal blue", 227.0), ("blue-circle", "circle", "royal blue", 303.0)]


def tween(obj, k, kind, begin, seconds, dx=0.0, dy=0.0, rot=0.0, sx=1.0, sy=1.0, kx=0.0, scene="s"):
    return (scene, obj, k, kind, begin, seconds, dx, dy, rot, sx, sy, kx, 0.0)


def scene(spark, tweens, seconds, fps=60.0, ids=("s",)):
    scenes = spark.createDataFrame([(i, seconds, fps) for i in ids], "scene_id string, duration double, fps double")
    objects = spark.createDataFrame([(i, n, name, None, shape, fill, None, [50.0, 50.0], 175.0, y, 50.0, 50.0) for i in ids for n, (name, shape, fill, y) in enumerate(PALETTE)], OBJECTS)
    return sc.sample(scenes, objects, spark.createDataFrame(tweens, PLAN))


def test_sampler_compound_tween(spark):
    s = scene(spark, [tween("black-square", 0, "other", 0.0, 1.0, 10.0, 20.0, 90.0, 2.0, 0.5, 10.0)], 1.0, 2.0)
    rows = s.frames.where("obj_idx = 0").orderBy("frame").collect()
    get = lambda c: [round(r[c], 6) for r in rows]
    assert get("tx_acc") == [0, 5, 10] and get("ty_acc") == [0, -10, -20] and get("rot_acc") == [0, 45, 90]
    assert get("sx_acc") == [1, 1.5, 2] and get("sy_acc") == [1, 0.75, 0.5] and get("kx_acc") == [0, 5, 10]
    assert [r.letters for r in rows] == ["", "TRSK", "TRSK"] and [r.types for r in rows] == [0, 7, 7]
    assert [round(r.sx, 4) for r in rows] == [1, 1.5, 1.3333]
    assert [(round(r.dir_tx, 6), round(r.dir_ty, 6)) for r in rows[:2]] == [(0, 0), (0.447214, -0.894427)] and rows[2].dir_tx is None
    assert [r.dir_rot for r in rows[:2]] == [0, 1] and [(r.dir_sx, r.dir_sy) for r in rows[:2]] == [(0, 0), (1, -1)]
    t = s.tweens.first()
    assert (t.start, t.end) == (0, 2)


PROGRAM = """o_1 = iota(Object, lambda o: color(o, "black") and shape(o, "square"))
exists(Motion, lambda m_1: type(m_1, "translate") and direction(m_1, [1.0, 0.0]) and magnitude(m_1, 100.0) and duration(m_1, 2.0) and agent(m_1, o_1))"""


def test_translate_right_report(spark):
    s = scene(spark, [tween("black-square", 0, "translate", 0.0, 2.0, 100.0)], 2.0)
    text = report_text(evaluate(PROGRAM, s)).first().report
    assert text.split("\n\n")[0] == 'o_1 = iota(Object, lambda o: color(o, "black") and shape(o, "square")): True\ncolor: True\nshape: True'
    assert text.endswith("type: True\ndirection: True\nmagnitude: True\nduration: True\nagent: True")
    assert verdicts(evaluate(PROGRAM, s)).first().strict


@pytest.mark.parametrize("change, tag", [({"dx": 80.0}, "magnitude"), ({"dx": -100.0}, "direction"), ({"seconds": 1.9}, "duration")])
def test_translate_right_negative(spark, change, tag):
    s = scene(spark, [tween("black-square", 0, "translate", 0.0, **{"seconds": 2.0, "dx": 100.0, **change})], 2.0)
    rows = {(r.stmt_idx, r.tag): r.result for r in evaluate(PROGRAM, s).collect()}
    assert rows[1, tag] is False


def test_two_squares(spark):
    s = scene(spark, [tween("black-square", 0, "translate", 0.0, 1.0, 50.0), tween("black-square", 1, "translate", 1.0, 1.0, 0.0, 50.0), tween("black-square", 2, "translate", 2.0, 1.0, 50.0), tween("blue-square", 0, "translate", 0.0, 1.0, 0.0, -50.0)], 3.0)
    move = lambda d, o, more="": f'iota(Motion, lambda m: type(m, "translate") and direction(m, {d}) and agent(m, {o}){more})'
    program = f"""o_1 = iota(Object, lambda o: color(o, "black") and shape(o, "square"))
o_2 = iota(Object, lambda o: shape(o, "square") and not o_1)
m_1 = {move([1.0, 0.0], "o_1")}
m_2 = {move([0.0, -1.0], "o_1")}
m_3 = {move([1.0, 0.0], "o_1", " and not m_1")}
m_4 = {move([0.0, 1.0], "o_2")}
t_before(m_1, m_2)
t_after(m_3, m_2)
t_while(m_1, m_4)
precedes(m_1, m_2)
not precedes(m_1, m_2)
s_top(o_1, o_2)
exists(Motion, lambda m: type(m, "translate") and agent(m, get_agent(m_1)) and post(m, s_top(o_1, o_2)))
exists(Motion, lambda m: type(m, "translate") and origin(m, ["50%", "50%"]))"""
    rows = [r.result for r in evaluate(program, s).where("node_idx = 0").orderBy("stmt_idx").collect()]
    assert rows == [True] * 9 + [False] + [True] * 4


def test_empty_selections(spark):
    s = scene(spark, [tween("black-square", 0, "translate", 0.0, 1.0, 50.0)], 1.0, ids=("s",))
    program = """o_1 = iota(Object, lambda o: color(o, "pink"))
o_2 = iota(Object, lambda o: shape(o, "square"))
exists(Motion, lambda m: type(m, "any") and agent(m, o_1))
s_top(o_1, o_2)
forall(Object, lambda o: color(o, "black"))
exists(Object, lambda o: id(o, "black-circle"))"""
    rows = [(r.result, r.status) for r in evaluate(program, s).where("node_idx = 0").orderBy("stmt_idx").collect()]
    assert rows == [(False, "ok"), (True, "ok"), (False, "ok"), (False, "invalid"), (False, "ok"), (True, "ok")]


@pytest.mark.parametrize("text", [
    'exists(Motion, lambda m: jump(m, "x"))', 'exists(Motion, lambda m: direction(m, [1, 0]) and type(m, "translate"))', 'exists(Motion, lambda m: type(m, "translate") and duration(m, [1, 2]))',
    'exists(Motion, lambda m: type(m, "scale") and magnitude(m, 2))', 'exists(Motion, lambda m: type(m, "translate") and direction(m, [0.0, 0.0]))', 'm = all(Motion, lambda m: type(m, "any"))', "o = iota(2, Object, lambda o: o)",
    'o = iota(Object, lambda o: color(o, "a"))\no = iota(Object, lambda o: color(o, "b"))', "exists(Motion, lambda m: agent(m, o_9))", 'exists(Motion, lambda m: type(m, "rotate +"))', "x = 3",
])
def test_rejected_programs(text):
    with pytest.raises(ProgramError):
        parse(text)


def close(a, b, tol=5.0):
    return abs(a - b) <= tol + 1e-5 * abs(b)


def holds(name, a, b, less=lambda x, y: x < y, gap=0):
    if name in INVERSE:
        return holds(INVERSE[name], b, a, less, gap)
    (s, e), (u, v) = a, b
    return {"precedes": less(e + gap, u), "meets": close(e, u), "overlaps": less(s, u) and less(u, e) and less(e, v), "finished_by": less(s, u) and close(e, v), "contains": less(s, u) and less(v, e), "starts": close(s, u) and less(e, v), "equals": close(s, u) and close(e, v)}[name]


def test_relations_and_regions(spark):
    ends = [0.0, 1, 3, 5, 6, 7, 12, 13, 18, 25]
    spans = [(s, e) for s in ends for e in ends if s <= e]
    pairs = [(*a, *b) for a in spans for b in spans]
    df = spark.createDataFrame([tuple(map(float, p)) for p in pairs], "s double, e double, u double, v double")
    c = F.col
    rows = df.select("*", *[relation(n, (c("s"), c("e")), (c("u"), c("v"))).alias(n) for n in RELATIONS], *[axis_relation(n, "y", {"left": c("s"), "right": c("s"), "bottom": c("e"), "top": c("s")}, {"left": c("s"), "right": c("s"), "bottom": c("v"), "top": c("u")}).alias("y_" + n) for n in RELATIONS]).collect()
    many = 0
    for r in rows:
        mine = [r[n] for n in RELATIONS]
        assert mine == [holds(n, (r.s, r.e), (r.u, r.v)) for n in RELATIONS]
        assert [r["y_" + n] for n in RELATIONS] == [holds(n, (r.e, r.s), (r.v, r.u), lambda x, y: x > y) for n in RELATIONS]
        assert any(mine)
        many += sum(mine) > 1
    assert len(rows) == 3025 and many == 2153
    sizes = {n: len({(x, y) for xs, ys in rects for x in xs for y in ys}) for n, rects in REGIONS.items()}
    assert list(sizes.values()) == [65, 52, 52, 52, 25, 20, 20, 16, 81, 105, 52, 52, 52, 52]
    rng = random.Random(2)
    boxes = [(*sorted(rng.sample(range(30), 2)), *sorted(rng.sample(range(30), 2)), *sorted(rng.sample(range(30), 2)), *sorted(rng.sample(range(30), 2))) for _ in range(300)]
    names = [p + s for p in "ab" for s in ("left", "right", "top", "bottom")]
    bd = spark.createDataFrame([tuple(map(float, b)) for b in boxes], ", ".join(f"{n} double" for n in names))
    side = lambda p: {s: c(p + s) for s in ("left", "right", "top", "bottom")}
    for r in bd.select("*", *[region(n, side("a"), side("b")).alias(n) for n in REGIONS]).collect():
        for n, rects in REGIONS.items():
            want = any(any(holds(x, (r.aleft, r.aright), (r.bleft, r.bright)) for x in xs) and any(holds(y, (r.abottom, r.atop), (r.bbottom, r.btop), lambda p, q: p > q) for y in ys) for xs, ys in rects)
            assert r[n] == want, n


def test_magnitude_against_loops(spark):
    """Random paths: marked frames by plain loops over tweens and frames."""
    rng = random.Random(4)
    steps, rows, tweens, want = 20, [], [], set()
    for obj in range(12):
        x = [round(rng.uniform(0, 6), 1) for _ in range(steps + 1)]
        kinds = [rng.choice([0, 1, 1, 2]) for _ in range(steps + 1)]
        rows += [("s", obj, f, kinds[f], x[f], 0.0, x[f], 1.0, 1.0) for f in range(steps + 1)]
        for k, (start, end) in enumerate([(0.0, 6.5), (7.2, 12.0), (13.0, 20.0)]):
            tweens.append(("s", obj, k, start, end))
            sf, ef = int(start), -int(-end // 1)
            hits = [i for i in range(sf, min(ef + 1, steps + 1)) if kinds[i] & 1 and abs(abs(x[i] - x[sf]) - 2.0) <= 0.1 + 2e-5]
            if hits:
                want |= {(obj, f) for f in range(sf, max(hits))}
    frames = spark.createDataFrame(rows, "scene_id string, obj_idx int, frame int, types int, tx_acc double, ty_acc double, rot_acc double, sx_acc double, sy_acc double")
    tw = spark.createDataFrame(tweens, "scene_id string, obj_idx int, tween_idx int, start double, end double")
    got = motion.magnitude(frames, tw, spark.createDataFrame([("s", steps)], "scene_id string, steps int"), 1, 2.0).collect()
    assert {(r.obj_idx, r.frame) for r in got} == want


def test_types():
    assert parse_types("~translate") == 6 and parse_types("rotate|scale & any") == 6 and parse_types("none") == 0
    with pytest.raises(ValueError):
        parse_types("spin")


def test_texts(spark):
    r = spark.range(1).select(tx.clean_commas(F.lit("a , ,b .")).alias("c"), tx.join_sentences(F.lit("Move it."), F.lit("then"), F.lit("Turn it."), F.lit(True)).alias("j"), tx.code_block(F.lit("x```\na=1\n```y")).alias("b"), tx.code_block(F.lit("x```y")).alias("n"), tx.format_number(F.lit(3.0)).alias("f"), tx.px_length(F.lit("12.5px")).alias("p"), tx.px_length(F.lit("50%")).alias("q"), tx.synonyms_in(F.lit("Move it, now. all at once"), ["it", "at once", "mov"]).alias("s")).first()
    assert (r.c, r.j, r.b, r.n, r.f, r.p, r.q, r.s) == ("a,b.", "Move it. Then, turn it.", "a=1", None, "3", 12.5, None, ["it", "at once"])


def test_program_generation():
    blue = {"shape": "circle", "fill": "blue"}
    text = program_text.program([{"type": "translate", "agents": [blue], "direction": [0.0, 1.0], "magnitude": 100.0}, {"relation": "before", "type": "rotate", "agents": [blue], "direction": -1.0, "magnitude": 90.0, "duration": 1.0}])
    assert text == """o_1 = iota(Object, lambda o: color(o, "blue") and shape(o, "circle"))

m_1 = iota(Motion, lambda m: type(m, "translate") and direction(m, [0.0, 1.0]) and magnitude(m, 100.0) and agent(m, o_1))
m_2 = iota(Motion, lambda m: type(m, "rotate") and direction(m, "counterclockwise") and magnitude(m, 90.0) and duration(m, 1.0) and agent(m, o_1))

t_before(m_1, m_2)"""
    assert len(parse(text).statements) == 4


def test_generators(spark):
    assert generate.modifier_orders(spark).count() == 120
    assert generate.splits(spark.createDataFrame([(["a", "b", "c"],)], "w array<string>"), "w").count() == 10
    motions = spark.createDataFrame([("g", 0, [("circle", "blue")], None), ("g", 1, [("square", "red"), ("circle", "blue")], [("square", "black")])], "graph_id string, motion_idx int, agents array<struct<shape:string,fill:string>>, post_reference array<struct<shape:string,fill:string>>")
    assert [(r.obj, r.fill) for r in generate.agent_rows(motions).orderBy("obj").collect()] == [(1, "blue"), (2, "red"), (3, "black")]


def test_statistics(spark):
    rows = [("r1", 1, False, True, False), ("r2", 3, False, True, False), ("r3", 2, False, True, False), ("r4", 5, False, False, True), ("r5", None, True, False, False), ("r6", 1, False, True, False)]
    r = analytics.pass_rates(spark.createDataFrame(rows, "run string, turns long, has_error boolean, has_success boolean, has_fail boolean").withColumn("c", F.lit(1)), ["c"]).first()
    assert (r.n_error, r.n_total, r.pass_0, r.pass_0_pct, r.pass_1plus, r.n_fail, r.avg_iter, r.min_iter, r.max_iter) == (1, 5, 2, 40.0, 2, 1, 2.5, 2, 3)


def test_point_query(spark):
    at = spark.createDataFrame([("c", k / 2400, 25 + 100 * min(1.0, k / 24), 25.0) for k in range(30)], "id string, time double, x double, y double")
    hits = analytics.near_point(at, spark.createDataFrame([("c", 0, 125.0, 25.0)], "id string, target int, x double, y double"), 0.01, ["id"])
    best = analytics.best_match(hits, ["id"]).first()
    assert abs(best.time - 0.01) < 1e-6 and best.error <= 0.01


def test_scene_json_round_trip(spark, tmp_path):
    n = 3
    doc = {"info": {"duration": 1.0, "fps": 2.0, "steps": 2, "scene-size": {"width": 20, "height": 20}, "objects": [{"id": "b", "shape": "square", "fill": "black", "size": [5, 5]}]}, "b": {"tweens": [{"type": "translate", "duration": 1.0, "start": 0, "end": 2}], "translateX_acc": [0, 5, 10], "translateY_acc": [0, 0, 0], "rotate_acc": [0] * n, "scaleX_acc": [1] * n, "scaleY_acc": [1] * n, "skewX_acc": [0] * n, "skewY_acc": [0] * n, "AABB": [{"top": 0, "left": x, "bottom": 5, "right": x + 5, "width": 5, "height": 5} for x in (0, 5, 10)], "transformedPts": [[[x, 0], [x + 5, 0], [x + 5, 5], [x, 5]] for x in (0, 5, 10)], "wldOrigin": [[x + 2.5, 2.5] for x in (0, 5, 10)]}}
    (tmp_path / "one_data.json").write_text(json.dumps(doc))
    s = sc.read_scene_json(spark, str(tmp_path / "*.json"))
    program = 'o_1 = iota(Object, lambda o: color(o, "black"))\nexists(Motion, lambda m: type(m, "translate") and direction(m, [1, 0]) and magnitude(m, 10) and agent(m, o_1))\nexists(Motion, lambda m: type(m, "translate") and origin(m, get_pos(o_1)))'
    assert [r.result for r in evaluate(program, s).where("node_idx = 0").orderBy("stmt_idx").collect()] == [True, True, False]
    sc.write_scenes(s, f"file://{tmp_path}/out")
    assert sc.read_scenes(spark, f"file://{tmp_path}/out").frames.count() == n


def test_stream_runs(spark, tmp_path):
    from frameloom.streaming.runs import stream_runs

    rows = [(1, f"2024-01-01 {h:02d}:{m:02d}:00") for h, m in ((0, 0), (0, 30), (3, 0), (9, 0))]
    spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = stream_runs(spark.readStream.schema("user_id int, ts timestamp").parquet(f"{tmp_path}/in"), ["user_id"])
    q = stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from bursts").collect()) == [1, 2]


def test_object_list_and_keys(spark):
    el = spark.createDataFrame([("s", 0, "still", "rect", 2.0, 3.0, 0.0, "Red", False), ("s", 1, "custom-star-gold", "path", 0.0, 0.0, 0.0, "x", True), ("s", 2, "letter-H", "path", 0.0, 0.0, 0.0, None, True), ("s", 3, "ignore-me", "rect", 1.0, 1.0, 0.0, "a", True), ("s", 4, "c", "circle", 0.0, 0.0, 4.0, "Blue", False)], "scene_id string, doc_idx int, obj_id string, tag string, width double, height double, r double, fill string, animated boolean")
    rows = [(r.obj_id, r.shape, r.fill, r.size) for r in sc.object_list(el).orderBy("obj_idx").collect()]
    assert rows == [("custom-star-gold", "star", "gold", None), ("letter-H", "H", None, None), ("still", "rectangle", "red", [2.0, 3.0]), ("c", "circle", "blue", [8.0, 8.0])]
    keys = sc.surrogate_keys(spark.createDataFrame([("", 1), ("a", 2), ("b", 3), ("b", 4)], "id string, path int").withColumn("s", F.lit(0)), "id", "path", ["s"])
    assert [r.key for r in keys.orderBy("path").collect()] == ["__el_1", "a", "__el_3", "__el_4"]


def test_de_morgan_and_subset(spark):
    s = scene(spark, [tween("black-square", 0, "translate", 0.0, 1.0, 50.0)], 1.0)
    a, b = 'color(o, "black")', 'shape(o, "square")'
    for left, right in itertools.combinations([f"not ({a} and {b})", f"(not {a}) or (not {b})"], 2):
        from frameloom.plans.compiler import Evaluation

        sets = []
        for body in (left, right):
            e = Evaluation(parse(f"o_1 = all(Object, lambda o: {body})\no_2 = iota(Object, lambda o: {body})"), s)
            e.run()
            sets.append({r.obj_idx for r in e.vars["o_1"].collect()})
            assert {r.obj_idx for r in e.vars["o_2"].collect()} <= sets[-1]
        assert sets[0] == sets[1]
