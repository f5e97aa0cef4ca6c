"""Tables of programs against the evaluation of each program by itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_engine import PROGRAM, scene, tween

from frameloom.plans import program_tables
from frameloom.plans.compiler import evaluate
from frameloom.plans.normal_form import normal_form
from frameloom.plans.program_tables import evaluate_programs

BASE = 'o_1 = iota(Object, lambda o: color(o, "black") and shape(o, "square"))\no_2 = iota(Object, lambda o: shape(o, "square") and not o_1)\n'
MOVE = 'm_1 = iota(Motion, lambda m: type(m, "translate") and direction(m, [1.0, 0.0]) and agent(m, o_1))\nm_2 = iota(Motion, lambda m: type(m, "translate") and agent(m, o_2))\n'
PROGRAMS = [
    PROGRAM,
    BASE + MOVE + 'm_3 = iota(Motion, lambda m: type(m, "translate") and direction(m, [1.0, 0.0]) and agent(m, o_1) and not m_1)\nt_before(m_1, m_3)\nt_after(m_3, m_1)\nt_while(m_1, m_2)\nprecedes(m_1, m_3) and not meets(m_1, m_2)\nnot precedes(m_1, m_3)',
    BASE + 's_top(o_1, o_2)\ns_bottom(o_1, o_2)\ns_precedes(o_1, o_2, "y")\ns_overlaps(o_1, o_2, "x") or s_border(o_2, o_1)',
    'o_1 = iota(Object, lambda o: color(o, "pink"))\no_2 = iota(Object, lambda o: shape(o, "square"))\nexists(Motion, lambda m: type(m, "any") and agent(m, o_1))\ns_top(o_1, o_2)\nforall(Object, lambda o: color(o, "black"))\nexists(Object, lambda o: id(o, "black-circle"))',
    BASE + MOVE + 'exists(Motion, lambda m: type(m, "translate") and agent(m, get_agent(m_1)) and post(m, s_top(o_1, o_2)))\nexists(Motion, lambda m: type(m, get_type(m_1)) and direction(m, get_direction(m_1)) or post(m, s_left(o_1, o_2)))',
    'exists(Motion, lambda m: type(m, "translate") and origin(m, ["50%", "50%"]))\nexists(Motion, lambda m: type(m, "rotate") and (origin(m, [200.0, 200.0]) or not origin(m, [225.0, 93.0])))',
    'forall(Motion, lambda m: type(m, "translate"))\nforall(Motion, lambda m: type(m, "any") or not type(m, "rotate"))\nforall(Motion, lambda m: not type(m, "any"))\nforall(Object, lambda o: shape(o, "square") or shape(o, "circle"))',
    'exists(Motion, lambda m: type(m, "rotate") and direction(m, "clockwise") and magnitude(m, 90.0))\nexists(Motion, lambda m: type(m, "scale") and magnitude(m, [2.0, 0.0]) and direction(m, [1.0, 1.0]))\nexists(Motion, lambda m: type(m, "rotate|scale") and duration(m, 1.0))\nexists(Motion, lambda m: type(m, "rotate") and direction(m, "counterclockwise"))',
    BASE + 'o_3 = all(Object, lambda o: color(o, get_color(o_1)) and not o_1)\no_4 = iota(Object, lambda o: shape(o, get_shape(o_2)) or id(o, get_id(o_1)))\nexists(Motion, lambda m: type(m, "any") and agent(m, o_3))\nexists(Motion, lambda m: type(m, "any") and origin(m, get_pos(o_1)))',
    'm_1 = iota(Motion, lambda m: type(m, "translate"))\nm_2 = iota(Motion, lambda m: type(m, "translate") and not m_1)\nm_3 = iota(Motion, lambda m: m_2 or type(m, "rotate"))\nt_while(m_1, m_3)\nequals(m_1, m_1)',
    'exists(Object, lambda o: color(o, "a") or color(o, "b") or color(o, "c") or color(o, "d") or color(o, "e") or color(o, "f") or color(o, "g") and not shape(o, "circle"))',
]
REJECTED = ['exists(Motion, lambda m: jump(m, "x"))', "x = 3", "", 'exists(Motion, lambda m: type(m, "translate") and origin(m, get_size(o_9)))']


def tables(spark):
    moves = {
        "a": [tween("black-square", 0, "translate", 0.0, 1.0, 50.0), tween("black-square", 1, "rotate", 1.0, 1.0, rot=90.0), tween("black-square", 2, "translate", 2.0, 1.0, 50.0, scene="a"), tween("blue-square", 0, "translate", 0.0, 2.0, 0.0, -50.0)],
        "b": [tween("black-square", 0, "translate", 0.0, 2.0, 100.0), tween("blue-circle", 0, "scale", 0.5, 1.0, sx=2.0, sy=2.0), tween("blue-square", 0, "other", 1.0, 1.0, -20.0, 300.0, -45.0)],
        "c": [tween(o, 0, "translate", 0.0, 3.0, 30.0) for o in ("black-square", "black-circle", "blue-square", "blue-circle")],
        "still": [],
    }
    plan = [(k, *t[1:]) for k, ts in moves.items() for t in ts]
    found = scene(spark, plan, 3.0, 10.0, tuple(moves))
    for name in ("scenes", "objects", "tweens", "frames"):
        setattr(found, name, getattr(found, name).cache())
    return found


@pytest.fixture(scope="module")
def scenes(spark):
    return tables(spark)


def test_programs_equal_single_evaluation(spark, scenes):
    """Every program on every scene, and reports row by row."""
    programs = spark.createDataFrame(list(enumerate(PROGRAMS)), "program_id int, text string")
    everywhere = programs.select("program_id", F.explode(F.array(*map(F.lit, ("a", "b", "c", "still", "unknown")))).alias("scene_id"))
    got = {}
    for r in evaluate_programs(programs, everywhere, scenes).collect():
        got.setdefault(r.program_id, set()).add((r.scene_id, r.stmt_idx, r.node_idx, r.tag, r.result, r.status))
    for i, text in enumerate(PROGRAMS):
        want = {(r.scene_id, r.stmt_idx, r.node_idx, r.tag, r.result, r.status) for r in evaluate(text, scenes).collect()}
        assert got[i] == want, text
    assert len({x[4] for rows in got.values() for x in rows}) == 2


def test_rejected_and_unassigned(spark, scenes):
    rows = [(f"r{i}", t) for i, t in enumerate(REJECTED)] + [("fine", PROGRAM), ("nowhere", PROGRAM), (None, PROGRAM)]
    programs = spark.createDataFrame(rows, "id string, code string")
    assigned = spark.createDataFrame([(i, "a") for i, _ in rows if i != "nowhere"], "program_id string, scene_id string")
    out = evaluate_programs(programs, assigned, scenes, "id", "code").collect()
    assert {r.program_id: r.status for r in out if r.stmt_idx == -1} == {"r0": "rejected", "r1": "rejected", "r3": "rejected"}
    assert {r.program_id for r in out} == {"r0", "r1", "r3", "fine"}


def test_equal_predicates_have_one_unit():
    """Names, the order of conjuncts and repetitions don't matter; what they stand for does."""
    a = normal_form('o_1 = iota(Object, lambda o: color(o, "red") and shape(o, "square"))\nexists(Motion, lambda m: type(m, "any") and agent(m, o_1))')
    b = normal_form('x = iota(Object, lambda q: shape(q, "square") and color(q, "red") and color(q, "red"))\nexists(Motion, lambda m: agent(m, x) and type(m, "any"))')
    c = normal_form('x = iota(Object, lambda q: shape(q, "square") or color(q, "red"))\nexists(Motion, lambda m: agent(m, x) and type(m, "any"))')
    keys = lambda f: {u["unit"] for u in f["units"]}
    assert keys(a) == keys(b) and len(keys(a)) == 2 and not keys(a) & keys(c)
    assert [n["tag"] for n in b["nodes"]][1:4] == ["shape", "color", "color"]


def test_plans_do_not_grow_with_programs(spark, scenes, monkeypatch):
    """Ten times the programs: as many tables are written, and the units of equal predicates are evaluated once."""
    seen = []
    keep = program_tables.Scratch

    class Counting(keep):
        def write(self, df, name):
            out = super().write(df, name)
            seen[-1].append((name, df._jdf.queryExecution().analyzed().treeString().count("\n")))
            if name == "units":
                units.append(out.count())
            return out

    monkeypatch.setattr(program_tables, "Scratch", Counting)
    units: list[int] = []
    for copies in (1, 10):
        seen.append([])
        programs = spark.createDataFrame([(i, PROGRAMS[1].replace("m_3", f"late_{i}")) for i in range(copies)], "program_id int, text string")
        evaluate_programs(programs, programs.select("program_id", F.lit("a").alias("scene_id")), scenes)
    assert seen[0] == seen[1] and units[0] == units[1]


def test_frames_are_read_once(spark, scenes):
    """Independent statements share one folding of the frames."""
    flat = program_tables.stretches(scenes.frames)
    assert flat.count() < scenes.frames.count() / 3
    assert flat.agg(F.sum(F.col("e") - F.col("s") + 1)).first()[0] == scenes.frames.where("frame < steps").count()
