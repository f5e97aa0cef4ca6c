"""Documents, program text, composition and interval merging against plain Python."""

from __future__ import annotations

import itertools
import json
import re
import random

import program_text
import pytest
from pyspark.sql import functions as F

from frameloom.operators import analytics, compose, generate, runs
from frameloom.plans import compiler
from frameloom.sources import records
from frameloom.sources import scenes as sc
from test_engine import scene, tween


def test_scene_documents_round_trip(spark, tmp_path):
    made = scene(spark, [tween("black-square", 0, "translate", 0.0, 0.5, 40.0), tween("blue-circle", 0, "rotate", 0.25, 0.5, rot=90.0, scene="t")], 1.0, 4.0, ids=("s", "t"))
    path = f"file://{tmp_path}/out"
    records.write_documents(records.data_documents(made), path, "data")
    again = sc.from_documents(records.read_documents(spark, path, "data"))
    columns = ["scene_id", "obj_id", "frame", "tx_acc", "rot_acc", "left", "bottom", "p2x", "wld_y", "types", "dir_rot"]
    rows = lambda t: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.frames.select(*columns).fillna({"dir_rot": 9}).collect())
    assert rows(again) == rows(made) and len(rows(made)) == 2 * 4 * 5
    assert sorted(tuple(r) for r in again.tweens.select("scene_id", "obj_id", "type", "start", "end").collect()) == sorted(tuple(r) for r in made.tweens.select("scene_id", "obj_id", "type", "start", "end").collect())
    program = 'o_1 = iota(Object, lambda o: color(o, "black"))\nexists(Motion, lambda m: type(m, "translate") and agent(m, o_1))'
    results = lambda t: sorted(tuple(r) for r in compiler.evaluate(program, t).collect())
    assert results(again) == results(made)
    with pytest.raises(ValueError):
        records.write_documents(records.data_documents(made), path, "other")


def test_other_documents(spark, tmp_path):
    made = scene(spark, [tween("black-square", 0, "translate", 0.0, 0.5, 40.0), tween("black-square", 1, "rotate", 0.25, 0.5, rot=90.0)], 1.0, 4.0)
    keyed = records.keyframe_values(sc.keyframe_times(made.tweens, ["scene_id", "obj_idx"]), made.frames, made.scenes, ["tx_acc", "rot_acc"])
    doc = json.loads(records.keyframe_documents(keyed, made.objects, ["tx_acc", "rot_acc"]).first().value)
    assert doc["black-square"]["translate"] == {"time": [0.0, 2.0], "tx_acc": [0.0, 40.0], "rot_acc": [0.0, 45.0]}
    assert doc["black-square"]["rotate"] == {"time": [1.0, 3.0], "tx_acc": [20.0, 40.0], "rot_acc": [0.0, 90.0]}
    rendered = json.loads(records.rendered_documents(sc.property_series(made.frames, ["tx_acc"]), made.objects).first().value)
    assert rendered["black-square"]["tx_acc"] == ["0.0", "20.0", "40.0", "40.0", "40.0"]
    props = spark.createDataFrame([("s", 'quo"te', ["a", "b"])], "scene_id string, obj_id string, props array<string>")
    assert json.loads(records.property_documents(props).first().value) == {'quo"te': ["a", "b"]}


def test_dataset_log_and_config(spark, tmp_path):
    entries = spark.createDataFrame([(2, "b"), (1, None)], "id int, prompt string")
    records.write_dataset(entries, f"file://{tmp_path}/set", ["id"])
    assert [tuple(r) for r in records.read_dataset_lines(spark, f"file://{tmp_path}/set", "id int, prompt string").collect()] == [(1, None), (2, "b")]
    (tmp_path / "list.json").write_text('[{"id": 1, "prompt": null},\n {"id": 2, "prompt": "b"}]')
    assert [tuple(r) for r in records.read_dataset(spark, f"file://{tmp_path}/list.json", "id int, prompt string").collect()] == [(1, None), (2, "b")]
    many = spark.range(500).selectExpr("id", "concat('p,', id, ']\\n') as prompt").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    records.write_dataset(many, f"file://{tmp_path}/parts", ["id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("parts/part-*"))
    whole = json.loads("".join(f.read_text() for f in files))
    assert len(files) > 1 and [x["id"] for x in whole] == list(range(500)) and whole[7]["prompt"] == "p,7]\n"
    again = records.read_dataset_lines(spark, f"file://{tmp_path}/parts", "id bigint, prompt string")
    assert sorted(map(tuple, again.collect())) == [(x["id"], x["prompt"]) for x in whole]
    records.write_dataset(many.limit(0), f"file://{tmp_path}/none", ["id"])
    assert json.loads("".join(f.read_text() for f in tmp_path.glob("none/part-*"))) == [] and records.read_dataset_lines(spark, f"file://{tmp_path}/none", "id int").count() == 0
    rows = [("r", "chat", 0, "user", "x"), ("r", "chat", 1, "assistant", "y"), ("r", "success", 2, None, ""), ("q", "fail", 0, None, "")]
    for row in rows:
        records.append_log(spark.createDataFrame([row], "run string, kind string, seq int, role string, text string"), f"file://{tmp_path}/log")
    got = {r.run: (r.turns, r.has_error, r.has_success, r.has_fail) for r in analytics.log_runs(spark.read.parquet(f"file://{tmp_path}/log")).collect()}
    assert got == {"r": (1, False, True, False), "q": (None, True, False, True)}
    text = "# a run\nname: 'x y'\nrounds: 50\nrate: 0.5\nmodel:\n  kind: local  # here\n  on: true\nlast: null\n"
    assert records.read_config(text, ["name", "model"]) == {"name": "x y", "rounds": 50, "rate": 0.5, "model": {"kind": "local", "on": True}, "last": None}
    with pytest.raises(ValueError, match="missing: other"):
        records.read_config(text, ["name", "other"])
    with pytest.raises(ValueError, match="line 1"):
        records.read_config("no colon", [])


def test_program_text_as_columns(spark):
    rng = random.Random(3)
    things = [{"shape": s, "fill": f} for s in ("circle", "square") for f in ("red", "blue")]
    graphs = []
    for _ in range(25):
        motions = []
        for i in range(rng.randint(1, 4)):
            m = {"type": rng.choice(["translate", "scale"]), "agents": [rng.choice(things)]}
            if i and rng.random() < 0.6:
                m["relation"] = rng.choice(["before", "after", "overlaps"])
            for key, value in (("direction", [0.0, 1.0]), ("magnitude", 100.0), ("origin", ["50%", "50%"]), ("duration", 2.0)):
                if rng.random() < 0.5:
                    m[key] = value
            if rng.random() < 0.4:
                m |= {"post": "bordering", "post_reference": [rng.choice(things)]}
            motions.append(m)
        graphs.append(motions)
    pair = lambda xs: [(x["shape"], x["fill"]) for x in xs] if xs else None
    text = lambda v: None if v is None else program_text.literal(v)
    rows = [(g, i, m["type"], *[text(m.get(k)) for k in ("direction", "magnitude", "origin", "duration")], pair(m["agents"]), m.get("post"), pair(m.get("post_reference")), m.get("relation")) for g, ms in enumerate(graphs) for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "graph_id int, motion_idx int, type string, direction string, magnitude string, origin string, duration string, agents array<struct<shape:string,fill:string>>, post string, post_reference array<struct<shape:string,fill:string>>, relation string")
    got = {r.graph_id: r.program for r in generate.programs(df).collect()}
    assert got == {g: program_text.program(ms) for g, ms in enumerate(graphs)}
    order = got[next(g for g, ms in enumerate(graphs) if any(m.get("post") and m.get("duration") for m in ms))]
    line = next(x for x in order.split("\n") if "post(" in x and "duration(" in x)
    assert line.index("post(") < line.index("duration(") < line.index("agent(")


def test_merged_intervals(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), s, s + rng.randint(-1, 9)) for s in (rng.randrange(80) for _ in range(120))]
    df = spark.createDataFrame(rows, "k int, s int, e int")
    one = sorted(tuple(r) for r in runs.merged(df, ["k"]).collect())
    assert one == sorted(tuple(r) for r in runs.runs(runs.covered(df, ["k"]), ["k"]).collect())


def test_slot_product(spark):
    rows = [(1, [["a", "b"], [None], ["x", "y", "z"]]), (2, [["a"], []]), (3, [[str(i) for i in range(30)]] * 3)]
    df = spark.createDataFrame(rows, "id int, slots array<array<string>>")
    got = compose.slot_product(df, "slots", ["id"], 100).collect()
    assert {tuple(r.choice) for r in got if r.id == 1} == set(itertools.product(["a", "b"], [None], ["x", "y", "z"]))
    assert not [r for r in got if r.id == 2]
    assert len({tuple(r.choice) for r in got if r.id == 3}) == 100


def test_language_extensions(spark):
    made = scene(spark, [tween("black-square", 0, "translate", 0.0, 0.5, 40.0), tween("blue-circle", 0, "rotate", 0.25, 0.5, rot=90.0)], 1.0, 4.0)
    counted = lambda text: compiler.count(text, made).first().n
    assert counted('count(Object, lambda o: color(o, "black"))') == 2 and counted('count(Motion, lambda m: type(m, "translate|rotate"))') == 2 and counted('count(Object, lambda o: color(o, "green"))') == 0
    with pytest.raises(ValueError):
        compiler.count('exists(Object, lambda o: color(o, "black"))', made)
    compiler.register_predicate("rightmost_of", "Motion", lambda x: F.col("right") >= float(x))
    text = 'm_1 = iota(Motion, lambda m: type(m, "translate") and rightmost_of(m, 230))'
    want = {(r.obj_idx, r.frame) for r in made.frames.where("frame < steps and (types & 1) <> 0 and right >= 230").collect()}
    held = compiler.trace(text, made).where("node_idx = 0 and result")
    assert {(r.obj_idx, r.frame) for r in held.collect()} == want and want
    with pytest.raises(ValueError):
        compiler.register_predicate("not a name", "Motion", lambda x: x)


def test_plans(spark, monkeypatch):
    """Temporal relations don't meet the pairs of a scene, independent statements read the frames once, and merging needs one shuffle."""
    made = scene(spark, [tween("black-square", 0, "translate", 0.0, 0.5, 40.0)], 1.0, 4.0)
    text = 'm_1 = iota(Motion, lambda m: type(m, "translate"))\nm_2 = iota(Motion, lambda m: type(m, "rotate"))\nprecedes(m_1, m_2)'
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    temporal = plan(compiler.evaluate(text, made))
    assert "NestedLoop" not in temporal and "min(e" in temporal and "max(s" in temporal
    read = []
    monkeypatch.setattr(compiler, "stretches", lambda frames: read.append(frames) or runs.stretches(frames))
    program_queries = __import__("frameloom.plans.program_queries", fromlist=["EXISTENCE"])
    report = compiler.evaluate(program_queries.EXISTENCE, made)
    assert len(read) == 1 and plan(report).count("stretches-") <= 2 and plan(report).count("Aggregate [scene_id") <= 4
    merged = runs.merged(spark.range(10).selectExpr("id % 3 as k", "id as s", "id + 1 as e"), ["k"])
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_bundles(spark, tmp_path, monkeypatch):
    """Files follow the bytes of documents; a reader opens only the bundles of the scenes that it asks for."""
    path = f"file://{tmp_path}/sink"
    docs = spark.range(300).selectExpr("lpad(id, 3, '0') as scene_id", "repeat('x', 90 + cast(id % 7 as int)) as value").repartition(5)
    records.write_documents(docs, path, "data", 3000)
    first = {r.scene_id: r.bundle for r in spark.read.parquet(f"{path}/index/kind=data").collect()}
    files = list(tmp_path.glob("sink/bundles/kind=data/bundle=*/*.parquet"))
    assert len(files) == len(set(first.values())) == 10
    assert sorted(map(tuple, records.read_documents(spark, path, "data").collect())) == sorted(map(tuple, docs.collect()))
    some = spark.createDataFrame([("005",), ("006",), ("none",), ("005",)], "scene_id string")
    found = records.read_documents(spark, path, "data", some)
    assert sorted(r.scene_id for r in found.collect()) == ["005", "006"]
    assert {first["005"], first["006"]} == {0} and re.search(r"PartitionFilters: \[[^\]]*bundle", found._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(records, "FEW_BUNDLES", 0)
    assert sorted(r.scene_id for r in records.read_documents(spark, path, "data", some).collect()) == ["005", "006"]
    records.write_documents(docs.coalesce(1), path, "data", 3000)  # again, dealt otherwise: the same bundles
    assert {r.scene_id: r.bundle for r in spark.read.parquet(f"{path}/index/kind=data").collect()} == first
    records.write_documents(docs.limit(0), path, "properties")
    assert spark.read.parquet(f"{path}/index/kind=properties").count() == 0
    with pytest.raises(ValueError):
        records.write_documents(docs, path, "other")


def test_programs_meet_once(spark):
    """One shuffle, by graph; a graph's objects are numbered by their first mention, and motions of no object, with nulls or of graphs without objects have the text they had."""
    box, ball = ("square", "red"), ("circle", None)
    rows = [
        (1, 0, "translate", None, [ball, box], None, None, None), (1, 1, "scale", "2.0", [box], "bordering", [ball], "before"), (1, 2, "rotate", None, None, "bordering", [box], None),
        (2, 0, "scale", None, None, None, None, None), (None, 0, "scale", None, [box], None, None, None),
    ]
    pair = "array<struct<shape:string,fill:string>>"
    df = spark.createDataFrame(rows, f"graph_id int, motion_idx int, type string, duration string, agents {pair}, post string, post_reference {pair}, relation string").selectExpr("*", "null direction", "null magnitude", "null origin")
    df = df.withColumns({c: F.col(c).cast("string") for c in ("direction", "magnitude", "origin")})
    out = generate.programs(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r.graph_id: r.program for r in out.collect()} == {1: "\n".join([
        'o_1 = iota(Object, lambda o: shape(o, "circle"))', 'o_2 = iota(Object, lambda o: color(o, "red") and shape(o, "square"))', "",
        'm_1 = iota(Motion, lambda m: type(m, "translate") and agent(m, o_1))', 'm_2 = iota(Motion, lambda m: type(m, "scale") and post(m, s_border(o_2, o_1)) and duration(m, 2.0) and agent(m, o_2))',
        'exists(Motion, lambda m_3: type(m_3, "rotate"))', "", "t_before(m_1, m_2)",
    ])}
