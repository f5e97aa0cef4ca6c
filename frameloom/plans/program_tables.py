"""Many programs over many scenes at once: a table of programs, a table that says which scenes each runs on.

Programs become data in the executors (:mod:`frameloom.plans.normal_form`). What they ask is evaluated by unit and scene, each once however many programs ask it: units of a level read
variables of lower levels only, so levels are evaluated one after the other, each by the same few joins; a plan grows with the depth of the deepest program, not with their number. Frames are read once, folded to
stretches of equal state; from there on, conditions over frames are sets of intervals that a boundary sweep combines. Reports are joined back by program, scene and statement.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.allen import RELATIONS, is_close, relation
from frameloom.functions.geometry import CONE
from frameloom.operators import intervals
from frameloom.operators.motion import has_type
from frameloom.operators.runs import first_runs, merged, runs, stretches
from frameloom.plans.compiler import color_is
from frameloom.plans.normal_form import SCHEMA, normal_form
from frameloom.scratch import Scratch, written
from frameloom.sources.scenes import Scenes

KEYS = ["scene_id", "obj_idx"]
SIDES = ("left", "right", "top", "bottom")
_C = F.col


def parsed(programs: DataFrame, id_col: str = "program_id", text_col: str = "text") -> DataFrame:
    """``program_id`` and the columns of ``normal_form.SCHEMA`` of each program; parsing is a small step of each row, in the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    table = programs.select(_C(id_col).alias("program_id"), _C(text_col).cast("string").alias("text"))
    kind = table.schema["program_id"].dataType.simpleString()
    names = f"program_id {kind}, {SCHEMA}"
    arrow = to_arrow_schema(programs.sparkSession.createDataFrame([], names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"program_id": i} | normal_form(t or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return table.mapInArrow(run, names)


def looked_up(words: Column, place: Column) -> Column:
    """The bit of a truth table at a place."""
    word = F.get(words, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _bit(of: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), of)


def directed() -> Column:
    """Whether a stretch moves in the direction of a predicate (``mask, text, x, y``)."""
    length = F.sqrt(_C("x") * _C("x") + _C("y") * _C("y"))
    cone = (_C("dir_tx") * _C("x") + _C("dir_ty") * _C("y")) / length > CONE
    turn = _C("dir_rot") == F.when(_C("text") == "clockwise", 1).otherwise(-1)
    axis = lambda c, t: (_C(t) == 0) | F.coalesce(_C(c) == F.signum(_C(t)).cast("int"), F.lit(False))
    parts = ((1, _C("x").isNotNull() & cone), (2, turn), (4, _C("x").isNotNull() & axis("dir_sx", "x") & axis("dir_sy", "y")))
    return reduce(lambda a, b: a | b, [(_C("mask").bitwiseAND(F.lit(k)) != 0) & has_type(k, _C("types")) & F.coalesce(held, F.lit(False)) for k, held in parts])


def _spans(t: Scenes) -> DataFrame:
    """Tweens with the number of their scene's steps."""
    return t.tweens.join(t.scenes.select("scene_id", "steps"), "scene_id")


def _durations(t: Scenes, asked: DataFrame) -> DataFrame:
    """``pred, scene_id, obj_idx, s, e`` of duration predicates: tweens of one of the types that last so long."""
    kind = F.when(_C("type") == "translate", 1).when(_C("type") == "rotate", 2).when(_C("type") == "scale", 4).otherwise(0)
    rows = _spans(t).join(asked, "scene_id").where((kind.bitwiseAND(_C("mask")) != 0) & is_close(_C("duration"), _C("x")))
    return rows.select("pred", *KEYS, F.floor("start").alias("s"), (F.least(F.ceil("end") + 1, _C("steps")) - 1).alias("e"))


def _magnitudes(t: Scenes, asked: DataFrame) -> DataFrame:
    """The same of magnitude predicates; a tween's changes are computed once for all of them."""
    acc = ("tx_acc", "ty_acc", "rot_acc", "sx_acc", "sy_acc")
    spans = _spans(t).select(*KEYS, "tween_idx", F.floor("start").cast("int").alias("sf"), F.least(F.ceil("end").cast("int"), _C("steps")).alias("last"), "steps")
    base = t.frames.select(*KEYS, _C("frame").alias("sf"), *[_C(c).alias("b_" + c) for c in acc])
    own = spans.join(base, [*KEYS, "sf"]).where("sf <= last").withColumn("frame", F.explode(F.sequence("sf", "last")))
    rows = own.join(t.frames.select(*KEYS, "frame", "types", *acc), [*KEYS, "frame"])
    d = lambda c: _C(c + "_acc") - _C(f"b_{c}_acc")
    ratio = lambda c: F.try_divide(_C(c + "_acc"), _C(f"b_{c}_acc"))
    rows = rows.select(*KEYS, "tween_idx", "sf", "frame", "steps", "types", F.sqrt(d("tx") ** 2 + d("ty") ** 2).alias("moved"), F.abs(d("rot")).alias("turned"), ratio("sx").alias("rx"), ratio("sy").alias("ry"))
    rows = rows.join(asked, "scene_id")
    near = lambda c, to: is_close(_C(c), _C(to), 0.1)
    axis = lambda c, to: (_C(to) == 0) | near(c, to)
    before, upto = _C("frame") - 1, F.least(_C("frame") + 1, _C("steps")) - 1
    hits = [
        F.when((_C("mask").bitwiseAND(F.lit(k)) != 0) & has_type(k, _C("types")) & F.coalesce(held, F.lit(False)), end)
        for k, held, end in ((1, near("moved", "x"), before), (2, near("turned", "x"), upto), (4, axis("rx", "x") & axis("ry", "y"), before))
    ]
    return rows.groupBy("pred", *KEYS, "tween_idx", "sf").agg(F.max(F.greatest(*hits)).alias("e")).where("e is not null").select("pred", *KEYS, _C("sf").alias("s"), "e")


def _origins(t: Scenes, asked: DataFrame) -> DataFrame:
    """The same of origin predicates (``pred, scene_id, percent, x, y``): frame by frame, as origins move."""
    corners = [(_C(f"p{i}x"), _C(f"p{i}y")) for i in range(4)]
    weights = ((1 - _C("x")) * (1 - _C("y")), _C("x") * (1 - _C("y")), _C("x") * _C("y"), (1 - _C("x")) * _C("y"))
    share = [sum((p[k] * w for p, w in zip(corners, weights)), F.lit(0.0)) for k in (0, 1)]
    held = [is_close(_C(w), F.when(_C("percent"), s).otherwise(_C(c)), 0.1) for w, s, c in (("wld_x", share[0], "x"), ("wld_y", share[1], "y"))]
    rows = t.frames.where("frame < steps").join(asked, "scene_id").where(held[0] & held[1])
    return runs(rows.select("pred", *KEYS, "frame"), ["pred", *KEYS])


class Tables:
    """One evaluation: units and scenes that are needed, and the tables that levels add to."""

    def __init__(self, forms: DataFrame, assigned: DataFrame, t: Scenes, keep: Scratch) -> None:
        self.t, self.keep = t, keep
        self.units = keep.write(forms.select(F.explode("units").alias("u")).select("u.*").dropDuplicates(["unit"]), "units")
        asked = forms.select("program_id", F.explode("units.unit").alias("unit")).join(assigned, "program_id").select("unit", "scene_id").distinct()
        self.asked = keep.write(asked.join(self.units, "unit"), "asked")  # a unit with each scene that some program runs it on
        self.flat = keep.write(stretches(t.frames), "stretches")
        self.universe = self.flat.groupBy(*KEYS).agg(F.min("s").alias("s"), F.max("e").alias("e"))
        self.moving = merged(self.flat.where("types <> 0"), KEYS)
        self.counts = {(r.level, r.type): r for r in self.units.groupBy("level", "type").agg(F.max(F.exists("leaves", lambda x: x["getter"] == "get_pos")).alias("pos"), F.max(_C("quant") == "forall").alias("every")).collect()}
        self.objects: list[DataFrame] = []  # unit, scene_id, obj_idx
        self.motions: list[DataFrame] = []  # unit, scene_id, obj_idx, s, e
        self.spaces: list[DataFrame] = []  # unit, scene_id, s, e
        self.results: list[DataFrame] = []  # unit, scene_id, holds, bits
        self.closed = self._closed()

    def leaves(self, level: int | None, kind: str) -> DataFrame:
        """A row for each predicate of the units of a level (or all) on each scene."""
        rows = self.asked.where((_C("type") == kind) & (F.lit(True) if level is None else _C("level") == level))
        return rows.select("unit", "scene_id", F.explode("leaves").alias("l")).select("unit", "scene_id", "l.*")

    def _closed(self) -> DataFrame:
        """``pred, scene_id, obj_idx, s, e``: runs of the predicates that need no variable, each once."""
        asked = self.keep.write(self.leaves(None, "motion").where("var is null").drop("unit", "leaf", "rects").dropDuplicates(["pred", "scene_id"]), "predicates")
        names = {r.name for r in asked.select("name").distinct().collect()}
        of = lambda *n: asked.where(_C("name").isin(*n)).select("pred", "scene_id", "name", "mask", "text", "x", "y", "percent")
        held = F.when(_C("name") == "type", _C("types").bitwiseAND(_C("mask")) != 0).otherwise(directed())
        parts = [self.flat.join(of("type", "direction"), "scene_id").where(held).select("pred", *KEYS, "s", "e")]
        for name, rows in (("duration", _durations), ("magnitude", _magnitudes), ("origin", _origins)):
            if name in names:
                parts.append(rows(self.t, of(name).drop("name")).select("pred", *KEYS, "s", "e"))
        return self.keep.write(merged(reduce(DataFrame.unionByName, parts), ["pred", *KEYS]), "runs")

    def all_of(self, tables: list[DataFrame], columns: str) -> DataFrame:
        none = self.t.objects.sparkSession.createDataFrame([], columns)
        return reduce(DataFrame.unionByName, tables) if tables else none

    def chosen(self) -> DataFrame:
        scene = self.t.objects.select("scene_id").schema["scene_id"].dataType.simpleString()
        return self.all_of(self.objects, f"unit string, scene_id {scene}, obj_idx int")

    def first(self) -> DataFrame:
        """``unit, scene_id, obj_idx``: the first object of each variable."""
        return self.chosen().groupBy("unit", "scene_id").agg(F.min("obj_idx").alias("obj_idx"))

    # levels

    def evaluate(self) -> None:
        for level in range(1 + max((k for k, _ in self.counts), default=-1)):
            new = []
            for kind in ("object", "motion", "temporal", "spatial"):
                if (level, kind) in self.counts:
                    new.append(getattr(self, kind)(level))
            self.results.append(self.keep.write(reduce(DataFrame.unionByName, new), "results"))

    def object(self, level: int) -> DataFrame:
        rows = self.leaves(level, "object").join(self.t.objects, "scene_id")
        text = _C("text")
        if level:
            first = self.first().withColumnRenamed("unit", "var")
            values = first.join(self.t.objects, KEYS).select("var", "scene_id", *[_C(c).cast("string").alias(f"of_{c}") for c in ("fill", "shape", "obj_id", "size") if c in self.t.objects.columns])
            if self.counts[level, "object"].pos:
                at = self.t.frames.where("frame = 0").join(first, KEYS).select("var", "scene_id", ((_C("left") + _C("right")) / 2).cast("string").alias("of_pos"))
                values = values.join(at, ["var", "scene_id"], "left")
            mine = self.chosen().select(_C("unit").alias("var"), *KEYS, F.lit(True).alias("own"))
            rows = rows.join(values, ["var", "scene_id"], "left").join(mine, ["var", *KEYS], "left")
            got = [F.when(_C("getter") == g, _C(c)) for g, c in (("get_color", "of_fill"), ("get_shape", "of_shape"), ("get_id", "of_obj_id"), ("get_size", "of_size"), ("get_pos", "of_pos")) if c in rows.columns]
            text = F.coalesce("text", *got)
        held = F.when(_C("name") == "color", color_is(text)).when(_C("name") == "shape", _C("shape") == text).when(_C("name") == "id", _C("obj_id") == text)
        held = held.otherwise(_C("own")) if level else held
        cells = rows.groupBy("unit", *KEYS).agg(F.sum(F.when(held, _bit(_C("leaf"))).otherwise(0)).alias("bits"))
        cells = cells.join(self.units.select("unit", "quant", "words"), "unit").withColumn("held", looked_up(_C("words"), _C("bits")))
        cells = self.keep.write(cells.drop("words"), "cells")
        kept = cells.where("held")
        one = kept.where("quant = 'iota'").groupBy("unit", "scene_id").agg(F.min("obj_idx").alias("obj_idx"))
        self.objects.append(self.keep.write(one.unionByName(kept.where("quant = 'all'").select("unit", *KEYS)), "objects"))
        holds = F.when(F.first("quant") == "forall", F.min("held")).otherwise(F.max("held"))
        return cells.groupBy("unit", "scene_id").agg(holds.alias("holds"), F.bit_or("bits").alias("bits"))

    def motion(self, level: int) -> DataFrame:
        on = self.asked.where((_C("type") == "motion") & (_C("level") == level)).select("unit", "scene_id")
        leaves = self.leaves(level, "motion").withColumn("bit", _bit(_C("leaf")))
        cut = lambda rows: rows.select("unit", *KEYS, _C("s").cast("bigint").alias("s"), _C("e").cast("bigint").alias("e"), "bit")
        marks = [cut(on.join(self.universe, "scene_id").withColumn("bit", F.lit(intervals.UNIVERSE)))]
        marks.append(cut(leaves.where("var is null").join(self.closed, ["pred", "scene_id"])))
        if level:
            var = lambda df: df.withColumnRenamed("unit", "var")
            if self.motions:
                marks.append(cut(leaves.where("name = 'var'").join(var(reduce(DataFrame.unionByName, self.motions)), ["var", "scene_id"])))
            agents = leaves.where("name = 'agent'").join(var(self.chosen()), ["var", "scene_id"])
            marks.append(cut(agents.join(self.moving, KEYS)))
            if self.spaces:
                marks.append(cut(self._posts(leaves.where("name = 'post'"), var(reduce(DataFrame.unionByName, self.spaces)))))
            if self.counts[level, "motion"].pos:
                at = self.t.frames.where("frame = 0").join(var(self.first()), KEYS).select("var", "scene_id", ((_C("left") + _C("right")) / 2).alias("x"), ((_C("top") + _C("bottom")) / 2).alias("y"))
                asked = leaves.where("getter = 'get_pos'").select("pred", "scene_id", "var").distinct().join(at, ["var", "scene_id"]).withColumn("percent", F.lit(False)).drop("var")
                marks.append(cut(leaves.where("getter = 'get_pos'").join(_origins(self.t, asked), ["pred", "scene_id"])))
        swept = intervals.segments(reduce(DataFrame.unionByName, marks), ["unit", *KEYS]).where(_C("mask").bitwiseAND(F.lit(intervals.UNIVERSE)) != 0)
        swept = swept.withColumn("bits", _C("mask").bitwiseAND(F.lit((1 << 16) - 1))).drop("mask").join(self.units.select("unit", "quant", "words"), "unit")
        cells = self.keep.write(swept.withColumn("held", looked_up(_C("words"), _C("bits"))).drop("words"), "swept")
        self.motions.append(self.keep.write(first_runs(merged(cells.where("held and quant = 'iota'"), ["unit", *KEYS]), ["unit", *KEYS]), "motions"))
        out = cells.groupBy("unit", "scene_id").agg(F.max("held").alias("holds"), F.bit_or("bits").alias("bits"))
        if self.counts[level, "motion"].every:
            out = self._forall(cells, out)
        return out

    def _posts(self, leaves: DataFrame, spaces: DataFrame) -> DataFrame:
        """Frames of tweens at whose end a spatial relation holds."""
        at = _spans(self.t).withColumn("at", F.least(F.ceil("end"), _C("steps") - 1).cast("int"))
        rows = at.select(*KEYS, F.floor("start").alias("from"), F.least(F.ceil("end") - 1, _C("steps") - 1).alias("to"), "at").join(spaces, "scene_id").where("at between s and e")
        marked = merged(rows.select("var", *KEYS, _C("from").alias("s"), _C("to").alias("e")), ["var", *KEYS])
        return leaves.join(marked, ["var", "scene_id"])

    def _forall(self, cells: DataFrame, out: DataFrame) -> DataFrame:
        """A frame in which all objects hold: as many of them hold as there are."""
        every = cells.where("quant = 'forall'")
        marks = every.select("unit", "scene_id", "s", "e", F.when(_C("held"), F.lit((1 << 32) + 1)).otherwise(F.lit(1)).cast("bigint").alias("bit"))
        swept = intervals.segments(marks, ["unit", "scene_id"])
        all_ = (_C("mask") > 0) & (F.shiftright("mask", 32) == _C("mask").bitwiseAND(F.lit((1 << 32) - 1)))
        found = swept.groupBy("unit", "scene_id").agg(F.max(all_).alias("every"))
        return out.join(found, ["unit", "scene_id"], "left").select("unit", "scene_id", F.coalesce("every", "holds").alias("holds"), "bits")

    def temporal(self, level: int) -> DataFrame:
        asked = self.asked.where((_C("type") == "temporal") & (_C("level") == level)).select("unit", "scene_id", "a", "b", "relations")
        every = reduce(DataFrame.unionByName, self.motions).withColumnRenamed("unit", "var")
        side = lambda name: asked.select("unit", "scene_id", _C(name).alias("var")).join(every, ["var", "scene_id"]).select("unit", "scene_id", "s", "e")
        names = [r[0] for r in asked.select(F.explode("relations")).distinct().collect()]  # at most the thirteen
        found = intervals.related(self.keep.write(side("a"), "left"), self.keep.write(side("b"), "right"), ["unit", "scene_id"], names, gap=1)
        hit = found.join(asked, ["unit", "scene_id"]).where(F.array_contains("relations", _C("relation"))).select("unit", "scene_id").distinct()
        return hit.select("unit", "scene_id", F.lit(True).alias("holds"), F.lit(0).cast("bigint").alias("bits"))

    def spatial(self, level: int) -> DataFrame:
        asked = self.asked.where((_C("type") == "spatial") & (_C("level") == level)).select("unit", "scene_id", "a", "b", "rects")
        pairs = asked.select("scene_id", "a", "b").distinct()  # one reading of two objects' boxes for all their relations
        first = self.first()
        boxes = self.t.frames.where("frame < steps").select(*KEYS, "frame", *SIDES)

        def side(name: str) -> DataFrame:
            rows = pairs.join(first.select(_C("unit").alias(name), *KEYS), [name, "scene_id"]).join(boxes, KEYS)
            return rows.select("scene_id", "a", "b", "frame", *[_C(c).alias(f"{name}_{c}") for c in SIDES])

        both = side("a").join(side("b"), ["scene_id", "a", "b", "frame"])
        x, y = [[(_C(f"{n}_{c}"), _C(f"{n}_{d}")) for n in "ab"] for c, d in (("left", "right"), ("bottom", "top"))]
        bits = lambda sides, down: sum((F.when(relation(n, *sides, descending=down), 1 << i).otherwise(0) for i, n in enumerate(RELATIONS)), F.lit(0))
        both = both.select("scene_id", "a", "b", "frame", bits(x, False).alias("xs"), bits(y, True).alias("ys"))
        on = lambda c, m: (m == -1) | (_C(c).bitwiseAND(m) != 0)
        rows = both.join(asked, ["scene_id", "a", "b"]).where(F.exists("rects", lambda r: on("xs", r["x"]) & on("ys", r["y"])))
        found = self.keep.write(runs(rows, ["unit", "scene_id"]), "spaces")
        self.spaces.append(found)
        return found.select("unit", "scene_id").distinct().select("unit", "scene_id", F.lit(True).alias("holds"), F.lit(0).cast("bigint").alias("bits"))


def evaluate_programs(programs: DataFrame, assigned: DataFrame, tables: Scenes, id_col: str = "program_id", text_col: str = "text") -> DataFrame:
    """``program_id, scene_id, stmt_idx, node_idx, tag, result, status``: the report of every program on each of its scenes.

    ``programs``: an id and a text, ids once each; ``assigned``: ``program_id, scene_id``. A program outside the language has one row a scene, statement -1, with the reason as its tag and status
    ``rejected``; others are as :func:`frameloom.plans.compiler.evaluate` reports them. Predicates that were registered in the session are not known here. The report is written to the shared folder.
    """
    keep = Scratch(programs.sparkSession)
    forms = keep.write(parsed(programs, id_col, text_col), "programs")
    assigned = keep.write(assigned.select("program_id", "scene_id").join(tables.scenes.select("scene_id"), "scene_id").distinct(), "assigned")
    run = Tables(forms, assigned, tables, keep)
    run.evaluate()
    scene = assigned.schema["scene_id"].dataType.simpleString()
    results = run.all_of(run.results, f"unit string, scene_id {scene}, holds boolean, bits bigint")

    nodes = forms.select("program_id", F.explode("nodes").alias("n")).select("program_id", "n.*").where("node > 0").join(assigned, "program_id")
    flag = F.when(_C("leaf") < 0, _C("holds")).otherwise(F.call_function("shiftright", _C("bits"), F.greatest("leaf", F.lit(0))).bitwiseAND(F.lit(1)) == 1)
    nodes = nodes.join(results, ["unit", "scene_id"], "left").select("program_id", "scene_id", "stmt", "node", "tag", F.coalesce(flag, F.lit(False)).alias("result"))

    statements = forms.select("program_id", F.explode("statements").alias("s")).select("program_id", "s.*").join(assigned, "program_id")
    parts = statements.select("program_id", "scene_id", "stmt", F.posexplode("units").alias("i", "unit")).join(results, ["unit", "scene_id"], "left")
    place = parts.groupBy("program_id", "scene_id", "stmt").agg(F.sum(F.when(_C("holds"), _bit(_C("i"))).otherwise(0)).alias("place"))
    found = run.first().select("unit", "scene_id", F.lit(True).alias("there"))
    gone = statements.where("a is not null").select("program_id", "scene_id", "stmt", F.explode(F.array("a", "b")).alias("unit")).join(found, ["unit", "scene_id"], "left")
    gone = gone.groupBy("program_id", "scene_id", "stmt").agg(F.max(_C("there").isNull()).alias("gone"))
    keys = ["program_id", "scene_id", "stmt"]
    whole = statements.join(place, keys).join(gone, keys, "left")
    status = F.when(_C("gone"), "invalid").otherwise("ok")
    heads = whole.select(*keys, F.lit(0).alias("node"), _C("text").alias("tag"), looked_up(_C("words"), _C("place")).alias("result"))
    named = whole.select(*keys, status.alias("status"))
    rejected = forms.where("error is not null").join(assigned, "program_id").select("program_id", "scene_id", F.lit(-1).alias("stmt"), F.lit(0).alias("node"), _C("error").alias("tag"), F.lit(False).alias("result"), F.lit("rejected").alias("status"))
    report = heads.unionByName(nodes).join(named, keys).unionByName(rejected)
    out = written(report.select("program_id", "scene_id", _C("stmt").alias("stmt_idx"), _C("node").alias("node_idx"), "tag", "result", "status"), "report")
    keep.clear()
    return out


__all__ = ["Tables", "evaluate_programs", "parsed", "stretches"]
