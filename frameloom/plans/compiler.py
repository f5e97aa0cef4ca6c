"""Compiles motion programs to DataFrames and evaluates them over all scenes at once.

A body over objects is one boolean column over them. A body over motions is read from stretches: frames are folded once to intervals in which an object's types and directions stay the same, on
which those predicates are columns; predicates of tweens, of origins and earlier variables are sets of intervals, and one boundary sweep combines them with the stretches. A
variable is a small table: objects, or runs. Quantifiers that use no variable are aggregated together. Each statement gives one report row for each scene and function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.allen import REGIONS, RELATIONS, TEMPORAL, axis_relation, region
from frameloom.functions.motion_types import parse_types
from frameloom.operators import motion
from frameloom.operators.intervals import UNIVERSE, related, segments
from frameloom.operators.runs import first_runs, merged, runs, stretches, with_flag
from frameloom.plans.lang import EXTENSIONS, GETTERS, MOTION, OBJECT, Bool, Call, Program, Quant, Var, parse, resolve
from frameloom.scratch import written
from frameloom.sources.scenes import Scenes

KEYS = ["scene_id", "obj_idx"]
SIDES = ("left", "right", "top", "bottom")


#: Builders of predicates that were added.
BUILDERS: dict = {}


def color_is(name: str | Column) -> Column:
    """A colour name that is part of the fill or stroke."""
    to = name if isinstance(name, Column) else F.lit(name)
    return F.coalesce(F.contains(F.col("fill"), to), F.lit(False)) | F.coalesce(F.contains(F.col("stroke"), to), F.lit(False))


def register_predicate(name: str, kind: str, build) -> None:
    """Adds a predicate to the language: ``name(v, value)`` over objects or motions, where ``build(value)`` is a boolean column over the objects' or the frames' table."""
    if not name.isidentifier() or kind not in (OBJECT, MOTION):
        raise ValueError("a name, and Object or Motion")
    EXTENSIONS[name], BUILDERS[name] = kind, build


class Evaluation:
    """One program over one set of scenes."""

    def __init__(self, program: Program, tables: Scenes) -> None:
        self.program, self.t, self.vars, self.traced, self.folded, self.leaves = program, tables, {}, [], None, 0

    # variables and values

    def first_object(self, name: str) -> DataFrame:
        """``scene_id, obj_idx``: the first object of a variable in each scene."""
        return self.vars[name].groupBy("scene_id").agg(F.min("obj_idx").alias("obj_idx"))

    def boxes(self, name: str, prefix: str) -> DataFrame:
        rows = self.t.frames.where("frame < steps").join(self.first_object(name), KEYS, "left_semi")
        return rows.select("scene_id", "frame", *[F.col(c).alias(f"{prefix}_{c}") for c in SIDES])

    def spatial(self, call: Call) -> DataFrame:
        """``scene_id, frame, holds`` of a region or an axis relation between the first objects of two variables."""
        both = self.boxes(call.args[0].name, "a").join(self.boxes(call.args[1].name, "b"), ["scene_id", "frame"])
        a, b = ({c: F.col(f"{p}_{c}") for c in SIDES} for p in "ab")
        held = region(call.name, a, b) if call.name in REGIONS else axis_relation(call.name[2:], call.args[2], a, b)
        return both.select("scene_id", "frame", held.alias("holds"))

    def temporal(self, call: Call) -> DataFrame:
        """``scene_id, holds``: whether any runs of two variables are so related."""
        found = related(*[self.vars[x.name] for x in call.args], ["scene_id"], TEMPORAL.get(call.name, (call.name,)), gap=1)
        return found.select("scene_id").distinct().withColumn("holds", F.lit(True))

    def getter(self, call: Call) -> tuple[DataFrame, list[str]]:
        """``scene_id`` and the value columns of an object getter, for the first object of its variable."""
        first = self.first_object(call.args[0].name)
        if call.name == "get_pos":
            rows = self.t.frames.where("frame = 0").join(first, KEYS, "left_semi")
            return rows.select("scene_id", ((F.col("left") + F.col("right")) / 2).alias("g0"), ((F.col("top") + F.col("bottom")) / 2).alias("g1")), ["g0", "g1"]
        name = {"get_size": "size", "get_color": "fill", "get_shape": "shape", "get_id": "obj_id"}[call.name]
        return self.t.objects.join(first, KEYS, "left_semi").select("scene_id", F.col(name).alias("g0")), ["g0"]

    # bodies

    def stretches(self) -> DataFrame:
        """The frames, folded; read once for a program."""
        if self.folded is None:
            self.folded = written(stretches(self.t.frames), "stretches")
        return self.folded

    def body(self, q: Quant) -> tuple[DataFrame, Column, list[tuple[str, Column]]]:
        """Rows of the quantifier's kind, the body as a column over them, and its function nodes."""
        self.rows = self.t.objects if q.kind == OBJECT else self.stretches()
        self.nodes, self.mask, self.extra, self.columns, self.sets = [], None, [], {}, {}
        held = self.expr(q.body, q)
        if q.kind == OBJECT:
            return self.rows, held, self.nodes
        rows = self.rows.select(*KEYS, "s", "e", *[c.alias(n) for n, c in self.columns.items()])
        if self.sets:  # columns are bits of the stretches' marks, sets add theirs
            bit = {n: 1 << i for i, n in enumerate([*self.columns, *self.sets])}
            own = reduce(lambda a, b: a + b, [F.when(F.col(n), F.lit(bit[n])).otherwise(F.lit(0)) for n in self.columns], F.lit(UNIVERSE))
            marks = [x.select(*KEYS, F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), F.lit(bit[n]).cast("bigint").alias("bit")) for n, x in self.sets.items()]
            swept = segments(reduce(DataFrame.unionByName, marks, rows.select(*KEYS, "s", "e", own.alias("bit"))), KEYS)
            flags = [(F.col("mask").bitwiseAND(F.lit(v)) != 0).alias(n) for n, v in bit.items()]
            rows = swept.where(F.col("mask").bitwiseAND(F.lit(UNIVERSE)) != 0).select(*KEYS, "s", "e", *flags)
        return rows, held, self.nodes

    def flag(self, marked: DataFrame, on: list[str]) -> Column:
        name = f"flag{len(self.rows.columns)}"
        self.rows = with_flag(self.rows, marked, on, name)
        return F.col(name)

    def leaf(self) -> str:
        self.leaves += 1
        return f"leaf{self.leaves}"

    def local(self, held: Column) -> Column:
        """A condition on a stretch's own columns."""
        name = self.leaf()
        self.columns[name] = held
        return F.col(name)

    def spans(self, found: DataFrame) -> Column:
        """A condition that is a set of intervals (``scene_id, obj_idx, s, e``; they may overlap)."""
        name = self.leaf()
        self.sets[name] = merged(found, KEYS)
        return F.col(name)

    def framed(self, rows: DataFrame, held: Column) -> Column:
        """A condition that only single frames tell."""
        return self.spans(runs(rows.where("frame < steps").select(*KEYS, "frame", held.alias("held")), KEYS, where=F.col("held")))

    def node(self, tag: str, held: Column) -> Column:
        self.nodes.append((tag, held))
        return held

    def expr(self, x, q: Quant) -> Column:
        if isinstance(x, Bool):
            parts = [self.expr(p, q) for p in x.parts]
            return ~parts[0] if x.op == "not" else reduce(lambda a, b: a & b if x.op == "and" else a | b, parts)
        if isinstance(x, Var):
            return self.flag(self.vars[x.name], KEYS) if q.kind == OBJECT else self.spans(self.vars[x.name])
        if x.name in BUILDERS:
            held = F.coalesce(BUILDERS[x.name](x.args[1]), F.lit(False))
            return self.node(x.name, held if q.kind == OBJECT else self.framed(self.t.frames, held))
        return self.object_call(x) if q.kind == OBJECT else self.motion_call(x)

    def object_call(self, x: Call) -> Column:
        value = x.args[1]
        if isinstance(value, Call):
            table, names = self.getter(value)
            name = f"got{len(self.rows.columns)}"
            self.rows = self.rows.join(table.select("scene_id", F.col(names[0]).cast("string").alias(name)), "scene_id", "left")
            to = F.col(name)
        else:
            to = F.lit(value)
        if x.name == "color":
            held = color_is(to)
        else:
            held = F.coalesce(F.col({"shape": "shape", "id": "obj_id"}[x.name]) == to, F.lit(False))
        return self.node(x.name, held)

    def motion_call(self, x: Call) -> Column:
        value, types, t = resolve(x.args[1], self.program), F.col("types"), self.t
        if x.name == "type":
            self.mask = parse_types(value)
            return self.node("type", self.local(motion.has_type(self.mask, types)))
        if x.name == "direction":
            return self.node("direction", self.local(motion.direction(self.mask, value)))
        if x.name == "magnitude":
            return self.node("magnitude", self.spans(motion.magnitude_spans(t.frames, t.tweens, t.scenes, self.mask, value)))
        if x.name == "duration":
            return self.node("duration", self.spans(motion.duration_spans(t.tweens, t.scenes, self.mask, value)))
        if x.name == "agent":
            return self.node("agent", self.local(motion.agent(self.flag(self.vars[value.name], KEYS), types)))
        if x.name == "origin":
            rows = t.frames
            if isinstance(value, Call) and value.name in GETTERS:
                table, names = self.getter(value)
                rows = rows.join(table.select("scene_id", *[F.col(n).alias(f"of_{n}") for n in names]), "scene_id")
                value = [F.col(f"of_{n}") for n in names]
            corners = [(F.col(f"p{i}x"), F.col(f"p{i}y")) for i in range(4)]
            return self.node("origin", self.framed(rows, motion.origin(value, (F.col("wld_x"), F.col("wld_y")), corners)))
        rel = self.spatial(value)
        held = self.node("post", self.spans(motion.post_spans(t.tweens, t.scenes, rel)))
        any_ = rel.groupBy("scene_id").agg(F.max("holds").alias("h"))
        self.extra.append((len(self.nodes), value.name, any_))
        return held

    # statements

    def quant(self, q: Quant) -> tuple[DataFrame, DataFrame | None, list]:
        """``scene_id, holds`` and the node results ``n0..`` of a quantified statement; the variable's table; the node tags."""
        rows, held, nodes = self.body(q)
        marked = rows.select(*KEYS, *(["s", "e"] if q.kind == MOTION else []), held.alias("held"), *[c.alias(f"n{i}") for i, (_, c) in enumerate(nodes)])
        self.traced.append((q, marked))
        tests = marked.groupBy("scene_id").agg((F.min if q.name == "forall" else F.max)("held").alias("holds"), *[F.max(f"n{i}").alias(f"n{i}") for i in range(len(nodes))])
        value = None
        if q.name == "forall" and q.kind == MOTION:
            tests = tests.drop("holds").join(self.everywhere(marked), "scene_id", "left")
        elif q.name == "count":
            self.counted = (marked.where("held") if q.kind == OBJECT else merged(marked.where("held"), KEYS)).groupBy("scene_id").agg(F.count("*").alias("n"))
        elif q.kind == OBJECT:
            value = marked.where("held").select(*KEYS)
            if q.name == "iota":
                value = value.groupBy("scene_id").agg(F.min("obj_idx").alias("obj_idx"))
        else:
            value = first_runs(merged(marked.where("held"), KEYS), KEYS)
        tags = [tag for tag, _ in nodes]
        for at, tag, table in reversed(self.extra):
            tests = tests.join(table.withColumnRenamed("h", f"x{at}"), "scene_id", "left")
        names = [(tag, f"n{i}") for i, tag in enumerate(tags)]
        for at, tag, _ in reversed(self.extra):
            names.insert(at, (tag, f"x{at}"))
        return tests, value, names

    def everywhere(self, marked: DataFrame) -> DataFrame:
        """``scene_id, holds``: whether some frame has as many objects that hold as it has objects."""
        one = F.when(F.col("held"), F.lit((1 << 32) + 1)).otherwise(F.lit(1)).cast("bigint")
        counts = segments(marked.select("scene_id", "s", "e", one.alias("bit")), ["scene_id"])
        every = (F.col("mask") > 0) & (F.shiftright("mask", 32) == F.col("mask").bitwiseAND(F.lit((1 << 32) - 1)))
        return counts.groupBy("scene_id").agg(F.max(every).alias("holds"))

    def shared(self) -> tuple[DataFrame | None, dict[int, list[tuple[str, str]]]]:
        """Bare quantifiers whose bodies are columns of objects or stretches alone, in one aggregation for each kind: a table by scene, and of each such statement its columns with their tags."""
        table, found = None, {}
        for kind in (OBJECT, MOTION):
            columns, answers = {}, []
            for n, s in enumerate(self.program.statements):
                q = s.expr
                if s.target is not None or not isinstance(q, Quant) or q.kind != kind or q.name not in ("exists", "forall") or kind == MOTION and q.name == "forall" or _uses(q.body, q.var):
                    continue
                _, held, nodes = self.body(q)
                if self.sets:
                    continue
                cells = {f"q{n}": held} | {f"q{n}_{i}": c for i, (_, c) in enumerate(nodes)}
                columns |= self.columns
                answers += [(F.min if q.name == "forall" and c == f"q{n}" else F.max)(x).alias(c) for c, x in cells.items()]
                found[n] = [(f"q{n}", s.text), *[(f"q{n}_{i}", tag) for i, (tag, _) in enumerate(nodes)]]
            if answers:
                rows = self.t.objects if kind == OBJECT else self.folded.withColumns(columns)
                own = rows.groupBy("scene_id").agg(*answers)
                table = own if table is None else table.join(own, "scene_id", "full")
        return table, found

    def missing(self, call: Call) -> DataFrame:
        """Scenes in which an object that a spatial relation needs was not found."""
        ids = self.t.scenes.select("scene_id")
        return reduce(DataFrame.union, [ids.join(self.vars[x.name], "scene_id", "left_anti") for x in call.args[:2]]).distinct()

    def scene_bool(self, x) -> tuple[DataFrame, list]:
        """A bare expression: ``scene_id, holds`` and node results."""
        if isinstance(x, Quant):
            tests, _, names = self.quant(x)
            return tests, names
        if isinstance(x, Call):
            found = self.temporal(x) if x.name in TEMPORAL or x.name in RELATIONS else self.spatial(x).groupBy("scene_id").agg(F.max("holds").alias("holds"))
            return found.withColumn("n0", F.col("holds")), [(x.name, "n0")]
        parts = [self.scene_bool(p) for p in x.parts]
        out, held, names = self.t.scenes.select("scene_id"), [], []
        for k, (table, own) in enumerate(parts):
            table = table.select("scene_id", F.col("holds").alias(f"h{k}"), *[F.col(c).alias(f"p{k}_{c}") for _, c in own])
            out = out.join(table, "scene_id", "left")
            held.append(F.coalesce(f"h{k}", F.lit(False)))
            names += [(tag, f"p{k}_{c}") for tag, c in own]
        whole = ~held[0] if x.op == "not" else reduce(lambda a, b: a & b if x.op == "and" else a | b, held)
        return out.withColumn("holds", whole), names

    def run(self, together: bool = True) -> DataFrame:
        """``scene_id, stmt_idx, node_idx, tag, result, status``: node 0 is the statement itself. ``together``: statements that can share an aggregation do."""
        joint, found = self.shared() if together else (None, {})
        out = []
        report = lambda n, cells: [F.struct(F.lit(n).alias("stmt_idx"), F.lit(i).alias("node_idx"), F.lit(tag).alias("tag"), F.coalesce(F.col(c), F.lit(False)).alias("result")) for i, (c, tag) in enumerate(cells)]
        ids = self.t.scenes.select("scene_id")
        if found:
            lines = F.array(*[x for n, cells in found.items() for x in report(n, cells)])
            out.append(ids.join(joint, "scene_id", "left").select("scene_id", F.explode(lines).alias("r"), F.lit("ok").alias("status")))
        for n, s in enumerate(self.program.statements):
            if n in found:
                continue
            if s.target is not None:
                tests, value, names = self.quant(s.expr)
                self.vars[s.target] = written(value, "variable")  # later statements read the variable, they don't plan it again
            else:
                tests, names = self.scene_bool(s.expr)
            rows = ids.join(tests, "scene_id", "left")
            status = F.lit("ok")
            if isinstance(s.expr, Call) and (s.expr.name in REGIONS or s.expr.name.startswith("s_")):
                rows = rows.join(self.missing(s.expr).withColumn("gone", F.lit(True)), "scene_id", "left")
                status = F.when(F.col("gone"), "invalid").otherwise("ok")
            out.append(rows.select("scene_id", F.explode(F.array(*report(n, [("holds", s.text), *[(c, tag) for tag, c in names]]))).alias("r"), status.alias("status")))
        return reduce(DataFrame.union, out).select("scene_id", "r.*", "status")


def _uses(x, var: str) -> bool:
    """Whether a body reads variables, its own apart."""
    if isinstance(x, Bool):
        return any(_uses(p, var) for p in x.parts)
    return isinstance(x, Var) or any(isinstance(a, Call) or isinstance(a, Var) and a.name != var for a in x.args)


def evaluate(program: str, tables: Scenes) -> DataFrame:
    """The report of a program over all scenes; raises ``ProgramError`` for programs outside the language."""
    return Evaluation(parse(program), tables).run()


def count(program: str, tables: Scenes) -> DataFrame:
    """``scene_id, n``: what the program's last statement counts (``count(Object|Motion, lambda v: ...)``): objects, or runs."""
    run = Evaluation(parse(program), tables)
    run.run()
    last = run.program.statements[-1].expr
    if not isinstance(last, Quant) or last.name != "count":
        raise ValueError("the last statement counts")
    return tables.scenes.select("scene_id").join(run.counted, "scene_id", "left").select("scene_id", F.coalesce("n", F.lit(0)).alias("n"))


def trace(program: str, tables: Scenes) -> DataFrame:
    """``scene_id, obj_idx, frame, quant_idx, node_idx, result``: the value of every function of every quantifier in every cell (frame is null for objects); node 0 is the body."""
    run = Evaluation(parse(program), tables)
    run.run(together=False)
    out = []
    for n, (q, cells) in enumerate(run.traced):
        if q.kind == MOTION:
            cells = cells.withColumn("frame", F.explode(F.sequence(F.col("s").cast("int"), F.col("e").cast("int"))))
        nodes = F.array(*[F.struct(F.lit(i).alias("node_idx"), F.col(c).alias("result")) for i, c in enumerate(["held", *[c for c in cells.columns if c.startswith("n")]])])
        frame = F.col("frame") if q.kind == MOTION else F.lit(None).cast("int")
        out.append(cells.select(*KEYS, frame.alias("frame"), F.lit(n).alias("quant_idx"), F.explode(nodes).alias("r")).select(*KEYS, "frame", "quant_idx", "r.*"))
    return reduce(DataFrame.union, out)


def verdicts(report: DataFrame) -> DataFrame:
    """For each scene: ``strict`` (no line of the report is false) and ``statements`` (every statement holds)."""
    return report.groupBy("scene_id").agg(F.min("result").alias("strict"), F.min(F.when(F.col("node_idx") == 0, F.col("result"))).alias("statements"))


def report_text(report: DataFrame) -> DataFrame:
    """``scene_id, report``: the report as text, a blank line between statements."""
    line = F.concat("tag", F.lit(": "), F.initcap(F.col("result").cast("string")))
    block = report.groupBy("scene_id", "stmt_idx").agg(F.array_sort(F.collect_list(F.struct("node_idx", line.alias("l")))).alias("b"))
    text = block.select("scene_id", "stmt_idx", F.array_join(F.col("b.l"), "\n").alias("t"))
    return text.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("stmt_idx", "t"))).alias("s")).select("scene_id", F.array_join(F.col("s.t"), "\n\n").alias("report"))


def read_program(spark: SparkSession, path: str) -> str:
    """A program file."""
    return spark.read.text(path, wholetext=True).first()[0]


__all__ = ["Evaluation", "color_is", "count", "evaluate", "read_program", "register_predicate", "report_text", "trace", "verdicts"]
