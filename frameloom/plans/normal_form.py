"""Programs as data: statements, report nodes and units of evaluation, under keys that equal things share.

A unit is a quantifier with its body, a temporal relation or a spatial relation. Its key is a hash of its normal form: the different predicates of the body in a fixed order, and the body as a truth
table over them; variables stand in it by the keys of their own units. So a unit, or a predicate, that many programs have under whatever names and in whatever order has one key.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np

from frameloom.functions.allen import REGIONS, RELATIONS, TEMPORAL
from frameloom.functions.motion_types import parse_types
from frameloom.plans.lang import GETTERS, MOTION, OBJECT, Bool, Call, Program, ProgramError, Quant, Var, parse, resolve

#: Most different predicates of a body, and most relations and quantifiers of a statement.
MOST_LEAVES = 16
#: Rectangles of relations; -1 leaves an axis open.
RECTS = "array<struct<x:int,y:int>>"
LEAF = f"struct<leaf:int,name:string,pred:string,mask:int,text:string,x:double,y:double,percent:boolean,var:string,getter:string,rects:{RECTS}>"
UNIT = f"struct<unit:string,level:int,type:string,quant:string,words:array<bigint>,a:string,b:string,relations:array<string>,rects:{RECTS},leaves:array<{LEAF}>>"
SCHEMA = f"error string, statements array<struct<stmt:int,text:string,words:array<bigint>,units:array<string>,a:string,b:string>>, nodes array<struct<stmt:int,node:int,tag:string,unit:string,leaf:int>>, units array<{UNIT}>"


def _key(form: object) -> str:
    return hashlib.sha256(json.dumps(form, sort_keys=True).encode()).hexdigest()[:32]


def _bits(names) -> int:
    return sum(1 << RELATIONS.index(n) for n in names)


def rects_of(call: Call) -> list[dict]:
    """A region, or an axis relation, as pairs of relation sets of the two axes."""
    if call.name in REGIONS:
        return [{"x": _bits(xs), "y": _bits(ys)} for xs, ys in REGIONS[call.name]]
    one = _bits([call.name[2:]])
    return [{"x": one, "y": -1} if call.args[2] == "x" else {"x": -1, "y": one}]


def truth_table(tree, index: dict[str, int], key_of) -> list[int]:
    """The values of a boolean tree for all flags of its leaves, as words of 64 bits; leaf j is bit j of the place."""
    if len(index) > MOST_LEAVES:
        raise ProgramError(f"more than {MOST_LEAVES} different parts in one expression")
    places = np.arange(1 << max(6, len(index)))

    def value(x) -> np.ndarray:
        if isinstance(x, Bool):
            parts = [value(p) for p in x.parts]
            return ~parts[0] if x.op == "not" else (np.logical_and if x.op == "and" else np.logical_or).reduce(parts)
        return places >> index[key_of(x)] & 1 == 1

    return np.packbits(value(tree), bitorder="little").view("<i8").tolist()


@dataclass
class _Builder:
    program: Program
    keys: dict[str, str] = field(default_factory=dict)  # of variables
    units: dict[str, dict] = field(default_factory=dict)

    def add(self, form: dict, uses: list[str]) -> str:
        level = 1 + max((self.units[u]["level"] for u in uses), default=-1)
        key = _key(form)
        self.units[key] = {"unit": key, "level": level, "quant": None, "words": None, "a": None, "b": None, "relations": None, "rects": None, "leaves": []} | form
        return key

    def spatial(self, call: Call) -> str:
        a, b = (self.keys[v.name] for v in call.args[:2])
        return self.add({"type": "spatial", "a": a, "b": b, "rects": rects_of(call)}, [a, b])

    def temporal(self, call: Call) -> str:
        a, b = (self.keys[v.name] for v in call.args)
        return self.add({"type": "temporal", "a": a, "b": b, "relations": sorted(TEMPORAL.get(call.name, (call.name,)))}, [a, b])

    def leaf(self, x, q: Quant, mask: int | None) -> tuple[dict, list[tuple[str, str | None]], list[str]]:
        """A predicate as data, its report nodes (a tag and the unit that has the result, or none if the predicate has it) and the units it needs."""
        out: dict = {"name": None, "mask": None, "text": None, "x": None, "y": None, "percent": None, "var": None, "getter": None, "rects": None}
        if isinstance(x, Var):
            key = self.keys[x.name]
            return out | {"name": "var", "var": key}, [], [key]
        out["name"] = x.name
        nodes: list[tuple[str, str | None]] = [(x.name, None)]
        value = resolve(x.args[1], self.program) if q.kind == MOTION else x.args[1]
        if x.name in ("direction", "magnitude", "duration"):
            out["mask"] = mask
        if isinstance(value, Call) and value.name in GETTERS:
            if q.kind == MOTION and value.name != "get_pos":
                raise ProgramError(f"{x.name}: {value.name} isn't a point")
            key = self.keys[value.args[0].name]
            return out | {"var": key, "getter": value.name}, nodes, [key]
        if x.name == "type":
            out["mask"] = parse_types(value)
        elif x.name == "agent":
            out["var"] = self.keys[value.name]
            return out, nodes, [out["var"]]
        elif x.name == "post":
            out["var"] = self.spatial(value)
            return out, [*nodes, (value.name, out["var"])], [out["var"]]
        elif isinstance(value, list):
            if isinstance(value[0], str):
                out |= {"percent": True, "x": float(value[0].replace("%", "")) / 100, "y": float(value[1].replace("%", "")) / 100}
            else:
                out |= {"percent": False, "x": float(value[0]), "y": float(value[1])}
        elif isinstance(value, str):
            out["text"] = value
        else:
            out["x"] = float(value)
        return out, nodes, []

    def quant(self, q: Quant) -> tuple[str, list[tuple[str, str, int]]]:
        """The unit of a quantifier, and its nodes as tag, unit and leaf (-1: what the unit says)."""
        mask, leaves, tags, uses, key_at = None, {}, [], [], {}
        todo = [q.body]
        while todo:  # in the order of the text, as a type counts for what stands after it
            x = todo.pop(0)
            if isinstance(x, Bool):
                todo = [*x.parts, *todo]
                continue
            if isinstance(x, Call) and x.name == "type":
                mask = parse_types(resolve(x.args[1], self.program))
            form, nodes, needs = self.leaf(x, q, mask)
            key = key_at[id(x)] = _key(form)
            leaves[key] = form
            uses += needs
            tags += [(tag, unit or key, -1 if unit else 0) for tag, unit in nodes]
        index = {k: i for i, k in enumerate(sorted(leaves))}
        words = truth_table(q.body, index, lambda x: key_at[id(x)])
        unit = self.add({"type": q.kind.lower(), "quant": q.name, "words": words, "leaves": [leaves[k] | {"leaf": i, "pred": k} for k, i in index.items()]}, uses)
        return unit, [(tag, key, -1) if at else (tag, unit, index[key]) for tag, key, at in tags]

    def part(self, x) -> tuple[str, list[tuple[str, str, int]]]:
        if isinstance(x, Quant):
            return self.quant(x)
        unit = self.temporal(x) if x.name in TEMPORAL or x.name in RELATIONS else self.spatial(x)
        return unit, [(x.name, unit, -1)]


def normal_form(text: str) -> dict:
    """The columns of ``SCHEMA`` for one program; an ``error`` for a text outside the language."""
    try:
        program = parse(text)
        build, statements, nodes = _Builder(program), [], []
        for n, s in enumerate(program.statements):
            parts: dict[int, tuple] = {}
            todo, order = [s.expr], []
            while todo:
                x = todo.pop(0)
                if isinstance(x, Bool):
                    todo = [*x.parts, *todo]
                elif isinstance(x, (Quant, Call)):
                    parts[id(x)] = build.part(x)
                    order.append(x)
                else:
                    raise ProgramError(f"not a statement: {s.text}")
            index: dict[str, int] = {}
            for x in order:
                index.setdefault(parts[id(x)][0], len(index))
            words = truth_table(s.expr, index, lambda x, parts=parts: parts[id(x)][0])
            alone = isinstance(s.expr, Call) and (s.expr.name in REGIONS or s.expr.name.startswith("s_"))
            a, b = (build.keys[v.name] for v in s.expr.args[:2]) if alone else (None, None)
            statements.append({"stmt": n, "text": s.text, "words": words, "units": list(index), "a": a, "b": b})
            tags = [(s.text, None, -1), *[t for x in order for t in parts[id(x)][1]]]
            nodes += [{"stmt": n, "node": i, "tag": tag, "unit": unit, "leaf": leaf} for i, (tag, unit, leaf) in enumerate(tags)]
            if s.target is not None:
                build.keys[s.target] = parts[id(s.expr)][0]
        return {"error": None, "statements": statements, "nodes": nodes, "units": list(build.units.values())}
    except (ProgramError, RecursionError) as e:
        return {"error": str(e) or type(e).__name__, "statements": [], "nodes": [], "units": []}


__all__ = ["MOTION", "OBJECT", "SCHEMA", "normal_form", "rects_of", "truth_table"]
