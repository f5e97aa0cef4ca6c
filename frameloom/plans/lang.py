"""Parser and checker of motion programs.

A program has one statement a line: ``name = iota(Object|Motion, lambda v: ...)``, or a bare expression of quantifiers, temporal or spatial
relations. Bodies combine predicates by ``and``, ``or`` and ``not``; an earlier variable stands for its own objects or frames.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from frameloom.functions.allen import REGIONS, RELATIONS, TEMPORAL
from frameloom.functions.motion_types import ROTATE, SCALE, TRANSLATE, parse_types

OBJECT, MOTION = "Object", "Motion"
OBJECT_PREDICATES = ("color", "shape", "id")
MOTION_PREDICATES = ("type", "direction", "magnitude", "origin", "duration", "post", "agent")
TEMPORAL_RELATIONS = (*RELATIONS, *TEMPORAL)
SPATIAL_RELATIONS = tuple(f"s_{r}" for r in RELATIONS)
GETTERS = ("get_pos", "get_size", "get_color", "get_shape", "get_id", "get_type", "get_agent", "get_direction", "get_origin", "get_magnitude", "get_duration", "get_post")
QUANTIFIERS = ("iota", "all", "exists", "forall", "count")
#: Predicates that were added by ``compiler.register_predicate``: their kind.
EXTENSIONS: dict[str, str] = {}


class ProgramError(ValueError):
    """A program that the language doesn't have."""


@dataclass
class Call:
    """A predicate or relation with literal, variable or nested arguments."""

    name: str
    args: list


@dataclass
class Bool:
    """``and``, ``or`` or ``not`` of expressions."""

    op: str
    parts: list


@dataclass
class Var:
    name: str


@dataclass
class Quant:
    """A quantifier over objects or motions with its body."""

    name: str
    kind: str
    var: str
    body: object


@dataclass
class Statement:
    text: str
    target: str | None
    expr: object


@dataclass
class Program:
    statements: list[Statement]
    #: of each variable, its kind and what the calls of its body were given
    kinds: dict[str, str] = field(default_factory=dict)
    info: dict[str, dict] = field(default_factory=dict)


def normalise(text: str) -> list[str]:
    """Statement texts: no comments, continued lines joined, double quotes."""
    try:
        return [ast.unparse(s).replace("'", '"') for s in ast.parse(text).body]
    except SyntaxError as e:
        raise ProgramError(f"not a program: {e}") from e


def parse(text: str) -> Program:
    """Parses and checks a program."""
    out = Program([])
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        raise ProgramError(f"not a program: {e}") from e
    for node, line in zip(tree.body, normalise(text)):
        target = None
        if isinstance(node, ast.Assign):
            if len(node.targets) != 1 or not isinstance(node.targets[0], ast.Name):
                raise ProgramError(f"one name on the left: {line}")
            target = node.targets[0].id
            if target in out.kinds:
                raise ProgramError(f"{target} is assigned twice")
        elif not isinstance(node, ast.Expr):
            raise ProgramError(f"not a statement: {line}")
        expr = _expr(node.value, out, None)
        if target is not None:
            if not isinstance(expr, Quant) or expr.name not in ("iota", "all"):
                raise ProgramError(f"only iota and all can be assigned: {line}")
            out.kinds[target] = expr.kind
            out.info[target] = _recorded(expr)
        elif isinstance(expr, (Var,)):
            raise ProgramError(f"not a statement: {line}")
        out.statements.append(Statement(line, target, expr))
    return out


def _recorded(q: Quant) -> dict:
    """Arguments that the conjuncts of a motion's body were given, for the getters."""
    out, todo = {}, [q.body]
    while todo:
        x = todo.pop(0)
        if isinstance(x, Bool):
            todo += x.parts
        elif isinstance(x, Call) and len(x.args) > 1:
            out.setdefault(x.name, x.args[1])
    return out


def _number(node: ast.AST):
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        value = _number(node.operand)
        return None if value is None or isinstance(value, str) else -value
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str)) and not isinstance(node.value, bool):
        return node.value
    return None


def _arg(node: ast.AST, program: Program, scope: tuple[str, str] | None):
    if isinstance(node, (ast.List, ast.Tuple)):
        values = [_number(x) for x in node.elts]
        if None in values or len(values) != 2:
            raise ProgramError("a list has two numbers")
        return values
    value = _number(node)
    if value is not None:
        return value
    return _expr(node, program, scope)


def _expr(node: ast.AST, program: Program, scope: tuple[str, str] | None):
    """``scope``: the lambda's variable and its kind."""
    match node:
        case ast.BoolOp():
            return Bool("and" if isinstance(node.op, ast.And) else "or", [_expr(v, program, scope) for v in node.values])
        case ast.UnaryOp(op=ast.Not()):
            return Bool("not", [_expr(node.operand, program, scope)])
        case ast.Name():
            if scope and node.id == scope[0] or node.id in program.kinds:
                return Var(node.id)
            raise ProgramError(f"unknown name {node.id}")
        case ast.Call(func=ast.Name(id=name)):
            if node.keywords:
                raise ProgramError(f"{name}: no keywords")
            if name in QUANTIFIERS:
                return _quant(name, node, program, scope)
            if name == "query" and len(node.args) == 1:
                return _expr(node.args[0], program, scope)
            call = Call(name, [_arg(a, program, scope) for a in node.args])
            _check(call, program, scope)
            return call
    raise ProgramError(f"not an expression: {ast.unparse(node)}")


def _quant(name: str, node: ast.Call, program: Program, scope) -> Quant:
    if scope:
        raise ProgramError("quantifiers don't nest")
    match node.args:
        case [ast.Name(id=kind), ast.Lambda() as f] if kind in (OBJECT, MOTION) and len(f.args.args) == 1:
            pass
        case _:
            raise ProgramError(f"{name}(Object|Motion, lambda v: ...) expected")
    if name == "all" and kind == MOTION:
        raise ProgramError("all ranges over objects")
    var = f.args.args[0].arg
    q = Quant(name, kind, var, _expr(f.body, program, (var, kind)))
    _check_body(q, program)
    return q


def _kind(arg, program: Program, scope) -> str | None:
    if isinstance(arg, Var):
        return scope[1] if scope and arg.name == scope[0] else program.kinds[arg.name]
    return None


def _check(call: Call, program: Program, scope) -> None:
    name, args = call.name, call.args
    kinds = [_kind(a, program, scope) for a in args]

    def need(*want) -> None:
        if len(args) != len(want) or any(w in (OBJECT, MOTION) and w != k for w, k in zip(want, kinds)):
            raise ProgramError(f"{name}: wrong arguments")

    if name in OBJECT_PREDICATES:
        need(OBJECT, str)
        if not isinstance(args[1], str) and not (isinstance(args[1], Call) and args[1].name in GETTERS):
            raise ProgramError(f"{name}: a text expected")
    elif name in MOTION_PREDICATES:
        need(MOTION, object)
        _check_motion(name, args[1], kinds[1])
    elif name in EXTENSIONS:
        need(EXTENSIONS[name], object)
    elif name in TEMPORAL_RELATIONS:
        need(MOTION, MOTION)
    elif name in SPATIAL_RELATIONS:
        need(OBJECT, OBJECT, str)
        if args[2] not in ("x", "y"):
            raise ProgramError(f"{name}: dimension x or y")
    elif name in REGIONS:
        need(OBJECT, OBJECT)
    elif name in GETTERS:
        need(MOTION if name in GETTERS[5:] else OBJECT)
    else:
        raise ProgramError(f"unknown predicate {name}")


def _check_motion(name: str, value, kind: str | None) -> None:
    text, number, pair = isinstance(value, str), isinstance(value, (int, float)), isinstance(value, list)
    getter = isinstance(value, Call) and value.name in GETTERS
    ok = {
        "type": text or getter, "direction": text or getter or pair and all(isinstance(v, (int, float)) for v in value), "magnitude": number or getter or pair and all(isinstance(v, (int, float)) for v in value),
        "origin": pair or getter, "duration": number or getter, "agent": kind == OBJECT or getter,
        "post": isinstance(value, Call) and (value.name in REGIONS or value.name in SPATIAL_RELATIONS) or getter,
    }[name]
    if not ok:
        raise ProgramError(f"{name}: wrong argument {value!r}")
    if name == "direction" and pair and not any(value):
        raise ProgramError("direction: a zero vector has none")
    if name == "origin" and pair and len({isinstance(v, str) for v in value}) > 1:
        raise ProgramError("origin: two percentages, or two numbers")


def resolve(value, program: Program):
    """What a motion getter stands for: the recorded argument of the variable."""
    if isinstance(value, Call) and value.name in GETTERS[5:]:
        found = program.info[value.args[0].name].get(value.name.removeprefix("get_"))
        if found is None:
            raise ProgramError(f"{value.args[0].name} has no {value.name.removeprefix('get_')}")
        return found
    return value


def _check_body(q: Quant, program: Program) -> None:
    """Order and shape rules: type comes before what depends on it; magnitudes fit the types."""
    mask = None
    todo = [q.body]
    while todo:
        x = todo.pop(0)
        if isinstance(x, Bool):
            todo = [*x.parts, *todo]
            continue
        if isinstance(x, Var):
            if x.name == q.var or program.kinds.get(x.name) != q.kind:
                raise ProgramError(f"{x.name} can't stand alone here")
            continue
        if isinstance(x, Call) and EXTENSIONS.get(x.name) == q.kind:
            continue
        if not isinstance(x, Call) or (q.kind == OBJECT) != (x.name in OBJECT_PREDICATES) or q.kind == MOTION and x.name not in MOTION_PREDICATES:
            raise ProgramError(f"not a predicate of {q.kind}")
        if x.name == "type":
            try:
                mask = parse_types(resolve(x.args[1], program))
            except ValueError as e:
                raise ProgramError(str(e)) from e
        elif x.name in ("direction", "magnitude", "duration") and mask is None:
            raise ProgramError(f"{x.name} comes after type")
        if x.name == "magnitude":
            value = resolve(x.args[1], program)
            if mask & SCALE and not isinstance(value, list) or mask & (TRANSLATE | ROTATE) and isinstance(value, list):
                raise ProgramError("magnitude: a pair for scaling, a number for others")
