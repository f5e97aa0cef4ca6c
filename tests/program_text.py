"""Program text of one scene graph, written plainly: what the columns of ``generate.programs`` must give."""

from __future__ import annotations

import json

from frameloom.operators.generate import RELATION_CALLS


def literal(value) -> str:
    """A value as it stands in a program."""
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) or isinstance(value, list) and any(isinstance(v, str) for v in value) else str(value)


def program(motions: list[dict]) -> str:
    """Program text of one scene graph. Each motion: relation (to the one before), type, agents, and magnitude, direction, origin, duration, post, post_reference or None.

    A motion tied to no other by a relation is an existence statement, others are variables that the relations name.
    """
    objects: list[tuple] = []
    for m in motions:
        for o in [*m.get("agents", []), *(m.get("post_reference") or [])]:
            if (key := tuple(sorted(o.items()))) not in objects:
                objects.append(key)
    name = lambda o: f"o_{objects.index(tuple(sorted(o.items()))) + 1}"
    lines = []
    for i, key in enumerate(objects, 1):
        tests = [f"{call}(o, {literal(v)})" for call, v in (("color", dict(key).get("fill")), ("shape", dict(key).get("shape")), ("id", dict(key).get("id"))) if v]
        lines.append(f"o_{i} = iota(Object, lambda o: {' and '.join(tests)})")
    blocks, order = ["\n".join(lines)], []
    own = []
    for i, m in enumerate(motions):
        alone = not m.get("relation") and not (i + 1 < len(motions) and motions[i + 1].get("relation"))
        var = f"m_{i + 1}" if alone else "m"
        tests = [f"type({var}, {literal(m['type'])})"]
        if (d := m.get("direction")) is not None:
            if m["type"] == "rotate":
                d = "clockwise" if (d[0] if isinstance(d, list) else d) > 0 else "counterclockwise"
            tests.append(f"direction({var}, {literal(d)})")
        agents = [name(o) for o in m.get("agents", [])]
        for call in ("magnitude", "origin"):
            if (v := m.get(call)) is not None:
                tests.append(f"{call}({var}, {literal(v)})")
        if m.get("post") and m.get("post_reference"):
            tests.append(f"post({var}, s_{m['post'].replace('ing', '')}({agents[0]}, {name(m['post_reference'][0])}))")
        if (v := m.get("duration")) is not None:
            tests.append(f"duration({var}, {literal(v)})")
        tests += [f"agent({var}, {a})" for a in agents[:1]]
        body = " and ".join(tests)
        own.append(f"exists(Motion, lambda {var}: {body})" if alone else f"m_{i + 1} = iota(Motion, lambda {var}: {body})")
        if m.get("relation"):
            order.append(f"{RELATION_CALLS[m['relation']]}(m_{i}, m_{i + 1})")
    return "\n\n".join([*blocks, "\n".join(own), *(["\n".join(order)] if order else [])])
