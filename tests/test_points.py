"""Point queries by pieces against every sample of the clock."""

from __future__ import annotations

import math
import random

from frameloom.operators import analytics


def brute(tweens, seconds, rest, target, tolerance, rate):
    out = []
    n = math.ceil(seconds * rate)
    for i in range(n + 1):
        t = min(i / rate, seconds)
        x, y = rest
        for begin, length, dx, dy in tweens:
            part = max(0.0, min(1.0, (t - begin) / length)) if length else float(t >= begin)
            x, y = x + dx * part, y + dy * part
        error = math.hypot(x - target[0], y - target[1])
        if error <= tolerance:
            out.append((t, error))
    return out


def test_pieces_equal_every_sample(spark):
    rng = random.Random(4)
    tweens, scenes, objects, targets, want = [], [], [], [], {}
    for k in range(60):
        seconds = rng.choice([0.5, 1.0, 1.2345, 0.01])
        own = [(rng.choice([0.0, 0.1, 0.25, rng.random(), -0.2]), rng.choice([0.0, 0.25, 0.5, rng.random()]), rng.choice([0.0, 10.0, -7.5]), rng.choice([0.0, 3.0, 20.0])) for _ in range(rng.randrange(5))]
        tweens += [(k, "a", *m) for m in own]
        scenes.append((k, seconds))
        objects.append((k, "a", 1.0, 2.0))
        target = rng.choice([(1.0, 2.0), (6.0, 2.0), (6.0, 5.0), (1.0 + 10 * rng.random(), 2.0 + 3 * rng.random())])
        targets.append((k, "a" if k % 7 else "none", *target))
        want[k] = brute(own, seconds, (1.0, 2.0), target, 0.3, 240.0) if k % 7 else None
    make = spark.createDataFrame
    out = analytics.points_in_time(
        make(tweens, "scene_id int, obj_id string, begin double, seconds double, dx double, dy double"), make(scenes, "scene_id int, duration double"),
        make(objects, "scene_id int, obj_id string, x double, y double"), make(targets, "scene_id int, obj_id string, x double, y double"), 0.3, 240.0,
    )
    got = {r.scene_id: None if r.matches is None else [(m.time, m.error) for m in r.matches] for r in out.collect()}
    assert set(got) == set(want)
    for k, rows in want.items():
        assert (got[k] is None) == (rows is None)
        if rows is not None:
            assert [t for t, _ in got[k]] == [t for t, _ in rows] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[k], rows))
    assert sum(len(v or ()) for v in want.values()) > 200
