"""Nearest-time search, run statistics, sampling and deduplication by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_point(positions: DataFrame, targets: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Positions (``keys, time, x, y``) within a distance of a target (``keys, target, x, y``): ``keys, target, time, error``. An equi join on the keys."""
    t = targets.select(*keys, "target", F.col("x").alias("__x"), F.col("y").alias("__y"))
    error = F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)
    return positions.join(t, keys).withColumn("error", error).where(F.col("error") <= tolerance).select(*keys, "target", "time", "error")


#: Samples a second of a point query.
POINT_RATE = 2400.0


def points_in_time(tweens: DataFrame, scenes: DataFrame, objects: DataFrame, targets: DataFrame, tolerance: float = 0.1, rate: float = POINT_RATE) -> DataFrame:
    """``scene_id, obj_id, matches``: the samples at which an object's centre is within ``tolerance`` of a target; null for ids that no scene has.

    ``tweens``: scene_id, obj_id, begin, seconds, dx, dy (linear moves); ``objects``: scene_id, obj_id, x, y (rest centres); ``targets``: scene_id, obj_id, x, y. Between the ends of an object's tweens its
    centre moves on a line, so the distance to a target is within the tolerance between the roots of a quadratic. Only the samples between them, and one more on either side, are listed and tested; the others
    of a scene's clock never become rows.
    """
    move = "struct<begin:double,seconds:double,dx:double,dy:double>"
    own = tweens.groupBy("scene_id", "obj_id").agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("begin", "seconds", "dx", "dy")])).alias("own"))
    asked = targets.select("scene_id", "obj_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = asked.join(objects.select("scene_id", "obj_id", "x", "y"), ["scene_id", "obj_id"]).join(own, ["scene_id", "obj_id"], "left").join(scenes.select("scene_id", F.col("duration").cast("double").alias("duration")), "scene_id")
    rows = rows.where("duration is not null").withColumn("own", F.coalesce("own", F.array().cast(f"array<{move}>")))
    # pieces: from one end of a tween to the next, within the scene
    ends = F.concat(F.array(F.lit(0.0), F.col("duration")), F.transform("own", lambda m: m["begin"]), F.transform("own", lambda m: m["begin"] + F.coalesce(m["seconds"], F.lit(0.0))))
    cuts = F.array_sort(F.array_distinct(F.filter(ends, lambda t: (t >= 0) & (t <= F.col("duration")))))
    rows = rows.withColumn("cuts", cuts).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.size("cuts") - 2, F.lit(0)))))
    rows = rows.select("scene_id", "obj_id", "x", "y", "tx", "ty", "own", "duration", F.get("cuts", F.col("piece")).alias("since"), F.coalesce(F.get("cuts", F.col("piece") + 1), F.get("cuts", F.col("piece"))).alias("until"))
    part = lambda m, t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(t - m["begin"], m["seconds"]), F.when(t >= m["begin"], 1.0).otherwise(0.0))))
    middle = (F.col("since") + F.col("until")) / 2

    def along(s: Column, m: Column) -> Column:
        """Adds a move's place at the piece's beginning, and its speed if it goes on over the piece."""
        done = part(m, F.col("since"))
        rate_ = F.when((m["begin"] <= middle) & (middle < m["begin"] + m["seconds"]), F.try_divide(F.lit(1.0), m["seconds"])).otherwise(0.0)
        return F.struct((s["px"] + m["dx"] * done).alias("px"), (s["py"] + m["dy"] * done).alias("py"), (s["vx"] + m["dx"] * rate_).alias("vx"), (s["vy"] + m["dy"] * rate_).alias("vy"))

    start = F.struct((F.col("x") - F.col("tx")).alias("px"), (F.col("y") - F.col("ty")).alias("py"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    rows = rows.withColumn("z", F.aggregate("own", start, along)).select("*", "z.*").drop("z")
    # |p + v t| <= r for t from the piece's beginning on, with a margin for rounding
    r = F.lit(tolerance * (1 + 1e-9)) + F.lit(1e-9) * (F.abs("px") + F.abs("py") + F.abs("tx") + F.abs("ty"))
    rows = rows.withColumns({"qa": F.col("vx") ** 2 + F.col("vy") ** 2, "qb": F.col("px") * F.col("vx") + F.col("py") * F.col("vy"), "qc": F.col("px") ** 2 + F.col("py") ** 2 - r * r})
    inner = F.col("qb") ** 2 - F.col("qa") * F.col("qc")
    root = F.sqrt(F.greatest(inner, F.lit(0.0)))
    far = F.col("until") - F.col("since")
    low = F.when(F.col("qa") > 0, F.greatest(F.lit(0.0), (-F.col("qb") - root) / F.col("qa"))).otherwise(0.0)
    high = F.when(F.col("qa") > 0, F.least(far, (root - F.col("qb")) / F.col("qa"))).otherwise(far)
    rows = rows.where(F.when(F.col("qa") > 0, inner >= 0).otherwise(F.col("qc") <= 0)).withColumns({"low": low, "high": high}).where("low <= high")
    last = F.ceil(F.col("duration") * rate)
    first_tick, last_tick = F.greatest(F.lit(0).cast("long"), F.floor((F.col("since") + F.col("low")) * rate) - 1), F.least(last, F.ceil((F.col("since") + F.col("high")) * rate) + 1)
    ticks = rows.where(first_tick <= last_tick).select("scene_id", "obj_id", "x", "y", "tx", "ty", "own", "since", "until", "duration", F.explode(F.sequence(first_tick, last_tick)).alias("i"))
    ticks = ticks.withColumn("time", F.least(F.col("i") / rate, F.col("duration"))).where("time >= since and (time < until or until >= duration)")  # each sample in one piece
    at = lambda rest, d: F.col(rest) + F.aggregate("own", F.lit(0.0), lambda s, m: s + m[d] * part(m, F.col("time")))
    error = F.hypot(at("x", "dx") - F.col("tx"), at("y", "dy") - F.col("ty"))
    hits = ticks.withColumn("error", error).where(F.col("error") <= tolerance).groupBy("scene_id", "obj_id").agg(F.array_sort(F.collect_list(F.struct("time", "error"))).alias("found"))
    known = objects.select("scene_id", "obj_id", F.lit(True).alias("known"))
    none = F.array().cast("array<struct<time:double,error:double>>")
    out = targets.select("scene_id", "obj_id").distinct().join(known, ["scene_id", "obj_id"], "left").join(hits, ["scene_id", "obj_id"], "left")
    return out.select("scene_id", "obj_id", F.when(F.col("known"), F.coalesce("found", none)).alias("matches"))


def best_match(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The match of least error (then least time) for each target."""
    return matches.groupBy(*keys, "target").agg(F.min(F.struct("error", "time")).alias("m")).select(*keys, "target", F.col("m.time").alias("time"), F.col("m.error").alias("error"))


def turns(messages: DataFrame, run: str, role: str = "role") -> DataFrame:
    """``run, turns``: assistant messages of each run."""
    return messages.groupBy(run).agg(F.count_if(F.col(role) == "assistant").alias("turns"))


def pass_rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """Pass statistics of runs (``turns, has_error, has_success, has_fail``) by group; runs with an error or without turns are left out of the rest."""
    return runs.groupBy(*by).agg(*pass_columns())


def pass_columns() -> list[Column]:
    """The aggregates of :func:`pass_rates`."""
    bad = F.col("has_error") | F.col("turns").isNull()
    late = ~bad & F.col("has_success") & (F.col("turns") > 1)
    total, first = F.count_if(~bad), F.count_if(~bad) - F.count_if(~bad & (F.col("turns") > 1))
    fail = F.count_if(~bad & ~F.col("has_success") & F.col("has_fail"))
    iterations = F.when(late, F.col("turns"))
    return [
        F.count_if(bad).alias("n_error"), total.alias("n_total"), first.alias("pass_0"), F.count_if(late).alias("pass_1plus"), fail.alias("n_fail"),
        F.round(F.try_divide(F.lit(100.0) * first, total), 6).alias("pass_0_pct"), F.round(F.avg(iterations), 6).alias("avg_iter"), F.coalesce(F.min(iterations), F.lit(0)).alias("min_iter"), F.coalesce(F.max(iterations), F.lit(0)).alias("max_iter"),
    ]


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def sample_groups(rows: DataFrame, keys: list[str], rank: Column, most: int, tie: str) -> DataFrame:
    """At most so many rows of each group, those of least rank."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, tie))).where(F.col("__n") <= most).drop("__n")


def mix(generated: DataFrame, rewritten: DataFrame, n_generated: int, n_rewritten: int, rank, tie: str) -> DataFrame:
    """A data set of so many rows of each source by rank; missing rewrites are made up by generated rows that weren't taken."""
    top = lambda df, n: df.orderBy(rank, tie).limit(n)
    some = top(rewritten, n_rewritten)
    taken = top(generated, n_generated)
    short = n_rewritten - some.count()
    out = taken.withColumn("kind", F.lit("generated")).unionByName(some.withColumn("kind", F.lit("rewritten")))
    if short > 0:
        out = out.unionByName(top(generated.join(taken.select(tie), tie, "left_anti"), short).withColumn("kind", F.lit("padding")))
    return out


def prompted(runs: DataFrame, prompts: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """Runs whose name is one of the prompts' and begins with a prefix."""
    return runs.where(F.col(name).startswith(prefix)).join(prompts.select(name), name, "left_semi")


def run_order(name: Column) -> Column:
    """What runs are ordered by: the parts of their name from the third on."""
    return F.slice(F.split(name, "_"), 3, F.greatest(F.size(F.split(name, "_")), F.lit(1)))


def log_runs(events: DataFrame) -> DataFrame:
    """``run, turns, has_error, has_success, has_fail`` from logged rows (``run, kind, role``): kind is chat, success, fail or error; a run without a chat is an error."""
    kind = F.col("kind")
    seen = [F.max(F.coalesce(kind == k, F.lit(False))) for k in ("error", "success", "fail", "chat")]
    out = events.groupBy("run").agg(F.count_if((kind == "chat") & (F.col("role") == "assistant")).alias("turns"), (seen[0] | ~seen[3]).alias("has_error"), seen[1].alias("has_success"), seen[2].alias("has_fail"))
    return out.withColumn("turns", F.when(F.col("turns") > 0, F.col("turns")))


def grand_total(runs: DataFrame, by: str) -> DataFrame:
    """Pass statistics by group and, where ``by`` is null, of all groups: one rollup."""
    return runs.rollup(by).agg(*pass_columns())


def property_differences(a: DataFrame, b: DataFrame, on: list[str], tolerance: float) -> DataFrame:
    """Numeric comparison of two property series: ``on, same``."""
    rows = a.join(b.withColumnRenamed("value", "other"), on, "full")
    return rows.select(*on, F.coalesce(F.abs(F.col("value") - F.col("other")) <= tolerance, F.lit(False)).alias("same"))


def equal_values(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Comparison by equality: ``on, same``; a missing side is not equal to anything, two nulls are equal."""
    rows = a.withColumn("__a", F.lit(True)).join(b.withColumnRenamed("value", "other").withColumn("__b", F.lit(True)), on, "full")
    return rows.select(*on, (F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("value").eqNullSafe(F.col("other"))).alias("same"))


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes (left, right, top, bottom); 0 where they don't meet."""
    wide = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    high = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    area = lambda x: (x["right"] - x["left"]) * (x["bottom"] - x["top"])
    return F.coalesce(F.try_divide(wide * high, area(a) + area(b) - wide * high), F.lit(0.0))
