"""Sets of closed integer intervals as tables, combined by boundary sweeps; and which interval relations hold between two sets of a group, without meeting their pairs.

A set is ``keys, s, e`` with disjoint intervals for each key. No operation lists the numbers that an interval covers: rows grow with intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.allen import INVERSE, RELATIONS, TOLERANCE, relation
from frameloom.operators.runs import merged

#: Mark of the universe in a sweep: above the bits of all sets.
UNIVERSE = 1 << 44
#: Groups of at most so many intervals a side are met pair by pair, which is linear in the rows too; larger ones are sorted.
FEW = 32
#: Relative part of the relations' tolerance.
RELATIVE = 1e-5


def segments(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, s, e, mask``: the stretches between boundaries, each with the sum of the ``bit`` of the intervals that cover it.

    ``marks``: keys, s, e, bit. Intervals of one bit are disjoint, so the sum is the set of bits. One shuffle on the keys, one sort.
    """
    ends = F.array(F.struct(F.col("s").cast("bigint").alias("p"), F.col("bit").alias("d")), F.struct((F.col("e") + 1).cast("bigint").alias("p"), (-F.col("bit")).alias("d")))
    rows = marks.where("s <= e").select(*keys, F.explode(ends).alias("x")).select(*keys, "x.p", "x.d")
    at = Window.partitionBy(*keys).orderBy("p")
    swept = rows.withColumn("mask", F.sum("d").over(at.rangeBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("p").over(at))
    return swept.where("next > p").select(*keys, F.col("p").alias("s"), (F.col("next") - 1).alias("e"), "mask")


def combined(sets: dict[str, DataFrame], universe: DataFrame, keys: Sequence[str], held: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """``keys, s, e``: where ``held`` is true of the sets' flags, within ``universe``, as maximal intervals. ``held`` may use and, or and not of at most 44 sets."""
    marks = [x.select(*keys, "s", "e", F.lit(1 << i).alias("bit")) for i, x in enumerate(sets.values())]
    swept = segments(reduce(DataFrame.unionByName, marks, universe.select(*keys, "s", "e", F.lit(UNIVERSE).alias("bit"))), keys)
    flag = {name: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(sets)}
    return merged(swept.where((F.col("mask").bitwiseAND(F.lit(UNIVERSE)) != 0) & held(flag)), list(keys))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merged(a.select(*keys, "s", "e").unionByName(b.select(*keys, "s", "e")), list(keys))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return combined({"b": b}, a, keys, lambda f: f["b"])


def complement(a: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    return combined({"a": a}, universe, keys, lambda f: ~f["a"])


# relations between sets


def _tolerance(target: Column) -> Column:
    return F.lit(TOLERANCE) + F.lit(RELATIVE) * F.abs(target)


def _precedes(a: DataFrame, b: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Extremes: the earliest end against the latest start."""
    first, last = a.groupBy(*keys).agg(F.min("e").alias("e")), b.groupBy(*keys).agg(F.max("s").alias("u"))
    return first.join(last, keys).where(F.col("e") + F.lit(gap) < F.col("u")).select(*keys)


def _contains(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A sweep by start with the greatest end so far; at equal starts, those of b come first, as they must start later."""
    rows = a.select(*keys, F.col("s").alias("at"), F.lit(1).alias("side"), "e").unionByName(b.select(*keys, F.col("s").alias("at"), F.lit(0).alias("side"), "e"))
    most = F.max(F.when(F.col("side") == 1, F.col("e"))).over(Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("most", most).where("side = 0 and most > e").select(*keys)


def _levels(n: int) -> int:
    return max(1, n.bit_length())


def _ranged(a: DataFrame, b: DataFrame, keys: list[str], by: str, queries: dict[str, tuple[Column, Column, bool]], levels: int) -> DataFrame:
    """``keys, s, e, q, some, least``: for each interval (s, e) of b and each query, whether an interval of a has its ``by`` in the query's range, and the least other end of those.

    ``queries``: from, to and whether both are included. Ranges of values become ranges of ranks in one sweep; a range of ranks is covered by two runs of a power of two, whose minima each row of
    a holds for all powers. Rows: those of a, and twice the queries of b.
    """
    other = "s" if by == "e" else "e"
    order = Window.partitionBy(*keys).orderBy(by, other)
    index = a.select(*keys, F.col(by).alias("at"), F.col(other).alias("m0"), (F.row_number().over(order) - 1).cast("bigint").alias("rank"))
    ranks = Window.partitionBy(*keys).orderBy("rank")
    for k in range(1, levels):
        index = index.withColumn(f"m{k}", F.least(f"m{k - 1}", F.lead(f"m{k - 1}", 1 << (k - 1)).over(ranks)))
    index = index.select(*keys, "rank", F.array(*[f"m{k}" for k in range(levels)]).alias("m"))
    ends = []
    for q, (low, high, closed) in queries.items():
        # of equal values, those in the range come after its lower and before its upper bound
        for side, value in (("low", low), ("high", high)):
            before = (side == "low") == closed
            ends.append(F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), value.cast("double").alias("at"), F.lit(0 if before else 2).alias("turn")))
    asked = b.select(*keys, "s", "e", F.explode(F.array(*ends)).alias("x")).select(*keys, "s", "e", "x.*")
    none = lambda kind: F.lit(None).cast(kind)
    rows = a.select(*keys, none("double").alias("s"), none("double").alias("e"), none("string").alias("q"), none("string").alias("side"), F.col(by).cast("double").alias("at"), F.lit(1).alias("turn"))
    found = asked.unionByName(rows).withColumn("n", F.sum((F.col("turn") == 1).cast("bigint")).over(Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)))
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("n")))
    spans = found.where("q is not null").groupBy(*keys, "s", "e", "q").agg(side("low").alias("low"), side("high").alias("high")).where("low < high")
    spans = spans.withColumn("k", F.length(F.bin(F.col("high") - F.col("low"))) - 1)
    part = F.explode(F.array_distinct(F.array("low", F.col("high") - F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k")))))
    hit = spans.withColumn("rank", part).join(index, [*keys, "rank"])
    return hit.groupBy(*keys, "s", "e", "q").agg(F.min(F.get("m", F.col("k"))).alias("least"))


def _one_way(a: DataFrame, b: DataFrame, keys: list[str], names: set[str], gap: float, levels: int) -> list[DataFrame]:
    """``keys, relation`` of the relations a has to b, of those that aren't swapped forms of others."""
    named = lambda rows, name: rows.select(*keys, F.lit(name).alias("relation"))
    s, e = F.col("s"), F.col("e")
    near = lambda c: (c - _tolerance(c), c + _tolerance(c), True)
    out = []
    if "precedes" in names:
        out.append(named(_precedes(a, b, keys, gap), "precedes"))
    if "contains" in names:
        out.append(named(_contains(a, b, keys), "contains"))
    by_end = {n: q for n, q in {"meets": near(s), "overlaps": (s, e, False), "finished_by": near(e)}.items() if n in names}
    if by_end:
        found = _ranged(a, b, keys, "e", by_end, levels)
        out.append(found.where((F.col("q") == "meets") | (F.col("least") < s)).select(*keys, F.col("q").alias("relation")))
    if "starts" in names:
        out.append(named(_ranged(a, b, keys, "s", {"starts": near(s)}, levels).where(F.col("least") < e), "starts"))
    return out


def _equals(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells about as wide as the tolerance, on both ends: an interval meets those of the nine cells around its own, and the first that is close ends the search."""
    # a scale on which the tolerance, which grows with the number, is at most 1
    scale = lambda c: F.floor(F.signum(c) * F.log1p(F.abs(c) * F.lit(RELATIVE / TOLERANCE)) / F.lit(RELATIVE) * F.lit(1 - 2 * RELATIVE)).cast("bigint")
    around = lambda c: F.explode(F.array(*[scale(c) + i for i in (-1, 0, 1)]))
    cells = a.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("s").alias("as"), F.col("e").alias("ae"), scale(F.col("s")).alias("cs"), scale(F.col("e")).alias("ce"))
    rows = b.withColumn("bs", around(F.col("s"))).withColumn("be", around(F.col("e")))
    close = (F.abs(F.col("as") - F.col("s")) <= _tolerance(F.col("s"))) & (F.abs(F.col("ae") - F.col("e")) <= _tolerance(F.col("e")))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in keys], (F.col("bs") == F.col("cs")) & (F.col("be") == F.col("ce")))
    return rows.join(cells, same & close, "left_semi").select(*keys)


def _pairs(a: DataFrame, b: DataFrame, keys: list[str], names: Sequence[str], gap: float) -> DataFrame:
    """All pairs of small groups."""
    both = a.join(b.select(*keys, F.col("s").alias("u"), F.col("e").alias("v")), keys)
    sides = (F.col("s"), F.col("e")), (F.col("u"), F.col("v"))
    held = [F.max(relation(n, *sides, gap=gap)).alias(n) for n in names]
    return both.groupBy(*keys).agg(*held).select(*keys, F.explode(F.array(*[F.when(F.col(n), F.lit(n)) for n in names])).alias("relation")).where("relation is not null")


def related(a: DataFrame, b: DataFrame, keys: Sequence[str], names: Sequence[str] = RELATIONS, gap: float = 0.0, few: int = FEW) -> DataFrame:
    """``keys, relation``: the relations of ``names`` that some interval of ``a`` has to some interval of ``b`` with the same keys (``keys, s, e`` both; finite ends, start before or at end).

    Same results as testing every pair with :func:`frameloom.functions.allen.relation`, in sorts of each side: precedes by extremes; contains by a prefix maximum; meets, overlaps,
    finished_by and starts by minima over ranges of ranks; equals by cells of the tolerance's width; the others by swapping sides. Intervals that are equal count once.
    """
    keys = list(keys)
    a, b = (x.select(*keys, F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e")).where("s <= e").distinct() for x in (a, b))
    swapped = {INVERSE[n]: n for n in names if n in INVERSE}
    plain = {n for n in names if n not in INVERSE}
    levels = 1
    if (plain | set(swapped)) - {"precedes"}:
        sizes = a.groupBy(*keys).count().unionByName(b.groupBy(*keys).count())
        largest = sizes.agg(F.max("count")).first()[0] or 1
        if largest <= few:
            return _pairs(a, b, keys, names, gap)
        levels = _levels(largest)
    out = _one_way(a, b, keys, plain, gap, levels)
    for rows in _one_way(b, a, keys, set(swapped), gap, levels):
        back = F.create_map(*[F.lit(x) for pair in swapped.items() for x in pair])
        out.append(rows.select(*keys, back[F.col("relation")].alias("relation")))
    if "equals" in plain:
        out.append(_equals(a, b, keys).select(*keys, F.lit("equals").alias("relation")))
    return reduce(DataFrame.unionByName, out).distinct()
