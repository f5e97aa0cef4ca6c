"""Sentence composition: phrases of a motion's parts, their products, and the rules that pairs of sentences follow.

Phrases are arrays of texts, one for each way to say a part; an array with a null says that the part is left out. Everything is a column over a table of motions, so products
are explosions of a row's own arrays, never joins. The vocabulary is a small mapping from a path (``directions/left/ADV``) to its words.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import clean_commas, format_number
from frameloom.operators.dealing import by_keys

#: Words of the default vocabulary.
VOCABULARY: dict[str, tuple[str, ...]] = {
    "directions/right/ADV": ("rightward",), "directions/right/PHRASE": ("to the right",), "directions/left/ADV": ("leftward",), "directions/left/PHRASE": ("to the left",),
    "directions/up/ADV": ("upward",), "directions/up/PHRASE": ("toward the top",), "directions/down/ADV": ("downward",), "directions/down/PHRASE": ("toward the bottom",),
    "directions/clockwise/ADV": ("clockwise",), "directions/clockwise/PHRASE": ("in a clockwise direction",),
    "directions/counterclockwise/ADV": ("counterclockwise",), "directions/counterclockwise/PHRASE": ("in a counterclockwise direction",),
    "directions/scale_up/ADV": ("up",), "directions/scale_down/ADV": ("down",), "directions/both-x-y/ADV": ("uniformly",), "directions/both-x-y/PHRASE": ("in both directions",),
    "directions/x-axis/ADV": ("horizontally",), "directions/x-axis/PHRASE": ("along the x-axis",), "directions/y-axis/ADV": ("vertically",), "directions/y-axis/PHRASE": ("along the y-axis",),
    "motions/translate/VERB": ("move", "shift"), "motions/rotate/VERB": ("rotate", "turn"), "motions/scale/VERB": ("scale",),
    "motions/translate/VERB_UP": ("rise",), "motions/translate/VERB_DOWN": ("drop", "fall"), "motions/rotate/VERB_CENTER": ("spin",),
    "motions/scale/VERB_UP": ("enlarge", "grow"), "motions/scale/VERB_DOWN": ("shrink",), "motions/scale/VERB_UP_SINGLE": ("stretch",), "motions/scale/VERB_DOWN_SINGLE": ("compress",),
    "magnitude/PREP": ("by",), "duration/PREP": ("for", "over"), "origin/PREP": ("about", "around"),
}
NOTHING = "cast(array(null) as array<string>)"


def words(vocabulary: Mapping[str, Sequence[str]], *paths: str) -> Column:
    """The words of some paths as one array; a path that the vocabulary lacks has none."""
    found = [w for p in paths for w in vocabulary.get(p, ())]
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")


def nothing() -> Column:
    return F.expr(NOTHING)


def times(first: Column, second: Column, join) -> Column:
    """All pairs of two arrays, the second's elements fastest."""
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: join(a, b))))


def object_phrase(objects: Column) -> Column:
    """``the <fill> <shape>`` for each of an array of objects, joined by ``and``."""
    one = lambda o: F.concat_ws(" ", F.lit("the"), o["fill"], o["shape"])
    return F.array(F.array_join(F.transform(objects, one), " and "))


def verbs(kind: Column, vocabulary: Mapping = VOCABULARY) -> Column:
    """Verbs of a motion type."""
    return reduce(lambda out, k: F.when(kind == k, words(vocabulary, f"motions/{k}/VERB")).otherwise(out), ("translate", "rotate", "scale"), F.array().cast("array<string>"))


def direction_parts(kind: Column, x: Column, y: Column, vocabulary: Mapping = VOCABULARY, axis_only: bool = False) -> tuple[Column, Column]:
    """Direction phrases for x and y.

    Translation: a word or phrase for the sign of each axis. Rotation: (counter)clockwise by the sign of x. Scaling: up or down, each with an axis phrase or, where
    both axes change alike, also alone. ``axis_only`` leaves up and down out (they are in the verb).
    """
    both = lambda name: words(vocabulary, f"directions/{name}/ADV", f"directions/{name}/PHRASE")
    signed = lambda v, more, less: F.when(v > 0, both(more)).when(v < 0, both(less)).otherwise(nothing())
    said = lambda name: [w for way in ("ADV", "PHRASE") for w in vocabulary.get(f"directions/{name}/{way}", ())]

    def along(v: Column, axes: Sequence[str]) -> Column:
        """The words of a sign, each with each axis phrase; an empty one says nothing."""
        def way(name: str) -> Column:
            pairs = [(a, b) for a in vocabulary.get(f"directions/{name}/ADV", ()) for b in axes]
            found = [((None if axis_only else a) if b == "" else b if axis_only else f"{a} {b}") for a, b in pairs]
            return F.array(*map(F.lit, found)).cast("array<string>")

        return F.when(v > 0, way("scale_up")).when(v < 0, way("scale_down")).otherwise(nothing())

    equal = [*said("both-x-y"), ""]
    scale_x = F.when(x == y, along(x, equal)).otherwise(along(x, said("x-axis")))
    scale_y = F.when(x == y, nothing()).otherwise(along(y, said("y-axis")))
    out_x = F.when(x.isNull(), nothing()).when(kind == "translate", signed(x, "right", "left")).when(kind == "rotate", signed(x, "clockwise", "counterclockwise")).otherwise(scale_x)
    out_y = F.when(x.isNull() | (kind == "rotate"), nothing()).when(kind == "translate", signed(y, "up", "down")).otherwise(scale_y)
    return out_x, out_y


def axis_magnitudes(size: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A magnitude along a direction, for each axis; null where size or direction is missing or nothing."""
    length = F.sqrt(x * x + y * y)
    return tuple(F.when((size != 0) & (length > 0), F.abs(v) * size / length) for v in (x, y))


def magnitude_parts(kind: Column, size_x: Column, size_y: Column, vocabulary: Mapping = VOCABULARY) -> tuple[Column, Column]:
    """Magnitude phrases for x and y: pixels, degrees (also as an angle) or plain factors. ``size_y`` is null where one size serves both axes."""
    unit = F.when(kind == "translate", " px").when(kind == "rotate", " degrees").otherwise("")

    def said(v: Column) -> Column:
        plain = F.array(*[F.concat(F.lit(f"{p} "), format_number(v), unit) for p in vocabulary.get("magnitude/PREP", ())]).cast("array<string>")
        angle = F.array(F.concat(F.lit("through an angle of "), format_number(v), unit))
        return F.when(v.isNull(), nothing()).when(kind == "rotate", F.concat(plain, angle)).when(v == 0, nothing()).otherwise(plain)

    same = (kind == "scale") & (size_x == size_y)
    return said(size_x), F.when(size_y.isNull() | same, nothing()).otherwise(said(size_y))


def duration_phrases(seconds: Column, vocabulary: Mapping = VOCABULARY) -> Column:
    """``<preposition> <n> second(s)``."""
    said = F.array(*[F.concat(F.lit(f"{p} "), format_number(seconds), F.when(seconds == 1, " second").otherwise(" seconds")) for p in vocabulary.get("duration/PREP", ())]).cast("array<string>")
    return F.when(seconds.isNull(), nothing()).otherwise(said)


def origin_phrases(origin: Column, vocabulary: Mapping = VOCABULARY) -> Column:
    """``<preposition> its center`` for the middle, else its percentages or pixels."""
    at = F.when((F.get(origin, F.lit(0)) == "50%") & (F.get(origin, F.lit(1)) == "50%"), F.lit("its center")).otherwise(F.concat(F.lit("the point ("), F.array_join(origin, ", "), F.lit(")")))
    return F.when(origin.isNull(), nothing()).otherwise(F.array(*[F.concat(F.lit(f"{p} "), at) for p in vocabulary.get("origin/PREP", ())]).cast("array<string>"))


def post_phrases(relation: Column, reference: Column) -> Column:
    """How the motion ends: ``until it is <relation> <object>``."""
    return F.when(relation.isNull(), nothing()).otherwise(F.transform(object_phrase(reference), lambda o: F.concat(F.lit("until it is "), F.translate(relation, "_", " "), F.lit(" "), o)))


def composed(directions: tuple[Column, Column], magnitudes: tuple[Column, Column]) -> Column:
    """Direction with magnitude for each axis, and both axes joined by ``and``; what is missing on one side is left out, and null is said where both are."""
    def axis(d: Column, m: Column) -> Column:
        said = F.filter(times(d, m, lambda a, b: F.nullif(F.concat_ws(" ", a, b), F.lit(""))), lambda s: s.isNotNull())
        return F.when(F.size(said) == 0, nothing()).otherwise(said)

    return times(axis(directions[0], magnitudes[0]), axis(directions[1], magnitudes[1]), lambda a, b: F.nullif(F.concat_ws(" and ", a, b), F.lit("")))


def resolved(x: Column, y: Column) -> Column:
    """Phrases of the one axis that has some; null where both have, or none."""
    none = lambda c: (F.size(c) == 1) & F.get(c, F.lit(0)).isNull()
    return F.when(~none(x) & none(y), x).when(none(x) & ~none(y), y).otherwise(nothing())


def conflated_verbs(kind: Column, x: Column, y: Column, origin: Column, vocabulary: Mapping = VOCABULARY) -> Column:
    """Verbs that say the direction themselves; an empty array where there is none.

    Scaling: up or down where both axes go alike, also single-axis verbs where one axis rests. Rotation about the middle. Translation mainly up (y > 0 and x < y) or down (y < 0 and x > y).
    """
    sx, sy = F.signum(x), F.signum(y)
    v = lambda *names: words(vocabulary, *[f"motions/{n}" for n in names])
    single = lambda s: (sx == s) & (sy == 0) | (sx == 0) & (sy == s)
    scale = F.when((sx > 0) & (sy > 0), v("scale/VERB_UP")).when((sx < 0) & (sy < 0), v("scale/VERB_DOWN")).when(single(1), v("scale/VERB_UP", "scale/VERB_UP_SINGLE")).when(single(-1), v("scale/VERB_DOWN", "scale/VERB_DOWN_SINGLE"))
    centre = F.coalesce((F.get(origin, F.lit(0)) == "50%") & (F.get(origin, F.lit(1)) == "50%"), F.lit(False))
    moved = F.when((y > 0) & (x < y), v("translate/VERB_UP")).when((y < 0) & (x > y), v("translate/VERB_DOWN"))
    found = F.when(kind == "scale", scale).when((kind == "rotate") & centre, v("rotate/VERB_CENTER")).when(kind == "translate", moved)
    return F.coalesce(found, F.array().cast("array<string>"))


def units(motions: DataFrame, vocabulary: Mapping = VOCABULARY) -> DataFrame:
    """The parts of every motion's sentences: ``unit, slots`` (array of phrase arrays: object, verb, then modifiers) and ``sequence`` (names of the modifiers) are added.

    ``motions``: type, x, y (direction), size_x, size_y (magnitude), origin, duration, post, agents, post_reference. Unit 0 is the plain one; units 1 and 2 have conflated verbs, where there are some.
    """
    kind, x, y, origin, no = (F.col(c) for c in ("type", "x", "y", "origin", "unit"))
    numbers = lambda *n: F.array(*map(F.lit, n))
    # the units are listed by their numbers; what only some of them say is worked out for those alone, each part once
    listed = F.when(F.size("__strong") == 0, numbers(0)).when(kind == "scale", numbers(0, 1, 2)).otherwise(numbers(0, 1))
    rows = motions.withColumn("__strong", conflated_verbs(kind, x, y, origin, vocabulary)).withColumn("unit", F.explode(listed))
    pair = lambda names, columns: dict(zip(names, columns, strict=True))
    axes, sizes = ("__dx", "__dy"), ("__mx", "__my")
    rows = rows.withColumns(pair(axes, direction_parts(kind, x, y, vocabulary)) | pair(sizes, magnitude_parts(kind, F.col("size_x"), F.col("size_y"), vocabulary)))
    own = pair(("__ax", "__ay"), [F.when((no > 0) & (kind == "scale"), c).otherwise(nothing()) for c in direction_parts(kind, x, y, vocabulary, axis_only=True)])
    rows = rows.withColumns({
        "__d": resolved(F.col("__dx"), F.col("__dy")), "__m": resolved(F.col("__mx"), F.col("__my")), "__who": object_phrase(F.col("agents")), "__about": origin_phrases(origin, vocabulary),
        "__lasting": duration_phrases(F.col("duration"), vocabulary), "__end": post_phrases(F.col("post"), F.col("post_reference")), **own,
    })
    bare = F.when((no > 0) & (kind != "rotate"), composed((F.col("__ax"), F.col("__ay")), (F.col("__mx"), F.col("__my"))))
    said = lambda *n: F.array("__who", "__strong", *[bare if c == "bare" else F.col(f"__{c}") for c in n])
    names = lambda *n: F.array(*map(F.lit, n))
    pick = lambda plain, spun, moved, first, second: F.when(no == 0, plain).when(kind == "rotate", spun).when(kind == "translate", moved).when(no == 1, first).otherwise(second)
    slots = pick(F.array(F.col("__who"), verbs(kind, vocabulary), *map(F.col, ("__d", "__m", "__about", "__lasting", "__end"))), said("d", "m", "end", "lasting"), said("bare", "about", "end", "lasting"), said("bare", "end", "about", "lasting"), said("bare", "end", "lasting", "about"))
    sequence = pick(
        names("direction", "magnitude", "origin", "duration", "post"), names("direction", "magnitude", "post", "duration"), names("magnitude", "origin", "post", "duration"),
        names("direction_magnitude", "post", "origin", "duration"), names("direction_magnitude", "post", "duration", "origin"),
    )
    return rows.select(*motions.columns, "unit", slots.alias("slots"), sequence.alias("sequence"))


#: A prime, as the step between the numbers that are drawn.
STEP = 1_000_003


def stride(total: Column) -> Column:
    """A step that shares no factor with the total, so that numbers drawn by it don't repeat."""
    return F.when(total % STEP == 0, F.lit(1)).otherwise(F.lit(STEP))


def slot_product(rows: DataFrame, slots: str, keys: list[str], most: int, seed: int = 0, start: Column | None = None) -> DataFrame:
    """One row for each choice of a phrase from every slot (``choice``: an array), at most ``most`` for each key.

    Choices are numbered in mixed radix, so a larger product is never listed: ``most`` numbers are drawn from it without repetition, by a stride that shares no factor with the
    product, from ``start`` on (an integer column; by default a hash of the keys).
    """
    sizes = F.transform(F.col(slots), F.size)
    total = F.aggregate(sizes, F.lit(1).cast("long"), lambda s, n: s * n)
    radix = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, i + 2, F.size(sizes)), F.lit(1).cast("long"), lambda s, m: s * m))
    first = F.pmod(F.xxhash64(*keys, F.lit(seed)) if start is None else start.cast("long"), F.col("__total"))
    number = F.when(F.col("__total") <= most, F.col("__i")).otherwise(F.pmod(first + F.col("__i") * stride(F.col("__total")), F.col("__total")))
    each = rows.withColumns({"__total": total, "__radix": radix, "__sizes": sizes}).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("__total", F.lit(most)) - 1)))
    each = each.where("__total > 0").withColumn("__n", number)
    choice = F.transform(F.col(slots), lambda s, i: F.get(s, (F.col("__n") / F.get("__radix", i)).cast("long") % F.get("__sizes", i)))
    return each.withColumn("choice", choice).select(*rows.columns, F.col("__n").alias("choice_no"), "choice")


def infix_allowed(infix: Column) -> Column:
    """At most one phrase stands between object and verb, and it is a phrase."""
    return (F.size(infix) == 0) | ((F.size(infix) == 1) & F.get(infix, F.lit(0)).isNotNull())


def direction_adjacent(kind: Column, sequence: Column) -> Column:
    """Whether, in sentences of other motions than translations, the direction directly follows the object or the verb."""
    place = lambda name: F.array_position(sequence, F.lit(name))
    at = F.when(place("direction") > 0, place("direction")).otherwise(place("direction_magnitude"))
    before = F.get(sequence, (at - 2).cast("int"))
    return (kind == "translate") | (at == 0) | ((at > 1) & before.isin("object", "verb"))


def connections(first: Column, second: Column, rules: Mapping[str, Sequence[str] | None]) -> Column:
    """Ways to connect two sentence forms: always as two sentences, joined only where the rules allow the second form after the first."""
    joined = reduce(lambda out, k: out | ((first == k) & second.isin(*rules[k])) if rules[k] else out, rules, F.lit(False))
    return F.when(F.coalesce(joined, F.lit(False)), F.array(F.lit("standalone"), F.lit("concat"))).otherwise(F.array(F.lit("standalone")))


def object_mode(first: Column, second: Column) -> Column:
    """``pron`` where the second motion has the agents of the first, else ``default``."""
    return F.when(first.eqNullSafe(second), F.lit("pron")).otherwise(F.lit("default"))


def referred(phrase: Column, mode: Column, count: Column) -> Column:
    """The object as it is said in a mode: itself, a pronoun, or nothing."""
    return F.when(mode == "pron", F.when(count > 1, "they").otherwise("it")).when(mode == "omit", F.lit(None)).otherwise(phrase)


def down_sample(rows: DataFrame, keys: list[str], most: int, tie: list[str], seed: int = 0, draw: Column | None = None) -> DataFrame:
    """At most ``most`` rows of each key, those of least ``draw`` (by default a hash of ``tie``, which also decides ties); groups that are no larger stay whole."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *tie) if draw is None else draw, *tie)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


# whole prompts

FORMS = ("present", "present_pass", "imperative", "imperative_ccomp", "imperative_advcl")
#: Forms in which a phrase between object and verb stands apart in the order of parts.
_APART = ("present", "present_pass")
# Participles that don't end in -ed.
PARTICIPLES = {"rise": "risen", "fall": "fallen", "spin": "spun", "grow": "grown", "shrink": "shrunk", "drop": "dropped"}


def third_person(verb: Column) -> Column:
    return F.concat(verb, F.when(verb.rlike("(s|x|ch|sh)$"), "es").otherwise("s"))


def participle(verb: Column) -> Column:
    own = reduce(lambda out, k: F.when(verb == k, PARTICIPLES[k]).otherwise(out), PARTICIPLES, F.lit(None).cast("string"))
    return F.coalesce(own, F.concat(verb, F.when(verb.endswith("e"), "d").otherwise("ed")))


def sentence(form: Column, forms: Sequence[str], prefix: Column, thing: Column, infix: Column, verb: Column, suffix: Column, plural: Column) -> Column:
    """One sentence of one of some forms, to be cleaned. ``prefix``, ``infix`` and ``suffix`` are texts, empty where nothing is said; commas stand in the prefix after each phrase, and around an infix between object and verb."""
    apart = F.when(infix == "", thing).otherwise(F.concat(thing, F.lit(", "), infix, F.lit(",")))
    does, done = F.when(plural, verb).otherwise(third_person(verb)), F.concat(F.when(plural, "are ").otherwise("is "), participle(verb))
    parts = {
        "present": (prefix, apart, does, suffix), "present_pass": (prefix, apart, done, suffix), "imperative": (prefix, verb, thing, infix, suffix),
        "imperative_ccomp": (prefix, F.lit("make"), thing, verb, infix, suffix), "imperative_advcl": (prefix, F.lit("animate"), thing, F.lit("to"), verb, infix, suffix),
    }
    said = reduce(lambda out, k: F.when(form == k, F.array(*parts[k])).otherwise(out), forms, F.lit(None).cast("array<string>"))
    return F.array_join(F.filter(said, lambda x: x != ""), " ")


def drawn(total: Column, most: int, rank: Column) -> Column:
    """At most ``most`` different numbers under ``total``: all of them in order where there are no more, else by steps of a prime from a place that ``rank`` gives."""
    if most == 1:
        return F.when(total > 0, F.array(F.pmod(rank, total).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    some = F.sequence(F.lit(0).cast("bigint"), F.least(total, F.lit(most).cast("bigint")) - 1)
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total <= most, some).otherwise(F.transform(some, lambda q: F.pmod(F.pmod(rank, total) + q * stride(total), total)))


def prompts(units_: DataFrame, keys: Sequence[str], rank: Column, forms: Sequence[str] = FORMS, orders: int = 120, per_group: int = 2, mode: Column | None = None) -> DataFrame:
    """Sentences of every motion: ``keys, unit, order_no, form, ordering, sentence``, cleaned, each sentence of a motion once.

    ``units_``: the table of :func:`units`. The space of a motion's sentences is unit x order of the modifiers x form x cut into prefix, infix and suffix x choice of a phrase for every part. Rules cut it before anything is
    drawn: at most one phrase between, which must be said, and directions beside object or verb for other motions than translations. What is left of a form, order and cut is a group with a number of sentences
    that the lengths of the phrase lists give; at most ``per_group`` numbers of each are drawn and turned back into choices, so no product is listed. ``orders``: how many of the plain unit's 120 orders are drawn. ``rank``: a
    whole number that places the draws. ``mode``: how the object is said (:func:`referred`).
    """
    perms = F.expr(f"array({', '.join(f'array{p}' for p in itertools.permutations(range(5)))})")
    plain = F.col("unit") == 0
    rows = units_.select(*keys, "unit", "type", "slots", "sequence", rank.cast("bigint").alias("__rank"), (F.lit(None).cast("string") if mode is None else mode).alias("__mode"))
    # a key's units meet before they are said, so that sentences aren't shuffled, in tasks of bounded numbers of sentences
    rows = by_keys(rows, keys, 8 * len(forms) * min(orders, 120) * per_group)
    rows = rows.withColumn("order_no", F.explode(F.when(plain, drawn(F.lit(120).cast("bigint"), orders, F.col("__rank"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    rows = rows.withColumn("__perm", F.when(plain, F.get(perms, F.col("order_no").cast("int"))).otherwise(F.sequence(F.lit(0), F.size("sequence") - 1)))
    permuted = F.concat(F.slice("slots", 1, 2), F.transform("__perm", lambda i: F.get("slots", i + 2)))
    rows = rows.select(*keys, "unit", "type", "order_no", "__rank", "__mode", permuted.alias("__base"), F.transform("__perm", lambda i: F.get("sequence", i)).alias("__names"))
    # what is said between object and verb is chosen from a list without null; numbers are in mixed radix, the last part's phrases changing fastest
    rows = rows.withColumns({"__strict": F.transform("__base", F.array_compact), "__sizes": F.transform("__base", lambda x: F.size(x).cast("bigint"))})
    place = lambda name: F.array_position("__names", F.lit(name))
    one = F.lit(1).cast("bigint")
    below = F.transform("__sizes", lambda n, j: F.aggregate(F.slice("__sizes", j + 2, F.size("__sizes")), one, lambda s, m: s * m))
    rows = rows.withColumns({"__radix": below, "__all": F.aggregate("__sizes", one, lambda s, n: s * n), "__k": F.size("__names"), "__d": F.when(place("direction") > 0, place("direction")).otherwise(place("direction_magnitude"))})
    # a group: a form, where the prefix ends, and which of the two cuts after it (nothing, or one phrase, between)
    groups = [(form, a, b) for form in forms for a, b in (((True, False), (False, True)) if form in _APART else ((True, True),))]
    told = ", ".join(f"named_struct('form', '{form}', 'bare', {a}, 'with', {b}, 'split', {form in _APART and b})".lower() for form, a, b in groups)
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k")))).select("*", F.inline(F.expr(f"array({told})")))
    i, k, d, split = F.col("__i"), F.col("__k"), F.col("__d"), F.col("split")
    # a direction directly after object or verb: the first part after the cut, or the one after what stands between
    rows = rows.where(((F.col("type") == "translate") | (d == 0) | (d == i + 1) | (split & (d == i + 2))) & (F.col("bare") | (i < k)))
    whole = lambda a, b: F.call_function("div", a, b)
    own, fewer, zero = F.get("__sizes", i + 2), F.size(F.get("__strict", i + 2)), F.lit(0).cast("bigint")
    rows = rows.withColumns({"__n0": F.when(F.col("bare"), F.col("__all")).otherwise(zero), "__n1": F.when(F.col("with") & (i < k) & (F.col("__all") > 0), whole(F.col("__all"), own) * fewer).otherwise(zero)})
    rows = rows.withColumn("__r", F.explode(drawn(F.col("__n0") + F.col("__n1"), per_group, F.col("__rank") * 31 + F.col("order_no") * 7 + i)))
    wide = F.col("__r") >= F.col("__n0")
    lists = F.when(wide, F.concat(F.slice("__base", F.lit(1), i + 2), F.slice("__strict", i + 3, F.lit(1)), F.slice("__base", i + 4, k))).otherwise(F.col("__base"))
    rows = rows.withColumns({"__at": F.when(wide, F.col("__r") - F.col("__n0")).otherwise(F.col("__r")), "__wide": wide.cast("int"), "__lists": lists})
    wide = F.col("__wide")
    # a number back into a choice; before a part with fewer phrases, places are worth less
    worth = F.when((wide == 1) & (own != fewer), F.transform("__radix", lambda n, j: F.when(j < i + 2, whole(n, own) * fewer).otherwise(n))).otherwise(F.col("__radix"))
    rows = rows.withColumn("__worth", worth)
    rows = rows.withColumn("__choice", F.zip_with("__lists", "__worth", lambda x, n: F.get(x, (whole(F.col("__at"), n) % F.size(x)).cast("int"))))
    part = lambda start, count: F.slice("__choice", start, count)
    thing = F.get("__choice", F.lit(0))
    plural = F.contains(thing, F.lit(" and "))
    rows = rows.withColumns({
        "__prefix": F.array_join(F.transform(part(F.lit(3), i), lambda x: F.concat(x, F.lit(","))), " "), "__between": F.array_join(part(i + 3, wide), " "), "__suffix": F.array_join(part(i + 3 + wide, k + 2), " "),
        "__verb": F.get("__choice", F.lit(1)), "__plural": plural, "__said": thing if mode is None else F.coalesce(referred(thing, F.col("__mode"), F.when(plural, 2).otherwise(1)), F.lit("")),
    })
    rows = rows.withColumn("__text", sentence(F.col("form"), forms, *map(F.col, ("__prefix", "__said", "__between", "__verb", "__suffix", "__plural"))))
    rows = rows.withColumn("__text", F.concat(F.upper(F.substring("__text", 1, 1)), F.substring("__text", F.lit(2), F.length("__text")), F.lit(".")))
    names = lambda start, count: F.slice("__names", start, count)
    pair = F.when(split, F.concat(F.array(F.lit("object")), names(i + 1, F.lit(1)), F.array(F.lit("verb")))).when(F.col("form") == "imperative", F.array(F.lit("verb"), F.lit("object"))).otherwise(F.array(F.lit("object"), F.lit("verb")))
    # by an explosion, which a filter on sentences doesn't pass: in front of the steps above it would repeat them all
    rows = rows.select(*keys, "unit", "order_no", "form", "__i", "__wide", "__at", F.explode(F.array(clean_commas(F.col("__text")))).alias("sentence"), F.concat(names(F.lit(1), i), pair, names(i + F.when(split, 2).otherwise(1), k)).alias("ordering"))
    order = Window.partitionBy(*keys, "sentence").orderBy("form", "unit", "order_no", "__i", "__wide", "__at")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*keys, "unit", F.col("order_no").cast("int").alias("order_no"), "form", "ordering", "sentence")


# pairs of sentences


def pair_prompts(first: DataFrame, second: DataFrame, connectors: DataFrame, keys: Sequence[str], rules: Mapping[str, Sequence[str] | None], most: int, rank: Column, down: int = 50) -> DataFrame:
    """``keys, relation, first_form, second_form, way, sentence``: at most ``most`` joined sentences of each key, cleaned, each once.

    ``first``: keys, form, sentence; ``second``: the same and ``relation``; ``connectors``: relation, way (standalone or concat), connector (a small table; a relation that it lacks is joined by nothing). A key's sentences of
    either side become two lists of at most ``down`` by the hash of their text, so a key is one row (where one table is both sides, pass it twice: it is listed once, keys with nulls have no pairs); the pairs with their ways of connecting are numbered, numbers are drawn, and each is turned back into a pair. Where
    the rules forbid to join a pair in one sentence the number is rejected, so a key with more than ``most`` numbers may give fewer sentences. ``rank``: a whole number of the key.
    """
    same, keys = second is first, list(keys)
    how = connectors.groupBy("relation").agg(F.sort_array(F.collect_list(F.struct("way", "connector"))).alias("__ways"))

    def listed(rows: DataFrame, name: str, more: Sequence[str] = ()) -> DataFrame:
        """A key's list, with the least of its other columns over all its rows."""
        least = rows.withColumns({c: F.min(c).over(Window.partitionBy(*keys)) for c in more}) if more else rows
        return down_sample(least, keys, down, ["sentence", "form"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sentence", "form"))).alias(name), *[F.min(c).alias(c) for c in more])

    rows = listed(second, "__b", ("relation",))
    rows = rows.withColumn("__a", F.col("__b")) if same else listed(first, "__a").join(rows, keys)
    rows = (rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if same else rows).join(F.broadcast(how), "relation", "left")
    none = F.array(F.struct(F.lit("standalone").alias("way"), F.lit("").alias("connector")))
    rows = rows.withColumn("__ways", F.coalesce("__ways", none))
    total = (F.size("__a").cast("bigint") * F.size("__b")) * F.size("__ways")
    each = rows.withColumn("__r", F.explode(drawn(total, most, rank)))
    at = lambda c, n: F.get(c, n.cast("int"))
    wide, deep = F.size("__ways"), F.size("__b")
    each = each.withColumns({"__x": at("__a", F.floor(F.col("__r") / (wide * deep))), "__y": at("__b", F.floor(F.col("__r") / wide) % deep), "__w": at("__ways", F.col("__r") % wide)})
    allowed = F.array_contains(connections(F.col("__x.form"), F.col("__y.form"), rules), F.col("__w.way"))
    each = each.where(allowed).select(*keys, "relation", "__r", F.col("__x.form").alias("first_form"), F.col("__y.form").alias("second_form"), F.col("__w.way").alias("way"), F.col("__w.connector").alias("__word"), F.trim(F.col("__x.sentence")).alias("__s"), F.trim(F.col("__y.sentence")).alias("__t"))
    a, b, word = F.col("__s"), F.col("__t"), F.col("__word")
    small = F.concat(F.lower(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b)))
    alone = F.concat(F.when(a.endswith("."), a).otherwise(F.concat(a, F.lit("."))), F.lit(" "), F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))), F.lit(", "), small)
    joined = F.concat(F.rtrim(a, F.lit(".")), F.lit(", "), word, F.lit(" "), small)
    text = F.when(word == "", F.concat_ws(" ", a, b)).when(F.col("way") == "standalone", alone).otherwise(joined)
    out = each.withColumn("__text", text).select(*keys, "relation", "first_form", "second_form", "way", clean_commas(F.col("__text")).alias("sentence"), "__r")
    order = Window.partitionBy(*keys, "sentence").orderBy("__r")
    return out.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__r")
