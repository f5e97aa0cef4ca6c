"""Labels, vocabulary entries and program documentation as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_label(fill: Column, shape: Column) -> Column:
    """``<fill> <shape>``, or ``object``."""
    said = F.concat_ws(" ", F.nullif(fill, F.lit("")), F.nullif(shape, F.lit("")))
    return F.when(said == "", "object").otherwise(said)


def motion_label(kind: Column, agents: Column) -> Column:
    """``<type> agent: <labels>``, or ``motion``. ``agents``: array of labels, null or empty if there are none."""
    who = F.when(F.size(agents) > 0, F.concat(F.lit("agent: "), F.array_join(agents, ", ")))
    said = F.concat_ws(" ", F.nullif(kind, F.lit("")), who)
    return F.when(said == "", "motion").otherwise(said)


def entry_text(entry: Column) -> Column:
    """Text of a vocabulary entry given as JSON: a plain string, its ``word`` or ``text``, or a preposition with what follows (a noun phrase or a noun)."""
    at = lambda path: F.get_json_object(entry, f"$.{path}")
    adjective = F.coalesce(at("np.adj.word"), at("np.adj"))
    phrase = F.concat_ws(" ", at("prep"), at("np.det"), adjective, at("np.noun"), at("np.noun2"))
    plain = F.get_json_object(F.concat(F.lit('{"v":'), entry, F.lit("}")), "$.v")
    said = F.coalesce(at("word"), at("text"), F.when(at("prep").isNotNull(), F.when(at("np").isNotNull(), phrase).otherwise(F.concat_ws(" ", at("prep"), at("noun")))))
    return F.when(entry.startswith("{"), F.coalesce(said, F.lit(""))).when(entry.startswith('"'), plain).otherwise(F.lit(""))


def labelled(items: Column, labels: Column, wanted: int = 1) -> Column:
    """Items whose label in a parallel array is the wanted one; items without a label are left out."""
    return F.filter(items, lambda x, i: F.coalesce(F.get(labels, i) == wanted, F.lit(False)))


def section_after(text: Column, header: str) -> Column:
    """What follows a header up to the next one like it, without newlines in front; a text without the header is an error."""
    parts = F.split(text, "\\Q" + header + "\\E")
    return F.when(F.size(parts) > 1, F.ltrim(F.get(parts, F.lit(1)), F.lit("\n"))).otherwise(F.raise_error(F.lit("the header is missing")).cast("string"))


def group_of(word: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The first group that has a word; null if none has."""
    return F.coalesce(*[F.when(word.isin(*words), F.lit(name)) for name, words in groups.items()])


def padded_id(base: Column, number: Column, width: int = 3) -> Column:
    """``<base>_<number>``, the number padded with zeros (longer numbers stay whole)."""
    digits = number.cast("string")
    return F.concat_ws("_", base, F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; where both have a key, the second's value stays."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def same_set(first: Column, second: Column) -> Column:
    """Whether two arrays hold the same elements."""
    return (F.size(F.array_except(first, second)) == 0) & (F.size(F.array_except(second, first)) == 0)
