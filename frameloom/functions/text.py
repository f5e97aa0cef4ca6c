"""Text functions of the prompt and program generators, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered clean-up patterns and their replacements.
CLEANUP = ((r"\s+,", ","), (r",\s*,+", ","), (r",\s*\.", "."), (r"\s+\.", "."), (r"\s{2,}", " "), (r"^[\s,]+", ""))


#: What every text that one of ``CLEANUP`` changes has somewhere.
UNCLEAN = r"[\s,][,.]|\s\s|^[\s,]"


def clean_commas(text: Column) -> Column:
    """Removes stray blanks and commas, in the order of ``CLEANUP``, and trims. Most texts have none and are looked through once."""
    cleaned = text
    for pattern, to in CLEANUP:
        cleaned = F.regexp_replace(cleaned, pattern, to)
    return F.trim(F.when(text.rlike(UNCLEAN), cleaned).otherwise(text))


def join_sentences(first: Column, connector: Column, second: Column, standalone: Column) -> Column:
    """Two sentences: as two, the connector capitalised, or as one, with the second's first letter lowered."""
    a, b = F.rtrim(first), F.trim(second)
    a = F.when(a.endswith("."), F.substring(a, F.lit(1), F.length(a) - 1)).otherwise(a)
    low = F.concat(F.lower(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b)))
    head = F.concat(F.upper(F.substring(connector, 1, 1)), F.substring(connector, F.lit(2), F.length(connector)))
    return F.when(standalone, F.concat(a, F.lit(". "), head, F.lit(", "), low)).otherwise(F.concat(a, F.lit(" "), connector, F.lit(" "), low))


def synonyms_in(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that a text has: single words as whole words without punctuation, phrases as substrings."""
    own = F.transform(F.split(text, " "), lambda w: F.rtrim(w, F.lit(".,!?;:")))
    found = [F.when(F.array_contains(own, w) if " " not in w else F.contains(text, F.lit(w)), F.lit(w)) for w in words]
    return F.array_compact(F.array(*found))


def code_block(text: Column, mark: str = "```") -> Column:
    """The text between the first two marks, without newlines at its ends; null if a mark is missing."""
    begin = F.locate(mark, text)
    rest = F.substring(text, begin + F.lit(len(mark)), F.length(text))
    end = F.locate(mark, rest)
    return F.when((begin > 0) & (end > 0), F.trim(F.substring(rest, F.lit(1), end - 1), F.lit("\n")))


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{{name}}`` replaced by the values; names that have none stay. Values are put in one after the other, so a value can hold a later name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def format_number(x: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def px_length(text: Column) -> Column:
    """Number of a plain or px length; null for others."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)(?:px)?\s*$", 1), F.lit("")), F.lit("999999999999.999999")).cast("double")
