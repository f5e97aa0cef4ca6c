"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words: letters and digits, everything else of ASCII is a blank, runs of blanks are one.
An item of n characters has an error budget k = floor(``rate`` * n). It is cut into k + 1 pieces of nearly equal length; k
edits can't touch them all, so every occurrence holds one piece exactly. An automaton finds all piece hits in one pass over a
text; each hit places its item, and Myers' bit-parallel distance verifies the window around that place. Places (which may lie before the
text) are dealt into cells of k + 1 characters; a window covers all that the hits of its cell can belong to, and is verified once.

Items shorter than ``least`` characters have no error budget: they are searched whole and count where they begin and end at word borders.

The items go to the executors in blocks of a bounded size, one block at a time; a benchmark of one block is one map over the documents without a shuffle. A larger one takes a
pass for each block, whose hits (not texts) are joined by the document's id and text hash.

Results: a null or empty text has no hits. Items whose text is null, or empty after folding, are not searched; an item without an id is, and reports null.
Repeated items each report; repeated documents each get their row. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, map_rows, materialise

#: Edits for each character of an item, and the length from which items may have edits.
RATE, LEAST = 0.08, 24
#: Characters of benchmark text that one broadcast may hold.
BLOCK_CHARS = 500_000
_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def fold(text: str | None) -> str:
    """The compared form of a text."""
    return b" ".join((text or "").lower().encode().translate(_FOLD).split()).decode()


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    n = len(text)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_distance(pattern: str, where: dict[str, int], text: str, limit: int) -> int:
    """Least edit distance of the pattern to any substring of ``text`` (Myers 1999, one wide word); over ``limit``: limit + 1."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(flat | up)), up & flat
        score += bool(rise & top) - bool(fall & top)
        best = min(best, score)
        rise, fall = rise << 1 & full, fall << 1 & full
        eq |= down
        up, down = fall | (full & ~(eq | rise)), rise & eq
    return best if best <= limit else limit + 1


class Matcher:
    """Finds the items of one block in folded texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int) -> None:
        import ahocorasick

        self.items, places = [], {}
        for key, text in items:
            text = fold(text)
            if text:
                k = int(rate * len(text)) if len(text) >= least else -1
                for at, piece in pieces(text, max(k, 0)):
                    places.setdefault(piece, []).append((len(self.items), at))
                self.items.append((key, text, k, masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Item number to its least distance, for the items that occur in a folded text."""
        out: dict[int, int] = {}
        if not self.items:
            return out
        tried: set[tuple[int, int]] = set()
        for end, (size, found) in self.automaton.iter(text):
            for n, at in found:
                if out.get(n) == 0:
                    continue
                _, item, k, where = self.items[n]
                begin = end + 1 - size - at
                if k < 0:
                    if (begin == 0 or text[begin - 1] == " ") and text[end + 1 : end + 2] in ("", " "):
                        out[n] = 0
                    continue
                if text.startswith(item, max(0, begin)):
                    out[n] = 0
                    continue
                cell = begin // (k + 1)
                if (n, cell) in tried:
                    continue  # that window holds all occurrences which this hit can belong to
                tried.add((n, cell))
                first = cell * (k + 1)
                d = best_distance(item, where, text[max(0, first - k) : first + len(item) + 2 * k], k)
                if d <= k:
                    out[n] = min(d, out.get(n, d))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``most`` characters; the driver holds one block at a time."""
    items = benchmark.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("k"), F.lit(n)) == b).orderBy("k", "t").collect()]


def _matches(rows: DataFrame, block: list[tuple], rate: float, least: int, key: str) -> DataFrame:
    """The columns of ``rows`` but its last one, the text, and ``hits`` of the block's items."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def make():
        matcher = Matcher(held.value, rate, least)
        return lambda *row: (*row[:-1], [{"k": matcher.items[n][0], "d": d} for n, d in matcher.find(fold(row[-1])).items()])

    kept = rows.schema.fields[:-1]
    return map_rows(rows, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"hits array<struct<k:{key},d:int>>"]), make)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Returns ``id_col, contaminated, item_ids, distances`` for every document; lists are in the order of the item ids."""
    key = benchmark.schema[item_col].dataType.simpleString()
    blocks = item_blocks(benchmark, item_col, item_text, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = _matches(docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")), first, rate, least, key)
    else:
        rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
        parts = [materialise(_matches(rows, block, rate, least, key).where("size(hits) > 0").select("d", "h", F.explode("hits").alias("hit")).distinct(), "hits") for block in chain([first, second], blocks)]
        found = reduce(DataFrame.union, parts).groupBy(F.col("d").alias("fd"), F.col("h").alias("fh")).agg(F.collect_list("hit").alias("hits"))  # at most the benchmark's items
        out = rows.select("d", "h").join(found, F.col("d").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh")), "left").select("d", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)).alias("hits"))
    hits = F.array_sort("hits")
    return out.select(F.col("d").alias(id_col), (F.size("hits") > 0).alias("contaminated"), hits["k"].alias("item_ids"), hits["d"].alias("distances"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a benchmark item, with all their columns: a map that filters, and for a benchmark of several blocks a table between the passes."""
    context = docs.sparkSession.sparkContext
    out, last = docs, None
    for block in item_blocks(benchmark, "item_id", "text", block_chars):
        held = context.broadcast(block)

        def keep(batches, held=held):
            import pyarrow as pa

            matcher = Matcher(held.value, RATE, LEAST)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                yield batch.filter(pa.array([not matcher.find(fold(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = map_batches(out if last is None else materialise(out, "cleaned"), keep, docs.schema)
        last = block
    return out
