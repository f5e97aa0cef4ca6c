"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

**Targets.** Sources in code point order (null last) have weights 5, 2, 1, repeating. They share the size of the whole corpus by weight; a source stops at
three times its own size, and what it can't take is shared again by weight among the others until none is above. Each round of that is one aggregation over the sources' table; the driver holds two sums.

**Selection.** A source takes every document as often as whole epochs fit its target. For what is left, every document draws an exponential key ``-ln(u) / weight``; in the order
of keys, documents are taken until their sizes add up to the rest, the last one if that ends nearer to it. So a document is likelier to be repeated the
higher its weight, and a source misses its target by half a document at most. ``u`` comes from a hash of the id and the text, so reruns agree.

**Scale.** Texts are read once; what remains is an id, a source and two numbers a row. The order within sources is a running sum over ranges (:mod:`frameloom.operators.ordinal`): a source
with a third of all rows is as many ranges as it needs. Sources are joined back by broadcast while they are few, else by a join that adaptive execution may split.

Results: a null or empty text has size 0 and is taken 0 times; a null id draws by its text; a null source is a source, the last. Repeated rows count each (they tie, so which of
them is taken can't be told). A source of size 0 has target 0. An empty table gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import materialise
from frameloom.operators.ordinal import numbered, running_sum

WEIGHTS = (5, 2, 1)
#: Most times that a document is taken.
MOST = 3
#: Most bytes of the sources' table that are broadcast.
FEW_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that stand for markup, numbers and tables more than for prose.
MARKS = "0123456789#*$%&|<>{}[]=_~^@\\/+"
LEAST_QUALITY = 0.01


def quality(text: Column) -> Column:
    """Weight of a text in (0, 1]: the squared share of its characters that aren't marks."""
    share = F.try_divide(F.length(F.translate(text, MARKS, "")), F.length(text))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(share * share, F.lit(LEAST_QUALITY)))


def uniform(*of: Column) -> Column:
    """A number strictly between 0 and 1, drawn by the first 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in of])), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of every source of ``sizes`` (``source, size``)."""
    ranked = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "n")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("n") % len(weights)).cast("int"))
    sources = materialise(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size").cast("decimal(20,0)") * most
    whole, all_weights = sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("weight")).first()
    left, of = int(whole or 0), int(all_weights or 0)
    while True:  # rounds of sharing: sources at their cap leave, and the others share the rest
        full = cap * of <= F.lit(left).cast("decimal(20,0)") * F.col("weight") if of else F.lit(True)
        caps, gone = sources.where(full).agg(F.sum(cap), F.sum("weight")).first()
        now = int(whole or 0) - int(caps or 0), int(all_weights or 0) - int(gone or 0)
        if now == (left, of):
            break
        left, of = now
    share = F.coalesce(*[F.when(F.col("weight") == w, F.lit(left * w / of)) for w in set(weights)]) if of else F.lit(None).cast("double")
    return sources.select("source", "source_size", F.when(full, cap.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``id_col, size, source_size, target, taken`` of every row; ``weight`` is the documents' quality weight (above 0), by default that of the text."""
    text = F.col(text_col)
    weight = quality(text) if weight is None else weight
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), (-F.ln(uniform(F.col(id_col), text)) / weight).alias("key"))
    sized = materialise(sized, "sizes")
    aims = materialise(targets(sized, weights, most).withColumnRenamed("source", "of"), "targets")
    few = (aims.agg(F.sum(F.coalesce(F.octet_length("of"), F.lit(0)) + 64)).first()[0] or 0) <= FEW_BYTES
    ordered = running_sum(sized, [F.col("key"), F.col("id"), F.col("size")], F.col("size"), "before", by=["source"])
    rows = ordered.join(F.broadcast(aims) if few else aims, F.col("source").eqNullSafe(F.col("of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    again = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (epochs + again.cast("int"))).cast("bigint").alias("taken"))
