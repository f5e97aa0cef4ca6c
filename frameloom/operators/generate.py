"""Program and sentence generation: cross products, permutations, splits and texts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.operators.dealing import by_keys

MODIFIERS = ("direction", "magnitude", "origin", "duration", "post")
RELATION_CALLS = {"before": "t_before", "overlaps": "t_while", "after": "t_after"}
#: Sentence forms of a motion.
TEMPLATES = {
    "present": "The {object} {verb} {rest}.", "passive": "The {object} is {verb_past} {rest}.", "imperative": "{Verb_base} the {object} {rest}.",
    "complement": "Make the {object} {verb_base} {rest}.", "clause": "Animate the {object} so that it {verb} {rest}.",
}


def modifier_orders(spark: SparkSession) -> DataFrame:
    """``ord, modifiers``: all orders of the modifiers."""
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(itertools.permutations(MODIFIERS))], "ord int, modifiers array<string>")


def splits(rows: DataFrame, items: str) -> DataFrame:
    """All cuts of an array into prefix, infix and suffix."""
    n = F.size(items)
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("j", F.explode(F.sequence(F.col("i"), n)))
    return cut.withColumns({"prefix": F.slice(items, F.lit(1), F.col("i")), "infix": F.slice(items, F.col("i") + 1, F.col("j") - F.col("i")), "suffix": F.slice(items, F.col("j") + 1, n)})


def agent_rows(motions: DataFrame) -> DataFrame:
    """``graph_id, obj, shape, fill``: the distinct objects of a graph's motions, in the order of their first mention (posts after agents)."""
    rows = motions.select("graph_id", "motion_idx", F.posexplode(F.concat(F.coalesce("agents", F.array().cast("array<struct<shape:string,fill:string>>")), F.coalesce("post_reference", F.array().cast("array<struct<shape:string,fill:string>>")))).alias("pos", "o"))
    first = rows.groupBy("graph_id", "o").agg(F.min(F.struct("motion_idx", "pos")).alias("at"))
    return first.withColumn("obj", F.row_number().over(Window.partitionBy("graph_id").orderBy("at"))).select("graph_id", "obj", "o.shape", "o.fill")


def programs(motions: DataFrame) -> DataFrame:
    """``graph_id, program``: the program text of every scene graph. A motion tied to no other by a relation is an existence statement, others are variables that the relations name.

    ``motions``: graph_id, motion_idx (from 0), type, direction, magnitude, origin, duration (as they stand in a program; null: none), agents and post_reference (arrays of shape and fill), post, relation (to the
    motion before). A graph's rows meet once, in tasks of bounded size: a row for each mention of an object, numbered by windows within the graph; its lines meet in one row.
    """
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    call = lambda name, value, var: F.when(value.isNotNull(), F.concat(F.lit(f"{name}("), var, F.lit(", "), value, F.lit(")")))
    none = F.array().cast("array<struct<shape:string,fill:string>>")
    order = Window.partitionBy("graph_id").orderBy("motion_idx")
    rows = by_keys(motions.where("graph_id is not null"), ["graph_id"], 12)  # a few mentions of each, in four sorts
    rows = rows.withColumns({"n": F.row_number().over(order), "alone": F.col("relation").isNull() & F.lead("relation").over(order).isNull(), "agents": F.coalesce("agents", none), "post_reference": F.coalesce("post_reference", none)})
    number, var = (F.col("motion_idx") + 1).cast("string"), F.when(F.col("alone"), F.concat(F.lit("m_"), (F.col("motion_idx") + 1).cast("string"))).otherwise(F.lit("m"))
    head = F.concat_ws(" and ", call("type", quoted(F.col("type")), var), *[call(c, F.col(c), var) for c in ("direction", "magnitude", "origin")])
    relation = F.when(F.col("relation").isNotNull(), F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in RELATION_CALLS.items() for x in kv]), F.col("relation")), F.lit("(m_"), F.col("motion_idx").cast("string"), F.lit(", m_"), number, F.lit(")")))
    said = F.struct("alone", number.alias("number"), var.alias("var"), F.nullif(head, F.lit("")).alias("head"), F.replace("post", F.lit("ing"), F.lit("")).alias("post"), call("duration", F.col("duration"), var).alias("lasting"), relation.alias("r"))
    rows = rows.select("graph_id", "n", said.alias("m"), F.size("agents").alias("own"), F.posexplode_outer(F.concat("agents", "post_reference")).alias("pos", "o"))
    # what is said of a motion goes with its first row; a row is its agent's, its reference's, or of no object
    rows = rows.withColumns({"lead": F.coalesce("pos", F.lit(0)) == 0, "who": (F.col("pos") == 0) & (F.col("own") > 0) & F.col("o").isNotNull(), "to": (F.col("pos") == F.col("own")) & F.col("o").isNotNull()})
    rows = rows.withColumns({"m": F.when(F.col("lead"), F.col("m")), "at": F.when(F.col("pos").isNotNull(), F.struct("n", "pos"))})
    rows = rows.withColumn("first", F.min("at").over(Window.partitionBy("graph_id", "o")))
    rows = rows.withColumn("obj", F.dense_rank().over(Window.partitionBy("graph_id").orderBy(F.col("first").asc_nulls_last())))
    name = lambda c: F.max(F.when(F.col(c), F.concat(F.lit("o_"), F.col("obj").cast("string")))).over(Window.partitionBy("graph_id", "n"))
    rows = rows.withColumns({"who": name("who"), "to": name("to")}).where(F.col("lead") | (F.col("at") == F.col("first")))
    tests = F.concat_ws(" and ", call("color", quoted(F.col("o.fill")), F.lit("o")), call("shape", quoted(F.col("o.shape")), F.lit("o")))
    line = F.concat(F.lit("o_"), F.col("obj").cast("string"), F.lit(" = iota(Object, lambda o: "), tests, F.lit(")"))
    m, who = F.col("m"), F.col("who")
    post = F.when(m["post"].isNotNull() & F.col("to").isNotNull(), F.concat(F.lit("s_"), m["post"], F.lit("("), who, F.lit(", "), F.col("to"), F.lit(")")))
    body = F.concat_ws(" and ", m["head"], call("post", post, m["var"]), m["lasting"], call("agent", who, m["var"]))
    text = F.when(m["alone"], F.concat(F.lit("exists(Motion, lambda "), m["var"], F.lit(": "), body, F.lit(")"))).otherwise(F.concat(F.lit("m_"), m["number"], F.lit(" = iota(Motion, lambda m: "), body, F.lit(")")))
    rows = rows.select("graph_id", "n", "obj", F.when(F.col("at") == F.col("first"), line).alias("object"), F.when(F.col("lead"), text).alias("l"), m["r"].alias("r"))
    joined = lambda by, c: F.array_join(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(by, F.col(c).alias("l")))))["l"], "\n")
    whole = rows.groupBy("graph_id").agg(F.count("object").alias("some"), joined("obj", "object").alias("objects"), joined("n", "l").alias("own"), F.nullif(joined("n", "r"), F.lit("")).alias("order"))
    return whole.where("some > 0").select("graph_id", F.concat_ws("\n\n", "objects", "own", "order").alias("program"))


def sentences(slots: DataFrame) -> DataFrame:
    """Every sentence form of every row of slots (object, verb, verb_past, verb_base, rest): ``form, sentence`` are added. The forms are a fixed small list."""
    forms = []
    for form, text in TEMPLATES.items():
        expr: Column = F.lit(text)
        for slot in ("object", "verb_past", "verb_base", "verb", "rest"):
            expr = F.replace(expr, F.lit("{" + slot + "}"), F.col(slot))
        expr = F.replace(expr, F.lit("{Verb_base}"), F.initcap("verb_base"))
        forms.append(F.struct(F.lit(form).alias("form"), F.regexp_replace(expr, r"\s+\.", ".").alias("sentence")))
    return slots.withColumn("f", F.explode(F.array(*forms))).select(*slots.columns, "f.*")
