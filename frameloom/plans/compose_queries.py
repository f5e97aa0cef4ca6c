"""Registered queries of sentence composition and vocabulary functions.

Bindings: ``orders`` as motions (type by key, direction by customer and key, size by price, duration by customer), ``part`` as vocabularies, slots and labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions import vocabulary as vo
from frameloom.operators import compose as co
from frameloom.operators import generate
from frameloom.plans.driver_queries import load, register

_KIND = ("translate", "rotate", "scale")
MOTIONS = """motions AS (SELECT o_orderkey, ['translate', 'rotate', 'scale'][o_orderkey % 3 + 1] AS type, CAST(o_custkey % 3 - 1 AS DOUBLE) AS x, CAST(o_orderkey // 4 % 3 - 1 AS DOUBLE) AS y, round(o_totalprice / 1000, 1) AS size,
  CASE o_orderkey % 4 WHEN 0 THEN ['50%', '50%'] WHEN 1 THEN ['10', '20'] END AS origin, nullif(CAST(o_custkey % 5 AS DOUBLE), 0) AS duration, CASE WHEN o_custkey % 2 = 0 THEN 'left_of' END AS post FROM orders)"""


def motions(s, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    origin = F.when(key % 4 == 0, F.array(F.lit("50%"), F.lit("50%"))).when(key % 4 == 1, F.array(F.lit("10"), F.lit("20")))
    rows = load(s, d, "orders").select(
        "o_orderkey", F.get(F.array(*map(F.lit, _KIND)), (key % 3).cast("int")).alias("type"), (cust % 3 - 1).cast("double").alias("x"), (F.floor(key / 4) % 3 - 1).cast("double").alias("y"),
        F.round(F.col("o_totalprice") / 1000, 1).alias("size"), origin.alias("origin"), F.nullif((cust % 5).cast("double"), F.lit(0.0)).alias("duration"), F.when(cust % 2 == 0, "left_of").alias("post"),
    )
    return rows


def shown(c):
    return F.array_join(c, "|", "~")


C = F.col
_DIR_X = """CASE type WHEN 'translate' THEN CASE WHEN x > 0 THEN 'rightward|to the right' WHEN x < 0 THEN 'leftward|to the left' ELSE '~' END
  WHEN 'rotate' THEN CASE WHEN x > 0 THEN 'clockwise|in a clockwise direction' WHEN x < 0 THEN 'counterclockwise|in a counterclockwise direction' ELSE '~' END
  ELSE CASE WHEN x = 0 THEN '~' WHEN x = y THEN replace('@ uniformly|@ in both directions|@', '@', if(x > 0, 'up', 'down')) ELSE replace('@ horizontally|@ along the x-axis', '@', if(x > 0, 'up', 'down')) END END"""
_DIR_Y = """CASE type WHEN 'translate' THEN CASE WHEN y > 0 THEN 'upward|toward the top' WHEN y < 0 THEN 'downward|toward the bottom' ELSE '~' END
  WHEN 'rotate' THEN '~' ELSE CASE WHEN y = 0 OR x = y THEN '~' ELSE replace('@ vertically|@ along the y-axis', '@', if(y > 0, 'up', 'down')) END END"""


def _directions(s, d):
    return co.direction_parts(C("type"), C("x"), C("y"))


register("q_direction_phrases", f"WITH {MOTIONS} SELECT o_orderkey, {_DIR_X} AS dx, {_DIR_Y} AS dy FROM motions")(
    lambda s, d: motions(s, d).select("o_orderkey", *[shown(c).alias(n) for n, c in zip(("dx", "dy"), _directions(s, d))])
)


def _sizes():
    """Sizes by type: along the direction, one for rotations, one for each axis of scalings."""
    along = [F.round(c, 2) for c in co.axis_magnitudes(C("size"), C("x"), C("y"))]
    one = F.lit(None).cast("double")
    return F.when(C("type") == "translate", along[0]).otherwise(C("size")), F.when(C("type") == "translate", along[1]).when((C("type") == "scale"), C("size") + C("x") - C("y")).otherwise(one)


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
SIZED = MOTIONS + """, sized AS (SELECT *, CASE WHEN type = 'translate' THEN CASE WHEN size <> 0 AND x * x + y * y > 0 THEN round(abs(x) * size / sqrt(x * x + y * y), 2) END ELSE size END AS sx,
  CASE type WHEN 'translate' THEN CASE WHEN size <> 0 AND x * x + y * y > 0 THEN round(abs(y) * size / sqrt(x * x + y * y), 2) END WHEN 'scale' THEN size + x - y END AS sy FROM motions)"""
_SAID = "CASE WHEN {0} IS NULL THEN '~' WHEN type = 'rotate' THEN 'by ' || " + _NUM + " || ' degrees|through an angle of ' || " + _NUM + " || ' degrees' WHEN {0} = 0 THEN '~' ELSE 'by ' || " + _NUM + " || if(type = 'translate', ' px', '') END"
_MAG_X, _MAG_Y = _SAID.format("sx"), "CASE WHEN type = 'scale' AND sx = sy THEN '~' ELSE " + _SAID.format("sy") + " END"
register("q_magnitude_axes", f"WITH {SIZED} SELECT o_orderkey, sx, sy FROM sized WHERE type = 'translate'")(
    lambda s, d: motions(s, d).where("type = 'translate'").select("o_orderkey", *[F.round(c, 2).alias(n) for n, c in zip(("sx", "sy"), co.axis_magnitudes(C("size"), C("x"), C("y")))])
)
register("q_magnitude_phrases", f"WITH {SIZED} SELECT o_orderkey, {_MAG_X} AS mx, {_MAG_Y} AS my FROM sized")(
    lambda s, d: motions(s, d).select("o_orderkey", *[shown(c).alias(n) for n, c in zip(("mx", "my"), co.magnitude_parts(C("type"), *_sizes()))])
)
_LISTS = f"""{SIZED}, said AS (SELECT o_orderkey, type, list_transform(string_split({_DIR_X}, '|'), lambda v: nullif(v, '~')) AS dx, list_transform(string_split({_DIR_Y}, '|'), lambda v: nullif(v, '~')) AS dy,
  list_transform(string_split({_MAG_X}, '|'), lambda v: nullif(v, '~')) AS mx, list_transform(string_split({_MAG_Y}, '|'), lambda v: nullif(v, '~')) AS my FROM sized)"""
_AXIS = "list_filter(flatten(list_transform(d{0}, lambda a: list_transform(m{0}, lambda b: nullif(concat_ws(' ', a, b), '')))), lambda v: v IS NOT NULL)"
register("q_direction_magnitude", f"""WITH {_LISTS}, axes AS (SELECT o_orderkey, {_AXIS.format('x')} AS ax, {_AXIS.format('y')} AS ay FROM said), full_ AS (SELECT o_orderkey, if(len(ax) = 0, [NULL], ax) AS ax, if(len(ay) = 0, [NULL], ay) AS ay FROM axes)
  SELECT o_orderkey, array_to_string(list_transform(flatten(list_transform(ax, lambda a: list_transform(ay, lambda b: nullif(concat_ws(' and ', a, b), '')))), lambda v: coalesce(v, '~')), '|') AS said FROM full_""")(
    lambda s, d: motions(s, d).select("o_orderkey", shown(co.composed(_directions(s, d), co.magnitude_parts(C("type"), *_sizes()))).alias("said"))
)
register("q_modifier_resolution", f"WITH {MOTIONS}, said AS (SELECT o_orderkey, {_DIR_X} AS dx, {_DIR_Y} AS dy FROM motions) SELECT o_orderkey, CASE WHEN dx <> '~' AND dy = '~' THEN dx WHEN dx = '~' AND dy <> '~' THEN dy ELSE '~' END AS said FROM said")(
    lambda s, d: motions(s, d).select("o_orderkey", shown(co.resolved(*_directions(s, d))).alias("said"))
)
register("q_verb_conflation", f"""WITH {MOTIONS} SELECT o_orderkey, CASE type WHEN 'scale' THEN CASE WHEN x > 0 AND y > 0 THEN 'enlarge|grow' WHEN x < 0 AND y < 0 THEN 'shrink' WHEN x + y = 1 AND x * y = 0 THEN 'enlarge|grow|stretch' WHEN x + y = -1 AND x * y = 0 THEN 'shrink|compress' ELSE '' END
  WHEN 'rotate' THEN if(origin = ['50%', '50%'], 'spin', '') ELSE CASE WHEN y > 0 AND x < y THEN 'rise' WHEN y < 0 AND x > y THEN 'drop|fall' ELSE '' END END AS verbs FROM motions""")(
    lambda s, d: motions(s, d).select("o_orderkey", shown(co.conflated_verbs(C("type"), C("x"), C("y"), C("origin"))).alias("verbs"))
)
register("q_phrase_verbs", f"WITH {MOTIONS} SELECT o_orderkey, CASE type WHEN 'translate' THEN 'move|shift' WHEN 'rotate' THEN 'rotate|turn' ELSE 'scale' END AS verbs FROM motions")(
    lambda s, d: motions(s, d).select("o_orderkey", shown(co.verbs(C("type"))).alias("verbs"))
)
register("q_phrase_duration", f"WITH {MOTIONS} SELECT o_orderkey, coalesce('for ' || n || ' second' || p || '|over ' || n || ' second' || p, '~') AS said FROM (SELECT o_orderkey, CAST(CAST(duration AS BIGINT) AS VARCHAR) AS n, if(duration = 1, '', 's') AS p FROM motions)")(
    lambda s, d: motions(s, d).select("o_orderkey", shown(co.duration_phrases(C("duration"))).alias("said"))
)
register("q_phrase_origin", f"WITH {MOTIONS} SELECT o_orderkey, CASE WHEN origin IS NULL THEN '~' WHEN origin = ['50%', '50%'] THEN 'about its center|around its center' ELSE 'about the point (10, 20)|around the point (10, 20)' END AS said FROM motions")(
    lambda s, d: motions(s, d).select("o_orderkey", shown(co.origin_phrases(C("origin"))).alias("said"))
)
_OBJECT = lambda: F.struct(F.get(F.split("p_name", " "), F.lit(0)).alias("fill"), F.get(F.split("p_name", " "), F.lit(1)).alias("shape"))
register("q_phrase_object_post", "SELECT p_partkey, 'the ' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || if(p_size % 2 = 0, ' and the ' || lower(p_type), '') AS object, if(p_size % 3 = 0, '~', 'until it is left of the ' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2)) AS post FROM part")(
    lambda s, d: load(s, d, "part").withColumn("objects", F.when(C("p_size") % 2 == 0, F.array(_OBJECT(), F.struct(F.lower("p_type").alias("fill"), F.lit(None).cast("string").alias("shape")))).otherwise(F.array(_OBJECT())))
    .select("p_partkey", shown(co.object_phrase(C("objects"))).alias("object"), shown(co.post_phrases(F.when(C("p_size") % 3 != 0, "left_of"), F.array(_OBJECT()))).alias("post"))
)


def _unit_rows(s, d):
    size_x, size_y = _sizes()
    thing = F.array(F.struct(F.lit("red").alias("fill"), F.lit("square").alias("shape")))
    return co.units(motions(s, d).withColumns({"size_x": size_x, "size_y": size_y}).withColumns({"agents": thing, "post_reference": thing}))


_STRONG = "type = 'scale' AND (x * y > 0 OR x + y IN (1, -1)) OR type = 'rotate' AND origin = ['50%', '50%'] OR type = 'translate' AND (y > 0 AND x < y OR y < 0 AND x > y)"
register("q_units", f"""WITH {MOTIONS}, strong AS (SELECT *, coalesce({_STRONG}, false) AS strong FROM motions) SELECT o_orderkey, 0 AS unit, 'direction,magnitude,origin,duration,post' AS sequence FROM strong
  UNION ALL SELECT o_orderkey, 1, CASE type WHEN 'scale' THEN 'direction_magnitude,post,origin,duration' WHEN 'rotate' THEN 'direction,magnitude,post,duration' ELSE 'magnitude,origin,post,duration' END FROM strong WHERE strong
  UNION ALL SELECT o_orderkey, 2, 'direction_magnitude,post,duration,origin' FROM strong WHERE strong AND type = 'scale'""")(
    lambda s, d: _unit_rows(s, d).select("o_orderkey", "unit", F.array_join("sequence", ",").alias("sequence"))
)


def _slots(s, d):
    return load(s, d, "part").select("p_partkey", F.array(F.split("p_name", " "), F.split("p_type", " "), F.split("p_brand", "#")).alias("slots"))


_SLOTS = "slots AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b, string_split(p_brand, '#') AS c FROM part)"
register("q_slot_product", f"WITH {_SLOTS} SELECT p_partkey, a || '|' || b || '|' || c AS choice FROM (SELECT p_partkey, a, b, unnest(c) AS c FROM (SELECT p_partkey, a, unnest(b) AS b, c FROM (SELECT p_partkey, unnest(a) AS a, b, c FROM slots)))")(
    lambda s, d: co.slot_product(_slots(s, d), "slots", ["p_partkey"], 1000).select("p_partkey", shown(C("choice")).alias("choice"))
)
register("q_slot_product_capped", f"""WITH {_SLOTS}, sized AS (SELECT *, len(a) * len(b) * len(c) AS total FROM slots),
  drawn AS (SELECT *, CASE WHEN total <= 5 THEN i ELSE (p_partkey * 7919 % total + i * 1000003) % total END AS n FROM (SELECT *, unnest(generate_series(0, least(total, 5) - 1)) AS i FROM sized))
  SELECT p_partkey, CAST(n AS BIGINT) AS choice_no, a[n // (len(b) * len(c)) + 1] || '|' || b[n // len(c) % len(b) + 1] || '|' || c[n % len(c) + 1] AS choice FROM drawn""")(
    lambda s, d: co.slot_product(_slots(s, d), "slots", ["p_partkey"], 5, start=C("p_partkey") * 7919).select("p_partkey", "choice_no", shown(C("choice")).alias("choice"))
)
_CUTS = """cuts AS (SELECT p_partkey, i, j, w[i+1:j] AS infix FROM (SELECT *, unnest(generate_series(i, len(w))) AS j FROM (SELECT *, unnest(generate_series(0, len(w))) AS i FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part))))"""
register("q_infix_valid", f"WITH {_CUTS} SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM cuts WHERE len(infix) <= 1 AND coalesce(infix[1], '') <> 'BRASS'")(
    lambda s, d: generate.splits(load(s, d, "part").select("p_partkey", F.transform(F.split("p_type", " "), lambda w: F.nullif(w, F.lit("BRASS"))).alias("w")), "w").where(co.infix_allowed(C("infix"))).select("p_partkey", "i", "j")
)
_ADJACENT = "t = 'translate' OR (list_position(seq, 'direction') > 1 AND seq[list_position(seq, 'direction') - 1] IN ('object', 'verb'))"
register("q_direction_adjacency", f"""WITH w AS (SELECT p_partkey, ['translate', 'rotate', 'scale'][p_size % 3 + 1] AS t, list_filter(['object', 'direction', 'duration', 'verb'], lambda x, i: (p_partkey + i) % 5 > 0) AS a, p_size % 4 AS k FROM part),
  r AS (SELECT p_partkey, t, a[k + 1:] || a[1:k] AS seq FROM w) SELECT p_partkey, t AS type, array_to_string(seq, ',') AS seq FROM r WHERE list_position(seq, 'direction') IS NULL OR list_position(seq, 'direction') = 0 OR {_ADJACENT}""")(
    lambda s, d: load(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, _KIND)), C("p_size") % 3).alias("type"), F.filter(F.array(*map(F.lit, ("object", "direction", "duration", "verb"))), lambda x, i: (C("p_partkey") + i + 1) % 5 > 0).alias("a"), (C("p_size") % 4).alias("k"))
    .withColumn("seq", F.concat(F.slice("a", C("k") + 1, F.size("a")), F.slice("a", F.lit(1), C("k")))).where(co.direction_adjacent(C("type"), C("seq"))).select("p_partkey", "type", F.array_join("seq", ",").alias("seq"))
)
_FORMS = ("present", "present_pass", "imperative", "imperative_ccomp")
_PICK = "['present', 'present_pass', 'imperative', 'imperative_ccomp'][l_{0} % 4 + 1]"
register("q_pair_legality", f"SELECT l_orderkey, l_linenumber, if(a = 'present' AND b = 'present', 'standalone,concat', 'standalone') AS ways FROM (SELECT l_orderkey, l_linenumber, {_PICK.format('partkey')} AS a, {_PICK.format('suppkey')} AS b FROM lineitem)")(
    lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(co.connections(*[F.get(F.array(*map(F.lit, _FORMS)), (C(c) % 4).cast("int")) for c in ("l_partkey", "l_suppkey")], {"present": ["present"], "imperative": None}), ",").alias("ways"))
)
register("q_pronoun_mode", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = l_partkey % 3 THEN CASE WHEN l_linenumber > 1 THEN 'they' ELSE 'it' END ELSE l_returnflag END AS said FROM lineitem")(
    lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", co.referred(C("l_returnflag"), co.object_mode(F.array(C("l_suppkey") % 3), F.array(C("l_partkey") % 3)), C("l_linenumber")).alias("said"))
)
register("q_down_sample", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7919 % 10007, p_partkey) AS n FROM part) WHERE n <= 4")(
    lambda s, d: co.down_sample(load(s, d, "part"), ["p_brand"], 4, ["p_partkey"], draw=C("p_partkey") * 7919 % 10007).select("p_brand", "p_partkey")
)

# whole prompts: the plain unit of every motion, one order of its modifiers, two forms, one sentence of each group

_THIRD = "verb || CASE WHEN regexp_matches(verb, '(s|x|ch|sh)$') THEN 'es' ELSE 's' END"
_TEXT = "t"
for _pattern, _to in tx.CLEANUP:
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', '{_to}', 'g')"
_ONE = "CASE WHEN {0} <> [NULL] AND {1} = [NULL] THEN {0} WHEN {0} = [NULL] AND {1} <> [NULL] THEN {1} ELSE [NULL] END"
_PRODUCT = "coalesce(CAST(list_aggregate(list_transform({0}, lambda x: len(x)), 'product') AS BIGINT), 1)"
PROMPTS = f"""{_LISTS}, parts AS (SELECT said.o_orderkey, said.type, [['the red square'], CASE said.type WHEN 'translate' THEN ['move', 'shift'] WHEN 'rotate' THEN ['rotate', 'turn'] ELSE ['scale'] END] AS core,
    [{_ONE.format("dx", "dy")}, {_ONE.format("mx", "my")}, CASE WHEN origin IS NULL THEN [NULL] WHEN origin = ['50%', '50%'] THEN ['about its center', 'around its center'] ELSE ['about the point (10, 20)', 'around the point (10, 20)'] END,
     CASE WHEN duration IS NULL THEN [NULL] ELSE list_transform(['for ', 'over '], lambda p: p || CAST(CAST(duration AS BIGINT) AS VARCHAR) || if(duration = 1, ' second', ' seconds')) END,
     CASE WHEN post IS NULL THEN [NULL] ELSE ['until it is left of the red square'] END] AS mods FROM said JOIN motions USING (o_orderkey)),
  perms AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS no FROM (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i)) WHERE len(list_distinct(p)) = 5),
  ordered AS (SELECT o_orderkey, type, no, core, list_transform(p, lambda i: mods[i + 1]) AS m, list_transform(p, lambda i: ['direction', 'magnitude', 'origin', 'duration', 'post'][i + 1]) AS names FROM parts JOIN perms ON no = o_orderkey % 120),
  cut AS (SELECT o_orderkey, type, no, core, names, m, i, form, bare, wide FROM ordered, (SELECT unnest(range(6)) AS i), (VALUES ('imperative', true, true), ('present', true, false), ('present', false, true)) f(form, bare, wide) WHERE bare OR i < 5),
  placed AS (SELECT *, CASE WHEN form = 'present' AND wide THEN names[1:i] || ['object'] || names[i + 1:i + 1] || ['verb'] || names[i + 2:] WHEN form = 'present' THEN names[1:i] || ['object', 'verb'] || names[i + 1:] ELSE names[1:i] || ['verb', 'object'] || names[i + 1:] END AS seq,
    core || m AS base, list_transform(core || m, lambda x, j: if(j = i + 3, list_filter(x, lambda y: y IS NOT NULL), x)) AS strict FROM cut),
  counted AS (SELECT *, if(bare, {_PRODUCT.format("base")}, 0) AS n0, if(wide AND i < 5, {_PRODUCT.format("strict")}, 0) AS n1 FROM placed WHERE type = 'translate' OR (list_position(seq, 'direction') > 1 AND seq[list_position(seq, 'direction') - 1] IN ('object', 'verb'))),
  picked AS (SELECT *, if(n0 + n1 = 1, 0, (o_orderkey * 31 + no * 7 + i) % (n0 + n1)) AS r FROM counted WHERE n0 + n1 > 0),
  sided AS (SELECT *, r >= n0 AS mid, if(r >= n0, strict, base) AS lists, if(r >= n0, r - n0, r) AS nth FROM picked),
  chosen AS (SELECT *, list_transform(lists, lambda x, j: x[1 + (nth // {_PRODUCT.format("lists[j + 1:]")}) % len(x)]) AS c FROM sided),
  worded AS (SELECT *, c[1] AS thing, c[2] AS verb, array_to_string(list_transform(list_filter(c[3:i + 2], lambda x: x IS NOT NULL), lambda x: x || ','), ' ') AS pre, if(mid, coalesce(c[i + 3], ''), '') AS inf, array_to_string(list_filter(c[if(mid, i + 4, i + 3):], lambda x: x IS NOT NULL), ' ') AS suf FROM chosen),
  spoken AS (SELECT *, array_to_string(list_filter(CASE form WHEN 'present' THEN [pre, if(inf = '', thing, thing || ', ' || inf || ','), {_THIRD}, suf] ELSE [pre, verb, thing, inf, suf] END, lambda x: x <> ''), ' ') AS u FROM worded),
  cleaned AS (SELECT *, trim({_TEXT}) AS sentence FROM (SELECT *, upper(left(u, 1)) || substring(u, 2) || '.' AS t FROM spoken))"""
_KEPT = "row_number() OVER (PARTITION BY o_orderkey, sentence ORDER BY form, no, i, mid, nth) = 1"


def _prompts(s, d):
    rows = _unit_rows(s, d).where("unit = 0")
    return co.prompts(rows, ["o_orderkey"], C("o_orderkey"), ("present", "imperative"), 1, 1)


register("q_prompts", f"WITH {PROMPTS} SELECT o_orderkey, form, CAST(no AS INTEGER) AS order_no, array_to_string(seq, ',') AS ordering, sentence FROM cleaned QUALIFY {_KEPT}")(
    lambda s, d: _prompts(s, d).select("o_orderkey", "form", "order_no", F.array_join("ordering", ",").alias("ordering"), "sentence")
)


def _pair_prompts(s, d):
    """The sentences of an order's motion, and those of the same motion as its second, with a connector."""
    rows = _prompts(s, d).select(C("o_orderkey").alias("graph"), "form", "sentence").where("length(sentence) % 3 = 0")
    words = s.createDataFrame([("before", "standalone", "then"), ("before", "concat", "and then"), ("after", "standalone", "before that")], "relation string, way string, connector string")
    second = rows.withColumn("relation", F.when(C("graph") % 3 == 0, "before").when(C("graph") % 3 == 1, "after"))
    return co.pair_prompts(second, second, words, ["graph"], {"present": ["present"], "imperative": None}, 4, C("graph"), 50)


_SMALL = "lower(left(y.sentence, 1)) || substring(y.sentence, 2)"
register("q_pair_prompts", f"""WITH {PROMPTS}, kept AS (SELECT o_orderkey AS graph, form, sentence FROM (SELECT * FROM cleaned QUALIFY {_KEPT}) WHERE length(sentence) % 3 = 0),
  lists AS (SELECT graph, list({{'sentence': sentence, 'form': form}} ORDER BY sentence, form) AS l FROM kept GROUP BY 1),
  ways AS (SELECT *, CASE graph % 3 WHEN 0 THEN [{{'way': 'concat', 'word': 'and then'}}, {{'way': 'standalone', 'word': 'then'}}] WHEN 1 THEN [{{'way': 'standalone', 'word': 'before that'}}] ELSE [{{'way': 'standalone', 'word': ''}}] END AS w FROM lists),
  spaces AS (SELECT *, len(l) * len(l) * len(w) AS total FROM ways), numbers AS (SELECT *, unnest(range(least(total, 4))) AS q FROM spaces), placed_ AS (SELECT *, if(total <= 4, q, (graph % total + q * 1000003) % total) AS r FROM numbers),
  paired AS (SELECT graph, r, l[1 + r // (len(w) * len(l))] AS x, l[1 + (r // len(w)) % len(l)] AS y, w[1 + r % len(w)] AS v FROM placed_),
  said_ AS (SELECT graph, r, x.form AS first_form, y.form AS second_form, v.way AS way, CASE WHEN v.word = '' THEN x.sentence || ' ' || y.sentence WHEN v.way = 'standalone' THEN x.sentence || ' ' || upper(left(v.word, 1)) || substring(v.word, 2) || ', ' || {_SMALL}
    ELSE rtrim(x.sentence, '.') || ', ' || v.word || ' ' || {_SMALL} END AS t FROM paired WHERE v.way = 'standalone' OR (x.form = 'present' AND y.form = 'present'))
  SELECT graph, first_form, second_form, way, sentence FROM (SELECT *, trim({_TEXT}) AS sentence FROM said_) QUALIFY row_number() OVER (PARTITION BY graph, sentence ORDER BY r) = 1""")(
    lambda s, d: _pair_prompts(s, d).select("graph", "first_form", "second_form", "way", "sentence")
)

# vocabulary

register("q_object_label", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'object' WHEN p_size % 4 = 1 THEN lower(p_type) WHEN p_size % 4 = 2 THEN p_brand ELSE lower(p_type) || ' ' || p_brand END AS label FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", vo.object_label(F.when(C("p_size") % 2 == 1, F.lower("p_type")), F.when(C("p_size") % 4 >= 2, C("p_brand"))).alias("label"))
)
register("q_motion_label", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'motion' WHEN p_size % 4 = 1 THEN 'rotate' WHEN p_size % 4 = 2 THEN 'agent: ' || p_brand || ', ' || p_type ELSE 'rotate agent: ' || p_brand || ', ' || p_type END AS label FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", vo.motion_label(F.when(C("p_size") % 2 == 1, "rotate"), F.when(C("p_size") % 4 >= 2, F.array("p_brand", "p_type"))).alias("label"))
)
_ENTRIES = ('"%s"', '{"word": "%s"}', '{"text": "%s"}', '{"prep": "by", "np": {"det": "the", "adj": {"word": "big"}, "noun": "%s", "noun2": "box"}}', '{"prep": "by", "noun": "%s"}', '{"other": "%s"}')
register("q_vocab_text", "SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN p_brand WHEN p_partkey % 6 = 3 THEN 'by the big ' || p_brand || ' box' WHEN p_partkey % 6 = 4 THEN 'by ' || p_brand ELSE '' END AS said FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", vo.entry_text(F.replace(F.get(F.array(*map(F.lit, _ENTRIES)), (C("p_partkey") % 6).cast("int")), F.lit("%s"), C("p_brand"))).alias("said"))
)
register("q_labelled_synonyms", "SELECT p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda w, i: (p_size + i) % 2 = 1 AND i <= 2), ',') AS found FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(vo.labelled(F.split("p_type", " "), F.array((C("p_size") + 1) % 2, (C("p_size") + 2) % 2)), ",").alias("found"))
)
register("q_doc_section", "SELECT item_id, ltrim(string_split('head' || chr(10) || '### Part' || chr(10) || chr(10) || text || '### Part tail', '### Part')[2], chr(10)) AS section FROM benchmark")(
    lambda s, d: load(s, d, "benchmark").select("item_id", vo.section_after(F.concat(F.lit("head\n### Part\n\n"), "text", F.lit("### Part tail")), "### Part").alias("section"))
)
register("q_template_render", "SELECT p_partkey, 'Make ' || p_name || ' move ' || p_size || ' px ({{other}}), ' || p_name AS said FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", tx.render(F.lit("Make {{object}} move {{size}} px ({{other}}), {{object}}"), {"object": C("p_name"), "size": C("p_size")}).alias("said"))
)
register("q_group_type", "SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 3) IN ('TIN', 'BRASS') THEN 'soft' WHEN split_part(p_type, ' ', 3) = 'STEEL' THEN 'hard' END AS kind FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", vo.group_of(F.get(F.split("p_type", " "), F.lit(2)), {"soft": ("TIN", "BRASS"), "hard": ("STEEL", "TIN")}).alias("kind"))
)
register("q_id_padding", "SELECT p_partkey, p_brand || '_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part")(
    lambda s, d: load(s, d, "part").select("p_partkey", vo.padded_id(C("p_brand"), C("p_partkey")).alias("id"))
)
register("q_map_merge", "SELECT p_partkey, 'a=' || p_size || ',b=' || p_type || ',c=' || p_brand AS merged FROM part")(
    lambda s, d: load(s, d, "part").withColumn("m", vo.merged(F.create_map(F.lit("a"), C("p_size").cast("string"), F.lit("b"), C("p_brand")), F.create_map(F.lit("b"), C("p_type"), F.lit("c"), C("p_brand")))).select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))
)
register("q_animation_set_equality", "WITH t AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber % 2 = 0))) AS a, list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber % 2 = 1))) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(a, []) = coalesce(b, []) AS same FROM t")(
    lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(C("l_linenumber") % 2 == 0, C("l_returnflag"))).alias("a"), F.collect_list(F.when(C("l_linenumber") % 2 == 1, C("l_returnflag"))).alias("b")).select("l_orderkey", vo.same_set(C("a"), C("b")).alias("same"))
)

__all__ = ["motions"]
