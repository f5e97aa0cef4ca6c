"""Line deduplication over a corpus: exact copies, and copies within a budget of edits by a segment-partition join.

A line is dropped if an equal line, or a near one, comes earlier in the corpus. Lines come in the order of (doc_id, hash of the text, position), so that
rows with one doc_id and different texts are different documents. Exact copies go at every length; blank lines stay. Near copies are looked for among lines of
at least ``least`` characters: two lines are near if they are within one character edit or, where the longer one has at least ``per_edit`` words, within
w // ``per_edit`` word edits (at most ``most``; w: its words). Words are what single spaces separate.

**Near copies.** A line's symbols are its words, and in lines of fewer than 2 * ``per_edit`` words also its characters. A line whose budget is k is
cut into k + 1 segments of nearly equal length. k edits leave one segment of the shorter line untouched; it then stands in the longer one, shifted
by at most the edits on either side of it. So each line indexes its segments under (budget, length, segment number, hash), and probes
the indexes of its own and the k lesser lengths with just the substrings that can match. Candidates are verified by an
edit distance that runs one bit-parallel automaton over the band of 2k + 1 diagonals.

**Scale.** Only hashes are shuffled, pre-aggregated, until it is known which keys two different lines share; texts are read again for those lines alone.
Near lines are not expanded into pairs: of all lines that share a key, each is first held against the earliest one, which is one pair a line.
Lines that this leaves undecided meet the others of their keys, those whose word sketches allow for so few edits. A key with more than ``SMALL`` undecided lines
is first divided: the segment that they share is cut out, and what is left of each is a shorter line within the same budget, which is cut into segments in
turn, until few lines share a key (a common beginning of log lines is passed over this way). Whether a line is near to
an earlier one is thus decided exactly, while the links inside a group of near copies are never listed; a dropped line names one earlier line.

Everything is DataFrame functions. Tables of ids are broadcast only while they are few; beyond, they join in a shuffle.

Results: a null text has no lines and stays null; an empty one has one empty line, which stays. A null doc_id comes before all others. Repeated
rows (same id and text) are one document to the rule and each get the same result. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from frameloom.llm.common import discard, materialise

#: Characters from which near copies are looked for, words for each word edit, greatest number of word edits.
LEAST, PER_EDIT, MOST = 20, 20, 3
#: Rows of ids that may be broadcast (up to 40 bytes each); more are joined in a shuffle.
BROADCAST_ROWS = 150_000
#: Undecided lines that may meet all lines of their key, and how often a key with more is divided.
SMALL, LEVELS = 1024, 10
#: A key, what it is of (0: characters, else words with so many edits), and the place it has in its line.
PLACED = "struct<k:bigint,kind:int,at:int,size:int>"
#: Symbols after which the automaton looks whether it can stop.
STRETCH = 16


def place(d: Column, t: Column, pos: Column, kind) -> Column:
    """A line's place in the corpus as one sortable value, null ids first: a number for integral ids (it aggregates in hash tables), else a struct."""
    if not isinstance(kind, IntegralType):
        return F.struct(d.alias("d"), t.alias("t"), pos.alias("pos"))
    low = F.shiftleft(t.bitwiseAND(F.lit((1 << 31) - 1)), 31) + pos
    return F.coalesce(d.cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(19,0)")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that isn't blank: ``d`` (id), ``t`` (hash of the text), ``pos``, ``place``, ``line``, and two hashes of it."""
    texts = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("x"))  # hashed once a text, not once a line
    lines = texts.select("d", "t", F.posexplode(F.split("x", "\n")).alias("pos", "line"))
    at = place(F.col("d"), F.col("t"), F.col("pos"), docs.schema[id_col].dataType)
    return lines.where(F.length(F.trim("line")) > 0).select("d", "t", "pos", at.alias("place"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def budget(words: Column, per_edit: int, most: int) -> Column:
    """Word edits within which a line of so many words, as the longer one, is near to another."""
    return F.least(F.floor(words / F.lit(per_edit)).cast("int"), F.lit(most))


def segment_starts(n: Column, i: int, parts: int) -> Column:
    """Start (from 0) of segment i of a line of n symbols."""
    return F.lit(0) if i == 0 else n if i == parts else F.floor(n * F.lit(i) / F.lit(parts)).cast("int")


def _placed(key: Column, kind: int, at: Column, size: Column) -> Column:
    return F.struct(key.alias("k"), F.lit(kind).alias("kind"), at.alias("at"), size.alias("size")).cast(PLACED)


def _key(n: Column, less: int, i: int, edits: int, shift: int, cut, tag: str, placed: bool = False, group: tuple = ()) -> Column:
    """Hash of what a line of n symbols has at the place of segment i of a line that is shorter by ``less``, shifted; null if it doesn't fit.

    The last bit tells whether it is a segment of the line itself, which its index holds. ``group`` names a key that is divided by this one;
    with ``placed`` the key comes with its place.
    """
    m = n - F.lit(less) if less else n
    begin, end = segment_starts(m, i, edits + 1), segment_starts(m, i + 1, edits + 1)
    at, size = begin + F.lit(shift) if shift else begin, end - begin if i else end
    value = F.xxhash64(*group, F.lit((100 if tag == "w" else 0) + 10 * edits + i), m, cut(at + 1, size)).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(int(less == shift == 0)))
    if placed:
        value = _placed(value, edits if tag == "w" else 0, at, size)
    fits = end > begin
    if shift < 0:
        fits &= at >= 0
    if shift > less:  # else it ends by the end of the line
        fits &= end + F.lit(shift) <= n
    return F.when(fits, value)


def index_keys(n: Column, edits: int, cut, tag: str, placed: bool = False) -> list[Column]:
    """Keys of a line's own segments."""
    return [_key(n, 0, i, edits, 0, cut, tag, placed) for i in range(edits + 1)]


def probe_keys(n: Column, edits: int, cut, tag: str, placed: bool = False, group: tuple = ()) -> list[Column]:
    """Keys of the substrings that can be a segment of a line that is shorter by up to ``edits`` (its own segments among them).

    A substring is shifted by no more than the edits on its left, and on its right.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                out.append(_key(n, less, i, edits, shift, cut, tag, placed, group))
    return out


def line_keys(per_edit: int, most: int, placed: bool = False) -> Column:
    """All keys (some null) of a line that has the columns ``line, n_chars, n_words, hashes`` (of its words)."""
    n, c = F.col("n_words"), F.col("n_chars")
    none = F.array().cast(f"array<{PLACED if placed else 'bigint'}>")
    words = lambda at, size: F.slice("hashes", at, size)
    own = budget(n, per_edit, most)
    keys = [F.when(n < 2 * per_edit, F.array(*probe_keys(c, 1, lambda at, size: F.substring("line", at, size), "c", placed))).otherwise(none)]
    probes = none
    for k in range(1, most + 1):
        probes = F.when(own == k, F.array(*probe_keys(n, k, words, "w", placed))).otherwise(probes)
        # lines that a longer one of the next budget can be near to stand in that budget's index too
        keys.append(F.when((own < k) & (budget(n + k, per_edit, most) >= k), F.array(*index_keys(n, k, words, "w", placed))).otherwise(none))
    return F.concat(probes, *keys)


def divided_keys(most: int) -> Column:
    """Keys that divide the group ``key``, of what is left of a member (``words``, or ``chars`` where ``kind`` is 0), with their places.

    What is left may be too short for segments that hold something: if the shorter of two has at most as many symbols as edits. With one edit, the longer one
    then has two symbols of which the other is one, or neither has over one; with more edits, all that are so short meet.
    """
    def keys(n: Column, edits: int, cut, kind: int) -> Column:
        def short(own: Column, *what: Column) -> Column:
            return _placed(F.xxhash64("key", F.lit("short"), *what).bitwiseAND(F.lit(-2)).bitwiseOR(own.cast("long")), kind, F.lit(0), F.lit(0))

        if edits == 1:
            ends = [F.when(n == 2, short(F.lit(0), cut(F.lit(k), F.lit(1)))) for k in (1, 2)]
            ends += [F.when(n == 1, short(F.lit(1), cut(F.lit(1), F.lit(1)))), F.when(n <= 1, short(F.lit(1)))]
        else:
            ends = [F.when(n <= 2 * edits, short(n <= edits))]
        return F.array(*probe_keys(n, edits, cut, "w" if kind else "c", True, (F.col("key"),)), *ends)

    out = F.when(F.col("kind") == 0, keys(F.length("chars"), 1, lambda at, size: F.substring("chars", at, size), 0))
    for k in range(1, most + 1):
        out = out.when(F.col("kind") == k, keys(F.size("words"), k, lambda at, size: F.slice("words", at, size), k))
    return out


def without_segments(members: DataFrame, placed: Column, columns: list[str]) -> DataFrame:
    """A row for each of a member's ``placed`` keys, with what is left of its ``words`` and ``chars`` when the key's segment is cut out."""
    each = members.withColumn("p", F.explode(placed)).where("p is not null")
    at, after, kind = F.col("p.at"), F.col("p.at") + F.col("p.size"), F.col("p.kind")
    words = F.concat(F.slice("words", F.lit(1), at), F.slice("words", after + 1, F.greatest(F.size("words") - after, F.lit(0))))
    chars = F.concat(F.substring("chars", F.lit(1), at), F.substring("chars", after + 1, F.length("chars")))
    key, own = F.col("p.k").bitwiseAND(F.lit(-2)), F.col("p.k").bitwiseAND(F.lit(1))
    held = [own.alias(c) if c == "own" else F.col(c) for c in columns]
    return each.select(key.alias("key"), *held, kind.alias("kind"), F.when(kind > 0, words).alias("words"), F.when(kind == 0, chars).alias("chars"))


def word_sketch(hashes: Column, shift: int) -> Column:
    """For each of 64 classes of words, whether the line has an odd number of them. A word edit changes at most two bits, a character edit three."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(bit(h)))


def word_hashes(line: Column) -> Column:
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def shared_length(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix, at most ``most``, by doubling steps down from 2^20 (texts that share more count as sharing that much)."""
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(21))]), F.lit(0), lambda s, step: F.when((s + step <= most) & (F.left(a, s + step) == F.left(b, s + step)), s + step).otherwise(s))


def stripped(a: Column, b: Column, words: bool, then) -> Column:
    """``then`` of what is left of two texts when their common beginning and end are gone, both turned around (which changes no distance). With ``words`` only whole words go."""
    def ends(x: Column, y: Column, next_) -> Column:
        def cut(p: Column) -> Column:
            p = p - F.length(F.substring_index(F.left(x, p), " ", -1)) if words else p
            return let(p, lambda q: next_(F.substring(x, q + 1, F.length(x)), F.substring(y, q + 1, F.length(y))))

        return let(shared_length(x, y, F.least(F.length(x), F.length(y))), cut)

    def turned(x: Column, y: Column) -> Column:
        return let(F.struct(F.reverse(x).alias("a"), F.reverse(y).alias("b")), lambda s: ends(s["a"], s["b"], then))

    return ends(a, b, turned)


def within(a: Column, b: Column, edits: int, words: bool) -> Column:
    """Whether two different texts are within so many edits of their words, or else of their characters."""
    symbols = lambda x: F.split(x, " ") if words else F.filter(F.split(x, ""), lambda c: c != "")
    return stripped(a, b, words, lambda x, y: distance_within(symbols(x), symbols(y), edits).isNotNull())


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used. (What ``then`` returns is copied: no large arrays.)"""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _automaton(x: Column, y: Column, n: Column, edits: int) -> Column:
    """State after ``n`` symbols of the array ``y``: a long that holds, for each number of errors, a slot with a bit for each diagonal that is reachable."""
    width = 2 * edits + 1
    slots = range(edits + 1)

    def each(slot: int) -> Column:
        """The same bits in every slot."""
        return F.lit(sum(slot << width * e for e in slots))

    begin, reach = 0, 1 << edits
    for e in slots:
        begin |= reach << width * e
        reach |= reach << 1 & (1 << width) - 1
    every, last = each((1 << width) - 1), F.lit((1 << width) - 1 << width * edits)

    def moved(s: Column) -> Column:
        """Symbols of ``x`` that are passed over: each costs an error and leads to the diagonal above."""
        return reduce(Column.bitwiseOR, [F.shiftleft(s.bitwiseAND(each((1 << width - j) - 1)), j * (width + 1)) for j in slots]).bitwiseAND(every)

    def step(s: Column, j: Column) -> Column:
        hit = sum((F.when(F.get(x, j + F.lit(o - edits)) == F.get(y, j), F.lit(1 << o)).otherwise(F.lit(0)) for o in range(width)), F.lit(0)).cast("long")
        cost = F.shiftleft(s.bitwiseOR(F.shiftrightunsigned(s, 1).bitwiseAND(each((1 << width - 1) - 1))), width)  # a substitution, or a symbol of y alone
        return let(s.bitwiseAND(hit * each(1)).bitwiseOR(cost).bitwiseAND(every), moved)

    def stretch(s: Column, first: Column) -> Column:
        """The next ``STRETCH`` symbols, unless no diagonal is left."""
        return F.when(s.bitwiseAND(last) == 0, s).otherwise(F.aggregate(F.sequence(first, F.least(first + F.lit(STRETCH), n) - 1), s, step))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(STRETCH)), F.lit(begin).cast("long"), stretch)


def distance_within(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two arrays of symbols, null if over ``edits``.

    For each number of errors one slot of a word holds the diagonals of the band that are reachable with at most so many; a symbol
    of ``y`` moves all of them at once (matches stay on their diagonal; a substitution, an insertion or a deletion costs one error).
    """

    def run(s: Column) -> Column:
        m, n = F.size(s["x"]), F.size(s["y"])

        def least(final: Column) -> Column:
            found = F.lit(None).cast("int")
            for e in reversed(range(edits + 1)):  # the bit of the diagonal on which both end
                found = F.when(F.call_function("getbit", final, m - n + F.lit(edits + e * (2 * edits + 1))) == 1, F.lit(e)).otherwise(found)
            return found

        whole = F.when((m == 0) | (n == 0), m + n).otherwise(let(_automaton(s["x"], s["y"], n, edits), least))
        return F.when(F.abs(m - n) <= edits, whole)

    return let(F.struct(x.alias("x"), y.alias("y")), run)


def near_pairs(pairs: DataFrame, texts: DataFrame, per_edit: int, most: int, cuts: int) -> DataFrame:
    """Those of ``pairs`` (``u``, ``x``: hashes of lines) that are near lines: ``u, x``."""
    side = lambda s: texts.select(*[F.col(c).alias(f"{s}_{c}") for c in ("h1", "line", "n_chars", "n_words")])
    both = pairs.join(side("a"), F.col("u") == F.col("a_h1")).join(side("b"), F.col("x") == F.col("b_h1")).repartition(cuts, "u", "x")
    longer = F.greatest("a_n_words", "b_n_words")
    k = budget(longer, per_edit, most)
    words = F.lit(False)
    for edits in range(1, most + 1):
        words = F.when(k == edits, within(F.col("a_line"), F.col("b_line"), edits, True)).otherwise(words)
    chars = (longer < 2 * per_edit) & (F.abs(F.col("a_n_chars") - F.col("b_n_chars")) <= 1)
    near = F.when(chars, within(F.col("a_line"), F.col("b_line"), 1, False)).otherwise(False) | words
    return both.select(F.explode(F.when(near, F.array(F.struct("u", "x")))).alias("p")).select("p.*")  # a filter would be moved ahead of the even dealing


def _few(ids: DataFrame) -> DataFrame:
    """A materialised table, marked for broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def near_copies(lines: DataFrame, texts_of, per_edit: int, most: int, cuts: int) -> DataFrame:
    """``h1, h2, x``: the lines that are near to an earlier line, and the hash of one such line.

    ``lines`` has ``h1, place, keys`` for each occurrence; ``texts_of`` gives ``h1, h2, line, n_chars`` of the lines in a table of ``h1, place``.
    """
    each = lines.select("h1", F.explode("keys").alias("k")).where("k is not null")
    key, own = F.col("k").bitwiseAND(F.lit(-2)).alias("key"), F.col("k").bitwiseAND(F.lit(1))
    shared = each.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max(own).alias("own")).where("lo <> hi and own = 1").select("key")
    shared = materialise(shared, "line-keys")
    met = lines.select("h1", "place", F.explode("keys").alias("k")).where("k is not null").withColumn("key", key).join(_few(shared), "key")
    alone = materialise(met.groupBy("key", "h1").agg(F.min("place").alias("place"), F.max(own).alias("own")), "line-keyed")
    discard(shared)
    texts = texts_of(materialise(alone.select("h1", "place").distinct(), "line-ids")).withColumn("hashes", word_hashes(F.col("line")))
    sketches = [word_sketch(F.col("hashes"), 6 * i).alias(f"sketch{i}") for i in (0, 1)]
    texts = materialise(texts.select("h1", "h2", "line", "n_chars", F.size("hashes").alias("n_words"), *sketches), "line-texts")
    columns = ["h1", "place", "n_words", "n_chars", "sketch0", "sketch1", "own"]
    met = materialise(alone.join(_few(texts.select("h1", *columns[2:6])), "h1").select("key", *columns), "line-members")
    discard(alone)
    near = lambda pairs: near_pairs(pairs.select(F.col("u_h1").alias("u"), F.col("x_h1").alias("x")).distinct(), texts, per_edit, most, cuts).groupBy("u").agg(F.min("x").alias("x"))

    against = lambda some, others: some.select("key", *[F.col(c).alias(f"u_{c}") for c in columns]).join(others, "key").where(may_be_near(per_edit, most))

    def undecided(some: DataFrame) -> DataFrame:
        return some.join(_few(reduce(DataFrame.union, found).select(F.col("u").alias("h1"))), "h1", "left_anti") if found else some

    def meet_earliest(some: DataFrame) -> None:
        """Every undecided line against the earliest line of each of its keys."""
        earliest = some.groupBy("key").agg(F.min("place").alias("x_place"), *[F.min_by(c, "place").alias(f"x_{c}") for c in columns if c != "place"])
        found.append(materialise(near(against(undecided(some), earliest)), "line-near"))

    found: list[DataFrame] = []
    meet_earliest(met)
    groups, calm = met, []
    for level in range(LEVELS + 1):
        hot = materialise(undecided(groups).groupBy("key").count().where(F.col("count") > SMALL).select("key"), "line-hot")
        if level == LEVELS or hot.isEmpty():
            calm.append(groups)
            break
        calm.append(groups.join(_few(hot), "key", "left_anti"))
        crowded = groups.join(_few(hot), "key")
        if level == 0:
            crowded = crowded.join(texts.select("h1", "line"), "h1").withColumn("hashes", word_hashes(F.col("line"))).withColumn("words", F.col("hashes")).withColumn("chars", F.col("line"))
            own = F.filter(line_keys(per_edit, most, True), lambda q: q["k"].bitwiseAND(F.lit(-2)) == F.col("key"))
            crowded = without_segments(crowded, own, columns)
        parts = materialise(without_segments(crowded, F.array_distinct(divided_keys(most)), columns), "line-parts")
        shared = parts.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("own").alias("own")).where("lo <> hi and own = 1").select("key")
        groups = materialise(parts.join(_few(materialise(shared, "line-keys")), "key"), "line-groups")
        discard(parts)
        meet_earliest(groups)

    # what is left against all earlier lines of its keys
    others = lambda some: some.select("key", *[F.col(c).alias(f"x_{c}") for c in columns])
    more = near(reduce(DataFrame.union, [against(undecided(some), others(some)).select("u_h1", "x_h1") for some in calm]))
    return texts.select("h1", "h2").join(reduce(DataFrame.union, [*found, more]), F.col("h1") == F.col("u")).select("h1", "h2", "x")


def may_be_near(per_edit: int, most: int) -> Column:
    """Whether ``x_`` comes before ``u_``, one of them probes what the other indexes, and their lengths and word sketches allow for so few edits."""
    longer = F.greatest("u_n_words", "x_n_words")
    k = budget(longer, per_edit, most)
    apart = F.greatest(*[F.bit_count(F.col(f"u_sketch{i}").bitwiseXOR(F.col(f"x_sketch{i}"))) for i in (0, 1)])
    by_words = (F.abs(F.col("u_n_words") - F.col("x_n_words")) <= k) & (apart <= 2 * k)
    by_chars = (longer < 2 * per_edit) & (F.abs(F.col("u_n_chars") - F.col("x_n_chars")) <= 1) & (apart <= 3)
    return (F.col("u_place") > F.col("x_place")) & (F.col("u_own") + F.col("x_own") > 0) & (by_words | by_chars)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_edit: int = PER_EDIT, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Dropped lines of each document that has some: ``d, t`` (id, text hash), ``exact`` and ``near`` (positions), ``of`` (for each near one the id of a document with an earlier near line)."""
    spark = docs.sparkSession
    seen = occurrences(docs, id_col, text_col).withColumn("n_chars", F.length("line"))
    keyed = seen.withColumn("hashes", F.when(F.col("n_chars") >= least, word_hashes(F.col("line")))).withColumn("n_words", F.size("hashes"))
    lines = materialise(keyed.select("d", "t", "pos", "place", "h1", "h2", F.when(F.col("n_chars") >= least, line_keys(per_edit, most)).alias("keys")), "lines")

    def texts_of(ids: DataFrame) -> DataFrame:
        holders = materialise(lines.join(_few(ids), ["h1", "place"]).select(F.col("d").alias("__ld_d"), F.col("t").alias("__ld_t")).distinct(), "line-holders")
        some = docs
        if holders.count() <= BROADCAST_ROWS:  # only documents that hold such a line are split again
            some = docs.join(F.broadcast(holders), docs[id_col].eqNullSafe(F.col("__ld_d")) & (F.xxhash64(docs[text_col]) == F.col("__ld_t")), "left_semi")
        found = occurrences(some, id_col, text_col).join(_few(ids), ["h1", "place"])
        return found.dropDuplicates(["h1", "h2"]).select("h1", "h2", "line", F.length("line").alias("n_chars"))

    near = materialise(near_copies(lines.where("keys is not null"), texts_of, per_edit, most, int(spark.conf.get("spark.sql.shuffle.partitions"))), "line-copies")
    firsts = lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("count")).join(near, ["h1", "h2"], "left").where("count > 1 or x is not null")
    firsts = materialise(firsts.select("h1", "h2", "first", "x"), "line-firsts")
    named = lines.select(F.col("h1").alias("x"), "place", "d").join(_few(materialise(firsts.where("x is not null").select("x").distinct(), "line-named")), "x").groupBy("x").agg(F.min_by("d", "place").alias("of"))
    firsts = materialise(firsts.join(named, "x", "left").select("h1", "h2", "first", F.col("x").isNotNull().alias("near"), "of"), "line-verdicts")
    marked = lines.select("d", "t", "pos", "place", "h1", "h2").join(_few(firsts), ["h1", "h2"]).withColumn("copy", F.col("place") != F.col("first"))
    return (
        marked.where(F.col("copy") | F.col("near")).groupBy("d", "t")
        .agg(F.array_sort(F.collect_set(F.when(F.col("copy"), F.col("pos")))).alias("exact"), F.array_sort(F.collect_set(F.when(~F.col("copy"), F.struct("pos", "of")))).alias("near"))
        .select("d", "t", "exact", F.col("near.pos").alias("near"), F.col("near.of").alias("of"))
    )


def _joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = found.select(*[F.col(c).alias(f"__ld_{c}") for c in found.columns])
    return docs.join(found, docs[id_col].eqNullSafe(F.col("__ld_d")) & (F.xxhash64(docs[text_col]) == F.col("__ld_t")), "left")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_edit: int = PER_EDIT, most: int = MOST, least: int = LEAST) -> DataFrame:
    """A row for each document: ``id_col, n_lines, exact, near`` (positions of dropped lines), ``near_of`` (for each near one the id of a document with an earlier near line), ``n_kept``."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.greatest(F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    found = decisions(docs, id_col, text_col, per_edit, most, least)
    out = slim.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left")
    none, ids = F.array().cast("array<int>"), F.array().cast(found.schema["of"].dataType)
    out = out.select(F.col("id").alias(id_col), "n_lines", F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"), F.coalesce("of", ids).alias("near_of"))
    return out.withColumn("n_kept", F.col("n_lines") - F.size("exact") - F.size("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_edit: int = PER_EDIT, most: int = MOST, least: int = LEAST) -> DataFrame:
    """``docs`` with all columns and rows, and without the dropped lines in ``text_col``."""
    out = _joined(docs, decisions(docs, id_col, text_col, per_edit, most, least), id_col, text_col)
    gone = F.array_union(F.col("__ld_exact"), F.col("__ld_near"))
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col("__ld_d").isNull() & F.col("__ld_t").isNull(), docs[text_col]).otherwise(kept)
    return out.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
