"""Phrase collocations, counted by depth-limited tries.

**Shards.** A worker numbers the words of a block of texts in byte order and lists, for each word, the four words from it on that lie in its piece (zeros where the piece ends). Sorted and counted, these
sequences are the trie of the block: a node is a run of rows that begin alike, and its count is the sum of the run. So the trie is serialised as it is sorted, in slices by prefix
range: sequences from one bound up to the next. A node whose run goes on across a bound is whole in no slice; each slice also carries what such nodes (at most three on either
side, the beginnings of its two bounds) count outside of it.

**Merge.** Slices of one language and range meet in one worker, which renumbers their words and merges the sorted runs (a stable sort of runs that are sorted already). A walk from a sequence's root
gives the counts of its nodes, so that each frequent phrase has the counts of its left parts. The bounds come from a sample of the texts and only balance the ranges; ranges grow in number with the input.

**Links.** The suffix link of a phrase is the phrase without its first word. Frequent phrases are joined along these links, from one word up; each takes over its link's count and right parts. (Every part of a
frequent phrase is frequent.) Candidates, cuts, scores and dropping are then columns of the frequent phrases.

**Scale.** What is shuffled is one counted row for each block and sequence, in compressed slices; a frequent word or phrase has one row in each slice, however often it occurs. Bounds are
at most ``BOUND`` bytes a word, one for each ``range_bytes`` of text: that parameter is what a worker's memory holds of a range, and may grow with it (at 100 TB and 256 MB a range, tasks carry some
40 MB of bounds).

Results: a null or empty text has no words; a null language is ``und``; repeated rows count each; an empty table has no rows. A text of any length is cut into blocks between words, with
the three words after a block looked at but not counted. Words of any length are kept whole. Ids and other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, materialise

DEPTH = 4
LEAST = 30
TOP = 2000
#: Words of a block; bytes of a text that are split at a time.
BLOCK, CHUNK = 1 << 20, 1 << 23
#: Bytes of text for each prefix range.
RANGE_BYTES = 8 << 20
#: Texts, and sequences of them, of which bounds are drawn; bytes of a bound's word.
SAMPLE_TEXTS, SAMPLE, BOUND = 2000, 20_000, 48
#: Parts of a language that are ranked by themselves first.
SALTS = 64
#: Piece ends become line ends, tabs become blanks; only A-Z are lower-cased.
_LETTERS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")
_BREAK = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with breaks between pieces."""
    return [w for w in text.translate(_LETTERS).replace(b"\n", b" \n ").split(b" ") if w]


def stretches(text: bytes, block: int, chunk: int = CHUNK) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The words of a text, ``block`` at a time, and the three after them; a long text isn't split whole."""
    words: list[bytes] = []
    at = 0
    while at < len(text):
        end = text.find(b" ", at + chunk)
        end = len(text) if end < 0 else end
        words += tokens(text[at:end])
        at = end
        while len(words) >= block + DEPTH - 1:
            yield words[:block], words[block : block + DEPTH - 1]
            words = words[block:]
    yield words, []


class Trie:
    """Counted sequences of one block: ``rows`` (word numbers from 1, zeros after a piece's end), sorted, their ``counts`` and the ``words`` in byte order."""

    def __init__(self, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.rows, self.counts = words, rows, counts
        self.before = np.r_[0, np.cumsum(counts)]

    def span(self, prefix: tuple[bytes, ...]) -> tuple[int, int]:
        """Rows that begin with ``prefix``; where there are none, the place where they would be."""
        low, high = 0, len(self.rows)
        for depth, word in enumerate(prefix):
            at = bisect_left(self.words, word) + 1
            known = at <= len(self.words) and self.words[at - 1] == word
            column = self.rows[low:high, depth]
            start = low + int(np.searchsorted(column, at, "left"))
            high = low + int(np.searchsorted(column, at, "right")) if known else start
            low = start
        return low, high

    def slices(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
        """``range, data`` of every range in which the trie has rows, or nodes that reach into it."""
        at = [0, *[self.span(b)[0] for b in bounds], len(self.rows)]
        outside = [[self.span(b[:d]) for d in range(1, min(len(b), DEPTH))] for b in bounds]
        for i, (low, high) in enumerate(zip(at, at[1:])):
            beyond = []
            for b in (i - 1, i):
                for start, end in outside[b] if 0 <= b < len(bounds) else ():
                    inner = max(start, low), min(end, high)
                    whole, inside = self.before[end] - self.before[start], self.before[inner[1]] - self.before[inner[0]] if inner[0] < inner[1] else 0
                    beyond.append(int(whole - inside))
            if low < high or any(beyond):
                yield i, _pack(self.words, self.rows[low:high], self.counts[low:high], beyond)


def build(words: list[bytes], ids: np.ndarray, own: int) -> Trie:
    """The trie of word numbers ``ids`` (0 at breaks) in byte order of ``words``; only the first ``own`` begin a sequence."""
    x = np.r_[ids, np.zeros(DEPTH, np.int64)]
    n = len(ids)
    two = np.where(x[:-1] > 0, x[:-1] * (len(words) + 1) + x[1:], 0)  # a pair that starts at a break is no pair
    pairs, at = np.unique(two, return_inverse=True)  # the first is no pair, as x ends with zeros
    first, second = at[:n][:own], np.where(x[1 : n + 1] > 0, at[2 : n + 2], 0)[:own]
    four, counts = np.unique((first * len(pairs) + second)[x[:n][:own] > 0], return_counts=True)
    left, right = pairs[four // len(pairs)], pairs[four % len(pairs)]
    v = len(words) + 1
    return Trie(words, np.stack([left // v, left % v, right // v, right % v], axis=1), counts)


def _pack(words: list[bytes], rows: np.ndarray, counts: np.ndarray, beyond: list[int]) -> bytes:
    used, local = np.unique(rows, return_inverse=True)
    names = [words[i - 1] for i in used.tolist() if i]
    local = local.reshape(rows.shape) + (0 if len(used) and used[0] == 0 else 1)
    table = pa.table({f"w{d}": pa.array(local[:, d].astype(np.int32)) for d in range(DEPTH)} | {"n": pa.array(counts)})
    table = table.replace_schema_metadata({"beyond": ",".join(map(str, beyond))})
    sink = pa.BufferOutputStream()
    option = pa.ipc.IpcWriteOptions(compression="zstd")
    for t in (table, pa.table({"w": pa.array(names, pa.large_binary())})):
        with pa.ipc.new_stream(sink, t.schema, options=option) as out:
            out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, list[int]]:
    source = pa.BufferReader(data)
    with pa.ipc.open_stream(source) as stream:
        table = stream.read_all()
    with pa.ipc.open_stream(source) as stream:
        names = stream.read_all().column(0).to_pylist()
    beyond = table.schema.metadata[b"beyond"].decode()
    rows = np.stack([table.column(d).to_numpy() for d in range(DEPTH)], axis=1).astype(np.int64)
    return names, rows, table.column(DEPTH).to_numpy(), [int(v) for v in beyond.split(",") if v]


class Block:
    """Words of one language until they make a trie."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        known = self.known
        self.parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        self.size += len(words)

    def trie(self, ahead: int = 0) -> Trie:
        """The trie of what was added, of which the last ``ahead`` begin no sequence."""
        names = list(self.known)[1:]
        order = sorted(range(len(names)), key=names.__getitem__)
        number = np.zeros(len(names) + 1, np.int64)
        number[np.array(order, np.int64) + 1] = np.arange(1, len(names) + 1)
        ids = number[np.concatenate(self.parts)] if self.parts else np.zeros(0, np.int64)
        return build([names[i] for i in order], ids, len(ids) - ahead)


def tries(texts: Iterator[tuple[str, bytes]], block: int = BLOCK) -> Iterator[tuple[str, Trie]]:
    """Tries of a stream of languages and texts."""
    open_: dict[str, Block] = {}
    held = 0
    for lang, text in texts:
        for part, ahead in stretches(text, block):
            now = open_.setdefault(lang, Block())
            was = now.size
            now.add(part + ahead if ahead else [*part, _BREAK])
            held += now.size - was
            if ahead:  # the text goes on: its block ends here
                held -= now.size
                yield lang, open_.pop(lang).trie(len(ahead))
        if held >= block:  # languages share a worker's memory
            for of, b in open_.items():
                yield of, b.trie()
            open_, held = {}, 0
    for of, b in open_.items():
        yield of, b.trie()


def merge(slices: list[bytes], low: tuple[bytes, ...], high: tuple[bytes, ...]) -> tuple[Trie, dict[tuple[bytes, ...], int]]:
    """The trie of a range from its slices, and what the nodes at its bounds count outside of it."""
    each = [_unpack(s) for s in slices]
    words = sorted(set().union(*(names for names, *_ in each)))
    number = {w: i + 1 for i, w in enumerate(words)}
    rows = np.concatenate([np.array([0, *map(number.__getitem__, names)], np.int64)[own] for names, own, *_ in each])
    counts = np.concatenate([n for _, _, n, _ in each])
    v = len(words) + 1
    pairs, at = np.unique(np.concatenate([rows[:, 0] * v + rows[:, 1], rows[:, 2] * v + rows[:, 3]]), return_inverse=True)
    key = at[: len(rows)] * len(pairs) + at[len(rows) :]
    order = np.argsort(key, kind="stable")  # sorted runs one after the other: a merge
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    trie = Trie(words, rows[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts)
    edges = [b[:d] for b in (low, high) for d in range(1, min(len(b), DEPTH))]
    outside: dict[tuple[bytes, ...], int] = dict.fromkeys(edges, 0)
    for *_, beyond in each:
        for prefix, n in dict(zip(edges, beyond)).items():
            outside[prefix] += n
    return trie, outside


def frequent(trie: Trie, outside: dict[tuple[bytes, ...], int], least: int, cuts: list[tuple[bytes, ...]], part: int) -> Iterator[tuple[tuple[bytes, ...], list[int]]]:
    """Nodes of the range ``part`` that count ``least`` or more: words, and the counts of their beginnings from one word up to the whole.

    Of the nodes that reach over a bound, those whose own place in the order is in this range, with or without rows of their own here.
    """
    rows = trie.rows
    inside = {p: int(trie.before[high] - trie.before[low]) for p in outside for low, high in [trie.span(p)]}
    for p in outside:
        counts = [outside[p[: d + 1]] + inside[p[: d + 1]] for d in range(len(p))]
        if counts[-1] >= least and bisect_right(cuts, p) == part:
            yield p, counts
    if not len(rows):
        return
    new = np.zeros(len(rows), bool)
    new[0] = True
    total = np.zeros((len(rows), DEPTH), np.int64)
    for d in range(DEPTH):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        start = np.flatnonzero(new)
        total[:, d] = np.repeat(np.add.reduceat(trie.counts, start), np.diff(np.r_[start, len(rows)]))
    for prefix, n in outside.items():
        low, high = trie.span(prefix)
        total[low:high, len(prefix) - 1] += n
    starts = np.r_[np.ones((1, DEPTH), bool), np.maximum.accumulate(rows[1:] != rows[:-1], axis=1)]
    for i, d in np.argwhere(starts & (rows > 0) & (total >= least)).tolist():
        node = tuple(trie.words[w - 1] for w in rows[i, : d + 1].tolist())
        if node not in outside:
            yield node, total[i, : d + 1].tolist()


def bounds(docs: DataFrame, text: str, range_bytes: int = RANGE_BYTES) -> list[tuple[bytes, ...]]:
    """Bounds of the prefix ranges, in order: sequences that part a sample's different sequences evenly."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    wanted = (size or 0) // range_bytes
    if not wanted:
        return []
    share, most = min(1.0, SAMPLE_TEXTS / rows), max(SAMPLE, 4 * wanted)
    step = max(1, round(size * share / 6 / most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                words = tokens(text[:CHUNK])
                for at in range(len(text) % step, len(words), step):
                    some = words[at : at + DEPTH]
                    some = some[: some.index(_BREAK)] if _BREAK in some else some
                    if some:
                        found.append([w[:BOUND] for w in some])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["w"])

    sampled = docs.sample(share, 42).select(F.col(text).cast("binary"))
    found = map_batches(sampled, run, "w array<binary>").distinct().orderBy(F.xxhash64("w")).limit(most).collect()
    drawn = sorted(tuple(map(bytes, r.w)) for r in found)
    return sorted({drawn[len(drawn) * k // (wanted + 1)] for k in range(1, wanted + 1)}) if drawn else []


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, range_bytes: int = RANGE_BYTES, block: int = BLOCK) -> DataFrame:
    """``lang, m, phrase, suffix, lefts, own``: frequent phrases of up to four words with the counts of their beginnings (the last is their own); rows of ``m`` 0 have a part of the language's words in ``own``."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("t")).where("t is not null")
    cuts = bounds(texts, "t", range_bytes)
    ends = [(), *cuts, ()]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for lang, trie in tries(stream, block):
            out = list(trie.slices(cuts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array([i for i, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["lang", "part", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for lang, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if key != (lang, part):
                    yield from close(key, held)
                    key, held = (lang, part), []
                held.append(data.as_py())
        yield from close(key, held)

    def close(key, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        lang, part = key
        trie, outside = merge(held, ends[part], ends[part + 1])
        out = [(0, b"", b"", [], int(trie.counts.sum()))]
        out += [(len(w), b" ".join(w), b" ".join(w[1:]), n, n[-1]) for w, n in frequent(trie, outside, least, cuts, part)]
        m, phrase, suffix, lefts, own = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array(m, pa.int32()), pa.array(phrase, pa.binary()), pa.array(suffix, pa.binary()), pa.array(lefts, pa.list_(pa.int64())), pa.array(own, pa.int64())], names=["lang", "m", "phrase", "suffix", "lefts", "own"])

    shards = map_batches(texts.select("lang", F.col("t").cast("binary").alias("t")), shard, "lang string, part int, data binary")
    dealt = shards.repartition("lang", "part").sortWithinPartitions("lang", "part")
    nodes = map_batches(dealt, gather, "lang string, m int, phrase binary, suffix binary, lefts array<bigint>, own bigint")
    return nodes.withColumns({c: F.col(c).cast("string") for c in ("phrase", "suffix")})


def linked(nodes: DataFrame) -> DataFrame:
    """Phrases of two words and more with ``rights``: the counts of what follows their first word, first two words, and so on, found along suffix links."""
    of = lambda m: nodes.where(F.col("m") == m)
    link, out = of(1).select("lang", F.col("phrase").alias("suffix"), F.array("own").alias("rights")), None
    for m in range(2, DEPTH + 1):
        own = of(m).join(link, ["lang", "suffix"])
        out = own if out is None else out.unionByName(own)
        link = own.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("own"), "rights").alias("rights"))
    return out


def scored(linked_phrases: DataFrame) -> DataFrame:
    """``lang, m, phrase, suffix, a, l, r, score``: each phrase by the cut that scores lowest."""
    wide = lambda c: c.cast("decimal(20,0)")
    cut = lambda i: F.struct(
        F.call_function("div", wide(F.lit(2_000_000)) * wide(F.col("own")), wide(F.get("lefts", i)) + wide(F.get("rights", i))).alias("score"),
        i.alias("k"), F.get("lefts", i).alias("l"), F.get("rights", i).alias("r"),
    )
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.col("m") - 2), cut))
    return linked_phrases.select("lang", "m", "phrase", "suffix", F.col("own").alias("a"), best.alias("b")).select("lang", "m", "phrase", "suffix", "a", "b.l", "b.r", "b.score")


def maximal(found: DataFrame) -> DataFrame:
    """Without phrases of which a longer one has four fifths of the occurrences.

    The longer phrase may be taken as longer by one word: of those inside a still longer one, one occurs at least as often as that.
    """
    longer = found.where("m > 2").select("lang", "a", F.explode(F.array(F.col("suffix"), F.regexp_replace("phrase", r" [^ ]*\z", ""))).alias("inner"))
    most = longer.groupBy("lang", "inner").agg(F.max("a").alias("most"))
    far = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * 80
    return found.join(most.select("lang", F.col("inner").alias("phrase"), "most"), ["lang", "phrase"], "left").where(~F.coalesce(far, F.lit(False))).drop("most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    nodes = materialise(phrases(docs, text_col, lang_col, least), "phrases")
    found = materialise(scored(linked(nodes)), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = maximal(found).withColumn("salt", F.abs(F.xxhash64("phrase") % SALTS))
    for keys in (["lang", "salt"], ["lang"]):  # a language's parts first, then at most SALTS times the result
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    words = nodes.where("m = 0").groupBy("lang").agg(F.sum("own").alias("n"))
    return few.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
