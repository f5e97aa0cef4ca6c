"""Token ids in a content-addressed store: rolling-hash chunks, recipes, Merkle manifests.

Every text is encoded with the ``tokenizers`` library and ended with one end id. A rolling hash over the ids cuts each
document's stream into chunks; cuts depend on content alone, so shared passages give equal chunks. The store is a folder:

* ``chunks``: ``gkey`` (SHA-256 of the ids as little-endian unsigned 32-bit integers), ``n``, ``payload`` (zstd of
  the ids as unsigned 16-bit integers, or 32-bit ones where an id needs it); each distinct chunk is stored once;
* ``recipes``: files in ascending order of ``doc_id``, each document's ``start``, ``n_tokens``, chunk ``keys`` and Merkle ``root`` over them;
* ``manifest``: one Merkle tree over all recipes, kept at three levels: a root for each run of at most 1,024 recipes (leaves: hash of a recipe's id, start,
  length and root), one for each part (range of ids) over its runs, and one for the store over its parts.

Reading back computes the whole manifest from the recipes and raises if any root differs; it hashes every chunk again, compares it with its key, and each recipe's root with its chunks.

Results: a null or empty text is the end id alone. Rows with a null ``doc_id`` come first; rows with equal ``doc_id`` follow in the order
of their roots, and repeated rows each keep their own recipe. An empty table gives an empty store. Extra columns aren't read. Special tokens that stand in a text
get their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from frameloom.llm.byte_bpe import PUNCTUATION, pack
from frameloom.llm.common import drop_table, map_batches, map_rows, materialise, scratch_path

#: Rolling-hash cuts: window, bits that must be zero, least and greatest ids of a chunk.
WINDOW, BITS, LEAST, MOST = 16, 10, 256, 8192
#: Bytes of texts that a worker encodes together (or one longer text); unknown words that the model gets at once; ids hashed at once for cuts.
TOGETHER, JOINT, BLOCK = 4 << 20, 64, 1 << 16
#: Segments of texts of which a worker remembers the ids (two generations of so many), and their greatest length.
MAX_PARTS, LONGEST = 400_000, 100
#: Chunk keys that a task remembers; recipes under one root of the manifest's lowest level.
SEEN, RUN = 200_000, 1024
MIX = 0x9E3779B97F4A7C15  # fixed value: an odd multiplier


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


def _kinds():
    """Of each byte: 1 if it belongs to an ASCII, Latin, Greek or Cyrillic letter, mostly (or ends some other character), 2 for ASCII punctuation, 4 for ASCII white space."""
    import numpy as np

    kinds = np.zeros(256, np.uint8)
    kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA), *range(0xCE, 0xD2)]] = 1
    kinds[list(PUNCTUATION.encode())] = 2
    kinds[[*range(9, 14), *range(28, 33)]] = 4
    return kinds


#: White space of two and three bytes in UTF-8.
WIDE_SPACES = [int.from_bytes(c.encode()) for c in map(chr, range(128, 0x3001)) if c.isspace()]


def segments(data, bounds):
    """Cuts texts (bytes one after another, and where each begins; last, where all end) where the split of the byte-level tokenizers surely cuts.

    Those places are before a blank and around a line break that stand between characters that aren't white space, and between letters and the ASCII punctuation
    that ends their segment. Returns where segments begin (last, where all end) and which of them such punctuation follows; the caller
    checks that these are letters, as bytes tell it only mostly.
    """
    import numpy as np

    n, kinds = len(data), _kinds()[data]
    space = kinds == 4
    wide = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(wide):  # white space of two or three bytes
        code = np.zeros((len(wide), 3), np.int64)
        for k in range(3):
            code[:, k] = data[np.minimum(wide + k, n - 1)]
        for size, held in ((2, np.isin(code[:, 0] << 8 | code[:, 1], WIDE_SPACES)), (3, np.isin(code[:, 0] << 16 | code[:, 1] << 8 | code[:, 2], WIDE_SPACES))):
            for k in range(size):
                space[wide[held] + k] = True
    outer = np.zeros(n, bool)  # beside white space or a border of its text
    outer[1:] = space[:-1]
    outer[:-1] |= space[1:]
    outer[bounds[:-1][bounds[:-1] < n]] = True
    outer[bounds[1:] - 1] = True
    line = (data == 10) & ~outer
    mark = np.zeros(n + 1, bool)
    mark[bounds] = True
    mark[:n] |= line
    mark[1:] |= line
    mark[:n] |= (data == 32) & ~outer
    starts = np.flatnonzero(mark)
    begin, end = starts[:-1], starts[1:]
    count = np.zeros(n + 1, np.int32)
    np.cumsum(kinds != 1, out=count[1:])
    lead = data[begin] == 32
    size = count[end] - count[begin] - lead
    size[size >= end - begin - lead] = 0
    np.cumsum(kinds == 2, out=count[1:])
    tails = (end - size)[(size > 0) & (count[end] - count[end - size] == size)]
    mark[tails] = True
    starts = np.flatnonzero(mark)
    mark[:] = False
    mark[tails] = True
    return starts, mark[starts[1:]]


class LibraryEncoder:
    """Encodes with the library: words of letters by its model alone (they are one match of the split), all else by the whole tokenizer.

    Texts are cut into segments, of which a worker remembers the ids: two generations of ``most``, from the older of which segments in use come back.
    """

    held: dict[str, LibraryEncoder] = {}

    def __init__(self, spec: str, most: int = MAX_PARTS) -> None:
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_str(spec)
        splits = library.pre_tokenizer
        self.added = [t.content for t in library.get_added_tokens_decoder().values()]
        self.model, self.letters = library.model.tokenize, np.array([ord(c) for _, c in sorted(_byte_letters().items())], "<u4")
        self.apart = self._apart(library.model, library.get_vocab(with_added_tokens=False))
        #: whether segments may be encoded alone: no normalizer, and the byte-level split
        self.parts = library.normalizer is None and isinstance(splits, pre_tokenizers.ByteLevel) and splits.use_regex and not splits.add_prefix_space
        self.whole = lambda text: pack(library.encode(text, add_special_tokens=False).ids)
        self.most, self.known, self.old = most, {}, {}

    def encode(self, text: str) -> bytes:
        return bytes(self.encode_all(pa.array([text]), b"")[0])

    def encode_all(self, texts: pa.StringArray, end: bytes) -> tuple[memoryview, list[int]]:
        """The ids of all texts (null: empty), ``end`` after each, one after another, and where each text's ids begin (in bytes; last, where all end).

        Arrow numbers the distinct segments, so each is looked up once for all its places. Texts with a special token, or with
        punctuation after what only looked like letters, are encoded whole.
        """
        import numpy as np

        texts = texts.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        if not len(data):
            return memoryview(end * len(texts)), [len(end) * k for k in range(len(texts) + 1)]
        alone = np.full(len(texts), not self.parts)
        for content in self.added:
            alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if self.parts:
            starts, followed = segments(data, bounds)
        else:
            starts = np.unique(bounds)
        first = np.searchsorted(starts, bounds)
        coded = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        parts, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        if self.parts:
            stems, odd = np.zeros(len(parts), bool), np.zeros(len(parts), bool)
            stems[at[followed]] = True
            odd[[i for i in np.flatnonzero(stems).tolist() if not parts[i].isascii() and not parts[i].removeprefix(" ").isalpha()]] = True
            if odd.any():
                alone[np.searchsorted(first, np.flatnonzero(odd[at] & followed), "right") - 1] = True
        sizes = np.diff(first)
        alone &= sizes > 0
        apart = np.flatnonzero(alone)
        if len(apart):  # the first place of such a text holds all its ids
            keep = np.repeat(~alone, sizes)
            keep[first[apart]] = True
            at[first[apart]] = len(parts) + np.arange(len(apart))
            at, sizes = at[keep], np.where(alone, 1, sizes)
            used = np.zeros(len(parts) + len(apart), bool)
            used[at] = True
            parts, at = [p for p, u in zip(parts, used.tolist()) if u], (np.cumsum(used) - 1)[at]
        values = self.ids_of(parts) + [self.whole(texts[i].as_py()) for i in apart.tolist()]
        ends = np.cumsum(sizes)
        joined = pa.array([*values, end], pa.large_binary()).take(pa.array(np.insert(at, ends, len(values))))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)
        return memoryview(joined.buffers()[2]), [0, *offsets[ends + np.arange(1, len(texts) + 1)].tolist()]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct segments; unknown words are encoded together."""
        known, old = self.known, self.old
        found = list(map(known.get, parts))
        words, begins = [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            part = parts[i]
            ids = old.get(part)
            if ids is None:
                if len(part) > LONGEST:
                    found[i] = self.whole(part)
                    continue
                if part[0] == " " and part[1:].isalpha():
                    words.append(i)
                    continue
                if part.isalpha():
                    begins.append(i)
                    continue
                ids = self.whole(part)
            found[i] = known[part] = ids
        for places, lead in ((words, " "), (begins, "\n")):
            some = [parts[i] for i in places]
            new = self.together(some, lead)
            known.update(zip(some, new))
            for i, ids in zip(places, new):
                found[i] = ids
        if len(known) > self.most:
            self.old, self.known = known, {}
        return found

    def together(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of words of letters, all with a blank before them or all without (``lead`` a line break)."""
        import numpy as np

        if not words:
            return []
        size = JOINT if lead in self.apart else 1
        skip, between = (4, lead) if lead == "\n" and lead in self.apart else (0, "")
        ids, stops = [], []
        for k in range(0, len(words), size):
            text = between.join(["", *words[k : k + size]])
            ids += [t.id for t in self.model(self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le"))]
            stops.append(len(ids))
        ids = np.array(ids, "<u4")
        begins = np.flatnonzero(self.apart[lead][ids]) if lead in self.apart else np.array([0, *stops[:-1]])
        if len(begins) != len(words):
            raise ValueError("words and their tokens don't fit")
        raw = ids.tobytes()
        return [raw[a + skip : b] for a, b in pairwise([*(4 * begins).tolist(), len(raw)])]  # a line break is a token of its own

    @staticmethod
    def _apart(model, vocabulary: dict[str, int]) -> dict:
        """The leads with which the model may get many words at once, and of each id whether its token begins with that lead.

        Merges stay inside the words if no token goes over a border: none holds the lead after a letter, or a line break before one.
        """
        import numpy as np
        from tokenizers import models

        code = {ord(c): b for b, c in _byte_letters().items()}
        if not isinstance(model, models.BPE) or model.dropout is not None or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix or not all(map(vocabulary.__contains__, map(chr, code))):
            return {}
        tokens = {i: bytes(code[ord(c)] for c in t) for t, i in vocabulary.items() if all(ord(c) in code for c in t)}

        def letter(data: bytes, at: int) -> bool:  # or a part of one
            return bool(data) and ((c := data.decode(errors="replace")[at]) == "\ufffd" or c.isalpha())

        out = {}
        for lead in (" ", "\n"):
            sides = [t.split(lead.encode()) for t in tokens.values() if lead.encode() in t]
            if not any(letter(a, -1) or (lead == "\n" and letter(b, 0)) for side in sides for a, b in pairwise(side)):
                out[lead] = np.zeros(max(vocabulary.values()) + 1, bool)
                out[lead][[i for i, t in tokens.items() if t.startswith(lead.encode())]] = True
        return out

    @classmethod
    def of(cls, spec: str) -> LibraryEncoder:
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in cls.held:
            cls.held = {key: cls(spec)}
        return cls.held[key]


def marks(ids) -> list[int]:
    """Where a chunk may end: after ids where the rolling hash of the last ``WINDOW`` ids has ``BITS`` zero bits."""
    import numpy as np

    found = []
    for begin in range(0, len(ids), BLOCK):
        low = max(0, begin - WINDOW)
        x = ids[low : begin + BLOCK].astype(np.uint64)
        x *= np.uint64(MIX)
        x ^= x >> np.uint64(29)
        total = np.cumsum(x, dtype=np.uint64)
        roll = total.copy()
        roll[WINDOW:] -= total[:-WINDOW]
        roll *= np.uint64(MIX)
        at = np.flatnonzero(roll < np.uint64(1 << 64 - BITS)) + low
        found += (at[at >= begin] + 1).tolist()
    return found


def cut_points(ids) -> list[int]:
    """Ends of the chunks of an id array."""
    return chunk_ends(marks(ids), 0, len(ids))


def chunk_ends(marked: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the ids from ``begin`` to ``end``. Marks in a text's first ``LEAST`` ids are never ends, so the marks may be those of many texts in a row."""
    ends = []
    if end - begin > LEAST:
        for m in marked[bisect_right(marked, begin) : bisect_left(marked, end)]:
            while m - begin > MOST:
                begin += MOST
                ends.append(begin)
            if m - begin >= LEAST:
                begin = m
                ends.append(m)
        while end - begin > MOST:
            begin += MOST
            ends.append(begin)
    if begin < end:
        ends.append(end)
    return ends


def groups(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (first column) have at most ``most`` bytes together, or one row."""
    begin = total = 0
    for k, size in enumerate(pc.binary_length(batch.column(0)).to_pylist()):
        if total and total + (size or 0) > most:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)


def merkle_root(keys: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is. Leaves and inner nodes are hashed apart."""
    level = [hashlib.sha256(b"\0" + k).digest() for k in keys]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else bytes(32)


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` into a store at ``path``.

    Texts are encoded once, into a table that later steps read (a lost executor repeats no more than its own tasks). A task writes a chunk that it
    meets again once (of ``SEEN`` keys that it remembers); one shuffle of the compressed chunks leaves each key once. Recipes are sorted in a shuffle of their own. The tokenizer's file is
    read on the driver and broadcast (a vocabulary, a few MB).
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    kind = docs.schema[id_col].dataType.simpleString()
    types = (pa.string(), pa.binary(), pa.int32(), pa.binary(), to_arrow_type(docs.schema[id_col].dataType))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        library, press, seen = LibraryEncoder.of(spec.value), zstandard.ZstdCompressor(level=1), set()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in groups(batch, TOGETHER):
                raw, bounds = library.encode_all(part.column(0), end)
                ids = np.frombuffer(raw, "<u4")
                marked = marks(ids)
                narrow = memoryview(ids.astype("<u2").tobytes()) if ids.max() < 1 << 16 else None
                chunks, recipes = [], []
                for begin, stop in pairwise(bounds):
                    keys, begin = [], begin // 4
                    total = stop // 4 - begin
                    for cut in chunk_ends(marked, begin, stop // 4):
                        key = hashlib.sha256(raw[4 * begin : 4 * cut]).digest()
                        keys.append(key)
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            some = narrow[2 * begin : 2 * cut] if narrow else _packed(ids[begin:cut])
                            chunks.append(("chunk", key, cut - begin, press.compress(some)))
                        begin = cut
                    recipes.append(("recipe", merkle_root(keys), total, b"".join(keys)))
                docs = [*[None] * len(chunks), *part.column(1).to_pylist()]
                columns = [*zip(*chunks, *recipes), docs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "gkey", "n", "payload", "doc_id"])

    encoded = scratch_path(spark, "encoded")
    rows = map_batches(docs.select(F.col(text_col), F.col(id_col)), encode, f"kind string, gkey binary, n int, payload binary, doc_id {kind}")
    rows.write.partitionBy("kind").option("compression", "none").parquet(encoded)
    both = spark.read.schema(f"gkey binary, n int, payload binary, doc_id {kind}, kind string").parquet(encoded)
    both.where("kind = 'chunk'").select("gkey", "n", "payload").repartition("gkey").dropDuplicates(["gkey"]).write.option("compression", "none").parquet(f"{path}/chunks")
    drop_table(spark, f"{encoded}/kind=chunk")
    recipes = both.where("kind = 'recipe'").select("doc_id", F.col("n").cast("long").alias("n_tokens"), F.col("payload").alias("keys"), F.col("gkey").alias("root"))
    sorted_ = materialise(recipes.repartitionByRange("doc_id", "root").withColumn("part", F.spark_partition_id()), "recipes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the range shuffle
    offsets = sorted_.groupBy("part").agg(F.sum("n_tokens").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("doc_id", "root")
    placed = (
        sorted_.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("row", F.row_number().over(inside))
        .select("part", "row", "doc_id", "start", "n_tokens", "keys", "root")
    )
    placed.repartitionByRange("part", "row").sortWithinPartitions("part", "row").write.option("compression", "none").parquet(f"{path}/recipes")
    manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")
    drop_table(spark, encoded)


def manifest(recipes: DataFrame) -> DataFrame:
    """The Merkle tree over recipes: ``level`` (0: runs of at most ``RUN`` recipes, 1: parts, 2: the store), ``part, run, n_docs, n_tokens, root``.

    A part holds as many recipes as one task of the range shuffle, so its runs are few; the store has one row for each of its parts.
    """
    leaf = F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.hex("root")).cast("binary"), 256))
    levels = [recipes.select("part", F.floor((F.col("row") - 1) / RUN).alias("run"), F.col("row").alias("at"), leaf.alias("root"), F.lit(1).cast("long").alias("n_docs"), "n_tokens")]
    schema = "part int, run long, n_docs long, n_tokens long, root binary"
    out = []
    for keys in (["part", "run"], ["part"], []):
        below = levels[-1]
        grouped = below.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "root"))).alias("leaves"))
        named = grouped.select(*[F.col(c) if c in keys else F.lit(-1).cast(t).alias(c) for c, t in (("part", "int"), ("run", "long"))], F.coalesce("n_docs", F.lit(0)), F.coalesce("n_tokens", F.lit(0)), F.col("leaves.root"))
        rooted = materialise(map_rows(named, schema, lambda: lambda part, run, n, tokens, leaves: (part, run, n, tokens, merkle_root(leaves))), "roots")
        out.append(rooted.withColumn("level", F.lit(len(out))))
        levels.append(rooted.withColumn("at", F.col(keys[-1])) if keys else rooted)
    return out[0].unionByName(out[1]).unionByName(out[2])


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Computes the manifest of the recipes anew and raises ``ValueError`` if it isn't the stored one."""
    held = spark.read.parquet(f"{path}/manifest")
    new = manifest(_recipes(spark, path)).select(*[F.col(c).alias(f"new_{c}") for c in held.columns])
    same = F.lit(True)
    for c in held.columns:
        same &= F.col(c).eqNullSafe(F.col(f"new_{c}"))
    keys = [F.col(c) == F.col(f"new_{c}") for c in ("level", "part", "run")]
    odd = held.join(new, keys, "full").where(~same).count()
    if odd:
        raise ValueError(f"{odd} roots of the manifest don't fit the recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def _packed(ids) -> bytes:
    return (ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes()


def _unpack(payload: bytes, n: int) -> bytes:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    return raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _placed(recipes: DataFrame) -> DataFrame:
    """A row for each chunk that a recipe names."""
    return recipes.select(
        "part", "row",
        F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("keys") / 32).cast("int") - 1), lambda i: F.substring(F.col("keys"), i * 32 + 1, 32))).alias("pos", "gkey"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reconstructs every document: ``doc_id, start, n_tokens, ids`` (ids as little-endian unsigned 32-bit integers). Raises if the manifest or a chunk doesn't fit."""
    verify_manifest(spark, path)
    chunks = map_rows(_chunks(spark, path), "gkey binary, ids binary", lambda: lambda key, n, data: (key, _checked(key, _unpack(data, n))))
    whole = _placed(_recipes(spark, path)).join(chunks, "gkey").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("c"))
    joined = whole.join(_recipes(spark, path), ["part", "row"]).select("doc_id", "start", "n_tokens", F.col("c.ids").alias("ids"))
    return map_rows(joined, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids binary", lambda: lambda d, s, n, ids: (d, s, n, b"".join(ids)))


def _checked(key: bytes, raw: bytes) -> bytes:
    if hashlib.sha256(raw).digest() != key:
        raise ValueError("a stored chunk doesn't match its key")
    return raw


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Checks the whole store and returns ``doc_id, start, n_tokens, ids_crc32, verified`` for each document.

    Each stored chunk is read once: its ids are hashed, counted and summed where they lie. Only those sums are shuffled to
    the recipes, where the checksums of consecutive chunks combine to that of the document. A chunk that many documents share
    is one row on its side, and Spark may split the other side of that join. Raises if the manifest doesn't fit the recipes.
    """
    verify_manifest(spark, path)

    def sums():
        def row(key, n, data):
            raw = _unpack(data, n)
            return key, len(raw) // 4, zlib.crc32(raw), hashlib.sha256(raw).digest() == key

        return row

    chunks = map_rows(_chunks(spark, path), "gkey binary, n int, crc long, ok boolean", sums)
    recipes = _recipes(spark, path)
    parts = _placed(recipes).join(chunks, "gkey").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc", "ok", "gkey"))).alias("c"))
    joined = recipes.join(parts, ["part", "row"], "left").select("doc_id", "start", "n_tokens", "root", F.col("c.n").alias("n"), F.col("c.crc").alias("crc"), F.col("c.ok").alias("ok"), F.col("c.gkey").alias("k"))

    def whole():
        zeros = bytes(4 * MOST)

        def row(doc_id, start, n_tokens, root, ns, crcs, oks, keys):
            total = 0
            for n, crc in zip(ns or [], crcs or []):  # checksum of a concatenation, from those of its parts
                pad = memoryview(zeros)[: 4 * n]
                total = zlib.crc32(pad, total) ^ zlib.crc32(pad) ^ crc
            return doc_id, start, sum(ns or []), total, all(oks or []) and sum(ns or []) == n_tokens and merkle_root(keys or []) == root

        return row

    return map_rows(joined, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long, verified boolean", whole)


def store_documents(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Writes a store in the shared scratch folder and returns what :func:`read_digests` reads back from it."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_file, end_id)
    return read_digests(docs.sparkSession, path)
