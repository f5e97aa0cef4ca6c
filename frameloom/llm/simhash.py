"""SimHash near-duplicates, joined by pigeonring filtering.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its three-word shingles. Two fingerprints are linked
if at most three bits differ; components of links are the groups.

**Candidates.** The 64 bits form a ring of four 16-bit segments. If at most three bits differ, then by the pigeonring
principle some segment starts a chain in which every prefix stays within its share of the budget: over 1, 2, 3, 4 consecutive
segments at most 0, 1, 2, 3 bits differ (the floor of 3/4 a segment). Such a chain is found by equality: its first
segment is equal; of the second segment's two bytes one is equal (one difference at most); of the third segment's three parts one is equal (two differences at most).
So each fingerprint has 4 x 2 x 3 keys of 29 or 30 bits. Pairs that share a key are kept in the join itself only if the whole
chain is viable, then by the full Hamming check; pairs that share several keys are listed once afterwards.

**Scale.** Equal fingerprints are one node, so copies never meet as pairs, and each link of different fingerprints is found.
Components contract in the shared folder by star rounds. Nothing is collected.

Results: a null or empty text, or one without words, has fingerprint zero, and is linked to all others of fingerprint zero. Rows
are never dropped: repeated rows each get their group. ``component_id`` is null only if all ids of a group are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import components, map_rows, materialise

#: Greatest number of differing bits of a link.
LIMIT = 3
#: Shingles that a worker hashes at a time.
BLOCK = 1 << 15
#: Parts of a third segment: least bit and width.
THIRDS = ((0, 5), (5, 5), (10, 6))


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number. Only A-Z are lower-cased; words end at ASCII white space."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = words[k : k + BLOCK + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if n > 1 or len(words) == 3 else [b" ".join(words)]
        h = np.array([digest(s, 42) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _row():
    def row(key, text):
        v = fingerprint(text)
        return key, v - (1 << 64) if v >> 63 else v

    return row


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long", _row)


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All pairs ``a < b`` of different values of ``nodes.fp`` that differ in at most ``limit`` (at most 3) bits."""
    if not 0 <= limit <= 3:
        raise ValueError("the ring of four segments serves limits up to 3")
    fp = F.col("fp")
    keys = []
    for s in range(4):
        first, second, third = 16 * s, 16 * ((s + 1) % 4), 16 * ((s + 2) % 4)
        for h in (0, 8):
            for t, (at, width) in enumerate(THIRDS):
                tag = (s * 2 + h // 8) * 3 + t
                keys.append(
                    F.shiftleft(F.lit(tag).cast("long"), 32)
                    + F.shiftleft(_bits(fp, first, 16), 16) + F.shiftleft(_bits(fp, second + h, 8), 8) + _bits(fp, third + at, width)
                )
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("k"))
    left, right = rows.select(F.col("fp").alias("a"), "k"), rows.select(F.col("fp").alias("b"), "k")
    x = F.col("a").bitwiseXOR(F.col("b"))

    def differ(s: int, count: int) -> Column:
        """Differing bits of ``count`` segments from the s-th on, around the ring."""
        mask = sum(0xFFFF << 16 * ((s + i) % 4) for i in range(count))
        return F.bit_count(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))

    viable = [(differ(s, 1) == 0) & (differ(s, 2) <= 1) & (differ(s, 3) <= 2) for s in range(4)]
    return (
        left.join(right, "k")
        .where((F.col("a") < F.col("b")) & (viable[0] | viable[1] | viable[2] | viable[3]) & (F.bit_count(x) <= limit))
        .select("a", "b").distinct()
    )


def _groups(prints: DataFrame, limit: int) -> DataFrame:
    """``fp, root`` of every distinct fingerprint: the least fingerprint that its links reach."""
    nodes = prints.select("fp").distinct()
    roots = components(links(nodes, limit))
    return materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Returns ``id_col, fingerprint, component_id`` for every row: 16 hex digits, and the least id that links reach."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = _groups(prints, limit)
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least")).join(groups, "fp")
    whole = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(whole, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group one row, that of the least id (of equal ids, the text with the least hash)."""
    raw = docs.select(F.struct(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h")).alias("k"), F.col(text_col).alias("t"))
    prints = materialise(fingerprints(raw, "k", "t"), "fingerprints")
    best = prints.groupBy("fp").agg(F.min("k").alias("k")).join(_groups(prints, limit), "fp").groupBy("root").agg(F.min("k").alias("k"))
    chosen = best.select(F.col("k.d").alias("__sh_d"), F.col("k.h").alias("__sh_h")).distinct()
    kept = docs.join(chosen, docs[id_col].eqNullSafe(F.col("__sh_d")) & (F.xxhash64(docs[text_col]) == F.col("__sh_h")), "left_semi")
    order = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("__sh_n", F.row_number().over(order)).where("__sh_n = 1").select(*docs.columns)
