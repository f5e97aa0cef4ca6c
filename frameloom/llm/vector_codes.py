"""Vector code compression: a product quantiser whose codebooks are trained exactly, in integers.

Every component becomes ``floor(1024 * x)``. A vector is cut into four consecutive parts, and a part's code is the index of the
nearest entry of its position's codebook (squared Euclidean distance, ties to the lower index). Codebooks start as the parts of the first vectors and
are moved to the floored means of what they were assigned, four times.

**Nearest entry.** Ranking entries needs ``|c|^2 - 2 x.c``. A float32 matrix product gives ``x.c`` for a block of parts and all entries at once. The product of
``n`` terms, in any order of summation and with both inputs rounded to float32, is off by at most ``g |x| |c|`` with ``g = (n + 2) u / (1 - (n + 2) u)``,
``u = 2**-24``; that and the roundings of the float64 arithmetic around it give each entry an interval that holds its true value. Every entry whose
interval reaches below the least upper end is evaluated again in int64, and the least distance with the lowest index is the code. Parts with components too
large for that (2**28 and more in the part or its codebook) are compared in integers without bound.

**Scale.** Each round is one map over the vectors with the codebooks (256 entries a position, whatever the input) in the task, then sums by entry and component: a task gives one row for each
entry and component that it met, added up in the JVM. Only sums of entries go to the driver, never vectors. Labels' errors are summed by label, in two
steps; sums of few labels are broadcast, others meet the vectors in a join that adaptive execution may split.

Results: rows whose vector is null or has a null, NaN or infinite component are dropped; so is one with a component of 2**52 or more, which no code's error can hold. A vector shorter than the longest, or a longest length
that four doesn't divide, is filled up with zeros. A null id sorts after all others when the first entries are taken, equal ids by their vectors. Repeated rows count each. An ``error`` over the range of long is
null, and so is the sum of its label. Fewer than 256 vectors give as many entries; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Least magnitude of a component at which distances leave int64 for integers without bound.
WIDE = 1 << 28
#: Parts that are held against all entries at a time.
BLOCK = 1024
#: Most bytes of label sums that are broadcast.
FEW_BYTES = 32 << 20


def _bound(values: np.ndarray) -> int:
    return max((abs(int(v)) for v in (values.min(), values.max())), default=0) if values.size else 0


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, ties to the lower index, and the squared distance (int64, or object for wide components)."""
    if max(_bound(parts), _bound(entries)) >= WIDE:
        return _nearest_wide(parts, entries)
    n = parts.shape[1]
    u = 2.0**-24
    g = (n + 2) * u / (1 - (n + 2) * u)
    slack = 1 + 1e-12  # upward, for square roots and products of float64
    cc = (entries * entries).sum(1)
    cc64, c_norm = cc.astype(np.float64), np.sqrt(cc.astype(np.float64)) * slack
    c32 = np.ascontiguousarray(entries.T.astype(np.float32))
    codes, errors = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for at in range(0, len(parts), BLOCK):
        x = parts[at : at + BLOCK]
        product = (x.astype(np.float32) @ c32).astype(np.float64)
        x_norm = np.sqrt((x * x).sum(1).astype(np.float64)) * slack
        value = cc64 - 2 * product
        off = 2 * g * slack * np.outer(x_norm, c_norm) + 2.0**-50 * (cc64 + 2 * np.abs(product)) + 2.0**-40
        row, col = np.nonzero(value - off <= (value + off).min(1)[:, None])
        exact = ((x[row] - entries[col]) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # every part keeps at least one entry
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        codes[at : at + BLOCK] = col[hit[np.unique(row[hit], return_index=True)[1]]]
        errors[at : at + BLOCK] = least
    return codes, errors


def _nearest_wide(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    book = entries.astype(object)
    codes, errors = np.empty(len(parts), np.int64), np.empty(len(parts), object)
    for i, x in enumerate(parts.astype(object)):
        d = ((book - x) ** 2).sum(1) if len(x) else np.zeros(len(book), object)
        codes[i] = min(range(len(d)), key=d.__getitem__)
        errors[i] = d[codes[i]]
    return codes, errors


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """``id, label, v`` of the kept rows, integer components filled up to one length, in the shared folder; and that length."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 52)))), F.lit(False))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & fits)
    kept = materialise(kept.select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v")), "vectors")
    low, high = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    width = -(-(high or 0) // PARTS) * PARTS
    if low is not None and low < width:
        kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    return kept, width


def first_books(kept: DataFrame, width: int) -> list[np.ndarray]:
    """The starting codebook of each position: parts of the vectors with the least ids."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r[0] for r in rows], np.int64).reshape(len(rows), width)
    return [np.ascontiguousarray(x) for x in np.split(start, PARTS, axis=1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def entry_sums(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``part, entry, pos, s``: sums of the components that each entry was assigned; position -1 has their count."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1]), object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for p, own in enumerate(np.split(x, PARTS, axis=1)):
                codes, _ = nearest(own, books[p])
                order = np.argsort(codes, kind="stable")
                met, first = np.unique(codes[order], return_index=True)
                counts[p] += np.bincount(codes, minlength=len(books[p]))
                if own.shape[1] and len(met):
                    grouped = own[order] if _bound(own) < WIDE else own[order].astype(object)
                    sums[p][met] += np.add.reduceat(grouped, first, axis=0)
        rows = [
            (p, int(e), pos, int(counts[p][e]) if pos < 0 else int(sums[p][e, pos]))
            for p in range(PARTS) for e in np.flatnonzero(counts[p]) for pos in range(-1, sums[p].shape[1])
        ]
        part, entry, pos, s = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(pos, pa.int32()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))], schema=schema)

    each = map_batches(kept.select("v"), run, "part int, entry int, pos int, s decimal(38,0)")
    return each.groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"))


def moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """The codebooks after one round: entries that were assigned parts move to the floor of their mean."""
    out = [b.copy() for b in books]
    rows = {(r.part, r.entry, r.pos): int(r.s) for r in sums.collect()}  # as many as the codebooks have numbers
    for (part, entry, pos), s in rows.items():
        if pos >= 0:
            out[part][entry, pos] = s // rows[part, entry, -1]
    return out


def train(kept: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final codebook of each position."""
    books = first_books(kept, width)
    for _ in range(rounds if len(books[0]) else 0):
        books = moved(books, entry_sums(kept, books, width))
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by position, entry and place, as decimal numbers between commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``id, label, code, error`` of every vector: a byte for each position, and the squared distance over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(own, books[p]) for p, own in enumerate(np.split(_matrix(batch.column(2), width), PARTS, axis=1))]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            errors = [sum(map(int, e)) for e in zip(*(e.tolist() for _, e in found))]
            text = [bytes(c).hex() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], names=["id", "label", "code", "error"]
            )

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return map_batches(kept.select("id", "label", "v"), run, f"id {types['id']}, label {types['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the components that a code stands for, in the vectors' own scale."""
    tables = [F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in b.tolist()]) for b in books]
    at = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(t, at(p)) for p, t in enumerate(tables)]))


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of equal labels (nulls are equal) added up."""
    unknown = F.max(F.col("error").isNull())
    total = F.when(~unknown, F.try_sum("error")).alias("label_error")
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(total), "label_errors")
    few = (sums.agg(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 64)).first()[0] or 0) <= FEW_BYTES
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every kept row."""
    kept, width = integers(vectors, id_col, vector_col, label_col)
    books = train(kept, width, rounds)
    coded = materialise(encode(kept, books, width), "codes")
    return label_errors(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
