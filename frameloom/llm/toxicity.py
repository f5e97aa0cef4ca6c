"""Toxicity: a factorization machine over hashed terms.

A text's features are its distinct words and their beginnings, hashed. The machine scores them by a bias, a weight for each term and the inner
products of the terms' factor vectors, so that a pair (an insult with a group mention) can count for more, or less, than the sum of its
parts. It is trained by AdaGrad on the logistic loss: first the weights alone; then every kept term is tested for pairs that the weights leave
unexplained, whatever its own weight is: the squared residuals that it gathers in pairs with other terms, against what chance gives. The terms that pass get factors,
which begin in the directions that the residuals of their pairs ask for, and weights and factors are trained together, on every table alike. Weights and whole factor vectors that don't earn their keep
shrink to zero, so that long clean texts don't add up noise. Rates and shrinkage were chosen on training folds (fold 3 as check).

The fit reads at most ``max_rows`` labelled rows, those with the least hash of the id; the labels' sample is a bounded table and
broadcast, documents aren't shuffled. Only hashed terms reach the driver. Scoring is one map.

Results: a null or empty text scores the bias. Repeated rows each get their score; documents with several labels count as toxic if one
of these says so; null labels don't count. Without any label the score is the prior 0.5 of an untrained bias.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, map_rows, tidy

#: Rows that a fit may read, hash bits, documents a term must have in them, factors.
MAX_ROWS, BITS, LEAST_DOCS, FACTORS = 8_000, 26, 6, 8
#: Lengths of word beginnings that are terms too; words of which a worker remembers the terms.
PREFIXES, MAX_WORDS = (4, 5, 6, 7), 60_000
#: A term gets factors if its pairs hold so many times the residuals that chance gives, over so many random draws of the other terms; it must stand in
#: so many labelled documents, and at most so many terms (the least explained ones) get factors.
UNEXPLAINED, DRAWS, PAIR_DOCS, PAIR_TERMS = 1.6, 32, 12, 500
#: Epochs, and those of the weights alone before.
EPOCHS, ALONE = 16, 4
THRESHOLD = 0.3
_WORDS = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, so that inflected and compound forms share terms."""
    crc, mask = zlib.crc32, (1 << BITS) - 1
    return (crc(word.encode()) & mask, *[crc(b"%d^" % n + word[:n].encode()) & mask for n in PREFIXES if len(word) >= n])


def words(text: str | None) -> set[str]:
    """The distinct lower-case words of a text."""
    return set((text or "").lower().encode().translate(_WORDS).decode().split())


def terms(text: str | None) -> set[int]:
    """Hashes of all terms of a text."""
    out: set[int] = set()
    for w in words(text):
        out.update(word_terms(w))
    return out


class Machine:
    """A second-order factorization machine with 0/1 features."""

    def __init__(self, bias: float, ids, weights, factors) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors
        self.at = {int(t): i for i, t in enumerate(ids)}
        self.trained = True
        self.known: dict[str, tuple[int, ...]] = {}

    def of_terms(self, terms) -> float:
        """Score of a set of term hashes."""
        return self._of({self.at[t] for t in terms if t in self.at})

    def score(self, text: str | None) -> float:
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        found: set[int] = set()
        for w in words(text):
            mine = self.known.get(w)
            if mine is None:
                mine = self.known[w] = tuple([self.at[t] for t in word_terms(w) if t in self.at])
            if mine:
                found.update(mine)
        return self._of(found)

    def _of(self, found: set[int]) -> float:
        import math

        z = self.bias
        if found:
            rows = sorted(found)
            v = self.factors[rows]
            s = v.sum(axis=0)
            z += float(self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Sparse:
    """The rows of a fit: 0/1 features as two parallel arrays, row numbers (ascending) and term numbers."""

    def __init__(self, row, term, rows: int, terms: int) -> None:
        import numpy as np

        self.row, self.term, self.rows, self.terms = row, term, rows, terms
        self.begin = np.searchsorted(row, np.arange(rows + 1))

    def by_row(self, values):
        """For each row, the sum of its terms' values."""
        import numpy as np

        return np.bincount(self.row, values[self.term], self.rows)

    def by_term(self, values):
        """For each term, the sum of its rows' values."""
        import numpy as np

        return np.bincount(self.term, values[self.row], self.terms)

    def part(self, some) -> Sparse:
        """Some rows, numbered anew."""
        import numpy as np

        row = np.repeat(np.arange(len(some)), self.begin[some + 1] - self.begin[some])
        return Sparse(row, np.concatenate([self.term[self.begin[i] : self.begin[i + 1]] for i in some]), len(some), self.terms)

    def only(self, terms) -> Sparse:
        """Only the terms that are marked, with their numbers."""
        on = terms[self.term]
        return Sparse(self.row[on], self.term[on], self.rows, self.terms)


def unexplained_terms(x: Sparse, residual, count, rng):
    """Marks the terms whose pairs hold more residual than chance: the sum over partners j of (sum of residuals of rows with both)^2, against its
    expectation for independent signs. Random signs of the partners estimate it in linear time."""
    import numpy as np

    size = np.bincount(x.row, minlength=x.rows)
    alone, chance, found = x.by_term(residual), x.by_term(residual**2 * (size - 1)), np.zeros(x.terms)
    for _ in range(DRAWS):
        sign = rng.choice([-1.0, 1.0], x.terms)
        found += (x.by_term(residual * x.by_row(sign)) - alone * sign) ** 2 / DRAWS
    ratio = np.where(count >= PAIR_DOCS, found / np.maximum(chance, 1e-9), 0)
    marked = ratio > UNEXPLAINED
    marked[np.argsort(-ratio, kind="stable")[PAIR_TERMS:]] = False
    return marked


def first_factors(x: Sparse, residual, count, marked):
    """Factors of the marked terms: the leading eigenvectors of their pairs' residuals, each term scaled by the root of its count."""
    import numpy as np

    v, own, block = np.zeros((x.terms, FACTORS)), np.flatnonzero(marked), 512
    number = np.full(x.terms, -1)
    number[own] = np.arange(len(own))
    some, pairs = x.only(marked), np.zeros((len(own), len(own)))
    for k in range(0, x.rows, block):
        a, b = np.searchsorted(some.row, [k, k + block])
        dense = np.zeros((min(block, x.rows - k), len(own)))
        dense[some.row[a:b] - k, number[some.term[a:b]]] = 1
        pairs += dense.T @ (dense * residual[k : k + block, None])
    np.fill_diagonal(pairs, 0)
    scale = 1 / np.sqrt(count[own])
    share, vectors = np.linalg.eigh(pairs * scale[:, None] * scale)
    vectors = vectors[:, ::-1][:, :FACTORS] * np.sqrt(np.clip(share[::-1][:FACTORS], 0, None))
    v[own, : vectors.shape[1]] = vectors
    return v * (0.1 / max(np.sqrt((v * v).sum(axis=1)).max(), 1e-9))


def known_terms(terms, ids):
    """Numbers of those terms that are among the sorted ids."""
    import numpy as np

    at = np.searchsorted(ids, terms)
    held = at < len(ids)
    held[held] = ids[at[held]] == terms[held]
    return at[held].astype(np.int32)


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, alone: int = ALONE, rate: float = 0.15, pair_rate: float = 0.05, l1: float = 1e-3, shrink: float = 3e-4, batch: int = 64, seed: int = 7) -> Machine:
    """Fits a machine on ``rows``: each document's term hashes (32-bit little-endian) and its label. ``alone``: epochs of the weights only (all of them: no factors)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y):
        untrained = Machine(0.0, [], np.zeros(0), np.zeros((0, FACTORS)))
        untrained.trained = False
        return untrained
    ids, count = np.unique(np.concatenate([np.frombuffer(r[0], "<u4") for r in rows]), return_counts=True)
    ids, count = ids[count >= LEAST_DOCS], count[count >= LEAST_DOCS]
    own = [known_terms(np.frombuffer(r[0], "<u4"), ids) for r in rows]
    x = Sparse(np.repeat(np.arange(len(y), dtype=np.int32), [len(t) for t in own]), np.concatenate(own), len(y), len(ids))
    del own
    n, base = len(ids), min(max(y.mean(), 1e-4), 1 - 1e-4)
    b, w, v = float(np.log(base / (1 - base))), np.zeros(n), np.zeros((n, FACTORS))
    gb, gw, gv = 1e-2, np.full(n, 1e-4), np.full((n, FACTORS), 1e-4)
    paired = np.zeros(n, bool)

    def chance(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for epoch in range(epochs):
        if epoch == alone and n:
            residual = y - chance(b + x.by_row(w))
            residual -= residual.mean()
            paired = unexplained_terms(x, residual, count, rng)
            if paired.any():
                v = first_factors(x, residual, count, paired)
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            some = order[k : k + batch]
            part = x.part(some)
            z = b + part.by_row(w)
            pairs = part.only(paired)
            if len(pairs.term):
                own = v[pairs.term]
                s = np.stack([pairs.by_row(v[:, f]) for f in range(FACTORS)], axis=1)
                z += 0.5 * ((s * s).sum(axis=1) - np.bincount(pairs.row, (own * own).sum(axis=1), len(some)))
            g = (chance(z) - y[some]) / len(some)
            slope = part.by_term(g)
            hit = np.unique(part.term)
            gb += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(gb)
            gw[hit] += slope[hit] ** 2
            step = rate / np.sqrt(gw[hit])
            new = w[hit] - step * slope[hit]
            w[hit] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            if not len(pairs.term):
                continue
            slope = np.stack([np.bincount(pairs.term, g[pairs.row] * (s[pairs.row, f] - own[:, f]), n) for f in range(FACTORS)], axis=1)
            hit = np.unique(pairs.term)
            gv[hit] += slope[hit] ** 2
            step = pair_rate / np.sqrt(gv[hit])
            new = v[hit] - step * slope[hit]
            norm = np.sqrt((new * new).sum(axis=1, keepdims=True)) + 1e-12
            v[hit] = new * np.maximum(1 - step.mean(axis=1, keepdims=True) * shrink / norm, 0)
    used = (w != 0) | (np.abs(v).max(axis=1) > 1e-3)
    return Machine(b, ids[used], w[used], v[used])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Trains on at most ``max_rows`` labelled documents."""
    chosen = (
        labels.select(F.col(id_col).alias("__k"), F.col(label_col).cast("int").alias("__y")).where("__k is not null and __y is not null")
        .groupBy("__k").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__k"), "__k").limit(max_rows)
    )
    found = docs.select(F.col(id_col).alias("__k"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__k").select("__t", "__y")

    def make():
        import numpy as np

        return lambda text, y: (np.array(sorted(terms(text)), "<u4").tobytes(), y)

    machine = train(sorted(tuple(r) for r in map_rows(found, "terms binary, y int", make).collect()))
    tidy()
    return machine


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        model = held.value
        return lambda key, text: (key, model.score(text))

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double", make)


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score under ``threshold``, with all their columns. A machine that saw no label rejects nothing."""
    if not machine.trained:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))
        model.known.clear()

    return map_batches(docs, keep, docs.schema)
