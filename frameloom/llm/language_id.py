"""Language identification with language-bitmask n-gram filters.

Each language has the set of character n-grams that occur in at least a share of its training texts. The sets are held in
one bit-sliced Bloom filter: a table whose cells are bitmasks of languages. Adding an n-gram sets the language's bit in the cells of its hashes;
looking it up is the AND of these cells, which names all languages that contain it at once. A text's n-grams are looked up together, and the
popcount of each language's bit over them is its count. A filter with a share f of its cells set answers a foreign n-gram wrongly with
probability p = f ** hashes; (count - n * p) / (1 - p) corrects the count. The greatest corrected count decides.

The fit reads about ``per_lang`` texts of each language (those whose hash falls under that language's share); its n-gram sets are bounded
by the share a gram must reach. The filter (a few MB) is broadcast; prediction is one map.

Results: a null text or one without letters is ``und`` with score 0. A text none of whose n-grams is known gets the most frequent
language with score 0; a tie goes to the language that sorts first. Repeated rows each get their prediction. Without any training row all are ``und``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_batches, map_rows

#: Training texts of a language, share of them that must have an n-gram, n-gram length, hashes, greatest number of languages.
PER_LANG, SHARE, GRAM, HASHES, MOST_LANGS = 1500, 0.02, 3, 3, 1024
UNKNOWN = "und"
#: Characters that are hashed at a time.
BLOCK = 1 << 18
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # fixed values: odd multipliers


def grams(text: str):
    """Hashes of the n-grams of a text's lower-case words, block by block; every word has a blank on both sides."""
    import numpy as np

    folded = b" ".join(text.lower().encode().translate(_LETTERS).split()).decode()
    for k in range(0, len(folded), BLOCK):
        part = folded[k : k + BLOCK + GRAM - 1]
        part = (" " if k == 0 else "") + part + (" " if k + BLOCK >= len(folded) else "")
        code = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.uint64)
        if len(code) < GRAM:
            continue
        h = code[: len(code) - GRAM + 1].copy()
        for i in range(1, GRAM):
            h <<= np.uint64(21)
            h |= code[i : len(code) - GRAM + 1 + i]
        yield h * np.uint64(_ODD[0])


class Filters:
    """The bit-sliced filter of all languages."""

    def __init__(self, sets: dict[str, list[int]], common: str | None) -> None:
        import numpy as np

        if len(sets) > MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} languages")
        self.langs, self.common = sorted(sets), common
        most = max([1024, *map(len, sets.values())])
        self.bits = max(12, (8 * most - 1).bit_length())
        #: one slice of cells for every 64 languages
        self.cells = np.zeros((-(-len(sets) // 64), 1 << self.bits), np.uint64)
        for i, lang in enumerate(self.langs):
            h = np.array(sets[lang], np.int64).view(np.uint64)
            for at in self._places(h):
                np.bitwise_or.at(self.cells[i // 64], at, np.uint64(1 << i % 64))
        fill = [float((self.cells[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(self.langs))]
        self.wrong = np.array([f**HASHES for f in fill])

    def _places(self, h):
        import numpy as np

        shift = np.uint64(64 - self.bits)
        return [(h * np.uint64(m)) >> shift for m in _ODD]

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        if not self.langs or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        n, count = 0, np.zeros(len(self.langs))
        for h in grams(text):
            at = self._places(h)
            masks = [c[at[0]] & c[at[1]] & c[at[2]] for c in self.cells]
            n += len(h)
            count += [np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.langs))]
        true = np.maximum(0, (count - n * self.wrong) / (1 - self.wrong))
        if not true.sum():
            return self.common, 0.0
        best = int(true.argmax())
        return self.langs[best], float(true[best] / true.sum())


def fit(docs: DataFrame, per_lang: int = PER_LANG, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learns the n-gram sets from about ``per_lang`` texts of each non-null ``lang_col``."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(lang_col).limit(MOST_LANGS + 1).collect()}
    if not sizes:
        return Filters({}, None)
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rank = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    cut = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    some = known.where(rank < F.try_element_at(cut, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                mine = [np.unique(h) for h in grams(text)]
                held.setdefault(lang, []).append(np.unique(np.concatenate(mine)) if mine else np.zeros(0, np.uint64))
        for lang, found in held.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    seen = map_batches(some, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1.0, share * min(n, per_lang)))])
    sets: dict[str, list[int]] = {lang: [] for lang in sizes}
    for lang, gram in seen.where(F.col("n") >= F.try_element_at(least, F.col("lang"))).select("lang", "gram").collect():
        sets[lang].append(gram)
    return Filters(sets, min(sizes, key=lambda x: (-sizes[x], x)))


def predictions(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        model = held.value
        return lambda key, text: (key, *model.predict(text))

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double", make)
