"""Quality rules as a short-circuit cascade.

Statistics that every text needs are computed once. The rules then run in the order of rejected share per cost, which a sample
of texts measures, in the executors: texts don't come to the driver. The first rule that rejects ends the row's work. A row is kept iff no rule rejects it, so the verdict doesn't depend on the order,
and the measured costs can't change a result.

Results: a null or empty text has no words and fails the base. Repeated rows each get their row. On an empty table the rules keep their listed order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
#: Rows of which the cascade's order is estimated: those with the least hash of the id (and what shares the last of these hashes).
SAMPLE = 300
LEAST_WORDS = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    import numpy as np

    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    _, pair = np.unique(x[:-1] * len(known) + x[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(known) + x[2:], return_inverse=True, return_counts=True)
    hit = count[window] > 1
    marked = np.zeros(len(words), bool)
    for i in range(3):
        marked[i : i + len(hit)] |= hit
    return int(marked.sum())


def base(text: str) -> tuple[dict, tuple[int, int, int, int, int]]:
    """What the rules share, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
    lines = [s for s in text.split("\n") if s.strip(" \t\r\x0b\f")]
    dups = len(lines) - len(set(lines))
    symbols = sum(map(text.count, SYMBOLS))
    return {"text": text, "words": words, "lines": lines, "chars": chars, "dups": dups, "symbols": symbols}, (len(words), chars, symbols, dups, repeated_words(words))


def _upper(x: dict) -> bool:
    letters = sum(map(str.isalpha, x["text"]))
    return sum(map(str.isupper, x["text"])) > 0.4 * letters


def _top_word(x: dict) -> bool:
    from collections import Counter

    return Counter(x["words"]).most_common(1)[0][1] > 0.3 * len(x["words"])


def _dup_lines(x: dict) -> bool:
    if not x["dups"]:
        return False
    seen: set[str] = set()
    again = sum(len(s) for s in x["lines"] if s in seen or seen.add(s))
    return again > 0.3 * x["chars"]


#: Each rule says whether it rejects a text (which has words).
RULES: dict[str, Callable[[dict], bool]] = {
    "symbols": lambda x: x["symbols"] > 0.15 * len(x["words"]),
    "word_length": lambda x: not 2 <= x["chars"] / len(x["words"]) <= 14,
    "exclamations": lambda x: x["text"].count("!") > 0.3 * len(x["words"]),
    "ellipses": lambda x: sum(s.rstrip().endswith(("...", "…")) for s in x["lines"]) > 0.3 * len(x["lines"]),
    "bullets": lambda x: sum(s.lstrip()[:1] in "-*•" for s in x["lines"]) > 0.9 * len(x["lines"]),
    "dup_lines": _dup_lines,
    "upper_case": _upper,
    "wordless": lambda x: sum(any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in w) for w in x["words"]) < 0.7 * len(x["words"]),
    "top_word": _top_word,
}


def measured(text: str | None) -> list[dict]:
    """For each rule, whether it rejects a text and the seconds it takes; nothing for a text without words."""
    x, stats = base(text or "")
    out = []
    for name, rule in RULES.items() if stats[0] else ():
        began = time.perf_counter()
        rejected = rule(x)
        out.append({"rule": name, "rejected": int(rejected), "cost": time.perf_counter() - began})
    return out


def cascade_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """Rules with their rejected share and cost in seconds a text, by share per cost; the driver gets a row for each rule."""
    least = docs.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = docs.where(F.xxhash64(id_col) <= F.lit(least)).select(F.col(text_col).alias("t"))
    each = map_rows(some, "found array<struct<rule:string,rejected:int,cost:double>>", lambda: lambda text: (measured(text),))
    rows = each.select(F.explode("found").alias("f")).groupBy("f.rule").agg(F.avg("f.rejected"), F.avg("f.cost")).collect() if least is not None else []
    found = {name: (share, cost) for name, share, cost in rows}
    out = [(name, *found.get(name, (0.0, 0.0))) for name in RULES]
    return sorted(out, key=lambda x: -x[1] / (x[2] + 1e-9))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Statistics and verdict of every row; see the module's description. One map, after the sample's estimate."""
    order = [name for name, _, _ in cascade_order(docs, id_col, text_col, sample)]

    def make():
        rules = [RULES[name] for name in order]

        def row(key, text):
            x, stats = base(text or "")
            failed = stats[0] < LEAST_WORDS or 100 * stats[4] > 50 * stats[0]
            return (key, *stats, failed, not failed and not any(rule(x) for rule in rules))

        return row

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_rows(docs.select(id_col, text_col), schema, make)
