"""Byte-level BPE and the token store against the public libraries."""

from __future__ import annotations

import base64
import glob
import hashlib
import itertools
import json
import os
import random
import shutil
import struct
import zlib

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm import byte_bpe, token_store

RANKS = P.path("byte_bpe_50k.tiktoken")
LETTERS = "ab  \n\t'sé漢字🙂12.,- 　 thenré"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return [*out, "a" * 3000, " " * 900 + "x", " \n" * 40, "<|endoftext|>", "x  y", "  lead", "trail  "]


@pytest.mark.parametrize("states", [60_000, 40])
def test_encoding_equals_library(codec, library, states):
    codec.machine.max_states = states
    made = codec.encode.__self__
    encoder = byte_bpe.ChunkedEncoder(made.encode_piece, made.first.word, 50)
    for text in random_texts(1500):
        raw = encoder.encode(text)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == library.encode_ordinary(text), text


def test_library_encoder_equals_library():
    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    whole, encoder = Tokenizer.from_str(spec), token_store.LibraryEncoder(spec)
    for text in [*random_texts(1500, 2), "a<|endoftext|>b <|endoftext|> c", "<|endoftext", "ǅungla ªº ⅷ x² ٣"]:
        raw = encoder.encode(text)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == whole.encode(text, add_special_tokens=False).ids, text


def in_batches(encoder, texts, size):
    for k in range(0, len(texts), size):
        raw, bounds = encoder.encode_all(pa.array(texts, pa.string()).slice(k, size), struct.pack("<I", 2))
        yield from (list(struct.unpack(f"<{(b - a) // 4}I", raw[a:b])) for a, b in itertools.pairwise(bounds))


def test_batches_equal_library():
    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    whole, rng = Tokenizer.from_str(spec), random.Random(4)
    letters = [*"abé ß漢×÷·’”،'ſ", *" " * 8, *"\n\n\t\r\x0b\x1c\x85\xa0   　", *",.!-'_$,.", *"19²", "the", "'s", "́", "🙂"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", "", "à µ à ª", "a\xa0 \xa0 b à \xa0", "é×, é, ×! a×", "x<|endoftext|>, y", "<|endoftext", " \n a,\n", "word,\nWord!\nword.\n\nword", "one, " * 3000]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for most, size in ((100, 37), (10**6, 5000), (0, 1)):
        encoder = token_store.LibraryEncoder(spec, most)
        for text, got, ids in zip(texts, in_batches(encoder, texts, size), want, strict=True):
            assert got == ids, text


@pytest.mark.parametrize("change", ["token", "ignore_merges", "prefix"])
def test_other_tokenizers(change):
    """Words are encoded one by one where tokens could go over their borders, and texts whole where the split is another one."""
    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    if change == "token":
        merge = ["e", "Ġ"] if isinstance(spec["model"]["merges"][0], list) else "e Ġ"
        spec["model"]["merges"].insert(0, merge)
        spec["model"]["vocab"]["eĠ"] = 50257
    elif change == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    else:
        spec["model"]["ignore_merges"] = True
    spec = json.dumps(spec)
    whole, encoder = Tokenizer.from_str(spec), token_store.LibraryEncoder(spec)
    assert " " not in encoder.apart or change == "prefix"
    texts = [*random_texts(300, 6), "the tree\nthe trees, be, e\nbe e"]
    for text, got in zip(texts, in_batches(encoder, texts, 64), strict=True):
        assert got == [*whole.encode(text, add_special_tokens=False).ids, 2], text


def test_words_together():
    """The model gets unknown words together, each word once for all its forms; before, each by a call of its own."""
    encoder = token_store.LibraryEncoder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    calls, model, whole = [], encoder.model, encoder.whole
    encoder.model = lambda text: calls.append(text) or model(text)
    encoder.whole = lambda text: calls.append(text) or whole(text)
    words = ["w" + "".join("abcdefghij"[int(d)] for d in str(i)) for i in range(640)]
    texts = [" ".join(["", *words]), " ".join(["", *(w + "," for w in words)]), "x\n" + "\nx ".join(w + ".!" for w in words)]
    assert len(list(in_batches(encoder, texts, 3))) == 3
    assert len(calls) <= 2 * 640 // token_store.JOINT + 10
    calls.clear()
    list(in_batches(encoder, texts[::-1], 1))
    assert not calls


def test_cuts_of_many_texts():
    import numpy as np

    rng = np.random.default_rng(8)
    sizes = [1, 255, 256, 257, 5000, 0, 70000, 20000, 3]
    docs = [rng.integers(0, 50000, n).astype("<u4") for n in sizes[:-2]] + [np.full(20000, 7, "<u4"), np.arange(3, dtype="<u4")]
    bounds = np.cumsum([0, *map(len, docs)]).tolist()
    marked = token_store.marks(np.concatenate(docs))
    for ids, (begin, end) in zip(docs, itertools.pairwise(bounds), strict=True):
        x = [int(v) * token_store.MIX % 2**64 for v in ids.tolist()]
        x = [v ^ v >> 29 for v in x]
        ends, last = [], 0
        for k in range(1, len(x) + 1):  # the definition
            due = sum(x[max(0, k - token_store.WINDOW) : k]) * token_store.MIX % 2**64 >> 64 - token_store.BITS == 0
            if k == len(x) or (due and k - last >= token_store.LEAST) or k - last == token_store.MOST:
                ends.append(k)
                last = k
        assert token_store.cut_points(ids) == [e - begin for e in token_store.chunk_ends(marked, begin, end)] == ends
    assert [[r["d"] for r in g.to_pylist()] for g in token_store.groups(pa.RecordBatch.from_pydict({"t": ["aa", None, "é", "x" * 9, "", "b"], "d": [*range(6)]}), 4)] == [[0, 1, 2], [3], [4, 5]]


def test_transducer_on_random_bytes(codec):
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeth \xc3\xa9\xff") for _ in range(rng.randint(1, 20)))
        assert codec.machine.encode(piece) == ([codec.machine.ranks[piece]] if piece in codec.machine.ranks else codec.machine.merge(piece))


def test_streaming_decode(codec):
    text = "é漢字🙂 the" * 50
    raw = codec.encode(text)
    ids = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    for size in (1, 2, 7):
        parts = list(byte_bpe.decode_stream((ids[i : i + size] for i in range(0, len(ids), size)), codec.token))
        assert b"".join(p for p, _ in parts) == text.encode() and "".join(c for _, c in parts) == text
    rng = random.Random(5)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        m, k = byte_bpe.Utf8Machine(), rng.randint(0, 12)
        assert m.feed(data[:k]) + m.feed(data[k:]) + m.end() == data.decode(errors="replace")


def test_documents(spark, library):
    rows = [(1, None), (2, ""), (3, "The the"), (3, "The the"), (None, "é\n\nx"), (4, "w " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1)).withColumn("ids", F.lit("x"))
    out = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in out.collect())
    want = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((key or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert got == sorted(want)
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(9)
    long = " ".join(rng.choice(["then", "ré", "blend", "x9,", "\n\nof"]) for _ in range(30000))
    texts = {1: "", 2: None, 5: "The end.", 7: long, 9: long + " tail", 11: "a  b  c", 12: "The end."}
    docs = spark.createDataFrame([*texts.items(), (5, "The end."), (None, "null id")], "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("payload", F.lit("p")).repartition(3)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, P.path("byte_bpe_50k.json"), 2)
    order = [(None, "null id"), (1, ""), (2, None), (5, "The end."), (5, "The end."), (7, long), (9, texts[9]), (11, texts[11]), (12, "The end.")]
    start, want = 0, []
    for key, text in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key or 0, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    rows = token_store.read_digests(spark, path).collect()
    assert all(r.verified for r in rows)
    assert sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in rows) == [(k, s, n, zlib.crc32(raw)) for k, s, n, raw in want]
    assert sorted((r.doc_id or 0, r.start, r.n_tokens, bytes(r.ids)) for r in token_store.read_documents(spark, path).collect()) == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("gkey").distinct().count() < sum(len(token_store.cut_points(__import__("numpy").frombuffer(w[3], "<u4"))) for w in want)
    files = sorted(glob.glob(f"{tmp_path}/store/recipes/part-*.parquet"))
    assert [r["doc_id"] or 0 for f in files for r in pq.read_table(f).to_pylist()] == [w[0] for w in want]
    assert [(r.level, r.n_docs, r.n_tokens) for r in spark.read.parquet(f"{path}/manifest").where("level = 2").collect()] == [(2, len(want), start)]


@pytest.mark.parametrize("column,value", [("start", "start + 1"), ("keys", "concat(substring(keys, 33), substring(keys, 1, 32))"), ("n_tokens", "n_tokens - 1"), ("doc_id", "doc_id + 100"), ("root", "unhex(sha2(root, 256))")])
def test_changed_recipe(spark, tmp_path, column, value):
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 911}" for k in range(9000))) for i in range(3)], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"), 2)
    recipes = spark.read.parquet(f"{path}/recipes")
    changed = recipes.select(*[F.when(F.col("doc_id") == 1, F.expr(value)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in recipes.columns])
    changed.write.parquet(f"{path}/changed")
    shutil.rmtree(f"{tmp_path}/store/recipes")
    os.rename(f"{tmp_path}/store/changed", f"{tmp_path}/store/recipes")
    spark.catalog.clearCache()
    if column == "keys":  # the manifest holds roots; a recipe's keys are held against its root
        assert [r.verified for r in token_store.read_digests(spark, path).orderBy("doc_id").collect()] == [True, False, True]
    else:
        with pytest.raises(ValueError, match="manifest"):
            token_store.read_digests(spark, path)


def test_empty_store(spark, tmp_path):
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/s", P.path("byte_bpe_50k.json"), 2)
    assert token_store.read_digests(spark, f"file://{tmp_path}/s").count() == 0
