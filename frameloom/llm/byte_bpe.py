"""Byte-level BPE: a lazily determinised transducer for encoding, an incremental UTF-8 machine for decoding.

**Encoding.** A rank file (token bytes to rank) fixes, for every byte string, one token sequence: neighbours merge in rank
order. Two facts make a left-to-right machine possible. A sequence is *the* encoding iff each neighbouring pair of it encodes
to itself, and of all encodings of a string's prefixes exactly one token ends at each position. So the encodings of all
prefixes form a tree over positions. A position stays alive while the bytes after it begin some longer token; what the ways
to all live positions share can be emitted. A state is the last emitted token, the bytes since the first live position and,
for each live position, the tokens that lead to it; the longest token bounds all of them, and so the lookahead. States and transitions are made when first met and kept in a
table of a bounded number of states; where a full table ends, the same moves go on without being kept.

**Decoding.** Token bytes are joined block by block; a byte-level state machine carries a character that a block cuts in two.

Results: a null or empty text has no tokens; its digests are those of no bytes. Rows are never dropped or merged, so ties and
repeated rows each get their own result. Only the identifier and text columns are read; extra columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from frameloom.llm.common import map_rows

#: States of the transducer and entries of the piece memory that a worker keeps at most; beyond, they aren't kept.
MAX_STATES = 60_000
MAX_PIECES = 400_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Tokens that are decoded at a time.
BLOCK = 1 << 16


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Parses a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Byte-driven transducer for one rank table; see the module's description."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.ranks, self.max_states = ranks, max_states
        self.token = {r: t for t, r in ranks.items()}
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        #: of a byte string, twice its rank plus one (0: no token), plus one if it begins a longer token
        self.look = {t: 2 * ranks.get(t, -1) + 2 + (t in self.starts) for t in self.starts | set(ranks)}
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        begin = (-1, b"", ((0, ()),))
        self.ids = {begin: 0}
        self.states = [begin]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, piece: bytes) -> list[int]:
        """The definition: joins the neighbours of least rank until none has one. Only used on a pair of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte, and for bytes that don't merge into t."""
        found = self.made.get(t, 0)
        if found == 0:
            parts = [self.ranks[self.token[t][i : i + 1]] for i in range(len(self.token[t]))]
            while len(parts) > 2:
                best = min((self.ranks.get(self.token[x] + self.token[y], t), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if best[0] >= t:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            found = self.made[t] = tuple(parts) if len(parts) == 2 else None
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether b can follow a (-1: the start) in an encoding: no merge ever crosses the border between them.

        The walk undoes the merges on both sides of the border, latest first. The tokens x and y that then met there would
        have merged if their rank came before the merge that took one of them in; of equal ranks the left goes first.
        """
        if a < 0:
            return len(self.token[b]) == 1 or self.halves(b) is not None
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            ok = self.stable(-1, a) and self.stable(-1, b)
            x, y, before = a, b, 1 << 60
            while ok:
                if self.ranks.get(self.token[x] + self.token[y], 1 << 60) < before:
                    ok = False
                elif len(self.token[x]) > 1 and (x > y or len(self.token[y]) == 1):
                    before, x = x, self.halves(x)[1]
                elif len(self.token[y]) > 1:
                    before, y = y + 1, self.halves(y)[0]
                else:
                    break
            self.pairs[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, tail, live = self.states[state]
        tail += bytes([byte])
        n, found, on = len(tail), None, []
        for back, chain in live:
            held = tail[n - 1 - back :]
            if found is None:
                t = self.ranks.get(held)
                if t is not None and self.stable(chain[-1] if chain else last, t):
                    found = (*chain, t)
            if held in self.starts:
                on.append((back + 1, chain))
        if found is None:
            raise ValueError("no token ends here: the ranks are not those of merges")
        # what the ways to all live positions share is decided
        shared = 0
        if not on:
            shared = len(found)
        elif on[0][1]:
            least = min(len(c) for _, c in on)
            while shared < least and all(c[shared] == found[shared] for _, c in on):
                shared += 1
        out = found[:shared]
        key = (out[-1] if out else last, tail[n - on[0][0] :] if on else b"", (*[(k, c[shared:]) for k, c in on], (0, found[shared:])))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = to, out
        return to, out

    def _rest(self, state: int, data: bytes) -> list[int]:
        """The tokens from a state on, by the same moves but without making states. Ways are linked lists, last token first."""
        last, tail, live = self.states[state]
        data = tail + data
        n, ways = len(tail), []
        for back, chain in live:
            way = None
            for t in chain:
                way = t, way
            ways.append((n - back, way))
        look, stable = self.look.get, self.stable
        for n in range(n + 1, len(data) + 1):
            found, on = None, []
            for at in ways:
                begin, way = at
                v = look(data[begin:n])
                if v:
                    if found is None and v > 1 and stable(way[0] if way else last, (v >> 1) - 1):
                        found = (v >> 1) - 1, way
                    if v & 1:
                        on.append(at)
            on.append((n, found))
            ways = on
        out, way = [], ways[-1][1]
        while way:
            out.append(way[0])
            way = way[1]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece. A piece that is itself a token stays whole, as rank-file encoders do."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, moves = 0, [], self.moves
        for i, byte in enumerate(piece):
            to = moves[state].get(byte)
            if to is None:
                if len(moves) >= self.max_states:
                    return out + self._rest(state, piece[i:])
                to = self._move(state, byte)
            state = to[0]
            if to[1]:
                out += to[1]
        return out + list(self.states[state][2][-1][1])


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Matches(dict):
    """Memory of the encoded bytes of single matches of the split pattern."""

    def __init__(self, encode, most: int = MAX_PIECES) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, match: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[match] = pack(self.encode(match.encode()))
        return ids


class Chunks(dict):
    """Memory of the encoded bytes of space-separated parts; ``None`` marks a part that can't stand alone.

    It holds two generations of ``most`` parts each: a full one becomes the old one, from which parts in use come back.
    """

    def __init__(self, encode, word, lead: str, most: int, first: Chunks | None = None) -> None:
        super().__init__()
        self.encode, self.word, self.lead, self.most, self.old, self.first, self.tails = encode, word, lead, most, {}, self if first is None else first, {}

    def __missing__(self, part: str) -> bytes | None:
        ids = self.old.get(part, 0)
        if ids == 0:
            if part.isalpha():
                ids = self[part] = self.word(self.lead + part)
                if len(self) > self.most:
                    self.put(part, ids)
                return ids
            ids = None if not part or part[0].isspace() or part[-1].isspace() else self._whole(part)
        self.put(part, ids)
        return ids

    def _whole(self, part: str) -> bytes:
        """A part's ids, from those of its pieces where it surely splits: around a line break between other characters, and after letters
        that only ASCII punctuation follows. So words are encoded once for all the forms in which they stand."""
        head, cut, rest = part.partition("\n")
        if cut and head and rest and not head[-1].isspace() and not rest[0].isspace():
            return self[head] + self._tail("\n") + self.first[rest]
        stem = part.rstrip(PUNCTUATION)
        if stem != part and stem.isalpha():
            return self[stem] + self._tail(part[len(stem) :])
        return self.encode(self.lead + part)

    def _tail(self, text: str) -> bytes:
        ids = self.tails.get(text)
        if ids is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            ids = self.tails[text] = self.encode(text)
        return ids

    def forget(self) -> None:
        self.clear()
        self.old, self.tails = {}, {}

    def put(self, part: str, ids: bytes | None) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[part] = ids


class ChunkedEncoder:
    """Encodes whole texts from memorised parts.

    ``encode_piece`` maps a string to id bytes. A blank between two characters that aren't white space always starts a new
    match of the usual split patterns, so a text may be cut before such blanks and each part encoded once. Parts at other blanks are joined again
    before they are encoded, whole and never cut. ``encode_word`` does the same for letters, with or without a blank before them: one match.
    """

    def __init__(self, encode_piece, encode_word, most: int = MAX_PIECES) -> None:
        self.encode_piece = encode_piece
        self.first = Chunks(encode_piece, encode_word, "", most // 4)
        self.inner = Chunks(encode_piece, encode_word, " ", most, self.first)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        found = [self.first[parts[0]], *map(self.inner.__getitem__, parts[1:])]
        try:
            return b"".join(found)
        except TypeError:  # some part can't stand alone
            out, run = [], None
        for k, (part, ids) in enumerate(zip(parts, found)):
            lead = " " * (k > 0)
            if ids is not None and (run is None or (run and not run[-1][-1:].isspace() and run[-1] != "")):
                if run:
                    out.append(self.encode_piece("".join(run)))
                run = None
                # a part that is followed by an unsafe one belongs to that run
                if k + 1 < len(parts) and found[k + 1] is None:
                    run = [lead + part]
                else:
                    out.append(ids)
            else:
                run = (run or []) + [lead + part]
        if run:
            out.append(self.encode_piece("".join(run)))
        return b"".join(out)


class Utf8Machine:
    """Incremental UTF-8 decoding by a state machine over bytes; malformed input gives U+FFFD."""

    #: lead byte ranges: first, last, bytes to follow, least and greatest second byte (fixed values of UTF-8)
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self) -> None:
        self.lead = {b: x[2:] for x in self.LEADS for b in range(x[0], x[1] + 1)}
        self.held, self.need, self.low, self.high, self.bad = b"", 0, 0x80, 0xBF, False

    def step(self, byte: int) -> str:
        """Takes one byte; returns the characters it completes."""
        if self.need:
            if self.low <= byte <= self.high:
                self.held += bytes([byte])
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if self.need:
                    return ""
                done, self.held = self.held.decode(), b""
                return done
            self.held, self.need, self.low, self.high, self.bad = b"", 0, 0x80, 0xBF, True
            return "�" + self.step(byte)
        if byte < 0x80:
            return chr(byte)
        if byte in self.lead:
            self.held = bytes([byte])
            self.need, self.low, self.high = self.lead[byte]
            return ""
        self.bad = True
        return "�"

    def feed(self, data: bytes) -> str:
        """Takes a block. Bytes at its borders go through the machine, the well-formed middle through the codec."""
        out, i, n = [], 0, len(data)
        while i < n and self.need:
            out.append(self.step(data[i]))
            i += 1
        cut = n
        while cut > i and n - cut < 3 and data[cut - 1] & 0xC0 == 0x80:
            cut -= 1
        if cut > i and data[cut - 1] >= 0xC2:
            cut -= 1
        else:
            cut = n
        try:
            out.append(data[i:cut].decode())
        except UnicodeDecodeError:
            cut = i
        out += map(self.step, data[cut:])
        return "".join(out)

    def end(self) -> str:
        """Closes the stream; a character that lacks bytes is malformed."""
        cut, self.held, self.need = self.held, b"", 0
        self.bad |= bool(cut)
        return "�" if cut else ""


def decode_stream(blocks: Iterable[list[int]], token: dict[int, bytes]) -> Iterator[tuple[bytes, str]]:
    """Decodes blocks of ids as they come: each block's bytes, and the characters that are complete so far."""
    machine = Utf8Machine()
    for ids in blocks:
        data = b"".join([token[i] for i in ids])
        yield data, machine.feed(data)
    if tail := machine.end():
        yield b"", tail


class Codec:
    """Encoder and decoder of one worker, made once for each rank file and pattern."""

    held: dict[tuple[str, str], Codec] = {}

    def __init__(self, data: bytes, pattern: str) -> None:
        ranks = load_ranks(data)
        self.machine, self.token = Transducer(ranks), {r: t for t, r in ranks.items()}
        find = regex.compile(pattern).findall
        encode = self.machine.encode

        self.matches = matches = Matches(encode, MAX_PIECES // 4)
        self.parts = ChunkedEncoder(lambda text: b"".join([matches[m] for m in find(text)]), lambda text: pack(encode(text.encode())))
        self.encode = self.parts.encode

    @classmethod
    def of(cls, data: bytes, pattern: str) -> Codec:
        key = hashlib.sha256(data).hexdigest(), pattern
        if key not in cls.held:
            cls.held = {key: cls(data, pattern)}
        return cls.held[key]

    @classmethod
    def rest(cls) -> None:
        """Between tasks a worker keeps the transducer, but not the parts of texts that it has seen: it may be idle beside other work."""
        for codec in cls.held.values():
            codec.matches.clear()
            codec.parts.first.forget()
            codec.parts.inner.forget()


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns the identifier, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the bytes that the ids decode to), ``round_trip`` (whether those are the text's bytes and
    well-formed UTF-8) and, with ``keep_ids``, ``ids`` as such bytes. The rank file is read on the driver and broadcast
    (a vocabulary, about 1 MB). It is one map without a shuffle.
    """
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        import numpy as np

        codec = Codec.of(data.value, pattern)

        def row(key, text):
            raw = codec.encode(text or "")
            digest, chars, ok = hashlib.sha256(), 0, True
            ids = np.frombuffer(raw, "<u4")
            for part, done in decode_stream((ids[i : i + BLOCK].tolist() for i in range(0, len(ids), BLOCK)), codec.token):
                digest.update(part)
                ok = ok and (text or "").startswith(done, chars)
                chars += len(done)
            out = key, len(ids), hashlib.sha256(raw).hexdigest(), digest.hexdigest(), ok and chars == len(text or "")
            return (*out, raw) if keep_ids else out

        return row

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids binary" * keep_ids
    return map_rows(docs.select(id_col, text_col), schema, make, Codec.rest)
