"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every beginning of a piece of text has exactly one token that ends its
encoding. A token t can end a beginning if it is a suffix of it and, unless it
is all of it, leaves the token s that ends the rest unchanged: encoding the
bytes of s and t gives s and t again. So one token for each byte is all that an
encoding needs to keep; it is read off backwards. Of a short piece only the
entries that its end asks for are found. Appending bytes adds entries
to that table and changes none, and after an edit only the entries near it
change: as soon as as many entries as the longest token has bytes are what they
were, the rest is too.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PATTERN, chunks
from .common import empty_text

#: Pieces, chunks and pairs that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Bytes of a piece, at most, of which only the entries are found that its end asks for.
SHORT = 64


def default_ranks() -> str:
    """The place of byte_bpe_multi_50k.tiktoken on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Ranks:
    """A vocabulary of ranks, and which of its tokens may follow which."""

    def __init__(self, tokens: dict[bytes, int]):
        self.rank, self.token = tokens, {r: t for t, r in tokens.items()}
        self.longest = max(map(len, tokens))
        self.follows: dict[tuple[int, int], bool] = {}
        # a token that its own bytes do not give can end no encoding
        self.ending = {t: r for t, r in tokens.items() if self.merged(t) == [r]}
        self.endings = ahocorasick.Automaton()
        self.reach: dict[bytes, int] = {}  # how long a token with these three last bytes can be
        for t, r in self.ending.items():
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
            self.endings.add_word(t.decode("latin-1"), (r, len(t)))
        self.endings.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a short piece, one merge at a time: the neighbours whose union ranks first, the leftmost of equals."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        ranks = [self.rank.get(piece[k : k + 2], len(self.rank)) for k in range(len(piece) - 1)]
        while ranks and (first := min(ranks)) < len(self.rank):
            k = ranks.index(first)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            for j in (k - 1, k):
                if 0 <= j < len(ranks):
                    ranks[j] = self.rank.get(parts[j] + parts[j + 1], len(self.rank))
        return [self.rank[p] for p in parts]

    def may_follow(self, s: int, t: int) -> bool:
        """Whether ``t`` after ``s`` leaves both as they are."""
        known = self.follows.get((s, t))
        if known is None:
            if len(self.follows) >= 4 * REMEMBERED:
                self.follows.clear()
            known = self.follows[s, t] = self.merged(self.token[s] + self.token[t]) == [s, t]
        return known

    def extended(self, last: list[int], piece: bytes) -> list[int]:
        """The table ``last`` of the beginning of ``piece``, carried on to its end; entry n is for its first n bytes."""
        done, follows = len(last) - 1, self.follows
        last += [-1] * (len(piece) - done)
        begin = max(0, done - self.longest + 1)
        for end, (t, size) in self.endings.iter(piece[begin:].decode("latin-1")):
            at = begin + end + 1
            if last[at] >= 0:  # of an earlier call, or found
                continue
            if at == size:
                last[at] = t
            elif at > size:
                s = last[at - size]
                ok = follows.get((s, t))
                if self.may_follow(s, t) if ok is None else ok:
                    last[at] = t
        return last

    def asked(self, last: dict[int, int], piece: bytes, at: int) -> int:
        """The entry for the first ``at`` bytes of a short piece; it and those it needs are added to ``last``."""
        ending = self.ending
        begin = at - self.reach.get(piece[at - 3 : at], 2) if at > 2 else 0
        for begin in range(begin if begin > 0 else 0, at):
            t = ending.get(piece[begin:at])
            if t is None:
                continue
            if begin:
                s = last.get(begin)
                if s is None:
                    s = self.asked(last, piece, begin)
                ok = self.follows.get((s, t))
                if not (self.may_follow(s, t) if ok is None else ok):
                    continue
            last[at] = t
            return t
        raise ValueError("a byte is no token")

    def read(self, last: list[int] | dict[int, int], piece: bytes) -> list[int]:
        """The ids of a piece from its table; a piece that is a token is that token."""
        if piece in self.rank:
            return [self.rank[piece]]
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]

    def ids(self, piece: bytes) -> list[int]:
        known = self.rank.get(piece)
        if known is not None or not piece:
            return [known] if piece else []
        if len(piece) > SHORT:
            return self.read(self.extended([-1], piece), piece)
        last: dict[int, int] = {}
        self.asked(last, piece, len(piece))
        return self.read(last, piece)

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Piece:
    """One piece of text whose encoding follows appends and edits."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.bytes, self.last = ranks, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.bytes += more
        self.last = self.ranks.extended(self.last, self.bytes)

    def replace(self, a: int, b: int, new: bytes) -> int:
        """Puts ``new`` in the place of bytes ``a`` to ``b``; returns how many entries were made anew."""
        old, shift, edited = self.last, len(new) - (b - a), a + len(new)
        self.bytes = self.bytes[:a] + new + self.bytes[b:]
        last, far, at = old[: a + 1], self.ranks.longest, a
        while at < len(self.bytes):
            at = min(len(self.bytes), at + far if at > edited else edited + far)
            last = self.ranks.extended(last, self.bytes[:at])
            if at - far >= edited and last[at - far + 1 :] == old[at - far + 1 - shift : at + 1 - shift]:
                last += old[at + 1 - shift :]
                break
        self.last = last
        return at - a

    def ids(self) -> list[int]:
        return self.ranks.read(self.last, self.bytes)


@lru_cache(maxsize=1)
def ranks_of(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))})


class Classes:
    """Characters whose class (letter, number, white space, other) tiktoken's Unicode tables see otherwise than this machine's."""

    STAND_INS = "a1\t!"
    OWN = (("a", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")), ("\t", regex.compile(r"\s")))

    def __init__(self):
        import tiktoken

        tokens = [bytes([b]) for b in range(256)] + [x + bytes([b]) for x in (b"a", b"1", b"!") for b in range(256)]
        ranks = {t: k for k, t in enumerate(tokens)}
        self.library = tiktoken.Encoding("classes", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen, self.odd = set(map(chr, range(128))), {}

    def in_library(self, c: str) -> str:
        """A character joins one of its own class, so the two first bytes become one token."""
        size = len(c.encode())
        return next((x for x in "a1!" if len(self.library.encode_ordinary(x + c)) == size), "\t")

    def stand_ins(self, text: str) -> dict[int, str]:
        """For ``str.translate``: characters of another class, and one that both sides put into the class that tiktoken sees."""
        if text.isascii():
            return {}
        chars = set(text)
        for c in chars - self.seen:
            own, there = next((x for x, p in self.OWN if p.match(c)), "!"), self.in_library(c)
            if own != there:
                self.odd[ord(c)] = there
            self.seen.add(c)
        return {k: self.odd[k] for k in map(ord, chars) if k in self.odd} if self.odd else {}


@lru_cache(maxsize=1)
def classes() -> Classes:
    return Classes()


class Known(dict):
    """Remembers what ``make`` gives for strings, ``most`` of up to ``longest`` characters, and then starts afresh; longer ones are kept apart, in ``long``, for one text."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 40):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.long: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > self.longest:
            value = self.long.get(key)
            if value is None:
                value = self.long[key] = self.make(key)
            return value
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Ids of whole texts as unsigned 32-bit little-endian bytes, each distinct chunk and piece once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.ranks = ranks_of(path)
        self.pieces = Known(self._piece, remembered)
        self.raw = Known(lambda c: self._chunk(c, ""), remembered)
        self.spaced = Known(lambda c: self._chunk(c, " "), remembered)

    def forget(self) -> None:
        """Long strings of one text are not kept for the next."""
        for known in (self.pieces, self.raw, self.spaced):
            known.long.clear()

    def _piece(self, p: str) -> bytes:
        ids = self.ranks.ids(p.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, p: str) -> bytes:
        return self.pieces[p]

    def _chunk(self, c: str, prefix: str) -> bytes:
        if c.isascii():  # letters, or letters and one mark, are not worth the pattern
            if c.isalpha():
                return self._piece(prefix + c)
            if c[:-1].isalpha() and c[-1] in ",.;:!?":
                return self.pieces[prefix + c[:-1]] + self.pieces[c[-1]]
        return b"".join(map(self.pieces.__getitem__, PATTERN.findall(prefix + c)))

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern, as tiktoken finds them."""
        odd = classes().stand_ins(text)
        return [text[m.start() : m.end()] for m in PATTERN.finditer(text.translate(odd))] if odd else PATTERN.findall(text)

    def ids(self, text: str) -> bytes:
        self.forget()
        if classes().stand_ins(text):
            return b"".join(map(self.piece, self.cut(text)))
        raw, spaced = chunks(text)
        return b"".join(map(self.raw.__getitem__, raw)) + b"".join(map(self.spaced.__getitem__, spaced))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> TextEncoder:
    """The encoder of a worker, which keeps what it remembers for its next tasks."""
    return TextEncoder(path)


def tail_of(pieces: list[str]) -> int:
    """From which piece on appended text may change the pieces: a contraction can take up the two last characters."""
    k, size = len(pieces), 0
    while k and size < 2:
        k -= 1
        size += len(pieces[k])
    return k


def byte_bpe(docs: DataFrame, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``; with ``with_ids`` the ids and the decoded bytes, too.

    ``ranks`` is the path of a file of ranks that every machine can read
    (default: the installed byte_bpe_multi_50k.tiktoken). The ids are those of
    the tiktoken library without special tokens; their digest is of unsigned
    little-endian 32-bit numbers, that of the decoded bytes of what the ids give
    back. A null or empty text has no tokens. Rows with a null doc_id and
    repeated rows are kept as they are; other columns are ignored; an empty
    table gives an empty table. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(ranks or default_ranks())
        for b in batches:
            rows = []
            for text in b["text"].tolist():
                ids = encoder.ids(text)
                back = encoder.ranks.decoded(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), *([ids, back] * with_ids)))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])
            out.insert(0, "doc_id", b["doc_id"].reset_index(drop=True))
            yield out

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), empty_text("text").alias("text")).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


STATE = "ids binary, tail string, tail_ids int, last binary"


def encoded_state(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """The encoding of every row of ``docs`` in a form to which text can be appended: doc_id and

    ids; tail, the end of the text that more text may still change, which gives
    the last tail_ids of the ids; and last, the table of the tail's first piece
    (the token that ends each of its beginnings, as unsigned 32-bit numbers).
    The text itself is not kept. A null text is empty.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(b"").alias("ids"), F.lit("").alias("tail"), F.lit(0).alias("tail_ids"), F.lit(b"").alias("last"), F.col("text").alias("more"))
    return rows.mapInPandas(_appender(ranks), f"doc_id string, {STATE}").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def appended(state: DataFrame, more: DataFrame, ranks: str | None = None) -> DataFrame:
    """``state`` (of ``encoded_state``) after the texts of ``more`` (doc_id, text) were appended, exactly as if the whole texts had been encoded.

    Only the tails are cut and encoded again. Ids without a row in ``more``, null
    ids and null texts stay as they are; rows of ``more`` whose id is unknown are
    ignored; an id with several rows in ``more`` gives a row for each.
    """
    rows = state.select("doc_id", *[c.split()[0] for c in STATE.split(", ")])
    rows = rows.join(more.select("doc_id", F.col("text").alias("more")), "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(_appender(ranks), f"doc_id string, {STATE}").withColumn("doc_id", F.col("doc_id").cast(state.schema["doc_id"].dataType))


def _appender(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path or default_ranks())
        for b in batches:
            rows = [longer(encoder, bytes(i), t, n, bytes(x), m or "") for i, t, n, x, m in zip(b["ids"], b["tail"], b["tail_ids"], b["last"], b["more"].where(b["more"].notna(), None), strict=True)]
            out = pd.DataFrame(rows, columns=["ids", "tail", "tail_ids", "last"])
            out.insert(0, "doc_id", b["doc_id"].reset_index(drop=True))
            yield out

    return run


def longer(encoder: TextEncoder, ids: bytes, tail: str, tail_ids: int, last: bytes, more: str) -> tuple[bytes, str, int, bytes]:
    """One row of a state with ``more`` text."""
    if not more:
        return ids, tail, tail_ids, last
    encoder.forget()
    pieces = encoder.cut(tail + more)
    known = [-1, *np.frombuffer(last, "<u4").tolist()]
    parts, tables = [], []
    for k, p in enumerate(pieces):
        raw = p.encode("utf-8", "replace")
        if k == 0 and len(known) > 1:  # the first piece begins as it did, if it is not shorter now
            same = min(len(raw), len(known) - 1)
            table = encoder.ranks.extended(known[: same + 1], raw)
            parts.append(np.array(encoder.ranks.read(table, raw), "<u4").tobytes())
            tables.append(table)
        else:
            parts.append(encoder.piece(p))
            tables.append(None)
    at = tail_of(pieces)
    raw = pieces[at].encode("utf-8", "replace")
    table = tables[at] or encoder.ranks.extended([-1], raw)
    kept = ids[: len(ids) - 4 * tail_ids] + b"".join(parts[:at])
    end = b"".join(parts[at:])
    return kept + end, "".join(pieces[at:]), len(end) // 4, np.array(table[1:], "<u4").tobytes()
