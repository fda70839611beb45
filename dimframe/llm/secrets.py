"""Secret scans: fixed patterns, and strings that a tokeniser finds hard.

A vocabulary learnt from prose encodes prose in few tokens; random strings
take many. A candidate string whose characters per token fall below a limit is
reported as ``random``, unless it is a known kind of identifier or digest, or
already lies within a span of the fixed patterns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text

#: The patterns of the base kinds and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Strings that may hide a secret: runs of the letters of base64 and its kin, from the length at which the ratio is reliable.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests and identifiers: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex; UUIDs; numbers.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9+_/=-]+)", re.IGNORECASE)
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # runs of one character class: the runs long enough are the matches of the class repeated often enough
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


@lru_cache(maxsize=2)
def _encoder(path: str | None, pattern: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_spans(text: str, base: list[tuple[int, int, str]], encode, ratio: float) -> list[tuple[int, int, str]]:
    """Candidates with fewer than ``ratio`` characters per token, outside ``base`` and no known identifier."""
    out = []
    # both in the order of their starts: a candidate lies within a span if one that starts no later ends no earlier
    spans, at, reach = sorted(base), 0, 0
    for m in CANDIDATE.finditer(text):
        s = m[0]
        while at < len(spans) and spans[at][0] <= m.start():
            reach = max(reach, spans[at][1])
            at += 1
        if m.end() <= reach or KNOWN.fullmatch(s):
            continue
        if len(s) < ratio * len(encode(s)):
            out.append((m.start(), m.end(), "random"))
    return out


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def secret_scan(docs: DataFrame, vocab: str | None = None, pattern: str | None = None, ratio: float = 2.2) -> DataFrame:
    """Secrets in the whole text of every row of ``docs``.

    doc_id, n_assign, n_access, n_hex, n_random (long), base_sha256 and spans:
    ``kind:start:end`` joined by commas, ordered by start and then by kind as
    listed in ``KINDS``; positions in code points, the end exclusive.
    base_sha256 is the digest of that text for the three base kinds alone.
    ``vocab`` is a tiktoken rank file that every machine can read and
    ``pattern`` its pre-tokeniser's; ``ratio`` the characters per token below
    which a candidate counts as random. Null texts are empty and hold nothing;
    rows with null or repeated ids are kept; other columns are ignored. No
    shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocab, pattern).encode_ordinary
        for b in batches:
            rows = []
            for text in b["text"].tolist():
                base = base_spans(text)
                more = random_spans(text, base, encode, ratio)
                kinds = [k for *_, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", empty_text("text").alias("text")).mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
