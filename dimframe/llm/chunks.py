"""Cuts texts into chunks that byte-level BPE encodes independently.

The pre-tokeniser of the vocabulary never lets a match cross the boundary
between a character and a single space that follows it, unless white space
stands on both sides. A text without such a place therefore falls apart at its
spaces: its first piece as it is, every further piece with its space in front.
Equal chunks need to be encoded only once. Other texts are cut by the
pre-tokeniser's pattern itself, and texts with characters that this machine's
Unicode tables do not know, on whose class libraries disagree, by the
tokenizers library's own pre-tokeniser.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import regex

#: Fixed value: the byte-level pre-tokeniser's pattern, as published with the vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_SPACE_AT_SPACE = re.compile(r"[^\S ] [^\S ]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        letters[b] = chr(b) if b in plain else chr(256 + extra)
        extra += b not in plain
    return letters


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t["content"] for t in vocabulary(path).get("added_tokens", []))


def chunks(text: str) -> tuple[list[str], list[str]]:
    """(chunks as they stand, chunks that have one space in front), together the whole text in order."""
    if not text:
        return [], []
    if "  " in text or _SPACE_AT_SPACE.search(text):
        return PATTERN.findall(text), []
    first, *rest = text.split(" ")
    if rest and not rest[-1]:  # a space at the very end
        return [first], rest
    return ([first] if first else []), rest


_SEEN, _UNASSIGNED = set(map(chr, range(128))), set()


def has_unassigned(text: str) -> bool:
    """Whether a text holds a character that is not assigned; each character is looked up once."""
    if text.isascii():
        return False
    chars = set(text)
    new = chars - _SEEN
    if new:
        _UNASSIGNED.update(c for c in new if unicodedata.category(c) == "Cn")
        _SEEN.update(new)
    return not _UNASSIGNED.isdisjoint(chars)


@lru_cache(maxsize=2)
def pre_tokeniser(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


def library_pieces(text: str, path: str) -> list[str]:
    """The pre-tokens of a text as the tokenizers library cuts it."""
    return [text[a:b] for _, (a, b) in pre_tokeniser(path).pre_tokenize_str(text)]


def default_vocab() -> str:
    """The place of byte_bpe_50k.json on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
