"""Text compression of three kinds, each with its inverse: UTF-8 prefix elision, byte runs, repeated words.

Codes are of this package's own layout; a text decodes to itself. Code bytes are such as UTF-8 never uses (F8 to FF), so texts need no escapes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from textloom.functions.batches import by_value


_SEQUENCE = re.compile(rb"[\xc2-\xdf].?|[\xe0-\xef].{0,2}|[\xf0-\xf7].{0,3}", re.S)
_NOT_ASCII = re.compile(rb"[\x80-\xbf\xc2-\xf7]")


def elide_prefixes(data: bytes) -> bytes:
    """Drops the first byte of a 2- or 3-byte sequence that equals the one before; the sequences in between are ASCII or of its length."""
    last = None

    def one(m: re.Match) -> bytes:
        nonlocal last
        sequence = m[0]
        b = sequence[0]
        if b == last:
            return sequence[1:]
        last = b if b < 0xF0 else None
        return sequence

    return _SEQUENCE.sub(one, data)


def restore_prefixes(data: bytes) -> bytes:
    out, prefix, at = [], None, 0
    while m := _NOT_ASCII.search(data, at):
        i = m.start()
        b = data[i]
        if b < 0xC0:
            n = 1 if prefix is None or prefix < 0xE0 else 2
            out += (data[at:i], b"" if prefix is None else _BYTE[prefix], data[i : i + n])
        else:
            n = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            prefix = b if n < 4 else None
            out.append(data[at : i + n])
        at = i + n
    out.append(data[at:])
    return b"".join(out)


_BYTE = [bytes([b]) for b in range(256)]

_RUN = re.compile(rb"(.)\1{3,}", re.S)


def code_runs(data: bytes) -> bytes:
    """Runs of four or more equal bytes: the byte, F9, and the count in base 128."""

    def one(m: re.Match) -> bytes:
        n, digits = len(m[0]), bytearray()
        while True:
            digits.append(n & 0x7F)
            n >>= 7
            if not n:
                break
            digits[-1] |= 0x80
        return m[1] + b"\xf9" + bytes(digits)

    return _RUN.sub(one, data)


_CODED_RUN = re.compile(rb"(.)\xf9([\x80-\xff]*[\x00-\x7f])", re.S)


def restore_runs(data: bytes) -> bytes:
    return _CODED_RUN.sub(lambda m: m[1] * sum((d & 0x7F) << 7 * k for k, d in enumerate(m[2])), data)


_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f\xf8-\xff]{3,32}")


def code_words(data: bytes) -> bytes:
    """Words of 3 to 32 bytes by length group: the first occurrence builds an entry, later ones are FA to FE and two hash bytes."""
    table: dict[tuple[int, int], bytes] = {}

    def one(m: re.Match) -> bytes:
        word = m[0]
        if len(word) < 4:
            return word
        group = min((len(word) - 1).bit_length() - 2, 4)
        slot = _hash(word)
        if table.get((group, slot)) == word:
            return bytes([0xFA + group, slot >> 8, slot & 0xFF])
        table.setdefault((group, slot), word)
        return word

    return _WORD.sub(one, data)


_CODED_WORD = re.compile(rb"[\xfa-\xfe]..|" + _WORD.pattern, re.S)


def restore_words(data: bytes) -> bytes:
    table: dict[tuple[int, int], bytes] = {}

    def one(m: re.Match) -> bytes:
        word = m[0]
        if word[0] >= 0xFA:
            return table[word[0] - 0xFA, word[1] << 8 | word[2]]
        if len(word) >= 4:
            table.setdefault((min((len(word) - 1).bit_length() - 2, 4), _hash(word)), word)
        return word

    return _CODED_WORD.sub(one, data)


@functools.lru_cache(1 << 15)  # of at most 32 bytes each
def _hash(word: bytes) -> int:
    h = 0
    for b in word:
        h = (h * 31 + b) & 0x7FFF
    return h


_KINDS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {"prefix": (elide_prefixes, restore_prefixes), "runs": (code_runs, restore_runs), "words": (code_words, restore_words)}


def _apply(data: Column, f: Callable[[bytes], bytes]) -> Column:
    return by_value(T.BinaryType(), f)(data.cast("binary"))


def compress(data: Column, kind: str) -> Column:
    return _apply(data, _KINDS[kind][0])


def decompress(data: Column, kind: str) -> Column:
    return _apply(data, _KINDS[kind][1])


def word_groups(text: Column) -> Column:
    """Words of a text with their length group."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.octet_length(w).alias("bytes"), F.when(F.octet_length(w) <= 4, 0).when(F.octet_length(w) <= 8, 1).when(F.octet_length(w) <= 16, 2).otherwise(3).alias("length_group")))
