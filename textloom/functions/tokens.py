"""Tokenization: normalizers in a chain, pre-tokenizers, split behaviours, and byte-pair encoding from a merge list."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions import normalize as _n
from textloom.functions.batches import sliced
from textloom.operators.lines import running_sums

_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
_WS = r"\p{IsWhite_Space}"
_WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}]"
_BERT_PUNCT = r"[!-/:-@\[-`{-~\p{P}]"
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
ENDOFTEXT = "<|endoftext|>"
#: Distinct pieces whose tokens a task keeps, and the longest of them.
KNOWN, KNOWN_CHARS = 100_000, 48


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(keep) else chr(next(others)) for b in range(256)]


def to_byte_level(text: Column) -> Column:
    """Each byte of the UTF-8 form as its character: bytes are read as Latin-1 and mapped, without leaving the JVM."""
    alphabet = byte_alphabet()
    moved = [b for b in range(256) if alphabet[b] != chr(b)]
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, moved)), "".join(alphabet[b] for b in moved))


def _nmt(t: Column) -> Column:
    t = F.regexp_replace(t, r"[\x{1}-\x{8}\x{B}\x{E}-\x{1F}\x{7F}\x{8F}\x{9F}]", "")
    return F.regexp_replace(t, r"[\x{9}\x{A}\x{C}\x{D}\x{1680}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}]", " ")


def _bert_clean(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"[\x{0}\x{FFFD}]|(?![\t\n\r])\p{C}", ""), _WS, " ")


NORMALIZERS = {
    "none": lambda t: t, "nfc": lambda t: _n.normalize(t, "NFC"), "nfd": lambda t: _n.normalize(t, "NFD"), "nfkc": lambda t: _n.normalize(t, "NFKC"),
    "nfkd": lambda t: _n.normalize(t, "NFKD"), "bytelevel": to_byte_level, "stripaccents": _n.strip_accents,
    "stripleft": lambda t: F.regexp_replace(t, rf"^{_WS}+", ""), "stripright": lambda t: F.regexp_replace(t, rf"{_WS}+\z", ""),
    "strip": lambda t: F.regexp_replace(t, rf"^{_WS}+|{_WS}+\z", ""), "lowercase": _n.simple_lower, "nmt": _nmt, "bertcleantext": _bert_clean,
    "bertchinesechars": lambda t: F.regexp_replace(t, f"({_CJK})", " $1 "),
}


def normalize(text: Column, *names: str) -> Column:
    for name in names:
        if name not in NORMALIZERS:
            raise ValueError(f"normalizer {name}")
        text = NORMALIZERS[name](text)
    return text


BEHAVIOURS = ("isolated", "removed", "mergedwithprevious", "mergedwithnext", "contiguous", "excludewhitespace")


def split_pattern(delimiter: str, behaviour: str) -> str:
    """A pattern whose matches are the pieces of a text cut at one-character delimiters (a class)."""
    rest = f"(?:(?!{delimiter})(?s:.))"
    return {
        "isolated": f"{delimiter}|{rest}+", "removed": f"{rest}+", "mergedwithprevious": f"{rest}*{delimiter}|{rest}+", "mergedwithnext": f"{delimiter}{rest}*|{rest}+",
        "contiguous": f"{delimiter}+|{rest}+", "excludewhitespace": f"(?!{_WS}){delimiter}|(?:(?!{delimiter}|{_WS})(?s:.))+",
    }[behaviour]


_PRE = {
    "whitespace": rf"{_WORD}+|(?:(?!{_WORD}|{_WS})(?s:.))+", "whitespacesplit": r"[^\p{IsWhite_Space}]+", "digits": None, "punctuation": None,
    "simplewordboundaries": rf"{_WORD}+|(?:(?!{_WORD})(?s:.))+", "bytelevel": GPT2, "bert": rf"{_BERT_PUNCT}|(?:(?!{_BERT_PUNCT}|{_WS})(?s:.))+", "chardelimiter": None,
    "sequence_whitespace_punctuation": rf"[!-/:-@\[-`{{-~\p{{P}}]|(?:(?![!-/:-@\[-`{{-~\p{{P}}]){_WORD})+|(?:(?!{_WORD}|{_WS}|\p{{P}}|[!-/:-@\[-`{{-~])(?s:.))+",
    # words of UAX #29 in short: letters with inner marks and apostrophes, numbers with inner separators, runs of white space, single others
    "uax29": r"[\p{IsAlphabetic}\p{Pc}\p{Nd}][\p{IsAlphabetic}\p{Pc}\p{Nd}\p{M}]*(?:(?:(?<=\p{IsAlphabetic})['.:\x{B7}\x{2019}](?=\p{IsAlphabetic})|(?<=\p{Nd})['.,;](?=\p{Nd}))[\p{IsAlphabetic}\p{Pc}\p{Nd}\p{M}]+)*|\r\n|(?: )+|\X",
}


def pretokenize(text: Column, kind: str, behaviour: str = "isolated", delimiter: str = " ", individual_digits: bool = False) -> Column:
    """The pieces of a text as an array."""
    if kind == "digits":
        pattern = split_pattern(r"\p{Nd}", "isolated" if individual_digits else "contiguous")
    elif kind == "punctuation":
        pattern = split_pattern(r"[!-/:-@\[-`{-~\p{P}]", behaviour)
    elif kind == "chardelimiter":
        from textloom.plans.regex import quote

        pattern = split_pattern(quote(delimiter), "removed")
    elif kind in _PRE:
        pattern = _PRE[kind]
    else:
        raise ValueError(f"pre-tokenizer {kind}")
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(pieces, to_byte_level) if kind == "bytelevel" else pieces


def with_offsets(pieces: Column, unit: str = "char") -> Column:
    """(piece, start, end) for pieces that cover their text; ``unit``: char or byte."""
    size = F.char_length if unit == "char" else F.octet_length
    sizes = F.transform(pieces, size)
    spans = F.zip_with(running_sums(sizes).cast("array<int>"), sizes, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
    return F.zip_with(pieces, spans, lambda p, s: F.struct(p.alias("piece"), s["start"].alias("start"), s["end"].alias("end")))


class Bpe:
    """Merges by rank: in a piece the adjacent pair of lowest rank is merged, the leftmost first, until none is left."""

    def __init__(self, merges: list[tuple[str, str]], limit: int | None = None):
        self.ranks = {pair: n for n, pair in enumerate(merges[:limit])}
        alphabet = sorted(byte_alphabet(), key=lambda c: byte_alphabet().index(c))
        self.ids = {c: n for n, c in enumerate(alphabet)}
        for n, (a, b) in enumerate(merges[:limit]):
            self.ids.setdefault(a + b, 256 + n)

    def pieces(self, token: str) -> list[str]:
        parts = list(token)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        ranks = self.ranks
        # pairs by rank and place; a pair that has changed since it was noted is passed over
        noted = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapq.heapify(noted)
        while noted:
            _, i, pair = heapq.heappop(noted)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(noted, (r, a, (parts[a], parts[b])))
        return [p for p in parts if p is not None]

    def encode(self, token: str) -> list[int]:
        return [self.ids[p] for p in self.pieces(token)]


def read_merges(lines: list[str]) -> list[tuple[str, str]]:
    """Lines ``A B`` in order of rank; a version line is skipped."""
    return [tuple(x.split(" ", 1)) for x in (line.rstrip("\n") for line in lines) if x and not x.startswith("#version")]


def bpe_tokens(df: DataFrame, merges: list[tuple[str, str]], text: str = "text", limit: int | None = None, strings: bool = False, strip_newlines: bool = False) -> DataFrame:
    """Tokens of each text as an array. A task keeps the tokens of up to ``KNOWN`` distinct pieces; ``<|endoftext|>`` passes as the id after the last merge."""
    source = F.regexp_replace(text, "[\r\n]", "") if strip_newlines else F.col(text)
    kind = T.ArrayType(T.StringType() if strings else T.IntegerType())
    end = [ENDOFTEXT] if strings else [256 + len(merges[:limit])]

    def start() -> Callable[[pa.Array], list]:
        bpe = Bpe(merges, limit)
        make = bpe.pieces if strings else bpe.encode
        known: dict[str, list] = {}

        def one(pieces: list[str]) -> list:
            out: list = []
            for p in pieces:
                if (ids := known.get(p)) is None:
                    ids = end if p == ENDOFTEXT else make(p)
                    if len(p) <= KNOWN_CHARS:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[p] = ids
                out += ids
            return out

        return lambda part: [None if v is None else one(v) for v in part.to_pylist()]

    pieces = F.regexp_extract_all(source, F.lit(r"<\|endoftext\|>|(?:(?!<\|endoftext\|>)(?:" + GPT2 + "))"), F.lit(0))
    return df.withColumn("tokens", sliced(kind, start)(F.transform(pieces, lambda p: F.when(p == ENDOFTEXT, p).otherwise(to_byte_level(p)))))
