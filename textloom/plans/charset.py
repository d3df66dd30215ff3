"""Sets of code points, built when a plan is made.

A set is a sorted tuple of inclusive ranges. Sets support union, intersection, difference and complement, can be made
from properties, names or patterns over names, and are written as a Java character class.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

TOP = sys.maxunicode


class CharSet:
    """Code points as inclusive ranges."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = ()):
        out: list[list[int]] = []
        for a, b in sorted(ranges):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        self.ranges = tuple((a, b) for a, b in out)

    @classmethod
    def of(cls, chars: str) -> CharSet:
        return cls((ord(c), ord(c)) for c in chars)

    @classmethod
    def where(cls, test: Callable[[str], bool]) -> CharSet:
        return cls((i, i) for i in range(TOP + 1) if not 0xD800 <= i <= 0xDFFF and test(chr(i)))

    def __or__(self, other: CharSet) -> CharSet:
        return CharSet((*self.ranges, *other.ranges))

    def __invert__(self) -> CharSet:
        out, at = [], 0
        for a, b in self.ranges:
            if a > at:
                out.append((at, a - 1))
            at = b + 1
        if at <= TOP:
            out.append((at, TOP))
        return CharSet(out)

    def __and__(self, other: CharSet) -> CharSet:
        return ~(~self | ~other)

    def __sub__(self, other: CharSet) -> CharSet:
        return self & ~other

    def __contains__(self, char: str) -> bool:
        return any(a <= ord(char) <= b for a, b in self.ranges)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, CharSet) and self.ranges == other.ranges

    def __hash__(self) -> int:
        return hash(self.ranges)

    def __len__(self) -> int:
        return sum(b - a + 1 for a, b in self.ranges)

    def closed_over_case(self) -> CharSet:
        """With the simple case variants of its members."""
        more = set()
        for a, b in self.ranges:
            for i in range(a, b + 1):
                c = chr(i)
                more |= {ord(x) for x in (c.lower(), c.upper(), c.casefold()) if len(x) == 1}
        return self | CharSet((i, i) for i in more)

    def java(self) -> str:
        """A Java character class; an empty set is a class that matches nothing."""
        if not self.ranges:
            return r"[^\x{0}-\x{10FFFF}]"
        return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in self.ranges) + "]"


#: Properties that Java's regex knows by the same meaning, in its spelling.
JAVA_BINARY = {
    "alphabetic": r"\p{IsAlphabetic}", "alpha": r"\p{IsAlphabetic}", "whitespace": r"\p{IsWhite_Space}", "space": r"\p{IsWhite_Space}",
    "wspace": r"\p{IsWhite_Space}", "uppercase": r"\p{IsUppercase}", "upper": r"\p{IsUppercase}", "lowercase": r"\p{IsLowercase}",
    "lower": r"\p{IsLowercase}", "ideographic": r"\p{IsIdeographic}", "ideo": r"\p{IsIdeographic}", "assigned": r"\p{IsAssigned}",
    "hexdigit": r"\p{IsHex_Digit}", "xdigit": r"\p{IsHex_Digit}", "digit": r"\p{IsDigit}", "letter": r"\p{L}", "punct": r"\p{P}",
    "word": r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}]", "alnum": r"[\p{IsAlphabetic}\p{Nd}]", "any": r"[\x{0}-\x{10FFFF}]",
    "ascii": r"[\x00-\x7F]", "cntrl": r"\p{Cc}", "blank": r"[\p{Zs}\t]", "joincontrol": r"\p{IsJoin_Control}", "emoji": r"\p{IsEmoji}",
    "graph": r"[^\p{IsWhite_Space}\p{Cc}\p{Cs}\p{Cn}]", "print": r"[[^\p{IsWhite_Space}\p{Cc}\p{Cs}\p{Cn}]\p{Zs}]",
}
_LONG_GC = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm",
    "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd",
    "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd",
    "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z",
    "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf",
    "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
_GC = {x.lower() for x in (*_LONG_GC.values(), "L&")}


def loose(name: str) -> str:
    return re.sub(r"[\s_-]", "", name).lower()


def property_class(name: str, value: str | None = None) -> str:
    """A Java class for a property; scripts, blocks and general categories by Java, the rest by enumeration here."""
    key = loose(name)
    if value is None:
        if key in _LONG_GC and key not in ("letter",):
            return rf"\p{{{_LONG_GC[key]}}}" if key != "casedletter" else r"\p{LC}"
        if key in _GC:
            return rf"\p{{{key[0].upper() + key[1:]}}}" if key not in ("lc", "l&") else r"\p{LC}"
        if key in JAVA_BINARY:
            return JAVA_BINARY[key]
        if key.startswith("in"):
            return rf"\p{{In{name[2:]}}}"
        return rf"\p{{IsScript{''}{name}}}".replace("IsScript", "Is")
    if key in ("gc", "generalcategory"):
        return property_class(_LONG_GC.get(loose(value), value))
    if key in ("sc", "script", "scx", "scriptextensions"):
        return rf"\p{{script={value}}}"
    if key in ("blk", "block"):
        return rf"\p{{block={value}}}"
    return property_set(key, lambda v: loose(v) == loose(value)).java()


_VALUES: dict[str, Callable[[str], str]] = {
    "ccc": lambda c: str(unicodedata.combining(c)), "canonicalcombiningclass": lambda c: str(unicodedata.combining(c)),
    "ea": unicodedata.east_asian_width, "eastasianwidth": unicodedata.east_asian_width, "bc": unicodedata.bidirectional, "bidiclass": unicodedata.bidirectional,
    "gc": unicodedata.category, "generalcategory": unicodedata.category, "na": lambda c: unicodedata.name(c, ""), "name": lambda c: unicodedata.name(c, ""),
    "nv": lambda c: f"{unicodedata.numeric(c):g}" if unicodedata.numeric(c, None) is not None else "", "numericvalue": lambda c: f"{unicodedata.numeric(c):g}" if unicodedata.numeric(c, None) is not None else "",
    "lc": str.lower, "lowercasemapping": str.lower, "uc": str.upper, "uppercasemapping": str.upper, "tc": str.title, "titlecasemapping": str.title, "cf": str.casefold, "casefolding": str.casefold,
    "nfd": lambda c: unicodedata.normalize("NFD", c), "nfkd": lambda c: unicodedata.normalize("NFKD", c), "nfc": lambda c: unicodedata.normalize("NFC", c), "nfkc": lambda c: unicodedata.normalize("NFKC", c),
}


def value_of(prop: str) -> Callable[[str], str]:
    if loose(prop) not in _VALUES:
        raise ValueError(f"unsupported property {prop}")
    return _VALUES[loose(prop)]


@lru_cache(64)
def _by_value(prop: str) -> dict[str, tuple[int, ...]]:
    out: dict[str, list[int]] = {}
    f = value_of(prop)
    for i in range(TOP + 1):
        if not 0xD800 <= i <= 0xDFFF:
            out.setdefault(f(chr(i)), []).append(i)
    return {k: tuple(v) for k, v in out.items()}


def property_set(prop: str, test: Callable[[str], bool]) -> CharSet:
    """The characters whose value of ``prop`` passes ``test``."""
    return CharSet((i, i) for v, who in _by_value(loose(prop)).items() if test(v) for i in who)


def property_matches(prop: str, pattern: str) -> CharSet:
    """The characters whose value of ``prop`` holds a match of ``pattern``."""
    find = re.compile(pattern, re.IGNORECASE).search
    return property_set(prop, lambda v: bool(find(v)))


#: The general categories, fixed values of the Unicode standard.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()


def matching_class(prop: str, pattern: str) -> str:
    """``property_matches`` as a class of a Java pattern. Categories are named, as a class of hundreds of ranges is tested range by range."""
    if loose(prop) in ("gc", "generalcategory"):
        found = [c for c in CATEGORIES if re.search(pattern, c, re.IGNORECASE)]
        if found:
            return "[" + "".join(rf"\p{{{c}}}" for c in found) + "]"
    return property_matches(prop, pattern).java()


def property_equals(prop: str, other: str) -> CharSet:
    """The characters with equal values of two properties; ``identity`` is the character itself."""
    f, g = value_of(prop), (lambda c: c) if loose(other) == "identity" else value_of(other)
    return CharSet.where(lambda c: f(c) == g(c))


@lru_cache(64)
def named(pattern: str) -> CharSet:
    """Characters whose whole name matches a pattern (in capitals)."""
    try:
        return CharSet.of(unicodedata.lookup(pattern))
    except (KeyError, ValueError):
        pass
    match = re.compile(pattern.upper()).fullmatch
    return property_set("name", lambda v: bool(v) and bool(match(v)))
