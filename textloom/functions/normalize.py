"""Normalization forms. Spark has none built in, so a vectorized Python function does them, on rows that need it only: a text
of ASCII characters is its own normal form and never leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from textloom.functions.batches import by_value
from textloom.plans.charset import CharSet

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalized(text: str, form: str) -> str:
    return unicodedata.normalize(form, text)


def _focused(text: Column, test: str, change: Callable[[str], str]) -> Column:
    """``change`` on the rows that pass a regex, the others untouched."""
    return F.when(text.rlike(test), by_value(T.StringType(), change)(F.when(text.rlike(test), text))).otherwise(text)


def normalize(text: Column, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(form)
    # below U+00C0 nothing decomposes canonically; below U+0300 everything is composed already
    clean = {"NFC": r"[^\x{0}-\x{2FF}]", "NFD": r"[^\x{0}-\x{BF}]", "NFKC": r"[^\x{0}-\x{7F}]", "NFKD": r"[^\x{0}-\x{7F}]"}[form]
    return _focused(text, clean, lambda t: unicodedata.normalize(form, t))


def normalize_where(text: Column, form: str, chars: CharSet, output: str = "all") -> Column:
    """Only characters of a set are normalized, run by run. ``output``: all, inside (the set's characters) or outside."""

    def change(t: str) -> str:
        out, run, inside = [], [], False

        def flush() -> None:
            if run and (output == "all" or (output == "inside") == inside):
                out.append(unicodedata.normalize(form, "".join(run)) if inside else "".join(run))
            run.clear()

        for c in t:
            if (c in chars) != inside:
                flush()
                inside = not inside
            run.append(c)
        flush()
        return "".join(out)

    return _focused(text, r"(?s).", change)


def is_fcd(text: str) -> bool:
    """Whether decomposing each character in place leaves combining marks in order."""
    last = 0
    for c in text:
        d = unicodedata.normalize("NFD", c)
        first = unicodedata.combining(d[0])
        if first and last > first:
            return False
        last = unicodedata.combining(d[-1])
    return True


def fcd_failures(text: Column) -> Column:
    """Positions (code points) at which the FCD test fails."""
    def bad(t: str) -> list[int]:
        out, last = [], 0
        for i, c in enumerate(t):
            d = unicodedata.normalize("NFD", c)
            first = unicodedata.combining(d[0])
            if first and last > first:
                out.append(i)
            last = unicodedata.combining(d[-1])
        return out

    test = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(test, by_value(T.ArrayType(T.IntegerType()), bad)(F.when(test, text))).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))


S, L, V, TT, N = 0xAC00, 0x1100, 0x1161, 0x11A7, 28


def hangul_decompose(text: Column) -> Column:
    """Syllables to jamo by arithmetic, without leaving the JVM."""

    def one(c: Column) -> Column:
        i = F.ascii(c) - S
        char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
        tail = F.when(F.pmod(i, F.lit(N)) == 0, "").otherwise(char(F.lit(TT) + F.pmod(i, F.lit(N))))
        made = F.concat(char(F.lit(L) + F.floor(i / 588)), char(F.lit(V) + F.floor(F.pmod(i, F.lit(588)) / N)), tail)
        return F.when((F.ascii(c) >= S) & (F.ascii(c) < S + 11172), made).otherwise(c)

    return F.when(text.rlike(r"[\x{AC00}-\x{D7A3}]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def hangul_compose(text: Column) -> Column:
    """Jamo to syllables: NFC on texts that hold jamo."""
    jamo = CharSet([(0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0xAC00, 0xD7A3)])
    return F.when(text.rlike(r"[\x{1161}-\x{11C2}]"), normalize_where(text, "NFC", jamo)).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Without non-spacing marks after decomposition; what is left is decomposed."""
    return F.regexp_replace(normalize(text, "NFD"), r"\p{Mn}", "")


def casefold(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x{0}-\x{7F}]"), _focused(text, r"[^\x{0}-\x{7F}]", str.casefold)).otherwise(F.lower(text))


def simple_lower(text: Column) -> Column:
    """One character to one character."""
    return _focused(text, r"[^\x{0}-\x{40}\x{5B}-\x{7F}]|[A-Z]", lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t))


def title(text: Column) -> Column:
    return _focused(text, r"(?s).", str.title)
