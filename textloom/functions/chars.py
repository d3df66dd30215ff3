"""Characters and bytes of a column: filters, mappings, notations, encodings. JVM expressions unless said otherwise."""

from __future__ import annotations

import codecs
import unicodedata

from pyspark.sql import Column, functions as F, types as T

from textloom.functions import normalize as _n
from textloom.functions.batches import by_value
from textloom.plans import regex


def keep(text: Column, char_class: str) -> Column:
    """Only the characters of a set expression."""
    return F.regexp_replace(text, F.lit(regex.negated(regex.translate(char_class))), F.lit(""))


def translate(text: Column, source: str, target: str) -> Column:
    """Source characters to target characters; those beyond the target's length become its last character."""
    if not target:
        raise ValueError("an empty target")
    first = "".join(dict.fromkeys(source))
    to = "".join(target[min(source.index(c), len(target) - 1)] for c in first)
    return F.translate(text, first, to)


def map_property(text: Column, prop: str) -> Column:
    """Mapping by a code point or string property: lower, upper, title case, folding, their simple forms."""
    key = prop.lower()
    known = {"lc": F.lower, "uc": F.upper, "tc": _n.title, "cf": _n.casefold, "slc": _n.simple_lower}
    if key in known:
        return known[key](text)
    simple = {"suc": str.upper, "stc": str.title, "scf": str.casefold}
    if key not in simple:
        raise ValueError(f"unsupported property {prop}")
    f = simple[key]
    return _n._focused(text, r"(?s).", lambda t: "".join(f(c) if len(f(c)) == 1 else c for c in t))


def codepoints(text: Column) -> Column:
    """UTF-8 decoded: an array of code points."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), F.ascii))


def from_codepoints(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p.cast("long")), 8, "0")), "UTF-32")), "")


def char_starts(text: Column) -> Column:
    """Byte offsets at which characters start."""
    sizes = F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), F.octet_length)
    zero = F.expr("named_struct('at', 0, 'made', CAST(array() AS array<int>))")
    return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["made"], F.array(acc["at"])).alias("made")), lambda acc: acc["made"])


def hex_lines(text: Column, lower: bool = False) -> Column:
    """Each line in hex, line feeds as they are."""
    made = F.array_join(F.transform(F.split(text, "\n", -1), F.hex), "\n")
    return F.lower(made) if lower else made


def base64(text: Column) -> Column:
    """Without line breaks, whatever the session's setting for them."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n]", "")


_NOTATION = {"unicode": ("U+%04X", None), "java": ("\\u%04x", "\\u%04x\\u%04x"), "c": ("\\u%04x", "\\U%08x"), "xml": ("&#x%X;", None), "perl": ("\\x{%X}", None), "decimal": ("&#%d;", None)}


def escape(text: Column, notation: str) -> Column:
    """Every character in a notation: unicode, java, c, xml, perl or decimal."""
    bmp, beyond = _NOTATION[notation]

    def one(c: Column) -> Column:
        p = F.ascii(c)
        plain = F.format_string(bmp, p)
        if notation == "java":
            return F.when(p > 0xFFFF, F.format_string(beyond, F.shiftright(p - 0x10000, 10) + 0xD800, F.pmod(p - 0x10000, F.lit(1024)) + 0xDC00)).otherwise(plain)
        return F.when(p > 0xFFFF, F.format_string(beyond, p)).otherwise(plain) if beyond else plain

    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def unescape(text: Column) -> Column:
    """All those notations decoded."""
    import re

    found = re.compile(r"U\+([0-9A-Fa-f]{4,6})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|&#x([0-9A-Fa-f]+);|\\x\{([0-9A-Fa-f]+)\}|&#(\d+);")

    def change(t: str) -> str:
        made = found.sub(lambda m: chr(int(m[6])) if m[6] else chr(int(next(x for x in m.groups()[:5] if x), 16)), t)
        return made.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return _n._focused(text, r"[U\\&]", change)


def to_hex(data: Column) -> Column:
    return F.hex(data)


def from_hex(text: Column) -> Column:
    return F.unhex(text)


# -- encodings


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def repair(data: Column, errors: str = "replace") -> Column:
    """Bytes as text: ill-formed parts are replaced, dropped, or make an error."""
    if errors == "replace":
        return F.make_valid_utf8(data)
    if errors == "abort":
        return F.validate_utf8(data)
    if errors != "drop":
        raise ValueError(errors)

    drop = by_value(T.StringType(), lambda b: b.decode("utf-8", "ignore"))
    binary = data.cast("binary")
    return F.when(F.is_valid_utf8(data), F.decode(binary, "UTF-8")).otherwise(drop(F.when(~F.is_valid_utf8(data), binary)))


_ERRORS = T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def _errors(raw: bytes) -> list[dict]:
    out: list[dict] = []
    found = lambda e: (out.append({"offset": e.start, "length": e.end - e.start}) or "", e.end)
    codecs.register_error("textloom-errors", found)
    raw.decode("utf-8", "textloom-errors")
    return out


def utf8_errors(data: Column) -> Column:
    """Offset and length of each maximal ill-formed part."""
    return by_value(_ERRORS, _errors)(data.cast("binary"))


def first_utf8_error(data: Column) -> Column:
    """Its offset, or -1."""
    return F.when(F.is_valid_utf8(data), -1).otherwise(F.coalesce(F.try_element_at(utf8_errors(F.when(~F.is_valid_utf8(data), data)), F.lit(1))["offset"], F.lit(-1)))


def to_utf16(text: Column, order: str = "BE") -> Column:
    return F.encode(text, f"UTF-16{order}")


def from_utf32(data: Column) -> Column:
    return F.decode(data, "UTF-32")


def transcode(data: Column, source: str, target: str = "UTF-8", errors: str = "replace") -> Column:
    """Bytes from any encoding to any; ``errors``: replace, drop or abort. Vectorized Python, as Spark refuses most charsets by default."""
    codecs.lookup(source), codecs.lookup(target)
    mode = {"replace": "replace", "drop": "ignore", "abort": "strict"}[errors]

    return by_value(T.BinaryType(), lambda b: b.decode(source, mode).encode(target, mode))(data.cast("binary"))


def gb18030_to_utf8(data: Column, errors: str = "replace") -> Column:
    return transcode(data, "gb18030", "utf-8", errors)


def iso8859_5_to_utf16(data: Column) -> Column:
    return transcode(data, "iso8859-5", "utf-16-be")


def symbol_hash(text: Column) -> Column:
    return F.xxhash64(text)


def category_codes(text: Column) -> Column:
    """The general category of each character."""
    return by_value(T.ArrayType(T.StringType()), lambda t: [unicodedata.category(c) for c in t])(text)
