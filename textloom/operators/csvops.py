"""CSV texts: parse, cut, search, standardize, convert. Records keep their raw text, as a header is a record like others.

A text with CSV in it is cut into records by one regex, in its row; large files go through ``sources.files.read_csv``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.search import found_in
from textloom.plans import regex

NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[Ee][-+][0-9]+)?"


def _field(sep: str, quote: str) -> str:
    s, q = (f"\\x{{{ord(x):X}}}" for x in (sep, quote))
    return f"(?:[^{s}{q}\\n\\r]|\\r(?!\\n|$)|{q}(?:[^{q}]|{q}{q})*{q})*"


def records(text: Column, sep: str = ",", quote: str = '"') -> Column:
    """The records of a text, without their ends (LF or CRLF outside quotes)."""
    q = f"\\x{{{ord(quote):X}}}"
    found = F.regexp_extract_all(text, F.lit(f"(?:[^{q}\\n]|{q}(?:[^{q}]|{q}{q})*{q})*(?:\\n|$)"), F.lit(0))
    kept = F.filter(found, lambda r: r != "")
    return F.transform(kept, lambda r: F.regexp_replace(r, "\\r?\\n$", ""))


def raw_fields(record: Column, sep: str = ",", quote: str = '"') -> Column:
    """The fields of a record as they stand, quotes included."""
    s = f"\\x{{{ord(sep):X}}}"
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(f"{s}({_field(sep, quote)})"), F.lit(1))
    return found


def value(field: Column, quote: str = '"') -> Column:
    """A field without its quotes, doubled ones undone."""
    quoted = field.startswith(quote) & field.endswith(quote) & (F.char_length(field) >= 2)
    return F.when(quoted, F.replace(F.substring(field, F.lit(2), F.char_length(field) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(field)


def fields(record: Column, sep: str = ",", quote: str = '"') -> Column:
    return F.transform(raw_fields(record, sep, quote), lambda f: value(f, quote))


def parse(df: DataFrame, text: str = "text", sep: str = ",", quote: str = '"') -> DataFrame:
    """A row a record: other columns, record_no (from 0), record, fields."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, F.posexplode(records(F.col(text), sep, quote)).alias("record_no", "record"))
    return rows.withColumn("fields", fields(F.col("record"), sep, quote))


def columns_of(spec: str, header: list[str], zero: bool = False) -> list[int]:
    """Column numbers (from 0) of a selection: names, numbers, ``a-b`` ranges; each column once."""
    out: list[int] = []

    def number(x: str) -> int:
        if x in header:
            return header.index(x)
        if not x.isdigit():
            raise ValueError(f"no column {x!r}")
        n = int(x) - (not zero)
        if not 0 <= n < len(header):
            raise ValueError(f"no column {x}")
        return n

    for part in (p.strip() for p in spec.split(",")):
        if part not in header and (m := re.fullmatch(r"([^-]+)-([^-]+)", part)):
            a, b = number(m[1]), number(m[2])
            out += range(a, b + 1)
        else:
            out.append(number(part))
    return list(dict.fromkeys(out))


def header_of(df: DataFrame, text: str = "text", sep: str = ",", quote: str = '"') -> list[str]:
    """The first record's fields, of one text."""
    row = df.select(fields(F.element_at(records(F.col(text), sep, quote), 1), sep, quote).alias("h")).head()
    return list(row["h"]) if row and row["h"] else []


def cut(df: DataFrame, columns: list[int], text: str = "text", sep: str = ",", quote: str = '"') -> DataFrame:
    """Only these columns of every record, in this order; fields as they stand. A record too short gives empty fields."""
    rows = parse(df, text, sep, quote).withColumn("_raw", raw_fields(F.col("record"), sep, quote))
    picked = F.array(*(F.coalesce(F.try_element_at("_raw", F.lit(n + 1)), F.lit("")) for n in columns))
    return rows.withColumn("record", F.array_join(picked, sep)).drop("_raw", "fields")


def _standard(v: Column) -> Column:
    return F.when(v.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def standardize(text: Column, sep: str = ",", quote: str = '"') -> Column:
    """With comma, double quotes and LF; fields that need quotes have them."""
    made = F.transform(records(text, sep, quote), lambda r: F.array_join(F.transform(fields(r, sep, quote), _standard), ","))
    return F.concat(F.array_join(made, "\n"), F.when(F.size(made) > 0, "\n").otherwise(""))


def search(df: DataFrame, pattern: str, columns: list[int] | None = None, text: str = "text", sep: str = ",", quote: str = '"', whole: bool = False, invert: bool = False) -> DataFrame:
    """The records, header included, in which a field of the columns matches; the record is returned as it stands."""
    java = regex.translate(pattern, line=whole)
    rows = parse(df, text, sep, quote)
    chosen = F.col("fields") if columns is None else F.array(*(F.try_element_at("fields", F.lit(n + 1)) for n in columns))
    hit = F.coalesce(F.exists(chosen, lambda f: found_in(f, java)), F.lit(False))
    return rows.where(~hit if invert else hit).drop("fields")


def empty_fields(df: DataFrame, text: str = "text", sep: str = ",", quote: str = '"') -> DataFrame:
    """(..., record_no, field_no) of empty fields."""
    rows = parse(df, text, sep, quote)
    at = F.filter(F.transform("fields", lambda f, i: F.when(f == "", i)), lambda i: i.isNotNull())
    return rows.select(*[c for c in rows.columns if c != "fields"], F.explode(at).alias("field_no"))


def json_string(v: Column) -> Column:
    """A JSON string literal."""
    made = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        made = F.replace(made, F.lit(c), F.lit(e))
    control = r"[\x{0}-\x{1F}]"
    chars = F.transform(F.split(made, ""), lambda c: F.when(c.rlike(control), F.format_string("\\u%04X", F.ascii(c))).otherwise(c))
    return F.concat(F.lit('"'), F.when(made.rlike(control), F.array_join(chars, "")).otherwise(made), F.lit('"'))


def json_value(v: Column) -> Column:
    """A field as JSON: numbers (an exponent has a sign), true, false and null as they are, others as strings."""
    return F.when(v.rlike(f"^(?:{NUMBER}|true|false|null)$"), v).otherwise(json_string(v))


def to_json(text: Column, sep: str = ",", quote: str = '"') -> Column:
    """An array of objects, keys from the first record; fields beyond the header are left out, missing ones empty strings."""
    found = F.transform(records(text, sep, quote), lambda r: fields(r, sep, quote))
    head = F.element_at(found, 1)

    def one(row: Column) -> Column:
        pairs = F.transform(head, lambda k, i: F.concat(json_string(k), F.lit(":"), json_value(F.coalesce(F.get(row, i), F.lit("")))))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    return F.when(F.size(found) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.slice(found, F.lit(2), F.size(found) - 1), one), ","), F.lit("]")))
