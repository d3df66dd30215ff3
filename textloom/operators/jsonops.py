"""JSON texts: validation with depth, error places, conversion to CSV."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.batches import sliced

MAX_DEPTH = 15
#: Unlike the number form of CSV fields, an exponent needs no sign.
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[Ee][-+]?[0-9]+)?"
_STRINGS = r'"(?:[^"\\]|\\.)*"'


def depth(text: Column) -> Column:
    """The deepest nesting of brackets outside strings; the brackets are walked in their row."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, f"(?s){_STRINGS}", ""), r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def add(acc, c):
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, add, lambda acc: acc["most"])


def _parses(text: Column) -> Column:
    """Whether a text is one JSON value. The parser stops after the first value, so the text is set into two arrays: a second value of
    its own or a bracket too many shows in one of them."""
    before, after = (F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))) for a, b in (("[", ",0]"), ("[0,", "]")))
    one = (F.try_variant_get(before, "$[1]", "int") == 0) & after.isNotNull() & F.try_variant_get(after, "$[2]", "string").isNull()
    return F.coalesce(one, F.lit(False))


def is_valid(text: Column, max_depth: int | None = MAX_DEPTH) -> Column:
    """Well-formed JSON without the noncharacters U+FFFE and U+FFFF, no deeper than ``max_depth``."""
    ok = _parses(text) & ~text.rlike(r"[\x{FFFE}\x{FFFF}]")
    ok = ok if max_depth is None else ok & (depth(text) <= max_depth)
    return F.when(text.isNotNull(), F.coalesce(ok, F.lit(False)))


_PLACE = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("message", T.StringType())])


def _place(t: str | None) -> dict:
    try:
        json.loads(t if t is not None else "null")
        return {}
    except json.JSONDecodeError as e:
        return {"line": e.lineno, "column": e.colno, "message": e.msg}
    except RecursionError:
        return {"line": 1, "column": 1, "message": "too deep"}


def first_error(text: Column) -> Column:
    """Line, column and message of the first error; nulls if there is none. Only rows that fail reach Python."""
    return sliced(_PLACE, lambda: lambda part: [_place(t) for t in part.to_pylist()])(F.when(~_parses(text), text))


def rows_of(df: DataFrame, text: str = "text") -> DataFrame:
    """The objects of texts that are arrays of flat objects with string values: other columns, row_no, fields (a map)."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.from_json(text, "array<map<string,string>>")).alias("row_no", "fields"))


def to_csv(text: Column, keys: list[str] | None = None) -> Column:
    """An array of flat objects as CSV: columns in sorted order of keys, missing values empty, values as they are."""
    rows = F.from_json(text, "array<map<string,string>>")
    names = F.array(*map(F.lit, keys)) if keys is not None else F.array_sort(F.array_distinct(F.flatten(F.transform(rows, F.map_keys))))
    head = F.array_join(names, ",")
    body = F.transform(rows, lambda m: F.array_join(F.transform(names, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(""))), ","))
    return F.concat(F.array_join(F.concat(F.array(head), body), "\n"), F.lit("\n"))


def escape(text: Column) -> Column:
    from textloom.operators.csvops import json_string

    return json_string(text)


def kind(text: Column) -> Column:
    """null, true, false, number or string (object, array, or invalid beyond the flat kinds)."""
    t = F.trim(text)
    return (
        F.when(t == "null", "null").when(t == "true", "true").when(t == "false", "false").when(t.rlike(f"^{_NUMBER}$"), "number")
        .when(t.rlike(f"(?s)^{_STRINGS}$"), "string").when(t.startswith("{"), "object").when(t.startswith("["), "array").otherwise("invalid")
    )
