"""Markup: tags, references, comments, well-formedness."""

from __future__ import annotations

from xml.parsers import expat

from pyspark.sql import Column, functions as F, types as T

from textloom.functions.batches import sliced

_TAG = r"<(/?[A-Za-z_:][^\s/>]*)"
_REF = r"&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z_:][\w:.-]*);"


def without(text: Column, comments: bool = True, instructions: bool = True, cdata: bool = False) -> Column:
    """Without comments, processing instructions and (on request) CDATA sections."""
    for wanted, pattern in ((comments, "(?s)<!--.*?-->"), (instructions, r"(?s)<\?.*?\?>"), (cdata, r"(?s)<!\[CDATA\[.*?\]\]>")):
        text = F.regexp_replace(text, pattern, "") if wanted else text
    return text


def tags(text: Column) -> Column:
    """Names of start and end tags (with a slash) in order."""
    return F.regexp_extract_all(text, F.lit(_TAG), F.lit(1))


def attributes(text: Column) -> Column:
    """Names of attributes in order."""
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<[A-Za-z_:][^\s/>]*(\s[^>]*)>"), F.lit(1)), " ")
    return F.regexp_extract_all(inside, F.lit("""([A-Za-z_:][\\w:.-]*)\\s*=\\s*(?:"[^"]*"|'[^']*'|[^\\s"'>]+)"""), F.lit(1))


def references(text: Column) -> Column:
    """Entity, decimal and hex references, without their marks."""
    return F.regexp_extract_all(text, F.lit(_REF), F.lit(1))


def comments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)<!--(.*?)-->"), F.lit(1))


_CHECKED = T.StructType([T.StructField("well_formed", T.BooleanType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("message", T.StringType())])


def _check(t: str | None) -> dict:
    if t is None:
        return {}
    parser = expat.ParserCreate()
    try:
        parser.Parse(t.encode("utf-8", "surrogatepass"), True)
        return {"well_formed": True}
    except expat.ExpatError as e:
        return {"well_formed": False, "line": e.lineno, "column": e.offset, "message": expat.ErrorString(e.code)}


def check(text: Column) -> Column:
    """Whether a document is well formed (tags match, names, references, attributes, declaration), and the first error's place."""
    return sliced(_CHECKED, lambda: lambda part: [_check(t) for t in part.to_pylist()])(text)
