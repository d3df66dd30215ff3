"""Records of texts: lines, their numbers, spans and edges.

Lines stay inside their row until they are needed as rows, so splitting, numbering and limiting take no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textloom.functions.batches import sliced

BREAKS = {"unix": "\n", "unicode": r"\R", "null": "\x00"}


def line_array(text: Column | str, mode: str = "unix") -> Column:
    """The lines of a text; a final break ends the last line and starts none. Null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, BREAKS[mode], -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(df: DataFrame, text: str = "text", mode: str = "unix") -> DataFrame:
    """A row a line: the other columns, ``line_no`` (from 1) and ``line``."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(line_array(text, mode)).alias("_at", "line")).select(*rest, (F.col("_at") + 1).cast("long").alias("line_no"), "line")


def with_spans(rows: DataFrame, key: str = "doc_id", break_length: int = 1) -> DataFrame:
    """``line_start`` and ``line_end`` (code points, half open) of each line; needs single-character breaks."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("line") + break_length).over(before), F.lit(0)).cast("long")
    return rows.withColumn("line_start", start).withColumn("line_end", F.col("line_start") + F.char_length("line"))


def _sums(part: pa.Array) -> pa.Array:
    ends = part.offsets.to_numpy()
    total = np.zeros(ends[-1] - ends[0] + 1, np.int64)
    np.cumsum(part.values.to_numpy()[ends[0] : ends[-1]], dtype=np.int64, out=total[1:])
    ends = ends - ends[0]
    made = total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made), mask=part.is_null())


def running_sums(sizes: Column) -> Column:
    """Running sums of each row's array, linear in its length: an ``aggregate`` that grows an array copies it at each step."""
    return sliced(T.ArrayType(T.LongType()), lambda: _sums)(sizes)


def spans_of(df: DataFrame, text: str = "text") -> DataFrame:
    """Start and end of each line within its row: no shuffle. (columns, line_no, line_start, line_end)"""
    rest = [c for c in df.columns if c != text]
    sizes = F.transform(line_array(text), lambda line: F.char_length(line) + 1)
    made = F.zip_with(running_sums(sizes), sizes, lambda e, n: F.struct((e - n).alias("s"), (e - 1).alias("e")))
    return df.select(*rest, F.posexplode(made).alias("_at", "span")).select(*rest, (F.col("_at") + 1).cast("long").alias("line_no"), F.col("span.s").alias("line_start"), F.col("span.e").alias("line_end"))


def keep_lines(rows: DataFrame, numbers: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines whose (key, line_no) is in ``numbers``: a semi-join."""
    return rows.join(numbers.select(key, "line_no"), [key, "line_no"], "left_semi")


def matched_text(df: DataFrame, condition, text: str = "text") -> DataFrame:
    """Only the matching lines of each text, each with its break; ``condition`` takes a line column."""
    kept = F.filter(line_array(text), condition)
    return df.withColumn(text, F.concat(F.array_join(kept, "\n"), F.when(F.size(kept) > 0, "\n").otherwise("")))


def reorder_fields(df: DataFrame, order: list[str]) -> DataFrame:
    """Fields of each record in a given order."""
    return df.select(*order)
