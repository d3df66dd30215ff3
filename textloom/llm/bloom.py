"""A blocked Bloom filter in front of a join: rows that can't find a partner aren't moved.

The keys of the smaller side become a table of 256-bit blocks that is broadcast; every row of the larger side looks up one block. No
row that has a partner is lost; one in some thousands that has none goes on to the exact join, which drops it.

Scale: a filter has at most ``MOST_BLOCKS`` blocks (8 MB of bits). Beyond some 2.8 million keys it lets more rows pass, and in the end
all of them, as if it weren't there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import Scratch
from textloom.llm.urlfilter import BITS_PER_URL as BITS_PER_KEY, _bits

MOST_BLOCKS = 1 << 18
_NAMES = ["_bloom_block", *(f"_bloom_{k}" for k in range(4))]


def tested(rows: DataFrame, key: Column, keys: DataFrame, scratch: Scratch, most: int = MOST_BLOCKS) -> DataFrame:
    """``rows`` with a column ``_possible``: true wherever ``key`` is in the first column of ``keys``, which is a written table."""
    blocks = min(max(1, -(-keys.count() * BITS_PER_KEY // 256)), most)
    bits = lambda of: [c.alias(n) for c, n in zip(_bits(of, blocks), _NAMES, strict=True)]
    table = keys.select(*bits(F.col(keys.columns[0]))).groupBy(_NAMES[0]).agg(*(F.bit_or(n).alias(f"{n}_all") for n in _NAMES[1:]))
    table = scratch.keep(table, "bloom")
    held = [F.coalesce(F.col(f"{n}_all").bitwiseAND(F.col(n)) == F.col(n), F.lit(False)) for n in _NAMES[1:]]
    found = rows.select("*", *bits(key)).join(F.broadcast(table), _NAMES[0], "left").withColumn("_possible", reduce(Column.__and__, held))
    return found.drop(*_NAMES, *(f"{n}_all" for n in _NAMES[1:]))


def possible(rows: DataFrame, key: Column, keys: DataFrame, scratch: Scratch, most: int = MOST_BLOCKS) -> DataFrame:
    """The rows whose ``key`` may be in ``keys``."""
    return tested(rows, key, keys, scratch, most).where("_possible").drop("_possible")


def split(rows: DataFrame, key: Column, keys: DataFrame, scratch: Scratch, most: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in ``keys``, and the others."""
    both = tested(rows, key, keys, scratch, most)
    return both.where("_possible").drop("_possible"), both.where("NOT _possible").drop("_possible")
