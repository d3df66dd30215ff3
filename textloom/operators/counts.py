"""Counts of texts: lines, words, characters, bytes, characters of a set. One pass, no shuffle but for totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.plans import regex


def line_breaks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(text, F.lit(r"[^\p{IsWhite_Space}]+")).cast("long")


def wc(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines (line feeds), words, characters and bytes of each row."""
    t = F.col(text)
    return df.select(
        *[c for c in df.columns if c != text], F.coalesce(line_breaks(t), F.lit(0)).alias("lines"), F.coalesce(words(t), F.lit(0)).alias("words"),
        F.coalesce(F.char_length(t), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("bytes"),
    )


def with_total(counts: DataFrame, key: str) -> DataFrame:
    """The rows and one of their sums, whose key is null."""
    sums = [c for c in counts.columns if c != key]
    return counts.unionByName(counts.agg(*(F.sum(c).alias(c) for c in sums)).withColumn(key, F.lit(None).cast(counts.schema[key].dataType)))


def count_set(text: Column, char_class: str) -> Column:
    """Characters of a set expression."""
    return F.coalesce(F.regexp_count(text, F.lit(regex.translate(char_class))), F.lit(0)).cast("long")


def property_table(df: DataFrame, classes: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """Characters of several sets by key: one aggregation."""
    return df.groupBy(key).agg(*(F.sum(count_set(F.col(text), c)).alias(name) for name, c in classes.items()))


def word_table(df: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """Words that occur at least ``least`` times, with their length group and count."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"[^\p{IsWhite_Space}]+"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("length", F.octet_length("word").cast("long"))
