"""Approximate matching: where a pattern ends in a text within some edits."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window, functions as F, types as T

from textloom.functions.batches import by_value

_HITS = T.ArrayType(T.StructType([T.StructField("pattern_no", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("distance", T.IntegerType())]))


def ends_within(text: str, pattern: str, k: int) -> list[tuple[int, int]]:
    """(end, distance) of each position at which a segment ends that is within k edits of the pattern: bit-parallel
    dynamic programming, one machine step a character (Myers, 1999)."""
    m = len(pattern)
    if not m:
        return []
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= k:
            out.append((j, score))
    return out


def approximate_matches(df: DataFrame, patterns: list[str], k: int = 2, text: str = "text", drop_breaks: bool = True) -> DataFrame:
    """(other columns, pattern_no, end, distance): ends counted from 0 in the text without line breaks."""
    run = by_value(_HITS, lambda t: [{"pattern_no": n, "end": e, "distance": d} for n, p in enumerate(patterns) for e, d in ends_within(t, p, k)])
    source = F.regexp_replace(text, "[\r\n]", "") if drop_breaks else F.col(text)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(run(source)).alias("hit")).select(*rest, "hit.*")


def dense_windows(hits: DataFrame, key: str, width: int, least: int) -> DataFrame:
    """The second filter: distinct ends, and those with at least ``least`` of them in the ``width`` positions up to each."""
    ends = hits.select(key, "end").distinct()
    w = Window.partitionBy(key).orderBy("end").rangeBetween(-(width - 1), 0)
    return ends.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)


def by_prefix(patterns: DataFrame, length: int) -> DataFrame:
    """Patterns grouped by a common prefix."""
    return patterns.groupBy(F.substring("pattern", 1, length).alias("prefix")).agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))


def near_patterns(df: DataFrame, column: str, patterns: list[str], k: int) -> DataFrame:
    """Whole values within k edits of a stated list of patterns, each with its distance; values meet the list inside their row."""
    tried = F.array(*(F.struct(F.lit(p).alias("pattern"), F.levenshtein(F.col(column), F.lit(p), k).alias("distance")) for p in patterns))
    return df.select("*", F.explode(F.filter(tried, lambda x: x["distance"] >= 0)).alias("hit")).select(*df.columns, "hit.pattern", "hit.distance")
