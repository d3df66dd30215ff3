"""Operators on positions: bit streams as boolean columns, integer streams as integer columns, one row a position.

All are window functions within one text, ordered by position; nothing is windowed over all rows. The streams of the
reference are endless with zeros outside, so shifts fill with zero (false), and markers that run past the end are lost
unless the table has an end-of-text row (``positions(..., eof=True)``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY, POS = "item_id", "pos"


def positions(df: DataFrame, text: str = "text", key: str = KEY, eof: bool = False) -> DataFrame:
    """(key, pos, ch, cp): a row a code point, and with ``eof`` one more with nulls."""
    chars = F.split(F.col(text), "")
    chars = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(chars)
    if eof:
        chars = F.concat(chars, F.array(F.lit(None).cast("string")))
    return df.select(key, F.posexplode(chars).alias(POS, "ch")).withColumn("cp", F.ascii("ch"))


def _order(key: str = KEY):
    return Window.partitionBy(key).orderBy(POS)


def _to_here(key: str = KEY):
    return _order(key).rowsBetween(Window.unboundedPreceding, 0)


def _before(key: str = KEY):
    return _order(key).rowsBetween(Window.unboundedPreceding, -1)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bit(x: Column) -> Column:
    return F.when(x, 1).otherwise(0)


# -- shifts


def advance(x: Column | str, n: int = 1, key: str = KEY) -> Column:
    """A mark n positions later."""
    return F.lag(_c(x), n, False).over(_order(key))


def lookahead(x: Column | str, n: int = 1, key: str = KEY) -> Column:
    return F.lead(_c(x), n, False).over(_order(key))


def shift_number(x: Column | str, n: int, key: str = KEY) -> Column:
    """Integers shifted forward (n > 0) or back; zeros come in."""
    return F.lag(_c(x), n, 0).over(_order(key)) if n >= 0 else F.lead(_c(x), -n, 0).over(_order(key))


def indexed_advance(df: DataFrame, x: str, index: str, out: str, n: int = 1, key: str = KEY) -> DataFrame:
    """Marks at positions of the index stream move to the n-th following index position.

    Index positions are numbered by a running count; the window over them alone orders by that number.
    """
    at = F.when(F.col(index), F.sum(_bit(F.col(index))).over(_to_here(key)))
    w = Window.partitionBy(key, F.col("_index").isNull()).orderBy("_index", POS)
    return df.withColumn("_index", at).withColumn(out, F.when(F.col("_index").isNotNull(), F.lag(F.col(x), n, False).over(w)).otherwise(False)).drop("_index")


def indexed_shift_back(df: DataFrame, x: str, index: str, out: str, n: int = 1, key: str = KEY) -> DataFrame:
    """Marks at index positions move to the n-th preceding one."""
    at = F.when(F.col(index), F.sum(_bit(F.col(index))).over(_to_here(key)))
    w = Window.partitionBy(key, F.col("_index").isNull()).orderBy("_index", POS)
    return df.withColumn("_index", at).withColumn(out, F.when(F.col("_index").isNotNull(), F.lead(F.col(x), n, False).over(w)).otherwise(False)).drop("_index")


# -- scans


def match_star(df: DataFrame, m: str, c: str, out: str, key: str = KEY) -> DataFrame:
    """All positions reachable from marks ``m`` through the class ``c``, the position after a run included."""
    islands = df.withColumn("_island", F.coalesce(F.sum(_bit(~F.col(c))).over(_before(key)), F.lit(0)))
    w = Window.partitionBy(key, "_island").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(out, F.max(F.col(m)).over(w)).drop("_island")


def scan_thru(df: DataFrame, m: str, c: str, out: str, key: str = KEY) -> DataFrame:
    """Each mark moves to the first position not in ``c`` at or after it."""
    return match_star(df, m, c, out, key).withColumn(out, F.col(out) & ~F.col(c))


def scan_to(df: DataFrame, m: str, c: str, out: str, key: str = KEY) -> DataFrame:
    """Each mark moves to the first position in ``c`` at or after it."""
    return scan_thru(df.withColumn("_not", ~F.col(c)), m, "_not", out, key).drop("_not")


def advance_then_scan_thru(df: DataFrame, m: str, c: str, out: str, key: str = KEY) -> DataFrame:
    return scan_thru(df.withColumn("_moved", advance(m, 1, key)), "_moved", c, out, key).drop("_moved")


def advance_then_scan_to(df: DataFrame, m: str, c: str, out: str, key: str = KEY) -> DataFrame:
    return scan_to(df.withColumn("_moved", advance(m, 1, key)), "_moved", c, out, key).drop("_moved")


def every_nth(x: Column | str, n: int, key: str = KEY) -> Column:
    """The 1st, n+1-th, ... set position."""
    return _c(x) & (F.sum(_bit(_c(x))).over(_to_here(key)) % n == 1 % n)


# -- spans and runs


def _depth(starts: Column, ends: Column, key: str) -> Column:
    return F.sum(_bit(starts) - _bit(ends)).over(_to_here(key))


def span_up_to(starts: str, ends: str, key: str = KEY) -> Column:
    """From each start up to, not with, its end."""
    return _depth(_c(starts), _c(ends), key) > 0


def inclusive_span(starts: str, ends: str, key: str = KEY) -> Column:
    """From each start to its end, both included."""
    return span_up_to(starts, ends, key) | _c(ends)


def exclusive_span(starts: str, ends: str, key: str = KEY) -> Column:
    """Strictly between starts and ends."""
    return span_up_to(starts, ends, key) & ~_c(starts)


def run_index(df: DataFrame, x: str, out: str, key: str = KEY, bits: int | None = None) -> DataFrame:
    """Position of each set bit within its run, from 0; zero elsewhere. With ``bits`` the index wraps and ``<out>_overflow`` marks it."""
    runs = df.withColumn("_run", F.sum(_bit(~F.col(x))).over(_to_here(key)))
    w = Window.partitionBy(key, "_run", F.col(x)).orderBy(POS)
    made = runs.withColumn(out, F.when(F.col(x), F.row_number().over(w) - 1).otherwise(0)).drop("_run")
    if bits is None:
        return made
    return made.withColumn(f"{out}_overflow", F.col(out) >= (1 << bits)).withColumn(out, F.col(out) % (1 << bits))


def fill_run_gaps(df: DataFrame, x: str, out: str, gap: int, key: str = KEY) -> DataFrame:
    """Gaps of at most ``gap`` positions between two runs are closed."""
    last = F.max(F.when(F.col(x), F.col(POS))).over(_to_here(key))
    next_ = F.min(F.when(F.col(x), F.col(POS))).over(_order(key).rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.col(x) | F.coalesce(next_ - last - 1 <= gap, F.lit(False)))


def nesting_depth(df: DataFrame, left: str, right: str, max_depth: int | None = None, key: str = KEY) -> DataFrame:
    """``depth`` (a closing bracket has the depth it closes) and ``nest_error``: an unmatched right bracket, a level beyond
    ``max_depth``, or, at the last position, brackets left open."""
    depth = F.sum(_bit(F.col(left))).over(_to_here(key)) - F.coalesce(F.sum(_bit(F.col(right))).over(_before(key)), F.lit(0))
    out = df.withColumn("depth", depth)
    open_ = F.col("depth") - _bit(F.col(right))
    bad = F.col(right) & (F.col("depth") <= 0)
    if max_depth is not None:
        bad = bad | (F.col("depth") > max_depth)
    return out.withColumn("nest_error", bad | (F.lead(POS).over(_order(key)).isNull() & (open_ > 0)))


def context_span(x: Column | str, before: int, after: int, key: str = KEY, order: str = POS) -> Column:
    """Marked positions and ``before`` ahead of and ``after`` behind them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-after, before)
    return F.max(_c(x)).over(w)


def matched_records(df: DataFrame, x: str, record: str, key: str = KEY) -> DataFrame:
    """Records (key, record) that hold a mark."""
    return df.groupBy(key, record).agg(F.max(F.col(x)).alias("matched")).where("matched")


def longest_matches(spans: DataFrame, key: str = KEY) -> DataFrame:
    """Of spans (key, start, end) the longest at each start, without those that lie inside an earlier one."""
    best = spans.groupBy(key, "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_reach", F.max("end").over(w)).where("_reach IS NULL OR end > _reach").drop("_reach")


def cover(df: DataFrame, starts: str, length: str, out: str, key: str = KEY) -> DataFrame:
    """Positions inside spans given by start marks and lengths."""
    reach = F.max(F.when(F.col(starts), F.col(POS) + F.col(length))).over(_to_here(key))
    return df.withColumn(out, F.coalesce(F.col(POS) < reach, F.lit(False)))


def transitions(x: Column | str, key: str = KEY) -> Column:
    """Positions where a value differs from the one before; the first is none."""
    return F.coalesce(_c(x) != F.lag(_c(x)).over(_order(key)), F.lit(False))


def equals_prior(x: Column | str, distance: int = 2, key: str = KEY) -> Column:
    """Whether the value equals the one ``distance`` before; zeros stand before the start."""
    return _c(x) == F.lag(_c(x), distance, 0).over(_order(key))


def line_starts(breaks: Column | str, key: str = KEY) -> Column:
    """The first position of each record."""
    return F.lag(_c(breaks), 1, True).over(_order(key))


def line_numbers(breaks: Column | str, key: str = KEY) -> Column:
    """Number (from 1) of the line a position is in; the break belongs to the line it ends."""
    return (F.coalesce(F.sum(_bit(_c(breaks))).over(_before(key)), F.lit(0)) + 1).cast("long")


def marked(df: DataFrame, x: str) -> DataFrame:
    """The marked positions as rows."""
    return df.where(F.col(x))


# -- filters, insertions, merges


def filter_by_mask(df: DataFrame, mask: str, key: str = KEY) -> DataFrame:
    """Positions with the mask, numbered anew."""
    return df.where(F.col(mask)).withColumn(POS, (F.row_number().over(_order(key)) - 1).cast("int"))


def spread_by_mask(spine: DataFrame, mask: str, items: DataFrame, value: str, key: str = KEY) -> DataFrame:
    """The n-th item lands on the n-th position with the mask; zero elsewhere."""
    numbered = spine.withColumn("_n", F.when(F.col(mask), F.sum(_bit(F.col(mask))).over(_to_here(key)) - 1))
    source = items.select(key, F.col(POS).cast("long").alias("_n"), F.col(value).alias(value))
    return numbered.join(source, [key, "_n"], "left").withColumn(value, F.coalesce(value, F.lit(0))).drop("_n")


def combined_mask(df: DataFrame, outer: str, inner: str, out: str, key: str = KEY) -> DataFrame:
    """One mask that filters as two filters in a row: ``inner`` belongs to the positions that ``outer`` keeps."""
    return df.withColumn(out, F.col(outer) & F.col(inner))


def zero_by_mask(x: Column | str, mask: Column | str) -> Column:
    return F.when(_c(mask), _c(x)).otherwise(0)


def insertion_mask(df: DataFrame, count: str, before: bool = True, key: str = KEY) -> DataFrame:
    """Each position with ``count`` gap positions before (or after) it: (..., is_gap), numbered anew."""
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(count))))
    w = Window.partitionBy(key).orderBy(POS, "_k")
    gap = F.col("_k") < F.col(count) if before else F.col("_k") > 0
    return copies.withColumn("is_gap", gap).withColumn(POS, (F.row_number().over(w) - 1).cast("int")).drop("_k")


def merge_by_mask(spine: DataFrame, mask: str, a: DataFrame, b: DataFrame, value: str, key: str = KEY) -> DataFrame:
    """Positions with the mask take the next item of ``a``, the others the next of ``b``."""
    side = Window.partitionBy(key, F.col(mask)).orderBy(POS)
    numbered = spine.withColumn("_n", (F.row_number().over(side) - 1).cast("int"))
    items = a.select(key, F.lit(True).alias("_m"), F.col(POS).alias("_n"), value).unionByName(b.select(key, F.lit(False).alias("_m"), F.col(POS).alias("_n"), value))
    return numbered.withColumn("_m", F.col(mask)).join(items, [key, "_m", "_n"], "left").drop("_m", "_n")


def swap_back(df: DataFrame, x: str, mark: str, out: str, n: int = 1, key: str = KEY) -> DataFrame:
    """Each marked item changes places with the one ``n`` before it."""
    w = _order(key)
    return df.withColumn(out, F.when(F.lead(F.col(mark), n, False).over(w), F.lead(F.col(x), n).over(w)).when(F.col(mark), F.lag(F.col(x), n).over(w)).otherwise(F.col(x)))


def sort_runs(df: DataFrame, run: str, sort_key: str, key: str = KEY) -> DataFrame:
    """Inside each run of marked positions the rows are sorted by a key, ties by position; ``pos`` is the new place."""
    islands = df.withColumn("_run", F.sum(_bit(~F.col(run))).over(_to_here(key)))
    first = F.min(POS).over(Window.partitionBy(key, "_run", run))
    place = F.row_number().over(Window.partitionBy(key, "_run", run).orderBy(sort_key, POS)) - 1
    return islands.withColumn("_new", F.when(F.col(run), first + place).otherwise(F.col(POS))).drop("_run", POS).withColumnRenamed("_new", POS)


def until_n(df: DataFrame, x: str, out: str, n: int, key: str = KEY) -> DataFrame:
    """Only the first n marks stay."""
    return df.withColumn(out, F.col(x) & (F.sum(_bit(F.col(x))).over(_to_here(key)) <= n))


def terminate_at(df: DataFrame, stop: str, key: str = KEY) -> DataFrame:
    """Positions before the first stop."""
    return df.withColumn("_stop", F.min(F.when(F.col(stop), F.col(POS))).over(Window.partitionBy(key))).where(F.col("_stop").isNull() | (F.col(POS) < F.col("_stop"))).drop("_stop")


def reverse_regions(text: Column, separator: str) -> Column:
    """Each region between separators, reversed."""
    return F.array_join(F.transform(F.split(text, separator, -1), F.reverse), separator)


def repeating(pattern: list, position: Column | str = POS) -> Column:
    """A constant cyclic stream."""
    return F.element_at(F.array(*(F.lit(x) for x in pattern)), (F.pmod(_c(position), F.lit(len(pattern))) + 1).cast("int"))


def at_eof(key: str = KEY) -> Column:
    """Marks the last position."""
    return F.lead(POS).over(_order(key)).isNull()


def add_sentinel(text: Column, marker: str = "\x00") -> Column:
    return F.concat(text, F.lit(marker))


# -- sets of streams


def union_streams(*marks: str) -> Column:
    return reduce(lambda a, b: a | b, map(F.col, marks))


def intersect_streams(*marks: str) -> Column:
    return reduce(lambda a, b: a & b, map(F.col, marks))


def union_positions(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return a.select(key, POS).union(b.select(key, POS)).distinct()


def intersect_positions(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return a.select(key, POS).intersect(b.select(key, POS))


def difference_positions(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    return a.select(key, POS).exceptAll(b.select(key, POS).distinct())


def multiplex(classes: dict[str, Column], rest: int = 0) -> Column:
    """A dense code for each class; the first that fits counts."""
    out = F.lit(rest)
    for n, test in reversed(list(enumerate(classes.values(), 1))):
        out = F.when(test, n).otherwise(out)
    return out


# -- logic on marks and bit-sliced integers


def majority3(a: Column, b: Column, c: Column) -> Column:
    return (a & b) | (a & c) | (b & c)


def xor(a: Column, b: Column) -> Column:
    return a != b


def select_by(mask: Column, a: Column, b: Column) -> Column:
    return F.when(mask, a).otherwise(b)


def add_modular(a: Column, b: Column | int, bits: int) -> Column:
    return F.pmod(a + b, F.lit(1 << bits))


def sub_modular(a: Column, b: Column | int, bits: int) -> Column:
    return F.pmod(a - b, F.lit(1 << bits))


def mul_modular(a: Column, k: Column | int, bits: int) -> Column:
    return F.pmod(a * k, F.lit(1 << bits))


def divide(a: Column, k: int) -> Column:
    """Quotient and remainder by a constant."""
    return F.struct(F.floor(a / k).cast("long").alias("quotient"), F.pmod(a, F.lit(k)).cast("long").alias("remainder"))


def truncate(a: Column, bits: int) -> Column:
    return F.pmod(a, F.lit(1 << bits))


def high_bits(a: Column, drop: int) -> Column:
    return F.shiftright(a, drop)


def sign_extend(a: Column, bits: int) -> Column:
    """The two's complement value of an integer of so many bits."""
    return F.when(a >= (1 << (bits - 1)), a - (1 << bits)).otherwise(a)


def lookup(a: Column, table: dict[int, int], otherwise: int = 0) -> Column:
    """A constant table."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, a), F.lit(otherwise))


def lookup_ranges(a: Column, table: list[tuple[int, int, int]], otherwise: int = 0) -> Column:
    """A constant table of (first, last, value); ranges don't overlap."""
    out = F.lit(otherwise)
    for first, last, value in table:
        out = F.when(a.between(first, last), value).otherwise(out)
    return out


def compare(a: Column, op: str, b: Column | int, bits: int = 32) -> Column:
    """EQ, NEQ, UGT, UGE, ULT, ULE of two integers, taken as unsigned of so many bits."""
    x, y = (F.pmod(v if isinstance(v, Column) else F.lit(v), F.lit(1 << bits)) for v in (a, b))
    return {"EQ": x == y, "NEQ": x != y, "UGT": x > y, "UGE": x >= y, "ULT": x < y, "ULE": x <= y}[op]


def basis_bits(a: Column, bits: int = 8) -> Column:
    """An integer's bits, low bit first."""
    return F.array(*(F.shiftright(a, k).bitwiseAND(1) for k in range(bits)))


def from_bits(bits: Column) -> Column:
    return F.aggregate(F.reverse(bits), F.lit(0), lambda acc, b: (acc * 2 + b).cast("int"))
