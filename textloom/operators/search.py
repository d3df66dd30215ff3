"""Line search over texts: the verbs of a grep, each one projection without a shuffle.

``Pattern`` compiles a search when the plan is made. A text's lines are tested inside its row; what comes out as rows are
matching lines only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.batches import by_value
from textloom.operators.lines import line_array, running_sums
from textloom.plans import regex


def found_in(text: Column, java: str) -> Column:
    """Whether a Java pattern is found."""
    return reduce(Column.__and__, (text.rlike(p) for p in regex.for_test(java)))


@dataclass(frozen=True)
class Pattern:
    """What to look for. ``patterns``: one or several, any may match."""

    patterns: str | tuple[str, ...]
    syntax: str = "pcre"
    ignore_case: bool = False
    word: bool = False
    line: bool = False
    invert: bool = False
    mode: str = "unix"
    equivalence: str | None = None

    @property
    def java(self) -> str:
        each = self.patterns if isinstance(self.patterns, str) else list(self.patterns)
        if self.equivalence:
            from textloom.functions.normalize import normalized

            each = normalized(each, self.equivalence) if isinstance(each, str) else [normalized(p, self.equivalence) for p in each]
        return regex.translate(each, self.syntax, self.ignore_case, self.word, self.line)

    def hits(self, line: Column) -> Column:
        """Fixed strings without flags are looked up as such, everything else by regex."""
        if self.equivalence:
            from textloom.functions.normalize import normalize

            line = normalize(line, self.equivalence)
        if self.syntax == "fixed" and not (self.ignore_case or self.word or self.line):
            texts = [t for p in ([self.patterns] if isinstance(self.patterns, str) else self.patterns) for t in p.split("\n")]
            found = F.lit(False)
            for t in texts:
                found = found | F.contains(line, F.lit(t))
        else:
            found = found_in(line, self.java)
        return ~found if self.invert else found


def _rows(text: str, p: Pattern) -> Column:
    """Matching lines of a row as an array of (line_no, line)."""
    source = line_array(text, p.mode)
    if p.equivalence:
        # the normalized text is matched, the line itself is returned
        from textloom.functions.normalize import normalize

        plain = Pattern(p.java, "raw", invert=p.invert)
        other = line_array(normalize(F.col(text), p.equivalence), p.mode)
        pairs = F.zip_with(source, other, lambda x, y: F.struct(x.alias("line"), y.alias("other")))
        pairs = F.transform(pairs, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x["line"].alias("line"), x["other"].alias("other")))
        kept = F.filter(pairs, lambda x: ~found_in(x["other"], p.java) if plain.invert else found_in(x["other"], p.java))
        return F.transform(kept, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line")))
    numbered = F.transform(source, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))
    return F.filter(numbered, lambda x: p.hits(x["line"]))


def _out(df: DataFrame, text: str, found: Column) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(found).alias("_hit")).select(*rest, "_hit.line_no", "_hit.line")


def grep(df: DataFrame, p: Pattern, text: str = "text", max_count: int | None = None) -> DataFrame:
    """Matching lines: other columns, line_no, line. ``max_count``: the first so many of each text."""
    found = _rows(text, p)
    return _out(df, text, found if max_count is None else F.slice(found, 1, max_count))


def count(df: DataFrame, p: Pattern, text: str = "text", max_count: int | None = None) -> DataFrame:
    """Matching lines of each text, zero included."""
    n = F.coalesce(F.size(F.filter(line_array(text, p.mode), p.hits)), F.lit(0)).cast("long")
    return df.select(*[c for c in df.columns if c != text], (n if max_count is None else F.least(n, F.lit(max_count))).alias("matches"))


def files(df: DataFrame, p: Pattern, text: str = "text", matching: bool = True) -> DataFrame:
    """The rows with a matching line, or those without."""
    found = F.coalesce(F.exists(line_array(text, p.mode), p.hits), F.lit(False))
    return df.where(found if matching else ~found).drop(text)


def quiet(df: DataFrame, p: Pattern, text: str = "text") -> bool:
    """Whether there is any match; stops at the first."""
    return not files(df, p, text).limit(1).isEmpty()


def context(df: DataFrame, p: Pattern, before: int = 0, after: int = 0, text: str = "text") -> DataFrame:
    """Matching lines and those around: other columns, line_no, line, is_match, group (runs that the separator would part)."""
    rest = [c for c in df.columns if c != text]
    flagged = df.withColumn("_lines", line_array(text, p.mode)).withColumn("_hits", F.transform("_lines", p.hits))
    near = lambda i: F.exists(F.slice("_hits", F.greatest(i + 1 - after, F.lit(1)), before + after + 1 + F.least(i - after, F.lit(0))), lambda h: h)
    rows = F.transform("_lines", lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"), F.element_at("_hits", i + 1).alias("is_match"), near(i).alias("near")))
    rows = F.transform(rows, lambda x, i: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["is_match"].alias("is_match"), x["near"].alias("near")))
    return flagged.select(*rest, F.explode(F.filter(rows, lambda x: x["near"])).alias("_hit")).select(*rest, "_hit.line_no", "_hit.line", "_hit.is_match")


def replace(df: DataFrame, p: Pattern, replacement: str, text: str = "text") -> DataFrame:
    """The matching lines with all matches replaced."""
    if p.invert:
        raise ValueError("a replacement and an inverted search don't go together")
    java = regex.replacement(replacement)
    rows = grep(df, p, text)
    return rows.withColumn("line", F.regexp_replace("line", F.lit(p.java), F.lit(java)))


def substitute(column: Column, pattern: str, replacement: str, **options) -> Column:
    """Search and replace in a column."""
    return F.regexp_replace(column, F.lit(regex.translate(pattern, **options)), F.lit(regex.replacement(replacement)))


def colorize(df: DataFrame, p: Pattern, text: str = "text", start: str = "\x1b[01;31m", end: str = "\x1b[m") -> DataFrame:
    """Matching lines with their matches between escapes."""
    return grep(df, p, text).withColumn("line", F.regexp_replace("line", F.lit(f"({p.java})"), F.lit(f"{start}$1{end}")))


def report(rows: DataFrame, name: str | None = None, number: bool = True, label: str | None = None, tab: bool = False, null: bool = False) -> DataFrame:
    """Lines as printed: ``file:line_no:line``."""
    parts = []
    if name or label:
        parts.append(F.col(name).cast("string") if name else F.lit(label))
    if number:
        parts.append(F.col("line_no").cast("string"))
    head = F.concat_ws(":", *parts)
    if null and (name or label):
        head = F.concat(parts[0], F.lit("\x00"), F.concat_ws(":", *parts[1:]))
    return rows.withColumn("report", F.concat(head, F.lit((":" if parts else "") + ("\t" if tab else "")), F.col("line")) if parts else F.col("line"))


def only_matching(df: DataFrame, p: Pattern, text: str = "text") -> DataFrame:
    """A row for each leftmost match in each line (an extension)."""
    rows = grep(df, p, text)
    return rows.select(*[c for c in rows.columns if c != "line"], F.posexplode(F.regexp_extract_all("line", F.lit(p.java), F.lit(0))).alias("match_no", "match"))


def count_starts(df: DataFrame, p: Pattern, text: str = "text") -> DataFrame:
    """Positions at which a match starts, overlapping ones included; for patterns of one length these are all matches."""
    found = F.regexp_count(text, F.lit(f"(?=(?:{p.java}))"))
    return df.select(*[c for c in df.columns if c != text], F.coalesce(found, F.lit(0)).cast("long").alias("matches"))


def match_ends(column: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """All positions at which some match of ``pattern`` ends (code points), of any alternative and length."""
    import regex as engine

    # a look-behind runs the pattern backward from each end: every end of any match, not only leftmost ones
    compiled = engine.compile(f"(?<=({'(?i)' if ignore_case else ''}{pattern}))", engine.V1)
    return by_value(T.ArrayType(T.IntegerType()), lambda t: [m.start() for m in compiled.finditer(t)])(column)


def count_all(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Distinct match ends of each text."""
    return df.select(*[c for c in df.columns if c != text], F.coalesce(F.size(match_ends(text, pattern)), F.lit(0)).cast("long").alias("matches"))


def match_spans(column: Column | str, p: Pattern) -> Column:
    """Leftmost matches as (start, end) in code points."""
    column = F.col(column) if isinstance(column, str) else column
    found, parts = F.regexp_extract_all(column, F.lit(p.java), F.lit(0)), F.split(column, p.java, -1)
    gaps = F.transform(F.slice(parts, F.lit(1), F.size(found)), F.char_length)
    sizes = F.transform(found, F.char_length)
    ends = running_sums(F.zip_with(gaps, sizes, lambda g, n: g + n)).cast("array<int>")
    return F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))


def not_binary(df: DataFrame, text: str = "text", policy: str = "without-match") -> DataFrame:
    """Texts with a NUL count as binary. ``without-match`` leaves them out, ``text`` searches them, ``binary`` marks them."""
    binary = F.contains(F.col(text), F.lit("\x00"))
    if policy == "text":
        return df
    return df.where(~F.coalesce(binary, F.lit(False))) if policy == "without-match" else df.withColumn("is_binary", F.coalesce(binary, F.lit(False)))


def byte_text(column: Column) -> Column:
    """Bytes as one character each, for searches by byte."""
    return F.decode(column.cast("binary"), "ISO-8859-1")


def which_patterns(df: DataFrame, patterns: DataFrame, text: str = "text", max_patterns: int = 10_000) -> DataFrame:
    """Each line with each pattern that it matches. ``patterns``: (pattern_id, pattern), a stated list whose size is checked; every line
    meets it inside its row, so no rows are multiplied before they match."""
    listed = patterns.select("pattern_id", "pattern").limit(max_patterns + 1).collect()
    if len(listed) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns: search them in several lists")
    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, F.posexplode(line_array(text)).alias("_at", "line"))
    ids = F.array_compact(F.array(*(F.when(found_in(F.col("line"), regex.translate(r["pattern"])), F.lit(r["pattern_id"])) for r in listed)))
    return rows.select(*rest, (F.col("_at") + 1).cast("long").alias("line_no"), F.explode(ids).alias("pattern_id"))
