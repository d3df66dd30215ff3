"""Files as tables: selection by rules, reading as bytes, text or lines, CSV, and writing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from textloom.plans.regex import glob


def paths(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def selected(path: Column, rules: Iterable[tuple[str, str]], kind: str = "file") -> Column:
    """Whether a name is selected by (include or exclude, pattern) rules: the last that fits wins; without one a name is selected
    unless the first rule is an include. Rules are constants of the plan."""
    rules = list(rules)
    out = F.lit(not (rules and rules[0][0] == "include"))
    for sense, pattern in rules:
        out = F.when(path.rlike(glob(pattern, kind)), F.lit(sense == "include")).otherwise(out)
    return out


def select_files(df: DataFrame, rules=(), folder_rules=(), path: str = "path") -> DataFrame:
    """Files by rules on their names and on the names of all their folders."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    ok = selected(name_of(F.col(path)), rules)
    if folder_rules:
        ok = ok & F.forall(F.filter(folders, lambda f: f != ""), lambda f: selected(f, folder_rules))
    return df.where(ok)


def ignored(path: Column, ignore_files: dict[str, list[str]]) -> Column:
    """Whether ignore files (by folder) exclude a path: deeper folders and later lines win, ``!`` takes back, a final slash means folders."""
    out = F.lit(False)
    for folder, lines in sorted(ignore_files.items(), key=lambda x: x[0].count("/")):
        base = folder.rstrip("/") + "/" if folder else ""
        inside = path.startswith(base)
        rest = F.substring(path, F.lit(len(base) + 1), F.char_length(path))
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            take_back, line = line.startswith("!"), line.removeprefix("!")
            body = glob(line.rstrip("/"), "git")[1:-1]
            tail = "/.*" if line.endswith("/") else "(?:/.*)?"
            out = F.when(inside & rest.rlike(f"^{body}{tail}$"), F.lit(not take_back)).otherwise(out)
    return out


def read_bytes(spark: SparkSession, folder: str, name_pattern: str | None = None) -> DataFrame:
    """(path, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", name_pattern) if name_pattern else reader).load(folder).select("path", "content")


def read_texts(spark: SparkSession, folder: str, name_pattern: str | None = None) -> DataFrame:
    """(path, text): a row a file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true")
    return (reader.option("pathGlobFilter", name_pattern) if name_pattern else reader).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, folder: str, separator: str = "\n") -> DataFrame:
    """(path, line): large files are split between tasks."""
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_csv(spark: SparkSession, folder: str, sep: str = ",", quote: str = '"', header: bool | list[str] = True) -> DataFrame:
    """CSV by records; doubled quotes are escapes. ``header``: from the first line, or given names."""
    reader = spark.read.option("sep", sep).option("quote", quote).option("escape", quote).option("multiLine", "true")
    if isinstance(header, list):
        return reader.schema(", ".join(f"`{h}` string" for h in header)).csv(folder)
    return reader.option("header", str(header).lower()).csv(folder)


def from_memory(spark: SparkSession, texts: list[str], name: str = "text") -> DataFrame:
    return spark.createDataFrame([Row(doc_id=n, **{name: t}) for n, t in enumerate(texts)])


def random_stream(spark: SparkSession, rows: int, bits: int = 8, seed: int = 0) -> DataFrame:
    """(pos, value): pseudo-random integers of some width, the same for a seed and a number of rows."""
    return spark.range(rows).select(F.col("id").alias("pos"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << bits)).alias("value"))


def empty_stream(df: DataFrame) -> DataFrame:
    """No rows of the same columns."""
    return df.where(F.lit(False))


# -- sinks


def write_lines(df: DataFrame, folder: str, column: str = "line") -> None:
    """Text files; they appear only when the write is complete."""
    df.select(column).write.mode("overwrite").text(folder)


def write_csv(df: DataFrame, folder: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).option("escape", '"').csv(folder)


def for_each(df: DataFrame, call: Callable[[Iterable[Row]], None]) -> None:
    """A callback for each partition's rows, on the executors."""
    df.foreachPartition(call)


def show_positions(df: DataFrame, columns: list[str], key: str = "item_id", pos: str = "pos") -> DataFrame:
    """Mark streams as lines of dots and ones, one a text and stream."""
    made = df.groupBy(key).agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.when(F.col(c), "1").otherwise(".").alias("x")))), lambda s: s["x"]), "").alias(c) for c in columns))
    return made
