"""The same operators over streams, to the end of what is there (``availableNow``) or on.

A row holds a whole record, so searches and counts need no state. State is kept for texts that arrive in pieces, where the
reference carries bits from segment to segment: by document, in ``number_pieces``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only without that setting and on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
    return f"{base.rstrip('/')}/textloom-stream-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream; a path to one file or to a folder of files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


def read_text_stream(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).text(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        # each batch of an aggregation replaces what the last one wrote
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def on_stream(path_or_stream: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Any row-wise operator over a stream, drained."""
    return drain(operator(path_or_stream), mode)


def number_pieces(pieces: DataFrame, key: str = "doc_id", order: str = "piece", text: str = "text") -> DataFrame:
    """Texts that arrive in pieces: for each piece the number of its first line and the nesting depth before it. (key, order, first_line, depth)"""

    def step(keys: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        line, depth = state.get if state.exists else (1, 0)
        rows = []
        for frame in frames:
            for n, t in sorted(zip(frame[order], frame[text], strict=True), key=lambda p: (not pd.isna(p[0]), 0 if pd.isna(p[0]) else p[0])):
                rows.append((keys[0], n, line, depth))
                line += (t or "").count("\n")
                depth += (t or "").count("(") - (t or "").count(")")
        state.update((line, depth))
        yield pd.DataFrame(rows, columns=[key, order, "first_line", "depth"])

    kind = pieces.schema[key].dataType.simpleString()
    return pieces.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} long, first_line long, depth long", "line long, depth long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 day", *keys: str) -> DataFrame:
    """Counts by window with a watermark; times without a zone are of the session's."""
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys).count()
    return grouped.select(F.col("window.start").alias("start"), *keys, F.col("count").alias("n"))
