"""What the operators of this subpackage share: table access, scratch tables and Python over Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions.batches import lean
from textloom.llm.words import by_bytes

#: Rows of a batch that are Python objects at a time; the batch itself stays Arrow memory.
SLICE = 1024

_ROOTS: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set on a local master; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage; they survive a lost executor.

    ``keep`` writes a frame and reads it back. ``drop`` deletes what a loop no longer needs; the
    rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"
        _ROOTS[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = SLICE, text: str | None = None) -> DataFrame:
    """As ``mapInPandas``, but ``run`` gets slices of at most ``rows`` rows, or by the bytes of the column ``text``. Whole numbers with
    nulls stay whole."""
    kind = T.StructType.fromDDL(schema)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        parts = by_bytes(batches, text) if text else (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        for part in parts:
            yield part.to_pandas(integer_object_nulls=True)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        arrow = to_arrow_schema(kind)
        for frame in run(slices(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)
        lean()  # the worker waits for its next task without what this one took

    return df.mapInArrow(go, kind)


def append_columns(df: DataFrame, added: list[T.StructField], start: Callable[[], Callable[[pa.RecordBatch], list[list]]], text: str = "text") -> DataFrame:
    """``df`` with the ``added`` columns. ``start`` is called once a task; what it returns turns a slice (by the bytes of the column
    ``text``) into their values. The columns of ``df`` go through as they are."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        make, kinds = start(), to_arrow_schema(T.StructType(added))
        for part in by_bytes(batches, text, 1 << 21):
            made = [pa.array(values, f.type) for values, f in zip(make(part), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], schema=pa.schema([*part.schema, *kinds]))
        del make
        lean()

    return df.mapInArrow(go, T.StructType([*df.schema.fields, *added]))


@atexit.register
def _clean() -> None:
    for root, spark in _ROOTS.items():
        try:
            _delete(spark, root)
        except Exception:  # the JVM may be gone already; the shared folder is the cluster's to sweep
            return
