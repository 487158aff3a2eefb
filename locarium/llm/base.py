"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def text_udf(make: Callable[[], Callable[[str], tuple]], schema: str, done: Callable[[], None] = lambda: None) -> Callable[[str | Column], Column]:
    """A column function from a text to a struct, one text at a time over Arrow batches.

    ``make`` runs once in each Python worker task and returns the function of one
    text (null arrives as the empty text). Only one text and the results of one
    slice of a batch are held at a time; what the function holds goes when the task
    ends, ``done`` clears what it shares with other tasks of the worker, and freed
    memory is given back. It is marked nondeterministic so that the optimiser
    never evaluates it twice for a filter and a projection.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark_type = _parse_datatype_string(schema)
    names = [f.name for f in spark_type.fields]
    arrow = [to_arrow_type(f.dataType) for f in spark_type.fields]

    def results(one: Callable[[str], tuple], texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in names]
        for value in texts:
            for column, x in zip(out, one(value.as_py() or ""), strict=True):
                column.append(x)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        try:
            for batch in batches:
                parts = [results(one, batch[k : k + 1000]) for k in range(0, len(batch), 1000)]
                yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts or [results(one, batch)])
                del batch, parts
        finally:
            del one
            done()
            give_back()

    return F.arrow_udf(run, spark_type).asNondeterministic()


class Scratch:
    """Intermediate tables in the folder that all executors share.

    ``keep`` writes a DataFrame and returns it as read back, which cuts its
    lineage: if an executor is lost, its tables are still there. The folder is
    the one that ``spark.checkpoint.dir`` names; only where that is unset and Spark
    runs in one process (as in tests) a temporary folder is made.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.gettempdir()}/checkpoints"
        self.root = f"{root}/{what}-{uuid.uuid4().hex}"
        self.made, self.paths = 0, set()

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that no later step reads."""
        self._delete({df._scratch_path for df in frames})

    def only(self, *frames: DataFrame) -> None:
        """Delete all kept tables but these, which the result still reads."""
        self._delete(self.paths - {df._scratch_path for df in frames})

    def _delete(self, paths: set[str]) -> None:
        sc = self.spark.sparkContext
        for name in paths & self.paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        self.paths -= paths


def spread(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
