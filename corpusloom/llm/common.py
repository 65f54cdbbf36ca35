"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows of a few machine words, that a join may broadcast.
BROADCAST_ROWS = 1_000_000


class Memo(dict):
    """``key -> make(key)``, kept until ``limit`` keys are held, then emptied.

    Word-level work (hashes, piece counts, segmentations) repeats heavily in
    prose, so each worker process computes it once per distinct word.
    """

    def __init__(self, make: Callable[[Any], Any], limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: Any) -> Any:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def release() -> None:
    """Give memory that this worker process has freed back to the system.

    Worker processes outlive their tasks; what their allocators keep counts against
    the executor while others need it.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library, which keeps its own counsel
    _trim = None


def each_text(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    """Texts of an Arrow column one by one, so that a batch of them is never held twice."""
    return (x.as_py() for x in column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is named and all runs on this machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/corpusloom-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoint into the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage; the rows survive the loss of executors.

    The shuffle files behind it aren't needed any more; a collection on the driver
    lets Spark remove them before the next step writes its own.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint()
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def sized(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``limit`` rows, else as it is.

    Beyond the limit the planner is left to shuffle both sides. The count reads
    ``limit + 1`` rows at most.
    """
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id, one for each.

    Repeated rows collapse. Where one doc_id carries several texts, the row with
    the greatest text is taken, of equal texts the greatest in the other columns (any,
    if one is of a type without an order). Only repeated ids are shuffled with their text.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    again = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return docs
    again = sized(again)
    row = F.struct(F.col("text"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    ordered = not any(kind in t for _, t in docs.dtypes for kind in ("map<", "variant"))
    pick = F.max(row) if ordered else F.max_by(row, "text")
    chosen = docs.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(pick.alias("_row"))
    return docs.join(again, "doc_id", "left_anti").unionByName(
        chosen.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash can serve as its bucket."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))
