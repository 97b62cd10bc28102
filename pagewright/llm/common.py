"""Helpers of the training-data operators: shared scratch tables, sampling, text batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SCRATCH: list[str] = []
HASH_SPAN = 1 << 30
#: Seconds between two times that a task gives memory back.
GIVE_BACK_S = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes inside."""
    start, made = len(_SCRATCH), list[str]()
    yield made
    made += _SCRATCH[start:]


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes the tables that materialize() wrote, all or some; call it once the results are stored."""
    jvm = spark.sparkContext._jvm
    for name in list(_SCRATCH if paths is None else paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _SCRATCH:
            _SCRATCH.remove(name)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4; null ids count as 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4, F.lit(0))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return fold(doc_id) == 2


def sampled(key: Column, share: Column | float) -> Column:
    """Whether a row is in a sample of about this share, decided by a hash of its key alone."""
    return F.pmod(key, F.lit(HASH_SPAN)) < (F.lit(float(HASH_SPAN)) * share)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches to about `limit` characters of text; one long text makes a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function, giving back to the system what Arrow's allocator holds free, now and then and at the end.

    Workers live on from stage to stage, and the allocator keeps the most that any task of theirs took.
    """

    @wraps(run)
    def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, last = pa.default_memory_pool(), time.monotonic()
        try:
            for made in run(batches):
                yield made
                del made
                if time.monotonic() - last > GIVE_BACK_S:
                    pool.release_unused()
                    last = time.monotonic()
        finally:
            pool.release_unused()

    return given_back


def native_types(df: DataFrame, columns: list[str]) -> list[str]:
    """`name type` of the columns, for the schema of a Python stage that passes them through."""
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]
