"""Helpers that the operators of this folder share: tables, shared storage, Arrow batches of text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a task works on at a time; longer texts are taken alone, whole.
SLICE_BYTES = 4_000_000


_HELD: dict[str, object] = {}


def worker_cache(name: str, make: Callable):
    """The cache of one operator in a Python worker; making it drops what an operator before it has left there."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can hand free memory back
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[name] = make()
    return _HELD[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset, on one
    machine; on a cluster an unset one is an error, as executors would not find each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tapeflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs whose texts hold at most `most` bytes (one longer text makes a run of its own)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def portions(texts, most: int = 1_000_000) -> Iterator[list]:
    """The texts of a pandas column in runs of at most `most` characters, as text_slices cuts batches."""
    run, held = [], 0
    for t in texts:
        size = len(t) if t else 0
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += size
    if run:
        yield run


def mapped(df: DataFrame, column: str, make: Callable, schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """make(batch) -> dict of columns, run by Arrow over slices of df; rows stay where they are."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(","))])

    def run(batches):
        for batch in text_slices(batches, column, most):
            yield pa.RecordBatch.from_pydict(make(batch), schema=fields)

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}
