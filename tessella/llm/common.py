"""Shared plumbing: the cluster's shared folder, shipping the package, and file access."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import work_path, written

__all__ = ["SharedFile", "file_frame", "filesystem", "fresh", "in_arrow", "kept", "partitions", "release", "ship", "slices", "table", "texts_of", "work_path", "written"]
ROOT = Path(__file__).resolve().parents[2]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken, in any case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Sends the package to executors unless PYTHONPATH has it already."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_tessella", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tessella-zip-")) / "tessella.zip"
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "tessella").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(at))
    spark.sparkContext._tessella = True


#: Bytes of one Arrow batch, about: Spark's own limit of 10,000 rows lets a batch of long texts take far more, in the executor and again in Python.
BATCH_BYTES = 4 << 20
#: What a worker keeps between tasks, by name.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A worker's own dictionary, which lasts until a task that doesn't name it begins."""
    return _KEPT.setdefault(name, {})


def release(name: str = "") -> None:
    """Gives back what the worker keeps, but for this."""
    if any(held for other, held in _KEPT.items() if other != name):
        for other, held in _KEPT.items():
            if other != name:
                held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def in_arrow(df: DataFrame, make, schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow with a function of (batches) -> batches, the package shipped first; keeps: the name of what the worker keeps for it."""
    spark = df.sparkSession
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower().rstrip("b")
    if size.isdigit() and int(size) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from make(batches)

    return df.mapInArrow(started, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column's strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds at most `rows` rows and about `size` bytes of a column."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.column(column).slice(at, n).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class SharedFile:
    """Written under another name and moved at the end, so that a lost task leaves no half file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def file_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of files to read, one task each up to a few thousand."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4000)))
