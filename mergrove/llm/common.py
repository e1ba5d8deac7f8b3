"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters; ``bytes.split()`` splits at the same six.
SPACE = r"[\x20\x09-\x0D]+"


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Select input columns by exact name under new names: ``take(df, id="doc_id")``.

    Columns are found by position, so other columns may clash with them or with each other, in any case.
    """
    names = df.columns
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"the input has no column {missing}; it has {names}")
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(c)}").alias(new) for new, c in columns.items()])


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.  A session that names none gets a
    temporary one if it runs within this process alone, as in tests, and is refused elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mergrove-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that :func:`written` has made in this process, from number ``since`` on, but those of ``keep``.

    Results are computed when they are asked for, so call it when they have been saved.
    """
    kept = {f._written for f in keep if hasattr(f, "_written")}
    for name in _WRITTEN[since:]:
        if name not in kept:
            _delete(spark, name)
            _WRITTEN.remove(name)


def made() -> int:
    """The number of tables made and not yet deleted."""
    return len(_WRITTEN)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs only its own tasks, and what is derived twice is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/mergrove/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`written` has made and nothing needs any more."""
    _delete(df.sparkSession, df._written)
    _WRITTEN.remove(df._written)


def release(spark: SparkSession) -> None:
    """Let the files of finished shuffles go now: Spark deletes them when the driver's garbage is next collected."""
    for _ in range(2):  # the first round frees what the second finds unused
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def input_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` has: Catalyst's estimate (for a file scan, its files), or 2 KB a row where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 2048 * df.count()


def parts_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """Partitions so that each gets about ``bytes_each`` of the input; grows with the input, not below the session's own number."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, own, math.ceil(input_bytes(df) / bytes_each))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal first ``keys`` columns (integers), from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in range(keys)]
        other = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            other |= batch.column(k).to_numpy(zero_copy_only=False) != last[k].as_py()
        at = np.flatnonzero(other)
        if len(at):
            yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]) + 1)])
            held, batch = [], batch.slice(int(at[-1]) + 1)
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != last[k] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(new)] if len(new) else [])


def part_bits(df: DataFrame, bytes_each: int, least: int = 4, most: int = 24) -> int:
    """Logarithm of the number of packed partitions, each for about ``bytes_each`` of the input."""
    return min(most, max(least, math.ceil(math.log2(max(1, input_bytes(df) / bytes_each)))))
