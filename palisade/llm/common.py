"""What the operators share: batches of rows in workers, checkpoints, the tables of a folder."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.scratch import scratch_dir

# Rows handled at once in a worker: bounds what is held besides the Arrow batch itself.
SLICE_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
) -> DataFrame:
    """Applies ``fn`` to slices of Arrow batches; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as files in the shared checkpoint folder, so that a
    lost executor costs nothing and the lineage ends here."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, prefixed until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(*columns: np.ndarray) -> bytes:
    """Numbers of several columns byte plane by byte plane, compressed: high bytes are mostly zero."""
    raw = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    """The ``size`` numbers of each column that ``packed`` took."""
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, size * sum(widths), codec="zstd", asbytes=True), np.uint8)
    found, at = [], 0
    for kind, width in zip(kinds, widths):
        planes = raw[at:at + size * width].reshape(width, size)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * width
    return found
