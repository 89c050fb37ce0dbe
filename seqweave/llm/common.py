"""Helpers shared by the corpus operators: reading tables, cutting lineage, viewing Arrow text as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode without one. A cluster without one is an error, as
    executors do not see each other's local folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="seqweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder, in a folder for each value of its last columns `by`, and read it back: lineage is cut and
    columns stay prunable."""
    path = f"{checkpoint_dir(df.sparkSession)}/seqweave-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    if (log := _log.get()) is not None:
        log.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_log: ContextVar[list[str] | None] = ContextVar("stored", default=None)


@contextmanager
def stored_paths() -> Iterator[list[str]]:
    """The folders that stored() writes meanwhile, in this thread; where such blocks are nested, the outer one has them too."""
    paths: list[str] = []
    token = _log.set(paths)
    try:
        yield paths
    finally:
        _log.reset(token)
        if (outer := _log.get()) is not None:
            outer += paths


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of stored() that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*cols: Column | str, names: tuple[str, str] = ("_k1", "_k2")) -> list[Column]:
    """128 bits that identify a row by its content, never null: repeated rows share one key and one result."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return [F.xxhash64(*cols, F.lit(1)).alias(names[0]), F.xxhash64(F.lit(2), *reversed(cols)).alias(names[1])]


def fresh(df: DataFrame, n: int = 1) -> list[str]:
    """n column names that df does not have, whatever the case of its own."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"_x{k}") not in taken:
            out.append(name)
        k += 1
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (null rows are empty), without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string_view(column.type) else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def spans_of_rows(offsets: np.ndarray, size: int):
    """Ranges of rows (lo, hi) whose texts have about `size` bytes together; one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns; one of the same name is replaced."""
    keep = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), *columns.values()], names=[*keep, *columns])


def with_schema(df: DataFrame, ddl: str):
    """Schema of df's columns followed by those of ddl, which replace columns of the same name."""
    from pyspark.sql import types as T

    new = T._parse_datatype_string(ddl)
    return T.StructType([f for f in df.schema.fields if f.name not in new.names] + new.fields)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of links (a, b): root is the least vertex of its connected component.

    Alternating large-star and small-star steps; each is a grouped minimum and an equality join, so a hub is pre-aggregated and no
    component meets in one task. Every round is checkpointed. Ends when each vertex hangs on a root directly.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct())
    for _ in range(rounds):
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select("m", "v"))
        least = both.groupBy("u").agg(F.min("w").alias("w0")).select("u", F.least("u", "w0").alias("low"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e"))
        edges = cut(small.select("e.v", "e.m").where("v <> m").distinct())
        if edges.join(edges.select(F.col("v").alias("m")), "m", "left_semi").isEmpty() and edges.groupBy("v").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("m").alias("v"), F.col("m").alias("root")).distinct()
    return edges.select("v", F.col("m").alias("root")).union(roots)
