"""Running sums and ranks over a whole table without a single-partition window.

Rows are dealt by range of the order, numbered or summed inside each partition, and shifted by what the partitions before hold;
only one row for each partition meets in one place. The dealt rows are checkpointed, so both uses see the same ranges.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only in local mode without one, else an error."""
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
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage is cut, and the planner knows the real size."""
    path = f"{shared_folder(df.sparkSession)}/seqweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes in fewer partitions, as a single small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def _dealt(df: DataFrame, order: list[Column | str]) -> DataFrame:
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_sum(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before, in the given order."""
    dealt = _dealt(df, order)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    out = dealt.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(shift), "_part")
    return out.withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift")


def ranked(df: DataFrame, order: list[str], name: str, dense: bool = False) -> DataFrame:
    """df with `name`: the 0-based place in the order, or with dense the place of the first row of its equals. Range
    partitioning keeps equal rows together."""
    dealt = _dealt(df, order)
    w = W.partitionBy("_part").orderBy(*order)
    place = (F.rank() if dense else F.row_number()).over(w) - 1
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    return dealt.withColumn(name, place.cast("long")).join(F.broadcast(shift), "_part").withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift")
