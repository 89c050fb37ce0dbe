"""A model of insert sizes from the first rows of a stream; rows wait for it in a folder and are put out once it is there.

folder/state holds the moments after each batch, folder/held the batches so far, folder/out the batches with the model. Batch k reads the
state of batch k - 1 and writes only folders of its own, so a batch that is run again, or a stream that starts again from its checkpoint,
gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "n long, mean double, squares double"


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of two sets of rows together."""
    n, shift = a[0] + b[0], b[1] - a[1]
    return (n, a[1] + shift * b[0] / n, a[2] + b[2] + shift * shift * a[0] * b[0] / n) if n else (0, 0.0, 0.0)


def state(spark: SparkSession, folder: str, k: int) -> tuple[int, float, float]:
    """The moments after batch k; none before the first."""
    return tuple(spark.read.schema(STATE).parquet(f"{folder}/state/batch={k}").first()) if k >= 0 else (0, 0.0, 0.0)


def put_out(rows: DataFrame, now: tuple[int, float, float], path: str) -> None:
    """rows with the model's mean and standard deviation (of a sample; null under two rows)."""
    n, mean, squares = now
    deviation = F.lit((squares / (n - 1)) ** 0.5) if n > 1 else F.lit(None).cast("double")
    rows.withColumns({"model_mean": F.lit(mean), "model_sd": deviation}).write.mode("overwrite").parquet(path)


def step(batch: DataFrame, k: int, folder: str, value: str, order: str, most: int) -> None:
    spark = batch.sparkSession
    before = state(spark, folder, k - 1)
    now = before
    if before[0] < most:
        first = batch.where(F.col(value).isNotNull()).orderBy(order).limit(most - before[0])
        got = first.agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0))).first()
        now = merged(before, tuple(got))
        batch.write.mode("overwrite").parquet(f"{folder}/held/batch={k}")
    if before[0] >= most:
        put_out(batch, now, f"{folder}/out/batch={k}")
    elif now[0] >= most:
        for j in range(k + 1):
            put_out(spark.read.schema(batch.schema).parquet(f"{folder}/held/batch={j}"), now, f"{folder}/out/batch={j}")
    spark.createDataFrame([now], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={k}")


def modelled(stream: DataFrame, folder: str, checkpoint: str, value: str = "size", order: str = "pair_id", most: int = 1000, **options) -> StreamingQuery:
    """Starts the stream. The model takes the first `most` rows with a value: whole batches in turn, and of the one that goes beyond the
    first by `order`. Until then batches are held, then they are read again and put out with the model, as each later one is at once. Rows
    without a value take no part in it, but are put out. options go to the trigger. Of a stream that ends sooner `finish` puts out the rest."""
    run = lambda batch, k: step(batch, k, folder, value, order, most)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**options or {"availableNow": True}).start()


def finish(spark: SparkSession, folder: str, schema, last: int, most: int = 1000) -> None:
    """Puts out what is still held after batch `last`, with the model of what came. Nothing is held once the model was full."""
    now = state(spark, folder, last)
    if now[0] < most:
        for j in range(last + 1):
            put_out(spark.read.schema(schema).parquet(f"{folder}/held/batch={j}"), now, f"{folder}/out/batch={j}")
