"""Session defaults for local runs; on a cluster the submitted configuration holds."""

from pyspark.sql import SparkSession


def local(cores: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
