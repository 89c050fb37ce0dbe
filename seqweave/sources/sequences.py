"""FASTA, FASTQ, pair, name-length and sample files as DataFrames, plain or gzipped, from any store that Spark reads.

FASTA is split at record starts, so large plain files are read in parallel; gzip files are read by one task each. FASTQ records
are four lines; lines are numbered from counts of the file blocks, so records across block edges stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def fasta(spark: SparkSession, path) -> DataFrame:
    """(name, comment, seq): sequences of several lines are joined. An empty file gives no rows, an empty sequence ''. A FASTQ file is an
    error."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    record = F.when(F.col("value").startswith("@"), F.raise_error(F.lit("FASTQ where FASTA is wanted")).cast("string")).otherwise(record)
    head, body = F.split_part("r", F.lit("\n"), F.lit(1)), F.regexp_replace("r", "^[^\n]*", "")
    parts = rows.select(record.alias("r")).select(F.trim(head).alias("h"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return parts.select(F.regexp_extract("h", r"^(\S*)", 1).alias("name"), F.regexp_extract("h", r"^\S*\s+(.*)$", 1).alias("comment"), "seq")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(path, line, value): 0-based line numbers within each file. Row ids grow by one within a block, so a line number is the
    distance to the block's first row plus the lines of the blocks before; one row for each block is gathered for that."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    shift = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(shift, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("before")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def fastq(spark: SparkSession, path) -> DataFrame:
    """(path, ordinal, name, comment, seq, qual). A record that lacks lines, or whose quality has another length, is an error."""
    lines = numbered_lines(spark, path).withColumn("ordinal", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    whole = lines.groupBy("path", "ordinal").agg(one(0).alias("h"), one(1).alias("seq"), one(2).alias("plus"), one(3).alias("qual")).where("NOT (h = '' AND coalesce(seq, '') = '')")
    good = F.coalesce(F.col("h").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False))
    checked = F.when(good, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("broken FASTQ record "), F.col("ordinal").cast("string"))).cast("string"))
    return whole.select("path", "ordinal", F.regexp_extract("h", r"^@(\S*)", 1).alias("name"), F.regexp_extract("h", r"^\S*\s+(.*)$", 1).alias("comment"), checked.alias("seq"), "qual")


def pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two FASTQ tables by ordinal, as structs m1 and m2; unequal counts are an error. Each table is of one file."""
    a = first.select("ordinal", F.struct("name", "seq", "qual").alias("m1"))
    b = second.select("ordinal", F.struct("name", "seq", "qual").alias("m2"))
    both = a.join(b, "ordinal", "full_outer")
    lone = F.col("m1").isNull() | F.col("m2").isNull()
    return both.select(F.when(lone, F.raise_error(F.lit("mate files differ in length")).cast("bigint")).otherwise(F.col("ordinal")).alias("ordinal"), "m1", "m2")


def lengths(spark: SparkSession, path) -> DataFrame:
    """(name, length) of a name-length file."""
    parts = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).cast("long").alias("length"))


def samples(spark: SparkSession, path) -> DataFrame:
    """(sample): one name a line."""
    return spark.read.text(path).select(F.trim("value").alias("sample")).where("sample <> ''")
