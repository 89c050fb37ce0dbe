"""Text forms of results: SAM, FASTA, matching-statistics and match files, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import sound_mapq
from ..operators.distributed import ranked

#: The columns of SAM, in order.
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
#: Optional fields and their types.
TAGS = {"AS": "i", "NM": "i", "ZS": "i", "MD": "Z", "OA": "Z", "AA": "Z"}
#: What stands for a missing column.
MISSING = {"flag": "4", "pos": "0", "mapq": "0", "pnext": "0", "tlen": "0"}


def sam_line(df: DataFrame) -> Column:
    """A SAM record of df's columns: the eleven of SAM and the tags among them. Missing ones take their placeholder; null tags go."""
    have = {c.lower(): c for c in df.columns}
    value = lambda c: sound_mapq(F.col(have[c])) if c == "mapq" else F.col(have[c])
    core = [F.coalesce(value(c).cast("string"), F.lit(MISSING.get(c, "*"))) if c in have else F.lit(MISSING.get(c, "*")) for c in SAM]
    tags = [F.concat(F.lit(f"{t}:{kind}:"), F.col(have[t.lower()]).cast("string")) for t, kind in TAGS.items() if t.lower() in have]
    return F.concat_ws("\t", *core, *tags)


def sam_header(index: DataFrame, program: str = "seqweave") -> DataFrame:
    """(k, value): header lines in order of k."""
    spark = index.sparkSession
    top = spark.createDataFrame([(-1, "@HD\tVN:1.6\tSO:unknown")], "k long, value string")
    names = index.select(F.col("ref_id").cast("long").alias("k"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))
    return top.unionByName(names).unionByName(spark.createDataFrame([((1 << 62), f"@PG\tID:{program}\tPN:{program}")], "k long, value string"))


def write_sam(records: DataFrame, index: DataFrame, path: str) -> None:
    """A folder of SAM text: header/ (one part, sorted) and records/ (parts as Spark deals them)."""
    sam_header(index).orderBy("k").coalesce(1).select("value").write.text(f"{path}/header")
    records.select(sam_line(records).alias("value")).write.text(f"{path}/records")


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    """A FASTA record with lines of `width` characters."""
    lines = F.regexp_replace(seq, f"(?s)(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), name, F.lit("\n"), lines)


def write_fasta_blocks(seqs: DataFrame, path: str, blocks: int) -> None:
    """seqs (ref_id, name, seq) as FASTA in `blocks` folders block=k, dealt by range of ref_id."""
    dealt = seqs.repartitionByRange(blocks, "ref_id").withColumn("block", F.spark_partition_id())
    dealt.select("block", fasta_text(F.col("name"), F.col("seq")).alias("value")).write.partitionBy("block").text(path)


def lengths_text(name: Column, values: Column) -> Column:
    """`>name` and the numbers of each place: the form of pointers, lengths and pseudo-lengths."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.array_join(F.transform(values, lambda v: v.cast("string")), " "))


def mems_text(name: Column, mems: Column) -> Column:
    """`>name` and (idx,len) of each match."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.array_join(F.transform(mems, lambda m: F.concat(F.lit("("), m["idx"].cast("string"), F.lit(","), m["len"].cast("string"), F.lit(")"))), " "))


def write_csv(stats: DataFrame, path: str) -> None:
    stats.write.option("header", True).csv(path)


def write_pseudo_lengths(found: DataFrame, path: str) -> None:
    """found (read_id, lengths) as text in order of read_id: `>` and the read's number in that order, then its pseudo-lengths."""
    numbered = ranked(found.select("read_id", "lengths"), ["read_id"], "_n")
    lines = numbered.select("_n", lengths_text(F.col("_n").cast("string"), F.col("lengths")).alias("value"))
    lines.repartitionByRange("_n").sortWithinPartitions("_n").select("value").write.text(path)
