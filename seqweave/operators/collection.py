"""A collection of named sequences as a table: starts, lookups by position, coordinate lifts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .distributed import running_sum

BIN = 4096


def seqidx(refs: DataFrame, separator: int = 0) -> DataFrame:
    """refs (ref_id, name, seq) -> ref_id, name, start, len; sequences follow one another with `separator` characters between."""
    sized = refs.select("ref_id", "name", F.length("seq").cast("long").alias("len")).withColumn("_step", F.col("len") + separator)
    return running_sum(sized, "_step", ["ref_id"], "start").select("ref_id", "name", "start", "len")


def locate(positions: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """positions with ref_id, name and offset of the sequence that holds them: an equality join on bins of the concatenation,
    then the interval test. Positions outside every sequence go."""
    bins = index.where("len > 0").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("start") + F.col("len") - 1) / BIN))))
    inside = (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("start") + F.col("len"))
    return positions.withColumn("_bin", F.floor(F.col(pos) / BIN)).join(bins, "_bin").where(inside).withColumn("offset", F.col(pos) - F.col("start")).drop("_bin")


def valid(located: DataFrame, length: str) -> DataFrame:
    """located rows with `valid`: whether an interval of this length stays inside its sequence."""
    return located.withColumn("valid", F.col("offset") + F.col(length) <= F.col("len"))


def identity_lift(index: DataFrame) -> DataFrame:
    """Lift segments that map each sequence onto itself."""
    return index.select("ref_id", F.lit(0).cast("long").alias("src_start"), F.col("len").alias("src_end"), F.lit(0).cast("long").alias("dst_start"), F.col("start").alias("dst_base"), F.lit("=").alias("op"))


def lift(located: DataFrame, segments: DataFrame) -> DataFrame:
    """located rows (ref_id, offset) with `lifted`: start of the target sequence plus the offset mapped by the segment that holds
    it; positions inside an insertion take the place where it stands."""
    inside = (F.col("offset") >= F.col("src_start")) & (F.col("offset") < F.col("src_end"))
    moved = F.when(F.col("op") == "I", F.col("dst_start")).otherwise(F.col("dst_start") + F.col("offset") - F.col("src_start"))
    return located.join(segments, "ref_id").where(inside).withColumn("lifted", F.col("dst_base") + moved).drop("src_start", "src_end", "dst_start", "dst_base", "op")


def same_region(a: DataFrame, b: DataFrame, key: str, segments: DataFrame) -> DataFrame:
    """(key, same): whether the located rows of a and b with one key lift to the same place of the same sequence."""
    one = lift(a, segments).select(key, F.col("ref_id").alias("_r1"), F.col("lifted").alias("_l1"))
    two = lift(b, segments).select(key, F.col("ref_id").alias("_r2"), F.col("lifted").alias("_l2"))
    return one.join(two, key).select(key, ((F.col("_r1") == F.col("_r2")) & (F.col("_l1") == F.col("_l2"))).alias("same"))


def random_access(located: DataFrame, refs: DataFrame, width: str) -> DataFrame:
    """located rows with `part`: the characters from the position on, `width` at most and none of the next sequence."""
    asked = located.withColumn("lo", F.col("offset").cast("long")).withColumn("hi", F.least(F.col("len"), F.col("offset") + F.col(width)).cast("long"))
    return asked.join(windows(asked, refs), ["ref_id", "lo", "hi"], "left").withColumn("part", F.coalesce("target", F.lit(""))).drop("lo", "hi", "target")


def pieces(refs: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, bin, part): sequences cut into pieces of BIN characters; null and empty ones have none."""
    size = BIN
    kind = refs.schema[key].dataType.simpleString()

    def cut_up(batches):
        for batch in batches:
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                for k in range(0, -(-len(text) // size), 1024):
                    part = [text[i : i + size] for i in range(k * size, min(len(text), (k + 1024) * size), size)]
                    yield pa.RecordBatch.from_arrays([pa.array([who] * len(part), batch.schema.field(0).type), pa.array(range(k, k + len(part)), pa.int64()), pa.array(part, pa.string())], names=[key, "bin", "part"])

    return refs.select(key, "seq").mapInArrow(cut_up, f"{key} {kind}, bin long, part string")


def windows(asked: DataFrame, refs: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, lo, hi, target): the characters from lo (0-based) up to hi of each asked window (key, lo, hi). Only the pieces that
    windows touch are joined, so no row carries a whole sequence. Windows outside the sequence have no row."""
    each = asked.select(key, "lo", "hi").where("hi > lo").distinct()
    bins = each.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))))
    met = bins.join(pieces(refs, key), [key, "bin"]).groupBy(key, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bin", "part"))).alias("p"))
    begin = F.col("lo") - F.col("p")[0]["bin"] * BIN
    return met.select(key, "lo", "hi", F.array_join("p.part", "").alias("t"), begin.cast("int").alias("at")).select(key, "lo", "hi", F.expr("substring(t, at + 1, cast(hi - lo as int))").alias("target")).where("target <> ''")
