"""Alignment by the longest match alone: each read is extended from its longest exact match on either strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S
from . import alignment, matching

# Mapping quality by ten bins of the best score's distance from a perfect one, without and with a valid second-best
# score; with one, rows are bins of the lead over it.
WITHOUT_SECOND = [43, 42, 41, 36, 32, 27, 20, 11, 4, 1, 0]
WITH_SECOND = [
    [2, 2, 2, 1, 1, 0, 0, 0, 0, 0, 0],
    [20, 14, 7, 3, 2, 1, 0, 0, 0, 0, 0],
    [20, 16, 10, 6, 3, 1, 0, 0, 0, 0, 0],
    [20, 17, 13, 9, 3, 1, 1, 0, 0, 0, 0],
    [21, 19, 15, 9, 5, 2, 2, 0, 0, 0, 0],
    [22, 21, 16, 11, 10, 5, 0, 0, 0, 0, 0],
    [23, 22, 19, 16, 11, 0, 0, 0, 0, 0, 0],
    [24, 25, 21, 30, 0, 0, 0, 0, 0, 0, 0],
    [30, 26, 29, 0, 0, 0, 0, 0, 0, 0, 0],
    [30, 27, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
]


def binned_mapq(score: Column, second: Column, least: Column, length: Column, match: int = 2) -> Column:
    """Mapping quality of an extended read; a second-best score counts only above the least score. Scores under the least score
    count as that."""
    span = (length * match - least).cast("double")
    bin_of = lambda x: F.greatest(F.lit(0), F.least(F.lit(10), (x * (10.0 / span) + 0.5).cast("int")))
    far = bin_of(length * match - score)
    table = F.array(*[F.lit(v) for row in WITH_SECOND for v in row])
    lead = F.get(table, bin_of(score - second) * 11 + far)
    return F.when(second > least, lead).otherwise(F.get(F.array(*map(F.lit, WITHOUT_SECOND)), far))


def extended(reads: DataFrame, refs: DataFrame, index: DataFrame, cfg: alignment.AlignConfig = alignment.AlignConfig()) -> DataFrame:
    """(read_id, ref_id, strand, pos, score, second, mapq, cigar, md, nm): the best extension over all places of the longest match of
    each strand; of equals the forward strand, then the first sequence and place. Reads without a match, or whose best score is
    under the least one, have no row."""
    both = alignment.stranded(reads)
    mems = matching.smems(both, refs, cfg.min_len)
    occ = matching.of_matches(mems, matching.longest(mems))
    w = (F.col("qe") - F.col("qs")).cast("long")
    x, y = F.col("start") + F.col("rpos") + w - 1, (F.col("qe") - 1).cast("long")
    one = occ.join(index.select("ref_id", "start", "len"), "ref_id").select("read_id", "ref_id", "start", "len", x.alias("x0"), x.alias("x1"), y.alias("y0"), y.alias("y1"), w.alias("score"), F.array(F.struct(x.alias("x"), y.alias("y"), w.alias("w"))).alias("anchors"))
    found = alignment.candidates(one, both, refs, cfg).withColumn("strand", F.pmod("read_id", F.lit(2)).cast("int")).withColumn("read_id", F.floor(F.col("read_id") / 2))
    good = alignment.regions(found, reads)
    read = W.partitionBy("read_id")
    ranked = good.withColumn("_k", F.row_number().over(read.orderBy(F.desc("score"), "strand", "ref_id", "pos")))
    best = ranked.withColumn("second", F.coalesce(F.max(F.when(F.col("_k") > 1, F.col("score"))).over(read), F.lit(0))).where("_k = 1")
    mapq = binned_mapq(F.col("score"), F.col("second"), S.min_score(F.col("n")), F.col("n"), cfg.match)
    return best.select("read_id", "ref_id", "strand", "pos", "score", "second", mapq.alias("mapq"), "cigar", "md", "nm")


def sam_rows(found: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """One SAM row for each read (read_id, seq, and qual if there is one) of `extended`: pos is 1-based; letters and qualities of the
    reverse strand are turned. Reads that `found` lacks are unmapped, with mapping quality 255."""
    named = found.join(refs.select("ref_id", F.col("name").alias("rname")), "ref_id")
    both = reads.select("read_id", "seq", F.col("qual") if "qual" in reads.columns else F.lit(None).cast("string").alias("qual")).join(named, "read_id", "left")
    back, on = F.col("strand") == 1, F.col("rname").isNotNull()
    seq = F.when(back, S.revcomp(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    return both.select(
        F.col("read_id").cast("string").alias("qname"),
        F.when(~on, F.lit(S.UNMAPPED)).when(back, F.lit(S.REVERSE)).otherwise(F.lit(0)).alias("flag"),
        F.coalesce("rname", F.lit("*")).alias("rname"),
        F.coalesce(F.col("pos") + 1, F.lit(0)).alias("pos"),
        F.coalesce("mapq", F.lit(255)).alias("mapq"),
        F.coalesce("cigar", F.lit("*")).alias("cigar"),
        F.when(on, seq).otherwise(F.lit("*")).alias("seq"),
        F.when(on, F.coalesce(qual, F.lit("*"))).otherwise(F.lit("*")).alias("qual"),
        F.col("score").alias("AS"),
        F.col("nm").alias("NM"),
        F.when(F.col("second") > 0, F.col("second")).alias("ZS"),
        F.col("md").alias("MD"),
    )
