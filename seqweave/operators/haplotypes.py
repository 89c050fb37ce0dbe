"""Alignment against a collection that holds haplotypes: reads are placed on the references, with the place on the haplotype in OA and
further places of equal score in AA."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalars as S
from . import alignment, collection, lifting
from .distributed import stored

#: Lifted places less than this apart are one region, as on one sequence.
REGION = 10


def lifted(found: DataFrame, reads: DataFrame, segments: DataFrame) -> DataFrame:
    """`alignment.regions` of the candidates with target_id, ref_pos and ref_cigar, null where nothing is left on the reference, and
    `region`: candidates of a read and strand whose lifted places follow one another less than REGION apart, whatever haplotype they lie
    on; a place without a lift is a region of its own."""
    one = alignment.regions(found, reads).withColumn("key", F.concat_ws("/", "read_id", "ref_id", "strand", "pos"))
    one = stored(one)
    target = segments.select("ref_id", "target_id").distinct()
    moved = lifting.lift_cigars(one, segments, ["ref_id"]).join(target, "ref_id", "left")
    where = F.when(F.col("ref_pos").isNull(), F.col("key")).otherwise(F.col("target_id").cast("string"))
    row = W.partitionBy("read_id", "strand", "_where").orderBy("ref_pos", "key")
    new = F.coalesce((F.col("ref_pos") - F.lag("ref_pos").over(row) >= REGION).cast("int"), F.lit(1))
    numbered = moved.withColumn("_where", where).withColumn("_new", new).withColumn("_n", F.sum("_new").over(row))
    return numbered.withColumn("region", F.concat_ws("/", "strand", "_where", "_n")).drop("key", "_where", "_new", "_n")


def single(found: DataFrame, reads: DataFrame, refs: DataFrame, segments: DataFrame, cfg: alignment.AlignConfig = alignment.AlignConfig()) -> DataFrame:
    """One SAM row for each read. The best candidate is reported (of equals the first sequence, place and strand; references come before
    haplotypes) at its place on the reference, with NM and MD against the reference; AS is its score on the haplotype. The second-best
    score and mapping quality leave out candidates of its own region, which are the same place on other haplotypes. OA is
    `sequence,pos,strand,CIGAR,MAPQ,NM;` on the haplotype; AA lists `sequence,pos,score;` of all further candidates of the best score, in
    order of sequence and place, so it grows with the haplotypes that a read fits as well. A read whose best candidate lies within an
    insertion has no place on the reference: flag 4, no NM and MD, but AS, OA and AA. Reads without a candidate are unmapped without
    tags. refs (ref_id, name, seq); segments as of `variants.collection_segments`."""
    read, region = W.partitionBy("read_id"), W.partitionBy("read_id", "region")
    order = [F.desc("score"), F.col("ref_id"), F.col("pos"), F.col("strand")]
    named = lifted(found, reads, segments).join(refs.select("ref_id", "name"), "ref_id")
    each = named.withColumns({"_k": F.row_number().over(read.orderBy(*order)), "_b": F.row_number().over(region.orderBy(*order)), "_top": F.max("score").over(read)})
    margin = max(cfg.match + cfg.mismatch, cfg.gap_open + cfg.gap_extend)
    other = (F.col("_b") == 1) & (F.col("_k") > 1)
    tie = F.when((F.col("score") == F.col("_top")) & (F.col("_k") > 1), F.struct("ref_id", "pos", "strand", F.concat_ws(",", "name", F.col("pos") + 1, "score").alias("t")))
    top = F.struct("ref_id", "target_id", "strand", "score", "pos", "cigar", "nm", "ref_pos", "ref_cigar", "name", "n")
    got = each.groupBy("read_id").agg(
        F.min_by(top, "_k").alias("b"),
        F.coalesce(F.max(F.when(other, F.col("score"))), F.lit(0)).alias("second"),
        F.count_if(other & (F.col("score") >= F.col("_top") - margin)).alias("sub_n"),
        F.array_sort(F.collect_list(tie)).alias("ties"),
    )
    flat = got.select("read_id", "b.*", "second", F.size("ties").cast("long").alias("n_ties"), F.array_join(F.transform("ties", lambda t: F.concat(t["t"], F.lit(";"))), "").alias("AA"), S.mapq_se(F.col("b.score"), F.col("second"), F.col("sub_n"), F.col("b.n"), cfg.match, cfg.mismatch, cfg.min_len).alias("mapq"))
    span = F.aggregate(F.transform(F.regexp_extract_all("ref_cigar", F.lit(r"(\d+)[MD]"), F.lit(1)), lambda v: v.cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    best = stored(flat.withColumn("lo", F.col("ref_pos")).withColumn("hi", F.col("ref_pos") + span))
    asked = best.where("lo IS NOT NULL").select(F.col("target_id").alias("ref_id"), "lo", "hi")
    texts = collection.windows(asked, refs).select(F.col("ref_id").alias("target_id"), "lo", "hi", "target")
    placed = best.join(texts, ["target_id", "lo", "hi"], "left").join(refs.select(F.col("ref_id").alias("target_id"), F.col("name").alias("rname")), "target_id", "left")

    @F.pandas_udf("md string, nm int")
    def against(seq: pd.Series, target: pd.Series, cigar: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None or c is None else alignment.described(s, t, "".join(op * int(k) for k, op in re.findall(r"(\d+)([MID])", c)), cfg)[2:] for s, t, c in zip(seq, target, cigar, strict=True)]
        return pd.DataFrame({"md": [r[0] for r in rows], "nm": pd.array([r[1] for r in rows], dtype="Int32")})

    both = reads.select("read_id", "seq").join(placed.drop("n"), "read_id", "left")
    seq = F.when(F.col("strand") == 1, S.revcomp(F.col("seq"))).otherwise(F.col("seq"))
    out = both.withColumn("_seq", seq).withColumn("_a", against(F.coalesce("_seq", F.lit("")), "target", "ref_cigar"))
    on = F.col("ref_pos").isNotNull()
    sign = F.when(F.col("strand") == 1, F.lit("-")).otherwise(F.lit("+"))
    return out.select(
        F.col("read_id").cast("string").alias("qname"),
        (F.when(on, F.lit(0)).otherwise(F.lit(S.UNMAPPED)) + F.when(F.col("strand") == 1, F.lit(S.REVERSE)).otherwise(F.lit(0))).alias("flag"),
        F.when(on, F.col("rname")).otherwise(F.lit("*")).alias("rname"),
        F.coalesce(F.col("ref_pos") + 1, F.lit(0)).alias("pos"),
        F.coalesce("mapq", F.lit(0)).alias("mapq"),
        F.when(on, F.col("ref_cigar")).otherwise(F.lit("*")).alias("cigar"),
        F.coalesce("_seq", F.lit("*")).alias("seq"),
        F.col("score").alias("AS"),
        F.when(F.col("second") > 0, F.col("second")).alias("ZS"),
        F.col("_a.nm").alias("NM"),
        F.col("_a.md").alias("MD"),
        F.when(F.col("score").isNotNull(), F.concat(F.concat_ws(",", "name", F.col("pos") + 1, sign, "cigar", "mapq", "nm"), F.lit(";"))).alias("OA"),
        F.when(F.col("n_ties") > 0, F.col("AA")).alias("AA"),
        "n_ties",
    )
