"""Pairs of reads: concordant placements, the insert-size model, rescue of a mate without a placement, SAM rows of pairs.

Reads come as (pair_id, mate, seq), mate 0 or 1; inside, read_id is 2 * pair_id + mate. Two placements are concordant if they stand on
different strands of one sequence with a gap (start of the reverse one less the end of the forward one) of at most `reach` to
either side. Null, empty and unplaced reads give an unmapped row; a mate without a partner is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import scalars as S
from . import alignment, collection
from .distributed import cut, stored


@dataclass(frozen=True)
class PairConfig:
    reach: int = 1000
    deviations: float = 4.0


PLACE = ["ref_id", "strand", "pos", "score", "cigar", "md", "nm", "n"]


def read_ids(mates: DataFrame) -> DataFrame:
    return mates.select((F.col("pair_id") * 2 + F.col("mate")).alias("read_id"), "seq")


def concordant(placed: DataFrame, reach: int) -> DataFrame:
    """(pair_id, gap, fwd, rev) of placed (read_id, PLACE): an equality join on bins of `reach` letters, then the distance test, so far
    copies of a repeat never meet."""
    each = placed.withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", F.pmod("read_id", F.lit(2)).cast("int")).withColumn("p", F.struct("mate", *PLACE))
    stop = F.floor((F.col("pos") + F.col("n")) / reach)
    fwd = each.where("strand = 0").select("pair_id", "ref_id", F.explode(F.array(stop - 1, stop, stop + 1)).alias("bin"), F.col("p").alias("fwd"))
    rev = each.where("strand = 1").select("pair_id", "ref_id", F.floor(F.col("pos") / reach).alias("bin"), F.col("p").alias("rev"))
    both = fwd.join(rev, ["pair_id", "ref_id", "bin"]).where("fwd.mate <> rev.mate")
    return both.withColumn("gap", F.col("rev.pos") - F.col("fwd.pos") - F.col("fwd.n")).where(F.abs("gap") <= reach).select("pair_id", "gap", "fwd", "rev")


def fragment_model(pairs: DataFrame) -> DataFrame:
    """One row (mean, sd, n_pairs): gaps of the pairs with one concordant placement only."""
    alone = pairs.groupBy("pair_id").agg(F.count("*").alias("c"), F.min("gap").alias("gap")).where("c = 1")
    return alone.agg(F.avg("gap").alias("mean"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("sd"), F.count("*").alias("n_pairs"))


@F.pandas_udf(T.DoubleType())
def log_tail(z: pd.Series) -> pd.Series:
    """ln(2 erfc(|z| / sqrt 2)); there is no built-in error function."""
    return z.map(lambda x: math.log(max(2 * math.erfc(abs(x) * math.sqrt(0.5)), 5e-324)))


def total(pairs: DataFrame, model: DataFrame, match: int) -> DataFrame:
    """pairs with `total`: both scores and the likelihood of the gap; the model is a single row."""
    with_model = pairs.crossJoin(F.broadcast(model))
    z = F.when(F.col("sd") > 0, (F.col("gap") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    raw = F.col("fwd.score") + F.col("rev.score") + 0.721 * log_tail(z) * match + 0.499
    return with_model.withColumn("total", F.greatest(F.lit(0), raw.cast("int")))


RESCUED = "pair_id long, ref_id long, strand int, pos long, score int, cigar string, md string, nm int, n int, mate int"


def rescued(placed: DataFrame, mates: DataFrame, refs: DataFrame, model: DataFrame, cfg: PairConfig, scores: alignment.AlignConfig) -> DataFrame:
    """Placements (read_id, PLACE) of mates that have none, searched in the window where the best placements of the other mate expect
    them. The first TILE letters find the place, the rest is extended from there, so memory does not grow with the read."""
    each = placed.withColumn("pair_id", F.floor(F.col("read_id") / 2))
    lone = each.withColumn("_lo", F.min("read_id").over(W.partitionBy("pair_id"))).withColumn("_hi", F.max("read_id").over(W.partitionBy("pair_id"))).where("_lo = _hi")
    lone = lone.withColumn("_top", F.max("score").over(W.partitionBy("pair_id"))).where("score = _top")
    asked = lone.select("pair_id", (F.lit(1) - F.pmod("read_id", F.lit(2))).cast("int").alias("mate"), "ref_id", (1 - F.col("strand")).cast("int").alias("strand"), F.col("pos").alias("p"), F.col("n").alias("pn"))
    seqs = mates.where(F.length("seq") > 0).select("pair_id", "mate", F.col("seq"), F.length("seq").alias("n"))
    spread = F.col("sd") * cfg.deviations + scores.context
    least = F.greatest(F.lit(-cfg.reach), F.floor(F.col("mean") - spread))
    most = F.least(F.lit(cfg.reach), F.ceil(F.col("mean") + spread))
    first = F.when(F.col("strand") == 1, F.col("p") + F.col("pn") + least).otherwise(F.col("p") - most - F.col("n"))
    last = F.when(F.col("strand") == 1, F.col("p") + F.col("pn") + most + F.col("n")).otherwise(F.col("p") - least)
    windows = asked.join(seqs, ["pair_id", "mate"]).crossJoin(F.broadcast(model)).where("mean IS NOT NULL").withColumn("lo", F.greatest(F.lit(0), first).cast("long")).withColumn("hi", last.cast("long")).where("hi > lo")
    seq = F.when(F.col("strand") == 1, S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq")
    sought = stored(windows.select("pair_id", "mate", "ref_id", "strand", "lo", "hi", "n", seq))
    near = sought.join(collection.windows(sought, refs), ["ref_id", "lo", "hi"])

    def search(batches):
        for pdf in batches:
            rows = []
            for c in pdf.itertuples():
                head, rest = c.seq[: alignment.TILE], c.seq[alignment.TILE :]
                ops = alignment.aligned(head, c.target, scores, free_end=True, free_start=True)[1]
                at = len(ops) - len(ops.lstrip("D"))
                ops = ops[at:]
                if rest:
                    ops += alignment.extended(rest, c.target[at + sum(o != "I" for o in ops) :], scores)
                score, cigar, md, nm = alignment.described(c.seq, c.target[at:], ops, scores)
                rows.append((c.pair_id, c.ref_id, c.strand, c.lo + at, score, cigar, md, nm, c.n, c.mate))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESCUED.split(", ")])

    found = near.mapInPandas(search, RESCUED).where(F.col("score") >= S.min_score(F.col("n")))
    return found.select((F.col("pair_id") * 2 + F.col("mate")).alias("read_id"), *PLACE).distinct()


def raw_mapq(diff: Column, match: int) -> Column:
    return (6.02 * diff / match + 0.499).cast("int")


def mapq_pair(score: Column, second: Column, sub_n: Column, match: int = 2) -> Column:
    """Mapping quality of a pair from its best and second-best total and the number of near-best pairs."""
    raw = raw_mapq(score - F.greatest(second, F.lit(0)), match) - F.when(sub_n > 0, (4.343 * F.ln(sub_n + 1) + 0.499).cast("int")).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(60), raw))


def mapq_mate(own: Column, pair: Column, score: Column, second: Column, match: int = 2) -> Column:
    """A mate's quality raised towards its pair's by 40 at most, and no better than its own lead over its second place allows."""
    return F.least(F.greatest(own, F.least(pair, own + 40)), raw_mapq(score - second, match))


def template_length(pos: Column, n: Column, other: Column, other_n: Column) -> Column:
    """Signed length of the template, seen from the mate at pos."""
    return F.when(other > pos, other + other_n - pos).otherwise(-(pos + n - other))


def sam_rows(found: DataFrame, mates: DataFrame, refs: DataFrame, cfg: PairConfig = PairConfig(), scores: alignment.AlignConfig = alignment.AlignConfig()) -> DataFrame:
    """Two SAM rows for each pair. The best concordant placement (mates rescued included) is the pair's; without one, each mate takes
    its own best. found: candidates of alignment.found for read_ids(mates)."""
    penalty = max(scores.match + scores.mismatch, scores.gap_open + scores.gap_extend)
    placed = cut(alignment.regions(found, read_ids(mates)).select("read_id", *PLACE))
    near = concordant(placed, cfg.reach)
    model = cut(fragment_model(near))
    more = cut(rescued(placed, mates, refs, model, cfg, scores))
    every = placed.withColumn("rescued", F.lit(False)).unionByName(more.withColumn("rescued", F.lit(True)))
    pairs = total(concordant(every.select("read_id", *PLACE), cfg.reach), model, scores.match)
    pair = W.partitionBy("pair_id")
    ranked = pairs.withColumn("_k", F.row_number().over(pair.orderBy(F.desc("total"), "fwd", "rev"))).withColumn("_top", F.max("total").over(pair))
    best = ranked.withColumn("second", F.coalesce(F.max(F.when(F.col("_k") > 1, F.col("total"))).over(pair), F.lit(0))).withColumn("sub_n", F.count_if(F.col("total") >= F.col("_top") - penalty).over(pair) - 1).where("_k = 1")
    chosen = best.withColumn("pair_mapq", mapq_pair(F.col("total"), F.col("second"), F.col("sub_n"), scores.match)).select("pair_id", "pair_mapq", F.explode(F.array("fwd", "rev")).alias("p")).select((F.col("pair_id") * 2 + F.col("p.mate")).alias("read_id"), *(F.col(f"p.{c}").alias(c) for c in PLACE), "pair_mapq")
    read = W.partitionBy("read_id")
    order = every.withColumn("_k", F.row_number().over(read.orderBy(F.desc("score"), "ref_id", "pos", "strand"))).withColumn("_top", F.max("score").over(read))
    own = order.withColumn("second", F.coalesce(F.max(F.when(F.col("_k") > 1, F.col("score"))).over(read), F.lit(0))).withColumn("sub_n", F.count_if(F.col("score") >= F.col("_top") - penalty).over(read) - 1).where("_k = 1")
    lead = own.select("read_id", F.col("_top").alias("top"), "second", "sub_n", "rescued")
    alone = own.select("read_id", *PLACE).join(chosen.select("read_id"), "read_id", "left_anti").withColumn("pair_mapq", F.lit(None).cast("int"))
    rows = chosen.unionByName(alone).join(lead, "read_id")
    second = F.least(F.col("score"), F.when(F.col("score") == F.col("top"), F.col("second")).otherwise(F.col("top")))
    single = S.mapq_se(F.col("score"), second, F.col("sub_n"), F.col("n"), scores.match, scores.mismatch, scores.min_len)
    mapq = F.when(F.col("pair_mapq").isNull(), single).otherwise(mapq_mate(single, F.col("pair_mapq"), F.col("score"), second, scores.match))
    rated = rows.select("read_id", *PLACE, "rescued", second.alias("zs"), F.greatest(F.lit(0), mapq).alias("mapq"), F.col("pair_mapq").isNotNull().alias("proper")).join(refs.select("ref_id", F.col("name").alias("rname")), "ref_id")
    one = lambda m: mates.where(F.col("mate") == m).select("pair_id", F.struct((F.col("pair_id") * 2 + m).alias("read_id"), "mate", "seq").alias("m"), (F.col("pair_id") * 2 + m).alias("read_id")).join(rated, "read_id", "left").select("pair_id", F.struct("m", *(c for c in rated.columns if c != "read_id")).alias(f"a{m}"))
    both = one(0).join(one(1), "pair_id")
    sides = both.select("pair_id", F.explode(F.array(F.struct(F.col("a0").alias("a"), F.col("a1").alias("b")), F.struct(F.col("a1").alias("a"), F.col("a0").alias("b")))).alias("s")).select("pair_id", "s.a", "s.b")
    mapped, other = F.col("a.rname").isNotNull(), F.col("b.rname").isNotNull()
    reverse, other_reverse = F.coalesce(F.col("a.strand") == 1, F.lit(False)), F.coalesce(F.col("b.strand") == 1, F.lit(False))
    proper = F.coalesce("a.proper", F.lit(False))
    flag = S.sam_flag(F.lit(True), mapped, other, reverse, other_reverse, F.col("a.m.mate") == 0) - F.when(mapped & other & ~proper, F.lit(S.PROPER)).otherwise(F.lit(0))
    same = F.coalesce(F.col("a.ref_id") == F.col("b.ref_id"), F.lit(False))
    text = F.when(reverse, S.revcomp(F.col("a.m.seq"))).otherwise(F.col("a.m.seq"))
    return sides.select(
        "pair_id",
        F.col("a.m.mate").cast("int").alias("mate"),
        flag.cast("int").alias("flag"),
        F.coalesce("a.rname", F.lit("*")).alias("rname"),
        F.coalesce(F.col("a.pos") + 1, F.lit(0)).alias("pos"),
        F.coalesce("a.mapq", F.lit(0)).alias("mapq"),
        F.coalesce("a.cigar", F.lit("*")).alias("cigar"),
        F.when(same, F.lit("=")).otherwise(F.coalesce("b.rname", F.lit("*"))).alias("rnext"),
        F.coalesce(F.col("b.pos") + 1, F.lit(0)).alias("pnext"),
        F.when(same, template_length(F.col("a.pos"), F.col("a.n"), F.col("b.pos"), F.col("b.n"))).otherwise(F.lit(0)).cast("long").alias("tlen"),
        F.coalesce(F.when(F.length("a.m.seq") > 0, text), F.lit("*")).alias("seq"),
        F.col("a.score").alias("AS"),
        F.when(F.col("a.zs") > 0, F.col("a.zs")).alias("ZS"),
        F.col("a.nm").alias("NM"),
        F.col("a.md").alias("MD"),
        F.coalesce("a.rescued", F.lit(False)).alias("rescued"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """One row over the rows of sam_rows, counted in pairs: processed; aligned, a concordant placement in the end; orphan, placed but not
    concordant before mates were rescued; orphan_recovered, concordant thanks to a rescue. Counts of parts add up."""
    proper, placed = F.col("flag").bitwiseAND(S.PROPER) > 0, F.col("flag").bitwiseAND(S.UNMAPPED) == 0
    pairs = rows.groupBy("pair_id").agg(F.bool_and(proper).alias("proper"), F.bool_or(placed).alias("placed"), F.bool_or("rescued").alias("rescued"))
    late = F.col("placed") & (~F.col("proper") | F.col("rescued"))
    return pairs.agg(F.count("*").alias("processed"), F.count_if("proper").alias("aligned"), F.count_if(late).alias("orphan"), F.count_if(late & F.col("proper")).alias("orphan_recovered"))
