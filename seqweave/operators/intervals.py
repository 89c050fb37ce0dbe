"""Matches as intervals of the suffix array: counted, capped and paged without a row for each occurrence.

The suffixes that begin with a match stand in a row, and neighbours among them share its length at least. From the rank of one
occurrence the interval goes to the nearest ranks on either side whose common prefix with the suffix before is shorter. Ranks are cut
into blocks: questions meet the block of their rank, and those that it leaves open go on to the nearest block with a small enough
minimum, which answers them. So the LCP array is dealt out once for each of both steps, whatever the lengths of the intervals, and a
match in a million sequences is one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import collection
from .distributed import stored

#: Ranks of a block, blocks at most (blocks grow beyond that), and questions that meet one copy of a block.
BLOCK, MOST_BLOCKS, ASKED = 1 << 20, 1 << 20, 1 << 22
#: Distinct places and lengths whose intervals go to the tasks, some 110 bytes each; beyond that matches are dealt out to meet them.
SENT = 500_000


class Minima:
    """Minima over stretches of powers of two, to find the nearest smaller value."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            now, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(now[:-half], now[half:]))

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The greatest place up to `at` with a value below `bound`; -1 for none. Stretches that are too great throughout are skipped."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            low = at - (1 << j) + 1
            skip = low >= 0
            skip[skip] = self.levels[j][low[skip]] >= bound[skip]
            at[skip] -= 1 << j
        return at

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least place from `at` on with a value below `bound`; n for none."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            skip = at + (1 << j) <= self.n
            skip[skip] = self.levels[j][at[skip]] >= bound[skip]
            at[skip] += 1 << j
        return at


NEAREST = "side int, at long, len long, found long, next long"


def _answered(rows: DataFrame, least: np.ndarray, block: int, n: int) -> DataFrame:
    """NEAREST of rows (block, copy, kind, side, at, value): the values of a block in order, then its questions."""
    shared = rows.sparkSession.sparkContext.broadcast(least)  # a number for each block

    def answer(batches):
        key, values, inside, blocks = None, [], None, Minima(shared.value)
        for batch in batches:
            b, copy, kind, side, at, value = (batch.column(i).to_numpy() for i in range(6))
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1])
            begin = np.flatnonzero(new)
            for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(b)).tolist(), strict=True):
                if key != (b[lo], copy[lo]):
                    key, values, inside = (b[lo], copy[lo]), [], None
                if not kind[lo]:
                    values.append(value[lo:hi])
                    continue
                inside = inside or Minima(np.concatenate(values))
                mine, base = int(b[lo]), int(b[lo]) * block
                s, a, bound = side[lo:hi], at[lo:hi] - base, value[lo:hi]
                right = s == 1
                found, ahead = np.empty(hi - lo, np.int64), np.full(hi - lo, -1)
                found[~right] = inside.before(a[~right], bound[~right])
                found[right] = inside.after(a[right], bound[right])
                none = np.where(right, found == inside.n, found < 0)
                found += base
                to = np.full(hi - lo, mine)
                to[none & ~right] = blocks.before(to[none & ~right] - 1, bound[none & ~right])
                to[none & right] = blocks.after(to[none & right] + 1, bound[none & right])
                ahead = np.where(right, to * block, to * block + block - 1)
                found = np.where(none & right & (to == blocks.n), n, found)
                none &= ~(right & (to == blocks.n))
                columns = [pa.array(s), pa.array(at[lo:hi]), pa.array(bound), pa.array(found, mask=none), pa.array(ahead, mask=~none)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NEAREST.split(", ")])

    return rows.mapInArrow(answer, NEAREST)


def nearest_smaller(asked: DataFrame, lcps: DataFrame, block: int = BLOCK, per_copy: int = ASKED) -> DataFrame:
    """asked (side, at, len) with found: the greatest rank up to `at` (side 0), or the least from it on (side 1), whose LCP is below
    `len`; the number of ranks where there is none. Each question once. Rank 0 has LCP 0, so side 0 always has one for len from 1 on."""
    ranks = stored(lcps.select(F.col("rank").alias("at"), F.col("lcp").cast("long").alias("value")))
    n = ranks.count()
    block = max(block, -(-n // MOST_BLOCKS))
    ranks = ranks.withColumn("block", F.floor(F.col("at") / block))
    least = ranks.groupBy("block").agg(F.min("value").alias("m")).orderBy("block").toArrow()  # at most MOST_BLOCKS rows
    least = least.column("m").to_numpy()

    def one_step(questions: DataFrame) -> DataFrame:
        questions = stored(questions.select(F.col("side").cast("int").alias("side"), F.col("at").cast("long").alias("at"), F.col("len").cast("long").alias("len")).distinct())
        questions = questions.withColumn("block", F.floor(F.least(F.col("at"), F.lit(max(0, n - 1))) / block))
        # a block with very many questions has copies, each of which takes a part of them; one row for each block
        copies = F.broadcast(questions.groupBy("block").agg(F.ceil(F.count("*") / per_copy).alias("n")))
        table = ranks.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(0).alias("side"), "at", "value")
        mine = questions.join(copies, "block").select("block", F.pmod(F.xxhash64("side", "at", "len"), F.col("n")).alias("copy"), F.lit(1).alias("kind"), "side", "at", F.col("len").alias("value"))
        both = table.unionByName(mine).repartition("block", "copy").sortWithinPartitions("block", "copy", "kind", "at")
        return stored(_answered(both, least, block, n))

    first = one_step(asked)
    beyond = first.where("found IS NULL").select("side", F.least("next", F.lit(n - 1)).alias("at"), "len")
    second = one_step(beyond).select("side", F.col("at").alias("next"), "len", F.col("found").alias("f"))
    went = first.where("found IS NULL").withColumn("next", F.least("next", F.lit(n - 1))).join(second, ["side", "next", "len"]).select("side", "at", "len", F.col("f").alias("found"))
    return first.where("found IS NOT NULL").select("side", "at", "len", "found").unionByName(went)


def of_matches(matches: DataFrame, sa: DataFrame, lcps: DataFrame, block: int = BLOCK, per_copy: int = ASKED) -> DataFrame:
    """matches (place, len and others) with sa_lo and sa_hi, the first and last rank of the suffixes that begin with the match, and n_occ.
    `place` is any occurrence in the text, len is at least 1; matches that are null in either, or shorter, go."""
    known = stored(matches.where("len > 0 AND place IS NOT NULL"))
    # few of very many matches differ in place and length: only these meet the suffix array
    each = stored(known.select("place", "len").distinct().join(sa.select(F.col("i").alias("place"), F.col("rank").alias("_rank")), "place"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_rank").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("_rank") + 1).alias("at")))).alias("x")
    ends = stored(nearest_smaller(each.select(sides, "len").select("x.*", "len"), lcps, block, per_copy))
    lo = ends.where("side = 0").select(F.col("at").alias("_rank"), "len", F.col("found").alias("sa_lo"))
    hi = ends.where("side = 1").select((F.col("at") - 1).alias("_rank"), "len", (F.col("found") - 1).alias("sa_hi"))
    found = stored(each.join(lo, ["_rank", "len"]).join(hi, ["_rank", "len"]).select("place", "len", "sa_lo", "sa_hi"))
    out = known.join(F.broadcast(found) if found.count() <= SENT else found, ["place", "len"])
    return out.select(*matches.columns, "sa_lo", "sa_hi", (F.col("sa_hi") - F.col("sa_lo") + 1).alias("n_occ"))


def page(found: DataFrame, sa: DataFrame, index: DataFrame, first: int, size: int) -> DataFrame:
    """`size` occurrences of each interval from the first-th on, in suffix order, with ref_id and rpos. Rows are made for these only."""
    last = F.least("sa_hi", F.col("sa_lo") + first + size - 1)
    rows = found.where(F.col("n_occ") > first).select("*", F.explode(F.sequence(F.col("sa_lo") + first, last)).alias("rank"))
    places = rows.join(sa.select("rank", F.col("i").alias("pos")), "rank")
    at = collection.locate(places.select("pos").distinct(), index).select("pos", "ref_id", F.col("offset").cast("int").alias("rpos"))
    return places.join(at, "pos").select(*found.columns, "rank", "ref_id", "rpos")


def stats(found: DataFrame, most: float = 0.5) -> DataFrame:
    """Per read: intervals, occurrences, most and least occurrences of one, and the occurrences of those with more than the share `most`."""
    each = found.groupBy("read_id").agg(F.count("*").alias("n_unique"), F.sum("n_occ").alias("total"), F.max("n_occ").alias("max_freq"), F.min("n_occ").alias("min_freq"))
    often = found.join(each.select("read_id", "total"), "read_id").where(F.col("n_occ") > most * F.col("total")).groupBy("read_id").agg(F.sum("n_occ").alias("filtered"))
    return each.join(often, "read_id", "left").na.fill(0, ["filtered"])
