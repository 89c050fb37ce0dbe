"""Suffix structures of a collection as tables: suffix array, BWT, runs, F, LF, neighbours, LCP, thresholds.

The text is the sequences in order of ref_id, each followed by a separator, and a terminator that is smaller than the separator; both
are smaller than any other character. The text is a table of characters, made from pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .collection import BIN, pieces, seqidx
from .distributed import cut, ranked, running_sum, stored

SEPARATOR, TERMINATOR = 2, 1


def characters(refs: DataFrame) -> DataFrame:
    """(i, c): code point c at place i of the text."""
    index = seqidx(refs, 1)
    chars = pieces(refs).select("ref_id", "bin", F.posexplode(F.split("part", "")).alias("j", "ch")).where("ch <> ''").select("ref_id", (F.col("bin") * BIN + F.col("j")).alias("k"), F.ascii("ch").alias("c"))
    text = index.join(chars, "ref_id").select((F.col("start") + F.col("k")).alias("i"), "c")
    seps = index.select((F.col("start") + F.col("len")).alias("i"), F.lit(SEPARATOR).alias("c"))
    end = index.agg(F.coalesce(F.max(F.col("start") + F.col("len") + 1), F.lit(0)).alias("i")).select(F.col("i").cast("long"), F.lit(TERMINATOR).alias("c"))
    return text.unionByName(seps).unionByName(end)


def suffix_array(chars: DataFrame) -> DataFrame:
    """(i, rank) by prefix doubling: ranks of pairs of half-length prefixes until all differ."""
    now = cut(ranked(chars.select("i", F.col("c").cast("long").alias("c")), ["c"], "r", dense=True).select("i", "r"))
    n, step = now.count(), 1
    while True:
        ahead = now.select((F.col("i") - step).alias("i"), F.col("r").alias("s"))
        pairs = now.join(ahead, "i", "left").withColumn("s", F.coalesce("s", F.lit(-1)))
        now = cut(ranked(pairs, ["r", "s"], "q", dense=True).select("i", F.col("q").alias("r")))
        step *= 2
        if step >= n or now.select("r").distinct().count() == n:
            return now.select("i", F.col("r").alias("rank"))


def bwt(chars: DataFrame, sa: DataFrame) -> DataFrame:
    """(rank, i, c): c is the character before suffix i, cyclically."""
    n = sa.count()
    before = chars.select(F.pmod(F.col("i") + 1, F.lit(n)).alias("i"), "c")
    return sa.join(before, "i").select("rank", "i", "c")


def _neighbour(sa: DataFrame, by: int, name: str) -> DataFrame:
    return sa.join(sa.select((F.col("rank") + by).alias("rank"), F.col("i").alias(name)), "rank", "left")


def phi(sa: DataFrame) -> DataFrame:
    """(i, prev): the suffix before i in suffix order; null for the first."""
    return _neighbour(sa, 1, "prev").select("i", "prev")


def phi_inv(sa: DataFrame) -> DataFrame:
    """(i, next): the suffix after i in suffix order; null for the last."""
    return _neighbour(sa, -1, "next").select("i", "next")


def phi_lcp(sa: DataFrame, lcps: DataFrame) -> DataFrame:
    """(i, prev, lcp): the suffix before i in suffix order and what both share; null and 0 for the first."""
    return _neighbour(sa, 1, "prev").join(lcps, "rank").select("i", "prev", "lcp")


def phi_inv_lcp(sa: DataFrame, lcps: DataFrame) -> DataFrame:
    """(i, next, lcp): the suffix after i in suffix order and what both share; null and 0 for the last."""
    after = lcps.select((F.col("rank") - 1).alias("rank"), "lcp")
    return _neighbour(sa, -1, "next").join(after, "rank", "left").select("i", "next", F.coalesce("lcp", F.lit(0).cast("long")).alias("lcp"))


def letter_runs(run_table: DataFrame) -> DataFrame:
    """(head, n_runs): runs of each letter."""
    return run_table.groupBy("head").agg(F.count("*").alias("n_runs"))


def run_select(run_table: DataFrame) -> DataFrame:
    """(head, k, run_id): the k-th run of each letter, from 1."""
    return run_ranks(run_table).select("head", (F.col("run_head_rank") + 1).alias("k"), "run_id")


def letter_ranks(run_table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (run_id, c) with head_rank and run_head_rank: places and runs of letter c before run run_id. Runs and questions share one order
    by letter and run, so the runs of a frequent letter are dealt over tasks."""
    rows = run_table.select(F.col("head").alias("c"), "run_id", F.lit(1).alias("kind"), "len", F.lit(1).alias("one"))
    every = rows.unionByName(asked.select("c", "run_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("len"), F.lit(0).alias("one")).distinct())
    order = ["c", "run_id", "kind"]
    places = running_sum(every, "len", order, "p").where("kind = 0").select("c", "run_id", "p")
    counts = running_sum(every, "one", order, "q").where("kind = 0").select("c", "run_id", "q")
    total = rows.groupBy("c").agg(F.sum("len").alias("n"), F.count("*").alias("m"))
    letters = total.select("c").unionByName(asked.select("c")).distinct().join(total, "c", "left").na.fill(0)
    before = W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)  # a row for each letter
    base = letters.select("c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    out = asked.join(places, ["c", "run_id"]).join(counts, ["c", "run_id"]).join(F.broadcast(base), "c")
    return out.select("run_id", "c", (F.col("p") - F.col("n0")).cast("long").alias("head_rank"), (F.col("q") - F.col("m0")).cast("long").alias("run_head_rank"))


def threshold_offsets(run_table: DataFrame, found: DataFrame) -> DataFrame:
    """One row: least and largest distance of a threshold from the end of the run of the same letter before, and log2 of the largest."""
    off = gaps(run_table).join(found, "run_id").select((F.col("threshold") - F.col("lo")).alias("d"))
    return off.agg(F.min("d").alias("least"), F.max("d").alias("most"), F.round(F.log2(F.max("d") + 1), 6).alias("log2_most"))


def runs(b: DataFrame) -> DataFrame:
    """(run_id, head, start, len, sa_first, sa_last) of the runs of equal characters of the BWT."""
    prev = b.select((F.col("rank") + 1).alias("rank"), F.col("c").alias("pc"))
    starts = b.join(prev, "rank", "left").where("pc IS NULL OR pc <> c").select("rank", F.col("c").alias("head"), F.col("i").alias("sa_first"))
    numbered = ranked(starts, ["rank"], "run_id")
    ends = numbered.select((F.col("run_id") - 1).alias("run_id"), F.col("rank").alias("stop"))
    out = numbered.join(ends, "run_id", "left").withColumn("stop", F.coalesce("stop", F.lit(b.count())))
    last = b.select((F.col("rank") + 1).alias("stop"), F.col("i").alias("sa_last"))
    return out.join(last, "stop").select("run_id", "head", F.col("rank").alias("start"), (F.col("stop") - F.col("rank")).alias("len"), "sa_first", "sa_last")


def f_column(b: DataFrame) -> DataFrame:
    """(c, n, f): occurrences of each character and of all smaller ones; one row for each character."""
    counts = b.groupBy("c").agg(F.count("*").alias("n"))
    return counts.withColumn("f", F.coalesce(F.sum("n").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def f_column_of_runs(run_table: DataFrame) -> DataFrame:
    """(c, f) from runs: occurrences of all smaller characters; one row for each character."""
    counts = run_table.groupBy(F.col("head").alias("c")).agg(F.sum("len").alias("n"))
    return counts.select("c", F.coalesce(F.sum("n").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("f"))


def lf(b: DataFrame) -> DataFrame:
    """(rank, lf): the rank of the suffix that starts one place earlier."""
    return ranked(b.select("rank", "c"), ["c", "rank"], "lf").select("rank", "lf")


def run_ranks(run_table: DataFrame) -> DataFrame:
    """(run_id, head, head_rank, run_head_rank, lf): places and runs of the run's own character before it, and LF of its first place.
    What is broadcast has a row for each character. One order by character and run serves all three, so the runs of a frequent character are dealt over tasks."""
    summed = running_sum(run_table.select("run_id", "head", "len"), "len", ["head", "run_id"], "lf")
    numbered = ranked(run_table.select("run_id", "head"), ["head", "run_id"], "k").select("run_id", "k")
    both = cut(summed.select("run_id", "head", "lf").join(numbered, "run_id"))
    first = both.groupBy("head").agg(F.min("lf").alias("f"), F.min("k").alias("k0"))
    return both.join(F.broadcast(first), "head").select("run_id", "head", (F.col("lf") - F.col("f")).alias("head_rank"), (F.col("k") - F.col("k0")).alias("run_head_rank"), "lf")


def prefix_ranks(chars: DataFrame, n: int) -> list[DataFrame]:
    """(i, r) for prefixes of 1, 2, 4 ... characters at every place that has so many: equal prefixes have equal ranks. Ends when all differ."""
    levels, step = [chars.select("i", F.col("c").cast("long").alias("r"))], 1
    while step < n:
        now = levels[-1]
        ahead = now.select((F.col("i") - step).alias("i"), F.col("r").alias("s"))
        pairs = now.join(ahead, "i")
        levels.append(cut(ranked(pairs, ["r", "s"], "q", dense=True).select("i", F.col("q").alias("r"))))
        step *= 2
        if levels[-1].groupBy("r").count().where("count > 1").isEmpty():
            break
    return levels


def common_extensions(levels: list[DataFrame], asked: DataFrame, bound: int | None = None) -> DataFrame:
    """asked (key, a, b) with lce: how many characters the text shares from places a and b on, at most `bound`; 0 for places outside the
    text. a and b differ. Ranks of prefixes of 2^j characters are compared from long to short, two joins a level."""
    at = asked.withColumn("lce", F.lit(0).cast("long"))
    top = len(levels) - 1 if bound is None else min(len(levels) - 1, max(0, bound.bit_length() - 1))
    for k in range(top, -1, -1):
        left = levels[k].select(F.col("i").alias("_a"), F.col("r").alias("_ra"))
        right = levels[k].select(F.col("i").alias("_b"), F.col("r").alias("_rb"))
        for _ in range(1 if bound is None or k < top else 2):  # a bound can hold the longest stretch twice, less one
            at = at.join(left, F.col("a") + F.col("lce") == F.col("_a"), "left").join(right, F.col("b") + F.col("lce") == F.col("_b"), "left")
            at = cut(at.withColumn("lce", F.col("lce") + F.when(F.col("_ra") == F.col("_rb"), F.lit(1 << k)).otherwise(F.lit(0))).select(*asked.columns, "lce"))
    return at if bound is None else at.withColumn("lce", F.least("lce", F.lit(bound)))


def lcp(chars: DataFrame, sa: DataFrame) -> DataFrame:
    """(rank, lcp) with the suffix before."""
    pairs = _neighbour(sa, 1, "j").where("j IS NOT NULL").select("rank", F.col("i").alias("a"), F.col("j").alias("b"))
    found = common_extensions(prefix_ranks(chars, sa.count()), pairs).select("rank", F.col("lce").alias("lcp"))
    return found.unionByName(sa.where("rank = 0").select("rank", F.lit(0).cast("long").alias("lcp")))


def gaps(run_table: DataFrame) -> DataFrame:
    """(run_id, start, prev, lo): each run that has one of its letter before it, with that one's number and end. Runs are numbered in one order
    by letter, dealt by range, so those of a frequent letter do not meet in one task."""
    numbered = ranked(run_table.select("head", "run_id", "start", "len"), ["head", "run_id"], "k")
    before = numbered.select((F.col("k") + 1).alias("k"), F.col("head").alias("h"), F.col("run_id").alias("prev"), (F.col("start") + F.col("len")).alias("lo"))
    return numbered.join(before, "k").where("h = head").select("run_id", "start", "prev", "lo")


def range_minima(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, a, b) with m: the least of values (i, m) for i from a to b. Two stretches of a power of two cover a range; minima of
    stretches are doubled level by level, and each level answers the ranges of its size."""
    asked = stored(asked.withColumn("j", F.floor(F.log2((F.col("b") - F.col("a") + 1).cast("double"))).cast("int")))
    most = asked.agg(F.max("j")).first()[0]
    level, answers = values, None
    for j in range(0 if most is None else most + 1):
        if j:
            ahead = level.select((F.col("i") - (1 << (j - 1))).alias("i"), F.col("m").alias("m2"))
            level = cut(level.join(ahead, "i").select("i", F.least("m", "m2").alias("m")))
        mine = asked.where(F.col("j") == j)
        left = level.select(F.col("i").alias("a"), F.col("m").alias("m1"))
        right = level.select((F.col("i") + (1 << j) - 1).alias("b"), F.col("m").alias("m2"))
        found = mine.join(left, "a").join(right, "b").select("key", "a", "b", F.least("m1", "m2").alias("m"))
        answers = found if answers is None else answers.unionByName(found)
    return answers if answers is not None else asked.crossJoin(values.limit(0).select("m")).select("key", "a", "b", "m")


def thresholds(run_table: DataFrame, lcps: DataFrame) -> DataFrame:
    """(run_id, threshold): the first place of the least LCP between a run and the run before of the same character; 0 for the first
    run of a character. The runs between both are whole, so one minimum for each run and range minima over runs are enough."""
    every = run_table.select("run_id", "start", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("rank")).join(lcps, "rank")
    low = stored(every.groupBy("run_id").agg(F.min(F.struct("lcp", "rank")).alias("m"), F.min(F.when(F.col("rank") == F.col("start"), F.struct("lcp", "rank"))).alias("own")))
    between = gaps(run_table).select(F.col("run_id").alias("key"), (F.col("prev") + 1).alias("a"), (F.col("run_id") - 1).alias("b"))
    least = range_minima(low.select(F.col("run_id").alias("i"), "m"), between).select(F.col("key").alias("run_id"), "m")
    found = least.join(low.select("run_id", "own"), "run_id").select("run_id", F.least("m", "own")["rank"].alias("threshold"))
    return run_table.select("run_id").join(found, "run_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))


def summary(run_table: DataFrame) -> DataFrame:
    out = run_table.agg(F.sum("len").alias("n"), F.count("*").alias("r"))
    return out.withColumn("n_over_r", F.col("n") / F.col("r")).withColumn("log2_n_over_r", F.log2(F.col("n") / F.col("r")))
