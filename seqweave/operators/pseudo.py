"""Pseudo-matching statistics: how many letters a read has followed the run table without a jump.

A read is walked from its end. In the run of the walk's place that holds the next letter of the read, the walk goes on by LF and the
length grows by one. Elsewhere it jumps to the run of that letter before or behind its place, behind if it has reached the
threshold of that run, goes on from there, and the length is 0; so it is for a letter that the collection does not have.

All that a step asks for is, for the letter and the place, the last run of the letter that begins at or before the place: steps()
keeps with each run where the next of its letter begins and what that one's threshold is. While the table has at most SENT
rows it goes to the tasks, which walk many reads side by side, one letter of each in a step. Larger tables are dealt out by letter
and range of places, and every step is one join of all reads with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .distributed import cut, ranked, running_sum, stored
from .suffix import f_column_of_runs

#: Rows of the step table that go to the tasks, some 60 bytes each.
SENT = 2_000_000
#: Places of one range of a dealt step table; steps between two checkpoints.
RANGE, STEPS_KEPT = 64, 8
LANES = 1 << 22


def steps(run_table: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(c, start, len, before, next_start, next_threshold, f) for each run: places of its letter before it, the next run of the letter
    and its threshold (null and n + 1 for the last), and how many letters of the collection are smaller."""
    n = run_table.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first()["n"]
    order = ["c", "start"]
    rows = run_table.join(thresholds, "run_id").select(F.col("head").alias("c"), "start", "len", "threshold")
    numbered = ranked(rows, order, "k")
    summed = running_sum(rows.select(*order, "len"), "len", order, "place").select(*order, "place")
    behind = numbered.select((F.col("k") - 1).alias("k"), F.col("c").alias("nc"), F.col("start").alias("next_start"), F.col("threshold").alias("next_threshold"))
    letters = f_column_of_runs(run_table)  # a row for each letter; `place` counts the smaller ones too
    same = F.col("nc") == F.col("c")
    out = numbered.join(behind, "k", "left").join(summed, order).join(F.broadcast(letters), "c")
    return out.select("c", "start", "len", (F.col("place") - F.col("f")).alias("before"), F.when(same, F.col("next_start")).alias("next_start"), F.when(same, F.col("next_threshold")).otherwise(n + 1).alias("next_threshold"), "f")


class Walker:
    """The step table as arrays, in order of letter and place."""

    def __init__(self, rows: dict[str, np.ndarray], n: int):
        order = np.lexsort((rows["start"], rows["c"]))
        self.n = n
        self.letters, self.first = np.unique(rows["c"][order], return_index=True)
        self.start, self.stop, self.before, self.threshold = (rows[k][order] for k in ("start", "stop", "before", "next_threshold"))
        self.f = np.append(rows["f"][order][self.first], n)
        self.key = np.searchsorted(self.letters, rows["c"][order]) * (n + 1) + self.start

    def step(self, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places after one letter each, and whether the walk went on without a jump."""
        k = np.searchsorted(self.letters, c)
        known = np.minimum(k, len(self.letters) - 1)
        i = np.searchsorted(self.key, known * (self.n + 1) + at, "right") - 1
        there = (k < len(self.letters)) & (self.letters[known] == c) & (i >= self.first[known])
        i = np.where(there, i, 0)
        inside = there & (at < self.stop[i])
        jumped = self.before[i] + self.stop[i] - self.start[i] - (at < self.threshold[i])
        rank = np.where(inside, self.before[i] + at - self.start[i], np.where(there, jumped, 0))
        return self.f[k] + rank, inside

    def lengths(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Lengths at every letter of reads that lie one behind another in codes."""
        sizes = np.diff(ends, prepend=0)
        order = np.argsort(-sizes, kind="stable")
        sizes, last = sizes[order], ends[order] - 1
        at, length, out = np.full(len(sizes), self.n - 1), np.zeros(len(sizes), np.int32), np.zeros(len(codes), np.int32)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -t, "left"))
            here = last[:m] - t
            at[:m], on = self.step(at[:m], codes[here])
            length[:m] = np.where(on, length[:m] + 1, 0)
            out[here] = length[:m]
        return out


def pseudo_lengths(reads: DataFrame, table: DataFrame, sent: int = SENT) -> DataFrame:
    """(read_id, lengths) of reads (read_id, seq) by a table of steps(): the pseudo-length at each letter. Null and empty reads have an
    empty list, as has every read if the table is empty; repeated rows are walked by themselves."""
    table = stored(table)
    reads = reads.select("read_id", F.coalesce("seq", F.lit("")).alias("seq"))
    n, rows = table.agg(F.coalesce(F.sum("len"), F.lit(0)), F.count("*")).first()
    if not n:
        return reads.select("read_id", F.array().cast("array<int>").alias("lengths"))
    return by_lanes(reads, table, n) if rows <= sent else by_rounds(reads, table, n)


def by_lanes(reads: DataFrame, table: DataFrame, n: int) -> DataFrame:
    rows = table.select("c", "start", (F.col("start") + F.col("len")).alias("stop"), "before", "next_threshold", "f").toArrow()  # at most SENT rows
    shared = reads.sparkSession.sparkContext.broadcast(Walker({c: rows.column(c).to_numpy().astype(np.int64) for c in rows.column_names}, n))
    schema = reads.select("read_id").schema.add("lengths", T.ArrayType(T.IntegerType()))

    def walk(batches):
        walker = shared.value

        def solve(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            ends = np.cumsum([len(t) for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(walker.lengths(codes, ends), pa.int32()))
            return pa.RecordBatch.from_arrays([ids, lists], names=["read_id", "lengths"])

        for batch in batches:
            lo, texts, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= LANES:
                    yield solve(batch.column(0).slice(lo, i + 1 - lo), texts)
                    lo, texts, size = i + 1, [], 0
            if texts:
                yield solve(batch.column(0).slice(lo), texts)

    return reads.mapInArrow(walk, schema)


def by_rounds(reads: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """The same by joins: each run stands in every range of places for which it is the last of its letter, so a range has no more than
    RANGE + 1 runs of a letter, and one row. A round takes one letter of every read that has one left."""
    ranges = F.explode(F.sequence(F.floor(F.col("start") / RANGE), F.floor((F.coalesce("next_start", F.lit(n + 1)) - 1) / RANGE))).alias("bin")
    dealt = table.select("c", ranges, F.struct("start", "len", "before", "next_threshold").alias("run"))
    dealt = stored(dealt.groupBy("c", "bin").agg(F.array_sort(F.collect_list("run")).alias("runs")))
    letters = table.groupBy("c").agg(F.min("f").alias("f"), F.sum("len").alias("m"))
    state = cut(reads.select("read_id", "seq", F.lit(n - 1).cast("long").alias("at"), F.lit(0).alias("length"), F.array().cast("array<int>").alias("lengths")))
    longest = reads.agg(F.coalesce(F.max(F.length("seq")), F.lit(0))).first()[0]
    smaller = F.broadcast(letters.select("c", "f"))  # a row for each letter
    sums = [(r["c"], r["m"]) for r in letters.collect()]
    for t in range(longest):
        left = F.length("seq") > t
        asked = state.withColumn("c", F.when(left, F.ascii(F.substr("seq", F.length("seq") - t, F.lit(1)))))
        asked = asked.join(smaller, "c", "left").join(dealt, (asked["c"] == dealt["c"]) & (F.floor(F.col("at") / RANGE) == dealt["bin"]), "left").select("read_id", "seq", "at", "length", "lengths", asked["c"].alias("c"), "f", "runs")
        below = F.coalesce("f", sum((F.when(F.col("c") > c, m).otherwise(0) for c, m in sums), F.lit(0)))
        asked = asked.withColumn("run", F.try_element_at(F.filter("runs", lambda r: r["start"] <= F.col("at")), F.lit(-1)))
        inside = F.coalesce(F.col("at") < F.col("run.start") + F.col("run.len"), F.lit(False))
        jumped = F.col("run.before") + F.col("run.len") - F.when(F.col("at") < F.col("run.next_threshold"), 1).otherwise(0)
        rank = F.coalesce(F.when(inside, F.col("run.before") + F.col("at") - F.col("run.start")).otherwise(jumped), F.lit(0))
        new = F.when(inside, F.col("length") + 1).otherwise(0)
        state = asked.select("read_id", "seq", F.when(F.col("c").isNull(), F.col("at")).otherwise(below + rank).cast("long").alias("at"), F.when(F.col("c").isNull(), F.col("length")).otherwise(new).alias("length"), F.when(F.col("c").isNull(), F.col("lengths")).otherwise(F.array_append("lengths", new)).alias("lengths"))
        if t % STEPS_KEPT == STEPS_KEPT - 1:
            state = cut(state)
    return state.select("read_id", F.reverse("lengths").alias("lengths"))


def threshold_ranks(run_table: DataFrame, thresholds: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (c, i) with n_before: thresholds of letter c at places before i; the first run of a letter has none. Thresholds and questions
    share one order by letter and place, dealt by range, so neither a frequent letter nor a place meets in one task."""
    numbered = ranked(run_table.select(F.col("head").alias("c"), "run_id"), ["c", "run_id"], "k")
    first = numbered.groupBy("c").agg(F.min("run_id").alias("run_id"))
    marks = numbered.join(first, ["c", "run_id"], "left_anti").join(thresholds, "run_id").select("c", F.col("threshold").alias("i"), F.lit(1).alias("kind"), F.lit(1).alias("one"))
    every = marks.unionByName(asked.select("c", "i", F.lit(0).alias("kind"), F.lit(0).alias("one")).distinct())
    counts = running_sum(every, "one", ["c", "i", "kind"], "q").where("kind = 0").select("c", "i", "q")
    total = every.groupBy("c").agg(F.sum("one").alias("m"))
    base = total.select("c", F.coalesce(F.sum("m").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("m0"))  # a row for each letter
    return asked.join(counts, ["c", "i"]).join(F.broadcast(base), "c").select("c", "i", (F.col("q") - F.col("m0")).cast("long").alias("n_before"))
