"""Matching statistics: for each place of a read, the longest prefix of the rest that occurs in the collection, and a place where it does.

From k characters on they follow from the maximal matches. Below k they follow from the words of k - 1 characters that begin at the
places of the collection, in order: the longest prefix of a place of a read that occurs is the longer one of what it shares with
the two words between which it falls, and the words with that prefix are neighbours. While there are at most WORDS_SENT
distinct words they go to the tasks, and reads are only dealt out to meet their maximal matches. Beyond that the length is
found by halving steps, each an equality join of all places with the distinct words of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .distributed import stored
from .matching import STRETCH, letters

#: Distinct words of the collection that go to the tasks, and places of a read that are looked up at a time.
WORDS_SENT, AT_ONCE = 250_000, 1 << 16


def places(reads: DataFrame, width: int) -> DataFrame:
    """(read_id, i, ahead): every place of a read and up to `width` characters from there. Null and empty reads have none."""
    stretch = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(STRETCH))).alias("at")
    parts = reads.where(F.length("seq") > 0).select("read_id", "seq", stretch).select("read_id", "at", F.substr("seq", F.col("at") + 1, F.lit(STRETCH + width - 1)).alias("part"))
    inner = F.explode(F.sequence(F.lit(0), F.least(F.lit(STRETCH), F.length("part")) - 1)).alias("j")
    whole = parts.withColumn("left", F.length("part")).select("read_id", "at", "part", inner)
    return whole.select("read_id", (F.col("at") + F.col("j")).alias("i"), F.substr("part", F.col("j") + 1, F.lit(width)).alias("ahead"))


def word_ends(refs: DataFrame, index: DataFrame, longest: int) -> DataFrame:
    """(ahead, at): the distinct words of `longest` characters, or less at an end of a sequence, and the first place of each."""
    ends = places(refs.select(F.col("ref_id").alias("read_id"), "seq"), longest).withColumnRenamed("read_id", "ref_id").join(index.select("ref_id", "start"), "ref_id")
    return ends.groupBy("ahead").agg(F.min(F.col("start") + F.col("i")).alias("at"))


def words(ends: DataFrame) -> DataFrame:
    """(word, at): all prefixes of the words in ends, and the first place of each."""
    size = F.explode(F.sequence(F.lit(1), F.length("ahead"))).alias("n")
    return ends.select("ahead", "at", size).select(F.substr("ahead", F.lit(1), F.col("n")).alias("word"), "at").groupBy("word").agg(F.min("at").alias("at"))


def short_lengths(reads: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(read_id, i, len, at) capped at k - 1: prefixes of a matching word match, so the length is found bit by bit."""
    known = stored(words(ends))
    now = places(reads, k - 1).withColumns({"len": F.lit(0), "at": F.lit(-1).cast("long")})
    step = 1 << max(0, (k - 1).bit_length() - 1)
    while step:
        tried = now.withColumn("word", F.when(F.col("len") + step <= F.length("ahead"), F.substr("ahead", F.lit(1), F.col("len") + step)))
        hit = known.select("word", F.lit(step).alias("_step"), F.col("at").alias("_at"))
        now = tried.join(hit, "word", "left").select("read_id", "i", "ahead", (F.col("len") + F.coalesce("_step", F.lit(0))).alias("len"), F.coalesce("_at", "at").alias("at"))
        step //= 2
    return now.select("read_id", "i", "len", "at")


class SortedWords:
    """Words of at most `width` letters in order, each letter a number from 1 on, with the first place of each."""

    def __init__(self, words: list[str], at: np.ndarray, width: int):
        self.width = width
        codes = letters("".join(words))
        self.alphabet = np.unique(codes)
        self.kind = np.dtype(np.uint8 if len(self.alphabet) < 250 else ">u4")
        sizes = np.array([len(w) for w in words], np.int64)
        table = np.zeros((len(words), width), self.kind)
        table[np.arange(width) < sizes[:, None]] = np.searchsorted(self.alphabet, codes) + 1
        keys = self._keys(table)
        order = np.argsort(keys, kind="stable")
        self.table, self.keys, self.least = table[order], keys[order], [at[order]]
        self.flat = self.small = None
        if self.kind == np.uint8 and len(self.alphabet) and self.alphabet[-1] < 1 << 16:
            self.small = np.full(int(self.alphabet[-1]) + 2, len(self.alphabet) + 1, np.uint8)
            self.small[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.steps = self._steps() if self.kind == np.uint8 else None

    def _steps(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first letter, letters, keys, first words) of the steps of a search: 8 letters, then 5 at a time behind the number of what came before, so
        that a key is one number and keys are in the order of the words."""
        out, at, group = [], 0, np.zeros(len(self.table), np.uint64)
        while at < self.width:
            n = 5 if at else 8
            part = np.zeros((len(self.table), n), np.uint8)
            part[:, : min(n, self.width - at)] = self.table[:, at : at + n]
            key = group << np.uint64(40) if at else group
            for j in range(n):
                key = key | (part[:, j].astype(np.uint64) << np.uint64(8 * (n - 1 - j)))
            known, begin, group = np.unique(key, return_index=True, return_inverse=True)
            group = group.astype(np.uint64)
            out.append((at, n, known, np.append(begin, len(self.table))))
            at += n
        return out

    def _keys(self, table: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(table).view(f"S{self.width * self.kind.itemsize}").reshape(-1)

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least place among words [lo, hi), by minima over stretches of powers of two."""
        if self.flat is None:
            while 2 << (len(self.least) - 1) <= len(self.keys):
                now, half = self.least[-1], 1 << (len(self.least) - 1)
                self.least.append(np.minimum(now[:-half], now[half:]))
            self.flat = np.concatenate(self.least)
            self.offset = np.cumsum([0, *map(len, self.least)])[:-1]
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        base = self.offset[level]
        return np.minimum(self.flat[base + lo], self.flat[base + hi - (np.int64(1) << level)])

    def numbers(self, text: str) -> np.ndarray:
        codes = letters(text)
        if self.small is not None:
            return self.small[np.minimum(codes, len(self.small) - 1)]
        k = np.minimum(np.searchsorted(self.alphabet, codes), max(0, len(self.alphabet) - 1))
        known = self.alphabet[k] == codes if len(self.alphabet) else np.zeros(len(codes), bool)
        return np.where(known, k + 1, len(self.alphabet) + 1).astype(self.kind)

    def longest(self, numbers: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Length and first place of the longest prefix that occurs, at the places [first, last) of a read; 0 and -1 for none."""
        n, width = last - first, self.width
        if not len(self.keys):
            return np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if self.steps is not None:
            return self._stepped(numbers, first, last)
        part = np.zeros(n + width - 1, self.kind)
        ahead = numbers[first : min(len(numbers), last + width - 1)]
        part[: len(ahead)] = ahead
        asked = np.lib.stride_tricks.sliding_window_view(part, width)
        at = np.searchsorted(self.keys, self._keys(asked))
        length = np.zeros(n, np.int64)
        for k in (at - 1, at):
            there = (k >= 0) & (k < len(self.keys))
            same = (self.table[np.clip(k, 0, len(self.keys) - 1)] == asked) & (asked > 0)
            length = np.maximum(length, np.where(there, np.where(same.all(axis=1), width, same.argmin(axis=1)), 0))
        inside = np.arange(width) < length[:, None]
        top = np.iinfo(self.kind).max
        lo = np.searchsorted(self.keys, self._keys(np.where(inside, asked, 0).astype(self.kind)))
        hi = np.searchsorted(self.keys, self._keys(np.where(inside, asked, top).astype(self.kind)), "right")
        hit = length > 0
        place = np.full(n, -1, np.int64)
        place[hit] = self._least(lo[hit], hi[hit])
        return length, place


    def _stepped(self, numbers: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """`longest` with letters packed to numbers. Places that share all letters of a step with some word go on to the next one."""
        n = last - first
        part = np.zeros(n + self.width + 16, np.uint64)
        ahead = numbers[first : min(len(numbers), last + self.width + 8)]
        part[: len(ahead)] = ahead
        for k in (1, 2, 4):  # 8 letters from each place on
            part = (part[:-k] << np.uint64(8 * k)) | part[k:]
        length, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        i, group = np.arange(n), np.zeros(n, np.uint64)
        for at, size, known, begin in self.steps:
            key = part[i + at] if not at else (part[i + at] >> np.uint64(24)) | (group << np.uint64(40))
            j = np.searchsorted(known, key)
            a, b = known[np.maximum(j - 1, 0)] ^ key, known[np.minimum(j, len(known) - 1)] ^ key
            near = np.minimum(a, b)  # the nearer of both neighbours shares more
            shared = sum(((near >> np.uint64(8 * t)) == 0).astype(np.int64) for t in range(size))
            left = np.minimum(len(numbers) - first, n + self.width) - i - at  # letters that the read, or a word, still has
            left = np.minimum(left, self.width - at)
            on = (shared == size) & (left > size)
            end = ~on
            e, m = i[end], np.minimum(shared[end], left[end])
            free = np.array([(1 << (8 * (size - t))) - 1 for t in range(size + 1)], np.uint64)[m]
            length[e] = at + m
            lo[e] = begin[np.searchsorted(known, key[end] & ~free)]
            hi[e] = begin[np.searchsorted(known, key[end] | free, "right")]
            i, group = i[on], j[on].astype(np.uint64)
            if not len(i):
                break
        hit = length > 0
        place = np.full(n, -1, np.int64)
        place[hit] = self._least(lo[hit], hi[hit])
        return length, place


def searched(reads: DataFrame, first: DataFrame, words_of: DataFrame, k: int) -> DataFrame:
    """(read_id, lengths, pointers) with the words in the tasks; first (read_id, qs, qe, p): maximal matches and a place of each."""
    rows = words_of.toArrow()  # at most WORDS_SENT rows of k - 1 characters
    shared = reads.sparkSession.sparkContext.broadcast((rows.column("ahead").to_pylist(), rows.column("at").to_numpy().astype(np.int64)))
    matches = first.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("qe", "qs", "p"))).alias("m"))  # no more than letters of the read
    both = reads.where(F.length("seq") > 0).select("read_id", "seq").join(matches, "read_id", "left").select("read_id", "seq", "m")
    schema = T.StructType([both.schema["read_id"], T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("pointers", T.ArrayType(T.LongType()))])

    def work(batches):
        words = SortedWords(*shared.value, k - 1)
        for batch in batches:
            for i, (text, found) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                numbers = words.numbers(text.as_py())
                n = len(numbers)
                length, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
                for lo in range(0, n, AT_ONCE):
                    hi = min(n, lo + AT_ONCE)
                    length[lo:hi], place[lo:hi] = words.longest(numbers, lo, hi)
                for m in found.as_py() or ():  # later ends are longer wherever both hold
                    here = np.arange(m["qs"], m["qe"] - k + 1)
                    length[here], place[here] = m["qe"] - here, m["p"] + here - m["qs"]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(x, t)) for x, t in ((length.astype(np.int32), pa.int32()), (place, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *lists], names=["read_id", "lengths", "pointers"])

    return both.mapInArrow(work, schema)


def matching_statistics(reads: DataFrame, refs: DataFrame, index: DataFrame, mems: DataFrame, k: int, sent: int = WORDS_SENT) -> DataFrame:
    """(read_id, lengths, pointers): for each place, in order, the length and a place in the collection where it begins (-1 for length
    0): the first one of the word below k characters, else of the maximal match it lies in. mems are the maximal matches of at
    least k characters. Null and empty reads have no row."""
    occ = mems.join(index.select("ref_id", "start"), "ref_id")
    first = occ.groupBy("read_id", "qs", "qe").agg(F.min(F.col("start") + F.col("rpos")).alias("p"))
    ends = stored(word_ends(refs, index, k - 1))
    if ends.count() <= sent:
        return searched(reads, first, ends, k)
    covered = first.select("read_id", F.explode(F.sequence("qs", F.col("qe") - k)).alias("i"), "qs", "qe", "p").select("read_id", "i", (F.col("qe") - F.col("i")).alias("len"), (F.col("p") + F.col("i") - F.col("qs")).alias("at"))
    both = short_lengths(reads, ends, k).unionByName(covered).groupBy("read_id", "i").agg(F.max(F.struct("len", "at")).alias("m"))
    rows = both.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("i", "m.len", "m.at"))).alias("all"))
    return rows.select("read_id", F.col("all.len").alias("lengths"), F.col("all.at").alias("pointers"))


def mem_list(lengths: Column) -> Column:
    """(idx, len) of the places whose length is not below the one before; there is no least length."""
    pairs = F.transform(lengths, lambda n, i: F.struct(i.alias("idx"), n.alias("len")))
    return F.filter(pairs, lambda p, i: (i == 0) | (p["len"] >= F.get(lengths, i - 1)))
