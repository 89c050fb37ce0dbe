"""Best-fit packing (operator 7): best-fit decreasing with a segment tree over remaining capacities.

Which bin best-fit decreasing gives a piece depends on lengths alone, and lengths are whole numbers up to the
capacity. So the plan is made for the histogram of lengths (at most `capacity` rows, however many documents there
are): open bins are kept as ranges of sequence numbers by what is left in them, a segment tree over what is left
finds the tightest open bin in logarithmic time, and all pieces of one length that go to equally full bins are
placed together. The plan is a list of ranges (length, ranks) -> (sequences, offset); its size follows the capacity,
not the corpus. Spark numbers the pieces within each length, in salted groups, and looks the ranges up.

Edge cases: null or empty text is a document of one end token; repeated rows are packed as often as they occur; an
empty table gives no rows; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored, table

CAPACITY, END = 1024, 2
#: Pieces of one length are numbered in groups of about this many.
RANKED = 200_000
#: From this many characters without a blank, the slower of two equal tokenizers takes the text.
LONG_RUN = 20_000


class Tokenizer:
    """ids of the public byte-level BPE: a rank-based encoder, and the reference one for texts with huge words."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import base64
        import re

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer as Slow

        with open(ranks or P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.slow = Slow.from_file(path or P.path("byte_bpe_50k.json"))
        self.special = {k: v for k, v in self.slow.get_vocab(with_added_tokens=True).items() if v >= len(merges)}
        self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=merges, special_tokens=self.special)
        self.huge = re.compile(rf"\S{{{LONG_RUN},}}|\s{{{LONG_RUN},}}")

    def __call__(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and self.huge.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document's ids; keep_ids adds the ids themselves."""

    def cut_up(batches):
        encode = Tokenizer(tokenizer)
        for batch in batches:
            out, kept = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[at:stop]
                    out.append((doc, k, at, stop - at, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                    at = stop
            cols = list(zip(*out, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_up, PIECES + (", ids array<int>" if keep_ids else ""))


class Capacities:
    """Segment tree over what is left in open bins: finds the least remainder of at least x that some bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, left: int, n: int) -> None:
        k = left + self.size
        while k:
            self.tree[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        k = least + self.size
        if self.tree[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.tree[k + 1]:  # a right sibling holds larger remainders
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of histogram[length] pieces. Rows (length, rank_from, rank_to, sequence, each, offset): the piece
    of rank r goes to sequence + (r - rank_from) // each, at offset + length * ((r - rank_from) % each)."""
    tree, open_bins, plan, bins = Capacities(capacity), defaultdict(list), [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            open_bins[left].append((first, n))
            tree.add(left, n)

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                first, n = open_bins[left].pop()
                tree.add(left, -n)
            each = left // length
            full = min(n, todo // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if todo and full < n:  # the last of these bins gets what remains
                plan.append((length, rank, rank + todo, first + full, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                full, rank, todo = full + 1, rank + todo, 0
            put(left, first + full, n - full)
    return plan


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (of pieces()) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = stored(parts)
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, salts long")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(key, F.col("salts"))).drop("salts")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = ranked.join(shifts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    plan = best_fit(histogram, capacity)
    ranges = spark.createDataFrame(plan, "length long, rank_from long, rank_to long, sequence long, each long, base long")
    ranges = F.broadcast(ranges) if len(plan) <= 200_000 else ranges
    at = F.col("rank") - F.col("rank_from")
    return ranked.join(ranges, "length").where("rank >= rank_from AND rank < rank_to").select(
        *parts.columns,
        F.expr("sequence + (rank - rank_from) div each").alias("sequence_id"),
        (F.col("base") + F.col("length") * F.pmod(at, F.col("each"))).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    return packed(pieces(docs, capacity, end, tokenizer, keep_ids), capacity)


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
