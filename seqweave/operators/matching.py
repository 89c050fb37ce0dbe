"""Exact matches of reads with a collection: common k-mers or sampled seeds, runs on diagonals, maximal intervals, occurrences.

A collection of at most SENT letters goes to the tasks, which look the k-mers of the reads up in a sorted table of its own and put
the places found together to runs; reads are not dealt out. For larger ones both sides are joined on sampled seeds:

Every k letters in a row contain a seed: of their words of `word_size(k)` letters the one with the least hash, the first of equals. Equal
k-mers have equal seeds at equal places, so reads and references are joined on the seeds' hashes alone, about one row for six
letters; with a seed go the starts of the k-mers it stands for and their letters, and each joined pair is compared letter by
letter. Reads are first held against the seeds of the references where these are few enough to be sent to the tasks (KNOWN);
otherwise both are dealt out by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import REVERSE, SECONDARY
from .distributed import spread, stored

STRETCH = 256
#: The columns that name a match.
MATCH = ["read_id", "qs", "qe"]
#: Letters that one step of the seed search takes together; low bits of a hash that give way to places, the same for all texts.
PIECE, PLACES = 1 << 20, 22
#: Distinct hashes of reference seeds that are sent to the tasks, eight bytes each.
KNOWN = 2_000_000
#: Letters of a collection that goes to the tasks as a whole, and pairs of places that one step there takes together.
SENT, PAIRS = 1_000_000, 1 << 20


def word_size(k: int) -> int:
    size = 1
    while 8 * size <= 3 * k:
        size *= 2
    return size


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` letters, a power of two."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = 1
    while n < size:
        h = (h[:-n] ^ (h[:-n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k letters, from those of the longest words of a power of two that begin and end them."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    size = 1 << (k.bit_length() - 1)
    h = word_hashes(codes, size)
    return h if size == k else (h[: len(codes) - k + 1] ^ (h[: len(codes) - k + 1] >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + h[k - size :]


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - width + n], x[width - n :]) if n < width else x


def seeds_of(codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(hash, row, place, first and last k-mer start) of the seeds of rows that begin at `first`, and end where the next begins."""
    size = word_size(k)
    if len(codes) < k:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = word_hashes(codes, size)
    mask = np.uint64((1 << PLACES) - 1)
    best = least_of((h & ~mask) | np.arange(len(h), dtype=np.uint64), k - size + 1)
    ends = np.append(first[1:], len(codes))
    row = np.repeat(np.arange(len(first)), ends - first)[: len(best)]
    whole = np.arange(len(best)) + k <= ends[row]
    at = (best & mask).astype(np.int64)
    new = np.ones(len(best), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new), len(best))
    b = stop[np.searchsorted(stop, a, "right")] - 1
    b = np.minimum(b, ends[row[a]] - k)
    return h[at[a]].view(np.int64), row[a], at[a] - first[row[a]], a - first[row[a]], b - first[row[a]]


SEEDS = "h long, id long, pos int, a int, b int, part string"


def seeds(seqs: DataFrame, k: int, known=None) -> DataFrame:
    """SEEDS of seqs (id, seq): hash, place, starts of the k-mers it stands for, and their letters. With known (a broadcast of sorted
    hashes) only those among it. Null and short sequences have none; long ones are taken piece by piece."""

    def find(batches):
        wanted = known.value if known is not None else None

        def solve(parts):
            text = "".join(t for _, _, t in parts)
            first = np.cumsum([0, *(len(t) for _, _, t in parts)])[:-1]
            h, row, pos, a, b = seeds_of(letters(text), first, k)
            if wanted is not None and len(h):
                at = np.searchsorted(wanted, h)
                hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == h) if len(wanted) else np.zeros(0, np.int64)
                h, row, pos, a, b = (x[hit] for x in (h, row, pos, a, b))
            cut = [parts[r][2][i : j + k] for r, i, j in zip(row.tolist(), a.tolist(), b.tolist(), strict=True)]
            ids, base = np.array([p[0] for p in parts], np.int64)[row], np.array([p[1] for p in parts], np.int64)[row]
            shifted = [pa.array((x + base).astype(np.int32)) for x in (pos, a, b)]
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), *shifted, pa.array(cut, pa.string())], names=["h", "id", "pos", "a", "b", "part"])

        yield from map(solve, pieces_of(batches, k))

    return seqs.mapInArrow(find, SEEDS)


def shared_prefix(x: str, y: str) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:  # x[:lo] == y[:lo], x[:hi] != y[:hi]
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid)
    return lo


def pieces_of(batches, k: int):
    """Lists of (id, place, part) of batches (id, seq), of some PIECE letters: long texts come in parts that share k - 1 letters."""
    parts, size = [], 0
    for batch in batches:
        for who, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            for at in range(0, len(text) - k + 1, PIECE):
                part = text[at : at + PIECE + k - 1]
                if size and size + len(part) > 2 * PIECE:
                    yield parts
                    parts, size = [], 0
                parts.append((who, at, part))
                size += len(part)
    if parts:
        yield parts


class Kmers:
    """Where the k-mers of sequences begin. Of a bit for each of 16 times as many hashes most k-mers that do not occur fall out."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        self.k, self.ids, self.codes = k, np.array(ids, np.int64), letters("".join(texts))
        edges = np.cumsum([0, *map(len, texts)])
        self.first = edges[:-1]
        h = kmer_hashes(self.codes, k)
        self.row = np.repeat(np.arange(len(texts)), np.diff(edges))
        at = np.flatnonzero(np.arange(len(h)) + k <= edges[self.row[: len(h)] + 1]) if len(texts) else np.zeros(0, np.int64)
        order = np.argsort(h[at], kind="stable")
        self.places = at[order]
        self.keys, count = np.unique(h[at], return_counts=True)
        self.begin = np.concatenate([[0], np.cumsum(count)])
        bits = max(10, (16 * len(self.keys)).bit_length())
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def common(self, codes: np.ndarray, edges: np.ndarray):
        """(row, q0, q1, sequence, place of q0) of runs of common k-mers of rows between two edges of codes, as arrays; some PAIRS places at
        a time, so a run can come in parts."""
        h = kmer_hashes(codes, self.k)
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return
        j = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        row = np.searchsorted(edges, at, "right") - 1
        good = (self.keys[j] == h[at]) & (at + self.k <= edges[row + 1])
        at, j, row = at[good], j[good], row[good]
        count = self.begin[j + 1] - self.begin[j]
        total, lo = np.cumsum(count), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - count[lo] + PAIRS, "right")))
            n = count[lo:hi]
            q, of = np.repeat(at[lo:hi], n), np.repeat(row[lo:hi], n)
            r = self.places[np.repeat(self.begin[j[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            same = np.ones(len(q), bool)
            for t in range(self.k):
                same &= codes[q + t] == self.codes[r + t]
            q, of, r = q[same], of[same], r[same]
            order = np.lexsort((q, r - q))
            q, of, r = q[order], of[order], r[order]
            who = self.row[r]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1] + 1) | (r[1:] != r[:-1] + 1) | (of[1:] != of[:-1]) | (who[1:] != who[:-1])
            a = np.flatnonzero(new)
            yield of[a], q[a], q[np.append(a[1:], len(q)) - 1] if len(a) else q[a], who[a], r[a]
            lo = hi


#: `real` tells runs with any letter but N.
RUNS = "read_id long, ref_id long, diag long, q0 long, q1 long, real boolean"


def runs(reads: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """RUNS of common k-mers: those of a read that start from q0 to q1 are equal to those `diag` places further on in the reference. Each
    common k-mer is in one run."""
    refs = refs.where(F.length("seq") >= k).select(F.col("ref_id").cast("long").alias("ref_id"), "seq")
    few = (refs.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0) <= SENT
    return (looked_up if few else seeded)(reads.select(F.col("read_id").cast("long").alias("id"), "seq"), refs, k)


def looked_up(reads: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """RUNS with all of refs in the tasks; reads (id, seq) stay where they are."""
    rows = refs.toArrow()  # at most SENT letters
    shared = reads.sparkSession.sparkContext.broadcast((rows.column("ref_id").to_pylist(), rows.column("seq").to_pylist()))

    def find(batches):
        index = Kmers(*shared.value, k)
        for parts in pieces_of(batches, k):
            codes, edges = letters("".join(t for _, _, t in parts)), np.cumsum([0, *(len(t) for _, _, t in parts)])
            ids, base = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64) - edges[:-1]
            known = np.concatenate([[0], np.cumsum(codes != ord("N"))])
            for row, q0, q1, who, r in index.common(codes, edges):
                shift = base[row]
                columns = [ids[row], index.ids[who], r - index.first[who] - q0 - shift, q0 + shift, q1 + shift]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(known[q1 + k] > known[q0])], names=[c.split()[0] for c in RUNS.split(", ")])

    return spread(reads).mapInArrow(find, RUNS)


def seeded(reads: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """RUNS by a join of reads (id, seq) and refs on their seeds."""
    size = word_size(k)
    theirs = stored(seeds(refs.select(F.col("ref_id").alias("id"), "seq"), k))
    hashes = theirs.select("h").distinct()
    few = hashes.limit(KNOWN + 1).count() <= KNOWN
    known = reads.sparkSession.sparkContext.broadcast(np.sort(hashes.toPandas()["h"].to_numpy(np.int64))) if few else None
    ours = seeds(spread(reads), k, known)
    other = theirs.select("h", F.col("id").alias("ref_id"), F.col("pos").alias("rpos"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("part").alias("rpart"))

    def compare(batches):
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("id", "pos", "a", "b", "part", "ref_id", "rpos", "ra", "rb", "rpart")]
            for who, pos, a, b, x, ref, rpos, ra, rb, y in zip(*cols, strict=True):
                i, j = pos - a, rpos - ra
                if x[i : i + size] != y[j : j + size]:
                    continue
                left = shared_prefix(x[:i][::-1], y[:j][::-1])
                right = shared_prefix(x[i + size :], y[j + size :])
                diag = rpos - pos
                lo, hi = max(a, ra - diag, pos - left), min(b, rb - diag, pos + size + right - k)
                if lo <= hi:
                    out.append((who, ref, diag, lo, hi, x[lo - a : hi - a + k].strip("N") != ""))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_())], names=[c.split()[0] for c in RUNS.split(", ")])

    return ours.join(other, "h").mapInArrow(compare, RUNS)


def kmer_hits(reads: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(read_id, qpos, ref_id, rpos) of every common k-mer."""
    each = runs(reads, refs, k).select("read_id", "ref_id", "diag", F.explode(F.sequence("q0", "q1")).alias("q"))
    return each.select("read_id", F.col("q").cast("int").alias("qpos"), "ref_id", (F.col("diag") + F.col("q")).cast("int").alias("rpos"))


def islands(found: DataFrame, k: int) -> DataFrame:
    """Maximal matches on a diagonal: (read_id, ref_id, rpos, qs, qe, real); runs that follow one another are joined."""
    diagonal = W.partitionBy("read_id", "ref_id", "diag").orderBy("q0")
    new = F.coalesce((F.col("q0") > F.lag("q1").over(diagonal) + 1).cast("int"), F.lit(1))
    out = found.withColumn("_new", new).withColumn("_run", F.sum("_new").over(diagonal)).groupBy("read_id", "ref_id", "diag", "_run").agg(F.min("q0").alias("qs"), (F.max("q1") + k).alias("qe"), F.max("real").alias("real"))
    return out.select("read_id", "ref_id", (F.col("diag") + F.col("qs")).cast("int").alias("rpos"), F.col("qs").cast("int").alias("qs"), F.col("qe").cast("int").alias("qe"), "real")


def maximal(runs: DataFrame) -> DataFrame:
    """Rows of `runs` on read intervals that no other matching interval contains: (read_id, qs, qe, ref_id, rpos), one for each
    occurrence, in no common row or group; intervals of N only go. Which intervals stay is decided on distinct ones; `runs` is read
    twice, so give it stored."""
    before = W.partitionBy("read_id").orderBy("qs", F.desc("qe")).rowsBetween(W.unboundedPreceding, -1)
    each = runs.select(*MATCH, "real").distinct()
    top = each.withColumn("_reach", F.max("qe").over(before)).where("_reach IS NULL OR qe > _reach").drop("_reach")
    return runs.join(top.where("real").drop("real"), MATCH, "left_semi").select(*MATCH, "ref_id", "rpos")


def smems(reads: DataFrame, refs: DataFrame, k: int = 25) -> DataFrame:
    """(read_id, qs, qe, ref_id, rpos): each occurrence of each super-maximal exact match of at least k characters."""
    return maximal(stored(islands(runs(reads, refs, k), k)))


def with_halves(reads: DataFrame, refs: DataFrame, k: int = 25) -> DataFrame:
    """Super-maximal matches and, of those of at least 2k characters, both halves with all occurrences of their own: (read_id, qs, qe,
    half, ref_id, rpos), half 0 for the match, 1 and 2 for its left and right part. Occurrences of a half are the diagonal matches around it."""
    found = stored(islands(runs(reads, refs, k), k))
    whole = stored(maximal(found).withColumn("half", F.lit(0)).select(*MATCH, "half", "ref_id", "rpos"))
    n, mid = F.col("qe") - F.col("qs"), F.col("qs") + F.floor((F.col("qe") - F.col("qs")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("qs").alias("qs"), mid.alias("qe"), F.lit(1).alias("half")), F.struct(mid.alias("qs"), F.col("qe").alias("qe"), F.lit(2).alias("half"))))
    halves = whole.select(*MATCH).distinct().where(n >= 2 * k).select("read_id", both.alias("p")).select("read_id", "p.*")
    around = found.select("read_id", "ref_id", "rpos", F.col("qs").alias("_qs"), F.col("qe").alias("_qe"))
    met = halves.join(around, "read_id").where("_qs <= qs AND _qe >= qe").select(*MATCH, "half", "ref_id", (F.col("rpos") + F.col("qs") - F.col("_qs")).alias("rpos"))
    return whole.unionByName(met)


def keys(mems: DataFrame) -> list[str]:
    """The columns that name a match: all but those of its occurrence."""
    return [c for c in mems.columns if c not in ("ref_id", "rpos")]


def intervals(mems: DataFrame) -> DataFrame:
    """Each match once with n_occ, counted where its occurrences are first."""
    return mems.groupBy(*keys(mems)).agg(F.count("*").alias("n_occ"))


def of_matches(mems: DataFrame, kept: DataFrame) -> DataFrame:
    """The occurrences of the matches in `kept`."""
    return mems.join(kept, keys(mems), "left_semi").select(*mems.columns)


def occurrences(mems: DataFrame) -> DataFrame:
    return mems.select(*MATCH, "ref_id", "rpos")


def longest(mems: DataFrame) -> DataFrame:
    """The longest match of each read, the first of equals."""
    best = mems.groupBy("read_id").agg(F.max_by(F.struct("qs", "qe"), F.struct(F.col("qe") - F.col("qs"), -F.col("qs"))).alias("m"))
    return best.select("read_id", "m.qs", "m.qe")


def seed_cap(occ: DataFrame, cap: int) -> DataFrame:
    """At most `cap` occurrences of a match in each reference, the first by place."""
    order = W.partitionBy("read_id", "qs", "qe", "ref_id").orderBy("rpos")
    return occ.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def capped(mems: DataFrame, cap: int) -> DataFrame:
    """mems with at most `cap` occurrences of a match in each reference, the first by place. Spark keeps `cap` of a task before it
    deals them out (for caps up to spark.sql.optimizer.windowGroupLimitThreshold)."""
    order = W.partitionBy(*keys(mems), "ref_id").orderBy("rpos")
    return mems.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def frequency_filter(found: DataFrame, most: float) -> DataFrame:
    """`intervals` without the matches with more than this share of all occurrences of their read, and that share."""
    return found.withColumn("share", F.col("n_occ") / F.sum("n_occ").over(W.partitionBy("read_id"))).where(F.col("share") <= most)


def direction_filter(mems: DataFrame, margin: float, by: str = "read_id") -> DataFrame:
    """Drops, of each group `by` of `intervals`, the direction (column dir, 0 or 1) whose matches are shorter on average by more than `margin`."""
    group = W.partitionBy(by)
    mean = lambda d: F.coalesce(F.avg(F.when(F.col("dir") == d, F.col("qe") - F.col("qs"))).over(group), F.lit(0.0))
    lead = mems.withColumn("_lead", mean(0) - mean(1))
    return lead.where(F.when(F.col("dir") == 0, -F.col("_lead")).otherwise(F.col("_lead")) <= margin).drop("_lead")


def paired_directions(mems: DataFrame) -> DataFrame:
    """mems of stranded mates (read_id = 4 * pair + 2 * mate + strand) with pair_id and dir: 0 for the first mate forward with the second
    reversed, 1 for the other way round."""
    bits = F.floor(F.col("read_id") / 2) + F.col("read_id")
    return mems.withColumn("pair_id", F.floor(F.col("read_id") / 4)).withColumn("dir", F.pmod(bits, F.lit(2)).cast("int"))


def mem_stats(mems: DataFrame, most: float = 0.5) -> DataFrame:
    """Per read: matches, occurrences, largest and least occurrences of a match, and of a match in one reference, and the occurrences of
    those matches that the frequency filter with `most` drops."""
    occ = occurrences(mems).groupBy("read_id", "qs", "qe", "ref_id").count()
    seeds = occ.groupBy("read_id", "qs", "qe").agg(F.sum("count").alias("n"), F.max("count").alias("hi"), F.min("count").alias("lo"))
    dropped = F.col("n") > most * F.sum("n").over(W.partitionBy("read_id"))
    seeds = seeds.withColumn("gone", F.when(dropped, F.col("n")).otherwise(F.lit(0)))
    return seeds.groupBy("read_id").agg(F.count("*").alias("n_unique"), F.sum("n").alias("total"), F.max("n").alias("max_freq"), F.min("n").alias("min_freq"), F.max("hi").alias("highest_occ"), F.min("lo").alias("lowest_occ"), F.sum("gone").alias("filtered"))


def averages(mems: DataFrame, reads: DataFrame) -> DataFrame:
    """Per read: mean length of its matches, the mean weighted by occurrences, the number of matches over the sum of read length by
    match length (to six places), and the length of all occurrences together."""
    n, w = F.col("n_occ"), (F.col("qe") - F.col("qs")).cast("long")
    sized = intervals(mems).join(reads.select("read_id", F.length("seq").alias("_n")), "read_id")
    return sized.groupBy("read_id").agg(F.avg(w).alias("mean"), (F.sum(w * n) / F.sum(n)).alias("weighted"), F.round(F.count("*") / F.sum(F.col("_n") / w), 6).alias("harmonic"), F.sum(w * n).alias("total_len"))


def mem_sam(mems: DataFrame, reads: DataFrame, names: DataFrame, stranded: bool = False) -> DataFrame:
    """One secondary SAM record for each occurrence of each match: flag 256, CIGAR of one M run, the matching part of the read. With
    `stranded` the ids are 2 * read_id + strand; records of strand 1 have flag 272 and the part of the reverse complement."""
    n = F.col("qe") - F.col("qs")
    strand = F.pmod("read_id", F.lit(2)).cast("int") if stranded else F.lit(0)
    who = F.floor(F.col("read_id") / 2) if stranded else F.col("read_id")
    rows = occurrences(mems).join(reads.select("read_id", "seq"), "read_id").join(names, "ref_id")
    return rows.select(who.cast("string").alias("qname"), (SECONDARY + REVERSE * strand).alias("flag"), F.col("name").alias("rname"), (F.col("rpos") + 1).cast("long").alias("pos"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.substr("seq", F.col("qs") + 1, n).alias("match"))
