"""Alignment of reads along chains: extension at both ends, gaps between anchors, CIGAR, MD, edit distance, mapping quality.

Spark deals out the candidates (a chain with its read and the window of its sequence); the kernel aligns one at a time. A gap of l
letters costs the less of gap_open + l * gap_extend and gap_open2 + l * gap_extend2; ties are settled for the diagonal, then for a deletion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalars as S
from . import chaining, collection, matching
from .distributed import stored

LOW = -(1 << 28)
TILE = 512


@dataclass(frozen=True)
class AlignConfig:
    match: int = 2
    mismatch: int = 4
    gap_open: int = 4
    gap_extend: int = 2
    gap_open2: int = 13
    gap_extend2: int = 1
    context: int = 100
    top_scores: int = 4
    min_len: int = 25
    per_ref: int = 1000
    most_share: float | None = None
    halves: bool = False
    direction: float | None = None
    apart: int = 0

    def gap(self, n: int) -> int:
        return min(self.gap_open + n * self.gap_extend, self.gap_open2 + n * self.gap_extend2)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def aligned(query: str, ref: str, cfg: AlignConfig = AlignConfig(), free_end: bool = False, free_start: bool = False) -> tuple[int, str]:
    """Score and operations (M, I, D) of the whole query against the whole ref, or with free_end against the prefix of ref that
    scores best (the shortest of equals); with free_start the letters of ref before the first pair cost nothing and show as leading D.
    Each row is one vector operation: the best deletion ending in a column is a running
    maximum along the row."""
    q, r = _codes(query), _codes(ref)
    n, m = len(q), len(r)
    costs = ((cfg.gap_open, cfg.gap_extend), (cfg.gap_open2, cfg.gap_extend2))
    columns = np.arange(m + 1, dtype=np.int64)
    best = np.full((n + 1, m + 1), LOW, np.int64)
    down, side = (np.full((2, n + 1, m + 1), LOW, np.int64) for _ in range(2))
    for g, (start, more) in enumerate(costs):
        side[g, 0, 1:] = -start - more * columns[1:]
    best[0], best[0, 0] = 0 if free_start else side[:, 0].max(axis=0), 0
    unknown = ord("N")
    for i in range(1, n + 1):
        for g, (start, more) in enumerate(costs):
            down[g, i] = np.maximum(best[i - 1] - start, down[g, i - 1]) - more
        now = down[:, i].max(axis=0)
        pair = np.where(r == q[i - 1], cfg.match, -cfg.mismatch)
        pair = np.where((r == unknown) | (q[i - 1] == unknown), 0, pair)
        now[1:] = np.maximum(now[1:], best[i - 1, :-1] + pair)
        for g, (start, more) in enumerate(costs):
            side[g, i, 1:] = np.maximum.accumulate(now[:-1] + more * columns[:-1]) - start - more * columns[1:]
        best[i] = np.maximum(now, side[:, i].max(axis=0))
    j = int(best[n].argmax()) if free_end else m
    score, i, ops, state, g = int(best[n, j]), n, [], "M", 0
    while i or j:
        if free_start and not i:
            ops.append("D" * j)
            break
        if state == "M":
            if i and j:
                s = 0 if unknown in (q[i - 1], r[j - 1]) else cfg.match if q[i - 1] == r[j - 1] else -cfg.mismatch
                if best[i, j] == best[i - 1, j - 1] + s:
                    ops.append("M")
                    i, j = i - 1, j - 1
                    continue
            state = "D" if j and best[i, j] in side[:, i, j] else "I"
            g = int(((side if state == "D" else down)[:, i, j] != best[i, j]).argmin())
        more = costs[g][1]
        if state == "D":
            ops.append("D")
            state = "D" if j > 1 and side[g, i, j] == side[g, i, j - 1] - more else "M"
            j -= 1
        else:
            ops.append("I")
            state = "I" if i > 1 and down[g, i, j] == down[g, i - 1, j] - more else "M"
            i -= 1
    return score, "".join(reversed(ops))


def extended(query: str, ref: str, cfg: AlignConfig = AlignConfig()) -> str:
    """Operations of the whole query from the start of ref. Longer queries go on tile by tile, so that memory does not grow with
    their length; within a tile the alignment is the best one."""
    ops, at = [], 0
    for k in range(0, len(query), TILE):
        part = query[k : k + TILE]
        ops.append(aligned(part, ref[at : at + len(part) + cfg.context], cfg, free_end=True)[1])
        at += sum(o != "I" for o in ops[-1])
    return "".join(ops)


def along(read: str, ref: str, steps: list[tuple[int, int, int]], cfg: AlignConfig = AlignConfig()) -> tuple[int, str]:
    """Start in ref and operations of the read aligned along the anchors (end in ref, end in read, length) of a chain. Where an anchor
    overlaps the one before in read or ref, both are aligned anew from end to end, or, if they are long, the overlap and `context`
    letters (TILE at most) on either side; so are further anchors that overlap a stretch of this kind, up to TILE letters in all. An
    anchor that ends no later than the one before in read or ref, once its overlap is cut off, is left out."""
    x, y, w = steps[0]
    x0, y0 = x - w + 1, y - w + 1
    left = extended(read[:y0][::-1], ref[max(0, x0 - y0 - cfg.context) : x0][::-1], cfg)[::-1]
    ops, tail, anew = [left], w, None  # tail: letters of the pairs that end at (x, y), not yet among ops; anew: where ops of a stretch begin
    for nx, ny, nw in steps[1:]:
        sx, sy = nx - nw + 1, ny - nw + 1
        cut = max(0, x + 1 - sx, y + 1 - sy)
        if cut >= nw:
            continue
        if cut:
            reach = min(TILE, cut + cfg.context)
            back, ahead = min(tail, reach), min(nw - cut, reach)
            bx, by, ex, ey = x + 1 - back, y + 1 - back, sx + cut + ahead, sy + cut + ahead
            if anew and back == tail and max(ex - anew[1], ey - anew[2]) <= TILE:
                at, bx, by = anew
                del ops[at:]
            else:
                ops.append("M" * (tail - back))
            anew = len(ops), bx, by
            ops.append(aligned(read[by:ey], ref[bx:ex], cfg)[1])
            tail = nw - cut - ahead
        else:
            query, target = read[y + 1 : sy], ref[x + 1 : sx]
            ops.append("M" * tail)
            ops.append(aligned(query, target, cfg)[1] if query and target else "I" * len(query) + "D" * len(target))
            tail, anew = nw, None
        x, y = nx, ny
    ops.append("M" * tail)
    rest = read[y + 1 :]
    ops.append(extended(rest, ref[x + 1 : x + 1 + len(rest) + cfg.context], cfg))
    return x0 - sum(o != "I" for o in left), "".join(ops)


def described(read: str, ref: str, ops: str, cfg: AlignConfig = AlignConfig()) -> tuple[int, str, str, int]:
    """Score, CIGAR, MD and edit distance of operations that take the read along ref from its first letter. Every MD letter stands
    between two numbers, as SAM asks."""
    score, runs, md, same, edits, i, j = 0, [], [], 0, 0, 0, 0
    for op, group in groupby(ops):
        n = len(list(group))
        runs.append(f"{n}{op}")
        if op == "M":
            for a, b in zip(read[i : i + n], ref[j : j + n], strict=True):
                if a == b:
                    same += 1
                else:
                    md += [str(same), b]
                    same = 0
                    edits += 1
                score += 0 if "N" in (a, b) else cfg.match if a == b else -cfg.mismatch
            i, j = i + n, j + n
            continue
        score -= cfg.gap(n)
        edits += n
        if op == "D":
            md += [str(same), "^" + ref[j : j + n]]
            same, j = 0, j + n
        else:
            i += n
    return score, "".join(runs), "".join(md) + str(same), edits


def stranded(reads: DataFrame) -> DataFrame:
    """Reads and their reverse complements: read_id becomes 2 * read_id + strand."""
    strand = F.explode(F.array(F.lit(0), F.lit(1))).alias("strand")
    both = reads.select("read_id", "seq", strand)
    return both.select((F.col("read_id") * 2 + F.col("strand")).alias("read_id"), F.when(F.col("strand") == 1, S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


CANDIDATES = "read_id long, ref_id long, score int, pos long, cigar string, md string, nm int, chain_score long"


def candidates(chains: DataFrame, reads: DataFrame, refs: DataFrame, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """CANDIDATES: an alignment for each chain of the read's best distinct chain scores; pos is 0-based in the sequence. Only the
    window that a read can reach is taken from a sequence."""
    top = chains.withColumn("_k", F.dense_rank().over(W.partitionBy("read_id").orderBy(F.desc("score")))).where(F.col("_k") <= cfg.top_scores).drop("_k")
    whole = top.join(reads.select("read_id", "seq"), "read_id").withColumn("n", F.length("seq"))
    first = F.greatest(F.lit(0).cast("long"), F.col("x0") - F.col("start") - F.col("y0") - cfg.context)
    last = F.least(F.col("len"), F.col("x1") - F.col("start") + F.col("n") - F.col("y1") + cfg.context)
    asked = stored(whole.select("read_id", "ref_id", "seq", "score", "start", "anchors", first.alias("lo"), last.alias("hi")))
    windows = asked.join(collection.windows(asked, refs), ["ref_id", "lo", "hi"])

    def align(batches):
        for pdf in batches:
            rows = []
            for c in pdf.itertuples():
                steps = [(a["x"] - c.start - c.lo, a["y"], a["w"]) for a in c.anchors]
                at, ops = along(c.seq, c.target, steps, cfg)
                score, cigar, md, nm = described(c.seq, c.target[at:], ops, cfg)
                rows.append((c.read_id, c.ref_id, score, c.lo + at, cigar, md, nm, c.score))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in CANDIDATES.split(", ")])

    return windows.mapInPandas(align, CANDIDATES).distinct()


def found(reads: DataFrame, refs: DataFrame, index: DataFrame, cfg: AlignConfig = AlignConfig(), chain_cfg: chaining.ChainConfig = chaining.ChainConfig()) -> DataFrame:
    """Candidates of both strands with read_id as in `reads`, and strand. Matches keep per_ref occurrences in each sequence; with halves
    those of long matches are seeds too; with direction (reads of pairs only, read_id = 2 * pair + mate) those of a direction that is
    shorter on average by more; with most_share those with a larger share of their read's occurrences go; with apart, of chains
    of one score that begin less than that apart on one sequence, the first stays."""
    both = stranded(reads)
    mems = matching.with_halves(both, refs, cfg.min_len) if cfg.halves else matching.smems(both, refs, cfg.min_len)
    mems = matching.capped(mems, cfg.per_ref)
    if cfg.direction is not None or cfg.most_share is not None:
        mems = stored(mems)
        kept = matching.intervals(mems)
        if cfg.direction is not None:
            kept = matching.direction_filter(matching.paired_directions(kept), cfg.direction, "pair_id")
        if cfg.most_share is not None:
            kept = matching.frequency_filter(kept, cfg.most_share)
        mems = matching.of_matches(mems, kept)
    chains = chaining.solved(chaining.anchors(mems, index), chain_cfg)
    if cfg.apart:
        chains = chaining.apart(chains, cfg.apart)
    out = candidates(chains, both, refs, cfg)
    return out.withColumn("strand", F.pmod("read_id", F.lit(2)).cast("int")).withColumn("read_id", F.floor(F.col("read_id") / 2))


def regions(found: DataFrame, reads: DataFrame) -> DataFrame:
    """Candidates that reach the least score for their read's length, with n, that length; of those at most 10 apart on one sequence and
    strand the best stays."""
    good = found.join(reads.select("read_id", F.length("seq").alias("n")), "read_id").where(F.col("score") >= S.min_score(F.col("n")))
    region = W.partitionBy("read_id", "ref_id", "strand").orderBy("pos")
    starts = F.coalesce((F.col("pos") - F.lag("pos").over(region) >= 10).cast("int"), F.lit(1))
    kept = good.withColumn("_new", starts).withColumn("_region", F.sum("_new").over(region))
    return kept.withColumn("_k", F.row_number().over(W.partitionBy("read_id", "ref_id", "strand", "_region").orderBy(F.desc("score"), "pos", "cigar"))).where("_k = 1").drop("_k", "_new", "_region")


def single(found: DataFrame, reads: DataFrame, refs: DataFrame, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """One SAM row for each read: its best alignment (of equals the first sequence, place and strand), the second-best score, the
    places that score as well, and mapping quality. Alignments under the least score for the read's length do not count;
    a read without any is unmapped. Candidates at most 10 apart on one sequence and strand are one region."""
    size = reads.select("read_id", "seq", F.length("seq").alias("n"))
    one = regions(found, reads)
    read = W.partitionBy("read_id")
    ordered = one.withColumn("_k", F.row_number().over(read.orderBy(F.desc("score"), "ref_id", "pos", "strand")))
    top = F.max("score").over(read)
    near = F.count_if(F.col("score") >= F.col("_top") - max(cfg.match + cfg.mismatch, cfg.gap_open + cfg.gap_extend)).over(read) - 1
    second = F.coalesce(F.max(F.when(F.col("_k") > 1, F.col("score"))).over(read), F.lit(0))
    rated = ordered.withColumn("_top", top).withColumn("second", second).withColumn("sub_n", near).withColumn("n_ties", F.count_if(F.col("score") == F.col("_top")).over(read) - 1).where("_k = 1")
    mapq = S.mapq_se(F.col("score"), F.col("second"), F.col("sub_n"), F.col("n"), cfg.match, cfg.mismatch, cfg.min_len)
    best = rated.select("read_id", "ref_id", "strand", "score", "second", "n_ties", "pos", "cigar", "md", "nm", mapq.alias("mapq"))
    named = best.join(refs.select("ref_id", F.col("name").alias("rname")), "ref_id")
    mapped = F.col("rname").isNotNull()
    out = size.join(named, "read_id", "left")
    seq = F.when(F.col("strand") == 1, S.revcomp(F.col("seq"))).otherwise(F.col("seq"))
    return out.select(
        F.col("read_id").cast("string").alias("qname"),
        F.when(~mapped, F.lit(S.UNMAPPED)).when(F.col("strand") == 1, F.lit(S.REVERSE)).otherwise(F.lit(0)).alias("flag"),
        F.coalesce("rname", F.lit("*")).alias("rname"),
        F.coalesce(F.col("pos") + 1, F.lit(0)).alias("pos"),
        F.coalesce("mapq", F.lit(0)).alias("mapq"),
        F.coalesce("cigar", F.lit("*")).alias("cigar"),
        F.coalesce(seq, F.lit("*")).alias("seq"),
        F.col("score").alias("AS"),
        F.when(F.col("second") > 0, F.col("second")).alias("ZS"),
        F.col("nm").alias("NM"),
        F.col("md").alias("MD"),
        "n_ties",
    )


def tied(found: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """(read_id, rname, pos, score): further places that score as well as the one that `single` reports; pos is 1-based."""
    read = W.partitionBy("read_id")
    order = regions(found, reads).withColumn("_top", F.max("score").over(read)).where("score = _top").withColumn("_k", F.row_number().over(read.orderBy("ref_id", "pos", "strand")))
    return order.where("_k > 1").join(refs.select("ref_id", F.col("name").alias("rname")), "ref_id").select("read_id", "rname", (F.col("pos") + 1).alias("pos"), "score")


def replayed(read: str, cigar: str, md: str) -> str:
    """The reference letters that a read, its CIGAR and MD stand for."""
    at, kept = 0, []
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        kept.append(read[at : at + int(n)] if op == "M" else "")
        at += int(n) if op != "D" else 0
    rest, at, out = "".join(kept), 0, []
    for n, deleted, letter in re.findall(r"(\d+)|\^([^\d^]+)|([^\d^])", md):
        if n:
            out.append(rest[at : at + int(n)])
            at += int(n)
        else:
            out.append(deleted or letter)
            at += 1 if letter else 0
    return "".join(out)
