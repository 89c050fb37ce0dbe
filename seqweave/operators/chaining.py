"""Chaining of matches into placements: anchors of each read, ordered by reference end, in a bounded look-back recurrence.

What each anchor adds to each of the anchors before it is found for all anchors at once; the recurrence then runs over all groups side
by side, one anchor of each group in a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class ChainConfig:
    """Largest distances of neighbours in the collection (x) and the read (y), anchors looked back at, least score and size of a chain,
    and whether secondary chains are sought."""

    max_dist_x: int = 500
    max_dist_y: int = 100
    max_iter: int = 10
    min_score: int = 40
    min_anchors: int = 1
    secondary: bool = False


def anchors(mems: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each occurrence of each match: x and y are the ends in the collection and the read, w the length; start and len are
    those of the sequence."""
    w = F.col("qe") - F.col("qs")
    return mems.join(index.select("ref_id", "start", "len"), "ref_id").select("read_id", "ref_id", "start", "len", (F.col("start") + F.col("rpos") + w - 1).alias("x"), (F.col("qe") - 1).alias("y"), w.alias("w"))


NEVER = -(1 << 60)


def gains(x: np.ndarray, y: np.ndarray, w: np.ndarray, group: np.ndarray, mean: np.ndarray, cfg: ChainConfig) -> np.ndarray:
    """(max_iter, n): what anchor i adds to a chain that ends with anchor i - d, in row d - 1; NEVER where it cannot follow. Anchors are
    in order of group and x. A step adds the least of both distances and the anchor's length, less a cost of the gap g between the
    distances: half of g/100 mean lengths of the group and log2 g together, rounded down."""
    out = np.full((cfg.max_iter, len(x)), NEVER, np.int64)
    for d in range(1, min(cfg.max_iter, len(x) - 1) + 1):
        dx, dy = x[d:] - x[:-d], y[d:] - y[:-d]
        gap = np.abs(dy - dx)
        cost = np.where(gap > 0, ((0.01 * gap * mean[d:]).astype(np.int64) + np.frexp(gap.astype(np.float64))[1] - 1) >> 1, 0)
        ok = (group[d:] == group[:-d]) & (dx <= cfg.max_dist_x) & (dy > 0) & (dy <= cfg.max_dist_y)
        out[d - 1, d:] = np.where(ok, np.minimum(np.minimum(dx, dy), w[d:]) - cost, NEVER)
    return out


def scores(gain: np.ndarray, w: np.ndarray, first: np.ndarray, size: np.ndarray, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score of a chain that ends with each anchor: f(i) = max(w(i), max over d of f(i - d) + gain(d, i)); how far back its
    predecessor is (0: none), the nearest of equals; and bits d - 1 of the anchors i - d that lie on that chain. Groups (first, size) are
    lanes: step t takes anchor t of every group that has one. barred: bits of anchors that must not be the predecessor."""
    back = len(gain)
    f, step, on = np.full(back + len(w), NEVER, np.int64), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    bits = np.arange(back)[:, None]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    for t in range(int(size[0]) if len(size) else 0):
        i = first[: int(np.searchsorted(-size, -t, "left"))] + t
        found = f[back + i - bits - 1] + gain[:, i]
        if barred is not None:
            found[(barred[i] >> bits) & 1 > 0] = NEVER
        d = found.argmax(axis=0)
        best = found[d, np.arange(len(i))]
        better = best > w[i]
        f[back + i] = np.where(better, best, w[i])
        step[i] = np.where(better, d + 1, 0)
        on[i] = np.where(better, ((on[i - d - 1] << (d + 1)) | (1 << d)) & ((1 << back) - 1), 0)
    return f[back:], step, on


def taken(f: np.ndarray, step: np.ndarray, cfg: ChainConfig) -> list[tuple[int, list[int]]]:
    """(score, anchors) of the chains of one group, best first: from the best end that is in no chain yet back to the start, or to an anchor
    of a chain taken before, if what it adds behind that is min_score at least."""
    used, out = np.zeros(len(f), bool), []
    ends = np.flatnonzero(f > cfg.min_score)
    for end in ends[np.lexsort((-ends, -f[ends]))].tolist():
        if used[end]:
            continue
        chain = [end]
        while step[chain[-1]] and not used[chain[-1] - step[chain[-1]]]:
            chain.append(chain[-1] - int(step[chain[-1]]))
        before = chain[-1] - int(step[chain[-1]]) if step[chain[-1]] else None
        if len(chain) >= cfg.min_anchors and (before is None or f[end] - f[before] >= cfg.min_score):
            used[chain] = True
            out.append((int(f[end]), chain[::-1]))
    return out


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray, cfg: ChainConfig, edges: np.ndarray | None = None):
    """For each group of anchors, between two edges and in order of x: (score, anchors, secondary) of its chains, best first. With
    cfg.secondary there is a second recurrence, in which an anchor may not follow one of its own best chain; its chains are
    taken from a table of their own, so they may share anchors with those of the first."""
    edges = np.array([0, len(x)]) if edges is None else edges
    first, size = edges[:-1], np.diff(edges)
    group = np.repeat(np.arange(len(size)), size)
    mean = np.float32(np.bincount(group, w, len(size))) / np.float32(np.maximum(size, 1))
    gain = gains(x, y, w, group, mean[group].astype(np.float64), cfg)
    f, step, on = scores(gain, w, first, size)
    if cfg.secondary:
        f2, step2, _ = scores(gain, w, first, size, on)
    ends = np.zeros(len(size), bool)  # of most groups no anchor ends a chain
    ends[group[(f > cfg.min_score) | (f2 > cfg.min_score if cfg.secondary else False)]] = True
    for lo, hi, any_ends in zip(edges.tolist(), edges[1:].tolist(), ends.tolist(), strict=False):
        if not any_ends:
            yield []
            continue
        found = [(score, c, False) for score, c in taken(f[lo:hi], step[lo:hi], cfg)]
        if cfg.secondary:
            known = {tuple(c) for _, c, _ in found}
            found += [(score, c, True) for score, c in taken(f2[lo:hi], step2[lo:hi], cfg) if tuple(c) not in known]
            found.sort(key=lambda r: -r[0])
        yield found


CHAINS = "read_id long, ref_id long, chain int, score long, n_anchors int, x0 long, x1 long, y0 long, y1 long, start long, len long, secondary boolean, anchors array<struct<x:long,y:long,w:long>>"


def solved(found: DataFrame, cfg: ChainConfig = ChainConfig(), within: bool = True) -> DataFrame:
    """CHAINS of anchors. With `within` a chain stays inside one sequence, and each pair of read and sequence is solved by itself, so a
    read that occurs in very many sequences is not one task; without, all anchors of a read are solved together and ref_id is
    that of the first anchor. Groups follow one another in sorted partitions; whole groups are solved as lanes, a batch at a time."""
    keys = ["read_id", "ref_id"] if within else ["read_id"]
    columns = ["read_id", "ref_id", "x", "y", "w", "start", "len"]

    def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
        edges = np.concatenate([[0], breaks(rows), [len(rows[0])]]).astype(np.int64)
        read, ref, x, y, w, start, size = rows
        out: list[tuple] = []
        for lo, chains in zip(edges.tolist(), solve(x, y, w, cfg, edges), strict=False):
            for k, (score, c, secondary) in enumerate(chains):
                c = np.array(c) + lo
                a, b = int(c[0]), int(c[-1])
                steps = [{"x": p, "y": q, "w": r} for p, q, r in zip(x[c].tolist(), y[c].tolist(), w[c].tolist(), strict=True)]
                out.append((int(read[a]), int(ref[a]), k, score, len(c), int(x[a]), int(x[b]), int(y[a]), int(y[b]), int(start[a]), int(size[a]), secondary, steps))
        step = pa.struct([("x", pa.int64()), ("y", pa.int64()), ("w", pa.int64())])
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.list_(step)]
        cols = list(zip(*out, strict=True)) or [()] * len(types)
        names = [f.split()[0] for f in CHAINS.split("array", 1)[0].split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def breaks(rows: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(max(0, len(rows[0]) - 1), bool)
        for c in rows[: len(keys)]:
            new |= c[1:] != c[:-1]
        return np.flatnonzero(new) + 1

    def run(batches):
        rest: list[list[np.ndarray]] = []  # parts of the group that may go on
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in columns]
            if not len(now[0]):
                continue
            if rest and any(rest[-1][c][-1] != now[c][0] for c in range(len(keys))):
                yield flush(rest)
                rest = []
            if len(at := breaks(now)):
                yield flush([*rest, [x[: at[-1]] for x in now]])
                rest, now = [], [x[at[-1] :] for x in now]
            rest.append(now)
        if rest:
            yield flush(rest)

    rows = found.select(*(F.col(c).cast("long").alias(c) for c in columns))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *(c for c in ("x", "y", "w"))).mapInArrow(run, CHAINS)


def chains(mems: DataFrame, index: DataFrame, cfg: ChainConfig = ChainConfig()) -> DataFrame:
    """(read_id, chain, score, n_anchors, x0, x1, y0, y1): first and last anchors' ends. The anchors of one read are solved
    together. With cfg.secondary also whether a chain is `secondary`."""
    columns = ["read_id", "chain", "score", "n_anchors", "x0", "x1", "y0", "y1"]
    return solved(anchors(mems, index), cfg, within=False).select(*columns, *["secondary"] * cfg.secondary)


def best(found: DataFrame) -> DataFrame:
    order = W.partitionBy("read_id").orderBy(F.desc("score"), "chain")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def near(found: DataFrame, distance: int) -> DataFrame:
    """found (CHAINS) with `near`: whether a chain begins less than `distance` after another chain of its read, sequence and score. Of a
    row of such chains, each close to the one before, only the first is not."""
    first = F.col("x0") - F.element_at("anchors", 1)["w"]
    same = W.partitionBy("read_id", "ref_id", "score").orderBy("_first", "chain")
    gap = F.col("_first") - F.lag("_first").over(same)
    return found.withColumn("_first", first).withColumn("near", F.coalesce(gap < distance, F.lit(False))).drop("_first")


def apart(found: DataFrame, distance: int) -> DataFrame:
    """found (CHAINS) without the chains that are `near` another."""
    return near(found, distance).where(~F.col("near")).drop("near")


def skipped(found: DataFrame, distance: int) -> DataFrame:
    """(read_id, chains_skipped): how many chains of each read `apart` leaves out, 0 included."""
    return near(found, distance).groupBy("read_id").agg(F.count_if("near").alias("chains_skipped"))
