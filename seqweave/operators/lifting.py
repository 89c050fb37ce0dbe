"""Alignments on haplotypes moved to their reference."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .collection import BIN

_OPS = re.compile(r"(\d+)([MID])")


def lifted(pos: int, cigar: str, segments: list[tuple[int, int, int, str]]) -> tuple[int, str] | None:
    """Place and CIGAR on the reference of an alignment at pos of a haplotype; segments (src_start, src_end, dst_start, op) in order
    cover it. Letters paired with inserted ones become insertions, letters that the haplotype lacks become deletions. None if no
    pair is left."""
    out, at, k, start, reached = [], pos, 0, None, 0
    for size, op in _OPS.findall(cigar):
        n = int(size)
        if op == "I":
            out.append((n, "I"))
            continue
        while n:
            while k < len(segments) and segments[k][1] <= at:
                k += 1
            if k == len(segments):
                return None
            src, stop, dst, kind = segments[k]
            step = min(n, stop - at)
            if op == "M" and kind == "I":
                out.append((step, "I"))
            elif op == "M":
                here = dst + at - src
                if start is None:
                    start = here
                elif here > reached:
                    out.append((here - reached, "D"))
                out.append((step, "M"))
                reached = here + step
            at, n = at + step, n - step
    if start is None:
        return None
    return start, "".join(f"{sum(x[0] for x in run)}{op}" for op, run in ((op, list(g)) for op, g in groupby(out, lambda x: x[1])))


def lift_cigars(alignments: DataFrame, segments: DataFrame, on: list[str]) -> DataFrame:
    """alignments (key, *on, pos, cigar) with ref_pos and ref_cigar, null if nothing is left on the reference. Segments (*on, src_start,
    src_end, dst_start, op) meet only the alignments in their bins of the haplotype."""
    span = F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MD]"), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    sized = alignments.withColumn("_end", F.col("pos") + F.greatest(span, F.lit(1)))
    asked = sized.select("key", *on, "pos", "_end", F.explode(F.sequence(F.floor(F.col("pos") / BIN), F.floor((F.col("_end") - 1) / BIN))).alias("_bin"))
    dealt = segments.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("src_start") / BIN), F.floor((F.col("src_end") - 1) / BIN))))
    met = asked.join(dealt, [*on, "_bin"]).where("src_start < _end AND src_end > pos")
    under = met.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("src_start", "src_end", "dst_start", "op"))).alias("_segments"))

    @F.pandas_udf("ref_pos long, ref_cigar string")
    def run(pos: pd.Series, cigar: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c, s in zip(pos, cigar, parts, strict=True):
            got = None if s is None else lifted(int(p), c, [(int(x["src_start"]), int(x["src_end"]), int(x["dst_start"]), x["op"]) for x in s])
            rows.append(got or (None, None))
        return pd.DataFrame({"ref_pos": pd.array([r[0] for r in rows], dtype="Int64"), "ref_cigar": [r[1] for r in rows]})

    return alignments.join(under, "key", "left").withColumn("_l", run("pos", "cigar", "_segments")).select(*alignments.columns, "_l.ref_pos", "_l.ref_cigar")
