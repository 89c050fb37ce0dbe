"""SimHash near-dedup (operator 3): deletion-variant signatures.

Texts get a 64-bit fingerprint of their word shingles. Two fingerprints at 2 or fewer differing bits agree in one half up
to one bit, so two segments do where exact pigeonholing would need three. The index holds, for each segment, its
one-wildcard variants: a variant drops one bit, and the two sides of the equality join are those with the bit unset and
those with it set. Where a half is fully equal, the other half is cut again in the same way, so that near copies, which
share whole halves, do not all meet in one bucket. The join's candidates are verified by counting differing bits, and
links are closed to components. Copies share a fingerprint and are one vertex.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other; repeated rows give repeated results;
rows whose doc_id is null get their fingerprint, and the least non-null doc_id of their component; an empty table gives no rows; texts
of any length are read whole; a column `fp` is replaced where fingerprints are added, all others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, fresh, replaced, row_key, stored, table, with_schema

SHINGLE, DISTANCE, SEED = 3, 2, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with the column fp (64 bits as a long)."""

    def add(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield replaced(batch, {"fp": pa.array(fps.view(np.int64))})

    return docs.mapInArrow(add, with_schema(docs, "fp long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_TOP, _LOW = 0xFFFFFFFF << 32, 0xFFFFFFFF
_Q = [0xFFFF << s for s in (48, 32, 16, 0)]


def variants() -> list[tuple[int, int, int | None]]:
    """(tag, bits kept, wildcard bit or None). With the halves T and L of two fingerprints that differ by at most 2 bits:
    T differs by one bit (L by at most one); or T is equal and L differs by 1 or 2 bits; or L is equal and T by 2."""
    out = [(p, _TOP & ~(1 << p), p) for p in range(32, 64)]
    out += [(64 + p, (_TOP | _Q[2]) & ~(1 << p), p) for p in range(16, 32)]  # one bit in L's upper quarter, at most one below
    out += [(128, _TOP | _Q[2], None), (129, _TOP | _Q[3], None)]
    out += [(128 + p, (_LOW | _Q[0]) & ~(1 << p), p) for p in range(48, 64)]
    return out + [(130, _LOW | _Q[0], None), (131, _LOW | _Q[1], None)]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at 1 or 2 differing bits; the variants are those for 2 bits."""
    if distance != 2:
        raise ValueError("the variants are laid out for a distance of 2")
    rows = []
    for tag, mask, p in variants():
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        sides = [F.shiftrightunsigned("fp", p).bitwiseAND(F.lit(1)).cast("int")] if p is not None else [F.lit(0), F.lit(1)]
        rows += [F.struct(F.lit(tag).alias("tag"), key.alias("key"), side.alias("side")) for side in sides]
    index = fps.select("fp", F.explode(F.array(*rows)).alias("v")).select("fp", "v.*")
    left = index.where("side = 0").select("tag", "key", F.col("fp").alias("a"))
    right = index.where("side = 1").select("tag", "key", F.col("fp").alias("b"))
    # rows are exploded, so the planner takes a side for as small as fps and would send all of it to the tasks: both are dealt out
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & ((F.col("tag").between(128, 131) & (F.col("a") < F.col("b"))) | ~F.col("tag").between(128, 131))
    return left.hint("merge").join(right.hint("merge"), ["tag", "key"]).where(near).select("a", "b")


def _classes(found: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of found (doc_id, fp)."""
    fps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(links(fps.select("fp")))
    of = fps.join(linked.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    return cut(of.join(lows, "root").select("fp", "root", "component_id"))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable by links."""
    found = stored(fingerprinted(docs.select("doc_id", "text")).drop("text"))
    return found.join(_classes(found).drop("root"), "fp")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group: the one with the least doc_id (rows without one come last), of several texts with that doc_id one of them,
    of repeated rows one. Every group keeps a row."""
    k1, k2 = fresh(docs, 2)
    found = stored(fingerprinted(docs.select("doc_id", "text", *row_key("doc_id", "text"))).drop("text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k1", "_k2")).alias("one")
    keep = found.join(_classes(found), "fp").groupBy("root").agg(least).select(F.col("one._k1").alias(k1), F.col("one._k2").alias(k2))
    keyed = docs.select("*", *row_key("doc_id", "text", names=(k1, k2)))
    return keyed.join(keep, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
