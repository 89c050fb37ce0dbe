"""Embedding near-dedup (operator 6): randomised-rotation binary codes.

Equal vectors are one class. Each class's unit vector is turned by random rotations; the signs are its binary code, stored once with
the correction factor that makes the code's inner products with other vectors unbiased, and with the vector itself in four bits a
dimension, the query side of the estimate. Bits of the code, a few a table, are bucket keys; the number of tables follows from
their length so that a pair at the threshold shares a bucket with probability RECALL at least. Only codes are dealt out to the
buckets. There they estimate all inner products, from either side, with confidence bounds: pairs clearly below the threshold are
dropped, and for the rest the vectors are fetched and recomputed exactly in double precision. What is to be recomputed travels as
bits, a row for each vector. A pair that shares several buckets counts in the first of them. Large buckets are dealt into blocks,
and pairs of blocks are compared in tasks of their own; links are counted there, not listed, and only a spanning forest of them
goes on to the components.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, whatever their repeats;
vectors of different dimensions do not link; a null vec_id takes part, and its component is the least non-null one; repeated rows
are vectors of one class; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, row_key, stored, table

THRESHOLD, RECALL = 0.9, 0.97
#: Bits of a bucket key: such that a bucket of unrelated vectors holds about PER_BUCKET. Beyond some 5e8 vectors buckets grow again.
PER_BUCKET, LEAST_BITS, MOST_BITS = 32, 6, 24
#: Bits of a code, at most, where the dimension is smaller.
MOST_SIGNS = 1024
BLOCK = 1024
#: Standard deviations of the code's estimate on either side.
BOUND = 4.0


@lru_cache(64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(16)
def rotations(dim: int, turns: int) -> np.ndarray:
    return np.concatenate([rotation(dim, k) for k in range(turns)])


def tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits and number of bucket tables for n vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(2, n) / PER_BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def turns_of(dim: int, bits: int, count: int) -> int:
    """Rotations of a code: its bits serve all tables, once each as far as MOST_SIGNS allows."""
    return max(1, -(-min(bits * count, MOST_SIGNS) // dim))


@lru_cache(64)
def positions(total: int, bits: int, count: int) -> np.ndarray:
    """(count, bits) places in a code of `total` signs: each table takes its own, as long as there are enough."""
    order = np.random.default_rng([total, bits]).permutation(total)
    return order[np.arange(count * bits).reshape(count, bits) % total]


def bucket_keys(signs: np.ndarray, bits: int, count: int) -> np.ndarray:
    """(row, table) keys of rows of signs (0 or 1), for the first `count` tables."""
    weights = (1 << np.arange(bits)).astype(np.float32)  # at most 24 bits: exact
    out = np.empty((len(signs), count), np.int32)
    for t, at in enumerate(positions(signs.shape[1], bits, count)):
        out[:, t] = signs[:, at] @ weights
    return out


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encoded(x: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors -> packed codes, correction factors (inner product of each vector with its own code), the vectors in four bits a
    dimension, and their step."""
    dim = x.shape[1]
    turned = x @ rotations(dim, turns).T
    factor = np.abs(turned).sum(axis=1) / (math.sqrt(dim) * turns)
    step = np.abs(x).max(axis=1) / 7.5
    level = np.clip(np.floor(x / step[:, None] + 8), 0, 15).astype(np.uint8)
    if dim % 2:
        level = np.concatenate([level, np.zeros((len(x), 1), np.uint8)], axis=1)
    return np.packbits(turned > 0, axis=1), factor.astype("f4"), level[:, ::2] << 4 | level[:, 1::2], step.astype("f4")


def rough(packed: np.ndarray, step: np.ndarray, dim: int) -> np.ndarray:
    """Vectors back from four bits a dimension."""
    level = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    return (level.astype("f4") - np.float32(7.5)) * step[:, None]


def estimates(codes, factor, query, step, dim: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of codes, row of query): unbiased estimates of the inner products of coded vectors with rough ones turned like them, and
    BOUND standard deviations of them."""
    norm = np.float32(math.sqrt(dim) * turns)
    about = (codes @ query.T) / (norm * factor[:, None])
    code = (1 - factor**2) / (max(1, dim - 1) * turns)
    return about, BOUND * np.sqrt(np.maximum(0, code)[:, None] + step[None, :] ** 2 / 12) / factor[:, None] + 1e-3


def possible(rows: dict, left: np.ndarray, right: np.ndarray, same: bool, dim: int, turns: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows left, of rows right) that reach the threshold within the bounds of both estimates."""
    both = {}
    for name, at in (("l", left), ("r", right)):
        codes = np.unpackbits(rows["code"][at], axis=1, count=dim * turns).astype("f4") * 2 - 1
        both[name] = codes, rows["factor"][at], rough(rows["level"][at], rows["step"][at], dim) @ rotations(dim, turns).T.astype("f4"), rows["step"][at]
        if same:
            both["r"] = both["l"]
            break
    about, error = estimates(both["l"][0], both["l"][1], both["r"][2], both["r"][3], dim, turns)
    may = about + error >= threshold
    about, error = estimates(both["r"][0], both["r"][1], both["l"][2], both["l"][3], dim, turns)
    may &= (about + error >= threshold).T
    if same:
        may &= np.triu(np.ones(may.shape, bool), 1)
    i, j = np.nonzero(may)
    return left[i], right[j]


def _finite(vector):
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """(v, _k1, _k2, n, low, vector) of the classes of equal sound vectors; v is a number of their own."""
    found = rows.where("sound").groupBy("_k1", "_k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("vector").alias("vector"))
    return stored(found.withColumn("v", F.monotonically_increasing_id()))


def by_dimension(vectors: pa.Array):
    """(rows, matrix) of an array column of doubles or floats, for each dimension."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, dim, values[starts[at][:, None] + np.arange(dim)]


CODED = "v long, n long, dim int, code binary, factor float, level binary, step float"
TASK = ["tab", "key", "dim", "i", "j"]


def coded(classes: DataFrame, bits: int, count: int) -> DataFrame:
    """A row for each class: code, correction factor, vector in four bits a dimension and its step."""

    def add(batches):
        for batch in batches:
            for at, dim, x in by_dimension(batch.column("vector")):
                code, factor, level, step = encoded(units(x), turns_of(dim, bits, count))
                whole = lambda a: pa.array([r.tobytes() for r in a])
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), whole(code), pa.array(factor), whole(level), pa.array(step)], names=[c.split()[0] for c in CODED.split(", ")])

    return classes.select("v", "n", "vector").mapInArrow(add, CODED)


def keyed(codes: DataFrame, bits: int, count: int) -> DataFrame:
    """codes with a row for each table: tab, key."""

    def add(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(at)
                signs = np.unpackbits(_matrix(part.column("code")), axis=1, count=dim * turns_of(dim, bits, count))
                keys = bucket_keys(signs, bits, count)
                for t in range(count):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), t, np.int32)), pa.array(keys[:, t].astype(np.int64))], names=[*part.schema.names, "tab", "key"])

    return codes.mapInArrow(add, f"{CODED}, tab int, key long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of bytes of one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def grouped(batches, keys: list[str]):
    """Tables of the rows that agree in keys, from batches that are sorted by them."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
        ids = np.stack([now.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                yield now.slice(a, b - a)
        rest = now.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


CANDIDATES = "tab int, key long, dim int, i int, j int, k int, v long, n long, mates binary"


def candidates(blocks: DataFrame, bits: int, count: int, threshold: float) -> DataFrame:
    """Rows of a task (TASK) that take part in a possible pair whose first common table this is, numbered by k; mates are bits of the
    numbers of their partners. blocks come sorted by TASK."""

    def run(batches):
        for rows in grouped(batches, TASK):
            tab, dim, i, j = (rows.column(c)[0].as_py() for c in ("tab", "dim", "i", "j"))
            turns = turns_of(dim, bits, count)
            part = {"code": _matrix(rows.column("code")), "level": _matrix(rows.column("level")), "factor": rows.column("factor").to_numpy(), "step": rows.column("step").to_numpy()}
            block = rows.column("block").to_numpy()
            a, b = possible(part, np.flatnonzero(block == i), np.flatnonzero(block == j), i == j, dim, turns, threshold)
            if tab and len(a):
                some, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                keys = bucket_keys(np.unpackbits(part["code"][some], axis=1, count=dim * turns), bits, count)[:, :tab]
                x, y = back[: len(a)], back[len(a) :]
                first = np.concatenate([~(keys[x[s : s + 4096]] == keys[y[s : s + 4096]]).any(axis=1) for s in range(0, len(x), 4096)])
                a, b = a[first], b[first]
            if not len(a):
                continue
            some, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            mates = np.zeros((len(some), len(some)), bool)
            mates[back[: len(a)], back[len(a) :]] = True
            at = pa.array(some)
            fixed = [rows.column(c).take(at).combine_chunks() for c in TASK]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(len(some), dtype=np.int32)), rows.column("v").take(at).combine_chunks(), rows.column("n").take(at).combine_chunks(), pa.array([m.tobytes() for m in np.packbits(mates, axis=1)])], names=[c.split()[0] for c in CANDIDATES.split(", ")])

    return blocks.mapInArrow(run, CANDIDATES)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row number that each of n rows reaches over the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


FOUND = "v long, other long, n long"


def verified(asked: DataFrame, threshold: float) -> DataFrame:
    """Rows (v, null, n): n vectors of other classes linked with v, and (v, other, null): a forest of the links. asked are CANDIDATES
    with their vectors, sorted by TASK and k."""

    def run(batches):
        for rows in grouped(batches, TASK):
            v, n = rows.column("v").to_numpy(), rows.column("n").to_numpy()
            ((_, _, x),) = by_dimension(rows.column("vector").combine_chunks())
            x = units(x)
            mates = np.unpackbits(_matrix(rows.column("mates")), axis=1, count=len(v)).astype(bool)
            p, q = np.nonzero(mates & (x @ x.T >= threshold))
            weight = np.bincount(p, n[q], len(v)) + np.bincount(q, n[p], len(v))
            low = forest(len(v), p, q)
            some, child = np.flatnonzero(weight), np.flatnonzero(low != np.arange(len(v)))
            blank = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v[some], v[child]])), pa.concat_arrays([blank(len(some)), pa.array(v[low[child]])]), pa.concat_arrays([pa.array(weight[some].astype(np.int64)), blank(len(child))])], names=["v", "other", "n"])

    return asked.mapInArrow(run, FOUND)


def deduplicated(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    rows = rows.select("vec_id", "vector", *row_key("vector", F.size("vector")), _finite(F.col("vector").cast("array<double>")).alias("sound"))
    classes = classes_of(rows)
    bits, count = tables(classes.count(), threshold, recall)
    codes = stored(coded(classes, bits, count))
    index = keyed(codes, bits, count)
    where = ["tab", "key", "dim"]
    sizes = index.groupBy(*where).agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = index.join(stored(sizes), where).withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("v", "tab"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    dealt = dealt.withColumn("p", F.explode(pair)).select(*where, F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "v", "n", "code", "factor", "level", "step")
    asked = stored(candidates(dealt.repartition(*TASK).sortWithinPartitions(*TASK), bits, count, threshold))
    exact = asked.join(classes.select("v", "vector"), "v").select(*TASK, "k", "v", "n", "mates", "vector")
    found = stored(verified(exact.repartition(*TASK).sortWithinPartitions(*TASK, "k"), threshold))
    counts = found.where("n IS NOT NULL").groupBy("v").agg(F.sum("n").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("v").alias("a"), F.col("other").alias("b")))
    of = classes.select("v", "_k1", "_k2", "n", "low").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")).join(counts, "v", "left")
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "root").select("_k1", "_k2", F.lit(True).alias("sound"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.drop("vector").join(of, ["_k1", "_k2", "sound"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "embeddings"))


#: All pairs by cosine, and everything that links reach: for small tables.
OP6_SQL = f"""WITH RECURSIVE s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
c(v, r) AS (SELECT a, a FROM l UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT v, min(r) AS r FROM c GROUP BY v)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.v = vec_id
"""
