"""Suffix-array dedup (operator 10): removes every byte covered by a string of LENGTH bytes that also starts elsewhere.

Only suffixes at anchors are sorted. An anchor is the gram of GRAM bytes with the least hash of some window of LENGTH bytes, so
equal windows have anchors at equal places, and two windows that contain anchors a and b there are equal just if a and b agree on
enough bytes to the left and right, LENGTH together. For each anchor the farthest such agreement to either side, over all
other anchors, is what is removed around it.

1. Anchors whose gram occurs once are dropped (a grouped count and a semi-join).
2. Anchors with the same 128-bit hash of their whole context agree as far as it matters: both contexts are removed. One of
   each such class goes on, so copies never meet in one task.
3. The others, of grams with several classes, are sorted: each task sorts its suffixes into runs and front-codes them (the
   length of the prefix shared with the one before, then the rest); runs are exchanged by gram and merged with a loser tree
   that compares two suffixes only beyond the prefix they are known to share with the last one put out. In the merged order,
   neighbouring suffixes are joined by falling common prefix, keeping each set ordered by left context, which gives the
   longest left agreement at every right agreement.
4. Grams of more than HOT classes (a line in very many documents) never meet in one task. Two anchors that agree in LENGTH bytes
   agree in 232 from the anchor on or in 169 before it, so their classes are dealt anew by 128-bit hashes of these, and sorted as in
   step 3. What is still in groups of more than HOT is settled by grouped counts of hashes of the windows of LENGTH bytes around
   the anchors: first of the core that STEP neighbouring windows share, then of each window of the cores that occur again. It
   removes the same bytes as step 3.

Edge cases: null text is empty; texts shorter than LENGTH lose nothing; a string may overlap its other occurrence;
repeated rows are occurrences of each other and give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, row_key, spans_of_rows, stored, stored_paths, table, text_bytes

LENGTH, GRAM = 400, 64
CHUNK = 1 << 19
#: Low bits of a gram's hash that give way to places: the same for texts up to a gigabyte, so that equal windows choose equal anchors.
BITS = 30
#: Suffixes that one merging task gets, about.
BUCKET = 40_000
#: Classes of a gram, of some 800 bytes each, up to which they meet in one task; windows that share one core.
HOT, STEP = 4_000, 24
#: Bytes of a group's number before its suffixes; keys of rows, 8 bytes each, that go to the tasks.
OWNER, KEYS_SENT = 8, 1_000_000
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_cache: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _cache or len(_cache[base]) < n:
        a = np.full(n, base, np.uint64)
        a[:1] = 1
        _cache[base] = np.cumprod(a, dtype=np.uint64)
    return _cache[base][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes in a row."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=sums[1:])
    h = (sums[k:] - sums[: n - k + 1]) * _power(_PINV, n)[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in data, for rows laid out by offsets, and their gram hashes (signed)."""
    base = int(offsets[0])
    data, offsets = data[base : offsets[-1]], offsets - base
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data, gram)
    bits = np.uint64(BITS)
    if len(data) >> BITS:  # one text of a gigabyte
        bits = np.uint64(len(data).bit_length())
    ranked = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
    least = window_minima(ranked, length - gram + 1)  # one for each window start
    whole = np.zeros(len(least), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            whole[a : b - length + 1] = True
    least = least[whole]
    changed = np.ones(len(least), bool)
    changed[1:] = least[1:] != least[:-1]
    at = np.unique((least[changed] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return at + base, h[at].view(np.int64)


ANCHORS = "_k1 long, _k2 long, pos int, start int, stop int, gram long, c1 long, c2 long"


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of docs (_k1, _k2, text): place, the context [start, stop), hashes of gram and context."""

    def find(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in spans_of_rows(offsets, CHUNK):
                at, h = anchors_of(data, offsets[lo : hi + 1], length, gram)
                if not len(at):
                    continue
                row = lo + np.searchsorted(offsets[lo : hi + 1], at, "right") - 1
                first, last = offsets[row], offsets[row + 1]
                start, stop = np.maximum(first, at - (length - gram)), np.minimum(last, at + length)
                raw = memoryview(data)
                digest = xxhash.xxh3_128_digest
                context = b"".join([digest(raw[a:b], c - a) for a, b, c in zip(start.tolist(), stop.tolist(), at.tolist(), strict=True)])
                c = np.frombuffer(context, "<i8").reshape(-1, 2)
                to = lambda x: pa.array((x - first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), to(at), to(start), to(stop), pa.array(h), pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1]))], names=[x.split()[0] for x in ANCHORS.split(", ")])

    return docs.mapInArrow(find, ANCHORS)


# ---- front-coded runs and their merge ----


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which share `known` bytes at least."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    while step > 1:
        step //= 2
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += step
    return lo


def front_coded(rows: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (suffix, payload) rows: shared prefix, rest, payload."""
    rows.sort()
    out, before = [], b""
    for suffix, payload in rows:
        shared = common(before, suffix)
        out.append(struct.pack("<HHH", shared, len(suffix) - shared, len(payload)) + suffix[shared:] + payload)
        before = suffix
    return b"".join(out)


def decoded(run: bytes):
    """(suffix, payload, prefix shared with the one before) of a front-coded run, in order."""
    at, before = 0, b""
    while at < len(run):
        shared, rest, n = struct.unpack_from("<HHH", run, at)
        at += 6
        before = before[:shared] + run[at : at + rest]
        yield before, run[at + rest : at + rest + n], shared
        at += rest + n


def merged(runs: list[bytes]):
    """(suffix, payload, prefix shared with the one before) over all runs, in order. Each head knows how much it shares with the
    last suffix put out; of two heads the one that shares more is the smaller, and only those that share equally are compared,
    beyond that prefix."""
    size = 1
    while size < len(runs):
        size *= 2
    sources = [decoded(r) for r in runs]
    heads = [next(s, None) for s in sources] + [None] * (size - len(runs))
    shared = [0] * size
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes the one with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        n = common(x, y, shared[a])
        a, b = (a, b) if x[n:] <= y[n:] else (b, a)
        shared[b] = n
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if size > 1 else 0
    while heads[top] is not None:
        suffix, payload, _ = heads[top]
        yield suffix, payload, shared[top]
        heads[top] = following = next(sources[top], None)
        shared[top] = following[2] if following else 0
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def reaches(lefts: list[bytes], shared: list[int], length: int) -> tuple[list[int], list[int]]:
    """For suffixes in order, with the prefix each shares with the one before and their left contexts (read outwards): the longest
    left and right agreement with another one, among those that are `length` or more together."""
    n = len(lefts)
    left, right = [0] * n, [0] * n
    order = sorted(range(n), key=lambda i: lefts[i])
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    sets: list[list[int] | None] = [[rank[i]] for i in range(n)]
    owner = list(range(n))

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(1, n), key=lambda i: -shared[i]):
        d = shared[i]
        a, b = find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, small = sets[a], sets[b]
        for r in small:
            k = bisect_left(big, r)
            for other in big[max(0, k - 1) : k + 1]:
                x, y = order[r], order[other]
                agree = common(lefts[x], lefts[y])
                if agree + d >= length:
                    for z in (x, y):
                        left[z], right[z] = max(left[z], agree), max(right[z], d)
            insort(big, r)
        sets[b], owner[b] = None, a
    return left, right


def once(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of docs (_k1, _k2, text) that places (unique _k1, _k2) has, each once, with its columns. The first half of the keys goes first: as
    long as they are at most KEYS_SENT they go to the tasks as sorted numbers, which costs the driver a tenth of what a table for a join
    does, and texts that are not asked for are not dealt out. What else these halves let through goes in the join on whole keys."""
    places = stored(places)
    if places.count() <= KEYS_SENT:
        keys = places.select("_k1").toArrow().column(0).to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(np.unique(keys))

        def pick(batches):
            known = shared.value
            for batch in batches:
                k = batch.column(batch.schema.get_field_index("_k1")).to_numpy()
                at = np.minimum(np.searchsorted(known, k), max(0, len(known) - 1))
                yield batch.filter(pa.array(known[at] == k if len(known) else np.zeros(len(k), bool)))

        asked = docs.mapInArrow(pick, docs.schema)
    else:
        asked = docs.join(places.select("_k1", "_k2").hint("merge"), ["_k1", "_k2"], "left_semi")
    return asked.dropDuplicates(["_k1", "_k2"]).join(places.hint("merge"), ["_k1", "_k2"])


def sorted_reaches(docs: DataFrame, picked: DataFrame, length: int, gram: int) -> DataFrame:
    """(_k1, _k2, start, stop) removed around the picked anchors (_k1, _k2, pos, bucket, owner) of docs (_k1, _k2, text). Suffixes are
    sorted behind their owner, the number of their group, so groups stay apart in a bucket; an anchor stands once in a group."""
    places = picked.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("pos", "bucket", "owner")).alias("at"))
    rows = once(docs, places)

    def runs(batches):
        for batch in batches:
            ids = batch.select(["_k1", "_k2"]).to_pylist()
            by: dict[int, list] = {}
            for row, text, at in zip(ids, batch.column("text"), batch.column("at").to_pylist(), strict=True):
                text = text.as_py().encode()
                for x in at:
                    p = x["pos"]
                    payload = struct.pack("<qqi", row["_k1"], row["_k2"], p) + text[max(0, p - (length - gram)) : p][::-1]
                    by.setdefault(x["bucket"], []).append((struct.pack(">q", x["owner"]) + text[p : p + length], payload))
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([front_coded(v) for v in by.values()], pa.binary())], names=["bucket", "run"])

    def merge(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple[bytes, int]] = []

        def close():
            if len(group) > 1:
                left, right = reaches([p[20:] for p, _ in group], [s for _, s in group], length)
                for (payload, _), a, b in zip(group, left, right, strict=True):
                    if b:
                        k1, k2, p = struct.unpack_from("<qqi", payload)
                        out.append((k1, k2, p - a, p + b))
            group.clear()

        for _, payload, shared in merged(table.column("run").to_pylist()):
            if shared < OWNER + gram:
                close()
            group.append((payload, shared - OWNER))
        close()
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_k1", "_k2", "start", "stop"])

    return rows.select("_k1", "_k2", "text", "at").mapInArrow(runs, "bucket int, run binary").groupBy("bucket").applyInArrow(merge, "_k1 long, _k2 long, start int, stop int")


WINDOWS = "_k1 long, _k2 long, pos int, k int, w1 long, w2 long"


def window_hashes(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of asked (_k1, _k2, pos, k, width): the hash of the `width` bytes from pos - k on, where the text has them."""
    places = asked.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("pos", "k", "width")).alias("at"))
    rows = once(docs, places).select("_k1", "_k2", "text", "at")

    def digests(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw = memoryview(data)
            for i, at in enumerate(batch.column(3)):
                pos, k, width = (at.values.field(n).to_numpy().astype(np.int64) for n in ("pos", "k", "width"))
                start = pos - k + offsets[i]
                ok = (pos >= k) & (start + width <= offsets[i + 1])
                pos, k, start, width = pos[ok], k[ok], start[ok], width[ok]
                w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a : a + n]) for a, n in zip(start.tolist(), width.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                same = lambda n, m=len(pos), i=i: batch.column(n).take(pa.array(np.full(m, i)))
                yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(pos.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return stored(rows.mapInArrow(digests, WINDOWS))


def windows_again(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """Of asked (_k1, _k2, pos, k): those whose `width` bytes from pos - k on are in their text and also at another pos with this k."""
    found = window_hashes(docs, asked.withColumn("width", F.lit(width)))
    key = ["k", "w1", "w2"]
    again = stored(found.groupBy(*key).count().where("count > 1").select(*key))
    return found.join(again, key, "left_semi").select("_k1", "_k2", "pos", "k")


def split_reaches(docs: DataFrame, picked: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """What sorted_reaches gives for picked (_k1, _k2, pos) of hot grams, with no more than `hot` of them in one group."""
    right = gram + (length - gram) // 2
    left = length - right + 1
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(right).alias("width")), F.struct(F.lit(left).alias("k"), F.lit(left).alias("width"))))
    found = window_hashes(docs, picked.select("_k1", "_k2", "pos", both.alias("x")).select("_k1", "_k2", "pos", "x.*"))
    key = ["k", "w1", "w2"]
    sizes = stored(found.groupBy(*key).count().where("count > 1"))
    met = stored(found.join(sizes, key))
    small, rest = met.where(F.col("count") <= hot), met.where(F.col("count") > hot).select("_k1", "_k2", "pos").distinct()
    buckets = max(1, -(-small.count() // BUCKET))
    owner = F.xxhash64(*key)  # tells apart both ways of an anchor, so it never meets itself
    out = sorted_reaches(docs, small.select("_k1", "_k2", "pos", F.pmod(owner, F.lit(buckets)).cast("int").alias("bucket"), owner.alias("owner")), length, gram)
    return out if rest.isEmpty() else out.unionByName(counted_reaches(docs, rest, length, gram))


def counted_reaches(docs: DataFrame, picked: DataFrame, length: int, gram: int, step: int = STEP) -> DataFrame:
    """What sorted_reaches gives for picked (_k1, _k2, pos), by counts of windows: no gram or window meets in one task."""
    last = length - gram
    step = min(step, last + 1)
    cores = windows_again(docs, picked.select("_k1", "_k2", "pos", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(step))).alias("k")), length - step + 1)
    each = cores.select("_k1", "_k2", "pos", F.explode(F.sequence("k", F.least(F.col("k") + step - 1, F.lit(last)))).alias("k"))
    begin = F.col("pos") - F.col("k")
    # windows of one anchor lie around its gram, so their union is one range
    return windows_again(docs, each, length).groupBy("_k1", "_k2", "pos").agg(F.min(begin).alias("start"), (F.max(begin) + length).alias("stop")).drop("pos")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(_k1, _k2, start, stop): byte ranges to remove from docs (_k1, _k2, text); they may overlap."""
    key, context = ["gram"], ["gram", "c1", "c2"]
    with stored_paths() as paths:
        every = stored(anchors(docs, length, gram))
        # written before it is joined: a join of two plain shuffles can split a hot gram
        again = stored(every.groupBy(*key).count().where("count > 1").select(*key))
    found = stored(every.join(again, key, "left_semi"))
    discard(docs.sparkSession, paths)
    classes = found.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "pos")).alias("one"))
    classes = stored(classes)
    copies = found.join(classes.where("n > 1").select(*context), context, "left_semi").select("_k1", "_k2", "start", "stop")
    several = stored(classes.groupBy(*key).count().where("count > 1"))
    picked = stored(classes.join(several, key).select("one.*", "gram", (F.col("count") > hot).alias("often")))
    often = picked.where("often").select("_k1", "_k2", "pos")
    if not often.isEmpty():
        copies = copies.unionByName(split_reaches(docs, often, length, gram, hot))
    picked = picked.where("NOT often")
    buckets = max(1, -(-picked.count() // BUCKET))
    picked = picked.select("_k1", "_k2", "pos", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"), F.col("gram").alias("owner"))
    return copies.unionByName(sorted_reaches(docs, picked, length, gram)).distinct()


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>, kept binary"


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the removed spans and the bytes kept (with digest: their SHA-256 instead)."""
    docs = docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    gone = removals(docs.select("_k1", "_k2", "text"), length, gram, hot).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = union_of([(s["start"], s["stop"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(spans), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(kept).digest() if digest else kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return docs.join(gone, ["_k1", "_k2"], "left").select("doc_id", "text", "gone").mapInArrow(cut, KEPT)


def op10(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


#: Bytes are pairs of hexadecimal digits; strings of LENGTH bytes are counted by their MD5.
OP10_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i FROM d)),
m AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n) GROUP BY doc_id, run),
p AS (SELECT r.*, x, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r JOIN d USING (doc_id)),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM p GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
