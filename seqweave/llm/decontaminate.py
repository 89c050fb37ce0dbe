"""Benchmark decontamination (operator 2): Wu-Manber multi-pattern search over words.

Symbols are words: ASCII letters are lower-cased, a word is a run of ASCII letters, digits and non-ASCII
characters. A pattern is a window of `window` consecutive words of a benchmark item (the whole item where it
is shorter). For each pattern length the searcher holds a shift table over blocks of two words, which says how
far the search may jump, and buckets of patterns by the hash of their last block; every candidate is then
compared word by word, so hashes decide nothing by themselves. The positions of a batch are searched in
many lanes at once, each of which jumps by its own shifts.

Edge cases: null or empty text has no words, is never contaminated; items without words have no window and are never found; the
windows of an item without an id mark words like any others, but name no item; repeated rows give repeated results, repeated items
count once; an empty table of documents gives no rows, an empty benchmark no hits; the added columns replace those of their names;
texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, fresh, replaced, spans_of_rows, table, text_bytes, with_schema

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark of more text than this is searched in several shards, one after another.
SHARD_BYTES = 32 << 20
CHUNK = 1 << 20
LANE = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        a = np.full(n, base, np.uint64)
        a[:1] = 1
        _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers[name][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of a stretch of rows: places in the bytes, rows, and a hash each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = low = _LOWER[data[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        n = len(low)
        edge = np.zeros(n + 2, bool)
        edge[offsets] = True  # words never cross rows
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _IS_WORD[low]
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:n]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1 : n + 1])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # first word of each row, and the end
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_P, n, "p"), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _power(_PINV, n + 1, "q")[self.starts]
        self.hashes = _mix(h)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()

    def window(self, i: int, m: int) -> bytes:
        return b" ".join(self.word(j) for j in range(i, i + m))


class Patterns:
    """The words of all items of a shard, as Words has them for documents; built chunk by chunk, so that temporary arrays stay small."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.cumsum([0, *map(len, raw)])
        low, starts, ends, first, hashes, words = [], [], [], [], [], 0
        for lo, hi in spans_of_rows(offsets, CHUNK):
            w = Words(data, offsets[lo : hi + 1])
            shift = int(offsets[lo])
            low.append(w.low)
            starts.append((w.starts + shift).astype(np.uint32))
            ends.append((w.ends + shift).astype(np.uint32))
            first.append(w.first[:-1] + words)
            hashes.append(w.hashes)
            words += len(w.starts)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.low, self.starts, self.ends, self.hashes = join(low, np.uint8), join(starts, np.uint32), join(ends, np.uint32), join(hashes, np.uint64)
        self.first = np.append(join(first, np.int64), words).astype(np.int64)

    def window(self, i: int, m: int) -> bytes:
        return b" ".join(self.low[self.starts[j] : self.ends[j]].tobytes() for j in range(i, i + m))


class WuManber:
    """Windows of m words each, given by their first words among the patterns' and the items that own them."""

    def __init__(self, m: int, words: Patterns, starts: np.ndarray, owners: np.ndarray):
        self.m, self.block, self.words = m, min(2, m), words
        h = words.hashes
        self.bits = np.uint64(max(8, min(22, int(len(starts) * m).bit_length() + 4)))
        self.shift = np.full(1 << int(self.bits), min(255, m - self.block + 1), np.uint8)
        for j in range(self.block - 1, m):
            at = self._slot(self._block(h[starts + j], h[starts + max(0, j - 1)]))
            np.minimum.at(self.shift, at, np.uint8(min(255, m - 1 - j)))
        suffix = self._block(h[starts + m - 1], h[starts + max(0, m - 2)])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.starts, self.owners = suffix[order], starts[order].astype(np.uint32), owners[order].astype(np.uint32)

    def _block(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return last if self.block == 1 else _mix(before * np.uint64(0xD6E8FEB86659FD93) + last)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> (np.uint64(64) - self.bits)).astype(np.int64)

    def find(self, w: Words) -> list[tuple[int, int]]:
        """(first word, item) of every occurrence within one row."""
        m, n = self.m, len(w.hashes)
        if n < m:
            return []
        block = np.zeros(n, np.uint64)
        block[1:] = self._block(w.hashes[1:], w.hashes[:-1])
        block[0] = w.hashes[0] if self.block == 1 else 0
        pos = np.arange(m - 1, n, LANE)
        end = np.minimum(pos + LANE, n)
        hits = []
        while len(pos):
            jump = self.shift[self._slot(block[pos])]
            hits.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        at = np.concatenate(hits)
        lo, hi = np.searchsorted(self.suffix, block[at], "left"), np.searchsorted(self.suffix, block[at], "right")
        at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            return []
        start = np.repeat(at, count) - m + 1
        which = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        row = np.searchsorted(w.first, start, "right") - 1
        ok = start + m <= w.first[row + 1]
        start, which = start[ok], which[ok]
        theirs = self.starts[which].astype(np.int64)
        for j in range(m):
            same = w.hashes[start + j] == self.words.hashes[theirs + j]
            start, which, theirs = start[same], which[same], theirs[same]
        return [(i, int(self.owners[p])) for i, p, k in zip(start.tolist(), which.tolist(), theirs.tolist(), strict=True) if w.window(i, m) == self.words.window(k, m)]


def searchers(texts: list[str], window: int) -> list[WuManber]:
    """Searchers for the windows of items' texts, one for each window length; items are known by their number."""
    words = Patterns(texts)
    n = np.diff(words.first)
    length = np.minimum(window, n)
    out = []
    for m in np.unique(length[n > 0]).tolist():
        items = np.flatnonzero(length == m)
        count = n[items] - m + 1
        owners = np.repeat(items, count)
        starts = np.repeat(words.first[items] - np.cumsum(count) + count, count) + np.arange(count.sum())
        out.append(WuManber(m, words, starts, owners))
    return out


ADDED = "n_words long, hit_words array<int>, items array<string>"


def _annotate(docs: DataFrame, items: list[tuple[str | None, str]], window: int, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], searchers([t for _, t in items], window)))

    def search(batches):
        ids, finders = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            n_words, hit, found = [], [], []
            for lo, hi in spans_of_rows(offsets, CHUNK):
                w = Words(data, offsets[lo : hi + 1])
                n_words += np.diff(w.first).tolist()
                places, names = [set() for _ in range(hi - lo)], [set() for _ in range(hi - lo)]
                for f in finders:
                    hits = f.find(w)
                    for (i, item), row in zip(hits, (np.searchsorted(w.first, [i for i, _ in hits], "right") - 1).tolist(), strict=True):
                        places[row].add((i - int(w.first[row]), f.m))
                        if ids[item] is not None:
                            names[row].add(ids[item])
                hit += [sorted({i + j for i, m in x for j in range(m)}) for x in places]
                found += [sorted(x) for x in names]
            yield replaced(batch, {"n_words": pa.array(n_words, pa.int64()), "hit_words": pa.array(hit, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))})

    return docs.mapInArrow(search, with_schema(docs, ADDED))


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_words, hit_words (sorted numbers of the words that are part of a benchmark window) and items
    (sorted ids of the items met). Columns of docs with these names are replaced.

    The searchers of a shard of at most about shard_bytes of benchmark text (some seven bytes for each of these) are built once and sent
    to the workers. A larger benchmark is dealt into shards by hash; the documents then pass one shard after the other and the
    results are merged row by row.
    """
    pairs = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    total = pairs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    if shards == 1:
        return _annotate(docs, [tuple(r) for r in pairs.collect()], window, text)
    taken = [c for c in docs.columns if c not in ("n_words", "hit_words", "items")]
    hit, names = fresh(docs, 2)
    out = docs.select(*taken).withColumns({"hit_words": F.expr("array()").cast("array<int>"), "items": F.expr("array()").cast("array<string>")})
    for k in range(shards):
        part = [tuple(r) for r in pairs.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k).collect()]
        out = out.withColumnsRenamed({"hit_words": hit, "items": names})
        out = _annotate(out, part, window, text)
        out = out.withColumns({"hit_words": F.array_sort(F.array_union(hit, "hit_words")), "items": F.array_sort(F.array_union(names, "items"))})
        out = cut(out.drop(hit, names))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    return annotate(docs, benchmark, window).where(F.size("hit_words") == 0).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
      FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
      FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, (SELECT DISTINCT m FROM p))),
h AS (SELECT s.doc_id, s.i, s.m, p.item FROM s JOIN p ON s.m = p.m AND s.win = p.win),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
