"""Substring dedup (operator 9): fuzzy passages by collinear chaining.

Seeds are grams of WORDS consecutive words, of which each window of WINDOW grams contributes the one with the least hash. With a
seed go six bits of each of the SIDE words before and after it. A seed that occurs again in a document is matched there with its place before, without leaving the document. Of each document the
first occurrence of a seed, and the first with the same 4 or 8 words before or after it, go on; they are joined with the first
document's seed, or seed and words: at most five matches for each, not one for each pair, and a common phrase still meets the
copies of its own passage. A match goes on if `needed` of the SIDE words on one side agree, shifted by one word at most: in a passage of
MIN_WORDS words and IDENTITY, one side of each seed is long enough for that; with `needed` 0 every match goes on. The documents of each
seed are counted: seeds of more than `hot` are held against grouped minima instead of meeting in one task; the matches are the same.

The matches of a document with another, or with itself, are chained in order: runs on one diagonal become blocks; a Fenwick tree
over the places in the other document gives each block its best predecessor under linear gap costs; chains are cut at gaps of
more than GAP characters. Both passages of every chain, also of one seed, are fetched, extended word by word past differences
until DROP equal words would be needed to make up for them, and aligned; where an extension comes to the end of what was
fetched, it is done again with a wider margin. Passages of at least MIN_WORDS words and IDENTITY (longest common subsequence of
words over the longer side) are reported: for the later document, or the later place in one document, with all its partners, and
for the holder of the first place as ranges.

Results are places in code points, ends exclusive. Edge cases: null and empty texts have no passages; repeated rows of one doc_id
and text are one document and give the same passages each; rows of one doc_id with different texts are different documents, and
so are rows without doc_id; an empty table gives no rows; texts of any length are read whole; further columns are not read.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, row_key, spans_of_rows, stored, stored_paths, table, text_bytes
from .decontaminate import Words
from .suffixdedup import window_minima

WORDS, WINDOW, GAP, MIN_WORDS, IDENTITY, DROP = 5, 8, 400, 40, 0.8, 8
#: Characters fetched to either side of a chain at first: enough to settle one that does not reach MIN_WORDS.
MARGIN = 350
GAP_COST = 0.05
SIDE, NEEDED, BITS = 8, 4, 6
CHUNK = 1 << 20

#: A seed in more documents than this is joined by grouped minima; below, its occurrences, at most one of each class and document, are
#: a megabyte in one task.
HOT = 5_000
#: Frequent seeds go to the tasks while they are at most so many; beyond that they are joined. So do ids of documents whose texts are asked for.
OFTEN_SENT = IDS_SENT = 1_000_000
#: Seeds are written in so many parts by hash, matched part by part and deleted part by part: only one part at a time is on disk both as
#: written and as dealt out. Matches within documents are a part of their own, which is not dealt out.
PARTS, KNOWN = 4, -1

#: `h` has 48 bits; `at` is the place in code points (start << 32 | end); `before` and `after` have BITS for each word, the nearest on top.
#: A negative h marks a match within a document, which is known from the start: `before` is then the earlier place. Bits of `own`: the
#: seed is the first of its document with this hash, and with each of CONTEXTS.
SEEDS = "h long, id long, at long, before long, after long, own long"
#: Words of `before` or `after` that make a class of contexts.
CONTEXTS = [("after", 4), ("after", 8), ("before", 4), ("before", 8)]
EVERY = (2 << len(CONTEXTS)) - 1


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n] if n > 0 else out
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def firsts(h: np.ndarray, before: np.ndarray, after: np.ndarray):
    """For seeds alone and for each context: (order by class, whether a class begins there, whether the text has all the words)."""
    side = {"before": before, "after": after}
    for c, n in ((None, 0), *CONTEXTS):
        k, whole = context(side[c], n) if c else (np.zeros(len(h), np.int64), np.ones(len(h), bool))
        order = np.lexsort((k, h))  # stable: the first of a class stays in front
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (k[order][1:] != k[order][:-1])
        yield order, new, whole[order]


def within(row: np.ndarray, h: np.ndarray, before: np.ndarray, after: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For seeds in order of their places: the bits of `own`, and pairs (place, place before) of one seed in one row."""
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    own = np.full(len(h), EVERY)
    if not same.any():
        return own, order[:0], order[:0]
    again, last = order[1:][same], order[:-1][same]
    group = np.zeros(len(h), np.int64)
    group[order[1:]] = np.cumsum(~same)
    own[again] = own[last] = 0
    some = np.flatnonzero(own == 0)
    group = group[some]
    for bit, (by, new, whole) in enumerate(firsts(group, before[some], after[some])):
        own[some[by[new & whole]]] |= 1 << bit
    good = promising(before[again], after[again], before[last], after[last], needed)
    return own, again[good], last[good]


def seeds(docs: DataFrame, words: int, window: int, needed: int = NEEDED) -> DataFrame:
    """SEEDS of docs (id, text)."""

    def pick(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in spans_of_rows(offsets, CHUNK):
                w = Words(data, offsets[lo : hi + 1])
                h = _rolled(w.hashes, words)
                if not len(h):
                    continue
                bits = np.uint64(max(1, len(h).bit_length()))
                ranked = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
                least = window_minima(ranked, window) if len(h) >= window else ranked[:0]
                chosen = []
                for a, b in zip(w.first[:-1].tolist(), (w.first[1:] - words + 1).tolist(), strict=True):
                    if b - a >= window:
                        x = least[a : b - window + 1]
                        chosen.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
                    elif b > a:
                        chosen.append(ranked[a:b].min(keepdims=True))
                if not chosen:
                    continue
                at = np.unique((np.concatenate(chosen) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
                key = (h[at] >> np.uint64(16)).view(np.int64)
                row = np.searchsorted(w.first, at, "right") - 1
                small = np.maximum(w.hashes >> np.uint64(64 - BITS), np.uint64(1))
                sides = []
                for begin, step in ((at - 1, -1), (at + words, 1)):
                    packed = np.zeros(len(at), np.uint64)
                    for j in range(SIDE):
                        k = begin + step * j
                        inside = (k >= w.first[row]) & (k < w.first[row + 1])
                        packed = packed << np.uint64(BITS) | np.where(inside, small[np.clip(k, 0, len(small) - 1)], np.uint64(0))
                    sides.append(packed.view(np.int64))
                chars = np.zeros(len(w.low) + 1, np.int64)
                np.cumsum((w.low & 0xC0) != 0x80, out=chars[1:])
                origin = chars[offsets[lo : hi + 1] - offsets[lo]][row]
                place = (chars[w.starts[at]] - origin) << 32 | (chars[w.ends[at + words - 1]] - origin)
                rows = [key, ids[lo + row], place, *sides]
                own, again, before = within(row, key, *sides, needed)
                rows.append(own)
                keep, none = own > 0, np.zeros(len(again), np.int64)
                known = [-1 - (ids[lo + row[again]] & ((1 << 47) - 1)), rows[1][again], place[again], place[before], none, none]
                rows = [np.concatenate([x[keep], y]) for x, y in zip(rows, known, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=[x.split()[0] for x in SEEDS.split(", ")])

    return docs.select("id", "text").mapInArrow(pick, SEEDS)


def frequent(found: DataFrame, hot: int) -> DataFrame:
    """(h) of the SEEDS that more than `hot` documents hold, by exact counts that are pre-aggregated."""
    first = found.where((F.col("h") >= 0) & (F.col("own").bitwiseAND(F.lit(1)) != 0))
    return first.groupBy("h").count().where(F.col("count") > hot).select("h")


def _words(x: np.ndarray) -> np.ndarray:
    """The words of packed sides, the nearest first."""
    shift = np.arange(BITS * (SIDE - 1), -1, -BITS)
    return (x[:, None] >> shift & ((1 << BITS) - 1)).astype(np.uint8)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words of each packed side x have an equal in y at the same place or next to it."""
    a, b = _words(x), _words(y)
    hit = a == b
    hit[:, 1:] |= a[:, 1:] == b[:, :-1]
    hit[:, :-1] |= a[:, :-1] == b[:, 1:]
    return (hit & (a != 0)).sum(axis=1)


def promising(before: np.ndarray, after: np.ndarray, before2: np.ndarray, after2: np.ndarray, needed: int) -> np.ndarray:
    return (alike(after, after2) >= needed) | (alike(before, before2) >= needed)


MATCHES = "id long, rid long, at long, rat long"


def context(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest words of packed sides, and whether the text has as many."""
    near = values >> BITS * (SIDE - n)
    return near, (near & ((1 << BITS) - 1)) != 0  # words that lack are zeros at the far end


def matched_rows(h: np.ndarray, ids: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, needed: int) -> pa.RecordBatch:
    """MATCHES of whole groups of seeds, which come in order of h, id, at."""
    known = h < 0
    done = [ids[known], ids[known], at[known], before[known]]
    often = np.zeros(len(h), bool)
    often[1:] = h[1:] == h[:-1]
    often[:-1] |= often[1:]
    often &= ~known
    h, ids, at, before, after = (x[often] for x in (h, ids, at, before, after))
    pairs = []
    for order, new, whole in firsts(h, before, after):
        to = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        own = new.copy()  # the first place of each document in the class
        own[1:] |= ids[order][1:] != ids[order][:-1]
        use = own & whole & (ids[order] != ids[to])
        pairs.append(order[use] * len(h) + to[use])
    i, j = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(h)))
    good = promising(before[i], after[i], before[j], after[j], needed)
    i, j = i[good], j[good]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(done, (ids[i], ids[j], at[i], at[j]), strict=True)], names=["id", "rid", "at", "rat"])


def whole_groups(batches, names: list[str]):
    """Arrays of the columns `names` of batches in order of the first one, cut where it changes; a long group is put together once."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in names]
        edges = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        last = int(edges[-1]) if len(edges) else 0
        if last or (rest and rest[-1][0][-1] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*rest, [x[:last] for x in now], strict=True)]
            rest = []
        rest.append([x[last:] for x in now])
    if rest:
        yield [np.concatenate(x) for x in zip(*rest, strict=True)]


def matched(docs: DataFrame, words: int = WORDS, window: int = WINDOW, hot: int = HOT, needed: int = NEEDED, sent: int = OFTEN_SENT) -> DataFrame:
    """MATCHES of the seeds of docs (id, text)."""
    names = ["h", "id", "at", "before", "after"]

    def run(batches):
        for group in whole_groups(batches, names):
            yield matched_rows(*group, needed)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.select(*names).repartition("h").sortWithinPartitions("h", "id", "at").mapInArrow(run, MATCHES)

    found = seeds(docs, words, window, needed)
    if docs.limit(hot + 1).count() <= hot:  # then no seed is in more documents
        return meet(found)
    part = F.pmod("h", F.lit(PARTS)).cast("int")
    with stored_paths() as paths:
        found = stored(found.withColumn("part", F.when(F.col("h") < 0, KNOWN).otherwise(part)), "part")
    out = found.where(F.col("part") == KNOWN).select("id", F.col("id").alias("rid"), "at", F.col("before").alias("rat"))
    seen = found.where(F.col("part") >= 0)
    with stored_paths() as often_paths:
        often = stored(frequent(seen, hot))
        n = often.count()
        send = F.broadcast if n <= sent else lambda rows: rows
        hot_rows = stored(seen.join(send(often), "h", "left_semi")) if n else None
    if n:
        out = out.unionByName(stored(matched_often(hot_rows, needed)))
    for k in range(PARTS):
        rare = found.where(F.col("part") == k)
        out = out.unionByName(stored(meet(rare.join(send(often.where(part == k)), "h", "left_anti") if n else rare)))
        discard(docs.sparkSession, [f"{paths[0]}/part={k}"])
    discard(docs.sparkSession, often_paths)
    return out


def matched_often(found: DataFrame, needed: int) -> DataFrame:
    """MATCHES of seeds that are frequent: first occurrences are grouped minima, which are pre-aggregated, and only those of classes of
    several documents are written and joined, so no seed meets in one task, and none is shuffled while the minima are few."""
    classes = []
    for bit, (c, n) in enumerate([(None, 0), *CONTEXTS]):
        near = F.shiftright(c, BITS * (SIDE - n)) if c else F.lit(0).cast("long")
        whole = near.bitwiseAND(F.lit((1 << BITS) - 1)) != 0 if c else F.lit(True)  # words that lack are zeros at the far end
        use = whole & (F.col("own").bitwiseAND(F.lit(1 << bit)) != 0)
        classes.append(F.struct(F.lit(bit).alias("c"), near.alias("k"), use.alias("use")))
    some = found.select("h", "id", "at", "before", "after", F.explode(F.array(*classes)).alias("x")).where("x.use").select("h", "x.c", "x.k", "id", "at", "before", "after")
    key = ["h", "c", "k"]
    first = stored(some.groupBy(*key).agg(F.min(F.struct("id", "at", "before", "after")).alias("f"), F.count("*").alias("n")).where("n > 1").select(*key, "f"))
    flat = some.join(first, key).where("id <> f.id").select("id", F.col("f.id").alias("rid"), "at", F.col("f.at").alias("rat"), "before", "after", F.col("f.before").alias("before2"), F.col("f.after").alias("after2"))

    def keep(batches):
        for batch in batches:
            good = promising(*(batch.column(c).to_numpy() for c in ("before", "after", "before2", "after2")), needed)
            yield batch.select(["id", "rid", "at", "rat"]).filter(pa.array(good))

    return flat.mapInArrow(keep, MATCHES).distinct()


def blocks(c0, c1, r0, r1, gap: int) -> list[list[int]]:
    """Matches in order of c0, those in a row on one diagonal joined: [c0, c1, r0, r1, seeds, first match]."""
    diagonal = r0 - c0
    new = np.ones(len(c0), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (c0[1:] - c1[:-1] > gap)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(c0)) - 1
    return np.stack([c0[at], c1[end], r0[at], r1[end], end - at + 1, at], axis=1).tolist()


def chains(found: list[list[int]], gap: int = GAP, cost: float = GAP_COST) -> list[list[list[int]]]:
    """Collinear chains of blocks that are ordered by c0. Gap costs grow with the characters skipped in either text, so the best
    predecessor is a prefix maximum over places in the other text, kept in a Fenwick tree."""
    if len(found) == 1:
        return [found]
    places = {r: k + 1 for k, r in enumerate(sorted({b[2] for b in found}))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    score, before = [0.0] * len(found), [-1] * len(found)
    waiting: list[tuple[int, float, int]] = []
    last = None
    for i, (c0, c1, r0, r1, _, _) in enumerate(found):
        if c0 != last:  # blocks with the same c0 do not precede each other
            for k, value, j in waiting:
                while k < len(tree):
                    tree[k] = max(tree[k], (value, j))
                    k += k & -k
            waiting, last = [], c0
        k, best = places[r0] - 1, (-1e18, -1)
        while k:
            best = max(best, tree[k])
            k -= k & -k
        gain = best[0] - cost * (c0 + r0)
        score[i] = c1 - c0 + max(0.0, gain)
        if gain > 0:
            before[i] = best[1]
        waiting.append((places[r0], score[i] + cost * (c1 + r1), i))
    used, out = [False] * len(found), []
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (chain[-1][0] - found[i][1] > gap or chain[-1][2] - found[i][3] > gap):
                out.append(chain[::-1])
                chain = []
            chain.append(found[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


CHAINS = "id long, rid long, c0 int, c1 int, r0 int, r1 int"


def chained(matches: DataFrame, gap: int) -> DataFrame:
    """CHAINS of MATCHES, which come sorted by id, rid, at, rat in each partition."""

    def run(batches):
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            ids, rids = now.column("id").to_numpy(), now.column("rid").to_numpy()
            edges = np.flatnonzero((ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1])) + 1
            last = int(edges[-1]) if len(edges) else 0
            rest = now.slice(last)
            if last:
                yield solve(now.slice(0, last), edges)
        if rest is not None and rest.num_rows:
            yield solve(rest, np.array([rest.num_rows]))

    def solve(part: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        ids, rids, at, rat = (part.column(n).to_numpy() for n in ("id", "rid", "at", "rat"))
        low = np.int64(0xFFFFFFFF)
        c0, c1, r0, r1 = at >> 32, at & low, rat >> 32, rat & low
        out, lo = [], 0
        for hi in edges.tolist():
            for chain in chains(blocks(c0[lo:hi], c1[lo:hi], r0[lo:hi], r1[lo:hi], gap), gap):
                out.append((ids[lo], rids[lo], chain[0][0], max(b[1] for b in chain), chain[0][2], max(b[3] for b in chain)))
            lo = hi
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.int64()] * 2 + [pa.int32()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in CHAINS.split(", ")])

    return matches.mapInArrow(run, CHAINS)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the rows of the alignment table kept as bits of one number."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    m = 0
    while m < n - k and a[-1 - m] == b[-1 - m]:
        m += 1
    a, b = a[k : len(a) - m], b[k : len(b) - m]
    if not a or not b:
        return k + m
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return k + m + len(a) - row.bit_count()


def extended(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many words of a and b belong together from the start. On each diagonal the farthest place after d differences is kept;
    an equal word is worth one, a changed word costs two, a word of one side two and a half. A diagonal is given up DROP below the
    best, where the extension ends."""
    n, m, d = len(a), len(b), 0
    best, ends, reach = -1, (0, 0), {0: 0}  # scores are doubled
    while reach:
        alive = {}
        for k, i in reach.items():
            j = i + k
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            score = i + j - 6 * d
            if score > best:
                best, ends = score, (i, j)
            alive[k] = i
        reach, d = {}, d + 1
        for k, i in alive.items():
            for to, at in ((k, i + 1), (k + 1, i), (k - 1, i + 1)):
                if at <= n and at + to <= m and 2 * at + to - 6 * d >= best - 2 * DROP and at > reach.get(to, -1):
                    reach[to] = at
    return ends


def _low(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.encode().lower().decode()


def _reach(text: str, n: int, of: int) -> int:
    """Where the n-th of the `of` words of text ends, found from the nearer end."""
    if not n:
        return 0
    if 2 * n <= of:
        return next(islice(_WORD.finditer(text), n - 1, None)).end()
    return len(text) - next(islice(_WORD.finditer(text[::-1]), of - n, None)).start()


def aligned(text: str, other: str, q: tuple[int, int], r: tuple[int, int], least: int = 0, cut: tuple[bool, bool, bool, bool] = (False,) * 4) -> tuple | None:
    """text and other with the places q and r of a chain in them -> places after extension, words, identity, and whether an
    extension came near an end where the text was cut (start and end of text, start and end of other) and may go on; None if it is
    settled below `least` words. The chain's ends are ends of seeds, so equal words stand there on both sides."""
    text, other = _low(text), _low(other)
    core, core2 = text[q[0] : q[1]], other[r[0] : r[1]]
    left, left2 = _WORD.findall(text[: q[0]])[::-1], _WORD.findall(other[: r[0]])[::-1]
    right, right2 = _WORD.findall(text[q[1] :]), _WORD.findall(other[r[1] :])
    i0, j0 = extended(left, left2)
    i1, j1 = extended(right, right2)
    x = _WORD.findall(core)
    n = len(x) + i0 + i1
    more = any(c and len(w) - k <= DROP + 2 for c, w, k in zip(cut, (left, right, left2, right2), (i0, i1, j0, j1), strict=True))
    if n < least and not more:
        return None
    y = x if core == core2 else _WORD.findall(core2)
    equal = len(x) if core == core2 else common_words(x, y)
    equal += common_words(left[:i0], left2[:j0]) + common_words(right[:i1], right2[:j1])
    start = lambda t, s, k, w: s[0] - _reach(t[: s[0]][::-1], k, len(w))
    stop = lambda t, s, k, w: s[1] + _reach(t[s[1] :], k, len(w))
    return start(text, q, i0, left), stop(text, q, i1, right), start(other, r, j0, left2), stop(other, r, j1, right2), n, equal / max(n, len(y) + j0 + j1), more


PASSAGES = "id long, rid long, c0 int, c1 int, r0 int, r1 int, n_words int, identity double, more boolean"


def compared(lines: DataFrame, texts: DataFrame, margin: int, min_words: int, identity: float) -> DataFrame:
    """PASSAGES of chains with the texts (id, text) up to `margin` characters around them; rows with `more` are the chains that need a
    wider margin."""
    key = ["id", "rid", "c0", "c1", "r0", "r1"]
    ask = lambda side, who, lo, hi: lines.select(*key, F.lit(side).alias("side"), F.col(who).alias("tid"), F.greatest(F.lit(0), F.col(lo) - margin).alias("lo"), (F.col(hi) + margin).alias("hi"))
    texts = texts.withColumnRenamed("id", "tid")
    asked = ask(0, "id", "c0", "c1").unionByName(ask(1, "rid", "r0", "r1"))
    ids = stored(asked.select("tid").distinct())
    if ids.count() <= IDS_SENT:  # texts that no chain asks for are not dealt out
        texts = texts.join(F.broadcast(ids), "tid", "left_semi")
    slices = asked.join(texts, "tid")
    slices = slices.select(*key, "side", F.expr("substring(text, lo + 1, hi - lo)").alias("part"))
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("part")))
    pairs = slices.groupBy(*key).agg(one(0).alias("a"), one(1).alias("b"))

    def align(batches):
        for batch in batches:
            out = []
            cols = [batch.column(n).to_pylist() for n in key]
            for (who, rid, c0, c1, r0, r1), a, b in zip(zip(*cols, strict=True), batch.column("a"), batch.column("b"), strict=True):
                p, q = max(0, c0 - margin), max(0, r0 - margin)
                a, b = a.as_py(), b.as_py()
                cut = (p > 0, len(a) == c1 + margin - p, q > 0, len(b) == r1 + margin - q)
                got = aligned(a, b, (c0 - p, c1 - p), (r0 - q, r1 - q), min_words, cut)
                if got and got[6]:
                    out.append((who, rid, c0, c1, r0, r1, 0, 0.0, True))
                elif got and got[5] >= identity:
                    out.append((who, rid, got[0] + p, got[1] + p, got[2] + q, got[3] + q, got[4], got[5], False))
            back = list(zip(*out, strict=True)) or [()] * 9
            types = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(back, types, strict=True)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return pairs.mapInArrow(align, PASSAGES)


def found_passages(docs: DataFrame, words: int = WORDS, window: int = WINDOW, gap: int = GAP, min_words: int = MIN_WORDS, identity: float = IDENTITY, hot: int = HOT, margin: int = MARGIN, needed: int = NEEDED) -> DataFrame:
    """Passages of docs (id, text; ids differ) that repeat, nearly, at a place with a first occurrence of their seeds or of those in
    context, or earlier in the document."""
    with stored_paths() as paths:
        matches = matched(docs, words, window, hot, needed)
    lines = stored(chained(matches.repartition("id").sortWithinPartitions("id", "rid", "at", "rat"), gap))
    discard(docs.sparkSession, paths)
    out = None
    while True:
        now = stored(compared(lines, docs, margin, min_words, identity))
        done = now.where("NOT more").drop("more")
        out = done if out is None else out.unionByName(done)
        lines = now.where("more").select("id", "rid", "c0", "c1", "r0", "r1")
        if lines.isEmpty():
            return out
        margin *= 16


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (id, doc_id, text) with an id of their own each, and rows (id, doc_id, n_chars) of the table. A doc_id that no two
    rows share is the id; else equal rows are one document, and documents are numbered."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        docs = docs.select(F.col("doc_id").alias("id"), "doc_id", "text")
        return docs, docs.select("id", "doc_id", F.length("text").alias("n_chars"))
    keyed = docs.select(*row_key("doc_id", "text"), "doc_id", "text")
    one = stored(keyed.dropDuplicates(["_k1", "_k2"]).withColumn("id", F.monotonically_increasing_id()))
    return one.select("id", "doc_id", "text"), keyed.select("_k1", "_k2", "doc_id", F.length("text").alias("n_chars")).join(one.select("_k1", "_k2", "id"), ["_k1", "_k2"]).drop("_k1", "_k2")


LISTED = "array<struct<c0:int,c1:int,rdoc:bigint,r0:int,r1:int,n_words:int,identity:double>>"
HELD = "array<struct<c0:int,c1:int,n:bigint>>"


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_chars, passages: an array of (c0, c1, rdoc, r0, r1, n_words, identity) by place, and held: the ranges (c0, c1, n) of the
    document that n later passages repeat."""
    whole, rows = identified(docs)
    found = found_passages(whole.select("id", "text"), **options)
    names = whole.select(F.col("id").alias("rid"), F.col("doc_id").alias("rdoc"))
    listed = found.join(names, "rid").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("c0", "c1", "rdoc", "r0", "r1", "n_words", "identity"))).alias("passages"))
    # pre-aggregated by start, so what meets for one document is bounded by its length
    starts = found.groupBy("rid", "r0").agg(F.max("r1").alias("r1"), F.count("*").alias("n"))
    held = starts.groupBy(F.col("rid").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("r0").alias("c0"), F.col("r1").alias("c1"), "n"))).alias("held"))
    out = rows.join(listed, "id", "left").join(held, "id", "left")
    return out.select("doc_id", "n_chars", F.coalesce("passages", F.array().cast(LISTED)).alias("passages"), F.coalesce("held", F.array().cast(HELD)).alias("held"))


def covered(ranges):
    """Characters in the union of sorted ranges (c0, c1)."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    grow = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["c1"] - F.greatest(p["c0"], a["to"]))).alias("n"), F.greatest(a["to"], p["c1"]).alias("to"))
    return F.aggregate(ranges, begin, grow, lambda a: a["n"]).cast("long")


def op9(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    place = lambda p: F.struct(p["c0"].alias("c0"), p["c1"].alias("c1"))
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        covered(F.array_sort(F.concat(F.transform("passages", place), F.transform("held", place)))).alias("n_shared"),
        covered(F.col("passages")).alias("n_repeated"),
        F.size("passages").cast("long").alias("n_passages"),
        F.array_sort(F.array_distinct(F.col("passages.rdoc"))).alias("first_in"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["c0"], p["c1"], p["rdoc"], p["r0"], p["r1"], F.format_number(p["identity"], 3))), ",").alias("passages"),
        F.array_join(F.transform("held", lambda p: F.concat_ws(":", p["c0"], p["c1"], p["n"])), ",").alias("held"),
    )
