"""Cross-tokenizer alignment (operator 11): divide and conquer at shared cuts.

Both tokenizers cut the same bytes. Where two of their tokens end at the same byte there is a shared cut. An interval between two
shared cuts is divided at one near its middle, which bisection finds: from the end of the middle token of A to the first end of B
at or behind it, from there to the first end of A, and so on until both are equal; if none comes before the interval's end, the
same to the left. Both halves are divided in turn; an interval without a shared cut inside, or with a single token on one side,
is a leaf and becomes a group. All intervals of a block of texts are divided at the same time, level by level, by array steps.

A link is a pair of token occurrences whose byte ranges overlap; links lie within groups. How many documents hold a pair of ids
linked is a grouped count over all documents. The table of counts goes to the tasks while it has at most BROADCAST rows (some 100
bytes each); beyond that it is joined by shuffling both sides, where a pair that is in most documents can be split.

Texts are tokenized by word: no token of either tokenizer goes on over a blank that follows a character other than white space, so
words that repeat are looked up. Texts with other blanks are tokenized whole.

Edge cases: texts that are null or empty, or whose tokens do not spell the text, have no tokens: zeros and an empty digest;
a null doc_id is kept; repeated rows are documents of their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import spans_of_rows, stored, table, text_bytes

BROADCAST = 1_000_000
CHUNK = 1 << 20
#: Words kept with their tokens in each worker; from this many characters without a blank a slower, equal tokenizer of A is used.
KEPT_WORDS, LONG_RUN = 400_000, 20_000
_HUGE = re.compile(rf"\S{{{LONG_RUN},}}|\s{{{LONG_RUN},}}")
#: Texts of single blanks between words are tokenized by word.
_ODD = re.compile(r"^\s|\s |\s$")


class Tokenizers:
    """Ids of A and B, and the bytes of each id."""

    def __init__(self, a: str | None = None, ranks: str | None = None, b: str | None = None):
        import public_tokenizers as P
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer as Slow

        with open(ranks or P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            merges = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
        self.slow = Slow.from_file(a or P.path("byte_bpe_50k.json"))
        self.slow.encode_special_tokens = True
        self.a = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b or P.path("piece_bpe_32k.model"))
        bytes_a = [b""] * (max(merges.values()) + 1)
        for token, k in merges.items():
            bytes_a[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        #: Of A and B: bytes, their number, and whether a word begins with the id.
        self.bytes = bytes_a, bytes_b
        self.sizes = tuple(np.array([len(x) for x in t], np.int32) for t in self.bytes)
        self.begins = tuple(np.array([x[:1] == b" " for x in t]) for t in self.bytes)
        self.by_word = not any("▁" in x.lstrip("▁") for x in pieces)  # else a piece of B goes on over a blank
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32)] * 2
        self.start, self.count = ([np.zeros(0, np.int64)] * 2 for _ in range(2))
        self.good = np.zeros(0, bool)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for a blank and the text, and of B for the text."""
        slow = len(text) >= LONG_RUN and _HUGE.search(text)
        a = self.slow.encode(f" {text}", add_special_tokens=False).ids if slow else self.a.encode_ordinary(f" {text}")
        return np.array(a, np.int32), np.array(self.b.encode(text), np.int32)

    def spelled(self, ids: tuple[np.ndarray, np.ndarray], text: str) -> bool:
        """Both spell a blank and the text."""
        want = f" {text}".encode()
        return all(b"".join(map(t.__getitem__, x.tolist())) == want for x, t in zip(ids, self.bytes, strict=True))

    def _learn(self, names: list[str], ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], good: np.ndarray) -> None:
        for k in (0, 1):
            ends = np.cumsum(counts[k]) + len(self.flat[k])
            self.start[k] = np.concatenate([self.start[k], ends - counts[k]])
            self.count[k] = np.concatenate([self.count[k], counts[k]])
            self.flat[k] = np.concatenate([self.flat[k], ids[k]])
        self.known.update(zip(names, range(len(self.good), len(self.good) + len(names)), strict=True))
        self.good = np.concatenate([self.good, good])

    def learn(self, words: list[str]) -> None:
        """Tokens of new words, all at once: each begins with the only token of it that begins with a blank."""
        text = " ".join(words)
        ids = self.whole(text)
        begins = [np.flatnonzero(b[x]) for b, x in zip(self.begins, ids, strict=True)]
        if all(len(x) == len(words) for x in begins) and self.spelled(ids, text):
            counts = tuple(np.diff(np.append(at, len(x))) for at, x in zip(begins, ids, strict=True))
            self._learn(words, ids, counts, np.ones(len(words), bool))
        elif len(words) > 1:  # one of them is odd
            self.learn(words[: len(words) // 2])
            self.learn(words[len(words) // 2 :])
        else:
            self._learn(words, ids, tuple(np.array([len(x)]) for x in ids), np.array([self.spelled(ids, text)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens; of A and B: the ids of all these texts, and the number in each."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        names = [[t] if not self.by_word or _ODD.search(t) or len(t) >= LONG_RUN and _HUGE.search(t) else t.split(" ") for t in texts]
        odd = {t for t, n in zip(texts, names, strict=True) if n[0] == t and (not t or len(n) == 1 and (not self.by_word or _ODD.search(t) or len(t) >= LONG_RUN))}
        new = dict.fromkeys(x for n in names for x in n if x not in self.known)
        for x in odd:
            new.pop(x, None)
            if x:
                ids = self.whole(x)
                self._learn([x], ids, tuple(np.array([len(i)]) for i in ids), np.array([self.spelled(ids, x)]))
            else:
                self._learn([x], (np.zeros(0, np.int32),) * 2, (np.zeros(1, np.int64),) * 2, np.array([False]))
        if new:
            self.learn(list(new))
        at = np.array([self.known[x] for n in names for x in n], np.int64)
        first = np.cumsum([0, *map(len, names)])[:-1]
        ok = np.logical_and.reduceat(self.good[at], first)
        at, n = at[np.repeat(ok, np.diff(np.append(first, len(at))))], np.array([len(n) for n, good in zip(names, ok.tolist(), strict=True) if good], np.int64)
        ids, counts = [], []
        for k in (0, 1):
            size = self.count[k][at]
            ends = np.cumsum(size)
            ids.append(self.flat[k][np.repeat(self.start[k][at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
            counts.append(np.diff(np.concatenate([[0], ends[np.cumsum(n) - 1]])) if len(n) else np.zeros(0, np.int64))
        for x in odd:
            del self.known[x]  # whole texts are not kept
        return ok, ids, counts


def shared_cuts(a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted positions where tokens of both end. a, b: ends of the tokens, rising; rows: ends of the texts, which are shared."""
    ia, ib = (np.searchsorted(x, rows) + 1 for x in (a, b))
    intervals = np.stack([np.concatenate([[0], ia[:-1]]), ia, np.concatenate([[0], ib[:-1]]), ib])  # tokens [a0, a1) and [b0, b1)
    cuts = [rows]
    while intervals.shape[1]:
        intervals = intervals[:, (intervals[1] - intervals[0] > 1) & (intervals[3] - intervals[2] > 1)]
        a0, a1, b0, b1 = intervals
        at_a, at_b = np.full(len(a0), -1), np.full(len(a0), -1)
        middle = (a0 + a1) // 2 - 1  # last token of the left half
        # to the right: bisect for an end of B, then of A, until both are the same or the interval ends
        todo, i = np.arange(len(a0)), middle.copy()
        while len(todo):
            j = np.searchsorted(b, a[i])
            k = np.searchsorted(a, b[j])
            same = b[j] == a[i]
            inside = (i < a1[todo] - 1) & (j < b1[todo] - 1)
            hit = same & inside
            at_a[todo[hit]], at_b[todo[hit]] = i[hit], j[hit]
            more = inside & ~same
            todo, i = todo[more], k[more]
        # to the left, where nothing was found
        todo = np.flatnonzero(at_a < 0)
        i = middle[todo]
        while len(todo):
            j = np.searchsorted(b, a[i], "right") - 1
            inside = (i >= a0[todo]) & (j >= b0[todo])
            todo, i, j = todo[inside], i[inside], j[inside]
            k = np.searchsorted(a, b[j], "right") - 1
            same = b[j] == a[i]
            at_a[todo[same]], at_b[todo[same]] = i[same], j[same]
            todo, i = todo[~same], k[~same]
        cut = at_a >= 0
        at_a, at_b, (a0, a1, b0, b1) = at_a[cut], at_b[cut], intervals[:, cut]
        cuts.append(a[at_a])
        halves = np.stack([a0, at_a + 1, at_a + 1, a1, b0, at_b + 1, at_b + 1, b1])
        intervals = halves.reshape(2, 2, 2, -1).transpose(0, 2, 3, 1).reshape(4, -1)  # both halves side by side, in order
    return np.sort(np.concatenate(cuts))


class Digests:
    """`a1,a2|b1;a3|b2,b3` of texts."""

    def __init__(self, ids: int):
        self.ids = ids
        self.shown = np.array([f"{k}{mark}".encode() for mark in (",", "|", ";", "") for k in range(ids)], object)

    def parts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
        """Ids with what follows each, in order of groups. group_a, group_b: rising numbers of the groups; ends_b: ends of texts in b."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        groups = int(group_a[-1]) + 1
        count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = a + self.ids * last_a
        mark_b = np.where(last_b, 2, 0)
        mark_b[ends_b - 1] = 3
        out[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = b + self.ids * mark_b
        return self.shown[out].tolist()


LINKED = "doc_id long, part int, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<int>, times array<int>"


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_groups: bool = False, **paths) -> DataFrame:
    """One row for each document: counts, the digest of its groups (with keep_groups the groups themselves), its distinct linked
    pairs of ids (as id of A times the size of B, plus id of B) and how often each is linked. (part, row) numbers the rows."""

    def work(batches):
        t = Tokenizers(**paths)
        digests = Digests(max(map(len, t.bytes)))
        row, part = 0, TaskContext.get().partitionId()
        if len(t.bytes[0]) * len(t.bytes[1]) >= 1 << 31:
            raise ValueError("pairs of ids need more than 31 bits")
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in spans_of_rows(offsets, CHUNK):
                ok, ids, counts = t.encode([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
                out = aligned(ids, counts, t, digests, keep_groups)
                rows = [next(out) if good else (0, 0, 0, 0, "", "" if keep_groups else None, [], []) for good in ok.tolist()]
                n = len(rows)
                cols = [batch.column(0).slice(lo, n), np.full(n, part), np.arange(row, row + n), *zip(*rows, strict=True)]
                row += n
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=[x.split()[0] for x in LINKED.split(", ")])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(work, LINKED)


def before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place."""
    return np.cumsum(marks, dtype=np.int32) - marks


def aligned(ids: list[np.ndarray], counts: list[np.ndarray], t: Tokenizers, digests: Digests, keep_groups: bool):
    """A row for each text of a block; ids and counts as Tokenizers.encode gives them."""
    (a, b), n = ids, len(counts[0])
    if not n:
        return
    ends_a, ends_b = (np.cumsum(sizes[x], dtype=np.int32) for sizes, x in zip(t.sizes, ids, strict=True))
    till_a, till_b = map(np.cumsum, counts)
    rows = ends_a[till_a - 1]
    cuts = shared_cuts(ends_a, ends_b, rows)
    at_a, at_b, at_cut = (np.zeros(int(rows[-1]) + 1, bool) for _ in range(3))
    at_a[ends_a] = at_b[ends_b] = at_cut[cuts] = True
    groups = before(at_cut)
    group_a, group_b = groups[ends_a], groups[ends_b]
    # a link lies between each two neighbouring ends of either
    ends = np.flatnonzero(at_a | at_b)
    link_a, link_b = before(at_a)[ends], before(at_b)[ends]
    n_links = np.diff(np.searchsorted(ends, rows, "right"), prepend=0)
    pairs = a[link_a].astype(np.int64) * len(t.bytes[1]) + b[link_b]
    distinct, times = np.unique((np.repeat(np.arange(n), n_links) << 31) | pairs, return_counts=True)
    of = np.searchsorted(distinct, np.arange(n + 1) << 31)
    pairs, times = (distinct & ((1 << 31) - 1)).astype(np.int32), times.astype(np.int32)
    parts = digests.parts(a, b, group_a, group_b, till_b)
    a0 = b0 = g0 = 0
    for i, (a1, b1, g1) in enumerate(zip(till_a.tolist(), till_b.tolist(), (group_a[till_a - 1] + 1).tolist(), strict=True)):
        shown = b"".join(parts[a0 + b0 : a1 + b1])
        yield a1 - a0, b1 - b0, g1 - g0, int(n_links[i]), hashlib.sha256(shown).hexdigest(), shown.decode() if keep_groups else None, pairs[of[i] : of[i + 1]], times[of[i] : of[i + 1]]
        a0, b0, g0 = a1, b1, g1


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, n_docs, best) over all rows of linked(): documents that hold the pair linked; best if no pair of its a has more."""
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")))
    a = F.expr(f"pair div {width}")
    most = stored(counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most")))  # at most a row for each id of A
    return stored(counts.withColumn("a", a).join(most, "a").select("pair", "a", F.pmod("pair", F.lit(width)).alias("b"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def aligned_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_groups: bool = False, broadcast: int = BROADCAST, **paths) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (null without keep_groups), n_best and count_sum."""
    found = stored(linked(docs, text, key, keep_groups, **paths))
    counts = pair_counts(found, _size_of_b(paths.get("b"))).select("pair", "n_docs", "best")
    if counts.count() <= broadcast:
        counts = F.broadcast(counts)
    each = found.select("part", "row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("part", "row", F.col("x.pairs").alias("pair"), "x.times")
    sums = each.join(counts, "pair").groupBy("part", "row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    whole = found.select("doc_id", "part", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups").join(sums, ["part", "row"], "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))


def _size_of_b(b: str | None) -> int:
    import public_tokenizers as P
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b or P.path("piece_bpe_32k.model")).get_piece_size()


def op11(spark, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents")).drop("groups")
