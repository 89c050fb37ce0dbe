"""Fill-in-middle transformation (operator 12): documents as piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text in UTF-8, and the
sentinels. Cutting at two token ends splits the one descriptor of the text in three; an arrangement is a permutation of these,
with a sentinel before each; the text put out, and its hash, are streamed from the descriptors. Restoring reads the sentinels of
a text put out, makes descriptors over that text, and applies the inverse permutation.

Edge cases: null text is empty; an empty text, and one that holds a sentinel already, stays plain; texts that are not UTF-8 do not
occur in string columns; a null doc_id counts as an empty id; repeated rows give repeated results; an empty table gives no rows;
columns named as the new ones are replaced, all others stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, replaced, spans_of_rows, table, text_bytes, with_schema

SEED, RATE, SPM = 42, 50, 80
SENTINELS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
#: Order of the parts in each form; the sentinel of a part stands before it.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
TEXT, MARKS = 0, 1
CHUNK = 1 << 22
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: tuple[memoryview, memoryview], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte `at` of the document; a cut at an edge leaves an empty piece."""
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[k : k + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise IndexError("cut beyond the end")

    def permuted(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def before_each(self, marks: list[tuple[int, int]]) -> PieceTable:
        """With a descriptor over the buffer of marks before each piece."""
        return PieceTable(self.buffers, [x for mark, piece in zip(marks, self.pieces, strict=True) for x in ((MARKS, *mark), piece)])

    def chunks(self):
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.chunks())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(k) for k in range(len(order)))


def marks_of(sentinels: tuple[str, ...]) -> tuple[memoryview, list[tuple[int, int]]]:
    """The sentinel buffer, and start and length of each sentinel in it."""
    raw = [s.encode() for s in sentinels]
    starts = np.cumsum([0, *map(len, raw)]).tolist()
    return memoryview(b"".join(raw)), [(a, len(r)) for a, r in zip(starts, raw, strict=False)]


def arranged(text: memoryview, ends: tuple[int, int], form: str, sentinels: tuple[str, ...] = SENTINELS) -> PieceTable:
    """The text cut behind prefix and middle and put in order of the form."""
    marks, spans = marks_of(sentinels)
    whole = PieceTable((text, marks), [(TEXT, 0, len(text))])
    if form == "plain":
        return whole
    whole.cut(ends[1])
    whole.cut(ends[0])
    parts = PieceTable(whole.buffers, [whole.pieces[k] for k in (0, 2, 1)])  # prefix, suffix, middle
    order = ORDERS[form]
    return parts.permuted(order).before_each([spans[k] for k in order])


def restored(output: memoryview, form: str, sentinels: tuple[str, ...] = SENTINELS) -> PieceTable:
    """The text again, as descriptors over what was put out. No part holds a sentinel, so the first one found is the right one."""
    marks, spans = marks_of(sentinels)
    if form == "plain":
        return PieceTable((output, marks), [(TEXT, 0, len(output))])
    raw, order, pieces, at = bytes(output), ORDERS[form], [], 0
    for here, following in zip(order, [*order[1:], None], strict=True):
        start = at + spans[here][1]
        at = len(raw) if following is None else raw.index(marks[spans[following][0] :][: spans[following][1]].tobytes(), start)
        pieces.append((TEXT, start, at - start))
    prefix, suffix, middle = inverse(order)
    return PieceTable((output, marks), pieces).permuted((prefix, middle, suffix))


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of tokens (blanks with the word after them, or blanks at the end of a text), and how many ends stand before each row."""
    blank = _BLANK[data]
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1 - offsets[0]] = True
    ends = last.copy()
    ends[:-1] |= ~blank[:-1] & blank[1:]
    at = np.flatnonzero(ends) + 1 + offsets[0]
    return at, np.searchsorted(at, offsets, "right")


NAMES = ["n long", "form string", "prefix_chars long", "middle_chars long", "pieces array<struct<buffer:int,start:int,length:int>>", "output string", "output_sha256 string"]


def transform(docs: DataFrame, text: str = "text", key: Column | None = None, rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """docs with the number of tokens, the form, lengths of prefix and middle in code points, the descriptors (byte ranges of buffer
    0, the text, and 1, the sentinels), the text put out and its hash. `key` (default: doc_id) decides cuts and form."""
    key = F.col("doc_id") if key is None else key
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    (hash_column,) = fresh(docs)
    docs = docs.withColumn(hash_column, drawn)
    marks = [s.encode() for s in sentinels]

    def form_of(raw: bytes, h: list[int]) -> str:
        if not raw or h[2] % 100 >= rate or any(m in raw for m in marks):
            return "plain"
        return "spm" if h[3] % 100 < spm else "psm"

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            drawn = batch.column(batch.schema.get_field_index(hash_column)).to_pylist()
            out: list[tuple] = []
            for lo, hi in spans_of_rows(offsets, CHUNK):
                part = offsets[lo : hi + 1]
                ends, first = token_ends(data[part[0] : part[-1]], part)
                chars = np.zeros(part[-1] - part[0] + 1, np.int64)
                np.cumsum((data[part[0] : part[-1]] & 0xC0) != 0x80, out=chars[1:])
                for i in range(lo, hi):
                    begin, stop, f = int(offsets[i]), int(offsets[i + 1]), int(first[i - lo])
                    n = int(first[i - lo + 1]) - f
                    h = [int(drawn[i][k : k + 8], 16) for k in range(0, 32, 8)]
                    raw = data[begin:stop].tobytes()
                    form = form_of(raw, h)
                    units = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    a, b = (int(ends[f + u - 1]) - begin if u else 0 for u in units)
                    done = arranged(memoryview(raw), (a, b), form, sentinels)
                    count = lambda x, y: int(chars[begin - part[0] + y] - chars[begin - part[0] + x])  # noqa: B023, E731
                    sizes = (None, None) if form == "plain" else (count(0, a), count(a, b))
                    pieces = [{"buffer": x, "start": y, "length": z} for x, y, z in done.pieces]
                    out.append((n, form, *sizes, pieces, done.bytes().decode(), done.sha256()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            piece = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), piece, pa.string(), pa.string()]
            yield replaced(batch, {x.split()[0]: pa.array(c, t) for x, t, c in zip(NAMES, types, cols, strict=True)})

    return docs.mapInArrow(work, with_schema(docs, ", ".join(NAMES))).drop(hash_column)


def restore(done: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Rows of `output` and `form` with `restored`, the text before, and `restored_sha256`, by nothing else than these two."""

    def work(batches):
        for batch in batches:
            texts, hashes = [], []
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            for output, form in zip(batch.column(batch.schema.get_field_index("output")), forms, strict=True):
                back = restored(memoryview((output.as_py() or "").encode()), form, sentinels)
                texts.append(back.bytes().decode())
                hashes.append(back.sha256())
            yield replaced(batch, {"restored": pa.array(texts, pa.string()), "restored_sha256": pa.array(hashes, pa.string())})

    return done.mapInArrow(work, with_schema(done, "restored string, restored_sha256 string"))


def op12(spark, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = restore(done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"))
    return done.select(F.col("doc_id").cast("long"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
u AS (SELECT *, len(w) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM w),
c AS (SELECT *, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS s FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""
