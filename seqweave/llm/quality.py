"""Quality classifier (operator 13): a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The sum over pairs is half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2,
so a text is scored in time linear in its features. Features of a text:

* words (runs of letters, digits and other bytes of UTF-8 text, ASCII letters in lower case) and marks (runs of all else but blanks),
  hashed into WORDS places; x is log(1 + count), all of a text scaled to length one;
* structure: the shares in STRUCTURE, each between 0 and 1;
* metadata: for each named numeric column log(1 + value) / 20, and whether it has a value.

The machine is fitted on the driver on a bounded sample: at most PER_CLASS rows of each label, those with the least hashes, of
whole texts reduced to features (WORDS and a few at most) by tasks. Scores are calibrated to the labels' counts over all rows.

Edge cases: null text is empty, and an empty text has a score from bias, structure and metadata; labels other than 0 and 1 and rows
without a document teach nothing; without rows of both labels the score is (ones + 1) / (rows + 2); repeated rows give repeated
results; an empty table gives no rows; columns named as the new ones are replaced; a metadata value that is null, negative or
not finite counts as missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, replaced, spans_of_rows, table, text_bytes, with_schema
from .suffixdedup import _P, _PINV, _power

WORDS, RANK = 1 << 14, 8
#: Rows of each label that teach, at most.
PER_CLASS = 1500
EPOCHS, BATCH, RATE, DECAY, DROP, FOLDS = 12, 64, 0.05, 1e-4, 0.5, 3
THRESHOLD = 0.3
CHUNK = 1 << 20
STRUCTURE = ("upper case of letters", "digits", "marks", "blanks", "line ends", "bytes beyond ASCII", "mean word length / 32", "distinct of words", "distinct of lines", "commonest word", "texts without a word", "log of words / 16")

_KIND = np.zeros(256, np.int8)  # 0 mark, 1 blank, 2 lower-case letter, 3 upper-case letter, 4 digit, 5 beyond ASCII
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[0x80:] = 5
_RUN = np.array([0, 1, 2, 2, 2, 2], np.int8)[_KIND]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the given ranges of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_PINV, len(data) + 1)[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(breaks)
    return starts, np.append(starts[1:], len(breaks))


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted by row, and how often each occurs."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return row[at], key[at], np.diff(np.append(at, len(row)))


class Features:
    """Sparse rows: those of row i are [start[i], start[i + 1])."""

    def __init__(self, start: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.start, self.at, self.x = start, at, x


def features(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> Features:
    """Of texts laid out in data by offsets; metadata: (rows, columns), NaN where missing."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n, size = len(offsets) - 1, np.diff(offsets)
    filled = np.flatnonzero(size)
    kind = _KIND[data]
    owner = np.repeat(np.arange(n), size)
    breaks = np.ones(len(data), bool)
    breaks[1:] = _RUN[data[1:]] != _RUN[data[:-1]]
    breaks[offsets[:-1][filled]] = True
    starts, ends = _runs(breaks)
    text = kind[starts] != 1
    starts, ends = starts[text], ends[text]
    words, row = kind[starts] >= 2, owner[starts]
    low = _LOWER[data]
    h = run_hashes(low, starts, ends)
    place = (h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)
    word_row, word_at, times = _distinct(row, place, n)
    x = np.log1p(times)
    x /= np.sqrt(np.bincount(word_row, x * x, n))[word_row]
    # structure
    count = lambda which: np.bincount(owner[which], minlength=n)
    share = lambda a, b: a / np.maximum(b, 1)
    kinds = [count(kind == k) for k in range(6)]
    letters = np.bincount(row[words], minlength=n)
    lengths = np.bincount(row[words], (ends - starts)[words], n)
    line = np.zeros(len(data), bool)
    line[offsets[:-1][filled]] = True
    line[1:] |= data[:-1] == 10
    line_starts, line_ends = _runs(line)
    lines = np.bincount(owner[line_starts], minlength=n) if len(data) else np.zeros(n, int)
    line_row, _, _ = _distinct(owner[line_starts], run_hashes(low, line_starts, line_ends), n)
    each_row, _, often = _distinct(row[words], h[words], n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, each_row, often)
    stats = [share(kinds[3], kinds[2] + kinds[3]), share(kinds[4], size), share(kinds[0], size), share(kinds[1], size), share(np.bincount(owner[data == 10], minlength=n), size), share(kinds[5], size)]
    stats += [np.minimum(1, share(lengths, letters) / 32), share(np.bincount(each_row, minlength=n), letters), share(np.bincount(line_row, minlength=n), lines), share(commonest, letters), letters == 0, np.minimum(1, np.log1p(letters) / 16)]
    known = np.isfinite(metadata) & (metadata >= 0)
    stats += [np.where(k, np.log1p(np.where(k, m, 0)) / 20, 0) for k, m in zip(known.T, metadata.T, strict=True)] + [k.astype(float) for k in known.T]
    dense = np.stack(stats, axis=1).astype(np.float64)
    per_row = np.bincount(word_row, minlength=n)
    total = per_row + dense.shape[1]
    start = np.concatenate([[0], np.cumsum(total)])
    at, value = np.empty(start[-1], np.int32), np.empty(start[-1], np.float32)
    inside = np.arange(len(word_row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    at[start[word_row] + inside], value[start[word_row] + inside] = word_at, x
    tail = (start[1:] - dense.shape[1])[:, None] + np.arange(dense.shape[1])
    at[tail], value[tail] = WORDS + np.arange(dense.shape[1]), dense
    return Features(start, at, value)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


class FactorisationMachine:
    def __init__(self, size: int, rank: int = RANK, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias, self.slope, self.shift, self.w = 0.0, 1.0, 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.1, (size, rank)).astype(np.float32)

    def raw(self, f: Features) -> np.ndarray:
        """Before the sigmoid, in linear time: half of the square of the sums less the sums of the squares."""
        x = f.x[:, None]
        vx = self.v[f.at] * x
        sums, squares = np.add.reduceat(vx, f.start[:-1]), np.add.reduceat(vx * vx, f.start[:-1])
        return self.bias + np.add.reduceat(self.w[f.at] * f.x, f.start[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, f: Features) -> np.ndarray:
        return sigmoid(self.slope * self.raw(f) + self.shift)

    def gradients(self, f: Features, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the mean cross-entropy: for the bias, and for w and v of each entry of f."""
        n = np.diff(f.start)
        d = (sigmoid(self.raw(f)) - y) / len(y)
        each = np.repeat(d, n) * f.x
        vx = self.v[f.at] * f.x[:, None]
        sums = np.repeat(np.add.reduceat(vx, f.start[:-1]), n, axis=0)
        return float(d.sum()), each, each[:, None] * (sums - vx)

    def train(self, f: Features, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> None:
        """Steps scaled by the squares of former gradients of each parameter; words are left out at random."""
        rng = np.random.default_rng(seed)
        w2, v2, b2 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                pick = order[k : k + batch]
                part = rows_of(f, pick)
                part.x = part.x * ((rng.random(len(part.at)) >= DROP) | (part.at >= WORDS))
                b, w, v = self.gradients(part, y[pick])
                ids, inverse = np.unique(part.at, return_inverse=True)
                gw = np.bincount(inverse, w) + DECAY * self.w[ids]
                gv = np.stack([np.bincount(inverse, c) for c in v.T], axis=1) + DECAY * self.v[ids]
                w2[ids] += gw * gw
                v2[ids] += gv * gv
                b2 += b * b
                self.w[ids] -= rate * gw / np.sqrt(w2[ids])
                self.v[ids] -= rate * gv / np.sqrt(v2[ids])
                self.bias -= rate * b / np.sqrt(b2)

    def calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
        """Slope and shift of the logistic fit of labels on raw scores of rows that did not teach; the ridge draws the slope to 1."""
        x, theta = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
        pull = np.array([ridge, 1e-3])
        for _ in range(50):
            p = sigmoid(x @ theta)
            slope = x.T @ (weight * (p - y)) + pull * (theta - (1, 0))
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            theta = theta - np.clip(np.linalg.solve(curve, slope), -1, 1)
        self.slope, self.shift = max(float(theta[0]), 1e-3), float(theta[1])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _metadata(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
    return np.stack(cols, axis=1) if cols else np.zeros((batch.num_rows, 0))


def with_numbers(docs: DataFrame, metadata: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """docs with the metadata columns as doubles of fresh names."""
    names = fresh(docs, len(metadata))
    return docs.withColumns({n: F.col(c).cast("double") for n, c in zip(names, metadata, strict=True)}), names


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", metadata: tuple[str, ...] = (), per_class: int = PER_CLASS) -> tuple[Features, np.ndarray, tuple[int, int]]:
    """Features and labels of at most per_class rows of each label, and how many rows of docs have label 0 and 1."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("_y")).where(F.col(key).isNotNull() & F.col("_y").isin(0, 1))
    known = known.join(docs.select(key), key, "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    least = lambda df, order, y: df.where(F.col("_y") == y).orderBy(*order).limit(per_class)
    chosen = least(known, [F.xxhash64(key), key], 0).union(least(known, [F.xxhash64(key), key], 1)).distinct()
    numbers, names = with_numbers(docs.select(key, text, *metadata), metadata)
    rows = numbers.join(F.broadcast(chosen), key).select("_y", F.xxhash64(key, text).alias("_h"), text, *names)

    def reduce(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            meta = _metadata(batch, names)
            for lo, hi in spans_of_rows(offsets, CHUNK):
                f = features(data, offsets[lo : hi + 1], meta[lo:hi])
                lists = lambda x, ty: pa.ListArray.from_arrays(pa.array(f.start, pa.int32()), pa.array(x, ty))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists(f.at, pa.int32()), lists(f.x, pa.float32())], names=["_y", "_h", "at", "x"])

    reduced = rows.mapInArrow(reduce, "_y int, _h long, at array<int>, x array<float>")
    got = pa.Table.from_batches([b for y in (0, 1) for b in least(reduced, ["_h"], y).toArrow().to_batches()] or []) if counts else None
    if got is None or not got.num_rows:
        return Features(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)), np.zeros(0), (counts.get(0, 0), counts.get(1, 0))
    lists = got.column("at").combine_chunks(), got.column("x").combine_chunks()
    start = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])
    return Features(start, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()), got.column("_y").to_numpy(), (counts.get(0, 0), counts.get(1, 0))


def rows_of(f: Features, pick: np.ndarray) -> Features:
    n = np.diff(f.start)[pick]
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(f.start[pick] - start[:-1], n) + np.arange(start[-1])
    return Features(start, f.at[at], f.x[at])


def fit(f: Features, y: np.ndarray, counts: tuple[int, int], folds: int = FOLDS, **options) -> FactorisationMachine | float:
    """A machine for (features, labels) drawn from rows with so many labels 0 and 1; one score for all without both labels. Scores are
    calibrated on what machines of the other folds make of each fold, weighted to the counts of all rows."""
    ones, rows = int(y.sum()), len(y)
    if not ones or ones == rows:
        return (counts[1] + 1) / (sum(counts) + 2)
    y, size = y.astype(np.float32), max(WORDS, int(f.at.max()) + 1)
    machine = FactorisationMachine(size)
    machine.train(f, y, **options)
    fold = np.random.default_rng(9).permutation(rows) % folds
    raw = np.zeros(rows)
    for k in range(folds):
        if (fold == k).any() and 0 < y[fold != k].sum() < (fold != k).sum():
            part = FactorisationMachine(size)
            part.train(rows_of(f, np.flatnonzero(fold != k)), y[fold != k], **options)
            raw[fold == k] = part.raw(rows_of(f, np.flatnonzero(fold == k)))
    weight = np.where(y > 0, counts[1] / ones, counts[0] / (rows - ones))
    machine.calibrate(raw, y, weight * rows / weight.sum())
    return machine


def scored(docs: DataFrame, machine: FactorisationMachine | float, text: str = "text", metadata: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; the score depends on text and metadata alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    numbers, names = with_numbers(docs, metadata)

    def work(batches):
        machine = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            meta, score = _metadata(batch, names), np.zeros(batch.num_rows)
            for lo, hi in spans_of_rows(offsets, CHUNK):
                score[lo:hi] = machine if isinstance(machine, float) else machine.scores(features(data, offsets[lo : hi + 1], meta[lo:hi]))
            yield replaced(batch, {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return numbers.mapInArrow(work, with_schema(numbers, "score double, predicted int")).drop(*names)


def trained(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",)) -> FactorisationMachine | float:
    """The machine for a table of documents: held-out documents teach nothing."""
    return fit(*sample(docs.where(~held_out()), labels, metadata=metadata))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text", "n_chars"), trained(docs, table(spark, sf_dir, "labels")), metadata=("n_chars",))
    return out.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "score", "predicted")
