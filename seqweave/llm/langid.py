"""Language ID (operator 4): a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into windows of WINDOW bytes, which together hold every byte. In each window a forward and a backward GRU read
the bytes, and each position gets probabilities of the languages from both states; a document's probabilities are the mean over
its positions. The network is fitted on the driver on a bounded sample: at most PER_LANG rows of each of the MOST_LANGS commonest
languages, one passage of at most PASSAGE characters from each. Labels are only read there; a prediction uses the text alone.

Edge cases: null text and text without a letter are `und` with score 0; rows without a label teach nothing; without any
labelled row everything is `und`; ties go to the first language in order; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import replaced, spans_of_rows, table, text_bytes, with_schema

WINDOW, HIDDEN, STEPS, BATCH, RATE = 64, 8, 500, 192, 0.02
#: Rows of a language and characters of a row that teach, and languages that are learned (the commonest), at most.
PER_LANG, PASSAGE, MOST_LANGS = 400, 1000, 100
LANES = 2048
PAD = 256
#: The pipeline rejects documents whose pooled probability is below this, and `und`.
REJECT = 0.35


def windows(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ids (length, windows), filled up with PAD; bytes in each window; row of each window."""
    sizes = np.diff(offsets)
    count = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + k * length
    n = np.minimum(length, offsets[1:][row] - start)
    at = start + np.arange(length)[:, None]
    ids = data[np.minimum(at, len(data) - 1)].astype(np.int16) if len(row) else np.zeros((length, 0), np.int16)
    ids[np.arange(length)[:, None] >= n] = PAD
    return ids, n, row


class ByteGRU:
    """Axis 0 of the weights is the direction. embed: gate inputs of each byte; u: recurrent weights; out, bias: to classes."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {
            "embed": rng.normal(0, 0.3, (2, 3 * hidden, PAD + 1)).astype("f4"),
            "u": rng.normal(0, 0.4 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype("f4"),
            "out": rng.normal(0, 0.3, (2, classes, hidden)).astype("f4"),
            "bias": np.zeros((classes, 1), "f4"),
        }

    def train(self, ids: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, ids.shape[1], batch)
            x = ids[:, pick].copy()
            short = rng.random(batch) < 0.15
            x[(np.arange(len(x))[:, None] >= rng.integers(4, len(x), batch)) & short] = PAD
            g = self.gradients(x, labels[pick])
            lr = rate * (1 - step / (steps + 1)) ** 0.5
            for k, grad in g.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over positions."""
        w, h, (length, n) = self.w, self.h, x.shape
        both = np.stack([x, x[::-1]])  # the backward direction reads from the end
        state = np.zeros((2, h, n), "f4")
        past, zs, rs, ns, uns = [], [], [], [], []
        for t in range(length):
            a = np.stack([w["embed"][d][:, both[d, t]] for d in (0, 1)])
            u = w["u"] @ state
            zr = 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + u[:, : 2 * h])) + 0.5
            z, r, un = zr[:, :h], zr[:, h:], u[:, 2 * h :]
            new = np.tanh(a[:, 2 * h :] + r * un)
            for kept, value in ((past, state), (zs, z), (rs, r), (ns, new), (uns, un)):
                kept.append(value)
            state = new + z * (state - new)
        states = [*past[1:], state]
        real = (x != PAD).astype("f4")
        real /= max(1.0, real.sum())
        target = np.zeros((w["bias"].shape[0], n), "f4")
        target[y, np.arange(n)] = 1
        g = {k: np.zeros_like(v) for k, v in w.items()}
        into = [np.zeros((2, h, n), "f4") for _ in range(length)]
        for t in range(length):
            s = length - 1 - t
            logit = w["out"][0] @ states[t][0] + w["out"][1] @ states[s][1] + w["bias"]
            p = np.exp(logit - logit.max(axis=0))
            d = (p / p.sum(axis=0) - target) * real[t]
            g["bias"] += d.sum(axis=1, keepdims=True)
            g["out"][0] += d @ states[t][0].T
            g["out"][1] += d @ states[s][1].T
            into[t][0] += w["out"][0].T @ d
            into[s][1] += w["out"][1].T @ d
        back = np.zeros((2, h, n), "f4")
        gates = np.empty((length, 2, 3 * h, n), "f4")
        for t in range(length - 1, -1, -1):
            d = back + into[t]
            z, r, new, un = zs[t], rs[t], ns[t], uns[t]
            dn = d * (1 - z) * (1 - new * new)
            dz = d * (past[t] - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            gates[t] = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            g["u"] += du @ past[t].transpose(0, 2, 1)
            back = d * z + w["u"].transpose(0, 2, 1) @ du
        for d in (0, 1):
            flat = gates[:, d].transpose(1, 0, 2).reshape(3 * h, -1)
            at = both[d].reshape(-1)
            g["embed"][d] = np.stack([np.bincount(at, f, PAD + 1) for f in flat])
        return g

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (position, class, window) of a block of windows."""
        h, (length, n) = self.h, x.shape
        half = np.repeat(np.array([0.5, 0.5, 1], "f4"), h)[:, None]  # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
        embed = [np.ascontiguousarray((e * half).T) for e in self.w["embed"]]
        u, out = self.w["u"] * half, self.w["out"]
        logits = np.repeat(self.w["bias"][None], length, axis=0).repeat(n, axis=2)
        for d in (0, 1):
            state = np.zeros((h, n), "f4")
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                a = embed[d].take(x[t], axis=0).T
                g = u[d] @ state
                zr = g[: 2 * h]
                zr += a[: 2 * h]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                new = g[2 * h :]
                new *= zr[h:]
                new += a[2 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= zr[:h]
                state += new
                logits[t] += out[d] @ state
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (row, class) over the positions of each row; rows without bytes get zeros."""
        ids, n, row = windows(data, offsets)
        total = np.zeros((len(offsets) - 1, self.w["bias"].shape[0]))
        for k in range(0, ids.shape[1], LANES):
            x = ids[:, k : k + LANES]
            p = self.positions(x)
            p *= (x != PAD)[:, None]
            np.add.at(total, row[k : k + LANES], p.sum(axis=0).T)
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def sample(labelled: DataFrame, text: str, lang: str, key: str, per_lang: int = PER_LANG, most: int = MOST_LANGS) -> list[tuple[str, str]]:
    """(passage, lang) of per_lang rows at most of each of the `most` commonest languages: the rows with the least hashes of key and
    text. Tasks keep per_lang rows of a language each before any is dealt out."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), text, F.lit(5)).alias("h"))
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    start = F.pmod(F.xxhash64("h", F.lit(6)), F.greatest(F.lit(1), F.length("text") - PASSAGE)) + 1
    passages = rows.where(F.col("lang").isin(langs)).select(F.substr("text", start.cast("int"), F.lit(PASSAGE)).alias("text"), "lang", "h")
    picked = passages.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("place") <= per_lang)
    return sorted(((r.text, r.lang) for r in picked.collect()), key=lambda r: (r[1], r[0]))


def fit(rows: list[tuple[str, str]], **options) -> tuple[list[str], ByteGRU | None]:
    """Languages in order, and a network trained on windows of (text, lang) rows, as many of each language."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return [], None
    ids, labels = [], []
    for k, lang in enumerate(langs):
        texts = [t.encode() for t, x in rows if x == lang]
        x, n, _ = windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        ids.append(x[:, n >= 8] if (n >= 8).any() else x)
        labels.append(np.full(ids[-1].shape[1], k))
    most = max(x.shape[1] for x in ids)
    ids = [x[:, np.arange(most) % x.shape[1]] for x in ids]
    labels = [np.full(most, k) for k in range(len(langs))]
    net = ByteGRU(len(langs))
    net.train(np.concatenate(ids, axis=1), np.concatenate(labels), **options)
    return langs, net


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, langs: list[str], net: ByteGRU | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, net))

    def label(batches):
        langs, net = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = text_bytes(column)
            names, scores = [], []
            for lo, hi in spans_of_rows(offsets, 1 << 20):
                if net is not None:
                    p = net.pooled(data, offsets[lo : hi + 1])
                    best = p.argmax(axis=1)
                for i in range(lo, hi):
                    known = net is not None and _has_letter(column[i].as_py() or "")
                    names.append(langs[best[i - lo]] if known else "und")
                    scores.append(min(1.0, float(p[i - lo, best[i - lo]])) if known else 0.0)
            yield replaced(batch, {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(label, with_schema(docs, "lang_pred string, score double"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame) -> tuple[list[str], ByteGRU | None]:
    """The network for a table of documents: held-out documents teach nothing."""
    return fit(sample(docs.where(~held_out()), "text", "lang", "doc_id"))


def accepted(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """Documents with a language: those predicted `und`, or with a score below `reject`, go."""
    out = identify(docs, *trained(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= reject)).select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), *trained(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
