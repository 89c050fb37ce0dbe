"""The factorisation machine against sums over all pairs and differences, its features against plain counts, and held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqweave.llm import quality as Q

SF = "/root/testdata/sf0.01"


def of(texts, metadata=None):
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return Q.features(data, np.cumsum([0, *map(len, raw)]), np.zeros((len(raw), 0)) if metadata is None else np.array(metadata, float))


def dense(f, size):
    out = np.zeros((len(f.start) - 1, size))
    for i in range(len(out)):
        np.add.at(out[i], f.at[f.start[i] : f.start[i + 1]], f.x[f.start[i] : f.start[i + 1]])
    return out


TEXTS = ["The cat, the CAT!! 12 cats", "", " \n\n ", "a" * 300, "x | y | z\nx | y | z\n", "été Ça été", "one", "!!! ???", "w " * 5000]


def test_linear_time_score_equals_the_sum_over_pairs():
    f, rng = of(TEXTS), np.random.default_rng(1)
    size = Q.WORDS + len(Q.STRUCTURE)
    m = Q.FactorisationMachine(size)
    m.bias, m.w = 0.3, rng.normal(size=size)
    m.v = rng.normal(size=m.v.shape)
    for x, got in zip(dense(f, size), m.raw(f), strict=True):
        at = np.flatnonzero(x)
        want = m.bias + m.w[at] @ x[at] + sum(m.v[i] @ m.v[j] * x[i] * x[j] for n, i in enumerate(at) for j in at[:n])
        assert abs(want - got) < 1e-4 * (1 + abs(want))


def test_gradients_are_those_of_the_loss():
    f, y = of(TEXTS), np.array([1, 0, 0, 1, 0, 1, 1, 0, 1.0])
    m = Q.FactorisationMachine(Q.WORDS + len(Q.STRUCTURE))
    m.w, m.v = np.random.default_rng(2).normal(size=m.w.shape), m.v.astype(float)
    loss = lambda: -np.mean(np.log(np.where(y > 0, Q.sigmoid(m.raw(f)), 1 - Q.sigmoid(m.raw(f)))))
    b, w, v = m.gradients(f, y)
    for at in random.Random(3).sample(sorted(set(f.at.tolist())), 12):
        for table, grad in ((m.w[at : at + 1], w[f.at == at].sum()), (m.v[at, 2:3], v[f.at == at, 2].sum())):
            table += 1e-4
            up = loss()
            table -= 2e-4
            assert abs((up - loss()) / 2e-4 - grad) < 1e-5
            table += 1e-4
    m.bias += 1e-4
    up = loss()
    m.bias -= 2e-4
    assert abs((up - loss()) / 2e-4 - b) < 1e-6


def test_features_are_plain_counts():
    f = of(TEXTS, [[10.0], [np.nan], [-1], [np.inf], [0], [1], [2], [3], [4]])
    for i, t in enumerate(TEXTS):
        at, x = f.at[f.start[i] : f.start[i + 1]], f.x[f.start[i] : f.start[i + 1]]
        words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t)
        runs = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words] + re.findall(r"[^A-Za-z0-9\x80-\U0010ffff\s]+", t)
        times = sorted(math.log1p(n) for n in Counter(runs).values())
        norm = math.sqrt(sum(v * v for v in times)) or 1
        assert np.allclose(sorted(x[at < Q.WORDS]), [v / norm for v in times], atol=1e-6)
        stats = dict(zip(Q.STRUCTURE, x[at >= Q.WORDS][: len(Q.STRUCTURE)], strict=True))
        n = max(1, len(t.encode()))
        assert math.isclose(stats["digits"], sum(c in "0123456789" for c in t) / n, abs_tol=1e-6)
        assert math.isclose(stats["line ends"], t.count("\n") / n, abs_tol=1e-6)
        assert math.isclose(stats["distinct of words"], len({w.lower() for w in words}) / max(1, len(words)), abs_tol=1e-6)
        assert stats["texts without a word"] == (not words) and all(0 <= v <= 1 for v in stats.values())
    meta = f.x[f.at >= Q.WORDS + len(Q.STRUCTURE)].reshape(-1, 2)
    assert meta[:, 1].tolist() == [1, 0, 0, 0, 1, 1, 1, 1, 1] and np.allclose(meta[0, 0], math.log(11) / 20)
    alone = [of([t]) for t in TEXTS]
    together = of(TEXTS)
    assert together.at.tolist() == [k for a in alone for k in a.at.tolist()] and np.allclose(together.x, np.concatenate([a.x for a in alone]))


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in entry.queries()["op13_quality"](spark, SF).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert got.keys() == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    rows = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None]
    held = [(r.score, y) for r, y in rows if r.held_out]
    assert len(held) > 50 and sum((s >= 0.3) == y for s, y in held) > 0.95 * len(held)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(a > b for a in good for b in bad) > 0.98 * len(good) * len(bad)


def test_scores_depend_on_text_and_metadata_alone(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = Q.trained(docs, labels)
    few = docs.limit(200)
    one = {r.doc_id: r.score for r in Q.scored(few, machine, metadata=("n_chars",)).collect()}
    other = few.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 1_000_000, "score": F.lit("clash"), "_x0": F.lit("kept")})
    rows = Q.scored(other, machine, metadata=("n_chars",)).collect()
    assert {r.doc_id - 1_000_000: r.score for r in rows} == one and {r._x0 for r in rows} == {"kept"}


def test_sample_is_bounded_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", None), (2, "!!! $$$", 4), (None, None, 1), (3, "", 0)], "doc_id long, text string, n_chars long")
    many = docs.union(spark.range(300).selectExpr("1L", "concat('good words here', id)", "id"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (9, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    f, y, counts = Q.sample(many, labels, metadata=("n_chars",), per_class=5)
    assert sorted(y.tolist()) == [0, 1, 1, 1, 1, 1] and counts == (1, 2) and len(f.start) == 7
    machine = Q.fit(f, y, counts)
    rows = Q.scored(docs.union(docs), machine, metadata=("n_chars",)).collect()
    assert len(rows) == 8 and len({(r.doc_id, r.score) for r in rows}) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert Q.scored(docs.limit(0), machine, metadata=("n_chars",)).count() == 0
    alone = Q.fit(*Q.sample(docs, labels.where("quality = 1")))
    assert alone == 3 / 4 and {r.score for r in Q.scored(docs, alone).collect()} == {alone}
    assert Q.fit(*Q.sample(docs.limit(0), labels.limit(0))) == 0.5
