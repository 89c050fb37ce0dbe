import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqweave.llm import neighbours as N
from tests.oracles import difference

SF = "/root/testdata/sf0.001"


def truth(vectors, threshold=0.9):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for v, o in zip(vectors, ok, strict=True)]
    linked = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in linked[i])])
            changed, root[i] = changed or low != root[i], low
    return {i: (len(linked[i]), root[i]) for i in range(n)}


def made(seed, dim=64, groups=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.normal(size=dim)
        out += [(base + rng.normal(size=dim) * s).tolist() for s in rng.choice([0.0, 0.1, 0.3], 6)]
    hot = rng.normal(size=dim)
    out += [hot.tolist()] * 30 + [(2 * hot).tolist()] + [(hot + rng.normal(size=dim) * 0.02).tolist() for _ in range(60)]
    return out + [None, [], [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [None], [float("inf")] * dim, [1.0] * 8, [1.0] * 8]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    vectors = made(block)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.deduplicated(df).collect()}
    want = truth(vectors)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    for i in range(len(vectors) - 8, len(vectors) - 2):
        assert got[i] == (0, i)


@pytest.mark.parametrize("dim,turns", [(64, 1), (64, 8), (768, 1)])
def test_estimates_are_unbiased_and_bounded(dim, turns):
    rng = np.random.default_rng(4)
    x, y = (N.units(rng.normal(size=(400, dim))) for _ in range(2))
    y = N.units(y + x * rng.uniform(0, 2, size=(400, 1)))  # the diagonal holds pairs at all angles
    code, factor, level, step = N.encoded(y, turns)
    signs = np.unpackbits(code, axis=1, count=dim * turns).astype("f4") * 2 - 1
    query = N.rough(N.encoded(x, turns)[2], N.encoded(x, turns)[3], dim)
    about, error = N.estimates(signs, factor, query @ N.rotations(dim, turns).T.astype("f4"), N.encoded(x, turns)[3], dim, turns)
    off = about - y @ x.T
    assert abs(off.mean()) < 0.003 and abs(np.diag(off).mean()) < 0.02
    assert (np.abs(off) < error).mean() > 0.999 and (np.abs(np.diag(off)) < np.diag(error)).mean() > 0.99


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    dim, rows = 64, []
    for _ in range(700):
        a, b = N.units(rng.normal(size=(2, dim)))
        b = N.units((b - (a @ b) * a)[None])[0]
        c = rng.uniform(0.9, 0.93)
        rows += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b).tolist()]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in N.deduplicated(df).collect()}
    want = {i: n for i, (n, _) in truth(rows).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.94 * sum(want.values())


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.deduplicated(empty).count() == 0
    two = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.deduplicated(two).collect()}
    assert got == {5: (2, 3, False), 3: (2, 3, True), None: (2, 3, False)}


def test_every_way_gives_the_rows_of_the_query(spark):
    assert difference(entry.queries()["op6_embeddings"](spark, SF), entry.oracle_sql()["op6_embeddings"], SF) is None
