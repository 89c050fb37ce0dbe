"""Chains against every choice of predecessors, and against a slow recurrence anchor by anchor."""

import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.operators import chaining as C
from seqweave.plans import catalog


def added(a, b, mean, cfg):
    """What anchor b = (x, y, w) adds behind a; None if it cannot follow."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    if dx > cfg.max_dist_x or not 0 < dy <= cfg.max_dist_y:
        return None
    gap, log = abs(dx - dy), 0
    while gap >> (log + 1):
        log += 1
    return min(dx, dy, b[2]) - ((int(0.01 * gap * float(np.float32(mean))) + log) // 2 if gap else 0)


def slow(anchors, cfg):
    """(score, anchors, secondary) by a recurrence from each anchor to all before it."""
    n, mean = len(anchors), sum(a[2] for a in anchors) / max(1, len(anchors))

    @cache
    def best(i, second):
        barred, out = set(), (anchors[i][2], None)
        if second:
            k = best(i, False)[1]
            while k is not None:
                barred.add(k)
                k = best(k, False)[1]
        for j in range(i - 1, max(-1, i - cfg.max_iter - 1), -1):
            gain = added(anchors[j], anchors[i], mean, cfg)
            if gain is not None and j not in barred and best(j, second)[0] + gain > out[0]:
                out = best(j, second)[0] + gain, j
        return out

    found = []
    for second in (False, True)[: 1 + cfg.secondary]:
        used = set()
        for i in sorted(range(n), key=lambda i: (-best(i, second)[0], -i)):
            if i in used or best(i, second)[0] <= cfg.min_score:
                continue
            chain, k = [], i
            while k is not None and k not in used:
                chain.append(k)
                k = best(k, second)[1]
            if len(chain) >= cfg.min_anchors and (k is None or best(i, second)[0] - best(k, second)[0] >= cfg.min_score):
                used.update(chain)
                if not second or chain[::-1] not in [c for _, c, _ in found]:
                    found.append((best(i, second)[0], chain[::-1], second))
    return sorted(found, key=lambda r: -r[0])


def made(rng, n, spread=60):
    return sorted((rng.randrange(spread * n), rng.randrange(60 + 4 * n), rng.randrange(5, 30)) for _ in range(n))


CONFIGS = [C.ChainConfig(), C.ChainConfig(200, 60, 3, 15, 2), C.ChainConfig(500, 100, 10, 10, 1, True), C.ChainConfig(300, 80, 2, 8, 1, True)]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_lanes_equal_the_slow_recurrence(cfg):
    rng = random.Random(8)
    groups = [made(rng, rng.randint(1, 40), rng.choice([5, 20, 60])) for _ in range(150)]
    edges = np.cumsum([0, *map(len, groups)])
    x, y, w = np.array([a for g in groups for a in g]).T
    got = list(C.solve(x, y, w, cfg, edges))
    assert got == [slow(g, cfg) for g in groups] and sum(len(g) > 1 for g in got) > 5
    assert not cfg.secondary or any(s for g in got for _, _, s in g)


@pytest.mark.parametrize("cfg", CONFIGS[:2])
def test_best_score_over_every_choice(cfg):
    rng = random.Random(4)
    for _ in range(120):
        anchors = made(rng, rng.randint(1, 9), 12)
        mean = sum(a[2] for a in anchors) / len(anchors)

        def every(i):
            yield anchors[i][2]
            for j in range(max(0, i - cfg.max_iter), i):
                gain = added(anchors[j], anchors[i], mean, cfg)  # noqa: B023
                if gain is not None:
                    yield from (s + gain for s in every(j))

        top = [max(every(i)) for i in range(len(anchors))]
        x, y, w = np.array(anchors).T
        size = np.array([len(anchors)])
        gain = C.gains(x, y, w, np.zeros(len(x), int), np.full(len(x), float(np.float32(mean))), cfg)
        assert C.scores(gain, w, np.array([0]), size)[0].tolist() == top


def test_second_recurrence_over_every_choice():
    """The best score of paths in which no anchor follows one of its own best chain."""
    cfg, rng = CONFIGS[2], random.Random(6)
    for _ in range(80):
        anchors = made(rng, rng.randint(2, 8), 12)
        mean = sum(a[2] for a in anchors) / len(anchors)
        x, y, w = np.array(anchors).T
        gain = C.gains(x, y, w, np.zeros(len(x), int), np.full(len(x), float(np.float32(mean))), cfg)
        one = np.array([0]), np.array([len(anchors)])
        _, step, on = C.scores(gain, w, *one)
        path = [[] for _ in anchors]
        for i in range(len(anchors)):
            path[i] = [*path[i - step[i]], i - step[i]] if step[i] else []

        def every(i):
            yield anchors[i][2]
            for j in range(max(0, i - cfg.max_iter), i):
                gain = added(anchors[j], anchors[i], mean, cfg)  # noqa: B023
                if gain is not None and j not in path[i]:  # noqa: B023
                    yield from (s + gain for s in every(j))

        assert C.scores(gain, w, *one, on)[0].tolist() == [max(every(i)) for i in range(len(anchors))]


def test_groups_cross_batches(spark):
    rng = random.Random(3)
    groups = {r: made(rng, n) for r, n in enumerate([1, 300, 2, 50, 50])}
    rows = [(r, 7, x, y, w, 0, 10**6) for r, g in groups.items() for x, y, w in g]
    df = spark.createDataFrame(rows, "read_id long, ref_id long, x long, y long, w long, start long, len long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = [(r.read_id, r.chain, r.score, [tuple(a) for a in r.anchors]) for r in C.solved(df, within=False).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(r, k, s, [g[i] for i in c]) for r, g in groups.items() for k, (s, c, _) in enumerate(slow(g, C.ChainConfig()))]
    assert sorted(got) == sorted(want) and C.solved(df.limit(0)).count() == 0


@pytest.mark.parametrize("name,secondary", [("chains", False), ("secondary_chains", True)])
def test_queries_against_the_slow_recurrence(spark, name, secondary):
    sf = "/root/testdata/sf0.01"
    mems = catalog.halves(spark, sf) if secondary else catalog.found(spark, sf)
    groups = {}
    for r in C.anchors(mems, catalog.index(spark, sf)).select("read_id", *(F.col(c).cast("long") for c in "xyw")).collect():
        groups.setdefault(r.read_id, []).append((r.x, r.y, r.w))
    want = set()
    for r, g in groups.items():
        g.sort()
        want |= {(r, k, s, len(c), g[c[0]][0], g[c[-1]][0], g[c[0]][1], g[c[-1]][1], *[second] * secondary) for k, (s, c, second) in enumerate(slow(g, C.ChainConfig(secondary=secondary)))}
    got = [tuple(r) for r in catalog.QUERIES[name](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) and got


def test_groups_without_a_chain_are_passed_over(monkeypatch):
    """Of very many groups of one short anchor none is looked into."""
    asked, taken = [], C.taken
    monkeypatch.setattr(C, "taken", lambda *a: asked.append(1) or taken(*a))
    x = np.arange(1000) * 1000
    w = np.where(np.arange(1000) == 700, 60, 12)
    got = list(C.solve(x, x, w, C.ChainConfig(), np.arange(1001)))
    assert len(asked) == 1 and [i for i, g in enumerate(got) if g] == [700] and got[700] == [(60, [0], False)]
