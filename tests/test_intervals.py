"""Intervals of the suffix array against plain search in the text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.operators import collection, intervals, suffix


def refs_of(spark, texts):
    return spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "ref_id long, name string, seq string")


def test_nearest_smaller_values():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 65, 200):
        values = rng.integers(0, 6, n)
        table = intervals.Minima(values)
        at, bound = (x.reshape(-1) for x in np.meshgrid(np.arange(n), np.arange(8)))
        less = [[i for i in range(n) if values[i] < b] for b in range(8)]
        assert table.before(at, bound).tolist() == [max([i for i in less[b] if i <= a], default=-1) for a, b in zip(at.tolist(), bound.tolist(), strict=True)]
        assert table.after(at, bound).tolist() == [min([i for i in less[b] if i >= a], default=n) for a, b in zip(at.tolist(), bound.tolist(), strict=True)]


def test_intervals_count_and_page_all_occurrences(spark):
    rng = random.Random(2)
    line = "".join(rng.choice("acgt") for _ in range(30))
    texts = ["".join(rng.choice("ac") for _ in range(40)), line, "", "tt" + line + "a", "a" * 25, line[:12] + line[:12]]
    refs = refs_of(spark, texts)
    index = collection.seqidx(refs, 1)
    chars = suffix.characters(refs)
    sa = suffix.suffix_array(chars)
    lcps = suffix.lcp(chars, sa)
    starts = {r.ref_id: r.start for r in index.collect()}
    whole = "".join(t + "\x02" for t in texts) + "\x01"
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    asked = [(7 * r + n, starts[r] + k, n) for r, t in enumerate(texts) for n in (1, 2, 5, 12, 30) for k in range(0, len(t) - n + 1, 3)]
    df = spark.createDataFrame([*asked, (0, None, 3), (0, 0, 0), (0, 0, None)], "read_id long, place long, len long").withColumn("_x", F.lit("kept"))
    want = sorted((q, p, n, *(lambda hits: (min(hits), max(hits), len(hits)))([k for k, i in enumerate(order) if whole.startswith(whole[p : p + n], i)])) for q, p, n in asked)
    for block, per_copy in ((1 << 20, 1 << 22), (8, 3), (17, 1)):
        got = intervals.of_matches(df, sa, lcps, block, per_copy)
        rows = got.collect()
        assert sorted((r.read_id, r.place, r.len, r.sa_lo, r.sa_hi, r.n_occ) for r in rows) == want, block
        assert {r._x for r in rows} == {"kept"}
    found = intervals.of_matches(df, sa, lcps).distinct()
    pages = {k: [tuple(r) for r in intervals.page(found, sa, index, 40 * k, 40).select("place", "len", "rank", "ref_id", "rpos").collect()] for k in range(3)}
    every = sorted(x for p in pages.values() for x in p)
    assert found.where("n_occ > 40").count() and found.where("n_occ > 120").isEmpty()
    assert len(every) == sum(r.n_occ for r in found.collect()) == len(set(every))
    assert all(order[rank] == starts[ref] + rpos and texts[ref].startswith(whole[place : place + n], rpos) for place, n, rank, ref, rpos in every)


def test_a_frequent_match_is_one_row(spark):
    refs = refs_of(spark, ["needle"] * 60)
    chars = suffix.characters(refs)
    sa = suffix.suffix_array(chars)
    df = spark.createDataFrame([(1, 0, 6), (1, 7, 3), (2, 1, 5)], "read_id long, place long, len long")
    found = intervals.of_matches(df, sa, suffix.lcp(chars, sa), block=64)
    assert sorted((r.read_id, r.len, r.n_occ) for r in found.collect()) == [(1, 3, 60), (1, 6, 60), (2, 5, 60)]
    got = {r.read_id: (r.n_unique, r.total, r.max_freq, r.min_freq, r.filtered) for r in intervals.stats(found).collect()}
    assert got == {1: (2, 120, 60, 60, 0), 2: (1, 60, 60, 60, 60)}
    assert intervals.page(found, sa, collection.seqidx(refs, 1), 58, 5).count() == 6


def test_no_matches(spark):
    refs = refs_of(spark, ["acgt"])
    chars = suffix.characters(refs)
    sa = suffix.suffix_array(chars)
    empty = spark.createDataFrame([], "read_id long, place long, len long")
    assert intervals.of_matches(empty, sa, suffix.lcp(chars, sa)).count() == 0


@pytest.mark.parametrize("sent", [intervals.SENT, 0])
def test_equal_matches_meet_the_suffix_array_once(spark, monkeypatch, sent):
    refs = refs_of(spark, ["banana", "bandana"])
    chars = suffix.characters(refs)
    sa = suffix.suffix_array(chars)
    lcps = suffix.lcp(chars, sa)
    ranked, write = [], intervals.stored

    def watched(df):
        out = write(df)
        if {"place", "_rank"} <= set(out.columns):
            ranked.append(out.count())
        return out

    monkeypatch.setattr(intervals, "stored", watched)
    monkeypatch.setattr(intervals, "SENT", sent)
    df = spark.range(500).selectExpr("id AS read_id", "id % 2 AS place", "2L + id % 2 AS len")
    got = intervals.of_matches(df, sa, lcps).collect()
    assert ranked == [2] and len(got) == 500 and {(r.place, r.len, r.n_occ) for r in got} == {(0, 2, 2), (1, 3, 3)}  # ba, ana
