"""Pseudo-matching statistics against a plain walk over a plain BWT; thresholds, range minima and common extensions against scans."""

import glob
import random

import pytest

from seqweave.operators import pseudo, suffix
from seqweave.operators.distributed import stored
from seqweave.sources import sinks


def text_of(seqs):
    return "".join(s + "\x02" for s in seqs) + "\x01"


def plain(text):
    """BWT, LCP with the suffix before, and (head, start, stop, threshold) of runs, by sorting and scanning."""
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    bwt = "".join(text[i - 1] for i in sa)
    share = lambda a, b: next((k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), 0)
    lcp = [0, *(share(a, b) for a, b in zip(sa, sa[1:], strict=False))]
    runs, at = [], 0
    while at < len(bwt):
        end = at
        while end < len(bwt) and bwt[end] == bwt[at]:
            end += 1
        before = [r for r in runs if r[0] == bwt[at]]
        runs.append((bwt[at], at, end, min(range(before[-1][2], at + 1), key=lambda r: (lcp[r], r)) if before else 0))
        at = end
    return sa, bwt, lcp, runs


def walked(read, bwt, runs):
    """One read, letter by letter from its end."""
    at, length, out = len(bwt) - 1, 0, []
    for c in reversed(read):
        rank = bwt[:at].count(c)
        if at < len(bwt) and bwt[at] == c:
            length += 1
        else:
            length = 0
            following = next((r for r in runs if r[0] == c and r[1] >= at), None)
            if c in bwt and at < (following[3] if following else len(bwt) + 1):
                rank -= 1
        at = sum(x < c for x in bwt) + rank
        out.append(length)
    return out[::-1]


def tables(spark, seqs):
    refs = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ref_id long, name string, seq string")
    chars = suffix.characters(refs)
    sa = stored(suffix.suffix_array(chars))
    runs = stored(suffix.runs(suffix.bwt(chars, sa)))
    return chars, sa, runs, stored(suffix.thresholds(runs, suffix.lcp(chars, sa)))


def made(rng, n, alphabet="abc"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_against_a_plain_walk(spark, tmp_path):
    rng = random.Random(5)
    seqs = made(rng, 6) + ["abcabcabc", "日本é日本"]
    _, bwt, _, runs = plain(text_of(seqs))
    _, _, table, found = tables(spark, seqs)
    assert [(chr(r.head), r.start, r.start + r.len, r.threshold) for r in table.join(found, "run_id").orderBy("run_id").collect()] == runs
    reads = ["".join(rng.choice("abcabcabcz日é\x02") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [seqs[0][:12], seqs[-1], "zzzz", "￿a", None, "", "ab", "ab"]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    step_table = stored(pseudo.steps(table, found))
    want = {i: walked(r or "", bwt, runs) for i, r in enumerate(reads)}
    assert max(map(max, filter(None, want.values()))) >= 4
    for sent in (pseudo.SENT, 0):
        got = pseudo.pseudo_lengths(df, step_table, sent)
        rows = got.collect()
        assert len(rows) == len(reads) and {r.read_id: list(r.lengths) for r in rows} == want, sent
    sinks.write_pseudo_lengths(pseudo.pseudo_lengths(df, step_table), f"{tmp_path}/out")
    lines = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    assert lines == "".join(f">{i}\n{' '.join(map(str, want[i]))}\n" for i in range(len(reads)))
    twice = df.where("read_id > 60").union(df.where("read_id > 60"))
    assert pseudo.pseudo_lengths(twice, step_table).count() == twice.count() and pseudo.pseudo_lengths(df.limit(0), step_table).count() == 0
    assert {tuple(r.lengths) for r in pseudo.pseudo_lengths(df, step_table.limit(0)).collect()} == {()}


def test_threshold_ranks(spark):
    seqs = made(random.Random(7), 8)
    _, bwt, _, runs = plain(text_of(seqs))
    _, _, table, found = tables(spark, seqs)
    asked = [(ord(c), i) for c in "abcz\x02" for i in range(0, len(bwt) + 2, 3)]
    got = {(r.c, r.i): r.n_before for r in pseudo.threshold_ranks(table, found, spark.createDataFrame(asked, "c int, i long")).collect()}
    later = {c: [r[3] for r in runs if r[0] == c][1:] for c in "abcz\x02"}
    assert got == {(c, i): sum(t < i for t in later[chr(c)]) for c, i in asked}


def test_range_minima(spark):
    rng = random.Random(2)
    values = [(i, rng.randrange(20)) for i in range(50)]
    asked = [(k, *sorted((rng.randrange(50), rng.randrange(50)))) for k in range(80)] + [(80, 0, 49), (81, 7, 7)]
    got = suffix.range_minima(spark.createDataFrame(values, "i long, m long"), spark.createDataFrame(asked, "key long, a long, b long"))
    assert {r.key: r.m for r in got.collect()} == {k: min(m for i, m in values if a <= i <= b) for k, a, b in asked}
    none = suffix.range_minima(spark.createDataFrame(values, "i long, m long"), spark.createDataFrame([], "key long, a long, b long"))
    assert none.columns == ["key", "a", "b", "m"] and none.count() == 0


@pytest.mark.parametrize("bound", [None, 1, 5, 40])
def test_common_extensions(spark, bound):
    seqs = ["abcabcabcabcabcabcabcabcabc", "bcabcabc", "aaaaaaaaaaaa", "abcabcabcabd", "é日本"]
    text = text_of(seqs)
    rng = random.Random(1)
    pairs = [(a, b) for a, b in ((rng.randrange(len(text) + 2), rng.randrange(len(text) + 2)) for _ in range(300)) if a != b]
    chars = suffix.characters(spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ref_id long, name string, seq string"))
    got = suffix.common_extensions(suffix.prefix_ranks(chars, len(text)), spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "key long, a long, b long"), bound)
    share = lambda a, b: next(k for k in range(len(text) + 1) if max(a, b) + k >= len(text) or text[a + k] != text[b + k])
    assert {r.key: r.lce for r in got.collect()} == {k: share(*p) if bound is None else min(bound, share(*p)) for k, p in enumerate(pairs)}
