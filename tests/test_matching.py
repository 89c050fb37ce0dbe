"""Exact matches against brute force over hand-made and random texts."""

import random

import pytest

from seqweave.operators import collection, matching as M


def made(seed, alphabet, n_reads=40):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    refs = [text(rng.randint(0, 120)) for _ in range(8)]
    refs += [refs[0], refs[1][:50] + refs[2][10:60]]
    reads = []
    for _ in range(n_reads):
        out = text(rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            r = rng.choice(refs)
            i = rng.randint(0, len(r))
            out += r[i : i + rng.randint(0, 60)] + text(rng.randint(0, 5))
        reads.append(out)
    return reads + ["", None, alphabet[0] * 70, refs[3]], [*refs, alphabet[0] * 60, None, ""]


@pytest.mark.parametrize("alphabet,k", [("ACGT", 12), ("abcdefghij é😀N", 10), ("AN", 25), ("ab", 4)])
def test_hits_and_maximal_matches(spark, alphabet, k, monkeypatch):
    reads, refs = made(k, alphabet)
    rd = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    rf = spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string")
    want = {(i, q, j, r) for i, x in enumerate(reads) for j, y in enumerate(refs) if x and y for q in range(len(x) - k + 1) for r in range(len(y) - k + 1) if x[q : q + k] == y[r : r + k]}
    got = [tuple(x) for x in M.kmer_hits(rd, rf, k).select("read_id", "qpos", "ref_id", "rpos").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(M, "KNOWN", 0)
    monkeypatch.setattr(M, "PIECE", 32)
    assert sorted(tuple(x) for x in M.kmer_hits(rd, rf, k).select("read_id", "qpos", "ref_id", "rpos").collect()) == sorted(want)
    mems = {}
    for i, x in enumerate(reads):
        spans = set()
        for _, q, j, r in (w for w in want if w[0] == i):
            y, a, b = refs[j], q, q + k
            while a and r - (q - a) and x[a - 1] == y[r - (q - a) - 1]:
                a -= 1
            while b < len(x) and r + b - q < len(y) and x[b] == y[r + b - q]:
                b += 1
            spans.add((a, b))
        for a, b in spans:
            if not any((c, d) != (a, b) and c <= a and b <= d for c, d in spans) and set(x[a:b]) != {"N"}:
                mems[i, a, b] = {(j, r) for j, y in enumerate(refs) if y for r in range(len(y) - (b - a) + 1) if y[r : r + b - a] == x[a:b]}
    found = [tuple(m) for m in M.smems(rd, rf, k).collect()]
    assert set(found) == {(*m, *o) for m, occs in mems.items() for o in occs} and len(found) == len(set(found))
    counted = {(m.read_id, m.qs, m.qe): m.n_occ for m in M.intervals(M.smems(rd, rf, k)).collect()}
    assert counted == {m: len(occs) for m, occs in mems.items()}
    rows = [tuple(m) for m in M.with_halves(rd, rf, k).collect()]
    slow = {(i, a, b, 0): o for (i, a, b), o in mems.items()}
    for i, a, b in mems:
        if b - a >= 2 * k:
            mid = a + (b - a) // 2
            for half, c, d in ((1, a, mid), (2, mid, b)):
                slow[i, c, d, half] = {(j, r) for j, y in enumerate(refs) if y for r in range(len(y) - (d - c) + 1) if y[r : r + d - c] == reads[i][c:d]}
    assert set(rows) == {(*m, *o) for m, occs in slow.items() for o in occs} and len(rows) == len(set(rows))


def test_windows_are_cut_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(collection, "BIN", 16)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé😀") for _ in range(n)) for n in (0, 5, 16, 33, 200)]
    refs = spark.createDataFrame([*enumerate(texts), (9, None)], "ref_id long, seq string")
    asked = [(i, lo, lo + rng.randint(0, 60)) for i in (0, 1, 2, 3, 4, 9) for lo in range(0, 210, 9)]
    got = {(r.ref_id, r.lo, r.hi): r.target for r in collection.windows(spark.createDataFrame(asked * 2, "ref_id long, lo long, hi long"), refs).collect()}
    want = {(i, lo, hi): t for i, lo, hi in asked if (t := (texts[i] if i < 5 else "")[lo:hi])}
    assert got == want


@pytest.mark.parametrize("alphabet,k,piece", [("ACGTN", 11, 1 << 20), ("ACGT", 12, 40), ("AN", 8, 64), ("aé😀N", 5, 32)])
def test_lookup_and_join_find_the_same(spark, alphabet, k, piece, monkeypatch):
    """A small collection is looked up in the tasks: nothing is dealt out, and no pairs are made that share a part of a k-mer only."""
    reads, refs = made(k, alphabet)
    rd = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    rf = spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string")
    monkeypatch.setattr(M, "PIECE", piece)
    monkeypatch.setattr(M, "PAIRS", 7)
    plan = M.runs(rd, rf, k)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    islands = lambda: sorted(map(tuple, M.islands(M.runs(rd, rf, k), k).collect()))
    got = islands()
    monkeypatch.setattr(M, "SENT", 0)
    assert "Join" in M.runs(rd, rf, k)._jdf.queryExecution().executedPlan().toString()
    assert got == islands() and len(got) > 100
    assert all(real == (set(reads[i][a:b]) != {"N"}) for i, _, _, a, b, real in got)
    monkeypatch.undo()
    assert M.runs(rd, rf.limit(0), k).count() == M.runs(rd.limit(0), rf, k).count() == 0


def test_candidates_of_short_matches_share_eight_letters():
    """The words of 4 letters that stood for 11 met each other hundreds of times for each match."""
    assert [M.word_size(k) for k in (4, 8, 11, 12, 25)] == [2, 4, 8, 8, 16]
