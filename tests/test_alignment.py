import random
import re

from seqweave.operators import alignment as A, collection, extending
from seqweave.sources import sinks

CFG = A.AlignConfig()


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def brute(q, r, free_end=False):
    """Score with the cheaper of two affine gap costs, cell by cell."""
    low = -(10**9)
    h = {(0, 0): (0, low, low, low, low)}
    for i in range(len(q) + 1):
        for j in range(len(r) + 1):
            if i or j:
                up, left = h.get((i - 1, j), (low,) * 5), h.get((i, j - 1), (low,) * 5)
                d = max(h[i - 1, j - 1]) + (2 if q[i - 1] == r[j - 1] else -4) if i and j else low
                h[i, j] = d, max(max(up) - 6, up[1] - 2), max(max(left) - 6, left[2] - 2), max(max(up) - 14, up[3] - 1), max(max(left) - 14, left[4] - 1)
    return max(max(h[len(q), j]) for j in range(len(r) + 1)) if free_end else max(h[len(q), len(r)])


def test_kernel_against_cells():
    rng = random.Random(1)
    for _ in range(300):
        q, r, free = dna(rng, rng.randint(0, 14)), dna(rng, rng.randint(0, 14)), rng.random() < 0.5
        if rng.random() < 0.5:
            r = q[: len(q) // 2] + dna(rng, rng.choice([0, 1, 2, 3, 20])) + q[len(q) // 2 + rng.randint(0, 3) :] + dna(rng, 2)
        score, ops = A.aligned(q, r, CFG, free)
        assert score == brute(q, r, free)
        assert sum(o != "D" for o in ops) == len(q)
        used = sum(o != "I" for o in ops)
        assert used == len(r) or free
        got, cigar, md, nm = A.described(q, r, ops, CFG)
        assert got == score or "ID" in ops or "DI" in ops
        assert A.replayed(q, cigar, md) == r[:used]


def edited(rng, s):
    out = list(s)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(10, len(out) - 10)
        out[k] = rng.choice(["", out[k] + dna(rng, 2), rng.choice("ACGT")])
    return "".join(out)


def test_reads_find_their_places(spark):
    rng = random.Random(2)
    refs = [(i, f"s{i}", dna(rng, 2000)) for i in range(4)]
    refs.append((9, "copy", refs[0][2]))
    comp = str.maketrans("ACGT", "TGCA")
    reads, truth = [], {}
    for k in range(60):
        i, at = rng.randrange(4), rng.randrange(0, 1800)
        piece = edited(rng, refs[i][2][at : at + 180])
        truth[k] = (i, at, k % 2)
        reads.append((k, piece.translate(comp)[::-1] if k % 2 else piece))
    reads += [(100, dna(rng, 150)), (101, ""), (102, None), (103, "ACG")]
    rf = spark.createDataFrame(refs, "ref_id long, name string, seq string")
    rd = spark.createDataFrame(reads, "read_id long, seq string")
    got = {int(r.qname): r for r in A.single(A.found(rd, rf, collection.seqidx(rf)), rd, rf).collect()}
    assert len(got) == len(reads)
    assert all(got[k].flag == 4 and got[k].cigar == "*" for k in (100, 101, 102, 103))
    names = {i: s for i, _, s in refs}
    for k, (i, at, strand) in truth.items():
        r = got[k]
        assert (r.rname, r.flag) == (f"s{i}", 16 * strand) and abs(r.pos - 1 - at) <= 8
        assert (r.n_ties, r.mapq > 0) == ((1, False) if i == 0 else (0, True))
        used = sum(int(n) for n, op in re.findall(r"(\d+)([MID])", r.cigar) if op != "I")
        assert A.replayed(r.seq, r.cigar, r.MD) == names[i][r.pos - 1 : r.pos - 1 + used]
    assert A.found(rd.limit(0), rf, collection.seqidx(rf)).count() == 0


def test_occurrences_are_capped_and_frequent_matches_go(spark):
    rng = random.Random(4)
    unit = dna(rng, 50)
    refs = [(0, "r", "".join(unit + dna(rng, 30) for _ in range(12))), (1, "s", dna(rng, 300))]
    rf = spark.createDataFrame(refs, "ref_id long, name string, seq string")
    rd = spark.createDataFrame([(0, unit), (1, refs[1][2][50:150]), (2, unit + refs[1][2][20:100])], "read_id long, seq string")
    idx = collection.seqidx(rf)
    assert A.matching.capped(A.matching.smems(rd, rf), 5).where("read_id = 0").count() == 5
    places = lambda cfg: {(r.read_id, r.ref_id) for r in A.found(rd, rf, idx, cfg).collect()}
    assert places(CFG) == {(0, 0), (1, 1), (2, 0), (2, 1)}
    assert places(A.AlignConfig(most_share=0.5)) == {(2, 1)}
    whole = {r.read_id: (r.ref_id, r.score) for r in A.found(rd, rf, idx, A.AlignConfig(halves=True)).collect() if r.read_id == 1}
    assert whole == {1: (1, 200)}


def test_long_gaps_take_the_second_cost():
    rng = random.Random(5)
    q = dna(rng, 120)
    r = q[:60] + dna(rng, 30) + q[60:]
    assert A.aligned(q, r, CFG)[0] == 240 - 13 - 30 and A.aligned(r, q, CFG)[0] == 240 - 13 - 30
    assert A.aligned(q, q[:60] + "AC" + q[60:], CFG)[0] == 240 - 4 - 4


def cut_form(read, ref, steps):
    """Operations along anchors from the first one's start, an overlapping anchor cut at its start."""
    x, y, w = steps[0]
    ops = "M" * w
    for nx, ny, nw in steps[1:]:
        cut = max(0, x + 1 - (nx - nw + 1), y + 1 - (ny - nw + 1))
        if cut < nw:
            query, target = read[y + 1 : ny - nw + 1 + cut], ref[x + 1 : nx - nw + 1 + cut]
            ops += (A.aligned(query, target, CFG)[1] if query and target else "I" * len(query) + "D" * len(target)) + "M" * (nw - cut)
            x, y = nx, ny
    return ops


def test_overlapping_anchors_are_aligned_anew():
    """Never below the cut form; on spans that fit one table as good as the best of all alignments; long ones in parts."""
    rng = random.Random(7)
    better = 0
    for k in range(120):
        unit = dna(rng, rng.randint(1, 6))
        read, ref = (dna(rng, 12) + unit * rng.randint(1, 6) + dna(rng, 12) for _ in range(2))
        ref = read[:12] + ref[12:-12] + read[-12:]
        if k % 3 == 0:  # a third anchor that overlaps the second
            read, ref = read + unit * 3 + "ACGTTGCA", ref + unit * 2 + "ACGTTGCA"
        ends = set()
        for i in range(len(read)):
            for j in range(len(ref)):
                if read[i] == ref[j] and (i + 1 == len(read) or j + 1 == len(ref) or read[i + 1] != ref[j + 1]):
                    w = 1
                    while w <= min(i, j) and read[i - w] == ref[j - w]:
                        w += 1
                    if w >= 8:
                        ends.add((j, i, w))
        steps = []
        for x, y, w in sorted(ends):
            if not steps or x > steps[-1][0] and y > steps[-1][1]:
                steps.append((x, y, w))
        (x, y, w), (x1, y1, _) = steps[0], steps[-1]
        if x - w + 1 or y - w + 1 or (x1, y1) != (len(ref) - 1, len(read) - 1):
            continue
        at, ops = A.along(read, ref, steps, CFG)
        score = A.described(read, ref, ops, CFG)[0]
        cut = A.described(read, ref, cut_form(read, ref, steps), CFG)[0]
        assert at == 0 and score >= cut and (ops.count("M") + ops.count("I"), ops.count("M") + ops.count("D")) == (len(read), len(ref))
        apart = all(nx - nw + 1 <= x or ny - nw + 1 <= y for (x, y, _), (nx, ny, nw) in zip(steps, steps[1:]))
        if apart:
            assert score == A.aligned(read, ref, CFG)[0]
            better += len(steps) > 1
    assert better > 20
    unit, end = dna(rng, 900), dna(rng, 300)
    read, ref = unit + unit[:400] + end, unit + unit + unit[:400] + end
    steps = [(1299, 1299, 1300), (2499, 1599, 1600)]
    ops = A.along(read, ref, steps, CFG)[1]
    assert A.described(read, ref, ops, CFG)[0] >= A.described(read, ref, cut_form(read, ref, steps), CFG)[0] == 2 * 1600 - 13 - 900


def test_extensions_as_sam(spark):
    rng = random.Random(8)
    ref = dna(rng, 400)
    rf = spark.createDataFrame([(3, "r", ref)], "ref_id long, name string, seq string")
    seq = ref[50:150]
    turned = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rd = spark.createDataFrame([(0, seq, "I" * 99 + "J"), (1, turned, "I" * 99 + "J"), (2, dna(rng, 90), None), (3, None, None)], "read_id long, seq string, qual string")
    found = extending.extended(rd, rf, collection.seqidx(rf))
    rows = extending.sam_rows(found, rd, rf)
    lines = sorted(r.line for r in rows.select(sinks.sam_line(rows).alias("line")).collect())
    tail = "\tAS:i:200\tNM:i:0\tMD:Z:100"
    assert lines[0] == f"0\t0\tr\t51\t43\t100M\t*\t0\t0\t{seq}\t{'I' * 99}J{tail}"
    assert lines[1] == f"1\t16\tr\t51\t43\t100M\t*\t0\t0\t{seq}\tJ{'I' * 99}{tail}"
    assert lines[2:] == [f"{k}\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*" for k in (2, 3)]
