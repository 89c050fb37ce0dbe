import random
import re

from pyspark.sql import functions as F

from seqweave.operators import alignment as A, chaining, collection, extending, lifting, matching, pairing
from seqweave.streaming import reads as R


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def changed(s):
    """Every tenth letter replaced: no seed is left."""
    return "".join(("G" if x != "G" else "T") if k % 10 == 5 else x for k, x in enumerate(s))


def test_pairs_find_their_places(spark):
    rng = random.Random(4)
    refs = [(k, f"s{k}", dna(rng, 4000)) for k in range(3)]
    rows, truth = [], {}
    for p in range(24):
        ref, at, gap = p % 3, rng.randint(50, 3000), 180 + rng.randint(-15, 15)
        fwd, rev = refs[ref][2][at : at + 100], refs[ref][2][at + 100 + gap : at + 200 + gap]
        flip = p % 2
        one, two = (fwd, reverse(rev)) if not flip else (reverse(rev), fwd)
        if p >= 20:
            two = reverse(changed(reverse(two))) if not flip else changed(two)
        rows += [(p, 0, one), (p, 1, two)]
        truth[p] = ref, at + 1, at + 101 + gap, flip
    rows += [(90, 0, dna(rng, 80)), (90, 1, None), (91, 0, refs[0][2][500:600]), (91, 1, dna(rng, 300))]
    mates = spark.createDataFrame(rows, "pair_id long, mate int, seq string")
    table = spark.createDataFrame(refs, "ref_id long, name string, seq string")
    got = {(r.pair_id, r.mate): r for r in pairing.sam_rows(A.found(pairing.read_ids(mates), table, collection.seqidx(table)), mates, table).collect()}
    assert len(got) == len(rows)
    for p, (ref, left, right, flip) in truth.items():
        a, b = got[p, 0], got[p, 1]
        left_one, right_one = (a, b) if not flip else (b, a)
        assert (left_one.rname, left_one.pos, right_one.pos) == (f"s{ref}", left, right), p
        assert left_one.tlen == right + 100 - left == -right_one.tlen
        assert a.rnext == b.rnext == "=" and a.pnext == b.pos and b.pnext == a.pos
        assert (a.flag, b.flag) == ((99, 147) if not flip else (83, 163))
        assert b.rescued == (p >= 20) and not a.rescued
        assert a.mapq == 60
        for r in (a, b):
            assert A.replayed(r.seq, r.cigar, r.MD) == refs[ref][2][r.pos - 1 : r.pos + 99]
    assert (got[90, 0].flag, got[90, 1].flag, got[90, 1].seq) == (77, 141, "*")
    assert got[91, 0].flag & 2 == 0 and got[91, 0].pos == 501 and got[91, 1].flag & 4
    count = pairing.counters(spark.createDataFrame([(p, r.flag, r.rescued) for (p, _), r in got.items()], "pair_id long, flag int, rescued boolean"))
    assert count.first().asDict() == {"processed": 26, "aligned": 24, "orphan": 5, "orphan_recovered": 4}


def test_direction_and_near_chains(spark):
    mems = [(0, 0, 90), (3, 0, 80), (1, 5, 31), (2, 0, 30), (4, 0, 60), (5, 0, 30), (6, 0, 40), (9, 3, 40)]
    df = spark.createDataFrame(mems, "read_id long, qs int, qe int")
    kept = matching.direction_filter(matching.paired_directions(df), 50.0, "pair_id").select("read_id", "pair_id", "dir").collect()
    # pair 0: means 85 and 28, so the second direction goes; pair 1: 60 and 35; pair 2: one direction only, of 37
    assert sorted(map(tuple, kept)) == [(0, 0, 0), (3, 0, 0), (4, 1, 0), (5, 1, 1), (6, 1, 1), (9, 2, 1)]
    anchors = lambda x: [{"x": x + 9, "y": 9, "w": 10}]
    rows = [(1, 0, k, score, x + 9, anchors(x)) for k, (score, x) in enumerate([(50, 100), (50, 109), (50, 118), (50, 130), (49, 104)])] + [(2, 0, 0, 50, 105 + 9, anchors(105)), (1, 1, 0, 50, 105 + 9, anchors(105))]
    chains = spark.createDataFrame(rows, "read_id long, ref_id long, chain int, score long, x0 long, anchors array<struct<x:long,y:long,w:long>>")
    assert sorted((r.read_id, r.ref_id, r.chain) for r in chaining.apart(chains, 10).collect()) == [(1, 0, 0), (1, 0, 3), (1, 0, 4), (1, 1, 0), (2, 0, 0)]


def test_near_chains_do_not_change_placements(spark):
    rng = random.Random(12)
    refs = spark.createDataFrame([(k, f"s{k}", dna(rng, 900)) for k in range(2)], "ref_id long, name string, seq string")
    texts = [r.seq for r in refs.orderBy("ref_id").collect()]
    reads = spark.createDataFrame([(p, texts[p % 2][40 * p : 40 * p + 90]) for p in range(12)], "read_id long, seq string")
    place = lambda cfg: sorted((r.qname, r.rname, r.pos, r.cigar) for r in A.single(A.found(reads, refs, collection.seqidx(refs), cfg), reads, refs).collect())
    assert place(A.AlignConfig(apart=10)) == place(A.AlignConfig()) and len(place(A.AlignConfig())) == 12


def test_longest_match_extension(spark):
    rng = random.Random(5)
    refs = [(k, f"s{k}", dna(rng, 1500)) for k in range(2)]
    reads = []
    for p in range(8):
        s = refs[p % 2][2][100 * p + 7 : 100 * p + 157]
        s = s[:40] + ("A" if s[40] != "A" else "C") + s[41:]
        reads.append((p, reverse(s) if p % 4 > 1 else s))
    reads += [(50, None), (51, ""), (52, dna(rng, 100))]
    table, asked = spark.createDataFrame(refs, "ref_id long, name string, seq string"), spark.createDataFrame(reads, "read_id long, seq string")
    got = {r.read_id: r for r in extending.extended(asked, table, collection.seqidx(table)).collect()}
    assert sorted(got) == list(range(8))
    for p, r in got.items():
        assert (r.ref_id, r.pos, r.strand, r.nm, r.cigar, r.score) == (p % 2, 100 * p + 7, int(p % 4 > 1), 1, "150M", 294)
        assert r.mapq == 43  # 6 under 300 is bin 0 of those to the least score


def test_tied_places(spark):
    rng = random.Random(8)
    twin = dna(rng, 600)
    refs = spark.createDataFrame([(0, "a", twin), (1, "b", twin), (2, "c", dna(rng, 600)), (3, "d", dna(rng, 30) + twin[100:400])], "ref_id long, name string, seq string")
    reads = spark.createDataFrame([(7, twin[150:250]), (8, twin[450:550]), (9, None)], "read_id long, seq string")
    got = A.tied(A.found(reads, refs, collection.seqidx(refs)), reads, refs)
    assert sorted(map(tuple, got.collect())) == [(7, "b", 151, 200), (7, "d", 81, 200), (8, "b", 451, 200)]


def test_binned_mapq(spark):
    rows = [(200, 0, 1), (194, 0, 1), (150, 0, 1), (200, 100, 1), (150, 140, 1), (57, 57, 1)]
    got = spark.createDataFrame(rows, "score int, second int, k int").select(extending.binned_mapq(F.col("score"), F.col("second"), F.lit(56), F.lit(100)).alias("q")).collect()
    assert [r.q for r in got] == [43, 43, 36, 24, 3, 0]


def test_cigar_lift_letter_by_letter():
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randint(1, 40)
        origin, segments, dst = [], [], 0  # of each haplotype letter: its place on the reference, None if inserted
        while dst < n:
            kind = rng.choice("=ID=")
            size = rng.randint(1, 6)
            if kind == "D":
                dst += size
                continue
            src = len(origin)
            origin += [None] * size if kind == "I" else list(range(dst, dst + size))
            segments.append((src, src + size, dst, kind))
            dst += size if kind == "=" else 0
        if not origin:
            continue
        pos = at = rng.randrange(len(origin))
        ops, want = [], []
        while at < len(origin) and rng.random() < 0.9:
            op, size = rng.choice("MMID"), rng.randint(1, 5)
            size = size if op == "I" else min(size, len(origin) - at)
            ops.append(f"{size}{op}")
            want += [None] * size if op == "I" else origin[at : at + size] if op == "M" else []
            at += 0 if op == "I" else size
        got = lifting.lifted(pos, "".join(ops), segments)
        if got is None:
            assert all(w is None for w in want)
            continue
        ref, have = got[0], []
        for size, op in re.findall(r"(\d+)([MID])", got[1]):
            have += [None] * int(size) if op == "I" else list(range(ref, ref + int(size))) if op == "M" else []
            ref += 0 if op == "I" else int(size)
        assert have == want


def test_streamed_reads(spark, tmp_path):
    rng = random.Random(7)
    refs = spark.createDataFrame([(0, dna(rng, 900)), (1, dna(rng, 900))], "ref_id long, seq string")
    text = [r.seq for r in refs.orderBy("ref_id").collect()]
    for f in range(3):
        rows = [(10 * f + k, text[k % 2][50 * k : 50 * k + 60]) for k in range(4)] + [(10 * f + 9, None)]
        spark.createDataFrame(rows, "read_id long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "read_id long, seq string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    R.match_stream(stream, refs, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3
    once = R.matching.occurrences(R.matching.smems(spark.read.parquet(str(tmp_path / "in")), refs))
    cols = ["read_id", "qs", "qe", "ref_id", "rpos"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, once.select(*cols).collect()))
    row = R.run_counters(spark.read.parquet(str(tmp_path / "in")), got).first()
    assert (row.processed, row.aligned) == (15, 12)
