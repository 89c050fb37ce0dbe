import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import scalars as S
from seqweave.operators import collection, matching, statistics
from seqweave.sources import sequences, sinks, variants


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_fasta_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"s{i}", dna(rng, n)) for i, n in enumerate([1, 59, 60, 61, 500, 3000])]
    df = spark.createDataFrame(rows, "ref_id long, name string, seq string")
    sinks.write_fasta_blocks(df, str(tmp_path / "fa"), 3)
    got = sequences.fasta(spark, str(tmp_path / "fa")).collect()
    assert sorted((r.name, r.seq) for r in got) == sorted((n, s) for _, n, s in rows)
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(">a first one\r\nAC\r\nGT\r\n>b\nT>T\n>c\n")
    assert [tuple(r) for r in sequences.fasta(spark, str(tmp_path / "x.fa.gz")).collect()] == [("a", "first one", "ACGT"), ("b", "", "T>T"), ("c", "", "")]


def test_fastq_blocks(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{i}", s := dna(rng, rng.randint(0, 90)), "".join(rng.choice("@+IF") for _ in s)) for i in range(500)]
    (tmp_path / "r.fq").write_text("".join(f"@{n} c\n{s}\n+\n{q}\n" for n, s, q in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = sequences.fastq(spark, str(tmp_path / "r.fq"))
        got = [(r.name, r.seq, r.qual) for r in df.orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == rows
    assert sequences.pairs(df, df).count() == 500
    with pytest.raises(Exception, match="differ in length"):
        sequences.pairs(df, df.where("ordinal < 499")).select("ordinal").collect()
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        sequences.fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_haplotypes_and_lift(spark, tmp_path):
    rng = random.Random(3)
    ref = dna(rng, 400)
    calls, at = [], 5
    while at < 380:
        n = rng.choice([1, 1, 1, 3, 6])
        alt = {0: dna(rng, 1), 1: ref[at] + dna(rng, 4), 2: ref[at]}[rng.randint(0, 2)]
        if alt != ref[at : at + n]:
            calls.append((at, ref[at : at + n], alt, rng.choice(["0|1", "1|1", "1|0", ".|1"])))
        at += n + rng.randint(1, 20)
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"] + [f"c\t{p + 1}\t.\t{r}\t{a},<DEL>\t.\t.\t.\tGT:DP\t{g}:3\t0|2" for p, r, a, g in calls]
    (tmp_path / "v.vcf").write_text("\n".join(lines) + "\n")
    refs = spark.createDataFrame([("c", ref)], "name string, seq string")
    found = variants.applied(variants.alleles(variants.vcf(spark, str(tmp_path / "v.vcf"))))
    got = {(r["sample"], r.hap): r.seq for r in variants.haplotypes(refs, found).collect()}
    assert set(got) == {("A", 1), ("A", 2)}
    want, back = {}, {}
    for hap in (1, 2):
        out, places, last = [], [], 0
        for p, r, a, g in calls:
            if g.split("|")[hap - 1] == "1":
                out += ref[last:p] + a
                places += list(range(last, p)) + [p + min(k, len(r)) if k >= min(len(r), len(a)) else p + k for k in range(len(a))]
                last = p + len(r)
        out += ref[last:]
        places += range(last, len(ref))
        want["A", hap], back[hap] = "".join(out), places
    assert got == want
    for hap in (1, 2):
        lifted = {}
        for s in variants.lift_segments(refs, found).where(F.col("hap") == hap).collect():
            for q in range(s.src_start, s.src_end):
                assert q not in lifted
                lifted[q] = s.dst_start + (0 if s.op == "I" else q - s.src_start)
        assert [lifted[q] for q in range(len(back[hap]))] == back[hap]


def test_collection_is_built_from_variants(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c\nACGTNACGTA\n>d\nTTTT\n")
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\nc\t2\t.\tC\tG,CT\t.\t.\t.\tGT\t0|1\t2|0\t.|.\n")
    fa, vcf = str(tmp_path / "r.fa"), str(tmp_path / "v.vcf")
    rows = lambda *args, **kw: [tuple(r) for r in variants.built(spark, fa, *args, **kw).orderBy("ref_id").collect()]
    assert rows() == [(0, "c", "ACGTAACGTA"), (1, "d", "TTTT")]
    one = rows(vcf, acgt_only=False)
    assert [r[0] for r in one] == list(range(8)) and one[:2] == [(0, "c", "ACGTNACGTA"), (1, "d", "TTTT")]
    assert {n: s for _, n, s in one[2:]} == {"c/A/1": "ACGTNACGTA", "d/A/1": "TTTT", "c/B/1": "ACTGTNACGTA", "d/B/1": "TTTT", "c/C/1": "ACGTNACGTA", "d/C/1": "TTTT"}
    both = {n: s for _, n, s in rows(vcf, samples=1, haplotypes_of=[1, 2], acgt_only=False)}
    assert both == {"c": "ACGTNACGTA", "d": "TTTT", "c/A/1": "ACGTNACGTA", "d/A/1": "TTTT", "c/A/2": "AGGTNACGTA", "d/A/2": "TTTT"}
    assert set(both) - {"c", "d"} == {n for _, n, _ in rows(vcf, samples=["A"], haplotypes_of=[1, 2])[2:]}
    assert rows(vcf, samples=0) == rows()
    with pytest.raises(ValueError, match="no such samples"):
        rows(vcf, samples=["Z"])
    (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n")
    with pytest.raises(Exception, match="FASTQ where FASTA"):
        variants.built(spark, str(tmp_path / "x.fq")).collect()


@pytest.mark.parametrize("sent,at_once", [(10**6, 1 << 16), (10**6, 7), (0, 1 << 16)])
def test_matching_statistics(spark, monkeypatch, sent, at_once):
    """With the words in the tasks, in stretches of any size, and by joins."""
    monkeypatch.setattr(statistics, "AT_ONCE", at_once)
    rng = random.Random(4)
    refs = [(i, f"s{i}", dna(rng, 300)) for i in range(3)]
    reads = [(i, refs[i % 3][2][40 : 40 + 30 * i] + dna(rng, 40) + "Né") for i in range(6)] + [(6, ""), (7, None), (8, "A")]
    rf = spark.createDataFrame(refs, "ref_id long, name string, seq string")
    rd = spark.createDataFrame(reads, "read_id long, seq string")
    text = "|".join(r for _, _, r in refs)
    ms = statistics.matching_statistics(rd, rf, collection.seqidx(rf.withColumn("name", F.lit("r")), 1), matching.smems(rd, rf, 8), 8, sent)
    got = {r.read_id: r for r in ms.select("read_id", "lengths", "pointers", statistics.mem_list(F.col("lengths")).alias("mems")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 8}
    for i, seq in reads:
        if seq:
            want = [max(n for n in range(len(seq) - k + 1) if any(seq[k : k + n] in r for _, _, r in refs)) for k in range(len(seq))]
            assert got[i].lengths == want
            assert all(p == -1 if n == 0 else text[p : p + n] == seq[k : k + n] for k, (n, p) in enumerate(zip(want, got[i].pointers, strict=True)))
            assert [tuple(m) for m in got[i].mems] == [(k, n) for k, n in enumerate(want) if k == 0 or n >= want[k - 1]]


@pytest.mark.parametrize("alphabet", ["ab", "".join(map(chr, range(300, 620)))])
def test_sorted_words_against_scans(alphabet):
    rng = random.Random(3)
    text = "".join(rng.choice(alphabet) for _ in range(400))
    at = {}
    for i in range(len(text)):
        at.setdefault(text[i : i + 6], i)
    words = statistics.SortedWords(list(at), np.array(list(at.values())), 6)
    read = text[50:90] + "".join(rng.choice(alphabet + "?\x00") for _ in range(60)) + text[-4:]
    length, place = words.longest(words.numbers(read), 0, len(read))
    for i in range(len(read)):
        n = max(n for n in range(min(6, len(read) - i) + 1) if read[i : i + n] in text)
        assert (length[i], place[i]) == (n, text.find(read[i : i + n]) if n else -1)
    part = words.longest(words.numbers(read), 11, 57)
    assert part[0].tolist() == length[11:57].tolist() and part[1].tolist() == place[11:57].tolist()
    none = statistics.SortedWords([], np.zeros(0, np.int64), 6).longest(words.numbers(read), 0, len(read))
    assert not none[0].any() and (none[1] == -1).all()


@pytest.mark.parametrize("alphabet,width", [("ab", 6), ("ab", 9), ("acgt", 24), ("abNé", 13), ("a", 24)])
def test_words_packed_to_numbers_find_the_same(alphabet, width):
    rng = random.Random(width)
    text = "".join(rng.choice(alphabet) for _ in range(300))
    at = {}
    for i in range(len(text)):
        at.setdefault(text[i : i + width], i)
    words = statistics.SortedWords(list(at), np.array(list(at.values())), width)
    read = "".join(rng.choice(alphabet + "z") for _ in range(300)) + text[33:120] + "z" + text[-9:]
    steps, words_of = words.steps, lambda a, b: [x.tolist() for x in words.longest(words.numbers(read), a, b)]
    assert [n for _, n, _, _ in steps] == [8] + [5] * -(-max(0, width - 8) // 5)
    for a, b in ((0, len(read)), (17, 40), (len(read) - 4, len(read))):
        words.steps = steps
        packed = words_of(a, b)
        words.steps = None  # the search by whole words
        assert packed == words_of(a, b)


def test_sam_and_lists(spark, tmp_path):
    refs = spark.createDataFrame([(1, "a", "ACGT"), (2, "b", "AC")], "ref_id long, name string, seq string")
    rows = spark.createDataFrame([("r", 0, "a", 3, 7, None), ("s", 4, None, None, None, "3A0")], "qname string, flag int, rname string, pos long, AS int, MD string")
    sinks.write_sam(rows, collection.seqidx(refs), str(tmp_path / "sam"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sam/header")).collect()] == ["@HD\tVN:1.6\tSO:unknown", "@SQ\tSN:a\tLN:4", "@SQ\tSN:b\tLN:2", "@PG\tID:seqweave\tPN:seqweave"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "sam/records")).collect()) == ["r\t0\ta\t3\t0\t*\t*\t0\t0\t*\t*\tAS:i:7", "s\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\tMD:Z:3A0"]
    (tmp_path / "l").write_text("x 12\ny 3\n\n")
    assert [tuple(r) for r in sequences.lengths(spark, str(tmp_path / "l")).collect()] == [("x", 12), ("y", 3)]


def test_fastq_is_no_collection(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="FASTQ where FASTA is wanted"):
        sequences.fasta(spark, str(tmp_path / "a.fq")).collect()


def test_reads_turned_and_cut(spark):
    df = spark.createDataFrame([("ACGTN", "abcde"), (None, None), ("", "")], "seq string, qual string")
    got = df.select(S.revcomp_read(F.col("seq"), F.col("qual")).alias("r"), S.partial_read(F.col("seq"), F.col("qual"), F.lit(1), F.lit(3)).alias("p")).collect()
    assert [(tuple(x.r), tuple(x.p)) for x in got] == [(("NACGT", "edcba"), ("CGT", "bcd")), ((None, None), (None, None)), (("", ""), ("", ""))]
    assert df.select(S.sound_mapq(F.lit(255)).alias("q")).first().q == 255
    with pytest.raises(Exception, match="out of range"):
        df.select(S.sound_mapq(F.lit(256))).collect()
