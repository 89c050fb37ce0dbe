"""Alignment against references and haplotypes, with planted reads."""

import random
import re

from seqweave.operators import alignment as A, collection, haplotypes
from seqweave.sources import sinks, variants
from tests.test_alignment import dna


def test_planted_reads_on_haplotypes(spark):
    rng = random.Random(11)
    ref, put = dna(rng, 600), dna(rng, 200)
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[99]]
    hap = ref[:99] + other + ref[100:300] + put + ref[300:450] + ref[460:]
    refs = spark.createDataFrame([("c", ref), ("d", ""), ("e", dna(rng, 300))], "name string, seq string")
    alleles = [("c", "S", 1, 100, ref[99], other), ("c", "S", 1, 300, ref[299], ref[299] + put), ("c", "S", 1, 450, ref[449:460], ref[449])]
    found = spark.createDataFrame(alleles, "chrom string, sample string, hap int, pos long, ref string, alt string")
    coll = variants.with_haplotypes(refs, found, ["S"])
    seqs = {r.name: r.seq for r in coll.collect()}
    assert seqs["c"] == ref and seqs["c/S/1"] == hap and seqs["d/S/1"] == "" and len(seqs) == 6
    segments = variants.collection_segments(coll, found)
    over = hap[600:700]  # over the letters left out
    turned = over.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    texts = [ref[:80], hap[60:140], hap[350:450], over, turned, dna(rng, 100), "", None, hap[270:330]]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    cand = A.found(reads, coll, collection.seqidx(coll))
    rows = haplotypes.single(cand, reads, coll, segments)
    got = {int(r.qname): r for r in rows.collect()}
    assert len(got) == len(texts)
    place = lambda k: (got[k].flag, got[k].rname, got[k].pos, got[k].cigar)
    assert place(0) == (0, "c", 1, "80M") and got[0].AA == "c/S/1,1,160;" and got[0].n_ties == 1
    assert got[0].OA == f"c,1,+,80M,{got[0].mapq},0;" and got[0].ZS is None and got[0].mapq > 30  # the same place on the haplotype is no rival
    assert place(1) == (0, "c", 61, "80M") and (got[1].AS, got[1].NM, got[1].AA) == (160, 1, None) and got[1].OA == f"c/S/1,61,+,80M,{got[1].mapq},0;" and got[1].ZS is None
    assert place(2) == (4, "*", 0, "*") and (got[2].AS, got[2].NM, got[2].MD) == (200, None, None) and got[2].OA == f"c/S/1,351,+,100M,{got[2].mapq},0;"
    at = 600 - 200  # place on the reference before the letters left out
    assert place(3) == (0, "c", at + 1, "50M10D50M") and got[3].NM == 10 and got[3].OA.startswith("c/S/1,601,+,100M,")
    assert place(4) == (16, *place(3)[1:]) and got[4].OA.startswith("c/S/1,601,-,100M,") and got[4].seq == over
    assert all(place(k) == (4, "*", 0, "*") and got[k].OA is None and got[k].AS is None for k in (5, 6, 7))
    assert place(8) == (0, "c", 271, "30M30I") and got[8].NM == 30
    for k in (0, 1, 3, 4, 8):
        r = got[k]
        used = sum(int(n) for n, op in re.findall(r"(\d+)([MID])", r.cigar) if op != "I")
        assert A.replayed(r.seq, r.cigar, r.MD) == ref[r.pos - 1 : r.pos - 1 + used]
    line = next(r.line for r in rows.where("qname = '0'").select(sinks.sam_line(rows).alias("line")).collect())
    assert line.endswith(f"\tOA:Z:c,1,+,80M,{got[0].mapq},0;\tAA:Z:c/S/1,1,160;")
    assert haplotypes.single(cand.limit(0), reads.limit(0), coll, segments).count() == 0
