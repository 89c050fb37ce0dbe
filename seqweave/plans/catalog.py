"""Queries over the given tables, and their SQL twins.

References are the rows of benchmark, reads the rows of documents, mates neighbouring turns of conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S
from ..operators import alignment, chaining, collection, distributed, extending, haplotypes, intervals, lifting, matching, pairing, pseudo, statistics, suffix
from ..sources import sinks, variants

K = 25
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))


def refs(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("seq"))


def found(spark, sf) -> DataFrame:
    return matching.smems(reads(spark, sf), refs(spark, sf), K)


def index(spark, sf) -> DataFrame:
    return collection.seqidx(refs(spark, sf), 1)


INDEX_SQL = """WITH idx AS (SELECT item_id AS ref_id, 'item' || item_id AS name, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS len FROM benchmark)
"""


@query(INDEX_SQL + "SELECT ref_id, name, start, len FROM idx")
def seqidx_build(spark, sf):
    return index(spark, sf)


def located(spark, sf):
    end = index(spark, sf).agg(F.max(F.col("start") + F.col("len")).alias("n"))
    asked = table(spark, sf, "documents").select("doc_id", "n_chars").crossJoin(F.broadcast(end)).select("doc_id", F.pmod(F.col("doc_id") * 7919 + F.col("n_chars"), F.col("n")).alias("pos"), F.pmod(F.col("n_chars"), F.lit(100)).alias("width"))
    return collection.locate(asked, index(spark, sf))


LOCATED_SQL = INDEX_SQL + """, ask AS (SELECT doc_id, (doc_id * 7919 + n_chars) % (SELECT max(start + len) FROM idx) AS pos, n_chars % 100 AS width FROM documents),
loc AS (SELECT doc_id, pos, width, ref_id, name, start, len, pos - start AS "offset" FROM ask JOIN idx ON pos >= start AND pos < start + len)
"""


@query(LOCATED_SQL + 'SELECT doc_id, pos, ref_id, name, "offset" FROM loc')
def locate_position(spark, sf):
    return located(spark, sf).select("doc_id", "pos", "ref_id", "name", "offset")


@query(LOCATED_SQL + 'SELECT doc_id, "offset" + width <= len AS valid FROM loc')
def interval_valid(spark, sf):
    return collection.valid(located(spark, sf), "width").select("doc_id", "valid")


@query(LOCATED_SQL + 'SELECT doc_id, pos, start + "offset" AS lifted FROM loc')
def lift_identity(spark, sf):
    return collection.lift(located(spark, sf), collection.identity_lift(index(spark, sf))).select("doc_id", "pos", "lifted")


@query(LOCATED_SQL + ', two AS (SELECT ask.doc_id, ref_id, pos + width % 3 - start AS "offset" FROM ask JOIN idx ON pos + width % 3 >= start AND pos + width % 3 < start + len) SELECT a.doc_id, a.ref_id = b.ref_id AND a."offset" = b."offset" AS same FROM loc a JOIN two b ON a.doc_id = b.doc_id')
def same_region(spark, sf):
    """The place that a document asks for, and one up to two characters further on."""
    places = located(spark, sf).select("doc_id", "pos", "width")
    near = places.select("doc_id", (F.col("pos") + F.pmod("width", F.lit(3))).alias("pos"))
    segments = collection.identity_lift(index(spark, sf))
    return collection.same_region(collection.locate(places, index(spark, sf)), collection.locate(near, index(spark, sf)), "doc_id", segments)


@query(LOCATED_SQL + 'SELECT doc_id, pos, name, "offset", start + "offset" AS lifted, substr(text, "offset" + 1, least(width, len - "offset")) AS part FROM loc JOIN benchmark ON item_id = ref_id')
def random_access(spark, sf):
    found = collection.lift(located(spark, sf), collection.identity_lift(index(spark, sf)))
    return collection.random_access(found, refs(spark, sf), "width").select("doc_id", "pos", "name", "offset", "lifted", "part")


DNA_SQL = "regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT'), '[^ACGT]', 'N', 'gs')"


@query(f"SELECT doc_id, sha256(reverse(translate(s, 'ACGTacgt', 'TGCATGCA'))) AS digest FROM (SELECT doc_id, {DNA_SQL} AS s FROM documents)")
def revcomp(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.revcomp(S.dna_view(F.col("text"))), 256).alias("digest"))


@query(f"SELECT doc_id, sha256(translate(regexp_replace(s, '[^ACGTacgt]', '4', 'gs'), 'ACGTacgt', '01230123')) AS digest FROM (SELECT doc_id, {DNA_SQL} AS s FROM documents)")
def nt4_encode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.nt4(S.dna_view(F.col("text"))), 256).alias("digest"))


HITS_SQL = f"""WITH rd AS (SELECT doc_id AS read_id, text AS seq FROM documents WHERE length(text) >= {K}),
rf AS (SELECT item_id AS ref_id, text AS seq FROM benchmark WHERE length(text) >= {K}),
qk AS (SELECT read_id, i AS qpos, substr(seq, i + 1, {K}) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM rd)),
rk AS (SELECT ref_id, i AS rpos, substr(seq, i + 1, {K}) AS kmer FROM (SELECT ref_id, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM rf)),
hits AS (SELECT read_id, qpos, ref_id, rpos FROM qk JOIN rk USING (kmer))
"""
MEMS_SQL = HITS_SQL + f""", isl AS (SELECT *, rpos - qpos AS diag, qpos - row_number() OVER (PARTITION BY read_id, ref_id, rpos - qpos ORDER BY qpos) AS g FROM hits),
run AS (SELECT read_id, ref_id, diag + min(qpos) AS rpos, min(qpos) AS qs, max(qpos) + {K} AS qe FROM isl GROUP BY read_id, ref_id, diag, g),
iv AS (SELECT DISTINCT read_id, qs, qe FROM run),
mem AS (SELECT k.read_id, k.qs, k.qe FROM (SELECT *, max(qe) OVER (PARTITION BY read_id ORDER BY qs, qe DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv) k JOIN rd USING (read_id)
        WHERE (pm IS NULL OR qe > pm) AND regexp_matches(substr(rd.seq, qs + 1, qe - qs), '[^N]')),
occ AS (SELECT read_id, qs, qe, ref_id, rpos FROM mem JOIN run USING (read_id, qs, qe))
"""


@query(HITS_SQL + "SELECT read_id, qpos, ref_id, rpos FROM hits")
def kmer_hits(spark, sf):
    return matching.kmer_hits(reads(spark, sf), refs(spark, sf), K)


@query(MEMS_SQL + "SELECT read_id, qs, qe FROM mem")
def smem_intervals(spark, sf):
    return matching.intervals(found(spark, sf)).select("read_id", "qs", "qe")


@query(MEMS_SQL + "SELECT read_id, qs, qe, ref_id, rpos FROM occ")
def smem_occurrences(spark, sf):
    return matching.occurrences(found(spark, sf))


@query(MEMS_SQL + "SELECT read_id, qs, qe FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY qe - qs DESC, qs) AS n FROM mem) WHERE n = 1")
def longest_mem(spark, sf):
    return matching.longest(found(spark, sf))


@query(MEMS_SQL + "SELECT count(*) FILTER (m >= 25) AS over_25, count(*) FILTER (m >= 50) AS over_50, count(*) FILTER (m >= 75) AS over_75 FROM (SELECT max(qe - qs) AS m FROM mem GROUP BY read_id)")
def reads_over_threshold(spark, sf):
    best = matching.longest(found(spark, sf)).select((F.col("qe") - F.col("qs")).alias("m"))
    return best.agg(*(F.count_if(F.col("m") >= t).alias(f"over_{t}") for t in (25, 50, 75)))


@query(MEMS_SQL + "SELECT doc_id AS read_id FROM documents WHERE doc_id IN (SELECT read_id FROM mem)")
def semi_matched_reads(spark, sf):
    return reads(spark, sf).join(found(spark, sf), "read_id", "left_semi").select("read_id")


@query(MEMS_SQL + "SELECT doc_id AS read_id FROM documents WHERE doc_id NOT IN (SELECT read_id FROM mem)")
def anti_unmatched_reads(spark, sf):
    return reads(spark, sf).join(found(spark, sf), "read_id", "left_anti").select("read_id")


HALF_SQL = MEMS_SQL + f""", hv AS (SELECT read_id, qs, qe, 0 AS half FROM mem UNION ALL SELECT read_id, qs, qs + (qe - qs) // 2, 1 FROM mem WHERE qe - qs >= {2 * K} UNION ALL SELECT read_id, qs + (qe - qs) // 2, qe, 2 FROM mem WHERE qe - qs >= {2 * K}),
ho AS (SELECT hv.*, run.ref_id, run.rpos + hv.qs - run.qs AS rpos FROM hv JOIN run ON run.read_id = hv.read_id AND run.qs <= hv.qs AND run.qe >= hv.qe)
"""


def halves(spark, sf) -> DataFrame:
    return matching.with_halves(reads(spark, sf), refs(spark, sf), K)


@query(HALF_SQL + "SELECT read_id, qs, qe, half, ref_id, rpos FROM ho")
def sub_seeds(spark, sf):
    return halves(spark, sf)


#: Both strands of the documents in their DNA-like view, under 2 * doc_id + strand, against the items in theirs. Of four documents in
#: order of doc_id the latter two are reads of the other strand, so matches fall on either.
STRANDS_SQL = f"""WITH rd AS (SELECT 2 * doc_id + strand AS read_id, CASE WHEN strand <> doc_id // 2 % 2 THEN reverse(translate(s, 'ACGTacgt', 'TGCATGCA')) ELSE s END AS seq FROM (SELECT doc_id, {DNA_SQL} AS s, unnest([0, 1]) AS strand FROM documents WHERE length(text) >= {K})),
rf AS (SELECT item_id AS ref_id, {DNA_SQL} AS seq FROM benchmark WHERE length(text) >= {K}),
""" + MEMS_SQL[MEMS_SQL.index("qk AS") :]


def both_strands(spark, sf, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The documents on both strands, and their matches."""
    view = S.dna_view(F.col("seq"))
    other = F.pmod(F.floor(F.col("read_id") / 2), F.lit(2)) == 1
    both = alignment.stranded(reads(spark, sf).withColumn("seq", F.when(other, S.revcomp(view)).otherwise(view)))
    return both, matching.smems(both, refs(spark, sf).withColumn("seq", S.dna_view(F.col("seq"))), k)


def of_length(sql: str, k: int) -> str:
    """The SQL of matches for another least length."""
    return re.sub(rf"\b{K}\b", str(k), re.sub(rf"\b{K - 1}\b", str(k - 1), sql))


def dna_matches(spark, sf, k: int) -> DataFrame:
    """Matches of k letters or more between documents and items, both in their DNA-like view, where short ones repeat."""
    view = S.dna_view(F.col("seq"))
    return matching.smems(reads(spark, sf).withColumn("seq", view), refs(spark, sf).withColumn("seq", view), k)


DNA_MEMS_SQL = f"""WITH rd AS (SELECT doc_id AS read_id, {DNA_SQL} AS seq FROM documents WHERE length(text) >= {K}),
rf AS (SELECT item_id AS ref_id, {DNA_SQL} AS seq FROM benchmark WHERE length(text) >= {K}),
""" + MEMS_SQL[MEMS_SQL.index("qk AS") :]
#: Least lengths at which the filters below have something to drop.
CAP_K, SHARE_K, SIDE_K = 11, 12, 12


@query(of_length(DNA_MEMS_SQL, CAP_K) + "SELECT read_id, qs, qe, ref_id, rpos FROM (SELECT *, row_number() OVER (PARTITION BY read_id, qs, qe, ref_id ORDER BY rpos) AS n FROM occ) WHERE n <= 1")
def seed_cap(spark, sf):
    """One occurrence of a match in each item."""
    return matching.seed_cap(matching.occurrences(dna_matches(spark, sf, CAP_K)), 1)


@query(of_length(DNA_MEMS_SQL, SHARE_K) + "SELECT read_id, qs, qe, n_occ FROM (SELECT *, n_occ / sum(n_occ) OVER (PARTITION BY read_id) AS share FROM (SELECT read_id, qs, qe, count(*) AS n_occ FROM occ GROUP BY ALL)) WHERE share <= 0.1")
def freq_filter(spark, sf):
    """Matches that hold at most a tenth of their read's occurrences."""
    return matching.frequency_filter(matching.intervals(dna_matches(spark, sf, SHARE_K)), 0.1).select("read_id", "qs", "qe", "n_occ")


@query(of_length(STRANDS_SQL, SIDE_K) + """, d AS (SELECT read_id, read_id // 4 AS pair_id, (read_id // 2 + read_id) % 2 AS dir, qs, qe FROM mem),
m AS (SELECT *, coalesce(avg(qe - qs) FILTER (dir = 0) OVER (PARTITION BY pair_id), 0) AS m0, coalesce(avg(qe - qs) FILTER (dir = 1) OVER (PARTITION BY pair_id), 0) AS m1 FROM d)
SELECT pair_id, read_id, qs, qe, CAST(dir AS INTEGER) AS dir FROM m WHERE NOT ((dir = 0 AND m1 - m0 > 50) OR (dir = 1 AND m0 - m1 > 50))""")
def direction_filter(spark, sf):
    """Documents 2i and 2i + 1 are mates."""
    mems = matching.paired_directions(matching.intervals(both_strands(spark, sf, SIDE_K)[1]))
    return matching.direction_filter(mems, 50.0, "pair_id").select("pair_id", "read_id", "qs", "qe", "dir")


@query(STRANDS_SQL + "SELECT CAST(read_id // 2 AS VARCHAR) AS qname, CAST(256 + 16 * (read_id % 2) AS INTEGER) AS flag, 'item' || ref_id AS rname, rpos + 1 AS pos, (qe - qs) || 'M' AS cigar, substr(seq, qs + 1, qe - qs) AS match FROM occ JOIN rd USING (read_id)")
def mem_sam_strands(spark, sf):
    both, mems = both_strands(spark, sf)
    return matching.mem_sam(mems, both, refs(spark, sf).select("ref_id", "name"), stranded=True)


@query(MEMS_SQL + """, s AS (SELECT read_id, qs, qe, ref_id, count(*) AS c FROM occ GROUP BY ALL), t0 AS (SELECT read_id, sum(c) AS n, max(c) AS hi, min(c) AS lo FROM s GROUP BY read_id, qs, qe), t AS (SELECT *, CASE WHEN n > 0.5 * sum(n) OVER (PARTITION BY read_id) THEN n ELSE 0 END AS gone FROM t0)
SELECT read_id, CAST(sum(gone) AS BIGINT) AS filtered, count(*) AS n_unique, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS max_freq, CAST(min(n) AS BIGINT) AS min_freq, max(hi) AS highest_occ, min(lo) AS lowest_occ FROM t GROUP BY read_id""")
def mem_stats_csv(spark, sf):
    return matching.mem_stats(found(spark, sf))


@query()
def mem_stats_chains(spark, sf):
    """Match statistics of the matches of 12 letters in the DNA-like view, with the chains that are skipped as they begin less than 10
    letters after another of their score; reads without a chain have skipped none."""
    mems = distributed.stored(dna_matches(spark, sf, SHARE_K))
    skipped = chaining.skipped(chaining.solved(chaining.anchors(mems, index(spark, sf))), 10)
    return matching.mem_stats(mems).join(skipped, "read_id", "left").fillna(0, ["chains_skipped"])


@query(MEMS_SQL + "SELECT CAST(read_id AS VARCHAR) AS qname, 256 AS flag, 'item' || ref_id AS rname, rpos + 1 AS pos, (qe - qs) || 'M' AS cigar, substr(seq, qs + 1, qe - qs) AS match FROM occ JOIN rd USING (read_id)")
def mem_sam_rows(spark, sf):
    return matching.mem_sam(found(spark, sf), reads(spark, sf), refs(spark, sf).select("ref_id", "name"))


@query(MEMS_SQL + "SELECT (SELECT count(*) FROM documents) AS processed, (SELECT count(DISTINCT read_id) FROM mem) AS aligned")
def run_counters(spark, sf):
    hit = found(spark, sf).select("read_id").distinct().withColumn("hit", F.lit(1))
    return reads(spark, sf).join(hit, "read_id", "left").agg(F.count("*").alias("processed"), F.count("hit").alias("aligned"))


# ---- matching statistics and text forms ----

WORDS_SQL = MEMS_SQL.replace("WITH rd AS", INDEX_SQL.strip() + ", rd AS", 1) + f""", pl AS (SELECT doc_id AS read_id, i, substr(text, i + 1, {K - 1}) AS ahead FROM (SELECT doc_id, text, unnest(range(0, length(text))) AS i FROM documents)),
wd AS (SELECT substr(text, i + 1, n) AS word, min(start + i) AS ptr FROM (SELECT text, start, i, unnest(range(1, {K})) AS n FROM (SELECT text, start, unnest(range(0, length(text))) AS i FROM benchmark JOIN idx ON item_id = ref_id)) WHERE i + n <= length(text) GROUP BY 1),
sh AS (SELECT read_id, i, max(n) AS len, arg_max(ptr, n) AS ptr FROM (SELECT read_id, i, ahead, unnest(range(1, length(ahead) + 1)) AS n FROM pl) JOIN wd ON substr(ahead, 1, n) = word GROUP BY ALL),
fp AS (SELECT read_id, qs, qe, min(start + rpos) AS p FROM occ JOIN idx USING (ref_id) GROUP BY ALL),
lo AS (SELECT read_id, i, max(qe - i) AS len, arg_max(p + i - qs, qe - i) AS ptr FROM (SELECT read_id, qs, qe, p, unnest(range(qs, qe - {K - 1})) AS i FROM fp) GROUP BY read_id, i),
ms AS (SELECT read_id, i, coalesce(lo.len, sh.len, 0) AS len, coalesce(lo.ptr, sh.ptr, -1) AS ptr FROM pl LEFT JOIN sh USING (read_id, i) LEFT JOIN lo USING (read_id, i))
"""


def statistics_of(spark, sf) -> DataFrame:
    return statistics.matching_statistics(reads(spark, sf), refs(spark, sf), index(spark, sf), found(spark, sf), K)


@query(WORDS_SQL + """SELECT read_id, count(*) AS n, CAST(sum(len) AS BIGINT) AS total, max(len) AS longest, sha256('>' || read_id || chr(10) || string_agg(len, ' ' ORDER BY i)) AS digest FROM ms GROUP BY read_id""")
def ms_lengths(spark, sf):
    n = F.col("lengths")
    text = sinks.lengths_text(F.col("read_id").cast("string"), n)
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    return statistics_of(spark, sf).select("read_id", F.size(n).cast("long").alias("n"), total.alias("total"), F.array_max(n).alias("longest"), F.sha2(text, 256).alias("digest"))


@query(WORDS_SQL + """SELECT read_id, count(*) AS n, sha256('>' || read_id || chr(10) || string_agg(ptr, ' ' ORDER BY i)) AS digest FROM ms GROUP BY read_id""")
def ms_pointers(spark, sf):
    text = sinks.lengths_text(F.col("read_id").cast("string"), F.col("pointers"))
    return statistics_of(spark, sf).select("read_id", F.size("pointers").cast("long").alias("n"), F.sha2(text, 256).alias("digest"))


@query(WORDS_SQL + """, e AS (SELECT *, lag(len) OVER (PARTITION BY read_id ORDER BY i) AS prev FROM ms)
SELECT read_id, count(*) AS n, sha256('>' || read_id || chr(10) || string_agg('(' || i || ',' || len || ')', ' ' ORDER BY i)) AS digest FROM e WHERE prev IS NULL OR len >= prev GROUP BY read_id""")
def mem_list(spark, sf):
    m = statistics_of(spark, sf).select("read_id", statistics.mem_list(F.col("lengths")).alias("mems"))
    return m.select("read_id", F.size("mems").cast("long").alias("n"), F.sha2(sinks.mems_text(F.col("read_id").cast("string"), F.col("mems")), 256).alias("digest"))


@query(MEMS_SQL + """SELECT read_id || chr(9) || 256 || chr(9) || 'item' || ref_id || chr(9) || (rpos + 1) || chr(9) || 0 || chr(9) || (qe - qs) || 'M' || chr(9) || '*' || chr(9) || 0 || chr(9) || 0 || chr(9) || '*' || chr(9) || '*' || chr(9) || 'AS:i:' || (2 * (qe - qs)) AS line FROM occ""")
def mem_sam_lines(spark, sf):
    rows = matching.mem_sam(found(spark, sf), reads(spark, sf), refs(spark, sf).select("ref_id", "name")).withColumn("AS", 2 * F.length("match"))
    return rows.select(sinks.sam_line(rows.drop("match")).alias("line"))


@query("SELECT item_id AS ref_id, sha256('>item' || item_id || chr(10) || rtrim(regexp_replace(text, '(.{60})', '\\1' || chr(10), 'gs'), chr(10))) AS digest FROM benchmark")
def fasta_records(spark, sf):
    return refs(spark, sf).select("ref_id", F.sha2(sinks.fasta_text(F.col("name"), F.col("seq")), 256).alias("digest"))


#: Each document asks for an edit of an item: all items in turn; its place, the letters replaced and those put there follow from doc_id.
CALLS_SQL = """WITH it AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark),
x AS (SELECT 'item' || item_id AS chrom, coalesce(lang, 'und') AS sample, CAST(doc_id % 2 + 1 AS INTEGER) AS hap, (doc_id * 37) % length(it.text) + 1 AS pos, doc_id, it.text FROM documents d JOIN it ON k = doc_id % (SELECT count(*) FROM benchmark) WHERE length(it.text) > 0),
calls AS (SELECT DISTINCT chrom, sample, hap, pos, substr(text, pos, 1 + doc_id % 3) AS ref, substr('ZQX', 1, 1 + (doc_id // 3) % 3) AS alt FROM x),
v AS (SELECT * FROM (SELECT *, max(pos + length(ref)) OVER (PARTITION BY chrom, sample, hap ORDER BY pos, ref, alt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM calls) WHERE e IS NULL OR pos >= e)
"""


def calls(spark, sf) -> DataFrame:
    items = distributed.ranked(refs(spark, sf), ["ref_id"], "k")
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("sample")).crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))
    both = d.withColumn("k", F.pmod("doc_id", F.col("n"))).join(items.where(F.length("seq") > 0), "k")
    pos = (F.col("doc_id") * 37) % F.length("seq") + 1
    ref = F.substr("seq", F.col("pos").cast("int"), (1 + F.col("doc_id") % 3).cast("int"))
    alt = F.substr(F.lit("ZQX"), F.lit(1), (1 + F.floor(F.col("doc_id") / 3) % 3).cast("int"))
    return variants.applied(both.withColumn("pos", pos).select(F.col("name").alias("chrom"), "sample", (F.col("doc_id") % 2 + 1).cast("int").alias("hap"), "pos", ref.alias("ref"), alt.alias("alt")).distinct())


@query(CALLS_SQL + "SELECT chrom, sample, hap, pos, ref, alt FROM v")
def applied_variants(spark, sf):
    return calls(spark, sf)


@query(CALLS_SQL + """, p AS (SELECT v.*, text, coalesce(lag(pos + length(ref)) OVER (PARTITION BY chrom, sample, hap ORDER BY pos), 1) AS f FROM v JOIN benchmark ON chrom = 'item' || item_id)
SELECT chrom AS name, sample, hap, string_agg(substr(text, f, pos - f) || alt, '' ORDER BY pos) || substr(any_value(text), max(pos + length(ref))) AS seq FROM p GROUP BY chrom, sample, hap""")
def haplotype_sequences(spark, sf):
    return variants.haplotypes(refs(spark, sf).select("name", "seq"), calls(spark, sf))


@query(CALLS_SQL + """, s AS (SELECT *, coalesce(sum(length(alt) - length(ref)) OVER (PARTITION BY chrom, sample, hap ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sh, least(length(ref), length(alt)) AS c FROM v),
g AS (SELECT chrom, sample, hap, pos, pos - 1 + c AS r0, pos - 1 + length(ref) AS r1, pos - 1 + c + sh AS q0, pos - 1 + length(alt) + sh AS q1 FROM s),
k AS (SELECT chrom, sample, hap, pos, q1 AS src, r1 AS dst, q0 FROM g UNION ALL SELECT DISTINCT chrom, sample, hap, 0, 0, 0, NULL FROM g),
eq AS (SELECT k.*, coalesce(lead(q0) OVER (PARTITION BY chrom, sample, hap ORDER BY pos), src + length(text) - dst) AS stop FROM k JOIN benchmark ON chrom = 'item' || item_id)
SELECT chrom AS name, sample, hap, CAST(src AS BIGINT) AS src_start, CAST(stop AS BIGINT) AS src_end, CAST(dst AS BIGINT) AS dst_start, '=' AS op FROM eq WHERE stop > src
UNION ALL SELECT chrom, sample, hap, CAST(q0 AS BIGINT), CAST(q1 AS BIGINT), CAST(r0 AS BIGINT), 'I' FROM g WHERE q1 > q0""")
def lift_segments(spark, sf):
    return variants.lift_segments(refs(spark, sf).select("name", "seq"), calls(spark, sf))


# ---- suffix structures ----


def chars(spark, sf):
    return suffix.characters(refs(spark, sf))


def array(spark, sf):
    return suffix.suffix_array(chars(spark, sf))


def transform(spark, sf):
    c = chars(spark, sf)
    return suffix.bwt(c, suffix.suffix_array(c))


SA_SQL = """WITH x AS (SELECT string_agg(text || chr(2), '' ORDER BY item_id) || chr(1) AS s FROM benchmark),
sa AS (SELECT i, row_number() OVER (ORDER BY substr(s, i + 1)) - 1 AS rank FROM (SELECT s, unnest(range(0, length(s))) AS i FROM x)),
b AS (SELECT rank, i, ord(substr((SELECT s FROM x), CASE WHEN i = 0 THEN length((SELECT s FROM x)) ELSE i END, 1)) AS c FROM sa)
"""
RUN_SQL = SA_SQL + """, r0 AS (SELECT *, CASE WHEN c = lag(c) OVER (ORDER BY rank) THEN 0 ELSE 1 END AS new FROM b),
r1 AS (SELECT *, sum(new) OVER (ORDER BY rank) - 1 AS run FROM r0),
rn AS (SELECT CAST(run AS BIGINT) AS run_id, min(c) AS head, min(rank) AS start, count(*) AS len, min_by(i, rank) AS sa_first, max_by(i, rank) AS sa_last FROM r1 GROUP BY run)
"""
#: Common prefixes as far as the longest text goes: bit by bit, as a prefix that is shared has all shorter ones shared.
_LCP_STEPS = 10
LCP_SQL = SA_SQL + ", l0 AS (SELECT rank, i, lag(i) OVER (ORDER BY rank) AS j, 0 AS n FROM sa)" + "".join(
    f", l{k + 1} AS (SELECT rank, i, j, n + CASE WHEN j IS NOT NULL AND greatest(i, j) + n + {1 << (_LCP_STEPS - k)} <= length((SELECT s FROM x)) AND substr((SELECT s FROM x), i + n + 1, {1 << (_LCP_STEPS - k)}) = substr((SELECT s FROM x), j + n + 1, {1 << (_LCP_STEPS - k)}) THEN {1 << (_LCP_STEPS - k)} ELSE 0 END AS n FROM l{k})" for k in range(_LCP_STEPS + 1)
) + f", lc AS (SELECT rank, n AS lcp FROM l{_LCP_STEPS + 1})\n"


@query(SA_SQL + "SELECT rank, i FROM sa")
def suffix_array(spark, sf):
    return array(spark, sf).select("rank", "i")


@query(SA_SQL + "SELECT rank, c FROM b")
def bwt(spark, sf):
    return transform(spark, sf).select("rank", "c")


@query(RUN_SQL + "SELECT run_id, head, start, len, sa_first, sa_last FROM rn")
def bwt_runs(spark, sf):
    return suffix.runs(transform(spark, sf))


@query(SA_SQL + ", n AS (SELECT c, count(*) AS n FROM b GROUP BY c) SELECT c, n, CAST(coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM n")
def f_column(spark, sf):
    return suffix.f_column(transform(spark, sf))


@query(SA_SQL + "SELECT rank, row_number() OVER (ORDER BY c, rank) - 1 AS lf FROM b")
def lf_mapping(spark, sf):
    return suffix.lf(transform(spark, sf))


@query(SA_SQL + "SELECT i, lag(i) OVER (ORDER BY rank) AS prev FROM sa")
def phi(spark, sf):
    return suffix.phi(array(spark, sf))


@query(SA_SQL + "SELECT i, lead(i) OVER (ORDER BY rank) AS next FROM sa")
def phi_inv(spark, sf):
    return suffix.phi_inv(array(spark, sf))


@query(RUN_SQL + """, w AS (SELECT run_id, head, coalesce(sum(len) OVER (PARTITION BY head ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hr, row_number() OVER (PARTITION BY head ORDER BY run_id) - 1 AS rr FROM rn),
f AS (SELECT head, coalesce(sum(n) OVER (ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM (SELECT head, sum(len) AS n FROM rn GROUP BY head))
SELECT run_id, head, CAST(hr AS BIGINT) AS head_rank, rr AS run_head_rank, CAST(hr + f AS BIGINT) AS lf FROM w JOIN f USING (head)""")
def run_ranks(spark, sf):
    return suffix.run_ranks(suffix.runs(transform(spark, sf)))


@query(LCP_SQL + "SELECT rank, CAST(lcp AS BIGINT) AS lcp FROM lc")
def lcp_array(spark, sf):
    c = chars(spark, sf)
    return suffix.lcp(c, suffix.suffix_array(c))


# ---- matches as intervals of the suffix array ----


def with_intervals(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The maximal matches of the documents as intervals, from the first place of each, and the suffix array."""
    at = found(spark, sf).join(index(spark, sf).select("ref_id", "start"), "ref_id")
    one = at.groupBy("read_id", "qs", "qe").agg(F.min(F.col("start") + F.col("rpos")).alias("place")).withColumn("len", F.col("qe") - F.col("qs"))
    c = chars(spark, sf)
    sa = suffix.suffix_array(c)
    return intervals.of_matches(one, sa, suffix.lcp(c, sa)).select("read_id", "qs", "qe", "sa_lo", "sa_hi", "n_occ"), sa


INTERVALS_SQL = MEMS_SQL + ", " + INDEX_SQL.strip().removeprefix("WITH ") + ", " + SA_SQL[: SA_SQL.index("b AS (")].strip().removeprefix("WITH ").rstrip(",") + """,
oc AS (SELECT read_id, qs, qe, ref_id, rpos, rank FROM occ JOIN idx USING (ref_id) JOIN sa ON i = start + rpos),
si AS (SELECT read_id, qs, qe, min(rank) AS sa_lo, max(rank) AS sa_hi, count(*) AS n_occ FROM oc GROUP BY ALL)
"""


@query(INTERVALS_SQL + "SELECT read_id, qs, qe, sa_lo, sa_hi, n_occ FROM si")
def smem_suffix_intervals(spark, sf):
    return with_intervals(spark, sf)[0]


@query(INTERVALS_SQL + "SELECT read_id, qs, qe, rank, ref_id, rpos FROM (SELECT *, row_number() OVER (PARTITION BY read_id, qs, qe ORDER BY rank) AS n FROM oc) WHERE n <= 2")
def smem_first_page(spark, sf):
    """The first two occurrences of each match in suffix order."""
    rows, sa = with_intervals(spark, sf)
    return intervals.page(rows, sa, index(spark, sf), 0, 2).select("read_id", "qs", "qe", "rank", "ref_id", "rpos")


@query(INTERVALS_SQL + """SELECT read_id, count(*) AS n_unique, CAST(sum(n_occ) AS BIGINT) AS total, max(n_occ) AS max_freq, min(n_occ) AS min_freq, CAST(sum(CASE WHEN n_occ > 0.5 * t THEN n_occ ELSE 0 END) AS BIGINT) AS filtered
FROM (SELECT *, sum(n_occ) OVER (PARTITION BY read_id) AS t FROM si) GROUP BY read_id""")
def interval_stats(spark, sf):
    return intervals.stats(with_intervals(spark, sf)[0])


@query(WORDS_SQL + ", " + SA_SQL[: SA_SQL.index("b AS (")].strip().removeprefix("WITH ").rstrip(",") + """,
e AS (SELECT *, lag(len) OVER (PARTITION BY read_id ORDER BY i) AS prev FROM ms),
m AS (SELECT read_id, i, CAST(len AS BIGINT) AS len, substr((SELECT s FROM x), ptr + 1, len) AS w FROM e WHERE len > 0 AND (prev IS NULL OR len >= prev)),
t AS (SELECT w, min(rank) AS lo, count(*) AS n FROM (SELECT rank, substr(s, sa.i + 1, l.len) AS w FROM sa, x, (SELECT DISTINCT len FROM m) l WHERE sa.i + l.len <= length(s)) WHERE w IN (SELECT w FROM m) GROUP BY w)
SELECT read_id, count(*) AS n_matches, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, count(*) FILTER (n = 1) AS singles, CAST(sum(lo) AS BIGINT) AS lo_sum FROM m JOIN t USING (w) GROUP BY read_id""")
def mem_list_counts(spark, sf):
    """Occurrences of every entry of the match list, of any length, from one place of each: no occurrence is listed."""
    # places are put beside the lengths before the list is dealt into rows, so that no row carries the array of all places of its read
    beside = F.transform(statistics.mem_list(F.col("lengths")), lambda m: F.struct(m["len"].cast("long").alias("len"), F.get("pointers", m["idx"]).alias("place")))
    rows = statistics_of(spark, sf).select("read_id", F.explode(beside).alias("m")).select("read_id", "m.len", "m.place").where("len > 0")
    c = chars(spark, sf)
    sa = suffix.suffix_array(c)
    counted = intervals.of_matches(rows, sa, suffix.lcp(c, sa))
    return counted.groupBy("read_id").agg(F.count("*").alias("n_matches"), F.sum("n_occ").alias("total"), F.max("n_occ").alias("most"), F.count_if(F.col("n_occ") == 1).alias("singles"), F.sum("sa_lo").alias("lo_sum"))


@query(LCP_SQL + """, r0 AS (SELECT *, CASE WHEN c = lag(c) OVER (ORDER BY rank) THEN 0 ELSE 1 END AS new FROM b),
rn AS (SELECT run AS run_id, min(c) AS head, min(rank) AS start, max(rank) + 1 AS stop FROM (SELECT *, CAST(sum(new) OVER (ORDER BY rank) - 1 AS BIGINT) AS run FROM r0) GROUP BY run),
gp AS (SELECT *, lag(stop) OVER (PARTITION BY head ORDER BY run_id) AS lo FROM rn),
mn AS (SELECT run_id, arg_min(rank, CAST(lcp AS BIGINT) * 1000000000 + rank) AS t FROM gp JOIN lc ON lc.rank BETWEEN gp.lo AND gp.start GROUP BY run_id)
SELECT run_id, CAST(coalesce(t, 0) AS BIGINT) AS threshold FROM rn LEFT JOIN mn USING (run_id)""")
def thresholds(spark, sf):
    c = chars(spark, sf)
    sa = suffix.suffix_array(c)
    return suffix.thresholds(suffix.runs(suffix.bwt(c, sa)), suffix.lcp(c, sa))


def with_lcp(spark, sf):
    c = chars(spark, sf)
    sa = suffix.suffix_array(c)
    return sa, suffix.lcp(c, sa)


@query(LCP_SQL + "SELECT i, j AS prev, CAST(n AS BIGINT) AS lcp FROM " + f"l{_LCP_STEPS + 1}")
def phi_lcp(spark, sf):
    return suffix.phi_lcp(*with_lcp(spark, sf))


@query(LCP_SQL + "SELECT i, lead(i) OVER (ORDER BY rank) AS next, CAST(coalesce(lead(n) OVER (ORDER BY rank), 0) AS BIGINT) AS lcp FROM " + f"l{_LCP_STEPS + 1}")
def phi_inv_lcp(spark, sf):
    return suffix.phi_inv_lcp(*with_lcp(spark, sf))


@query(RUN_SQL + "SELECT head, count(*) AS n_runs FROM rn GROUP BY head")
def letter_runs(spark, sf):
    return suffix.letter_runs(suffix.runs(transform(spark, sf)))


@query(RUN_SQL + "SELECT head, row_number() OVER (PARTITION BY head ORDER BY run_id) AS k, run_id FROM rn")
def run_select(spark, sf):
    return suffix.run_select(suffix.runs(transform(spark, sf)))


@query(RUN_SQL + """, q AS (SELECT run_id, lead(head, 1, 7) OVER (ORDER BY run_id) AS c FROM rn)
SELECT q.run_id, q.c, CAST(coalesce(sum(rn.len), 0) AS BIGINT) AS head_rank, count(rn.run_id) AS run_head_rank FROM q LEFT JOIN rn ON rn.head = q.c AND rn.run_id < q.run_id GROUP BY q.run_id, q.c""")
def letter_ranks(spark, sf):
    """Before each run: places and runs of the letter of the run after it, or of a letter that does not occur."""
    table_of = distributed.stored(suffix.runs(transform(spark, sf)))
    after = table_of.select((F.col("run_id") - 1).alias("run_id"), F.col("head").alias("c"))
    asked = table_of.select("run_id").join(after, "run_id", "left").select("run_id", F.coalesce("c", F.lit(7)).alias("c"))
    return suffix.letter_ranks(table_of, asked)


@query(ORACLES["thresholds"].replace("SELECT run_id, CAST(coalesce(t, 0) AS BIGINT) AS threshold FROM rn LEFT JOIN mn USING (run_id)", "SELECT CAST(min(t - lo) AS BIGINT) AS least, CAST(max(t - lo) AS BIGINT) AS most, round(log2(max(t - lo) + 1), 6) AS log2_most FROM gp JOIN mn USING (run_id)"))
def threshold_offsets(spark, sf):
    c = chars(spark, sf)
    sa = suffix.suffix_array(c)
    table_of = distributed.stored(suffix.runs(suffix.bwt(c, sa)))
    return suffix.threshold_offsets(table_of, suffix.thresholds(table_of, suffix.lcp(c, sa)))


THRESHOLD_SQL = ORACLES["thresholds"].removesuffix("SELECT run_id, CAST(coalesce(t, 0) AS BIGINT) AS threshold FROM rn LEFT JOIN mn USING (run_id)") + """,
th AS (SELECT run_id, head AS c, start, stop, CAST(coalesce(t, 0) AS BIGINT) AS thr, row_number() OVER (PARTITION BY head ORDER BY run_id) AS k FROM rn LEFT JOIN mn USING (run_id))
"""


def run_table(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Runs of the collection and their thresholds."""
    c = chars(spark, sf)
    sa = suffix.suffix_array(c)
    runs = distributed.stored(suffix.runs(suffix.bwt(c, sa)))
    return runs, suffix.thresholds(runs, suffix.lcp(c, sa))


@query(THRESHOLD_SQL + """, q AS (SELECT DISTINCT lead(c, 1, 7) OVER (ORDER BY run_id) AS c, start AS i FROM th)
SELECT q.c, q.i, count(th.run_id) AS n_before FROM q LEFT JOIN th ON th.c = q.c AND th.k > 1 AND th.thr < q.i GROUP BY q.c, q.i""")
def threshold_ranks(spark, sf):
    """Thresholds before the start of each run, of the letter of the run after it, or of a letter that does not occur."""
    runs, found = run_table(spark, sf)
    after = runs.select((F.col("run_id") - 1).alias("run_id"), F.col("head").alias("c"))
    asked = runs.join(after, "run_id", "left").select(F.coalesce("c", F.lit(7)).alias("c"), F.col("start").alias("i")).distinct()
    return pseudo.threshold_ranks(runs, found, asked)


#: Steps of every letter from every place, then one letter of each turn after the other.
PSEUDO_SQL = THRESHOLD_SQL.replace("WITH x AS", "WITH RECURSIVE x AS", 1) + """, nn AS (SELECT max(stop) AS n FROM th),
sr AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY c ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lead(thr, 1, (SELECT n + 1 FROM nn)) OVER (PARTITION BY c ORDER BY start) AS nthr FROM th),
rd AS (SELECT conv_id, turn, coalesce(text, '') AS s, row_number() OVER (ORDER BY conv_id, turn) - 1 AS k FROM conversations),
ch AS MATERIALIZED (SELECT k, t, ord(substr(s, length(s) - t, 1)) AS c FROM (SELECT k, s, CAST(unnest(range(0, length(s))) AS INTEGER) AS t FROM rd)),
lt AS (SELECT c FROM ch UNION SELECT c FROM th),
fc AS (SELECT lt.c, CAST(coalesce(sum(th.stop - th.start), 0) AS BIGINT) AS f FROM lt LEFT JOIN th ON th.c < lt.c GROUP BY lt.c),
gr AS (SELECT p AS pos, c, f FROM fc, (SELECT unnest(range(0, n + 1)) AS p FROM nn)),
tr AS MATERIALIZED (SELECT pos, gr.c, CAST(CASE WHEN start IS NULL THEN f WHEN pos < stop THEN f + before + pos - start ELSE f + before + stop - start - CASE WHEN pos < nthr THEN 1 ELSE 0 END END AS BIGINT) AS nxt, start IS NOT NULL AND pos < stop AS hit FROM gr ASOF LEFT JOIN sr ON gr.c = sr.c AND gr.pos >= sr.start),
st AS (SELECT k, -1 AS t, (SELECT CAST(n - 1 AS BIGINT) FROM nn) AS pos, 0 AS len FROM rd
  UNION ALL SELECT st.k, ch.t, tr.nxt, CASE WHEN tr.hit THEN len + 1 ELSE 0 END FROM st JOIN ch ON ch.k = st.k AND ch.t = st.t + 1 JOIN tr ON tr.pos = st.pos AND tr.c = ch.c)
SELECT conv_id, turn, count(*) FILTER (t >= 0) AS n, CAST(coalesce(sum(len), 0) AS BIGINT) AS total, CAST(max(len) AS INTEGER) AS longest, sha256('>' || k || chr(10) || coalesce(string_agg(len, ' ' ORDER BY t DESC) FILTER (t >= 0), '')) AS digest FROM st JOIN rd USING (k) GROUP BY conv_id, turn, k"""


@query(PSEUDO_SQL)
def pseudo_lengths(spark, sf):
    """Pseudo-lengths of every turn of a conversation in the items, and their text form under the turn's number in order."""
    turns = distributed.ranked(table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("seq")), ["conv_id", "turn"], "read_id")
    turns = distributed.stored(turns)
    found = pseudo.pseudo_lengths(turns, pseudo.steps(*run_table(spark, sf))).join(turns.select("read_id", "conv_id", "turn"), "read_id")
    n = F.col("lengths")
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    text = sinks.lengths_text(F.col("read_id").cast("string"), n)
    return found.select("conv_id", "turn", F.size(n).cast("long").alias("n"), total.alias("total"), F.coalesce(F.array_max(n), F.lit(0)).alias("longest"), F.sha2(text, 256).alias("digest"))


@query(LCP_SQL.replace("lag(i) OVER (ORDER BY rank) AS j", "lag(i, 2) OVER (ORDER BY rank) AS j") + f"SELECT i, j, CAST(least(n, 40) AS BIGINT) AS lce FROM l{_LCP_STEPS + 1} WHERE j IS NOT NULL")
def common_extensions(spark, sf):
    """What each suffix shares with the one two before it in suffix order, 40 characters at most."""
    c = chars(spark, sf)
    sa = distributed.stored(suffix.suffix_array(c))
    two = sa.join(sa.select((F.col("rank") + 2).alias("rank"), F.col("i").alias("b")), "rank").select(F.col("i").alias("a"), "b")
    return suffix.common_extensions(suffix.prefix_ranks(c, sa.count()), two, 40).select(F.col("a").alias("i"), F.col("b").alias("j"), "lce")


@query(RUN_SQL + "SELECT CAST(sum(len) AS BIGINT) AS n, count(*) AS r, sum(len) / count(*) AS n_over_r, log2(sum(len) / count(*)) AS log2_n_over_r FROM rn")
def run_summary(spark, sf):
    return suffix.summary(suffix.runs(transform(spark, sf)))


# ---- pairs, scores, flags ----


def pairs(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    first = turns.where(F.pmod("turn", F.lit(2)) == 0)
    second = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("n2"))
    return first.join(second, ["conv_id", "turn"])


PAIR_SQL = "WITH p AS (SELECT a.conv_id, a.turn, length(a.text) AS n, length(b.text) AS n2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)\n"


@query(PAIR_SQL + "SELECT conv_id, turn, n, n2 FROM p")
def mate_pairs(spark, sf):
    return pairs(spark, sf)


@query(PAIR_SQL + "SELECT count(*) AS n, round(avg(n + n2), 4) AS mean, round(var_pop(n + n2), 4) AS var_pop, round(var_samp(n + n2), 4) AS var_samp, round(stddev_pop(n + n2), 4) AS sd FROM p")
def insert_stats(spark, sf):
    x = F.col("n") + F.col("n2")
    return pairs(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.var_pop(x), 4).alias("var_pop"), F.round(F.var_samp(x), 4).alias("var_samp"), F.round(F.stddev_pop(x), 4).alias("sd"))


@query(PAIR_SQL + "SELECT count(*) AS n, round(avg(n + n2), 4) AS mean, round(var_pop(n + n2), 4) AS var_pop FROM p")
def moment_merge(spark, sf):
    """Moments of each conversation, merged: counts, means and sums of squared deviations add up with the shift of the means."""
    x = F.col("n") + F.col("n2")
    part = pairs(spark, sf).groupBy("conv_id").agg(F.count("*").alias("c"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("s"))
    whole = part.agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("mean"), F.sum("s").alias("s"), F.sum(F.col("c") * F.col("m") * F.col("m")).alias("q"))
    return whole.select("n", F.round("mean", 4).alias("mean"), F.round((F.col("s") + F.col("q")) / F.col("n") - F.col("mean") * F.col("mean"), 4).alias("var_pop"))


@query("SELECT doc_id, n_chars, CAST(trunc(20 + 8 * ln(n_chars)) AS INTEGER) AS min_score FROM documents WHERE n_chars > 0")
def min_scores(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 0").select("doc_id", "n_chars", S.min_score(F.col("n_chars")).alias("min_score"))


SCORED_SQL = "WITH s AS (SELECT l.doc_id, 100 + l.doc_id % 900 AS len, (2 * (100 + l.doc_id % 900)) - 6 * (l.doc_id % 7) AS score, CASE WHEN l.doc_id % 3 = 0 THEN 0 ELSE (100 + l.doc_id % 900) END AS second, l.doc_id % 4 AS sub_n FROM labels l)\n"


def scored(spark, sf):
    length = 100 + F.pmod("doc_id", F.lit(900))
    return table(spark, sf, "labels").select("doc_id", length.alias("len"), (2 * length - 6 * F.pmod("doc_id", F.lit(7))).alias("score"), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(0)).otherwise(length).alias("second"), F.pmod("doc_id", F.lit(4)).alias("sub_n"))


@query(SCORED_SQL + """, t AS (SELECT *, CASE WHEN second > 0 THEN second ELSE 50 END AS sub, 1.0::DOUBLE - (len * 2 - score) / 6.0::DOUBLE / len AS idn FROM s)
SELECT doc_id, CASE WHEN sub >= score THEN 0 ELSE greatest(0, least(60, CAST(trunc(6.02::DOUBLE * (score - sub) / 2.0::DOUBLE * pow((CASE WHEN len < 50 THEN 1.0 ELSE 3.0::DOUBLE / ln(len) END) * idn * idn, 2) + 0.499::DOUBLE) AS INTEGER)
  - CASE WHEN sub_n > 0 THEN CAST(trunc(4.343::DOUBLE * ln(sub_n + 1) + 0.499::DOUBLE) AS INTEGER) ELSE 0 END)) END AS mapq FROM t""")
def mapq_se(spark, sf):
    return scored(spark, sf).select("doc_id", S.mapq_se(F.col("score"), F.col("second"), F.col("sub_n"), F.col("len")).alias("mapq"))


@query("""SELECT doc_id, (CASE WHEN quality = 0 THEN 4 ELSE 0 END) + (CASE WHEN doc_id % 2 = 1 AND quality = 1 THEN 16 ELSE 0 END)
 + 1 + (CASE WHEN quality = 1 AND toxic = 0 THEN 2 ELSE 0 END) + (CASE WHEN toxic = 1 THEN 8 ELSE 0 END) + (CASE WHEN doc_id % 2 = 0 AND toxic = 0 THEN 32 ELSE 0 END) + (CASE WHEN doc_id % 4 < 2 THEN 64 ELSE 128 END) AS flag FROM labels""")
def sam_flags(spark, sf):
    odd = F.pmod("doc_id", F.lit(2)) == 1
    flag = S.sam_flag(F.lit(True), F.col("quality") == 1, F.col("toxic") == 0, odd, ~odd, F.pmod("doc_id", F.lit(4)) < 2)
    return table(spark, sf, "labels").select("doc_id", flag.alias("flag"))


@query(MEMS_SQL + "SELECT DISTINCT read_id, score FROM (SELECT read_id, qe - qs AS score, dense_rank() OVER (PARTITION BY read_id ORDER BY qe - qs DESC) AS k FROM mem) WHERE k <= 4")
def topk_distinct_scores(spark, sf):
    score = found(spark, sf).select("read_id", (F.col("qe") - F.col("qs")).alias("score"))
    return score.withColumn("k", F.dense_rank().over(W.partitionBy("read_id").orderBy(F.desc("score")))).where("k <= 4").select("read_id", "score").distinct()


@query()
def chains(spark, sf):
    return chaining.chains(found(spark, sf), index(spark, sf))


#: Anchors of each read in order; a row for each step, with score, size and start of the best chains that end with the last ten.
BEST_CHAIN_SQL = "WITH RECURSIVE " + MEMS_SQL.removeprefix("WITH ") + """, ix AS (SELECT item_id AS ref_id, sum(length(text) + 1) OVER (ORDER BY item_id) - length(text) - 1 AS start FROM benchmark),
an AS (SELECT read_id, start + rpos + qe - qs - 1 AS x, qe - 1 AS y, qe - qs AS w FROM occ JOIN ix USING (ref_id)),
nu AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY x, y, w) AS n, avg(w) OVER (PARTITION BY read_id) AS mean FROM an),
ln AS (SELECT b.read_id, b.n, b.n - a.n AS d, b.x - a.x AS dx, b.y - a.y AS dy, b.w, b.mean, abs((b.x - a.x) - (b.y - a.y)) AS g FROM nu a JOIN nu b ON a.read_id = b.read_id AND b.n - a.n BETWEEN 1 AND 10
       WHERE b.x - a.x <= 500 AND b.y - a.y BETWEEN 1 AND 100),
ga AS (SELECT read_id, n, d, CAST(least(dx, dy, w) AS BIGINT) - CASE WHEN g > 0 THEN CAST(floor((trunc(0.01::DOUBLE * g * mean) + floor(log2(g))) / 2) AS BIGINT) ELSE 0 END AS gain FROM ln),
ls AS (SELECT nu.read_id, nu.n, x, y, w, coalesce(list([d, gain] ORDER BY d) FILTER (d IS NOT NULL), []) AS ways FROM nu LEFT JOIN ga ON ga.read_id = nu.read_id AND ga.n = nu.n GROUP BY nu.read_id, nu.n, x, y, w),
st AS (SELECT read_id, n, x, y, w::BIGINT AS f, 1::BIGINT AS size, x AS x0, y AS y0, [[w::BIGINT, 1, x, y]] AS last FROM ls WHERE n = 1
  UNION ALL SELECT read_id, n, x, y, f, size, x0, y0, list_concat([[f, size, x0, y0]], last)[1:10] FROM (
    SELECT read_id, n, x, y, last, CASE WHEN top > w THEN top ELSE w END AS f, CASE WHEN top > w THEN last[back][2] + 1 ELSE 1 END AS size, CASE WHEN top > w THEN last[back][3] ELSE x END AS x0, CASE WHEN top > w THEN last[back][4] ELSE y END AS y0 FROM (
      SELECT *, CASE WHEN len(ways) > 0 THEN ways[list_position(list_transform(ways, lambda v: last[v[1]][1] + v[2]), top)][1] END AS back FROM (
        SELECT ls.read_id, ls.n, ls.x, ls.y, ls.w::BIGINT AS w, ls.ways, st.last, list_max(list_transform(ls.ways, lambda v: st.last[v[1]][1] + v[2])) AS top FROM st JOIN ls ON ls.read_id = st.read_id AND ls.n = st.n + 1)))),
be AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY f DESC, n DESC) AS k FROM st WHERE f > 40)
SELECT read_id, 0 AS chain, f AS score, CAST(size AS INTEGER) AS n_anchors, CAST(x0 AS BIGINT) AS x0, CAST(x AS BIGINT) AS x1, CAST(y0 AS BIGINT) AS y0, CAST(y AS BIGINT) AS y1 FROM be WHERE k = 1"""


@query(BEST_CHAIN_SQL)
def best_chain(spark, sf):
    return chaining.best(chaining.chains(found(spark, sf), index(spark, sf)))


@query()
def secondary_chains(spark, sf):
    """Chains of the matches and their halves, and those that a second recurrence finds beside each anchor's best chain."""
    return chaining.chains(halves(spark, sf), index(spark, sf), chaining.ChainConfig(secondary=True))


# ---- alignment: the items of benchmark are the reads, the documents the collection ----


def item_reads(spark, sf) -> DataFrame:
    return refs(spark, sf).select(F.col("ref_id").alias("read_id"), "seq")


def document_refs(spark, sf) -> DataFrame:
    return reads(spark, sf).select(F.col("read_id").alias("ref_id"), F.concat(F.lit("doc"), F.col("read_id").cast("string")).alias("name"), "seq").where("seq <> ''")


@query()
def align_candidates(spark, sf):
    docs = document_refs(spark, sf)
    return alignment.found(item_reads(spark, sf), docs, collection.seqidx(docs))


@query()
def align_se(spark, sf):
    docs, items = document_refs(spark, sf), item_reads(spark, sf)
    return alignment.single(alignment.found(items, docs, collection.seqidx(docs)), items, docs)


@query()
def extend_longest(spark, sf):
    docs = document_refs(spark, sf)
    return extending.extended(item_reads(spark, sf), docs, collection.seqidx(docs))


@query()
def extend_sam_lines(spark, sf):
    """SAM lines of every item, extended from its longest match."""
    items, docs = item_reads(spark, sf), document_refs(spark, sf)
    rows = extending.sam_rows(extend_longest(spark, sf), items, docs)
    return rows.select(sinks.sam_line(rows).alias("line"))


#: Letters of a read on either side of a place where haplotype and reference differ; letters of an item that a long edit puts in.
AROUND, PUT_IN = 60, 150


def haplotype_reads(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items in their DNA-like view and their haplotypes as a collection, its lift segments, and reads: the letters around each place where
    a haplotype follows its reference again, and those in the middle of each long insertion; every other one is of the other strand. A
    haplotype is a language and one of two; an edit at every fifth place puts the item's first letters in, backwards."""
    items = distributed.stored(refs(spark, sf).select("name", S.dna_view(F.coalesce("seq", F.lit(""))).alias("seq")).where("seq <> ''"))
    edits = calls(spark, sf).select("chrom", "sample", "hap", "pos", F.length("ref").alias("n"), "alt").join(items.select(F.col("name").alias("chrom"), "seq"), "chrom")
    ref = F.substr("seq", F.col("pos").cast("int"), F.col("n"))
    long = F.concat(F.left(ref, F.lit(1)), F.reverse(F.left("seq", F.lit(PUT_IN))))
    alt = F.when(F.pmod("pos", F.lit(5)) == 0, long).otherwise(S.dna_view(F.col("alt")))
    found = distributed.stored(edits.select("chrom", "sample", "hap", "pos", ref.alias("ref"), alt.alias("alt")))
    samples = [r["sample"] for r in found.select("sample").distinct().orderBy("sample").collect()]  # one for each language
    coll = variants.with_haplotypes(items, found, samples, [1, 2])
    segments = distributed.stored(variants.collection_segments(coll, found))
    size = coll.select("ref_id", F.length("seq").cast("long").alias("n"))
    inside = (F.col("op") == "I") & (F.col("src_end") - F.col("src_start") > 2 * AROUND)
    mid = F.floor((F.col("src_start") + F.col("src_end")) / 2)
    at = F.when(inside, mid).when(F.col("op") == "=", F.col("src_start"))
    place = segments.withColumn("at", at).where("at IS NOT NULL").join(size, "ref_id")
    place = place.select("ref_id", F.greatest(F.lit(0), F.col("at") - AROUND).cast("long").alias("lo"), F.least("n", F.col("at") + AROUND).cast("long").alias("hi")).distinct()
    each = distributed.ranked(collection.windows(place, coll), ["ref_id", "lo", "hi"], "read_id")
    return coll, segments, distributed.stored(each.select("read_id", F.when(F.pmod("read_id", F.lit(2)) == 1, S.revcomp(F.col("target"))).otherwise(F.col("target")).alias("seq")))


@query()
def align_haplotypes(spark, sf):
    """SAM rows on the items, with OA on the haplotype and AA of equals, of the reads that haplotypes give."""
    coll, segments, each = haplotype_reads(spark, sf)
    return haplotypes.single(alignment.found(each, coll, collection.seqidx(coll)), each, coll, segments)


# ---- pairs: both halves of an item, on opposite strands, in a DNA-like view of items and documents ----


def item_mates(spark, sf) -> DataFrame:
    """Both halves of every item; every twelfth letter of the second mate of odd items is changed, so it has no seed. Short and empty
    items give short and empty mates."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("pair_id"), S.dna_view(F.coalesce("text", F.lit(""))).alias("seq"))
    half = F.floor(F.length("seq") / 2).cast("int")
    second = F.substr("seq", half + 1)
    changed = F.when(F.pmod("pair_id", F.lit(2)) == 1, F.regexp_replace(second, "(.{11}).", "$1A")).otherwise(second)
    first = items.select("pair_id", F.lit(0).alias("mate"), F.left("seq", half).alias("seq"))
    return first.unionByName(items.select("pair_id", F.lit(1).alias("mate"), S.revcomp(changed).alias("seq")))


@query()
def align_pe(spark, sf):
    docs = document_refs(spark, sf).withColumn("seq", S.dna_view(F.col("seq")))
    mates = item_mates(spark, sf)
    cfg = alignment.AlignConfig(direction=50.0)
    return pairing.sam_rows(alignment.found(pairing.read_ids(mates), docs, collection.seqidx(docs), cfg), mates, docs, scores=cfg)


@query()
def pair_counters(spark, sf):
    return pairing.counters(align_pe(spark, sf))


@query("""WITH s AS (SELECT doc_id, 300 + doc_id % 200 AS score, (doc_id * 7) % 290 AS second, doc_id % 3 AS sub_n FROM labels)
SELECT doc_id, greatest(0, least(60, CAST(trunc(6.02::DOUBLE * (score - second) / 2 + 0.499::DOUBLE) AS INTEGER) - CASE WHEN sub_n > 0 THEN CAST(trunc(4.343::DOUBLE * ln(sub_n + 1) + 0.499::DOUBLE) AS INTEGER) ELSE 0 END)) AS mapq FROM s""")
def mapq_pe(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "labels").select("doc_id", pairing.mapq_pair(300 + i % 200, (i * 7) % 290, i % 3).alias("mapq"))


@query(LOCATED_SQL + """SELECT a.doc_id, CASE WHEN b.pos > a.pos THEN b.pos + b.width - a.pos ELSE b.pos - a.pos - a.width END AS tlen FROM loc a JOIN loc b ON b.doc_id = a.doc_id + 1 AND a.ref_id = b.ref_id""")
def template_lengths(spark, sf):
    a = located(spark, sf).select("doc_id", "pos", "width", "ref_id")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), "ref_id", F.col("pos").alias("pos2"), F.col("width").alias("width2"))
    return a.join(b, ["doc_id", "ref_id"]).select("doc_id", pairing.template_length(F.col("pos"), F.col("width"), F.col("pos2"), F.col("width2")).alias("tlen"))


@query(MEMS_SQL + """, s AS (SELECT read_id, qs, qe, count(*) AS n FROM occ GROUP BY ALL)
SELECT read_id, avg(qe - qs) AS mean, CAST(sum((qe - qs) * n) AS DOUBLE) / sum(n) AS weighted, round(count(*) / sum(length(seq)::DOUBLE / (qe - qs)), 6) AS harmonic, CAST(sum((qe - qs) * n) AS BIGINT) AS total_len FROM s JOIN rd USING (read_id) GROUP BY read_id""")
def mem_averages(spark, sf):
    return matching.averages(found(spark, sf), reads(spark, sf))


@query(ORACLES["lift_segments"].replace("SELECT chrom AS name", ", seg AS (SELECT chrom AS name", 1) + """)
SELECT name, sample, hap, min(dst_start) FILTER (op = '=') AS ref_pos, CAST(sum(src_end - src_start) FILTER (op = '=') AS BIGINT) AS n_m, CAST(coalesce(sum(src_end - src_start) FILTER (op = 'I'), 0) AS BIGINT) AS n_i,
  CAST(max(dst_start + src_end - src_start) FILTER (op = '=') - min(dst_start) FILTER (op = '=') - sum(src_end - src_start) FILTER (op = '=') AS BIGINT) AS n_d FROM seg GROUP BY name, sample, hap""")
def lift_cigar(spark, sf):
    on = ["name", "sample", "hap"]
    whole = haplotype_sequences(spark, sf).where("seq <> ''").select(F.concat_ws("/", *on).alias("key"), *on, F.lit(0).cast("long").alias("pos"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"))
    out = lifting.lift_cigars(whole, lift_segments(spark, sf), on)
    count = lambda op: F.aggregate(F.regexp_extract_all("ref_cigar", F.lit(rf"(\d+){op}"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return out.select(*on, "ref_pos", *(count(op).alias(f"n_{op.lower()}") for op in "MID"))
