"""Variant files and the haplotype sequences they describe.

Rules of ours: a haplotype takes the allele of its column of the genotype; a variant that starts before the end of an earlier one
of the same haplotype is left out; missing, symbolic and reference alleles change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S
from ..operators import collection
from ..operators.distributed import ranked, stored
from . import sequences


def vcf(spark: SparkSession, path) -> DataFrame:
    """(chrom, pos, ref, alts, sample, genotype): one row for each record and sample; pos is 1-based. The header line with the sample
    names is small and joined by file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"))
    names = lines.where(F.col("value").startswith("#CHROM")).select("path", F.slice(F.split("value", "\t"), 10, 1 << 20).alias("names"))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("path", F.split("value", "\t").alias("f"))
    both = rows.join(names, "path").select("names", F.slice("f", 10, F.size("names")).alias("calls"), F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("pos"), F.get("f", F.lit(3)).alias("ref"), F.split(F.get("f", F.lit(4)), ",").alias("alts"))
    each = both.select("chrom", "pos", "ref", "alts", F.explode(F.arrays_zip("names", "calls")).alias("s"))  # a row holds its own sample only
    return each.select("chrom", "pos", "ref", "alts", F.col("s.names").alias("sample"), F.split_part("s.calls", F.lit(":"), F.lit(1)).alias("genotype"))


def alleles(variants: DataFrame, haplotypes: list[int] = [1, 2]) -> DataFrame:  # noqa: B006
    """(chrom, sample, hap, pos, ref, alt) of the alleles that differ from the reference."""
    called = variants.withColumn("hap", F.explode(F.array(*map(F.lit, haplotypes)))).withColumn("a", F.get(F.split("genotype", "[|/]"), F.col("hap") - 1).try_cast("int"))
    return called.where("a > 0").select("chrom", "sample", "hap", "pos", "ref", F.get("alts", F.col("a") - 1).alias("alt")).where(F.col("alt").rlike("^[A-Za-z]+$"))


def applied(found: DataFrame) -> DataFrame:
    """alleles without those that overlap an earlier one of their haplotype."""
    w = W.partitionBy("chrom", "sample", "hap").orderBy("pos", "ref", "alt").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("pos") + F.length("ref")
    return found.withColumn("_end", F.max(end).over(w)).where("_end IS NULL OR pos >= _end").drop("_end")


def haplotypes(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(name, sample, hap, seq) of refs (name, seq) with the alleles of each haplotype that has any. Each allele asks for the stretch of
    the reference between the one before and itself, and the last one for the rest; the pieces are joined in order."""
    key = ["chrom", "sample", "hap"]
    w = W.partitionBy(*key).orderBy("pos")
    end = F.col("pos") + F.length("ref") - 1
    size = refs.select(F.col("name").alias("chrom"), F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("n"))
    stretch = found.select(*key, "pos", F.coalesce(F.lag(end).over(w), F.lit(0)).cast("long").alias("lo"), (F.col("pos") - 1).alias("hi"), "alt").join(size.select("chrom"), "chrom")
    rest = found.groupBy(*key).agg(F.max(end).cast("long").alias("lo")).join(size, "chrom").select(*key, F.lit(1 << 62).alias("pos"), "lo", F.col("n").alias("hi"), F.lit("").alias("alt"))
    asked = stored(stretch.unionByName(rest))
    texts = collection.windows(asked, refs.select(F.col("name").alias("chrom"), "seq"), "chrom")
    piece = F.concat(F.coalesce("target", F.lit("")), "alt")
    joined = asked.join(texts, ["chrom", "lo", "hi"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    return joined.select(F.col("chrom").alias("name"), "sample", "hap", F.array_join("p.piece", "").alias("seq"))


def lift_segments(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(name, sample, hap, src_start, src_end, dst_start, op) that map a haplotype back to its reference, 0-based, ends exclusive:
    '=' runs of equal length, and 'I' for inserted letters, which all map to the place after the insertion's anchor."""
    w = W.partitionBy("chrom", "sample", "hap").orderBy("pos")
    common = F.least(F.length("ref"), F.length("alt"))
    shift = F.coalesce(F.sum(F.length("alt") - F.length("ref")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    v = found.select("chrom", "sample", "hap", (F.col("pos") - 1 + common).alias("r0"), (F.col("pos") - 1 + F.length("ref")).alias("r1"), (F.col("pos") - 1 + common + shift).alias("q0"), (F.col("pos") - 1 + F.length("alt") + shift).alias("q1"), "pos")
    key = ["chrom", "sample", "hap"]
    inserted = v.where("q1 > q0").select(*key, F.col("q0").alias("src_start"), F.col("q1").alias("src_end"), F.col("r0").alias("dst_start"), F.lit("I").alias("op"))
    seq = refs.select(F.col("name").alias("chrom"), F.length("seq").cast("long").alias("n"))
    starts = v.select(*key, "pos", F.col("q1").alias("src"), F.col("r1").alias("dst")).unionByName(v.select(*key).distinct().select(*key, F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst")))
    stops = v.select(*key, "pos", "q0")
    both = starts.join(stops, [*key, "pos"], "left").join(seq, "chrom")
    until = F.coalesce(F.lead("q0").over(W.partitionBy(*key).orderBy("pos")), F.col("src") + F.col("n") - F.col("dst"))
    equal = both.select(*key, F.col("src").alias("src_start"), until.alias("src_end"), F.col("dst").alias("dst_start"), F.lit("=").alias("op")).where("src_end > src_start")
    return equal.unionByName(inserted).withColumnRenamed("chrom", "name")


def sample_names(spark: SparkSession, path) -> list[str]:
    """The samples of the header lines, in order, each once. A header is one line of a file."""
    heads = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.slice(F.split(F.regexp_replace("value", "\r$", ""), "\t"), 10, 1 << 20).alias("n"))
    return list(dict.fromkeys(n for r in heads.distinct().collect() for n in r.n))


def with_haplotypes(refs: DataFrame, found: DataFrame, samples: list[str], haplotypes_of: list[int] = [1]) -> DataFrame:  # noqa: B006
    """(ref_id, name, base, sample, hap, seq): refs (name, seq) as hap 0 of no sample, then each of them as each haplotype has it, called
    name/sample/haplotype, without alleles there too; base is the name in refs. Stored, so that its numbers hold."""
    whole = refs.select(F.lit("").alias("sample"), F.lit(0).alias("hap"), "name", F.col("name").alias("base"), "seq")
    if samples:
        mine = found.where(F.col("sample").isin(samples) & F.col("hap").isin(haplotypes_of))
        changed = haplotypes(refs, mine).withColumnRenamed("seq", "_seq")
        each = refs.withColumn("sample", F.explode(F.array(*map(F.lit, samples)))).withColumn("hap", F.explode(F.array(*map(F.lit, haplotypes_of))))
        both = each.join(changed, ["name", "sample", "hap"], "left")
        whole = whole.unionByName(both.select("sample", "hap", F.concat_ws("/", "name", "sample", "hap").alias("name"), F.col("name").alias("base"), F.coalesce("_seq", "seq").alias("seq")))
    return stored(ranked(whole, ["sample", "hap", "name"], "ref_id").select("ref_id", "name", "base", "sample", "hap", "seq"))


def collection_segments(coll: DataFrame, found: DataFrame) -> DataFrame:
    """(ref_id, target_id, src_start, src_end, dst_start, op): lift segments of every sequence of `with_haplotypes`, to the ref_id of its
    reference; sequences without alleles map onto it as they are. Empty ones have none."""
    refs = coll.where("hap = 0").select("name", "seq")
    named = coll.select("ref_id", "base", "sample", "hap", F.length("seq").cast("long").alias("n"))
    moved = lift_segments(refs, found).withColumnRenamed("name", "base").join(named, ["base", "sample", "hap"])
    same = named.join(found.select(F.col("chrom").alias("base"), "sample", "hap").distinct(), ["base", "sample", "hap"], "left_anti").where("n > 0")
    zero = F.lit(0).cast("long")
    all_ = moved.select("ref_id", "base", "src_start", "src_end", "dst_start", "op").unionByName(same.select("ref_id", "base", zero.alias("src_start"), F.col("n").alias("src_end"), zero.alias("dst_start"), F.lit("=").alias("op")))
    target = coll.where("hap = 0").select("base", F.col("ref_id").alias("target_id"))
    return all_.join(target, "base").select("ref_id", "target_id", "src_start", "src_end", "dst_start", "op")


def built(spark: SparkSession, fasta, vcf_path=None, samples: list[str] | int | None = None, haplotypes_of: list[int] = [1], acgt_only: bool = True) -> DataFrame:  # noqa: B006
    """(ref_id, name, seq): the sequences of FASTA files and, with variant files, each of them as each haplotype of each sample has it,
    called name/sample/haplotype, without variants there too. samples: names, or how many of the header's first; all by default.
    With acgt_only other letters become A. References come first; a FASTQ file or an unknown sample is an error."""
    refs, found, chosen = sequences.fasta(spark, fasta).select("name", "seq"), None, []
    if vcf_path is not None:
        have = sample_names(spark, vcf_path)
        chosen = have if samples is None else have[:samples] if isinstance(samples, int) else list(samples)
        if unknown := [n for n in chosen if n not in have]:
            raise ValueError(f"no such samples: {unknown}")
        if chosen:
            found = applied(alleles(vcf(spark, vcf_path).where(F.col("sample").isin(chosen)), haplotypes_of))
    out = with_haplotypes(refs, found, chosen, haplotypes_of).select("ref_id", "name", "seq")
    return out.withColumn("seq", S.acgt_only(F.col("seq"))) if acgt_only else out
