"""A pipeline over documents: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir). Between stages the documents are written as Parquet to the shared folder and read again.

Edge cases: documents of null text or without a letter have no language and go in the first stage, so the others get none from
it; by themselves, line_dedup keeps null text, near_dedup counts it as empty, decontaminate keeps it, and pack packs it as one
end token. Repeated rows are copies: near_dedup keeps one. Empty tables give no rows. All stages but the last keep further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqweave.llm import decontaminate, langid, linededup, packing, simhash
from seqweave.llm.common import discard, stored, stored_paths, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmarks), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents. What a stage has written goes once its result is stored."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        with stored_paths() as paths:
            docs = stage(spark, docs, sf_dir)
            docs = stored(docs) if k + 1 < len(STAGES) else docs
        if k + 1 < len(STAGES):
            discard(spark, before + paths[:-1])
            before = paths[-1:]
    return docs


#: Language ID, SimHash groups and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
