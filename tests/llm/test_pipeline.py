"""Stages of the pipeline, each against brute force on its own input, and the whole over the given tables."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from seqweave.llm import decontaminate, langid, packing, simhash
from seqweave.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 13}", len(t or "")) for i, t in enumerate(texts)], DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


ODD = [None, "", "   ", "12 34", "alpha beta gamma delta", "alpha beta gamma delta", "x\ny", "é" * 40]


def test_stages_are_those_of_the_task():
    assert [n for n, _ in C.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "pack"]


def test_language(spark):
    docs = table(spark, SF, "documents")
    labelled = docs.unionByName(rows(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10**6))
    kept = {r.doc_id for r in C.language(spark, labelled, SF).collect()}
    langs, net = langid.trained(labelled)
    for r in labelled.collect():
        raw = (r.text or "").encode()
        p = net.pooled(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] if raw else np.zeros(1)
        known = any(map(str.isalpha, r.text or "")) and p.max() >= langid.REJECT
        if abs(p.max() - langid.REJECT) > 1e-4:
            assert (r.doc_id in kept) == known, r.doc_id
    assert C.language(spark, docs.limit(0), SF).count() == 0


def test_line_dedup(spark):
    shared = "All rights reserved."
    texts = [f"own line {i}\n{shared}\nmore {i}" for i in range(30)] + ODD
    docs = rows(spark, texts, _k1=0, n_lines=7)
    got = {r.doc_id: r.text for r in C.line_dedup(spark, docs, SF).collect()}
    assert got == {i: t if t is None else "\n".join(x for x in t.split("\n") if x != shared) for i, t in enumerate(texts)}
    assert C.line_dedup(spark, docs, SF).columns == docs.columns and C.line_dedup(spark, docs.limit(0), SF).count() == 0


def test_near_dedup(spark):
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()] + ODD
    docs = rows(spark, texts, fp=0)
    fps = [simhash.fingerprint(t) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        new = [min(low[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(texts))]
        if new == low:
            break
        low = new
    got = C.near_dedup(spark, docs.union(docs), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(low)) and got.columns == docs.columns
    assert C.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_decontaminate(spark):
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    words = lambda t: re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        m = min(10, len(w))
        windows[m] |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
    docs = table(spark, SF, "documents").unionByName(rows(spark, ODD + [items[0], "x " + items[1].upper()]).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = C.clean_of_benchmarks(spark, docs, SF)
    clean = [r.doc_id for r in docs.collect() for w in [words(r.text)] if not any(tuple(w[i : i + m]) in x for m, x in windows.items() for i in range(len(w) - m + 1))]
    assert sorted(r.doc_id for r in got.collect()) == sorted(clean) and got.columns == docs.columns
    assert C.clean_of_benchmarks(spark, docs.limit(0), SF).count() == 0


def test_pack(spark):
    docs = rows(spark, ODD * 2)
    got = C.pack(spark, docs, SF).collect()
    t = packing.Tokenizer()
    assert Counter(r.doc_id for r in got) == Counter(range(2 * len(ODD)))
    assert {r.doc_id: r.length for r in got} == {i: len(t(x or "")) + 1 for i, x in enumerate(ODD * 2)}
    assert C.pack(spark, docs.limit(0), SF).count() == 0


def test_run_is_the_stages_in_order_and_leaves_little_behind(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = {x for x in os.listdir(folder) if x.startswith("seqweave-")}
    got = Counter(tuple(r)[:5] for r in C.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    left = {x for x in os.listdir(folder) if x.startswith("seqweave-")} - before
    docs = table(spark, SF, "documents")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert got == Counter(tuple(r)[:5] for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert len(left) <= 2  # the documents before the last stage, and its pieces


@pytest.mark.parametrize("sf", [SF])
def test_no_document_is_made_up(spark, sf):
    ids = {r.doc_id for r in table(spark, sf, "documents").collect()}
    assert {r.doc_id for r in C.run(spark, sf).collect()} <= ids


def test_near_dedup_deals_out_exploded_variants(spark, monkeypatch):
    """What near_dedup links is joined by a shuffle, however small the planner takes an exploded side for."""
    plans, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or components(links))
    C.near_dedup(spark, rows(spark, ODD), SF)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastExchange" not in plans[0]
