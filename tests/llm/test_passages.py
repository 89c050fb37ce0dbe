import os
import random

from pyspark.sql import functions as F

from seqweave.llm import passages as P
from seqweave.llm.common import stored_paths


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_common_words():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert P.common_words(a, b) == lcs(a, b)


def test_chains_against_all_predecessors():
    rng = random.Random(2)
    for _ in range(100):
        found = sorted([c, c + 30, r, r + 30, 1, 0] for c, r in {(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(rng.randint(1, 25))})
        got = P.chains(found, gap=10**9)
        assert sorted(b for c in got for b in c) == sorted(found)
        for chain in got:
            assert all(x[0] < y[0] and x[2] < y[2] for x, y in zip(chain, chain[1:], strict=False))
        best = [0.0] * len(found)
        for i, b in enumerate(found):
            best[i] = 30 + max([0.0, *(best[j] + P.GAP_COST * (a[1] + a[3] - b[0] - b[2]) for j, a in enumerate(found) if a[0] < b[0] and a[2] < b[2])])
        def value(chain):
            return 30 * len(chain) - sum(P.GAP_COST * (y[0] + y[2] - x[1] - x[3]) for x, y in zip(chain, chain[1:], strict=False))
        assert abs(max(map(value, got)) - max(best)) < 1e-6


def test_planted_passages(spark):
    rng = random.Random(3)
    passage = words(rng, 60)
    edited = passage[:20] + ["changed"] + passage[21:40] + passage[41:]
    lone = words(rng, 51)
    docs = [words(rng, 200) + passage + words(rng, 100), words(rng, 50) + edited + words(rng, 70), lone, words(rng, 30) + lone, words(rng, 300), passage[:30] + words(rng, 40), passage]
    texts = [" ".join(d) for d in docs] + [None, "", "...", "".join(c.upper() if c < "{" else c for c in " ".join(docs[4]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.find(df).collect()}
    assert {i for i, r in got.items() if r.passages} == {1, 3, 6, 10}
    for i, first, want in ((1, 0, edited), (3, 2, lone), (6, 0, passage), (10, 4, docs[4])):
        (p,) = got[i].passages
        assert p.rdoc == first and p.identity >= 0.9
        assert len(set(texts[i][p.c0 : p.c1].lower().split()) & set(want)) >= len(set(want)) - 4
        assert texts[i][p.c0 : p.c1].split()[0].lower() in want
    assert got[7].n_chars == 0 and P.find(df.limit(0)).count() == 0


def test_all_copies_are_caught(spark):
    rng = random.Random(4)
    text = " ".join(words(rng, 120))
    rows = [(i, text if i % 2 else " ".join(words(rng, 80)) + " " + text) for i in range(40)]
    got = P.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(passages) > 0").count()
    assert got == 39


def test_repeated_rows_give_the_same_passages(spark):
    rng = random.Random(5)
    lone = " ".join(words(rng, 60))
    rows = [(1, lone), (2, "x y " + lone), (2, "x y " + lone), (3, " ".join(words(rng, 80)))]
    got = [(r.doc_id, tuple(r.passages)) for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(i for i, _ in got) == [1, 2, 2, 3]
    assert len({p for i, p in got if i == 2}) == 1 and all(bool(p) == (i == 2) for i, p in got)


def test_passages_with_many_edits_are_found(spark):
    rng = random.Random(6)
    rows, planted = [], {}
    for rate in (0.05, 0.10, 0.15):
        for n in range(51, 101):
            passage = words(rng, n)
            edited = [w if rng.random() >= rate else f"changed{rng.randrange(10**6)}" for w in passage]
            if lcs(passage, edited) < 0.82 * n:
                continue
            k = len(rows)
            rows += [(k, " ".join(words(rng, 60) + passage + words(rng, 60))), (k + 1, " ".join(words(rng, 60) + edited + words(rng, 60)))]
            planted.setdefault(rate, []).append(k)
    got = {r.doc_id: {p.rdoc for p in r.passages} for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {rate: sum(k in got[k + 1] for k in ks) / len(ks) for rate, ks in planted.items()}
    assert recall[0.05] >= 0.98 and recall[0.10] >= 0.95 and recall[0.15] >= 0.9, recall


def test_copies_meet_when_earlier_documents_have_all_their_phrases(spark):
    rng = random.Random(7)
    passage = words(rng, 56)
    texts = [passage[i : i + 5] for i in range(52)]  # a text of one gram has it as its seed
    texts += [words(rng, 40) + passage + words(rng, 40), words(rng, 70) + passage + words(rng, 20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for hot in (P.HOT, 1):
        got = {r.doc_id: {p.rdoc for p in r.passages} for r in P.find(df, hot=hot).collect()}
        assert {i: x for i, x in got.items() if x} == {53: {52}}


def test_both_ways_of_joining_seeds_give_the_same_matches(spark):
    rng = random.Random(8)
    pool = [words(rng, rng.randint(10, 60)) for _ in range(6)]
    texts = [" ".join(x for _ in range(rng.randint(1, 4)) for x in (rng.choice(pool) if rng.random() < 0.6 else words(rng, 20))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for needed in (P.NEEDED, 0):
        plain = sorted(map(tuple, P.matched(df, hot=10**6, needed=needed).collect()))
        for hot in (1, 3):
            assert plain == sorted(map(tuple, P.matched(df, hot=hot, needed=needed).collect()))
        assert plain == sorted(map(tuple, P.matched(df, hot=1, needed=needed, sent=0).collect())) and len(plain) > 100


def test_documents_of_each_seed_are_counted(spark):
    rng = random.Random(13)
    lines = [" ".join(words(rng, 5)) for _ in range(4)]  # a text of one gram has it as its seed
    rows = [(10 * k + i, line) for k, line in enumerate(lines) for i in range(k + 1)]
    found = P.seeds(spark.createDataFrame(rows, "id long, text string"), P.WORDS, P.WINDOW)
    assert [P.frequent(found, hot).count() for hot in range(6)] == [4, 3, 2, 1, 0, 0]


def test_groups_stay_whole_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(14)
    for _ in range(50):
        h = np.sort(np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 40))]))
        table, batches = pa.table({"h": h, "x": np.arange(len(h))}), []
        while table.num_rows:
            n = rng.randint(0, 5)
            batches += table.slice(0, n).combine_chunks().to_batches() or [pa.record_batch({"h": h[:0], "x": h[:0]})]
            table = table.slice(n)
        got = [g for g, _ in P.whole_groups(batches, ["h", "x"])]
        assert np.concatenate(got).tolist() == h.tolist()
        assert all(len(g) for g in got) and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))


def test_with_none_needed_every_match_goes_on(spark):
    rng = random.Random(15)
    line = words(rng, 5)
    df = spark.createDataFrame([(i, " ".join(words(rng, 9) + line + words(rng, 9))) for i in range(8)], "id long, text string")
    options = {"window": 1}
    assert P.matched(df, **options).count() == 0
    assert sorted((r.id, r.rid) for r in P.matched(df, **options, needed=0).collect()) == [(i, 0) for i in range(1, 8)]


def test_seeds_and_matches_do_not_stay_on_disk(spark, monkeypatch):
    rng = random.Random(16)
    pool = [words(rng, 60) for _ in range(4)]
    texts = [" ".join(x for _ in range(3) for x in (rng.choice(pool), words(rng, 20)) for x in x) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    left, discard = [], getattr(P, "discard", None)

    def record(session, paths):
        discard(session, paths)
        left.extend(len([x for x in os.listdir(os.path.dirname(p)) if x.startswith("part=")]) for p in paths if "/part=" in p)

    monkeypatch.setattr(P, "discard", record, raising=False)
    with stored_paths() as paths:
        got = P.found_passages(df, hot=1)
    assert got.count() > 30
    still = [c for p in paths if os.path.exists(p) for c in spark.read.parquet(p).columns]
    assert still and not {"h", "before", "at"} & set(still)
    assert left == list(range(P.PARTS, 0, -1))  # the part of matches within documents goes last


def test_many_asked_texts_give_the_same_passages(spark, monkeypatch):
    rng = random.Random(18)
    pool = [words(rng, 60) for _ in range(4)]
    texts = [" ".join(x for _ in range(3) for x in (rng.choice(pool), words(rng, 20)) for x in x) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    few = sorted(map(tuple, P.found_passages(df).collect()))
    monkeypatch.setattr(P, "IDS_SENT", 0)
    assert few == sorted(map(tuple, P.found_passages(df).collect())) and few


def test_places_of_words_from_either_end():
    rng = random.Random(17)
    for _ in range(200):
        text = "".join(rng.choice("ab é.,-") for _ in range(rng.randint(0, 40)))
        ends = [m.end() for m in P._WORD.finditer(text)]
        assert [P._reach(text, n, len(ends)) for n in range(len(ends) + 1)] == [0, *ends]


def test_repeats_within_a_document_and_holders(spark):
    rng = random.Random(9)
    passage, line = words(rng, 60), words(rng, 12)
    texts = [words(rng, 30) + passage + words(rng, 90) + passage + words(rng, 20), passage, line * 40]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.find(df).collect()}
    first, second = len(" ".join(texts[0][:30])) + 1, len(" ".join(texts[0][:180])) + 1
    n = len(" ".join(passage))
    (own,) = got[0].passages
    assert (own.rdoc, own.r0, own.c0, own.c1 - own.c0) == (0, first, second, n)
    assert {p.rdoc for p in got[1].passages} == {0} and not got[1].held
    assert [(h.c0, h.c1, h.n) for h in got[0].held] == [(first, first + n, 2)]
    assert sum(p.c1 - p.c0 for p in got[2].passages) > 0.9 * len(" ".join(texts[2]))


def test_extension_goes_on_past_the_margin(spark):
    rng = random.Random(10)
    passage = words(rng, 900)
    changed = [w if k % 7 else f"x{k}" for k, w in enumerate(passage)]
    changed[440:452] = passage[440:452]
    df = spark.createDataFrame([(0, " ".join(words(rng, 20) + passage)), (1, " ".join(changed + words(rng, 20)))], "doc_id long, text string")
    for margin in (60, P.MARGIN):
        (r,) = P.find(df, margin=margin).where("doc_id = 1").collect()
        n = len(" ".join(changed))
        assert any(p.c0 < 60 and p.c1 > n - 60 for p in r.passages), (margin, [(p.c0, p.c1) for p in r.passages], n)


def test_coverage_of_edited_passages_of_a_pool(spark):
    """Documents of passages from a pool, each edited by itself, and words of their own: what is found against what was put there."""
    rng = random.Random(11)
    pool, texts, truth = [words(rng, rng.randint(50, 120)) for _ in range(25)], [], []
    last: dict[int, list[list[str]]] = {}
    for _ in range(120):
        text, marks = words(rng, rng.randint(5, 60)), []
        marks = [None] * len(text)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(pool))
            part = [x for w in pool[k] for x in ([w] if rng.random() > 0.08 else rng.choice([[], ["neu" + w], [w, "ein" + w]]))]
            known = any(lcs(part, old) >= 0.84 * max(len(part), len(old)) for old in last.get(k, []))
            last.setdefault(k, []).append(part)
            fill = words(rng, rng.randint(5, 60))
            text, marks = text + part + fill, marks + [known] * len(part) + [None] * len(fill)
        texts.append(text)
        truth.append(marks)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.passages for r in P.find(df).collect()}
    found = wanted = wrong = alone = 0
    for i, (text, marks) in enumerate(zip(texts, truth, strict=True)):
        at = 0
        for w, mark in zip(text, marks, strict=True):
            hit = any(p.c0 <= at < p.c1 for p in got[i])
            wanted, found = wanted + (mark is True), found + (mark is True and hit)
            alone, wrong = alone + (mark is None), wrong + (mark is None and hit)
            at += len(w) + 1
    assert found >= 0.9 * wanted and wrong <= 0.01 * alone, (found, wanted, wrong, alone)


def test_odd_rows(spark):
    rng = random.Random(12)
    a, b = (" ".join(words(rng, 60)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "y"), (None, a, "z"), (None, None, "z"), (2, "", "z"), (3, b + " " + a, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("_k1", F.lit("clash")).withColumn("rid", F.lit(0))
    got = P.find(df).collect()
    assert len(got) == len(rows)
    assert sum(bool(r.passages or r.held) for r in got) == 4
    long = " ".join(words(rng, 40_000))
    got = {r.doc_id: r for r in P.find(spark.createDataFrame([(1, long), (2, "a b c " + long)], "doc_id long, text string")).collect()}
    assert max(p.c1 - p.c0 for p in got[2].passages) == len(long)
