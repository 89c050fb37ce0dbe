import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from seqweave.llm import suffixdedup as S
from tests.oracles import difference


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])


def made(seed, alphabet):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    return [*texts, "a" * 100, "ab" * 40, texts[0], texts[0], ""]


@pytest.mark.parametrize("length,gram,alphabet", [(20, 6, "abcdefghij"), (20, 4, "abé"), (12, 8, "ab")])
def test_against_brute_force(spark, length, gram, alphabet):
    texts = made(length, alphabet)
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.deduplicated(df, length, gram).collect()}
    assert got == dict(enumerate([*brute([t.encode() for t in texts], length), (0, 0, 0, b"")]))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute([(r.text or "").encode() for r in rows], S.LENGTH), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.deduplicated(docs).collect()} == want
    assert S.deduplicated(docs.limit(0)).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    runs = [[(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"%d" % i) for i in range(rng.randint(0, 20))] for _ in range(7)]
    got = list(S.merged([S.front_coded(list(r)) for r in runs]))
    assert [x for x, _, _ in got] == sorted(x for r in runs for x, _ in r)
    for (a, _, _), (b, _, n) in zip(got, got[1:], strict=False):
        assert n == S.common(a, b)
    assert sorted(p for _, p, _ in got) == sorted(p for r in runs for _, p in r)


def test_hot_grams_are_not_merged_in_one_task(spark, monkeypatch):
    rng = random.Random(9)
    random_text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = [random_text(n) for n in (14, 19, 20, 33)]
    texts = [random_text(rng.randint(0, 30)) + rng.choice(lines) + random_text(rng.randint(0, 30)) for _ in range(200)]
    texts += [random_text(9) + lines[0] + x + lines[0] + x for x in (random_text(3), random_text(8))] + made(3, "abcdefghij")
    sizes = []
    plain = S.sorted_reaches

    def watched(docs, picked, *args):
        sizes.extend(r["count"] for r in picked.groupBy("bucket").count().collect())
        return plain(docs, picked, *args)

    monkeypatch.setattr(S, "sorted_reaches", watched)
    monkeypatch.setattr(S, "BUCKET", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.deduplicated(docs, 20, 6, hot=10).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 20)))
    assert max(sizes) <= 40
    counted = []
    monkeypatch.setattr(S, "counted_reaches", lambda *a, f=S.counted_reaches: counted.append(1) or f(*a))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([lines[3] * 2 + random_text(1) for _ in range(40)] + texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.deduplicated(docs, 20, 6, hot=3).collect()}
    assert got == dict(enumerate(brute([r.text.encode() for r in docs.orderBy("doc_id").collect()], 20))) and counted


def test_query_and_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(entry.queries()["op10_suffix_dedup"](spark, sf), entry.oracle_sql()["op10_suffix_dedup"], sf) is None
    rows = [(1, "x" * 30, 5, "a"), (1, "x" * 30, 6, "b"), (None, "y" * 25, 7, "c"), (2, None, 8, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 int, gram string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.deduplicated(df, 20, 6).collect())
    assert got == [(0, 25, 25), (1, 30, 30), (1, 30, 30), (2, 0, 0)]


def test_anchors_do_not_depend_on_the_chunk():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 3000).astype(np.uint8)
    long = np.concatenate([rng.integers(97, 123, 1 << 17).astype(np.uint8), text])
    one, _ = S.anchors_of(text, np.array([0, len(text)]), 400, 64)
    two, _ = S.anchors_of(long, np.array([0, 1 << 17, len(long)]), 400, 64)
    assert one.tolist() == [x - (1 << 17) for x in two.tolist() if x >= 1 << 17]


@pytest.mark.parametrize("bucket", [S.BUCKET, 50])
def test_no_anchor_meets_itself_at_any_threshold(spark, monkeypatch, bucket):
    """Passages around one common line, by each way for hot grams: the same bytes go, in one bucket and in several."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line = text(90)
    around = [(text(280), text(280)) for _ in range(12)]
    texts = [text(rng.randint(0, 300)) + a + line + b + text(rng.randint(0, 300)) for a, b in around for _ in range(2)]
    texts += [text(500) + line + text(500) for _ in range(40)]
    want = dict(enumerate(brute([t.encode() for t in texts], S.LENGTH)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(S, "BUCKET", bucket)
    for hot in (2, 5):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.deduplicated(docs, hot=hot).collect()}
        assert got == want, hot


def test_planted_passages_go_from_length_on(spark):
    """Passages of over 50 words in two documents each: LENGTH equal bytes go, a byte less or an edit in every LENGTH bytes stays."""
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(n // 6 + 1))[:n]
    edited = text(1200)
    planted = {S.LENGTH: [text(S.LENGTH)] * 2, S.LENGTH - 1: [text(S.LENGTH - 1)] * 2, 1200: [edited, "".join("_" if i % 390 == 195 else x for i, x in enumerate(edited))]}
    assert all(len(p.split()) > 50 for pair in planted.values() for p in pair)
    # the bytes beside a passage differ, so that it is no longer than planted
    texts = [(n, f"{text(300)}{a}{p}{b}{text(300)}") for n, pair in planted.items() for p, a, b in zip(pair, "01", "23", strict=True)] + [(0, text(900)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    gone = lambda *length: {r.doc_id: r.n_removed for r in S.deduplicated(docs, *length).collect()}
    assert gone() == {i: n if n == S.LENGTH else 0 for i, (n, _) in enumerate(texts)}
    assert [gone(S.LENGTH - 1)[i] for i in range(4)] == [S.LENGTH, S.LENGTH, S.LENGTH - 1, S.LENGTH - 1]


@pytest.mark.parametrize("sent", [S.KEYS_SENT, 0])
def test_keys_of_texts_take_no_table_on_the_driver(spark, monkeypatch, sent):
    """A table of a million keys for a broadcast join takes the driver some 200 MB, and several are built at a time."""
    monkeypatch.setattr(S, "KEYS_SENT", sent)
    rows = [(i % 40, i % 40 + (i == 7) * 1000, f"text {i % 40}") for i in range(80)]  # 7 has the first half of 47's key only
    docs = spark.createDataFrame(rows, "_k1 long, _k2 long, text string")
    asked = spark.createDataFrame([(i, i, [i]) for i in range(0, 60, 3)], "_k1 long, _k2 long, at array<int>")
    got = S.once(docs, asked)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i, i, f"text {i}", [i]) for i in range(0, 40, 3)]
    assert S.once(docs, asked.limit(0)).count() == 0
