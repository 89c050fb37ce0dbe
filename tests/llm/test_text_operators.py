"""Operators on texts against brute-force versions, over hand-made rows with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqweave.llm import decontaminate, langid, linededup, packing, pii, secrets, simhash
from tests.oracles import difference

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + [None, "", " ", "\n\n", "é" * 50, "A-b_c 1.2.3.4.5 x@y.z" * 30]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_decontaminate", "op5_secrets", "op8_pii"])
def test_sql_twin(spark, name):
    assert difference(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF) is None


def test_line_dedup_cases(spark):
    texts = ["a\nshared\nb", "shared", None, "", "x\n\nshared\n", "shared\nshared", "once\nonce"]
    docs = frame(spark, texts, {0: "p", 1: "q", 4: "r", 5: None, 6: "p"}).withColumn("n_lines", F.lit("clash"))
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.deduplicated(docs, min_sites=3).collect()}
    assert out == {0: ("a\nb", 3, 1), 1: ("", 1, 1), 2: (None, 0, 0), 3: ("", 1, 0), 4: ("x\n\n", 4, 1), 5: ("", 2, 2), 6: ("once\nonce", 2, 0)}
    assert linededup.deduplicated(docs.limit(0)).count() == 0
    odd = docs.union(docs).withColumns({c: F.lit("clash") for c in ("_k1", "_k2", "_gone", "_all", "_x0", "pos", "h1")})
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed, r._k1, r._all) for r in linededup.deduplicated(odd, min_sites=3).collect())
    assert got == Counter({(i, *x, "clash", "clash"): 2 for i, x in out.items()})


def words(t):
    return re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontaminate(spark):
    texts = ["one two three four five", "x one Two three FOUR y", None, "", "zwei drei", "three four three four", "één twee", "alpha"]
    bench = spark.createDataFrame([(1, "one two three four"), (2, "three, four"), (3, None), (4, "..."), (5, "één"), (6, "two three four five"), (None, "alpha"), (2, "three, four")], "item_id long, text string")
    items = [(1, "one two three four"), (2, "three four"), (5, "één"), (6, "two three four five"), (None, "alpha")]
    for shard in (1 << 20, 12):
        got = {r.doc_id: (r.n_words, list(r.hit_words), list(r["items"])) for r in decontaminate.annotate(frame(spark, texts), bench, window=3, shard_bytes=shard).collect()}
        for i, t in enumerate(texts):
            w, hit, names = words(t), set(), set()
            for item, text in items:
                p = words(text)
                m = min(3, len(p))
                for s in range(len(p) - m + 1):
                    for k in range(len(w) - m + 1):
                        if w[k : k + m] == p[s : s + m]:
                            hit |= set(range(k, k + m))
                            names |= {str(item)} if item else set()
            assert got[i] == (len(w), sorted(hit), sorted(names)), (shard, i)
    twice = frame(spark, texts).union(frame(spark, texts)).withColumns({"items": F.lit("clash"), "_x0": F.lit(1)})
    assert Counter((r.doc_id, tuple(r.hit_words)) for r in decontaminate.annotate(twice, bench, window=3, shard_bytes=12).collect()) == Counter({(i, tuple(x[1])): 2 for i, x in got.items()})
    assert decontaminate.annotate(frame(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.annotate(frame(spark, texts), bench.limit(0)).where("size(hit_words) > 0").isEmpty()


def test_searcher_of_a_large_benchmark_is_built_in_bounded_time_and_space():
    import time

    rng = np.random.default_rng(3)
    vocabulary = np.array(["w%x" % k for k in range(50_000)])
    texts = [" ".join(vocabulary[rng.integers(0, len(vocabulary), 200)]) for _ in range(4000)]
    began = time.time()
    (searcher,) = decontaminate.searchers(texts, 10)
    assert time.time() - began < 20
    held = sum(x.nbytes for x in (searcher.suffix, searcher.starts, searcher.owners, searcher.shift, searcher.words.low, searcher.words.hashes, searcher.words.starts, searcher.words.ends))
    assert held < 10 * sum(map(len, texts)) + (8 << 20)
    raw = np.frombuffer(texts[7].encode(), np.uint8)
    assert [x for x in searcher.find(decontaminate.Words(raw, np.array([0, len(raw)]))) if x[1] == 7] == [(i, 7) for i in range(191)]


def test_simhash(spark):
    texts = corpus(spark) + ["a b c d e f g", "a b c d e f g", "one", "two words"]
    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [slow(t) for t in texts]
    root = list(range(len(texts)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.grouped(frame(spark, texts)).collect()}
    assert got == {i: (fps[i], find(i)) for i in range(len(texts))}
    kept = [r.doc_id for r in simhash.representatives(frame(spark, texts).union(frame(spark, texts[:3]))).collect()]
    assert sorted(kept) == [i for i in range(len(texts)) if find(i) == i]
    odd = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "quite another text of its own"), (1, "alpha beta gamma delta"), (None, "a third one stands here alone"), (5, "a third one stands here alone")], "doc_id long, text string").withColumns({"fp": F.lit("clash"), "_k1": F.lit(0)})
    assert sorted((r.doc_id, r.text[:5]) for r in simhash.representatives(odd).collect()) == [(1, "alpha"), (1, "quite"), (5, "a thi")]
    assert simhash.representatives(odd.limit(0)).count() == 0 and simhash.grouped(odd.limit(0)).count() == 0


def test_simhash_links_complete(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3]))) for _ in range(12)}
    fps = sorted(fps)
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {tuple(sorted((r.a & (2**64 - 1), r.b & (2**64 - 1)))) for r in simhash.links(df).collect()}
    assert got == want


def test_simhash_variants_are_not_broadcast(spark):
    """The planner sees an exploded side as small as the fingerprints; at 0.5 GB of documents it held some 15 million rows."""
    plan = simhash.links(spark.range(100).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_langid_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, *langid.trained(docs)).where(langid.held_out()).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out)
    odd = spark.createDataFrame([(1, None), (2, "123 ..."), (3, ""), (4, "été")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, *langid.trained(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and 0 <= got[4].score <= 1
    assert langid.identify(odd, [], None).where("lang_pred <> 'und'").isEmpty()


def test_langid_gradients():
    rng = np.random.default_rng(1)
    net = langid.ByteGRU(3, hidden=3)
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    x, y = rng.integers(0, 6, (7, 4)), np.array([0, 1, 2, 1])
    x[5:, 1] = langid.PAD
    def loss():
        p = net.positions(x)
        real = x != langid.PAD
        return -sum(np.log(p[t, y[i], i]) for t in range(7) for i in range(4) if real[t, i]) / real.sum()
    g = net.gradients(x, y)
    for k in net.w:
        for at in rng.choice(net.w[k].size, 12):
            at = np.unravel_index(int(at), net.w[k].shape)
            old = net.w[k][at]
            net.w[k][at] = old + 1e-2
            up = loss()
            net.w[k][at] = old - 1e-2
            down = loss()
            net.w[k][at] = old
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3 + 0.02 * abs(g[k][at]), (k, at)


def test_secrets(spark):
    key = "Ab1" * 13 + "x"
    texts = ["Password = 'hunter22xx' token:abcdefgh= api-key=12345678 API_KEY=12345678", f"AKIA{'A1' * 8} ... {key} https://s3.example.com/x", f"{key} https://s3.example.com/x", None, "", "f" * 31 + " " + "0" * 40, f"AKIA{'Z' * 11} AKIA{'Z' * 12}", f"AKIA{'A1' * 8}" + "." * 900 + key, "é secret: aaaaaaaa"]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        slow = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.A) if len(m[2]) >= 8]
        slow += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        slow += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        assert sorted(tuple(x) for x in got[i].base) == sorted(slow)
    assert [x.kind for x in sorted(got[1].linked, key=lambda x: x.start)] == ["key", "endpoint"]
    assert all(not got[i].linked for i in (2, 3, 4, 7))


def test_linked_secrets_against_brute_force(spark):
    rng = random.Random(4)
    bits = [f"AKIA{'Q7' * 8}", "Ab1" * 13 + "x", "a" * 40, "https://s3.example.com/x", "http://h", "secret=abcdefgh1", "f" * 32, "." * 150, " ", "é ", "\n", "token: short"]
    texts = ["".join(rng.choice(bits) + " " for _ in range(rng.randint(1, 14))) for _ in range(300)] + [None, "", f"AKIA{'Q7' * 8} " + "." * 70_000 + " " + "Ab1" * 13 + "x"]
    docs = frame(spark, texts).union(frame(spark, texts[:5])).withColumns({c: F.lit("clash") for c in ("base", "weak", "_k1", "cell")})
    got = defaultdict(list)
    for r in secrets.scan(docs).collect():
        got[r.doc_id].append(r)
    total = 0
    for i, t in enumerate(texts):
        base, weak = secrets.base_spans(t or ""), secrets.weak_spans(t or "")
        near = lambda x, kinds, pool: any(s <= x[2] + secrets.SCOPE and x[1] <= e + secrets.SCOPE for k, s, e in pool if k in kinds)
        keys = [x for x in weak if x[0] == "key" and near(x, ("access",), base)]
        ends = [x for x in weak if x[0] == "endpoint" and near(x, ("access",), base) and near(x, ("key", "assign"), keys + base)]
        total += len(keys) + len(ends)
        assert len(got[i]) == (2 if i < 5 else 1)
        for r in got[i]:
            assert sorted(tuple(x) for x in r.linked) == sorted(keys + ends)
    assert total > 100 and secrets.scan(docs.limit(0)).count() == 0


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_pii(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y+z@mail.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", "+", "é", "日本", " ", " ", "-", "7", "12", "GB82 WEST 1234 5698 7654 32", "\x01", "\x02", "card", "000", "\n", "a@b", "a@b.c@d.e", "5500000000000004"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)] + corpus(spark) + ["1 " * 5000, "a." * 5000, "a@" + "b." * 3000 + "c"]
    texts = [t.replace("\x00", "") if t else t for t in texts]
    out = pii.scan(frame(spark, texts)).select("doc_id", *pii.PATTERNS).collect()
    for r in out:
        got = [(k, x.start, x.end) for k in pii.BASE for x in r[k]]
        assert got == slow_pii(texts[r.doc_id]), (texts[r.doc_id][:200], got)
    iban = pii.scan(frame(spark, ["bank: GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433"])).orderBy("doc_id").collect()
    assert [(x.start, x.end, x.score) for x in iban[0].iban] == [(6, 33, 1.0)] and not iban[1].iban


def test_pii_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    bits = ["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+49 (30) 1234567", "é", " ", " x ", "GB82 WEST 1234 5698 7654 32", "call ", "bank\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(150)] + [None, "", " a@b.cc" * 3000]
    frame(spark, texts).union(frame(spark, texts[:4])).write.parquet(f"{tmp_path}/documents.parquet")
    count = Counter()
    for r in pii.op8(spark, str(tmp_path)).collect():
        count[r.doc_id] += 1
        slow = slow_pii(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in slow) for k in pii.BASE)
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in slow)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        ibans = [f"iban:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![A-Za-z0-9])GB82 WEST 1234 5698 7654 32(?![A-Za-z0-9])", texts[r.doc_id] or "")]
        assert r.spans == ",".join([*shown.split(",")[: len(slow)], *ibans])
    assert count == Counter({i: 2 if i < 4 else 1 for i in range(len(texts))})
    odd = frame(spark, ["x 1.2.3.4"]).withColumns({c: F.lit("clash") for c in ("_text", "_x0", "_x1")})
    assert pii.scan(odd).select("_x0", "_text", F.size("ip")).first() == ("clash", "clash", 1) and pii.scan(odd.limit(0)).count() == 0


def test_iban_before_upper_case_words(spark):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    texts = [f"{n}{after}" for n in numbers for after in ("", " BIC COBADEFFXXX", " Please pay", " OK then", ".", " 12", f" {numbers[0]}")]
    got = pii.scan(frame(spark, ["IBAN " + t for t in texts])).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        number = next(n for n in numbers if t.startswith(n))
        want = [(5, 5 + len(number))] + ([(len(t) + 5 - 22, len(t) + 5)] if t.endswith(f" {numbers[0]}") else [])
        assert [(x.start, x.end) for x in r.iban] == want, t
    other = ["ZZ89370400440532013000 BIC", "DE89370400440532013000X", "DE89370400440532013001 BIC", "AB12 CDEF GHIJ KLMN DE89 3704 0044 0532 0130 00"]
    assert [len(r.iban) for r in pii.scan(frame(spark, other)).orderBy("doc_id").collect()] == [0, 0, 0, 1]


def test_tokenizer_is_the_public_one():
    t = packing.Tokenizer()
    rng = random.Random(9)
    alphabet = "ab Zé日\n\t 's123.,!?​ 😀\r" + "ß"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["<|endoftext|>x", "x" * 25_000, " " * 25_000]
    for x in texts:
        assert t(x) == t.slow.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(spark, capacity):
    texts = corpus(spark) + ["same text"] * 40 + [None, ""]
    docs = frame(spark, texts)
    parts = packing.pack(docs, capacity, keep_ids=True).collect()
    t, by_doc, bins = packing.Tokenizer(), defaultdict(list), defaultdict(list)
    for p in parts:
        by_doc[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids)
    for i, x in enumerate(texts):
        mine = sorted(by_doc[i], key=lambda p: p.piece)
        assert [v for p in mine for v in p.ids] == [*t(x or ""), 2]
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist()
        assert all(p.length == capacity for p in mine[1:])
    for b in bins.values():
        b.sort(key=lambda p: p.offset)
        assert [p.offset for p in b] == np.cumsum([0, *(p.length for p in b)])[:-1].tolist() and sum(p.length for p in b) <= capacity
    left = []  # plain best-fit decreasing, one piece at a time
    for n in sorted((p.length for p in parts), reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    assert len(bins) == len(left)
    assert Counter(capacity - sum(p.length for p in b) for b in bins.values()) == Counter(left)


def test_packing_odd_tables(spark):
    docs = frame(spark, ["a b", "a b", None]).withColumns({c: F.lit("clash") for c in ("length", "rank", "salt", "piece")})
    got = packing.pack(docs.union(docs)).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6 and {r.sequence_id for r in got} == {0}
    assert packing.pack(docs.limit(0)).count() == 0


def test_langid_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, net = langid.trained(docs)
    few = docs.limit(3).withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1)})
    got = Counter((r.doc_id, r.lang_pred, r.score) for r in langid.identify(few.union(few), langs, net).collect())
    assert set(got.values()) == {2} and langid.identify(few.limit(0), langs, net).count() == 0
    assert langid.trained(docs.limit(0)) == ([], None)


def test_langid_sample_is_bounded(spark):
    """Rows that share an id, have none, or are all the same: no more than the bound, and each language is learned."""
    rows = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('text of its own ', id) as text", "'en' as lang")
    rows = rows.union(spark.range(3000).selectExpr("9L", "concat('ein Text ', id)", "'de'")).union(spark.range(3000).selectExpr("7L", "'le texte'", "'fr'"))
    rows = rows.union(spark.createDataFrame([(1, "x", "aa"), (2, None, "en"), (3, "text", None)], "doc_id long, text string, lang string"))
    assert Counter(lang for _, lang in langid.sample(rows, "text", "lang", "doc_id", per_lang=50)) == {"en": 50, "de": 50, "fr": 50, "aa": 1}
    assert {lang for _, lang in langid.sample(rows, "text", "lang", "doc_id", per_lang=50, most=2)} == {"de", "en"}
