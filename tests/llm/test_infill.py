"""Fill-in-middle against a version of plain slices and regular expressions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqweave.llm import infill
from tests.oracles import difference

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def slow(doc_id, text):
    t = text or ""
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return len(w), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made():
    rng = random.Random(6)
    bits = ["a", "é", "日本", " ", "\t", "\n", "\x0b\x0c\r", "\x1c", "\xa0", "<", ">", "<S", "P>", "M>", "word", "<P", " x ", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return texts + [None, "", " ", "\n\n", "<P>", "a <M> b", "x" * 100_000, "one two " * 30_000, "same text here", "same text here"]


def test_against_plain_slices(spark):
    texts = made()
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id here at all")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "output", "_x0", "_drawn")})
    rows = infill.restore(infill.transform(docs.union(docs.limit(5)))).collect()
    assert len(rows) == len(texts) + 6 and Counter(r.form for r in rows).keys() == {"plain", "psm", "spm"}
    for r in rows:
        want = slow(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want, r
        assert (r.output_sha256, r.restored, r.restored_sha256) == (sha(want[4]), r.text or "", sha(r.text or ""))
        raw, marks = (r.text or "").encode(), b"<P><S><M>"
        assert b"".join((raw, marks)[x.buffer][x.start : x.start + x.length] for x in r.pieces).decode() == r.output
        assert (r._x0, r._drawn) == ("clash", "clash")
    assert infill.transform(docs.limit(0)).count() == 0


def test_other_sentinels_and_rates(spark):
    docs = spark.createDataFrame([(i, f"w{i} <P> middle of it") for i in range(60)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    rows = infill.restore(infill.transform(docs, rate=100, spm=0, sentinels=marks), marks).collect()
    assert all(r.form == "psm" and r.restored == r.text and r.output.startswith("[pre]") for r in rows)


def test_piece_table_cuts():
    table = infill.PieceTable((memoryview(b"abcdef"), memoryview(b"")), [(0, 0, 6)])
    for at in (4, 2, 2, 0, 6):
        table.cut(at)
        assert table.bytes() == b"abcdef"
    assert sorted(x[2] for x in table.pieces) == [0, 0, 0, 2, 2, 2]
    with pytest.raises(IndexError):
        table.cut(7)
    for order in infill.ORDERS.values():
        assert [order[k] for k in infill.inverse(order)] == [0, 1, 2]


def test_query(spark):
    assert difference(entry.queries()["op12_infill"](spark, SF), entry.oracle_sql()["op12_infill"], SF) is None
