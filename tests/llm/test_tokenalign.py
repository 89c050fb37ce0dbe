"""Alignment of two tokenizers against scans of every pair of ends and tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from seqweave.llm import tokenalign as A

SF = "/root/testdata/sf0.001"


def byte_decoder():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in printable]
    return {chr(k): k for k in printable} | {chr(256 + n): k for n, k in enumerate(rest)}


def slow(texts):
    """Rows by the two libraries on whole texts, and a scan of all tokens of a group."""
    a_of, b_of = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_of.encode_special_tokens = True
    code, out, held = byte_decoder(), [], Counter()
    piece = lambda x: bytes([int(x[3:5], 16)]) if len(x) == 6 and x.startswith("<0x") and x.endswith(">") else x.replace("▁", " ").encode()
    for t in texts:
        t = t or ""
        ea, b = a_of.encode(" " + t, add_special_tokens=False), b_of.encode(t)
        ta, tb = [bytes(code[c] for c in x) for x in ea.tokens], [piece(b_of.id_to_piece(k)) for k in b]
        if not t or b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            out.append(None)
            continue
        end_a, end_b = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({*end_a} & {*end_b}):
            i2, j2 = end_a.index(cut, i) + 1, end_b.index(cut, j) + 1
            groups.append(",".join(map(str, ea.ids[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            for x in range(i, i2):
                for y in range(j, j2):
                    if max(end_a[x] - len(ta[x]), end_b[y] - len(tb[y])) < min(end_a[x], end_b[y]):
                        links.append((ea.ids[x], b[y]))
            i, j = i2, j2
        held.update(set(links))
        out.append((len(ta), len(tb), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for r in out:
        if r is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield r[0], r[1], len(r[2]), len(r[3]), sum(held[x] == most[x[0]] for x in r[3]), sum(held[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()


def made():
    rng = random.Random(12)
    bits = ["a", "the", " the", "ing", "é", "日本語", "😀", " ", "  ", "\n", "\t", "▁", "<0x41>", "<|endoftext|>", "</s>", "<s>", "'s", "123", "$$$", " ", "　", "ﬁ", "\x00", "́", "ñ", " x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "x" * 30_000, "日" * 3000, "of the", "of the", "a\nb c\n d", "\n"]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast", [A.BROADCAST, 0])
def test_against_scans(spark, broadcast):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("pairs", "row", "part")})
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in A.aligned_documents(docs, broadcast=broadcast).collect()}
    want = dict(enumerate(slow(texts)))
    assert {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {}
    assert len({x[0] for x in want.values()}) > 20 and sum(x[2] < x[0] for x in want.values()) > 20


def test_query_on_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in entry.queries()["op11_tokenalign"](spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in rows], slow([r.text for r in rows]), strict=True))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_links, r.count_sum, r.groups is None) for r in A.aligned_documents(docs).collect())
    assert got == Counter({(1, 2, 6, True): 2, (None, 2, 6, True): 1, (2, 0, 0, True): 1})
    assert A.aligned_documents(docs.limit(0)).count() == 0
    shown = A.aligned_documents(docs, keep_groups=True).where("doc_id = 1").first().groups
    assert [g.count("|") for g in shown.split(";")] == [1, 1]


def test_shared_cuts_of_random_ends():
    rng = np.random.default_rng(4)
    for n, share in ((3, 0.5), (50, 0.9), (400, 0.1), (400, 0.02)):
        for _ in range(40):
            rows = np.cumsum(rng.integers(1, n, 5))
            total = int(rows[-1])
            a, b = (np.union1d(np.flatnonzero(rng.random(total) < share) + 1, rows) for _ in (0, 1))
            assert A.shared_cuts(a, b, rows).tolist() == np.intersect1d(a, b).tolist()
