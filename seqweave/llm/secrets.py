"""Secret scans (operator 5): multipart credential linking.

One Arrow pass proposes spans. `assign`, `access` and `hex` are reported as they stand. Two weak kinds say little by
themselves: `key`, a run of 40 letters, digits, + and / with upper case, lower case and digits (the form of a secret that
belongs to an access identifier), and `endpoint`, a URL. They are reported only where complementary parts co-occur: an
interval join within the document keeps a key with an access identifier at most `scope` characters away, and an endpoint
that has an access identifier and a key or assignment at most `scope` characters away.

Positions are code points, ends exclusive. Edge cases: null text is empty and has no spans; repeated rows give repeated results; spans of
one start come by kind as listed; an empty table gives no rows; texts of any length are read whole; further columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import row_key, stored, table

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no match of their own
KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", re.A)
BASE = ("assign", "access", "hex")
SCOPE = 400


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("key", m.start(), m.end()) for m in KEY.finditer(text) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    if "http" in text:
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return found


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def proposed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base spans, and weak ones for documents that have an access identifier."""

    def scan(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            base, weak = [], []
            for x in batch.column(at):
                x = x.as_py() or ""
                base.append(spans := base_spans(x))
                weak.append(weak_spans(x) if any(k == "access" for k, _, _ in spans) else [])
            as_rows = lambda found: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in found], SPAN)
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), as_rows(base), as_rows(weak)], names=[*(batch.schema.names[i] for i in keep), "base", "weak"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    return docs.mapInArrow(scan, f"{kept}, base {spans}, weak {spans}")


def near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """left rows with a right row of the same document at most `scope` characters away: an interval join on blocks of 4 x `scope`
    characters. A left row stands in every block that it reaches with `scope` on either side, so close rows share one."""
    longest = 4 * scope
    cells = lambda d: F.explode(F.sequence(F.floor((d["start"] - scope) / longest), F.floor((d["end"] + scope) / longest)))
    a = left.withColumn("cell", cells(left))
    b = right.select("_k1", "_k2", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    b = b.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / longest), F.floor(F.col("e") / longest))))
    close = (F.col("s") <= F.col("end") + scope) & (F.col("start") <= F.col("e") + scope)
    return a.join(b, ["_k1", "_k2", "cell"]).where(close).select("_k1", "_k2", "kind", "start", "end").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base spans, linked spans (weak ones that complementary parts support), all spans by start and kind."""
    scanned = stored(proposed(docs.select("doc_id", *row_key("doc_id", "text"), "text")))
    part = lambda column: scanned.where("size(weak) > 0").select("_k1", "_k2", F.explode(column).alias("x")).select("_k1", "_k2", "x.*").distinct()
    base, weak = part("base"), part("weak")
    access = base.where("kind = 'access'")
    keys = near(weak.where("kind = 'key'"), access, scope)
    ends = near(near(weak.where("kind = 'endpoint'"), access, scope), keys.unionByName(base.where("kind = 'assign'")), scope)
    linked = keys.unionByName(ends).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    out = scanned.join(linked, ["_k1", "_k2"], "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.slice("base", 1, 0)).alias("linked"))


def in_order(spans, kinds: tuple[str, ...]):
    """'kind:start:end' of the spans by start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("s"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"])), ",")


def op5(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(in_order(F.col("base"), BASE), 256).alias("base_sha256"),
        in_order(F.concat("base", "linked"), (*BASE, "key", "endpoint")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def _sql_spans(kind: str, pattern: str, check: str) -> str:
    return f"""
{kind} AS (SELECT doc_id, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(x) AS BIGINT) AS e FROM (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, unnest(p) AS x, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d))) WHERE i % 2 = 1 AND {check})"""


_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_SQL_ASSIGN = f"""({"|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))})["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
_NEAR = "x.doc_id = a.doc_id AND a.s <= x.e + {0} AND x.s <= a.e + {0}".format(SCOPE)
OP5_SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),{_sql_spans("assign", _SQL_ASSIGN, f"length(regexp_extract(x, '{_SQL_ASSIGN}', 2)) >= 8")},{_sql_spans("access", "AKIA[A-Z0-9]+", "length(x) >= 16")},{_sql_spans("hex", "[0-9a-f]{32,}", "true")},
{_sql_spans("key", "[A-Za-z0-9+/]{40,}", "length(x) = 40 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')")},{_sql_spans("endpoint", "https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", "true")},
base AS (SELECT *, 1 AS k FROM assign UNION ALL SELECT *, 2 FROM access UNION ALL SELECT *, 3 FROM hex),
keys AS (SELECT *, 4 AS k FROM key x WHERE EXISTS (SELECT 1 FROM access a WHERE {_NEAR})),
ends AS (SELECT *, 5 AS k FROM endpoint x WHERE EXISTS (SELECT 1 FROM access a WHERE {_NEAR}) AND EXISTS (SELECT 1 FROM (SELECT doc_id, s, e FROM keys UNION ALL SELECT doc_id, s, e FROM assign) a WHERE {_NEAR})),
every AS (SELECT * FROM base UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM ends),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)}, count(*) FILTER (k > 3) AS n_linked,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM documents LEFT JOIN g USING (doc_id)
"""
