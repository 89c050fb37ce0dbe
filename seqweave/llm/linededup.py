"""Line dedup (operator 1): cross-site boilerplate by distinct-site spread. DataFrame functions only.

A line is what stands between newlines. HyperLogLog sketches of the sites of each line (by 128 bits of its hash) are merged by
aggregation. A line whose estimate lies clearly above `min_sites` is boilerplate, one clearly below is not; lines near the
threshold, within `band` standard errors and one site at least, get exact distinct counts. Boilerplate lines are removed
wherever they occur.

Edge cases: null text stays null and has no lines; empty lines are kept; a null site counts as no site; a document of which
nothing stays has the empty text; repeated rows give repeated results; an empty table gives no rows; n_lines and n_removed replace
columns of these names, all others are kept whatever their names; a text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, fresh, row_key, table

#: Sites from which on a line is boilerplate, log2 of the sketch's buckets, and standard errors that count as near.
MIN_SITES, LG_K, BAND = 10, 10, 3


def lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(row key, position, line key, site) of the lines that are not empty."""
    each = docs.select(*row_key("doc_id", text, site), F.col(site).cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return each.where("line <> ''").select("_k1", "_k2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND, text: str = "text", site: str = "source") -> DataFrame:
    """Keys (h1, h2) of the lines on at least min_sites sites."""
    each = lines(docs, text, site).select("h1", "h2", "site")
    spread = cut(each.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("about")).where(F.col("about") >= F.lit(min_sites - max(1.0, band * 1.04 / 2 ** (lg_k / 2) * min_sites))))
    margin = max(1.0, band * 1.04 / 2 ** (lg_k / 2) * min_sites)
    clear = spread.where(F.col("about") > min_sites + margin).select("h1", "h2")
    close = spread.where(F.col("about") <= min_sites + margin).select("h1", "h2")
    exact = each.join(close, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return clear.union(exact.select("h1", "h2"))


def deduplicated(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND, text: str = "text", site: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines and n_removed (which replace columns of that name)."""
    bad = cut(boilerplate(docs, min_sites, lg_k, band, text, site).withColumn("bad", F.lit(True)))
    marked = lines(docs, text, site).select("_k1", "_k2", "pos", "h1", "h2").join(bad, ["h1", "h2"]).select("_k1", "_k2", "pos").distinct()
    k1, k2, lost, whole = fresh(docs, 4)
    removed = marked.groupBy(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).agg(F.array_sort(F.collect_list("pos")).alias(lost))
    gone = F.coalesce(lost, F.array().cast("array<int>"))
    # the removed positions cut the line numbers into stretches that stay
    bounds = F.concat(F.array(F.lit(-1)), F.col(lost), F.array(F.size(whole)))
    stay = F.flatten(F.transform(F.sequence(F.lit(1), F.size(lost) + 1), lambda i: F.slice(whole, F.get(bounds, i - 1) + 2, F.get(bounds, i) - F.get(bounds, i - 1) - 1)))
    out = docs.select("*", *row_key("doc_id", text, site, names=(k1, k2))).join(removed, [k1, k2], "left").withColumn(whole, F.split(text, "\n", -1))
    out = out.withColumns({"n_lines": F.coalesce(F.size(whole).cast("long") * F.col(text).isNotNull().cast("long"), F.lit(0)), "n_removed": F.size(gone).cast("long")})
    kept = F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))
    added = [c for c in ("n_lines", "n_removed")]
    return out.withColumn(text, kept).select(*[c for c in docs.columns if c not in added], *added)


def op1(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"))


OP1_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL), '') AS kept
      FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars
FROM documents d LEFT JOIN k USING (doc_id)
"""
