r"""PII (operator 8): patterns propose, checksums confirm, context adjusts the score. DataFrame functions only.

A pattern's matches are put between marks (U+0001; those of the text are first replaced by U+0002, which no pattern can
match either) and the text is split at the marks, so every second part is a match and lengths give places. Matches that fail
their check are dropped. `iban` spans are added to the base kinds: a country that issues such numbers, its length, and the
mod-97 check. Each span's score starts from its kind and rises if a context word stands within 40 characters before or after
it in the text between matches.

Positions are code points, ends exclusive. Edge cases: null text is empty; repeated rows give repeated results; an empty table
gives no rows; a text of any length is one row, and its parts are walked in stretches of their square root, so that many matches
in one text cost no square; columns named like the kinds are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, table

#: Countries by the length of their account numbers.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_KNOWN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"

# Fixed values. The possessive forms and look-behinds match the same spans as the plain patterns in their comments.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # country, two digits, the rest by the country's length; no letter or digit follows
    "iban": rf"(?<![A-Za-z0-9]){_KNOWN}",
}
NEEDS = {"email": "@", "phone": "+"}  # texts without these have no match
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write to|reach|address",
    "ip": r"\bip\b|host|server|address|client|login",
    "card": "card|visa|credit|debit|payment|pay ",
    "phone": "call|phone|tel|fax|mobile|contact",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
}
NEAR, BOOST = 40, 0.2
BASE = ("email", "ip", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))
    return F.aggregate(F.transform(from_right, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check: the first four characters go to the end, letters count from 10."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    return F.lit(True)


SPAN = "struct<start:int,end:int,score:double>"
NONE = f"array<{SPAN}>"


def split_at_matches(kind: str, text: Column) -> Column:
    """The parts of a text without U+0001, every second one a match; null where the kind cannot occur."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], "\x01$0\x01"), "\x01", -1)
    return F.when(text.contains(NEEDS[kind]), parts) if kind in NEEDS else parts


def spans(kind: str, parts: Column) -> Column:
    """Array of the confirmed (start, end, score) of one kind; parts is a column of split_at_matches."""
    n = F.size(parts)
    step = (2 * F.ceil(F.sqrt(n) / 2)).cast("int")  # even, so that places keep their parity
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda g: g * step)
    total = lambda s: F.aggregate(F.slice(parts, s + 1, step), F.lit(0), lambda a, x: a + F.length(x))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,at:int>>").alias("all"))
    grow = lambda a, s: F.struct((a["at"] + total(s)).alias("at"), F.concat(a["all"], F.array(F.struct(s.alias("s"), a["at"].alias("at")))).alias("all"))
    stretches = F.aggregate(starts, none, grow, lambda a: a["all"])
    before = lambda i: F.coalesce(F.get(parts, i - 1), F.lit(""))
    near = lambda i: F.lower(F.concat(F.substr(before(i), F.greatest(F.lit(1), F.length(before(i)) - NEAR + 1)), F.lit(" "), F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, NEAR))).rlike(CONTEXT[kind])
    score = lambda i: F.when(near(i), F.lit(round(BASE_SCORE[kind] + BOOST, 2))).otherwise(F.lit(BASE_SCORE[kind]))
    span = lambda a, p: F.struct(a["at"].alias("start"), (a["at"] + F.length(p["x"])).alias("end"), score(p["i"]).alias("score"))
    keep = lambda a, p: F.when((p["i"] % 2 == 1) & confirmed(kind, p["x"]), F.concat(a["found"], F.array(span(a, p)))).otherwise(a["found"])
    walk = lambda a, p: F.struct((a["at"] + F.length(p["x"])).alias("at"), keep(a, p).alias("found"))
    numbered = lambda s: F.transform(F.slice(parts, s + 1, step), lambda x, i: F.struct((s + i).alias("i"), x.alias("x")))
    each = lambda b: F.aggregate(numbered(b["s"]), F.struct(b["at"].alias("at"), F.array().cast(NONE).alias("found")), walk, lambda a: a["found"])
    return F.coalesce(F.when(n > 1, F.flatten(F.transform(stretches, each))), F.array().cast(NONE))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one array column of (start, end, score) for each kind; columns with these names are replaced."""
    plain, *names = fresh(docs, 1 + len(PATTERNS))
    parts = dict(zip(PATTERNS, names, strict=True))
    clean = docs.withColumn(plain, F.translate(F.coalesce(text, F.lit("")), "\x01", "\x02"))
    cut = clean.withColumns({parts[k]: split_at_matches(k, F.col(plain)) for k in PATTERNS})
    return cut.withColumns({k: spans(k, F.col(parts[k])) for k in PATTERNS}).drop(plain, *names)


def listed(kinds) -> Column:
    """'kind:start:end' by kind as listed, then start."""

    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scores = F.array_join(F.concat(*(F.transform(F.col(k), lambda s: s["score"].cast("string")) for k in PATTERNS)), ",")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(listed(BASE), 256).alias("base_sha256"), listed(PATTERNS).alias("spans"), scores.alias("scores"))


# ---- the twin: its patterns have no look-around, so U+0003 is put to either side of what ends a word before IBANs are sought ----

_SQL_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:(?:\\x03 \\x03)?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(^|\x03)({_SQL_KNOWN})(\x03|$)",
}
_SQL_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (CASE WHEN ltrim(p, '0') = '' THEN 0 WHEN len(ltrim(p, '0')) > 3 THEN 999 ELSE CAST(ltrim(p, '0') AS INTEGER) END) > 255)) = 0",
    "card": "len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN (len(d) - 1 - i) % 2 = 0 THEN CAST(d[i + 1] AS INTEGER) ELSE (CAST(d[i + 1] AS INTEGER) * 2) % 10 + (CAST(d[i + 1] AS INTEGER) * 2) // 10 END)) % 10 = 0",
    "phone": "len(d) BETWEEN 8 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)), lambda a, c: (CASE WHEN c < 10 THEN a * 10 + c ELSE a * 100 + c END) % 97) = 1",
}


def _sql_of(kind: str) -> str:
    mark = "'\\1' || chr(1) || '\\2' || chr(1) || '\\3'" if kind == "iban" else "chr(1) || '\\0' || chr(1)"
    text = "regexp_replace(t, '([^A-Za-z0-9])', chr(3) || '\\1' || chr(3), 'g')" if kind == "iban" else "t"
    return f"""
{kind}_p AS (SELECT doc_id, unnest(p) AS x, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, list_transform(string_split(regexp_replace({text}, '{_SQL_PATTERNS[kind]}', {mark}, 'g'), chr(1)), lambda x: replace(x, chr(3), '')) AS p FROM d)),
{kind}_w AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS d, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  lower(right(coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), ''), {NEAR}) || ' ' || left(coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY i), ''), {NEAR})) AS around FROM {kind}_p),
{kind}_s AS (SELECT doc_id, {list(PATTERNS).index(kind)} AS k, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(x) AS BIGINT) AS e, CASE WHEN regexp_matches(around, '{CONTEXT[kind]}') THEN {round(BASE_SCORE[kind] + BOOST, 2)}::DOUBLE ELSE {BASE_SCORE[kind]}::DOUBLE END AS score FROM {kind}_w WHERE i % 2 = 1 AND {_SQL_CHECKS[kind]})"""


OP8_SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(3), chr(2) || chr(2)) AS t FROM documents),{",".join(map(_sql_of, PATTERNS))},
s AS ({" UNION ALL ".join(f"SELECT * FROM {k}_s" for k in PATTERNS)}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PATTERNS)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s) AS scores FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents LEFT JOIN g USING (doc_id)
"""
