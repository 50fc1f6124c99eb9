"""Secret scans (native): fixed patterns, plus sliding-window Shannon entropy over candidate strings.

Three kinds of base pattern (assign, access, hex) are found leftmost and non-overlapping. Candidates of
the entropy scan are maximal runs of base64 characters holding a letter and a digit; by the characters
it uses, a run belongs to the class hex, upper or mixed. A window of ``WINDOW`` characters slides over
it: counts per character change by the one that enters and the one that leaves, and with them the sum
of c log2 c, kept in millionths so that it is exact. A run whose most even window reaches the threshold
of its class becomes a span unless an allow-list pattern or a base span covers it.

Everything is an expression over one row: no shuffle, no Python on the executors. Texts without the
marks of a kind skip its scan.

Defined results: null text counts as empty; offsets are code points, ends exclusive; no span gives an
empty string, whose hash is that of the empty string; repeated rows are scanned alike; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, text_of

KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: kind: (pattern before the value, the value, least length of the value)
KINDS = {
    "assign": (rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    "access": ("", r"AKIA[A-Z0-9]+", 20),
    "hex": ("", r"[0-9a-f]{24,}", 24),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: class: (its characters, least entropy of the best window in bits)
CLASSES = {"hex": ("^[0-9a-fA-F]+$", 3.0), "upper": ("^[A-Z0-9]+$", 3.4), "mixed": ("", 3.7)}
#: Runs that look random but are no secrets: UUIDs, documentation values, plain paths and joined words.
ALLOWED = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example)|^[a-z]+([/_-][a-z]+)*[0-9]{0,4}$|^[0-9]+([-_/][0-9]+)*$"
#: Millionths of c log2 c.
CLOGC = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1))]
#: Characters whose counts share a number; matches that are summed up together.
PACKED = 12
BLOCK = 256
NAMES = [*KINDS, "entropy"]
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, before: str, value: str, body) -> Column:
    """An array of ``body(start, end of match, value)`` for all matches: with the gap before each match
    as a group of its own, sums of lengths give the positions. The end of the text closes the last gap
    (with an empty value, which no caller keeps), so that no tail is searched twice. Matches are summed up in
    blocks, block by block and then within each, as arrays that grow entry by entry are copied every time."""
    pattern = F.lit(rf"([\s\S]*?)(?:({before})({value})|\z)")
    parts = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k)).alias(n) for k, n in ((1, "gap"), (2, "pre"), (3, "val"))])
    none = F.array().cast("array<struct<start:int,end:int,val:string>>")

    def length(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(x["pre"]) + F.length(x["val"])

    def step(a: Column, x: Column) -> Column:
        start, end = a["at"] + F.length(x["gap"]), a["at"] + length(x)
        return F.struct(end.alias("at"), F.concat(a["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["val"].alias("val")))).alias("found"))

    def offsets(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(blocks, zero, lambda a, x: F.struct((a["at"] + F.aggregate(x, F.lit(0), lambda n, y: n + length(y))).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def assembled(blocks: Column) -> Column:
        return let(offsets(blocks), lambda at: F.flatten(F.transform(blocks, lambda x, i: F.aggregate(x, F.struct(F.get(at, i).alias("at"), none.alias("found")), step, lambda a: a["found"]))))

    def cut(p: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.slice(p, k * BLOCK + 1, F.lit(BLOCK))), assembled)

    return body(let(parts, cut))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _best_window(value: Column) -> Column:
    """The least sum of c log2 c (in millionths) over the windows of ``value``; the most even window. Counts
    are kept packed, ``PACKED`` characters of 5 bits to a number, so that a step changes two fields."""
    table = F.array(*map(F.lit, CLOGC))
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    fields = [f"n{k}" for k in range(-(-len(ALPHABET) // PACKED))]
    zero = F.struct(*[F.lit(0).cast("long").alias(f) for f in fields], F.lit(0).alias("sum"), F.lit(10**9).alias("best"))

    def place(code: Column) -> Column:
        return (code % PACKED * 5).cast("int")

    def count(a: Column, code: Column) -> Column:
        held = F.element_at(F.array(*[a[f] for f in fields]), F.floor(code / PACKED).cast("int") + 1)
        return F.call_function("shiftright", held, place(code)).bitwiseAND(F.lit(31)).cast("int")

    def one(code: Column, k: int) -> Column:
        return F.when(F.floor(code / PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("long"), place(code))).otherwise(F.lit(0).cast("long"))

    def slide(code: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            enter, leave = F.get(code, i), F.coalesce(F.get(code, i - WINDOW), F.lit(-1))
            gone, same = leave >= 0, enter == leave
            n_in, n_out = count(a, enter), F.when(gone, count(a, F.greatest(leave, F.lit(0)))).otherwise(1)
            total = F.when(same, a["sum"]).otherwise(a["sum"] + F.get(table, n_in + 1) - F.get(table, n_in) + F.get(table, n_out - 1) - F.get(table, n_out))
            counts = [(a[f] + one(enter, k) - F.when(gone, one(leave, k)).otherwise(F.lit(0).cast("long"))).alias(f) for k, f in enumerate(fields)]
            return F.struct(*counts, total.alias("sum"), F.when(i >= WINDOW - 1, F.least(a["best"], total)).otherwise(a["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), zero, step, lambda a: a["best"])

    return let(codes, slide)


def most_clogc(bits: float) -> int:
    """The sum of c log2 c, in millionths, at which a window has an entropy of ``bits``."""
    return int((math.log2(WINDOW) - bits) * WINDOW * 1e6)


def _random(value: Column) -> Column:
    limit = F.lit(most_clogc(CLASSES["mixed"][1]))
    for chars, bits in (CLASSES["upper"], CLASSES["hex"]):
        limit = F.when(value.rlike(chars), most_clogc(bits)).otherwise(limit)
    candidate = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(ALLOWED)
    return F.when(candidate, _best_window(value) <= limit).otherwise(False)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), kind being the place in ``NAMES``."""
    t, none = F.col("t"), F.array().cast(SPANS)
    gates = {"assign": t.rlike(KEYWORDS), "access": t.contains("AKIA"), "hex": t.rlike("[0-9a-f]{24}")}
    found = [
        F.when(gates[k], _matches(t, before, value, lambda f, n=n, least=least: _spans(F.filter(f, lambda x: F.length(x["val"]) >= least), n))).otherwise(none)
        for n, (k, (before, value, least)) in enumerate(KINDS.items())
    ]
    out = docs.select("doc_id", text_of().alias("t")).select("doc_id", "t", F.array_sort(F.concat(*found)).alias("base"))
    runs = F.when(t.rlike(CANDIDATE) & t.rlike("[0-9]"), _matches(t, "", CANDIDATE, lambda f: F.filter(f, lambda x: _random(x["val"]))))
    out = out.withColumn("runs", F.coalesce(runs, F.array().cast("array<struct<start:int,end:int,val:string>>")))
    fresh = F.filter("runs", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", _spans(fresh, len(KINDS)))).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return secret_spans(docs).select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _found_sql(n: int, before: str, value: str, least: int) -> str:
    before, value = before.replace("'", "''"), value.replace("'", "''")
    pat = rf"([\s\S]*?)(?:({before})({value})|\z)"
    return f"""SELECT rid, {n} AS kind, e - strlen_all AS start, e AS "end", v FROM (
  SELECT rid, v, length(p) + length(v) AS strlen_all, sum(length(g) + length(p) + length(v)) OVER (PARTITION BY rid ORDER BY i) AS e
  FROM (SELECT rid, unnest(regexp_extract_all(t, '{pat}', 1)) AS g, unnest(regexp_extract_all(t, '{pat}', 2)) AS p, unnest(regexp_extract_all(t, '{pat}', 3)) AS v,
               generate_subscripts(regexp_extract_all(t, '{pat}', 3), 1) AS i FROM d))
WHERE length(v) >= {least}"""


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE = {
    "op5_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_found_sql(n, *k) for n, k in enumerate(KINDS.values()))}),
run AS ({_found_sql(3, "", CANDIDATE, 20)}),
cand AS (SELECT *, row_number() OVER () AS c FROM run WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{ALLOWED}')
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = run.rid AND b.start <= run.start AND run."end" <= b."end")),
win AS (SELECT c, v, s, substr(v, CAST(s + o AS BIGINT), 1) AS ch FROM (SELECT c, v, unnest(generate_series(1, length(v) - {WINDOW - 1})) AS s FROM cand), (SELECT unnest(generate_series(0, {WINDOW - 1})) AS o)),
ent AS (SELECT c, v, s, sum(CAST(round(k * log2(k) * 1e6) AS BIGINT)) AS u FROM (SELECT c, v, s, ch, count(*) AS k FROM win GROUP BY ALL) GROUP BY ALL),
hot AS (SELECT c FROM ent GROUP BY c, v HAVING min(u) <= CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN {most_clogc(3.0)} WHEN regexp_matches(v, '^[A-Z0-9]+$') THEN {most_clogc(3.4)} ELSE {most_clogc(3.7)} END),
spans AS (SELECT rid, kind, start, "end" FROM base UNION ALL SELECT rid, kind, start, "end" FROM cand WHERE c IN (SELECT c FROM hot)),
w AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
             string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS b,
             string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, kind) AS s FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN w USING (rid)"""
}
