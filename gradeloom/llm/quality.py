"""Quality rules (native): line-first cleaning.

Each line is tried against navigation, symbol, shouting, boilerplate and punctuation rules; failing
lines are removed, and a document that loses more than ``max_loss`` percent of the characters in its
non-blank lines is rejected. Base counts of the whole text come first: too few words, or too many
words inside repeated 5-word windows, reject a document whatever its lines.

Everything is an expression over one row: no shuffle, no Python on the executors.

Defined results: null text has no words and fails the base rule; a text of blanks likewise; repeated
rows are judged alike; an empty table gives an empty result; further columns are ignored by the report
and kept by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, WORD, let, text_of

NGRAM = 5
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_LOSS_PCT = 50

#: Phrases of page furniture by language, matched in either case where a word begins ('.' stands for an accented letter).
PHRASES = {
    "en": "all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept cookies|enable javascript|subscribe to our|sign up for|"
    "click here|read more|share this|skip to content|powered by|follow us on|back to top|lorem ipsum",
    "de": "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl.rung|cookie-einstellungen|cookies akzeptieren|newsletter abonnieren|hier klicken|weiterlesen|folgen sie uns|nach oben",
    "es": "todos los derechos reservados|t.rminos de uso|pol.tica de (?:privacidad|cookies)|aceptar cookies|suscr.bete|haga clic aqu.|leer m.s|s.guenos en|volver arriba",
    "fr": "tous droits r.serv.s|conditions d.utilisation|politique de confidentialit.|accepter les cookies|abonnez-vous|cliquez ici|lire la suite|suivez-nous|haut de page",
}
BOILERPLATE = f"(?i)(?:^|[^a-z])(?:{'|'.join(PHRASES.values())})"
#: (name, expression over a line l): a line that satisfies one of them fails.
LINE_RULES = {
    "navigation": r"[|>»•][^|>»•]*[|>»•][^|>»•]*[|>»•]",
    "symbols": r"([#*$%&<>]{2,}[^#*$%&<>]*){4}",
    "shouting": r"(!!+[^!]*){4}",
}
#: A line with a phrase of page furniture for every so many of its characters fails.
FURNITURE_CHARS = 200
#: A line of at least so many words must have some punctuation.
PUNCTUATED_FROM = 12
PUNCTUATION = r"[.,;:!?…。、؟]"


def _line_fails(line: Column) -> Column:
    rules = [line.rlike(r) for r in LINE_RULES.values()]
    long_line = F.regexp_count(line, F.lit(WORD)) >= PUNCTUATED_FROM
    out = (~line.rlike(PUNCTUATION) & long_line) | (line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * FURNITURE_CHARS >= F.length(line)))
    for r in rules:
        out = out | r
    return out


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def _repeated(grams: Column) -> Column:
    """Words inside windows found twice or more, from the windows' hashes in order."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(NGRAM), F.coalesce(F.get(at, j + 1) - x, F.lit(NGRAM))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def twins(s: Column) -> Column:
        same = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["g"] == e["g"]) | (F.get(s, j + 1)["g"] == e["g"]), e["i"]))
        return let(F.array_sort(F.filter(same, lambda x: x.isNotNull())), covered)

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(pairs, twins))


def _word_counts(words: Column) -> Column:
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - NGRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(NGRAM)]))
    repeat = F.when(n >= NGRAM, let(grams, _repeated)).otherwise(F.lit(0).cast("long"))
    return F.struct(n.cast("long").alias("n_words"), repeat.alias("n_repeat_words"))


def _word_chars(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text).cast("long")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, base_failed and kept."""
    trimmed = F.btrim("t", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = let(
        _lines(F.col("t")),
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _chars(x).alias("all_chars"),
            _chars(F.filter(x, lambda y: ~_line_fails(y))).alias("kept_chars"),
        ),
    )
    out = docs.select("doc_id", text_of().alias("t")).select("doc_id", let(words, _word_counts).alias("w"), _word_chars(F.col("t")).alias("word_chars"), F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("l"))
    out = out.select("doc_id", "w.*", "word_chars", "n_symbols", "l.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("kept_chars") >= (100 - MAX_LOSS_PCT) * F.col("all_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``clean_text``: the text without its failing lines (null where none is left)."""
    lines = F.filter(F.split(text_of(), "\n"), lambda x: ~_line_fails(x))
    return docs.withColumn("clean_text", F.nullif(F.array_join(lines, "\n"), F.lit("")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FAILS = " OR ".join(f"regexp_matches(x, '{r}')" for r in LINE_RULES.values()) + f" OR (NOT regexp_matches(x, '{PUNCTUATION}') AND len(regexp_extract_all(x, '{WORD}')) >= {PUNCTUATED_FROM}) OR (regexp_matches(x, '{BOILERPLATE}') AND len(regexp_extract_all(x, '{BOILERPLATE}')) * {FURNITURE_CHARS} >= length(x))"
QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS j FROM r WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}')),
l AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines, sum(length(x)) AS all_chars,
             coalesce(sum(length(x)) FILTER (WHERE NOT ({_FAILS})), 0) AS kept_chars FROM ln GROUP BY rid),
b AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             coalesce(all_chars, 0) AS all_chars, coalesce(kept_chars, 0) AS kept_chars
      FROM d LEFT JOIN cov USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * kept_chars >= {100 - MAX_LOSS_PCT} * all_chars AS kept FROM f"""
}
