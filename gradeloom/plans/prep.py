"""Queries for corpus preparation, serialization and features (D, S, F, IO)."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import folded_text, keyed
from ..operators import boosting
from ..operators import features as feat
from ..operators import forest, linear, prep, prompts, terms
from .registry import query
from .views import VIEWS, examples, runs, table, u


def _h(seed, key: str) -> str:
    return f"sha256('{seed}:' || {key})"


def _split(spark, d, s):
    return examples(spark, d).where(F.col("source_split") == s)


def _keys(spark, d, s=None):
    """Rows by the key of their text."""
    rows = examples(spark, d) if s is None else _split(spark, d, s)
    return prep.without_texts(rows, "row_id", "label", "source_split")


LABELED = VIEWS + f""", tr AS (SELECT * FROM ex WHERE source_split = 'train'),
kept AS (SELECT * FROM tr WHERE norm NOT IN (SELECT norm FROM ex WHERE source_split = 'test')),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h(42, "row_id")}, row_id) AS rank FROM tr)"""


def _quota_sql(src: str, limit: str) -> str:
    return f"""qc AS (SELECT label, count(*) AS n FROM {src} GROUP BY label), qt AS (SELECT *, {limit} * n / sum(n) OVER () AS t, count(*) OVER () AS c FROM qc),
qs AS (SELECT label, c, row_number() OVER (ORDER BY t - j DESC, label, j) AS r FROM (SELECT *, unnest(generate_series(1, n - 1)) AS j FROM qt)),
q AS (SELECT qc.label, 1 + count(qs.r) AS quota FROM qc LEFT JOIN qs ON qc.label = qs.label AND r <= {limit} - c GROUP BY qc.label)"""


@query("d01_normalized_text", VIEWS + "SELECT row_id, sha256(norm) AS norm_sha256 FROM ex")
def d01(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.sha2(folded_text(F.col("text")), 256).alias("norm_sha256"))


@query("d02_load_rows", r"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN CASE WHEN k IS NULL THEN 'unknown_label' WHEN k >= 3 THEN 'label_out_of_range' END ELSE 'empty_text' END AS reason, CASE WHEN regexp_matches(coalesce(text, ''), '\S') AND k < 3 THEN 'docs:' || doc_id || ':' || substr(sha256(text || '|' || k), 1, 16) END AS row_id
FROM (SELECT *, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS k FROM documents)""")
def d02(spark, d):
    return prep.load_rows(table(spark, d, "documents"), ["de", "en", "es", "fr"], "docs", n_classes=3).select("doc_id", "reason", "row_id")


@query("d03_overlap_kept", LABELED + "SELECT row_id FROM kept")
def d03(spark, d):
    return prep.overlap_filter(_keys(spark, d, "train"), _keys(spark, d, "test")).select("row_id")


@query("d03_overlap_removed", LABELED + "SELECT row_id FROM tr WHERE row_id NOT IN (SELECT row_id FROM kept)")
def d03r(spark, d):
    return prep.overlap_filter(_keys(spark, d, "train"), _keys(spark, d, "test"), removed=True).select("row_id")


@query("d04_stratified_subset", LABELED + f", {_quota_sql('tr', '100')} SELECT row_id, label FROM rk JOIN q USING (label) WHERE rank <= quota")
def d04(spark, d):
    return prep.stratified_subset(_split(spark, d, "train"), 100, 42).select("row_id", "label")


@query("d04_quotas", LABELED + f", {_quota_sql('tr', '100')} SELECT label, quota FROM q")
def d04q(spark, d):
    return prep.quotas(_split(spark, d, "train").groupBy("label").agg(F.count("*").alias("n")), 100)


PREPARED = (
    LABELED
    + f""", lim AS (SELECT greatest(4, (count(*) * 10 + 99) // 100) AS lim FROM kept), {_quota_sql("kept", "(SELECT lim FROM lim)")},
kr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h(42, "row_id")}, row_id) AS rank FROM kept),
val AS (SELECT kr.* FROM kr JOIN q USING (label) WHERE rank <= quota),
prepared AS (SELECT row_id, text, norm, label, CASE WHEN source_split = 'test' THEN 'test' WHEN row_id NOT IN (SELECT row_id FROM kept) THEN NULL WHEN row_id IN (SELECT row_id FROM val) THEN 'validation'
  WHEN norm IN (SELECT norm FROM val) THEN NULL ELSE 'train' END AS split, CASE WHEN source_split = 'train' AND row_id NOT IN (SELECT row_id FROM kept) THEN 'test_overlap'
  WHEN source_split = 'train' AND row_id NOT IN (SELECT row_id FROM val) AND norm IN (SELECT norm FROM val) THEN 'validation_overlap' END AS removal_reason FROM ex)"""
)


def _prepared(spark, d):
    return prep.prepare(examples(spark, d), 4)


def _prepared_keys(spark, d):
    return prep.prepare_keys(examples(spark, d), 4)


@query("d05_prepare", PREPARED + "SELECT row_id, label, split, removal_reason FROM prepared")
def d05(spark, d):
    return _prepared_keys(spark, d).select("row_id", "label", "split", "removal_reason")


@query(
    "d06_violations",
    PREPARED
    + """, k AS (SELECT * FROM prepared WHERE split IS NOT NULL) SELECT 'missing_class' AS rule, CAST(sum(4 - c) AS BIGINT) AS n FROM (SELECT count(DISTINCT label) AS c FROM k GROUP BY split)
UNION ALL SELECT 'duplicate_id', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM k GROUP BY row_id) UNION ALL SELECT 'empty_text', count(*) FROM k WHERE norm = ''
UNION ALL SELECT 'cross_split_text', count(*) FROM (SELECT norm FROM k GROUP BY norm HAVING min(split) <> max(split))""",
)
def d06(spark, d):
    return prep.violations(_prepared_keys(spark, d).where("split is not null"), 4)


@query(
    "d07_split_audit",
    VIEWS
    + """SELECT source_split, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_text_rows, count(*) FILTER (WHERE lo <> hi) AS conflicting_groups, any_value(k) AS n_classes
FROM (SELECT source_split, norm, count(*) AS n, min(label) AS lo, max(label) AS hi FROM ex GROUP BY 1, 2) JOIN (SELECT source_split, count(DISTINCT label) AS k FROM ex GROUP BY 1) USING (source_split) GROUP BY 1""",
)
def d07(spark, d):
    return prep.split_audit(_keys(spark, d))


@query(
    "d08_cap_text",
    PREPARED
    + """, cp AS (SELECT row_id, split, length(text) > 80 AS truncated, trim(substr(norm, 1, 80)) AS norm FROM prepared WHERE split IS NOT NULL),
v AS (SELECT * FROM cp WHERE split = 'validation' AND norm NOT IN (SELECT norm FROM cp WHERE split = 'test'))
SELECT row_id, split, truncated FROM cp WHERE split = 'test' UNION ALL SELECT row_id, split, truncated FROM v
UNION ALL SELECT row_id, split, truncated FROM cp WHERE split = 'train' AND norm NOT IN (SELECT norm FROM cp WHERE split = 'test' UNION SELECT norm FROM v)""",
)
def d08(spark, d):
    # beyond the cap one character more is enough to see that a text was cut
    split = _prepared_keys(spark, d).where("split is not null").select("row_id", "split")
    rows = examples(spark, d).select("row_id", F.substring("text", 1, 81).alias("text"), F.substring("norm", 1, 80).alias("norm"))
    return prep.cap_text(rows.join(split, "row_id"), 80).select("row_id", "split", "truncated")


@query("d09_k_per_class", LABELED + "SELECT row_id, label, rank FROM rk WHERE rank <= 8")
def d09(spark, d):
    return prep.select_examples(_split(spark, d, "train"), 8, 42).select("row_id", "label", "rank")


@query("d10_nestedness", LABELED + "SELECT 1 AS k, 4 AS inside, count(*) AS missing FROM rk WHERE rank <= 1 AND row_id NOT IN (SELECT row_id FROM rk WHERE rank <= 4) UNION ALL SELECT 4, 8, count(*) FROM rk WHERE rank <= 4 AND row_id NOT IN (SELECT row_id FROM rk WHERE rank <= 8)")
def d10(spark, d):
    picks = {k: prep.select_examples(_split(spark, d, "train"), k, 42).select("row_id") for k in (1, 4, 8)}
    rows = [picks[a].join(picks[b], "row_id", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(a).alias("k"), F.lit(b).alias("inside"), "missing") for a, b in ((1, 4), (4, 8))]
    return rows[0].union(rows[1])


FOLDS = (
    VIEWS
    + f""", gl AS (SELECT norm, label, count(*) AS n FROM ex GROUP BY 1, 2), gs AS (SELECT norm, label AS stratum FROM gl QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n DESC, label) = 1),
folds AS (SELECT norm, sha256(norm) AS group_sha256, CAST((row_number() OVER (PARTITION BY stratum ORDER BY {_h(42, "sha256(norm)")}) - 1) % 5 AS INTEGER) AS fold FROM gs)"""
)


@query("d11_group_folds", FOLDS + "SELECT row_id, group_sha256, fold FROM ex JOIN folds USING (norm)")
def d11(spark, d):
    return prep.grouped_folds(_keys(spark, d)).select("row_id", "group_sha256", "fold")


@query(
    "d12_grouped_prepare",
    FOLDS + f""", t AS (SELECT row_id, label, norm FROM ex JOIN folds USING (norm) WHERE fold = 0), tl AS (SELECT count(*) // 2 AS lim FROM t), {_quota_sql("t", "(SELECT lim FROM tl)")},
trk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h(7, "row_id")}, row_id) AS rank FROM t), keep AS (SELECT row_id FROM trk JOIN q USING (label) WHERE rank <= quota)
SELECT row_id, CASE WHEN fold = 0 THEN CASE WHEN row_id IN (SELECT row_id FROM keep) THEN 'test' ELSE 'excluded' END WHEN fold = 1 THEN 'validation' ELSE 'train' END AS split FROM ex JOIN folds USING (norm)""",
)
def d12(spark, d):
    rows = prep.grouped_folds(_keys(spark, d))
    test = rows.where("fold = 0")
    keep = prep.stratified_subset(test, test.count() // 2, 7).select("row_id", F.lit(True).alias("kept"))
    split = F.when(F.col("fold") == 0, F.when(F.col("kept"), "test").otherwise("excluded")).when(F.col("fold") == 1, "validation").otherwise("train")
    return rows.join(keep, "row_id", "left").select("row_id", split.alias("split"))


@query(
    "d13_validation_inventory",
    PREPARED + f""", v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h(13, "row_id")}, row_id) AS r FROM prepared WHERE split = 'validation'),
t AS (SELECT label, count(*) AS train_rows, least(count(*), 2) AS demonstrations FROM prepared WHERE split = 'train' GROUP BY 1)
SELECT label, count(*) FILTER (WHERE r <= 3) AS diagnostic, count(*) FILTER (WHERE r > 3) AS remaining, count(*) FILTER (WHERE row_id IN (SELECT row_id FROM prepared WHERE split = 'train')) AS shared_ids, count(*) FILTER (WHERE norm IN (SELECT norm FROM prepared WHERE split IN ('train', 'test'))) AS shared_texts, train_rows, demonstrations FROM v LEFT JOIN t USING (label) GROUP BY label, train_rows, demonstrations""",
)
def d13(spark, d):
    """Validation rows by use, whether ids or texts are shared with other splits, and what training offers."""
    rows = _prepared_keys(spark, d).where("split is not null")
    v = prep.hash_ranked(rows.where("split = 'validation'"), 13, ["label"])
    ids = rows.where("split = 'train'").select("row_id", F.lit(1).alias("same_id"))
    texts = rows.where("split in ('train', 'test')").select("norm_sha256", F.lit(1).alias("same_text")).distinct()
    train = rows.where("split = 'train'").groupBy("label").agg(F.count("*").alias("train_rows"), F.least(F.count("*"), F.lit(2)).alias("demonstrations"))
    out = v.join(ids, "row_id", "left").join(texts, "norm_sha256", "left").groupBy("label").agg(F.count_if(F.col("rank") <= 3).alias("diagnostic"), F.count_if(F.col("rank") > 3).alias("remaining"), F.count("same_id").alias("shared_ids"), F.count("same_text").alias("shared_texts"))
    return out.join(train, "label", "left")


@query("d14_case_selection", VIEWS + "SELECT row_id FROM ex WHERE source_split = 'test' ORDER BY sha256(to_json(['case', '42', 'docs', CAST(row_id AS VARCHAR)])::VARCHAR), row_id LIMIT 16")
def d14(spark, d):
    key = F.sha2(F.to_json(F.array(F.lit("case"), F.lit("42"), F.lit("docs"), F.col("row_id").cast("string"))), 256)
    return _split(spark, d, "test").orderBy(key, "row_id").limit(16).select("row_id")


NATIVE = f"""WITH tab AS (SELECT c_custkey AS row_id, CASE WHEN {u("'na'", "c_custkey")} % 10 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS acctbal, CAST(c_nationkey AS VARCHAR) AS nation,
  CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label, CASE WHEN {u("'split'", "c_custkey")} % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer)
"""


def _native(spark, d):
    return feat.native_table(table(spark, d, "customer"))


@query("f04_standardize", NATIVE + ", md AS (SELECT coalesce(median(acctbal), 0) AS m FROM tab WHERE split = 'train'), st AS (SELECT avg(coalesce(acctbal, m)) AS mu, stddev_pop(coalesce(acctbal, m)) AS sd FROM tab, md WHERE split = 'train') SELECT row_id, round((coalesce(acctbal, m) - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 8) AS z FROM tab, md, st")
def f04(spark, d):
    rows = _native(spark, d)
    return feat.standardize(rows, rows.where("split = 'train'"), "acctbal").select("row_id", F.round("z", 8).alias("z"))


@query("f05_one_hot", NATIVE + ", lv AS (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS slot FROM (SELECT DISTINCT nation FROM tab WHERE split = 'train')) SELECT row_id, lv.slot FROM tab LEFT JOIN lv USING (nation)")
def f05(spark, d):
    rows = _native(spark, d)
    return feat.one_hot(rows, rows.where("split = 'train'"), "nation").select("row_id", "slot")


@query("f05_missing_level", NATIVE + f", gone AS (SELECT row_id, split, CASE WHEN {u("'gone'", "row_id")} % 10 <> 0 THEN nation END AS nation FROM tab), fl AS (SELECT row_id, split, coalesce(nation, '__missing__') AS nation FROM gone), lv AS (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS slot FROM (SELECT DISTINCT nation FROM fl WHERE split = 'train')) SELECT row_id, lv.slot FROM fl LEFT JOIN lv USING (nation)")
def f05_missing(spark, d):
    """Some rows have no level: they share the slot of the missing one."""
    rows = _native(spark, d).withColumn("nation", F.when(keyed("gone", F.col("row_id")) % 10 != 0, F.col("nation")))
    return feat.one_hot(rows, rows.where("split = 'train'"), "nation").select("row_id", "slot")


@query("f06_provenance", NATIVE + ", md AS (SELECT median(acctbal) AS m FROM tab WHERE split = 'train') SELECT 'acctbal' AS feature, any_value(m) AS median, round(avg(coalesce(acctbal, m)), 6) AS mean, round(stddev_pop(coalesce(acctbal, m)), 6) AS scale, count(DISTINCT nation) AS levels FROM tab, md WHERE split = 'train'")
def f06(spark, d):
    return feat.provenance(_native(spark, d).where("split = 'train'"), "acctbal", "nation")


@query("f07_majority", VIEWS + "SELECT row_id, (SELECT label FROM ex WHERE source_split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS label FROM ex WHERE source_split = 'test'")
def f07(spark, d):
    return feat.majority(_split(spark, d, "train"), _split(spark, d, "test")).select("row_id", "label")


@query("f07_probabilities", VIEWS + "SELECT row_id, c, CASE WHEN c = (SELECT label FROM ex WHERE source_split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM ex, cls WHERE source_split = 'test'")
def f07_probabilities(spark, d):
    return feat.majority(_split(spark, d, "train"), _split(spark, d, "test"), 4).select("row_id", F.posexplode("probabilities").alias("c", "p"))


_TERMS = r"""tok AS (SELECT row_id, source_split, label, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM ex),
tm AS (SELECT row_id, source_split, label, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
tf AS (SELECT row_id, source_split, label, term, count(*) AS tf FROM tm GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM tf WHERE source_split = 'train' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 60000),
nd AS (SELECT count(*) AS n FROM ex WHERE source_split = 'train'), ww AS (SELECT row_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), nd)"""
_GRAMS = r"""wd AS (SELECT row_id, source_split, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0b]+'), lambda x: x <> '')) AS w FROM ex), pw AS (SELECT row_id, source_split, ' ' || w || ' ' AS w, count(*) AS times FROM wd GROUP BY 1, 2, 3),
gn AS (SELECT *, unnest([3, 4, 5]) AS z FROM pw), gg AS (SELECT row_id, source_split, times, unnest(CASE WHEN length(w) <= z THEN [w] ELSE list_transform(generate_series(1, length(w) - z + 1), lambda i: substr(w, i, z)) END) AS term FROM gn WHERE z = 3 OR length(w) >= z),
gf AS (SELECT row_id, source_split, term, sum(times) AS tf FROM gg GROUP BY ALL), gv AS (SELECT term, count(*) AS df FROM gf WHERE source_split = 'train' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 80000),
gd AS (SELECT count(*) AS n FROM ex WHERE source_split = 'train'), gw AS (SELECT row_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM gf JOIN gv USING (term), gd)"""


def _digest_sql(src: str, name: str = "term") -> str:
    """Per row: terms, sum of weights, and a checksum that names each term with its weight in millionths."""
    return f"SELECT row_id, count(*) AS n_terms, round(sum(w), 5) AS total, CAST(sum(CAST(floor(w * 1e6 + 0.25) AS BIGINT) * (('0x' || substr(md5({name}), 1, 4))::BIGINT)) AS BIGINT) AS checksum FROM {src} GROUP BY 1"


def _digest(counts, char: str = "", word: str = ""):
    codes = [int(md5(f"{name}{t}".encode()).hexdigest()[:4], 16) for name, terms in ((char, counts.grams), (word, counts.words)) for t in terms]
    return counts.digests(np.array(codes, np.int64)).withColumn("total", F.round("total", 5))


_UNIT = "SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM"


@query("f01_word_tfidf", VIEWS + f", {_TERMS}, z AS ({_UNIT} ww) {_digest_sql('z')}")
def f01(spark, d):
    return _digest(feat.text_counts(examples(spark, d), chars=0))


@query("f02_char_grams", VIEWS + f", {_GRAMS}, z AS ({_UNIT} gw) {_digest_sql('z')}")
def f02(spark, d):
    return _digest(feat.text_counts(examples(spark, d), words=0))


@query("f03_feature_union", VIEWS + f", {_TERMS}, {_GRAMS}, z AS (SELECT row_id, 'word:' || term AS term, w FROM ({_UNIT} ww) UNION ALL SELECT row_id, 'char:' || term, w FROM ({_UNIT} gw)) {_digest_sql('z')}")
def f03(spark, d):
    return _digest(feat.text_counts(examples(spark, d)), "char:", "word:")


@query("f10_naive_bayes_sums", VIEWS + f", {_TERMS} SELECT label, term, CAST(sum(tf) AS BIGINT) AS n FROM tf JOIN vocab USING (term) WHERE source_split = 'train' GROUP BY 1, 2")
def f10(spark, d):
    terms = feat.word_terms(examples(spark, d).where("source_split = 'train'"))
    vocab = feat.vocabulary(feat.term_counts(terms), 60_000)
    return feat.term_counts(terms, vocab).groupBy("label", "term").agg(F.sum("tf").alias("n"))


@query("f10_naive_bayes", VIEWS + f""", {_TERMS}, vt AS (SELECT tf.* FROM tf JOIN vocab USING (term)), sm AS (SELECT label AS c, term, sum(tf) AS k FROM vt WHERE source_split = 'train' GROUP BY 1, 2),
tc AS (SELECT label AS c, sum(tf) AS total, count(DISTINCT row_id) AS rows, (SELECT count(*) FROM vocab) AS v FROM vt WHERE source_split = 'train' GROUP BY 1),
sco AS (SELECT t.row_id, tc.c, ln(any_value(rows)) + sum(t.tf * ln((coalesce(k, 0) + 1) / (total + v))) AS s FROM vt t CROSS JOIN tc LEFT JOIN sm ON sm.c = tc.c AND sm.term = t.term WHERE t.source_split = 'test' GROUP BY 1, 2)
SELECT row_id, c AS label FROM sco QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(-s, 6), c) = 1""")
def f10p(spark, d):
    return terms.naive_bayes(feat.text_counts(examples(spark, d), chars=0))


@query("f14_argmax", VIEWS + "SELECT run_id, row_id, list_position(p, list_max(p)) - 1 AS best FROM pred WHERE p IS NOT NULL")
def f14(spark, d):
    from ..functions.scalars import argmax
    from .views import predictions

    return predictions(spark, d).where("probabilities is not null").select("run_id", "row_id", argmax(F.col("probabilities")).alias("best"))


def _text(spark, d):
    counts = feat.text_counts(examples(spark, d))
    return counts.where("train"), counts.where("test")


@query("f08_logistic_regression")
def f08(spark, d):
    train, test = _text(spark, d)
    return feat.predict_text(feat.fit_text("logistic", train, 1.0, 4, train.width), test)


@query("f08_optimality", VIEWS + f", {_TERMS}, {_GRAMS} SELECT (SELECT count(*) FROM vocab) + (SELECT count(*) FROM gv) AS features, (SELECT count(*) FROM ex WHERE source_split = 'train') AS n_train, 1.0::DOUBLE AS strength, true AS flat")
def f08_flat(spark, d):
    """Whether the weights fitted with C = 1 meet the condition of the optimum, computed from the rows' features."""
    train, _ = _text(spark, d)
    width = train.width
    model = feat.fit_text("logistic", train, 1.0, 4, width)
    n, flat = train.rows, F.col("steepest") < 1e-4
    return linear.steepest(model, train.blocks(), 1.0).select(F.lit(width).cast("long").alias("features"), F.lit(n).cast("long").alias("n_train"), F.lit(1.0).alias("strength"), flat.alias("flat"))


@query("f09_linear_svm")
def f09(spark, d):
    train, test = _text(spark, d)
    return feat.predict_text(feat.fit_text("svm", train, 1.0, 4, train.width), test)


@query("f11_random_forest")
def f11(spark, d):
    rows = _native(spark, d)
    return forest.forest(rows.where("split = 'train'"), rows.where("split = 'test'"), "acctbal", "nation")


def _numeric(spark, d, numeric=("acctbal",)):
    rows = _native(spark, d)
    return feat.numeric_matrix(rows, rows.where("split = 'train'"), list(numeric), "nation").withColumnRenamed("label", "y")


@query("f12_boosted_trees")
def f12(spark, d):
    return boosting.boosted(_numeric(spark, d), 5, rounds=20)


@query("f12_first_splits", NATIVE + """, tr AS (SELECT label, nation FROM tab WHERE split = 'train'), lv AS (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS f, count(*) AS m FROM tr GROUP BY nation),
kc AS (SELECT label AS k, count(*) AS nk, (SELECT count(*) FROM tr) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tr) AS p FROM tr GROUP BY label),
sm AS (SELECT k, f, n, m, (SELECT count(*) FROM tr WHERE tr.label = k AND tr.nation = lv.nation) AS hit, nk, round(p * 16777216) AS up, round((p - 1) * 16777216) AS un, round(p * (1 - p) * 16777216) AS uh FROM kc, lv),
gh AS (SELECT k, f, ((m - hit) * up + hit * un) / 16777216 AS gr, m * uh / 16777216 AS hr, ((n - nk) * up + nk * un) / 16777216 AS g, n * uh / 16777216 AS h FROM sm WHERE m < n),
gn AS (SELECT k, f, (g - gr) * (g - gr) / (h - hr + 1) + gr * gr / (hr + 1) - g * g / (h + 1) AS gain FROM gh)
SELECT k, f::INTEGER AS f, 0 AS b, round(gain, 4) AS gain FROM gn QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f) = 1""")
def f12_splits(spark, d):
    """The first split of every class's first tree, on the levels of the categorical feature."""
    rows = _numeric(spark, d, ())
    return boosting.first_splits(rows.where("split = 'train'"), 5).withColumn("gain", F.round("gain", 4))


CANDIDATES = [(m, c) for m in ("logistic", "bayes") for c in (0.1, 1.0, 10.0)]


def _tuned(spark, d, candidates=CANDIDATES, per_class=None):
    return feat.tuned(prep.prepared_texts(examples(spark, d), 4), candidates, 4, per_class)


@query("f13_equal_budget", PREPARED + " SELECT 1::BIGINT AS trials, count(*) AS n_test, count(DISTINCT row_id) AS n_ids FROM prepared WHERE split = 'test'")
def f13_budget(spark, d):
    """Four selected rows of every class train one candidate, none is scored on validation rows."""
    predictions, trials = _tuned(spark, d, [("logistic", c) for c in (0.1, 1.0, 10.0)], 4)
    n = trials.where("macro_f1 is null and chosen").count()
    return predictions.agg(F.lit(n).cast("long").alias("trials"), F.count("*").alias("n_test"), F.count_distinct("row_id").alias("n_ids"))


@query("f13_tuned_predictions")
def f13(spark, d):
    return _tuned(spark, d)[0]


@query("f13_trials")
def f13t(spark, d):
    return _tuned(spark, d)[1]


@query("s01_serialize", NATIVE + "SELECT row_id, sha256('Predict the segment.' || chr(10) || 'acctbal=' || coalesce(CASE WHEN acctbal = floor(acctbal) THEN CAST(CAST(acctbal AS BIGINT) AS VARCHAR) ELSE CAST(acctbal AS VARCHAR) END, 'NA') || '; nation=\"' || nation || '\"') AS text_sha256 FROM tab")
def s01(spark, d):
    rows = _native(spark, d)
    text = prompts.serialize([("acctbal", "numeric"), ("nation", "categorical")], "Predict the segment.")
    return rows.select("row_id", F.sha2(text, 256).alias("text_sha256"))


@query("s03_lossless", NATIVE + "SELECT 0 AS mismatches, count(*) AS n_rows FROM tab")
def s03(spark, d):
    return prompts.lossless(_native(spark, d).withColumn("t", prompts.number_text(F.col("acctbal"))), "t", "acctbal")


@query("s03_damaged", NATIVE + f"SELECT count(*) FILTER ({u("'cut'", 'row_id')} % 19 = 0 AND acctbal IS NOT NULL)::INTEGER AS mismatches, count(*) AS n_rows FROM tab")
def s03_damaged(spark, d):
    """Some texts are lost on the way: those of rows that had a number no longer give it."""
    text = F.when(keyed("cut", F.col("row_id")) % 19 == 0, "NA").otherwise(prompts.number_text(F.col("acctbal")))
    return prompts.lossless(_native(spark, d).withColumn("t", text), "t", "acctbal")


@query("s04_parity", NATIVE + "SELECT split, count(*) AS same, 0 AS different FROM tab GROUP BY split")
def s04(spark, d):
    a = _native(spark, d)
    return prompts.parity(a, a.select("split", "row_id", "label", prompts.number_text(F.col("acctbal")).alias("text")))


@query("s04_damaged", NATIVE + f", h AS (SELECT split, {u("'par'", 'row_id')} AS h FROM tab) SELECT split, count(*) FILTER (h % 17 <> 0 AND h % 23 <> 0) AS same, count(*) FILTER (h % 17 = 0 OR h % 23 = 0)::INTEGER AS different FROM h GROUP BY split")
def s04_damaged(spark, d):
    """A written table with other labels in some rows and some rows missing."""
    a, h = _native(spark, d), keyed("par", F.col("row_id"))
    label = F.when(h % 17 == 0, F.col("label") + 1).otherwise(F.col("label"))
    return prompts.parity(a, a.where(h % 23 != 0).select("split", "row_id", label.alias("label"), prompts.number_text(F.col("acctbal")).alias("text")))


INSTRUCTION = "Classify the text by its language."
_DEMO = """dm AS (SELECT string_agg('{"text":' || to_json(norm) || ',"label":' || label || '}', chr(10) ORDER BY label, rank) AS demos FROM rk WHERE rank <= 2),
pm AS (SELECT row_id, '""" + INSTRUCTION + """' || chr(10) || '{"0":"de","1":"en","2":"es","3":"fr"}' || chr(10) || demos || chr(10) || '{"text":' || to_json(norm) || '}' AS prompt FROM ex, dm WHERE source_split = 'test')"""


def _prompts(spark, d):
    demos = prep.select_examples(_split(spark, d, "train"), 2, 42)
    return prompts.build_prompts(_split(spark, d, "test"), demos, ["de", "en", "es", "fr"], INSTRUCTION)


@query("s05_prompts", LABELED + f", {_DEMO} SELECT row_id, sha256(prompt) AS prompt_sha256 FROM pm")
def s05(spark, d):
    return _prompts(spark, d).select("row_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("s06_review_prompts", LABELED + f", {_DEMO} SELECT row_id, CASE WHEN pred >= 0 THEN sha256(prompt || chr(10) || 'Proposed class: ' || pred) END AS prompt_sha256, CASE WHEN pred < 0 THEN 'source_proposal_failed' END AS error FROM pred JOIN pm USING (row_id) WHERE run_id = 'base'")
def s06(spark, d):
    from .views import predictions

    return prompts.review_prompts(predictions(spark, d).where("run_id = 'base'"), _prompts(spark, d)).select("row_id", F.sha2("prompt", 256).alias("prompt_sha256"), "error")


_DONOR = f"cs AS (SELECT row_id, pred, row_number() OVER (ORDER BY {_h('donor', 'row_id')}, row_id) AS r, count(*) OVER () AS n FROM pred WHERE run_id = 'base' AND pred >= 0), dn AS (SELECT a.row_id, b.row_id AS donor_row_id, a.pred, b.pred AS donor_pred FROM cs a JOIN cs b ON b.r = a.r % a.n + 1)"


@query("s08_donors", VIEWS + f", {_DONOR} SELECT row_id, donor_row_id, pred = donor_pred AS unchanged FROM dn")
def s08(spark, d):
    from .views import predictions

    return prompts.donors(predictions(spark, d).where("run_id = 'base' and pred >= 0")).select("row_id", "donor_row_id", (F.col("pred") == F.col("donor_pred")).alias("unchanged"))


_PLAN = f"""{_DONOR}, arm AS (SELECT unnest(['actual', 'no_proposal', 'shuffled']) AS arm),
rq AS (SELECT row_id, arm, CASE arm WHEN 'actual' THEN pred WHEN 'shuffled' THEN donor_pred END AS proposal, 0 AS is_repeat FROM dn, arm),
rp AS (SELECT row_id, 'actual' AS arm, pred AS proposal, 1 AS is_repeat FROM dn ORDER BY {_h('repeat', 'row_id')}, row_id LIMIT 16), al AS (SELECT * FROM rq UNION ALL SELECT * FROM rp)"""


@query("s07_control_prompts", LABELED + f", {_DEMO}, {_PLAN}, cp AS (SELECT row_id, prompt || chr(10) || 'Proposed class: ' || coalesce(CAST(proposal AS VARCHAR), 'none') || chr(10) || 'Answer with the class number.' AS full_prompt, proposal FROM rq JOIN pm USING (row_id)) SELECT row_id, count(*) AS arms, count(DISTINCT coalesce(proposal, -1)) AS proposals, 1 AS prefixes, 1 AS suffixes, count(DISTINCT full_prompt) AS prompts, min(sha256(full_prompt)) AS least_sha256 FROM cp GROUP BY row_id")
def s07(spark, d):
    from .views import predictions

    plan = prompts.control_plan(predictions(spark, d).where("run_id = 'base' and pred >= 0"), 0)
    rows = prompts.control_prompts(plan, _prompts(spark, d))
    distinct = lambda c: F.count_distinct(F.sha2(c, 256))
    return rows.groupBy("row_id").agg(F.count("*").alias("arms"), F.count_distinct(F.coalesce("proposal", F.lit(-1))).alias("proposals"), distinct("before").cast("int").alias("prefixes"), distinct("behind").cast("int").alias("suffixes"), distinct("prompt").alias("prompts"), F.min(F.sha2("prompt", 256)).alias("least_sha256"))


@query("s09_plan", VIEWS + f", {_PLAN} SELECT row_id, arm, proposal, is_repeat, row_number() OVER (ORDER BY {_h('run', 'row_id || chr(58) || arm || chr(58) || is_repeat')}) - 1 AS execution_index FROM al")
def s09(spark, d):
    from .views import predictions

    return prompts.control_plan(predictions(spark, d).where("run_id = 'base' and pred >= 0"), 16)


@query("s10_matrix", "SELECT m AS model, s AS shots, z AS seed, (SELECT count(*) FROM documents) AS requests FROM (SELECT unnest(['m1', 'm2', 'm3']) AS m), (SELECT unnest([0, 1, 4, 8]) AS s), (SELECT unnest([13, 42, 87]) AS z) WHERE s > 0 OR z = 42")
def s10(spark, d):
    return prompts.matrix(spark, ["m1", "m2", "m3"], [0, 1, 4, 8], [13, 42, 87]).crossJoin(table(spark, d, "documents").agg(F.count("*").alias("requests")))


@query("s11_digests", LABELED + f", {_DEMO} SELECT row_id, sha256(text) AS text_sha256, CASE WHEN source_split = 'test' THEN sha256(prompt) END AS prompt_sha256 FROM ex LEFT JOIN pm USING (row_id)")
def s11(spark, d):
    digests = _prompts(spark, d).select("row_id", F.sha2("prompt", 256).alias("prompt_sha256"))
    return examples(spark, d).select("row_id", F.sha2("text", 256).alias("text_sha256")).join(digests, "row_id", "left")


@query("io01_pruned_scan", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def io01(spark, d):
    return table(spark, d, "documents").select("text", "lang").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
