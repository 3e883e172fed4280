"""The registered queries, each over whole tables, and the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import labels, scores, text
from ..operators import align, decode, noise, report
from ..operators.bayesian import BayesianSegmenter
from ..operators.ngram import CharacterModel
from ..operators.trained import TrainedClassifier
from ..sources import corpus, tei
from . import benchmark

KEYS = ["doc_id", "line"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The corpus of lines in DuckDB.
LINES = r"""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, source, ls, unnest(range(len(ls))) AS i FROM l),
w AS (SELECT doc_id, source, CAST(i AS INTEGER) AS line, list_filter(regexp_split_to_array(ls[i + 1], '\s+'), lambda x: x <> '') AS words FROM p),
v AS (SELECT *, array_to_string(words, ' ') AS text, array_to_string(words, '') AS plain FROM w WHERE len(words) > 0)
"""
BINARY_SQL = "array_to_string(list_transform(words, lambda x: repeat('I', CAST(length(x) - 1 AS BIGINT)) || 'E'), '')"
QUADRI_SQL = "array_to_string(list_transform(words, lambda x: CASE WHEN length(x) = 1 THEN 'S' ELSE 'B' || repeat('I', CAST(length(x) - 2 AS BIGINT)) || 'E' END), '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def verses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_verses(spark, sf_dir)


@query(LINES + "SELECT doc_id, line, text, plain, CAST(len(words) AS INTEGER) AS n_words FROM v")
def verses(spark, sf_dir):
    return verses_of(spark, sf_dir).select(*KEYS, "text", text.without_spaces("text").alias("plain"), F.size("words").alias("n_words"))


@query(LINES + "SELECT source AS book, count(*) AS n_verses, count(DISTINCT doc_id) AS n_chapters, CAST(sum(len(words)) AS BIGINT) AS n_words FROM v GROUP BY source")
def verse_counts(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    return v.groupBy("book").agg(F.count("*").alias("n_verses"), F.countDistinct("doc_id").alias("n_chapters"), F.sum(F.size("words")).alias("n_words"))


def _annotated(spark, sf_dir, scheme):
    a = corpus.annotated_corpus(verses_of(spark, sf_dir), scheme)
    return a.select(*KEYS, "text", F.array_join("labels", "").alias("labels"), "verse_text", "same_length")


def _annotated_sql(expr):
    return LINES + f"SELECT doc_id, line, lower(plain) AS text, {expr} AS labels, text AS verse_text, length(lower(plain)) = length({expr}) AS same_length FROM v"


@query(_annotated_sql(BINARY_SQL))
def annotate_binary(spark, sf_dir):
    return _annotated(spark, sf_dir, "binary")


@query(_annotated_sql(QUADRI_SQL))
def annotate_quadri(spark, sf_dir):
    return _annotated(spark, sf_dir, "quadri")


@query(LINES + f"SELECT doc_id, line, translate({QUADRI_SQL}, 'IEBS', '0123') AS label_ids FROM v")
def label_ids(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    return v.select(*KEYS, F.array_join(labels.ids(labels.quadri("words"), "quadri").cast("array<string>"), "").alias("label_ids"))


@query(
    LINES
    + f""", b AS (SELECT doc_id, line, {BINARY_SQL} AS b FROM v)
SELECT doc_id, line, array_to_string(list_transform(range(128), lambda i: CASE WHEN i = 0 OR i > least(126, length(b)) THEN '-100' WHEN b[i] = 'E' THEN '1' ELSE '0' END), ',') AS token_labels FROM b"""
)
def token_align(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    return v.select(*KEYS, F.array_join(labels.token_labels(labels.ids(labels.binary("words"))).cast("array<string>"), ",").alias("token_labels"))


@query(LINES + "SELECT doc_id, line, text AS rebuilt FROM v")
def reconstruct_roundtrip(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    return v.select(*KEYS, labels.rebuild(text.without_spaces("text"), labels.ids(labels.quadri("words"), "quadri")).alias("rebuilt"))


@query(
    LINES
    + """, c AS (SELECT doc_id, line, list_transform(string_split(plain, ''), lambda x: unicode(x)) AS t FROM v),
s AS (SELECT doc_id, line, t, unnest(range(0, len(t), 64)) AS start FROM c)
SELECT doc_id, line, CAST(start AS INTEGER) AS start, md5(array_to_string(t[start + 1:start + 128], ',') || repeat(',0', CAST(greatest(0, 128 - (len(t) - start)) AS BIGINT))) AS ids FROM s"""
)
def token_windows(spark, sf_dir):
    v = verses_of(spark, sf_dir).select(*KEYS, labels.code_points(text.without_spaces("text")).alias("t"))
    w = v.select(*KEYS, F.explode(labels.windows("t", 128, 64)).alias("w"))
    return w.select(*KEYS, F.col("w.start").alias("start"), F.md5(F.array_join(F.col("w.input_ids").cast("array<string>"), ",")).alias("ids"))


@query(
    LINES
    + """, h AS (SELECT doc_id, line, row_number() OVER (ORDER BY md5(doc_id || '|' || line || '|42')) AS r, count(*) OVER () AS n FROM v)
SELECT doc_id, line, r <= floor(n * 0.8) AS is_train FROM h"""
)
def split_80_20(spark, sf_dir):
    v = verses_of(spark, sf_dir).select(*KEYS)
    return decode.exact_split(v, F.concat_ws("|", "doc_id", "line")).select(*KEYS, "is_train")


@query("SELECT doc_id, translate(text, '''’', '') AS text FROM documents")
def clean_symbols(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.drop_symbols("text").alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\p{C}', '', 'g') AS text FROM documents")
def control_chars(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.drop_control("text").alias("text"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_marks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.fold_latin("text").alias("text"))


@query("SELECT doc_id, regexp_replace(lower(replace(text, '⌀', '')), '[^a-z ]', '', 'g') AS text FROM documents")
def alphabet_filter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.keep_alphabet(text.fold(F.lower("text"), {text.GAP: ""}), text.LATIN_ALPHABET).alias("text"))


@query("SELECT doc_id, replace(translate(text, 'ϲͻϹ', 'σσΣ'), 'ϛ', 'στ') AS text FROM documents")
def fold_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.fold("text", text.greek_fold()).alias("text"))


#: The variant letters that are folded, and what becomes of each; the last three and the gap follow in the SQL.
VARIANTS = "ἀἁἂἃἄἅἆἇἐἑἒἓἔἕἠἡἢἣἤἥἦἧἰἱἲἳἴἵἶἷὀὁὂὃὄὅὐὑὒὓὔὕὖὗὠὡὢὣὤὥὦὧὰὲὴὶὸὺὼᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾰᾱᾲᾳᾴᾶᾷῂῃῄῆῇῐῑῒῖῗῠῡῢῤῥῦῧῲῳῴῶῷάέήίόύώΐΰϲͻϹ"
PLAIN = "ααααααααεεεεεεηηηηηηηηιιιιιιιιοοοοοουυυυυυυυωωωωωωωωαεηιουωααααααααηηηηηηηηωωωωωωωωαααααααηηηηηιιιιιυυυρρυυωωωωωαεηιουωιυσσΣ"
#: Small letters become variant letters, ϛ and gaps, other ones in each fifth of the documents, so that all of the table is met.
GREEK_LETTERS = VARIANTS + "ϛ" + text.GAP
FIFTHS = [(VARIANTS + "ϛ" + text.GAP)[min(26 * k, len(GREEK_LETTERS) - 26) :][:26] for k in range(5)]
AS_GREEK = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', '{letters}')" for k, letters in enumerate(FIFTHS)) + " END"


def _greek(spark, sf_dir):
    fifth, small = F.col("doc_id") % 5, "abcdefghijklmnopqrstuvwxyz"
    made = F.coalesce(*[F.when(fifth == k, F.translate("text", small, letters)) for k, letters in enumerate(FIFTHS)])
    return corpus.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", made.alias("text"))


@query(f"SELECT doc_id, strip_accents({AS_GREEK}) AS text FROM documents")
def greek_strip_marks(spark, sf_dir):
    """Decomposition and removal of marks for every script, over documents in Greek letters."""
    return _greek(spark, sf_dir).select("doc_id", text.remove_diacritics("text").alias("text"))


@query(f"SELECT doc_id, replace(replace(translate({AS_GREEK}, '{VARIANTS}', '{PLAIN}'), 'ϛ', 'στ'), '{text.GAP}', '') AS text FROM documents")
def greek_fold_table(spark, sf_dir):
    """All entries of the fold table, over documents that hold each of them."""
    return _greek(spark, sf_dir).select("doc_id", text.fold("text", text.greek_fold()).alias("text"))


@query(
    r"""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5
  WHEN 0 THEN 'B04K' || l_linenumber || 'V' || l_orderkey WHEN 1 THEN 'Gen.' || l_linenumber || '.0' || l_orderkey
  WHEN 2 THEN 'IncipitK' || l_linenumber || 'V1' WHEN 3 THEN '1Cor.' || l_linenumber || '.' || l_orderkey ELSE 'Subscriptio' END AS ref FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN contains(lower(ref), 'incip') THEN 'Incipit' WHEN contains(lower(ref), 'subscrip') THEN 'Subscriptio'
    WHEN regexp_matches(ref, '^(\d?[A-Za-z]+)\.(\d+)\.(\d+)$') THEN CAST(CAST(regexp_extract(ref, '^(\d?[A-Za-z]+)\.(\d+)\.(\d+)$', 2) AS BIGINT) AS VARCHAR) ELSE string_split(ref, 'K')[2] END AS chapter,
  CASE WHEN contains(lower(ref), 'subscrip') THEN 'Subscriptio'
    WHEN regexp_matches(ref, '^(\d?[A-Za-z]+)\.(\d+)\.(\d+)$') THEN CAST(CAST(regexp_extract(ref, '^(\d?[A-Za-z]+)\.(\d+)\.(\d+)$', 3) AS BIGINT) AS VARCHAR) ELSE string_split(ref, 'V')[2] END AS verse
FROM r"""
)
def ref_parse(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    n, k, kind = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 5
    ref = F.when(kind == 0, F.concat(F.lit("B04K"), n, F.lit("V"), k)).when(kind == 1, F.concat(F.lit("Gen."), n, F.lit(".0"), k)).when(kind == 2, F.concat(F.lit("IncipitK"), n, F.lit("V1"))).when(kind == 3, F.concat(F.lit("1Cor."), n, F.lit("."), k)).otherwise("Subscriptio")
    d = d.withColumn("ref", ref)
    return d.select("l_orderkey", "l_linenumber", text.chapter_of("ref").alias("chapter"), text.verse_of("ref").alias("verse"))


@query("SELECT k.*, url FROM pages JOIN (SELECT CAST(row_number() OVER (ORDER BY o, i) - 1 AS BIGINT) AS pos, p || lpad(CAST(i AS VARCHAR), 4, '0') AS ms_id FROM (SELECT 1 AS o, '2' AS p, unnest(range(1, 326)) AS i UNION ALL SELECT 2, '1', unnest(range(1, 135)) UNION ALL SELECT 3, '3', unnest(range(1, 500)))) k ON pos = page_id")
def manuscript_ids(spark, sf_dir):
    """The catalogue's ids, each with the page that stands at its place."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("pos"), "url")
    return corpus.manuscript_ids(spark).join(pages, "pos")


@query(
    r"""
WITH a AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark),
c AS (SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_test, (SELECT count(*) FROM a JOIN b USING (w)) AS n_common)
SELECT *, round(100.0 * n_common / n_train, 2) AS percent FROM c"""
)
def vocab_overlap(spark, sf_dir):
    return report.vocabulary_overlap(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("SELECT count(DISTINCT split_part('x_' || source || '_' || lang, '_', 2)) AS n_names FROM documents")
def distinct_second_field(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws("_", F.lit("x"), "source", "lang").alias("key"))
    return report.distinct_names(d, "key")


# ---- scores, against segmentation into words of five characters

#: Boundaries as offsets, then counts and ratios in the grouping of the formulas.
SCORED = (
    LINES
    + """, g AS (SELECT doc_id, line, words AS t, list_transform(range(0, length(plain), 5), lambda i: substring(plain, CAST(i + 1 AS BIGINT), 5)) AS p FROM v),
o AS (SELECT *, list_distinct(list_transform(range(1, len(t)), lambda i: CAST(list_sum(list_transform(t[1:i], lambda x: length(x))) AS INTEGER))) AS e,
  list_distinct(list_transform(range(1, len(p)), lambda i: CAST(i * 5 AS INTEGER))) AS q FROM g),
n AS (SELECT *, len(list_intersect(e, q)) AS tp, len(q) - len(list_intersect(e, q)) AS fp, len(e) - len(list_intersect(e, q)) AS fn,
  len(list_intersect(list_distinct(t), list_distinct(p))) AS hit, len(list_filter(range(1, least(len(t), len(p)) + 1), lambda i: t[i] = p[i])) AS same FROM o),
r AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS bp, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS br,
  coalesce(CAST(hit AS DOUBLE) / nullif(len(list_distinct(p)), 0), 0) AS wp, coalesce(CAST(hit AS DOUBLE) / nullif(len(list_distinct(t)), 0), 0) AS wr FROM n),
z AS (SELECT doc_id, line, CASE WHEN len(e) = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / len(e) END AS boundary_accuracy, bp AS boundary_precision, br AS boundary_recall,
  coalesce(2 * (bp * br) / nullif(bp + br, 0), 0) AS boundary_f1, wp AS word_precision, wr AS word_recall, coalesce(2 * (wp * wr) / nullif(wp + wr, 0), 0) AS word_f1,
  CAST(same AS DOUBLE) / len(t) AS sequence_accuracy, CAST(len(t) AS INTEGER) AS expected_words, CAST(len(p) AS INTEGER) AS predicted_words, CAST(hit AS INTEGER) AS correct_words,
  CAST(same AS INTEGER) AS exact_position_matches, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn FROM r)
"""
)


def _fixed(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    return v.withColumn("predicted", decode.fixed_width(text.without_spaces("text")))


@query(SCORED + "SELECT doc_id, line, array_to_string(list_sort(e), ',') AS offsets FROM o")
def boundaries(spark, sf_dir):
    return verses_of(spark, sf_dir).select(*KEYS, F.array_join(scores.boundaries("words").cast("array<string>"), ",").alias("offsets"))


@query(SCORED + "SELECT doc_id, line, CAST(round(boundary_accuracy, 9) AS DOUBLE) AS accuracy, CAST(round(boundary_precision, 9) AS DOUBLE) AS precision, CAST(round(boundary_recall, 9) AS DOUBLE) AS recall, CAST(round(boundary_f1, 9) AS DOUBLE) AS f1, tp AS boundary_true_positives, fp AS boundary_false_positives, fn AS boundary_false_negatives FROM z")
def boundary_scores(spark, sf_dir):
    s = _fixed(spark, sf_dir).select(*KEYS, scores.boundary_scores(scores.boundaries("words"), scores.boundaries("predicted")).alias("s")).select(*KEYS, "s.*")
    return s.select(*KEYS, *[F.round(m, 9).alias(m) for m in scores.BOUNDARY], "boundary_true_positives", "boundary_false_positives", "boundary_false_negatives")


@query(SCORED + "SELECT doc_id, line, " + ", ".join(f"CAST(round({m}, 9) AS DOUBLE) AS {m}" for m in scores.ALL[4:8]) + ", " + ", ".join(scores.COUNTS) + " FROM z")
def word_scores(spark, sf_dir):
    rows = report.score_rows(_fixed(spark, sf_dir), KEYS)
    return rows.select(*KEYS, *[F.round(m, 9).alias(m) for m in scores.ALL[4:8]], *scores.COUNTS)


@query(SCORED + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(round(avg({m}), 6) AS DOUBLE) AS value FROM z" for m in scores.ALL) + ")")
def macro_scores_fixed(spark, sf_dir):
    return report.macro_average(report.score_rows(_fixed(spark, sf_dir), KEYS)).withColumn("value", F.round("value", 6))


# ---- segmenters, fitted on the whole corpus and applied to it

SEGMENTED = (
    LINES
    + r""", a AS (SELECT doc_id, line, text, lower(plain) AS plain, words, repeat(chr(2), 3) || lower(plain) || repeat(chr(3), 3) AS pad, BINARY AS b FROM v),
c AS (SELECT doc_id, line, i, substring(pad, CAST(i + 1 AS BIGINT), 7) AS k0, CASE WHEN substring(b, CAST(i + 1 AS BIGINT), 1) = 'E' THEN 1 ELSE 0 END AS l FROM (SELECT *, unnest(range(length(plain))) AS i FROM a)),
f AS (SELECT k0, count(*) AS n, sum(l) AS e FROM c GROUP BY k0),
f1 AS (SELECT substring(k0, 2, 5) AS k1, sum(n) AS n, sum(e) AS e FROM f GROUP BY 1),
f2 AS (SELECT substring(k0, 3, 3) AS k2, sum(n) AS n, sum(e) AS e FROM f GROUP BY 1),
d AS (SELECT f.k0, CASE WHEN f.n >= 5 THEN 2 * f.e >= f.n WHEN f1.n >= 5 THEN 2 * f1.e >= f1.n ELSE 2 * f2.e >= f2.n END AS cut
  FROM f JOIN f1 ON f1.k1 = substring(f.k0, 2, 5) JOIN f2 ON f2.k2 = substring(f.k0, 3, 3)),
s AS (SELECT c.doc_id, c.line, string_agg(substring(c.k0, 4, 1) || CASE WHEN d.cut THEN ' ' ELSE '' END, '' ORDER BY c.i) AS t FROM c JOIN d USING (k0) WHERE c.i < 126 GROUP BY c.doc_id, c.line),
u AS (SELECT v.doc_id, v.line, list_transform(v.words, lambda x: lower(x)) AS t, trim(s.t) AS segmented, string_split(trim(s.t), ' ') AS p FROM v JOIN s USING (doc_id, line))
""".replace("BINARY", BINARY_SQL)
)


#: The same with every character of each line.
SEGMENTED_WHOLE = SEGMENTED.replace(" WHERE c.i < 126", "")


@query(SEGMENTED_WHOLE + "SELECT doc_id, line, segmented FROM u")
def segment_standard(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    found = decode.StandardSegmenter(decode.ContextModel.fit(v), None).segment(v.select(*KEYS, F.lower(text.without_spaces("text")).alias("text")), KEYS)
    return found.select(*KEYS, F.array_join("words", " ").alias("segmented"))


#: From truth t and predicted words p to the means of all measures.
MACRO = (
    """, o AS (SELECT *, list_distinct(list_transform(range(1, len(t)), lambda i: CAST(list_sum(list_transform(t[1:i], lambda x: length(x))) AS INTEGER))) AS e,
  list_distinct(list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS INTEGER))) AS q FROM u),
"""
    + SCORED[SCORED.index("n AS (SELECT *, len(list_intersect(e, q)) AS tp") :]
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(round(avg({m}), 6) AS DOUBLE) AS value FROM z" for m in scores.ALL)
    + " UNION ALL SELECT 'n_errors', 0.0)"
)


@query(SEGMENTED + MACRO)
def macro_scores(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    rows = benchmark.evaluate(decode.StandardSegmenter(decode.ContextModel.fit(v)), v, KEYS)
    return report.macro_average(rows).withColumn("value", F.round("value", 6))


#: Fitted on the four fifths of the lines that split_80_20 marks, applied to the rest.
HELD_OUT = (
    SEGMENTED_WHOLE.replace(
        "a AS (SELECT doc_id",
        """h AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || '|' || line || '|42')) <= floor(count(*) OVER () * 0.8) AS is_train FROM v),
a AS (SELECT is_train, doc_id""",
    )
    .replace("FROM v),\nc AS (SELECT doc_id", "FROM h),\nc AS (SELECT is_train, doc_id")
    .replace("FROM c GROUP BY k0", "FROM c WHERE is_train GROUP BY k0")
    .replace("d AS (SELECT f.k0, CASE", "t0 AS (SELECT DISTINCT k0 FROM c WHERE NOT is_train),\nd AS (SELECT t0.k0, CASE")
    .replace("ELSE 2 * f2.e >= f2.n END AS cut\n  FROM f JOIN f1 ON f1.k1 = substring(f.k0, 2, 5) JOIN f2 ON f2.k2 = substring(f.k0, 3, 3))", "ELSE coalesce(2 * f2.e >= f2.n, true) END AS cut\n  FROM t0 LEFT JOIN f ON f.k0 = t0.k0 LEFT JOIN f1 ON f1.k1 = substring(t0.k0, 2, 5) LEFT JOIN f2 ON f2.k2 = substring(t0.k0, 3, 3))")
    .replace("JOIN d USING (k0) GROUP BY", "JOIN d USING (k0) WHERE NOT c.is_train GROUP BY")
)


def _split(spark, sf_dir):
    split = decode.exact_split(verses_of(spark, sf_dir), F.concat_ws("|", "doc_id", "line"))
    return split.where("is_train").drop("is_train"), split.where("not is_train").drop("is_train")


@query(HELD_OUT + MACRO)
def held_out_scores(spark, sf_dir):
    """Means of the count model on whole lines it was not fitted on."""
    train, test = _split(spark, sf_dir)
    rows = benchmark.evaluate(decode.StandardSegmenter(decode.ContextModel.fit(train), None), test, KEYS)
    return report.macro_average(rows).withColumn("value", F.round("value", 6))


@query()
def trained_scores(spark, sf_dir):
    """Means of the trained classifier on the first 126 characters of the lines of held_out_scores."""
    train, test = _split(spark, sf_dir)
    return report.macro_average(benchmark.evaluate(decode.StandardSegmenter(TrainedClassifier.fit(train)), test, KEYS))


@query()
def grid_scores(spark, sf_dir):
    """All algorithms that are fitted apart, both schemes and three beams on held-out lines in one pass, by language and in all."""
    train, test = _split(spark, sf_dir)
    configurations = [("STANDARD", 1, "binary"), ("STANDARD", 1, "quadri"), *[("HIERARCHICAL", k, s) for k in (3, 10, 15) for s in ("binary", "quadri")]]
    return benchmark.grid(train, test, KEYS, configurations, by=["lang"], totals=True).withColumn("value", F.round("value", 6))


#: The marked lines of all n-grams of six characters, and of shorter ones at the start.
GRAMS = (
    LINES
    + """, m AS (SELECT chr(2) || lower(text) || chr(3) AS t FROM v),
g AS (SELECT substring(t, CAST(i AS BIGINT), 6) AS gram FROM (SELECT t, unnest(range(1, length(t) - 4)) AS i FROM m) UNION ALL SELECT substring(t, 1, CAST(i AS BIGINT)) FROM (SELECT t, unnest(range(2, least(6, length(t) + 1))) AS i FROM m))
SELECT gram, count(*) AS n FROM g GROUP BY gram"""
)


@query(GRAMS)
def character_grams(spark, sf_dir):
    """What the character model is fitted on, counted on sliding windows of token ids."""
    return CharacterModel.grams(benchmark.lower_words(verses_of(spark, sf_dir)))


@query()
def held_out_perplexity(spark, sf_dir):
    """By characters, of the character model and of word bigrams, on lines that neither was fitted on."""
    train, test = (benchmark.lower_words(x) for x in _split(spark, sf_dir))
    by_character = CharacterModel.fit(train).perplexity(test, KEYS).select(F.lit("characters").alias("model"), "nll", "n")
    length = F.length(F.array_join("words", " ")) + 1
    by_word = decode.WordModel.fit(train).perplexity(test, KEYS).drop("n").join(test.select(*KEYS, length.alias("n")), KEYS).select(F.lit("word bigrams").alias("model"), "nll", "n")
    sums = by_character.unionByName(by_word).groupBy("model").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_characters"), (F.sum("nll") / F.sum("n")).alias("loss"))
    return sums.withColumn("perplexity", F.exp("loss"))


MODELLED = (
    LINES
    + """, b AS (SELECT doc_id, line, i, CASE WHEN i = 1 THEN '' ELSE words[i - 1] END AS x, words[i] AS y FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM v)),
u AS (SELECT y, count(*) AS n FROM b GROUP BY y), bi AS (SELECT x, y, count(*) AS n FROM b GROUP BY x, y), bx AS (SELECT x, count(*) AS n FROM b GROUP BY x), tot AS (SELECT sum(n) AS n, count(*) AS m FROM u)
"""
)


@query(
    MODELLED
    + """SELECT doc_id, line, CAST(round(exp(avg(-ln(0.7::DOUBLE * (bi.n / CAST(bx.n AS DOUBLE)) + (1 - 0.7::DOUBLE) * ((u.n + 1.0::DOUBLE) / (tot.n + tot.m))))), 4) AS DOUBLE) AS perplexity
FROM b JOIN bi USING (x, y) JOIN bx USING (x) JOIN u USING (y) CROSS JOIN tot GROUP BY doc_id, line"""
)
def perplexity(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    return decode.WordModel.fit(v).perplexity(v, KEYS, seen=True).select(*KEYS, F.round("perplexity", 4).alias("perplexity"))


@query()
def segment_hierarchical(spark, sf_dir):
    v = verses_of(spark, sf_dir)
    segmenter = decode.HierarchicalSegmenter(decode.ContextModel.fit(v), decode.WordModel.fit(benchmark.lower_words(v)), beam_width=3, max_length=None)
    found = segmenter.segment(v.select(*KEYS, F.lower(text.without_spaces("text")).alias("text")), KEYS)
    return found.select(*KEYS, F.array_join("words", " ").alias("segmented"))


@query()
def segment_unsupervised(spark, sf_dir):
    v = corpus.unspaced_texts(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.lower("text").alias("text")))
    found = BayesianSegmenter().train(v).segment(v, ["item_id"])
    return found.select("item_id", F.array_join("words", " ").alias("segmented"))


@query(
    LINES
    + """, q AS (SELECT doc_id, line, list_transform(range(1, length(plain) + 1), lambda i: (unicode(substring(plain, CAST(i AS BIGINT), 1)) % 9 + 1) / 11.0::DOUBLE) AS p FROM v),
c AS (SELECT doc_id, line, list_sum(list_transform(p, lambda x: ln(greatest(x, 1 - x)))) AS best, list_sort(list_transform(p, lambda x: abs(ln(x) - ln(1 - x)))) AS loss FROM q),
k AS (SELECT doc_id, line, unnest(CASE WHEN len(loss) = 1 THEN [0, 1] ELSE [0, 1, 2] END) AS rank, best, loss FROM c)
SELECT doc_id, line, CAST(rank AS INTEGER) AS rank, CAST(round(best - CASE WHEN rank = 0 THEN 0 ELSE loss[rank] END, 6) AS DOUBLE) AS score FROM k"""
)
def kbest(spark, sf_dir):
    """The three best sequences of whole lines: after the best, those that give up the cheapest place, and the second cheapest."""
    v = verses_of(spark, sf_dir)
    p = F.transform(labels.code_points(text.without_spaces("text")), lambda c: (c % 9 + 1) / 11.0)
    return decode.k_best_rows(v.select(*KEYS, p.alias("p")), KEYS, "p", 3).select(*KEYS, "rank", F.round("score", 6).alias("score"))


# ---- noise

#: Substitution of a letter by the next one and deletion, by md5 uniforms.
NOISED = (
    LINES
    + """, c AS (SELECT doc_id, line, plain, i, substring(plain, CAST(i + 1 AS BIGINT), 1) AS ch FROM (SELECT doc_id, line, lower(plain) AS plain, unnest(range(length(plain))) AS i FROM v)),
x AS (SELECT *, CAST(('0x' || substr(md5('7|' || doc_id || ':' || line || '|' || i), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS u FROM c),
y AS (SELECT *, CASE WHEN ch BETWEEN 'a' AND 'y' AND u < 0.1::DOUBLE THEN chr(unicode(ch) + 1) WHEN ch BETWEEN 'a' AND 'y' AND u < 0.15::DOUBLE THEN '' ELSE ch END AS o FROM x),
z AS (SELECT doc_id, line, any_value(plain) AS clean, string_agg(o, '' ORDER BY i) AS noisy FROM y GROUP BY doc_id, line)
"""
)


def _model(spark) -> noise.NoiseModel:
    rows = []
    for a, b in zip("abcdefghijklmnopqrstuvwxy", "bcdefghijklmnopqrstuvwxyz", strict=True):
        rows += [(noise.CHARACTERS, a, None, 0.04), (noise.CONDITIONAL, a, "substitute", 0.1), (noise.CONDITIONAL, a, "delete", 0.05), (noise.CONDITIONAL, a, "correct", 0.85), (noise.SUBSTITUTIONS, a, b, 1.0)]
    model = noise.NoiseModel(spark.createDataFrame(rows, "kind string, ch string, key string, p double"), 0.15)
    model.cuts = dict.fromkeys(model.cuts, (0.1, 0.15))  # the literal rates, so that both engines compare with the same doubles
    return model


def _noisy(spark, sf_dir):
    """Whole lines without spaces in lower case, and what the noise model makes of them."""
    v = verses_of(spark, sf_dir).withColumn("clean", F.lower(text.without_spaces("text")))
    return v.withColumn("noisy", _model(spark).generate("clean", F.concat_ws(":", "doc_id", "line")))


@query(NOISED + "SELECT doc_id, line, clean, noisy FROM z")
def noise_apply(spark, sf_dir):
    return _noisy(spark, sf_dir).select(*KEYS, "clean", "noisy")


#: Small letters beyond ASCII in the tables, for SQL that measures bytes: each becomes a capital, which no lower-cased line holds.
BEYOND = "äöüßéèêàçîôûùœñáíóúâëï"
SINGLE = f"z1 AS (SELECT doc_id, line, translate(clean, '{BEYOND}', '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[: len(BEYOND)]}') AS clean, translate(noisy, '{BEYOND}', '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[: len(BEYOND)]}') AS noisy FROM z)"


@query(NOISED + f", {SINGLE} SELECT doc_id, line, CAST(levenshtein(clean, noisy) AS INTEGER) AS distance, CAST(round(levenshtein(clean, noisy) / CAST(length(clean) AS DOUBLE), 9) AS DOUBLE) AS cer FROM z1")
def edit_distance_cer(spark, sf_dir):
    """Characters are counted, not bytes."""
    return _distances(_noisy(spark, sf_dir))


def _distances(n):
    d = n.select(*KEYS, align.distance_column(F.col("clean"), F.col("noisy")).alias("distance"), F.length("clean").alias("n"))
    return d.select(*KEYS, "distance", F.round(F.col("distance") / F.col("n"), 9).alias("cer"))


@query(
    NOISED
    + """, g AS (SELECT ch, CASE WHEN o = '' THEN '⌀' ELSE o END AS o FROM y), k AS (SELECT ch, o, CASE WHEN ch = o THEN 'correct' WHEN o = '⌀' THEN 'delete' ELSE 'substitute' END AS op, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT 'character_distribution' AS kind, ch, CAST(NULL AS VARCHAR) AS key, sum(c) / CAST(sum(sum(c)) OVER () AS DOUBLE) AS p FROM k GROUP BY ch
  UNION ALL SELECT 'conditional', ch, op, sum(c) / CAST(sum(sum(c)) OVER (PARTITION BY ch) AS DOUBLE) FROM k GROUP BY ch, op
  UNION ALL SELECT 'substitutions', ch, o, c / CAST(sum(c) OVER (PARTITION BY ch) AS DOUBLE) FROM k WHERE op = 'substitute')
SELECT kind, ch, key, CAST(round(p, 9) AS DOUBLE) AS p FROM t"""
)
def noise_learn(spark, sf_dir):
    v = verses_of(spark, sf_dir).withColumn("clean", F.lower(text.without_spaces("text")))
    key = F.concat_ws(":", "doc_id", "line")
    return noise.learn(v.select(F.col("clean").alias("gt"), _aligned("clean", key).alias("noisy"))).withColumn("p", F.round("p", 9))


@F.arrow_udf(StringType())
def _aligned(clean: pa.Array, key: pa.Array) -> pa.Array:
    """Substitution of a letter by the next one, and a gap for a deleted one: aligned by construction."""
    texts, keys = clean.to_pylist(), key.to_pylist()
    out = list(texts)
    for some, points, row, place in noise.groups(texts):
        at = np.flatnonzero((points >= ord("a")) & (points <= ord("y")))
        u = noise.share_of(noise.digests(noise.prefixes(7, [keys[i] for i in some]), row[at], place[at])[0])
        seen = points.astype("<u4")
        seen[at] = np.where(u < 0.1, points[at] + 1, np.where(u < 0.15, ord(text.GAP), points[at]))
        for i, part in zip(some, np.split(seen, np.flatnonzero(place == 0)[1:]), strict=True):
            out[i] = part.tobytes().decode("utf-32-le")
    return pa.array(out, pa.string())


#: Pairs with substitutions, deletions and insertions, the tables learned from them, and the rates at a target of 0.1.
CHAINED = (
    LINES
    + """, c AS (SELECT doc_id, line, i, substring(plain, CAST(i + 1 AS BIGINT), 1) AS ch FROM (SELECT doc_id, line, lower(plain) AS plain, unnest(range(length(plain))) AS i FROM v)),
d AS (SELECT *, UNIFORM(3, 1) AS u FROM c),
g AS (SELECT ch, CASE WHEN ch BETWEEN 'a' AND 'y' AND u < 0.06::DOUBLE THEN chr(unicode(ch) + 1) WHEN ch BETWEEN 'a' AND 'y' AND u < 0.1::DOUBLE THEN '⌀' ELSE ch END AS o FROM d
  UNION ALL SELECT '⌀', CASE WHEN ch < 'm' THEN 'q' ELSE 'x' END FROM d WHERE u BETWEEN 0.1::DOUBLE AND 0.13::DOUBLE),
k AS (SELECT ch, o, count(*) AS n FROM g GROUP BY ch, o),
t AS (SELECT ch, sum(n) AS n, sum(CASE WHEN o = '⌀' THEN n ELSE 0 END) AS dels, sum(CASE WHEN o <> ch AND o <> '⌀' THEN n ELSE 0 END) AS subs FROM k WHERE ch <> '⌀' GROUP BY ch),
tot AS (SELECT sum(n) AS n, (SELECT sum(n) FROM k WHERE ch = '⌀') AS ins, (SELECT sum(dels + subs) FROM t) AS errs FROM t),
s AS (SELECT 0.1::DOUBLE / ((errs + ins) / CAST(n AS DOUBLE)) AS scale, ins / CAST(n AS DOUBLE) AS gap FROM tot),
r AS (SELECT ch, subs / CAST(n AS DOUBLE) * scale AS cut1, (subs + dels) / CAST(n AS DOUBLE) * scale AS cut2 FROM t, s),
q AS (SELECT sum(CASE WHEN o = 'q' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS share FROM k WHERE ch = '⌀'),
y AS (SELECT c.*, UNIFORM(11, 1) AS u, UNIFORM(11, 17) AS w, UNIFORM(11, 25) AS x FROM c),
z AS (SELECT doc_id, line, string_agg(CASE WHEN u < cut1 THEN chr(unicode(y.ch) + 1) WHEN u < cut2 THEN '' ELSE y.ch END || CASE WHEN w < gap * scale THEN CASE WHEN x < share THEN 'q' ELSE 'x' END ELSE '' END, '' ORDER BY i) AS noisy
  FROM y JOIN r USING (ch), s, q GROUP BY doc_id, line)
SELECT doc_id, line, noisy FROM z"""
)
for n, at in ((3, 1), (11, 1), (11, 17), (11, 25)):
    CHAINED = CHAINED.replace(f"UNIFORM({n}, {at})", f"CAST(('0x' || substr(md5('{n}|' || doc_id || ':' || line || '|' || i), {at}, 8)) AS UBIGINT) / 4294967296.0::DOUBLE")


@query(CHAINED)
def noise_chain(spark, sf_dir):
    """Tables learned from aligned pairs with all three kinds of errors, scaled to a target rate, and applied to the same lines."""
    v = verses_of(spark, sf_dir).withColumn("clean", F.lower(text.without_spaces("text")))
    key = F.concat_ws(":", "doc_id", "line")

    pairs = v.select(_three_kinds.asNondeterministic()("clean", key).alias("p")).select("p.gt", "p.noisy")
    model = noise.NoiseModel(noise.learn(pairs), 0.1, seed=11)
    return v.select(*KEYS, model.generate("clean", key).alias("noisy"))


@F.arrow_udf(StructType([StructField("gt", StringType()), StructField("noisy", StringType())]))
def _three_kinds(clean: pa.Array, key: pa.Array) -> pa.Array:
    """Aligned texts: letters become the next one or a gap, and a letter is put before some characters, where the truth has a gap."""
    texts, keys = clean.to_pylist(), key.to_pylist()
    gt, noisy = list(texts), list(texts)
    for some, points, row, place in noise.groups(texts):
        u = noise.share_of(noise.digests(noise.prefixes(3, [keys[i] for i in some]), row, place)[0])
        letter, more = (points >= ord("a")) & (points <= ord("y")), (u >= 0.1) & (u <= 0.13)
        seen = np.where(letter & (u < 0.06), points + 1, np.where(letter & (u < 0.1), ord(text.GAP), points))
        at = np.flatnonzero(more)
        put = np.where(points[at] < ord("m"), ord("q"), ord("x"))
        ends = np.cumsum(1 + more)[np.flatnonzero(place == 0)[1:] - 1]
        for out, whole in ((gt, np.insert(points, at, ord(text.GAP))), (noisy, np.insert(seen, at, put))):
            for i, part in zip(some, np.split(whole.astype("<u4"), ends), strict=True):
                out[i] = part.tobytes().decode("utf-32-le")
    return pa.StructArray.from_arrays([pa.array(gt, pa.string()), pa.array(noisy, pa.string())], names=["gt", "noisy"])


@query()
def align_gap(spark, sf_dir):
    return align.align_pairs(_noisy(spark, sf_dir), KEYS, "clean", "noisy")


def _projected(spark, sf_dir):
    n = _noisy(spark, sf_dir).withColumn("kept", F.filter(F.transform("words", F.lower), lambda w: w != ""))
    return n.withColumn("expected", align.project_column(scores.boundaries("kept"), F.array_join("kept", ""), F.col("noisy")))


@query()
def project_boundaries(spark, sf_dir):
    return _projected(spark, sf_dir).select(*KEYS, F.array_join(F.col("expected").cast("array<string>"), ",").alias("offsets"))


@query()
def noisy_scores(spark, sf_dir):
    p = _projected(spark, sf_dir).withColumn("predicted", decode.fixed_width("noisy"))
    return report.score_rows(p, KEYS, "kept", "predicted", F.col("expected"))


@query()
def tei_parse(spark, sf_dir):
    """Pages' titles and ids in a TEI frame, parsed back."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), "[<>&]", " ").alias("t"))
    words = F.array_join(F.transform(text.words("t"), lambda w: F.concat(F.lit("<w>"), w, F.lit("</w>"))), "")
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><title n="t"/><div type="book" n="B20"><div type="chapter" n="B20K3"><ab n="B20K3V'), F.col("page_id").cast("string"), F.lit('">'), words, F.lit("</ab></div></div></TEI>"))
    out = tei.parse_transcriptions(p.withColumn("xml", xml))
    return out.select("page_id", "parsed.title", F.explode("parsed.verses").alias("v"), "parsed.error").select("page_id", "title", "v.chapter", "v.verse", "v.text", "error")


#: Whole documents as transcriptions: line breaks in words, readings in every third line, an incipit of the first line.
TRANSCRIBED = (
    LINES
    + r""", x AS (SELECT doc_id, line, list_filter(list_transform(words, lambda w: regexp_replace(translate(w, '<>&"', ''), '\p{C}', '', 'g')), lambda w: w <> '') AS ws FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM x WHERE len(ws) > 0)
SELECT doc_id, 'document ' || doc_id AS title, CASE WHEN n = 1 THEN 'Incipit' ELSE '3' END AS chapter, CAST(line AS VARCHAR) AS verse,
  array_to_string(ws, ' ') || CASE WHEN line % 3 = 0 THEN ' ' || ws[1] || ' ' || ws[len(ws)] ELSE '' END AS text FROM y"""
)


@query(TRANSCRIBED)
def tei_documents(spark, sf_dir):
    """Verses of whole documents in a TEI frame, parsed back."""
    # no word holds a blank, so a line is cleaned at once
    v = verses_of(spark, sf_dir).select("doc_id", "line", F.filter(F.split(text.drop_control(F.translate("text", '<>&"', "")), " "), lambda w: w != "").alias("ws")).where(F.size("ws") > 0)
    # each fourth word goes on in the next line of the manuscript
    word = lambda w, i: F.concat(F.lit("<w>"), F.substr(w, F.lit(1), F.lit(1)), F.when(i % 4 == 3, '<lb break="no"/>').otherwise(""), F.substr(w, F.lit(2)), F.lit("</w>"))
    reading = lambda kind, w: F.concat(F.lit(f"<rdg{kind}><w>"), w, F.lit("</w></rdg>"))
    first, last = F.element_at("ws", 1), F.element_at("ws", -1)
    app = F.when(F.col("line") % 3 == 0, F.concat(F.lit("<app>"), reading(' type="orig"', first), reading(' type="corr"', F.lit("never")), F.lit("</app><app>"), reading("", last), F.lit("</app>"))).otherwise("")
    ab = F.concat(F.lit('<ab n="B20K3V'), F.col("line").cast("string"), F.lit('">'), F.array_join(F.transform("ws", word), "<lb/>"), app, F.lit("</ab>"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line", ab.alias("ab")))), lambda x: x["ab"])  # a document's own lines
    docs = v.groupBy("doc_id").agg(lines.alias("abs"))
    head = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><title n="document '), F.col("doc_id").cast("string"), F.lit('"/><div type="book" n="B20"><div type="incipit" n="B20incipit">'))
    body = F.concat(F.element_at("abs", 1), F.lit('</div><div type="chapter" n="B20K3">'), F.array_join(F.slice("abs", 2, F.greatest(F.size("abs") - 1, F.lit(0))), ""))
    xml = F.concat(head, body, F.lit('</div></div><div type="book" n="B21"><div type="chapter" n="B21K1"><ab n="B21K1V1"><w>other</w></ab></div></div></TEI>'))
    out = tei.parse_transcriptions(docs.select("doc_id", xml.alias("xml")))
    return out.select("doc_id", "parsed.title", F.explode("parsed.verses").alias("v")).select("doc_id", "title", "v.chapter", "v.verse", "v.text")


#: Documents in dict form: a verse for each line, every fifth word supplied, readings in every third line.
DICT_FORM = (
    LINES
    + """SELECT doc_id, '7V' || line AS chapter, CAST(line AS VARCHAR) AS verse,
  array_to_string(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN i % 5 = 0 THEN 'SUPPLIED' ELSE words[i] || ' ' END), '')
  || CASE WHEN line % 3 = 0 THEN words[1] || ' ' || words[len(words)] || ' ' ELSE '' END AS text FROM v"""
)


@query(DICT_FORM)
def dict_form_verses(spark, sf_dir):
    """Verses, supplied words and original readings out of documents in dict form, each made from a whole document."""
    # no word holds a blank, so a line is quoted at once
    line = verses_of(spark, sf_dir).select(*KEYS, F.to_json(F.array("text")).alias("quoted"))
    v = line.select(*KEYS, F.split(F.substr("quoted", F.lit(3), F.length("quoted") - 4), " ").alias("words"))
    one = lambda w: F.concat(F.lit('"'), w, F.lit('"'))
    word = lambda w, i: F.when((i + 1) % 5 == 0, F.concat(F.lit('{"supplied": {"#text": '), one(w), F.lit("}}"))).otherwise(one(w))
    reading = lambda kind, w: F.concat(F.lit(f'{{"@type": "{kind}", "w": '), w, F.lit("}"))
    first, last = one(F.element_at("words", 1)), one(F.element_at("words", -1))
    app = F.concat(F.lit(', "app": [{"rdg": ['), reading("orig", first), F.lit(", "), reading("corr", last), F.lit(']}, {"seg": {"rdg": ['), reading("orig", F.concat(F.lit('{"#text": '), last, F.lit("}"))), F.lit("]}}]"))
    ab = F.concat(F.lit('{"@n": "B04K7V'), F.col("line").cast("string"), F.lit('", "w": ['), F.array_join(F.transform("words", word), ", "), F.lit("]"), F.when(F.col("line") % 3 == 0, app).otherwise(""), F.lit("}"))
    docs = v.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", ab.alias("ab")))), lambda x: x["ab"]), ", ").alias("abs"))  # a document's own lines
    json = F.concat(F.lit('{"TEI": {"text": {"body": {"div": {"div": ["no verse", {"ab": ['), "abs", F.lit("]}]}}}}}"))
    return tei.dict_verses(docs.select("doc_id", json.alias("json")), ["doc_id"]).select("doc_id", "chapter", "verse", "text")


@query(
    LINES.replace("documents WHERE", "(SELECT item_id AS doc_id, '' AS source, replace(text, chr(10), ' ') AS text FROM benchmark) WHERE")
    + f""", b AS (SELECT doc_id, plain, {BINARY_SQL} AS b, unnest(range(least(126, length(plain)) + 2)) AS place FROM v)
SELECT doc_id AS item_id, CAST(place AS INTEGER) AS place, CASE WHEN place = 0 THEN '[CLS]' WHEN place = least(126, length(plain)) + 1 THEN '[SEP]' ELSE substring(plain, CAST(place AS BIGINT), 1) END AS token,
  CASE WHEN place = 0 OR place = least(126, length(plain)) + 1 THEN -100 WHEN substring(b, CAST(place AS BIGINT), 1) = 'E' THEN 1 ELSE 0 END AS label FROM b"""
)
def alignment_report(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.words("text").alias("words")).where(F.size("words") > 0)
    given = b.select("item_id", F.array_join("words", "").alias("text"), labels.ids(labels.binary("words")).alias("label_ids"))
    return labels.alignment_report(given, ["item_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
