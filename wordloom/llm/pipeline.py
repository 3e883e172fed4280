"""A corpus pipeline of five operators over documents; each stage's result is written and read as the next one's input.

Decisions are taken by row, not by id: a row is known by a 128-bit hash of all its columns, so rows that share an id are judged
each by its own content, and only rows equal in every column share a fate. Columns of documents beyond doc_id, text, lang, source
and n_chars are passed on, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, minhash, packing, pii
from .common import Workspace, bound_batches, fresh, maybe_broadcast, table_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs plus two hash columns of fresh names."""
    names = [fresh(docs, "row_a"), fresh(docs, "row_b")]
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return docs.withColumns({n: F.xxhash64(F.lit(seed), *parts) for n, seed in zip(names, (1, 2), strict=True)}), names


def _without(docs: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows of docs whose key is not in gone (a written table of distinct keys)."""
    return docs.join(maybe_broadcast(gone), key, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language; lang becomes the language found.

    Null and empty texts hold no letters and go; so do texts no language reaches a posterior of one half for. Null lang or source
    are no evidence, ties go to the first language by name, rows that repeat an id are judged each by itself; an empty table
    stays empty, and without any declared language nothing goes.
    """
    bound_batches(spark)
    work, (keyed, key) = Workspace(spark, "pipeline-language"), _with_row_key(docs)
    found = work.settle(language_id.identify(keyed, work, declared="lang", host="source", carry=key).select(*key, "lang", "declared", "kept"), "languages")
    kept = _without(keyed, work.settle(found.where("not kept").select(*key).distinct(), "gone"), key)
    new = fresh(keyed, "found")
    other = work.settle(found.where("kept and lang is not null and not lang <=> declared").select(*key, F.col("lang").alias(new)).distinct(), "relabelled")
    joined = kept.join(maybe_broadcast(other), key, "left")
    return joined.withColumn("lang", F.coalesce(F.col(new), F.col("lang"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated runs of lines; documents of which nothing is left go; n_chars follows the text.

    The row with the least id keeps the run, rows with a null id never do; null and empty texts stay as they are, texts of one
    line never change, and an empty table stays empty.
    """
    bound_batches(spark)
    other = docs.withColumnsRenamed({c: fresh(docs, f"extra_{i}") for i, c in enumerate(docs.columns) if c.lower() in ("removed_lines", "removed_runs", "n_lines")})
    out = line_dedup.dedup_lines(other, Workspace(spark, "pipeline-lines")).where("removed_lines = '' or text <> ''")
    out = out.withColumn("n_chars", F.when(F.col("removed_lines") == "", F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(other.columns, docs.columns, strict=True)])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: shingles of five words, similarity 0.8 or more.

    The row with the least id stays; of rows of one group that share it, one does. Texts without words are like nothing, and rows
    with a null id stay. An empty table stays empty.
    """
    bound_batches(spark)
    work, (keyed, key) = Workspace(spark, "pipeline-minhash"), _with_row_key(docs)
    found = work.settle(minhash.near_duplicates(keyed, work, carry=key).select("group_id", "kept", *key), "groups")
    gone = found.where("not kept").select(*key)
    # kept rows of one group share the least id: the first of them by hash stays, once
    shared = found.where("kept and group_id is not null").groupBy("group_id").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = work.settle(shared, "shared-ids")
    if not shared.take(1):
        return _without(keyed, work.settle(gone.distinct(), "gone"), key).select(*[F.col(f"`{c}`") for c in docs.columns])
    again = found.where("kept").join(shared.select("group_id", "first"), "group_id").select(*key, (F.struct(*key) == F.col("first")).alias("once"))
    again = work.settle(again.distinct(), "rows-of-shared-ids")
    rest = _without(keyed, work.settle(gone.union(again.select(*key)).distinct(), "gone"), key)
    once = keyed.join(maybe_broadcast(again.where("once").select(*key)), key, "left_semi").dropDuplicates(key)
    return rest.unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text.

    Row by row: null texts stay null, empty ones empty, repeated rows and null ids are nothing special.
    """
    bound_batches(spark)
    before = fresh(docs, "before")
    out = pii.redact_pii(docs.withColumn(before, F.xxhash64("text")))
    n_chars = F.when(F.xxhash64("text") == F.col(before), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens: a row for each piece.

    Null and empty texts are one piece of the end id; repeated rows are packed as often as they come, null ids stay null; other
    columns are left out; an empty table gives no pieces.
    """
    bound_batches(spark)
    return packing.pack_documents(docs, Workspace(spark, "pipeline-packing"), BYTE_BPE)


STAGES = [("language-id", identify_language), ("line-dedup", dedup_lines), ("minhash-near-dedup", dedup_near), ("pii", redact_pii), ("best-fit-packing", pack)]
#: Fitted models, hash minima and a genetic search can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; returns the last one's rows."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = work.settle(stage(spark, docs, sf_dir), name)
    return docs
