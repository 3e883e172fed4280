"""Language identification by Bayesian fusion of evidence.

Text: likelihoods of hashed letter trigrams under a model of each language. Declared language, address suffix and host: how
often each goes with each language, counted by grouped aggregation over all rows. A host's prior is smoothed towards its
parent (the suffix of the address), and that towards the prior of all rows. What a row itself adds to these counts is taken out
before it is judged, so its text counts once. A class for no known language, in which all trigrams are equally likely,
competes with the languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import let
from .common import Workspace, maybe_broadcast, texts

BUCKETS = 1 << 16
#: The text models are fitted on about so many rows of each declared language (chosen by a hash of the id), the rest on all.
SAMPLE = 2000
#: Trigrams that count in full; pseudo-counts of a parent; prior of no known language.
EVIDENCE, SMOOTH, PRIOR_NONE = 100.0, 20.0, 1e-3
#: Trigrams that are held before they are counted.
HELD = 1 << 20
LEAST_POSTERIOR = 0.5
#: Letters in lower case and bytes of other scripts as they are, everything else a space.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Bucket numbers of the trigrams that hold a letter."""
    b = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def address_suffix(url: F.Column) -> F.Column:
    """The last label of the host in a URL, in lower case; null without one."""
    return F.nullif(F.regexp_extract(host_of(url), r"\.?([^.]+)$", 1), F.lit(""))


def markup_language(html: F.Column) -> F.Column:
    """The primary subtag of the lang attribute of a page's html element, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))


def visible_text(html: F.Column) -> F.Column:
    """A page's text: scripts, styles, comments and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def host_of(url: F.Column) -> F.Column:
    """The host in a URL, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """All declared languages and their log-probabilities of all buckets, from columns doc_id, text, declared."""
    counts = labelled.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n")).collect()  # one row for each language
    names = sorted(r["declared"] for r in counts)
    model = np.empty((len(names), BUCKETS), np.float32)
    if names:
        share = F.create_map(*[F.lit(x) for r in counts for x in (r["declared"], min(1.0, sample / r["n"]))])
        some = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, "declared"), F.lit(0.0)) * (1 << 20))
        place = {x: i for i, x in enumerate(names)}

        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code // BUCKETS, pa.int32()), pa.array(code % BUCKETS, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                for t, d in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                    held.append(trigrams(t).astype(np.int64) + place[d] * BUCKETS)
                    n += len(held[-1])
                    if n > HELD:
                        yield counted(held)
                        held, n = [], 0
            if n:
                yield counted(held)

        summed = some.select("text", "declared").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        got = summed.toPandas().sort_values("lang")  # the buckets seen in each language
        lang, bucket, n = (got[c].to_numpy() for c in ("lang", "bucket", "n"))
        ends = np.searchsorted(lang, np.arange(len(names) + 1))
        for i in range(len(names)):
            row = np.full(BUCKETS, 0.05)
            row[bucket[ends[i] : ends[i + 1]]] += n[ends[i] : ends[i + 1]]
            model[i] = np.log(row / row.sum())
    return names, model


def identify(df: DataFrame, work: Workspace, declared: str | F.Column, host: str | F.Column | None = None, address: str | F.Column | None = None, id_col: str = "doc_id", text_col: str | F.Column = "text", carry: list[str] = ()) -> DataFrame:
    """doc_id, lang, posterior, n_trigrams, declared, kept of each row, and the columns named in `carry` (of other names).

    kept is false where a row's text holds no letters or no language reaches LEAST_POSTERIOR. Null or empty texts hold no letters
    (lang null). Null evidence of any kind says nothing; ties go to the first language by name; rows repeat as they come.
    Without any declared language in the table nothing can be fitted: all lang are null and nothing is rejected.
    """
    column = lambda c, kind="string": (F.lit(None) if c is None else c if isinstance(c, F.Column) else F.col(c)).cast(kind)
    src = df.select(F.col(id_col).alias("doc_id"), column(text_col).alias("text"), column(declared).alias("declared"), column(host).alias("host"), address_suffix(column(address)).alias("suffix"), *carry)
    kind = src.schema["doc_id"].dataType.simpleString()
    names, model = fit(src.select("doc_id", "text", "declared"))
    result = ["doc_id", "lang", "posterior", "n_trigrams", "declared", "kept", *carry]
    if not names:
        return src.withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "n_trigrams": F.lit(0).cast("long"), "kept": F.lit(True)}).select(*result)
    table, k = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T)), len(names)
    schema = StructType.fromDDL(f"doc_id {kind}, declared string, host string, suffix string, n long, text array<double>")
    for c in carry:
        schema = schema.add(c, src.schema[c].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = table.value
        for b in batches:
            n, text = [], []
            for t in texts(b.column(1)):
                x = trigrams(t)
                n.append(len(x))
                mean = np.zeros(k) if not len(x) else np.bincount(x, minlength=BUCKETS) @ by_bucket / len(x) if len(x) > BUCKETS else by_bucket[x].sum(axis=0, dtype=np.float64) / len(x)
                text.append(mean * min(len(x), EVIDENCE))
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in (2, 3, 4)], pa.array(n, pa.int64()), pa.array(text, pa.list_(pa.float64())), *b.columns[5:]], names=schema.names)

    scored = work.settle(src.mapInArrow(score, schema), "text-evidence")
    # the language of the text alone, where it has letters: from 0, else -1
    best = F.when(F.col("n") > 0, F.array_position("text", F.array_max("text")).cast("int") - 1).otherwise(-1)
    scored = scored.withColumn("own", best)
    counts = work.settle(scored.where("own >= 0").groupBy("declared", "host", "suffix", "own").agg(F.count("*").alias("n")), "counts")
    vector = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("own") == i, F.col("n"))), F.lit(0)).cast("double") for i in range(k)]).alias(c)
    total = counts.agg(vector("c")).first()["c"]
    # counts by declaration, suffix and host, the latter two under their parents
    said = work.settle(counts.where("declared is not null").groupBy("declared").agg(vector("by_declared")), "declared")
    suffixes = work.settle(counts.where("suffix is not null").groupBy("suffix").agg(vector("by_suffix")), "suffixes")
    hosts = work.settle(counts.where("host is not null").groupBy(F.col("host").alias("h"), F.col("suffix").alias("s")).agg(vector("by_host")), "hosts")
    fused = scored.join(maybe_broadcast(said), "declared", "left").join(maybe_broadcast(suffixes), "suffix", "left")
    # rows without a host are spread: they match nothing
    spread = F.coalesce("host", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("doc_id", "n", "text"), F.lit(1024)).cast("string")))
    fused = fused.join(maybe_broadcast(hosts), (spread == F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
    others = lambda c: F.transform(c, lambda x, i: x - (F.col("own") == i).cast("double"))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    towards = lambda c, parent: let(size(c), lambda n: F.zip_with(c, parent, lambda x, p: (x + SMOOTH * p) / (n + SMOOTH)))
    under = lambda c, parent: F.when(F.col(c).isNull(), parent).otherwise(towards(others(c), parent))
    fused = fused.withColumn("base", F.transform(others(F.array(*map(F.lit, total))), lambda x: (x + 1) / (F.lit(float(sum(total) + k)) - (F.col("own") >= 0).cast("double"))))
    fused = fused.withColumn("prior", under("by_host", under("by_suffix", F.col("base"))))
    # P(declared | language) up to a factor: P(language | declared) / P(language)
    fused = fused.withColumn("evidence", F.zip_with(under("by_declared", F.col("base")), "base", lambda x, p: x / p))
    logs = F.zip_with(F.zip_with("text", "prior", lambda x, y: x + F.ln(y)), "evidence", lambda x, y: x + F.ln(y))
    none = F.lit(float(np.log(PRIOR_NONE))) - F.least(F.col("n"), F.lit(EVIDENCE)) * float(np.log(BUCKETS))
    fused = fused.withColumn("logs", F.concat(logs, F.array(none))).withColumn("top", F.array_max("logs"))
    fused = fused.withColumn("at", F.array_position("logs", F.col("top")).cast("int"))
    fused = fused.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    fused = fused.withColumn("lang", F.when((F.col("n") > 0) & (F.col("at") <= k), F.element_at(F.array(*map(F.lit, names)), F.least("at", F.lit(k)))))
    return fused.withColumn("n_trigrams", F.col("n")).withColumn("kept", F.col("lang").isNotNull() & (F.col("posterior") >= LEAST_POSTERIOR)).select(*result)
