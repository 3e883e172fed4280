"""The stages by row: repeated ids, nulls and columns whose names clash with those of the operators."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wordloom.llm import language_id, pipeline
from wordloom.llm.common import Workspace, measured_bytes, shared_dir

CLASHES = ("found", "found_", "gone", "__gone", "__before", "before", "doc", "key", "removed_lines", "n_lines", "row_a", "kept", "component_id", "rep", "id")
PROSE = "the thing that they were looking for was not in the house but under the old tree in the garden"


def table(spark, rows):
    """Rows of doc_id, text as documents with columns that clash."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").cast("int").alias("n_chars"))
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="module")
def filler(spark):
    return [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' and length(text) between 200 and 2000").limit(40).collect()]


def texts(df):
    out = df.collect()
    assert all(r[c] == f"own {c}" for r in out for c in CLASHES)
    return sorted(((r["doc_id"], r["text"]) for r in out if r["doc_id"] is None or r["doc_id"] < 1000), key=str)


def test_languages_by_row(spark, filler):
    rows = [(1, PROSE), (1, "0123 4567 89"), (1, PROSE + " again"), (2, None), (3, ""), (None, PROSE)]
    df = table(spark, rows + filler)
    out = pipeline.identify_language(spark, df, "")
    assert out.columns == df.columns
    assert texts(out) == sorted([(1, PROSE), (1, PROSE + " again"), (None, PROSE)], key=str)
    assert pipeline.identify_language(spark, df.limit(0), "").count() == 0


def test_lines_by_row(spark):
    run = "\n".join(f"line {k} " + " ".join(f"w{k}{j}" for j in range(9)) for k in range(4))
    rows = [(1, run), (2, "head\n" + run + "\ntail"), (2, "only this"), (None, run), (None, "x\n" + run), (3, None), (4, "")]
    out = pipeline.dedup_lines(spark, table(spark, rows), "")
    assert texts(out) == sorted([(1, run), (2, "head\ntail"), (2, "only this"), (None, "x"), (3, None), (4, "")], key=str)
    assert {r["doc_id"]: r["n_chars"] for r in out.where("doc_id is not null and not text <=> 'only this'").collect()} == {1: len(run), 2: 9, 3: None, 4: 0}


def test_near_duplicates_by_row(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, a), (1, a + " x"), (1, b), (2, a + " y"), (3, b + " z"), (4, "c d"), (5, ""), (6, None), (None, a), (None, a)]
    out = texts(pipeline.dedup_near(spark, table(spark, rows), ""))
    # of the rows with id 1 one of each group stays, which of a and a + " x" is settled by their hashes
    assert [t for i, t in out if i == 1 and t.startswith("b")] == [b] and len([t for i, t in out if i == 1]) == 2
    assert [r for r in out if r[0] != 1] == sorted([(4, "c d"), (5, ""), (6, None), (None, a), (None, a)], key=str)
    assert pipeline.dedup_near(spark, table(spark, rows).limit(0), "").count() == 0


def test_redaction_and_packing_of_rows(spark):
    rows = [(1, "mail a.b@c.de now"), (1, "plain"), (2, None), (3, ""), (None, "10.0.0.1")]
    out = pipeline.redact_pii(spark, table(spark, rows), "")
    assert texts(out) == sorted([(1, "mail [EMAIL] now"), (1, "plain"), (2, None), (3, ""), (None, "[IP]")], key=str)
    packed = pipeline.pack(spark, table(spark, rows), "").collect()
    assert len(packed) == len(rows) and len({r["sequence_id"] for r in packed}) == 1
    assert pipeline.pack(spark, table(spark, rows).limit(0), "").count() == 0


def brute_identify(rows, names, model, smooth=language_id.SMOOTH):
    """Posteriors from text likelihoods, declarations, suffixes and hosts, each row left out of its own counts."""
    import collections

    import numpy as np

    own, like, n_tri = [], [], []
    for r in rows:
        x = language_id.trigrams((r["text"] or "").encode())
        like.append(model[:, x].sum(axis=1, dtype=np.float64) / len(x) * min(len(x), language_id.EVIDENCE) if len(x) else np.zeros(len(names)))
        own.append(int(like[-1].argmax()) if len(x) else -1)
        n_tri.append(len(x))
    out = []
    for i, r in enumerate(rows):
        count = collections.defaultdict(lambda: np.zeros(len(names)))
        for j, s in enumerate(rows):
            if own[j] >= 0 and i != j:
                for k in (("all",), ("declared", s["declared"]), ("suffix", s["suffix"]), ("host", s["host"], s["suffix"])):
                    count[k][own[j]] += 1
        base = (count["all",] + 1) / (count["all",].sum() + len(names))
        towards = lambda c, p: (c + smooth * p) / (c.sum() + smooth)
        prior = base
        if r["suffix"] is not None:
            prior = towards(count["suffix", r["suffix"]], prior)
        if r["host"] is not None:
            prior = towards(count["host", r["host"], r["suffix"]], prior)
        said = towards(count["declared", r["declared"]], base) / base if r["declared"] is not None else np.ones(len(names))
        logs = np.append(like[i] + np.log(prior) + np.log(said), np.log(language_id.PRIOR_NONE) - min(n_tri[i], language_id.EVIDENCE) * np.log(language_id.BUCKETS))
        p = np.exp(logs - logs.max())
        at = int(logs.argmax())
        out.append((r["id"], names[at] if n_tri[i] and at < len(names) else None, round(1 / p.sum(), 9)))
    return out


def test_fused_evidence_equals_brute_force(spark):
    """Over pages: markup language, address suffix and host against a plain recomputation of priors and posteriors."""
    url, html = F.col("url"), F.col("html")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(120)
    odd = spark.createDataFrame([(9001, None, "<html lang=en>le la les des"), (9002, "http://x.example.de/", None), (9003, "nothing", "der die das")], "page_id long, url string, html string")
    pages = pages.select("page_id", "url", "html").unionByName(odd)
    found = language_id.identify(pages, Workspace(spark, "t"), language_id.markup_language(html), language_id.host_of(url), url, "page_id", language_id.visible_text(html)).collect()
    src = pages.select(F.col("page_id").alias("id"), language_id.visible_text(html).alias("text"), language_id.markup_language(html).alias("declared"), language_id.host_of(url).alias("host"), language_id.address_suffix(url).alias("suffix"))
    names, model = language_id.fit(src.select(F.col("id").alias("doc_id"), "text", "declared"))
    want = brute_identify(src.collect(), names, model)
    assert sorted((r["doc_id"], r["lang"] or "") for r in found) == sorted((i, lang or "") for i, lang, _ in want)
    got = {r["doc_id"]: r["posterior"] for r in found}
    assert all(got[i] == pytest.approx(p, abs=1e-6) for i, _, p in want)


def test_visible_text(spark):
    html = '<html><style>p{}</style><script>var t="</p>";</script><!-- a <b> --><p class="x">One <b>two</b></p></html>'
    assert spark.range(1).select(language_id.visible_text(F.lit(html))).first()[0].split() == ["One", "two"]


def test_workspace(spark):
    work = Workspace(spark, "t")
    a = work.settle(spark.range(10), "a")
    assert a.count() == 10 and a.settled_at.startswith(shared_dir(spark))
    work.drop(a)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(a.settled_at)
    kept = work.settle(spark.range(5), "b")
    work.clear()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(kept.settled_at)
    df = spark.createDataFrame([(1, "é" * 1000, [1.0] * 50), (None, None, None)], "a long, b string, c array<double>")
    assert 2000 < measured_bytes(df) < 4000
