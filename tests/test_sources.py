import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import decode, report
from wordloom.plans import benchmark
from wordloom.sources import corpus, tei
from wordloom.streaming.annotate import annotate_stream

NESTED = {"John": {"10": {"1": "in principio", "2": "erat verbum"}, "2": {"1": "é"}}}


def test_nested(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(NESTED, ensure_ascii=False, indent=4), encoding="utf-8")
    df = corpus.read_nested(spark, str(tmp_path / "c.json"))
    assert [tuple(r)[:4] for r in df.orderBy("pos").collect()] == [("John", "10", "1", "in principio"), ("John", "10", "2", "erat verbum"), ("John", "2", "1", "é")]
    corpus.write_nested(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"]) == NESTED


def test_annotated_lines(spark, tmp_path):
    df = spark.createDataFrame([("Un test",)], "text string")
    corpus.write_annotated(corpus.annotated_corpus(df), str(tmp_path / "a"))
    r = corpus.read_annotated(spark, str(tmp_path / "a")).first()
    assert r["text"] == "untest" and r["label_ids"] == [0, 1, 0, 0, 0, 1]
    assert corpus.annotated_texts(spark, str(tmp_path / "a")).first()["text"] == "untest"


def test_morphology(spark, tmp_path):
    (tmp_path / "61-Mt-x.txt").write_text("010101 N- ---- Bib, Bib bib bib\n010101 N- ---- gen gen gen gen\n010102 V- ---- a b c d\n")
    got = corpus.read_morphology(spark, str(tmp_path)).orderBy("verse").collect()
    assert [(r["book"], r["chapter"], r["verse"], r["text"]) for r in got] == [("Mt", "1", "1", "Bib gen "), ("Mt", "1", "2", "b ")]


def test_ocr_pairs(spark, tmp_path):
    for name, t in {"1v": "Abx", "1v_gt": "ab c\n", "2v": "no pair", "3r": "r", "3r_gt": "r"}.items():
        (tmp_path / f"{name}.txt").write_text(t)
    (tmp_path / "4v.dat").write_text("x")
    got = corpus.read_ocr_pairs(spark, str(tmp_path), "v", text.LATIN_ALPHABET, {text.GAP: ""}).collect()
    assert [tuple(r) for r in got] == [("1v", "ab c", "abx")]


def test_manuscripts(spark):
    got = [r["ms_id"] for r in corpus.manuscript_ids(spark, (1, 3), None, (9, 11)).orderBy("pos").collect()]
    assert got == ["20001", "20002", "30009", "30010"]


def test_tei(spark):
    xml = (
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><title n="P46"/><div type="book" n="B20"><div type="chapter" n="B20K1"><ab n="B20K1V1"><w>ab<lb/>c<unclear>d</unclear></w>'
        '<w><abbr>x</abbr>y</w><app><rdg type="orig"><w>or</w></rdg><rdg type="corr"><w>co</w></rdg><rdg><w>un</w></rdg></app></ab><ab n="B20K1V1"><w>more</w></ab></div></div>'
        '<div type="book" n="B21"><div type="chapter" n="B21K1"><ab n="B21K1V1"><w>other</w></ab></div></div></TEI>'
    )
    got = tei.parse_transcriptions(spark.createDataFrame([(xml,), ("<broken",), (None,)], "xml string")).collect()
    assert got[0]["parsed"]["title"] == "P46" and [tuple(v) for v in got[0]["parsed"]["verses"]] == [("1", "1", "abcd xy or un more")]
    assert got[1]["parsed"]["error"] and got[2]["parsed"]["error"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("s_a_1",), ("s_b_1",), ("s_a_2",), ("s",)], "k string")
    assert report.distinct_names(df, "k").first()["n_names"] == 2
    a, b = (spark.createDataFrame([(t,)], "text string") for t in ("A b c", "b d"))
    assert tuple(report.vocabulary_overlap(a, b).first()) == (3, 2, 1, 33.33)


def test_grid_and_errors(spark):
    rows = [(i, "in principio erat".split()) for i in range(6)] + [(9, [])]
    df = spark.createDataFrame(rows, "i int, words array<string>").withColumn("text", F.array_join("words", " "))
    got = {(r["algorithm"], r["scheme"], r["metric"]): r["value"] for r in benchmark.grid(df, df, ["i"], [("STANDARD", 1), ("HIERARCHICAL", 3, "quadri")]).collect()}
    # an empty verse scores accuracy 1 and nothing else, and is no error
    for key in (("STANDARD", "binary"), ("HIERARCHICAL", "quadri")):
        assert got[(*key, "boundary_accuracy")] == 1.0 and got[(*key, "boundary_f1")] == 6 / 7 and got[(*key, "n_errors")] == 0.0
    with pytest.raises(ValueError):
        benchmark.make_segmenter("STANDARD", df, scheme="other")


def test_verses_without_an_answer_are_errors(spark):
    class Half(decode.Segmenter):
        def segment(self, df, keys, text_col="text"):
            return df.where("i % 2 = 0").select(*keys, F.array(text_col).alias("words"))

    df = spark.createDataFrame([(i, ["ab", "c"]) for i in range(5)], "i int, words array<string>").withColumn("text", F.array_join("words", " "))
    rows = benchmark.evaluate(Half(), df, ["i"])
    assert {r["i"]: r["error"] for r in rows.collect()} == {0: None, 1: "no answer", 2: None, 3: "no answer", 4: None}
    got = {r["metric"]: r["value"] for r in report.macro_average(rows).collect()}
    assert got["n_errors"] == 2.0 and got["predicted_words"] == 1.0


def test_benchmark_run(spark, tmp_path):
    """From files to files: train and test apart, four labels, noisy texts joined by key, models saved and loaded."""
    verse = "in principio erat verbum et"
    book = lambda t, n: {"Ioh": {"1": {str(k): t for k in range(1, n + 1)}}}
    for name, t, n in (("train", verse, 9), ("test", verse, 3), ("noisy", verse.replace("principio", "prncipio"), 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps(book(t, n)))
    file = lambda n: str(tmp_path / f"{n}.json")
    args = lambda *more: benchmark.arguments(["--language", "lat", "--corpus", file("test"), "--out", str(tmp_path / "out"), *more])
    assert args("--algorithm", "STANDARD").annotation == "binary"
    with pytest.raises(ValueError):
        benchmark.run(spark, args("--algorithm", "STANDARD"))
    assert benchmark.run(spark, args("--algorithm", "STANDARD", "--annotation", "quadri", "--train", file("train"))) == {"verses": 3, "errors": 0}
    assert benchmark.run(spark, args("--algorithm", "HIERARCHICAL", "--beam", "3", "--train", file("train"), "--noisy", file("noisy"))) == {"verses": 2, "errors": 0}
    scores = {r["metric"]: float(r["value"]) for r in spark.read.option("header", True).csv(str(tmp_path / "out/lat_quadri_STANDARD_1.csv")).collect()}
    assert scores["word_f1"] == 1.0
    assert spark.read.text(str(tmp_path / "out/lat_STANDARD_quadri_1_segments.txt")).count() == 3
    assert [json.loads(r["value"])["errors"] for r in spark.read.text(str(tmp_path / "out/log")).collect()] == [0, 0]
    paths = benchmark.model_table(str(tmp_path / "models"))["lat", "quadri"]
    words = corpus.read_nested(spark, file("train")).withColumn("words", text.words("text"))
    decode.ContextModel.fit(words, scheme="quadri").save(paths["contexts"])
    decode.WordModel.fit(words).save(paths["words"])
    assert benchmark.run(spark, args("--algorithm", "HIERARCHICAL", "--annotation", "quadri", "--models", str(tmp_path / "models")))["errors"] == 0
    with pytest.raises(ValueError):
        benchmark.run(spark, args("--algorithm", "STANDARD", "--models", str(tmp_path / "absent")))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Un test")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["labels"] == list("IEIIIE")
