import ast
import json
import warnings

import pytest
from pyspark.sql import functions as F

from wordloom.operators import decode
from wordloom.plans import noise_levels
from wordloom.sources import corpus, transcriptions


def test_fetch(spark, tmp_path):
    (tmp_path / "20001.xml").write_text("<TEI>α</TEI>", encoding="utf-8")
    (tmp_path / "20002.xml").write_text("No transcription available")
    got = {r["ms_id"]: r for r in transcriptions.fetch(spark, ["20001", "20002", "20003"], f"file://{tmp_path}/{{id}}.xml", absent="No transcription", idsPerTask=2).collect()}
    assert got["20001"]["xml"] == "<TEI>α</TEI>" and got["20001"]["error"] is None
    assert got["20002"]["xml"] is None and got["20002"]["error"] == "no transcription"
    assert got["20003"]["xml"] is None and got["20003"]["error"]
    assert transcriptions.fetch(spark, [], f"file://{tmp_path}/{{id}}.xml").count() == 0


def test_models_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(i, "in principio erat".split()) for i in range(6)], "i int, words array<string>")
    decode.ContextModel.fit(df).save(str(tmp_path / "c"))
    decode.WordModel.fit(df).save(str(tmp_path / "w"))
    segmenter = decode.HierarchicalSegmenter(decode.ContextModel.load(spark, str(tmp_path / "c")), decode.WordModel.load(spark, str(tmp_path / "w")), 3)
    found = segmenter.segment(df.select("i", F.array_join("words", "").alias("text")), ["i"])
    assert [r["words"] for r in found.collect()] == [["in", "principio", "erat"]] * 6


def test_segments_read_as_python(spark, tmp_path):
    rows = [(["in", "it's"], "in it's"), (['a"b'], "c\\d\ne"), (["it's \"x\""], None), (None, "")]
    corpus.write_segments(spark.createDataFrame(rows, "words array<string>, text string").coalesce(1), str(tmp_path / "s"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert sorted(map(ast.literal_eval, lines)) == sorted((w or [], t or "") for w, t in rows)


def test_noise_levels(spark, tmp_path):
    words = "lorem ipsum dolor sit amet"
    (tmp_path / "lat.json").write_text(json.dumps({"m": {"1": {"1": words, "2": ""}}}))
    (tmp_path / "lat_pairs").mkdir()
    (tmp_path / "lat_pairs" / "p1r_gt.txt").write_text(words)
    (tmp_path / "lat_pairs" / "p1r.txt").write_text(words.replace("m", "n"))
    noisy = noise_levels.corrupt_language(spark, "lat", str(tmp_path / "lat.json"), str(tmp_path / "lat_pairs"), str(tmp_path / "out"))
    got = {(r["level"], r["verse"]): r["text"] for r in noisy.collect()}
    assert {k for k, _ in got} == set(corpus.NOISE_LEVELS["lat"]) and got[("mild", "2")] == ""
    assert all(len(got[(k, "1")]) == len(words.replace(" ", "")) for k in corpus.NOISE_LEVELS["lat"])
    assert corpus.read_distributions(spark, str(tmp_path / "out/distributions")).where("kind = 'substitutions'").first()["key"] == "n"


@pytest.mark.parametrize("folder", ["absent_pairs", "empty_pairs"])
def test_noise_levels_skip_what_is_missing(spark, tmp_path, folder):
    (tmp_path / "lat.json").write_text(json.dumps({"m": {"1": {"1": "a"}}}))
    (tmp_path / "empty_pairs").mkdir()
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert noise_levels.corrupt_language(spark, "lat", str(tmp_path / "lat.json"), str(tmp_path / folder), str(tmp_path / "out")) is None
    assert any("skipped" in str(w.message) for w in seen)
