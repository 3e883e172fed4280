"""Documents in dict form, manuscripts fetched, parsed and added, and the alignment report."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions import labels
from wordloom.sources import corpus, tei, transcriptions


def test_text_of_nested_objects():
    node = {"@n": "no text", "ab": [{"w": "one"}, {"w": {"unclear": "two", "#text": "never"}}, {"seg": {"#text": "three", "deep": [{"w": "four"}, "loose"]}}], "#text": "five"}
    assert tei.collect_text(node) == ["one", "two", "three", "four", "five"]
    assert tei.collect_text("alone") == [] and tei.collect_text([]) == []


def test_original_words_of_readings():
    node = [{"rdg": [{"@type": "orig", "w": "a"}, {"@type": "corr", "w": "b"}, {"@type": "orig", "w": {"#text": "c"}}, {"@type": "orig"}], "seg": {"rdg": [{"@type": "orig", "w": "beside"}]}}, {"x": {"y": [{"rdg": [{"@type": "orig", "w": "d"}]}]}}, 7, None]
    assert tei.original_words(node) == ["a", "c", "d"]


def document(*divs):
    return json.dumps({"TEI": {"text": {"body": {"div": {"div": list(divs)}}}}}, ensure_ascii=False)


def test_dict_verses(spark):
    supplied = {"supplied": {"#text": "x"}}
    rows = [
        (1, document("text", {"head": "no ab"}, {"ab": {"@n": "B04K1V1", "w": ["not a list of ab"]}}, {"ab": [{"@n": "B04K1V1", "w": ["en", "ar\nche", supplied, {"unclear": "gone"}]}, None, "loose", {"w": ["no n"]}, {"@n": "B04K1V2"}, {"@n": "B04K1V1", "w": ["again"], "app": {"rdg": [{"@type": "orig", "w": "ho"}, {"@type": "orig", "w": "lo\ngos"}]}}]})),
        (2, document({"ab": [{"@n": "Luke.3.04", "w": ["λόγος", "é😀"]}]})),
        (3, "{broken"),
        (4, None),
        (5, '{"TEI": 5}'),
    ]
    got = tei.dict_verses(spark.createDataFrame(rows, "pos int, json string").withColumnRenamed("pos", "doc"), ["doc"]).orderBy("doc", "pos").collect()
    assert [(r["doc"], r["chapter"], r["verse"], r["text"]) for r in got] == [(1, "1V1", "1", "en arche SUPPLIEDagain ho logos "), (1, "1V2", "2", ""), (2, "3", "4", "λόγος é😀 ")]
    texts = spark.createDataFrame([('{"w": ["a", {"#text": "b"}], "x": {"#text": "c"}}',), ("no json",), (None,)], "j string").select(tei.texts_of("j").alias("t")).collect()
    assert [r["t"] for r in texts] == [['["a", {"#text": "b"}]', "c"], None, None]


XML = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><title n="{0}"/><div type="book" n="B20"><div type="chapter" n="B20K3"><ab n="B20K3V1"><w>en</w><w>{0}</w></ab></div></div></TEI>'


def test_extraction_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A repeated run adds only what is missing, ids stay with what was fetched for them, failures are tried again."""
    for i in ("10001", "10003", "10004"):
        (tmp_path / f"{i}.xml").write_text(XML.format(f"ms{i}"))
    (tmp_path / "10005.xml").write_text("<broken")
    (tmp_path / "10006.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><title n="empty"/></TEI>')
    out, template = str(tmp_path / "out"), f"file://{tmp_path}/{{id}}.xml"
    asked, real = [], transcriptions.fetch
    monkeypatch.setattr(transcriptions, "fetch", lambda spark, ids, *a, **k: asked.append(list(ids)) or real(spark, ids, *a, **k))
    ids = ["10001", "10002", "10003", "10005", "10006"]
    got = {(r["ms_id"], r["title"], r["text"]) for r in transcriptions.extract(spark, ids, template, out, block=2).collect()}
    assert got == {("10001", "ms10001", "en ms10001"), ("10003", "ms10003", "en ms10003"), ("10006", "empty", None)}
    assert asked == [["10001", "10002"], ["10003", "10005"], ["10006"]]
    assert {r["ms_id"] for r in spark.read.json(f"{out}/failures").collect()} == {"10002", "10005"}
    asked.clear()
    (tmp_path / "10002.xml").write_text(XML.format("late"))
    more = transcriptions.extract(spark, [*ids, "10004"], template, out, block=2)
    assert asked == [["10002", "10005"], ["10004"]] and more.groupBy("ms_id").count().where("count > 1").count() == 0
    assert {r["title"] for r in more.collect()} == {"ms10001", "late", "ms10003", "ms10004", "empty"}
    corpus.write_nested(transcriptions.as_corpus(more), str(tmp_path / "nested"))
    books = [b for b, in corpus.read_nested_split(spark, str(tmp_path / "nested/*.txt")).select("book").distinct().collect()]
    assert sorted(books) == ["10001", "10002", "10003", "10004"]


@pytest.mark.parametrize("n", [0, 3, 126, 200])
def test_alignment_report(spark, n):
    df = spark.createDataFrame([(1, "x" * n, [1] * n)], "k int, text string, label_ids array<int>")
    got = [tuple(r) for r in labels.alignment_report(df, ["k"]).orderBy("place").select("place", "token", "label").collect()]
    k = min(n, 126)
    assert got == [(0, "[CLS]", -100), *[(i + 1, "x", 1) for i in range(k)], (k + 1, "[SEP]", -100)]
    assert labels.alignment_report(df, ["k"]).where(F.col("token") == "[SEP]").count() == 1


def test_all_corpora_are_annotated(spark, tmp_path):
    from wordloom.plans import annotation

    (tmp_path / "sblgnt.json").write_text(json.dumps({"John": {"1": {"1": "En arche", "2": "houtos"}}}))
    (tmp_path / "vulgata.json").write_text(json.dumps({"Ioannes": {"1": {"1": "in principio"}}}))
    with pytest.warns(UserWarning, match="seals is skipped"):
        got = annotation.annotate_corpora(spark, str(tmp_path), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {("grc", "binary", 2, 0), ("grc", "quadri", 2, 0), ("lat", "binary", 1, 0), ("lat", "quadri", 1, 0)}
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out/vulgata-quadri")).collect()) == ["inprincipio - ['B', 'E', 'B', 'I', 'I', 'I', 'I', 'I', 'I', 'I', 'E'] - in principio"]
    assert spark.read.text(str(tmp_path / "out/sblgnt-binary")).count() == 2
