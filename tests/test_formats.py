"""Nested JSON read in ranges, the published layout of noise tables, and the word error rate."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators import noise
from wordloom.sources import corpus

ODD = ["", "plain", 'a "quoted" word', "back\\slash", "ends with \\", '\\"', "{braces} [and] : colons,", "ä λόγος 😀", "tab\tnew\nline", "\\\\\"}", " " * 50, "long " * 400]


def nested(seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(ODD) + str(rng.randint(0, 10**6))
    return {name(): {name(): {name(): rng.choice(ODD) for _ in range(rng.randint(0, 9))} for _ in range(rng.randint(0, 5))} for _ in range(rng.randint(0, 6))}


def rows_of(df):
    return [tuple(r) for r in df.orderBy("pos").select("book", "chapter", "verse", "text").collect()]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "indent", "escaped"), [(0, None, True), (1, 4, False), (2, None, False), (3, 1, True)])
def test_ranges_give_the_same_verses(spark, tmp_path, monkeypatch, small_ranges, seed, indent, escaped):
    data, path = nested(seed), str(tmp_path / "c.json")
    with open(path, "w") as f:
        json.dump(data, f, indent=indent, ensure_ascii=escaped)
    want = [(b, c, v, t) for b, cs in data.items() for c, vs in cs.items() for v, t in vs.items()]
    monkeypatch.setattr(corpus, "STRETCH", 5)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    for size in ("97", "1000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert rows_of(corpus.read_nested_split(spark, path)) == want
    assert sorted(rows_of(corpus.read_nested(spark, path))) == sorted(want)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    assert spark.read.option("lineSep", '"').text(path).rdd.getNumPartitions() > 3


def test_ranges_of_odd_files(spark, tmp_path):
    cases = {"{}": [], '{"b": {}}': [], '{"b": {"1": {"1": null, "2": 7, "3" : "x" , "4":true}}}': [("b", "1", "1", None), ("b", "1", "2", "7"), ("b", "1", "3", "x"), ("b", "1", "4", "true")]}
    for i, (content, want) in enumerate(cases.items()):
        path = tmp_path / f"{i}.json"
        path.write_text(content)
        assert rows_of(corpus.read_nested_split(spark, str(path))) == want


def test_published_layout_of_noise_tables(spark, tmp_path):
    pairs = spark.createDataFrame([("abcab" + text.GAP, "abdx" + text.GAP + "q"), ('a"b', 'a"c')], "gt string, noisy string")
    tables = noise.learn(pairs)
    corpus.write_distributions_nested(tables, str(tmp_path / "d"))
    got = json.loads(next((tmp_path / "d").glob("part-*")).read_text())
    want = {}
    for r in tables.collect():
        if text.GAP not in r["ch"]:
            at = want.setdefault(r["kind"], {})
            if r["key"] is None:
                at[r["ch"]] = r["p"]
            else:
                at.setdefault(r["ch"], {})[r["key"]] = r["p"]
    want.pop("insertions", None)  # only the gap has insertions here
    assert {k: v for k, v in got.items() if v} == want
    back = {tuple(r) for r in corpus.read_distributions_nested(spark, str(tmp_path / "d")).collect()}
    assert back == {tuple(r) for r in tables.collect() if text.GAP not in r["ch"]}
    (tmp_path / "e.json").write_text('{"conditional": {"a": {"delete": 0.5, "correct": 0.5}}}')
    assert sorted(tuple(r) for r in corpus.read_distributions_nested(spark, str(tmp_path / "e.json")).collect()) == [("conditional", "a", "correct", 0.5), ("conditional", "a", "delete", 0.5)]


@pytest.mark.parametrize(("cer", "wer"), [(0.05, 1.0), (0.05, 0.2), (0.1, 0.4)])
def test_error_rates_are_reached(spark, cer, wer):
    """Characters go wrong as often as asked, and only in the asked share of words."""
    letters = "abcdefgh"
    pairs = spark.createDataFrame([("".join(letters[(i + k) % 8] for i in range(800)), "".join(letters[(i + k + (i % 9 == 0)) % 8] for i in range(800))) for k in range(8)], "gt string, noisy string")
    model = noise.NoiseModel(noise.learn(pairs), cer, wer)
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice(letters) for _ in range(10)) for _ in range(40))) for k in range(100)] + [(100, ""), (101, None), (102, " a  b ")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("noisy", model.generate("t", F.col("k")))
    words = errors = wrong = 0
    for r in df.collect():
        if not r["t"] or r["k"] == 102:
            assert r["noisy"] is None if r["t"] is None else len(r["noisy"]) == len(r["t"])
            continue
        for a, b in zip(r["t"].split(" "), r["noisy"].split(" "), strict=True):
            e = sum(x != y for x, y in zip(a, b, strict=True))
            words, errors, wrong = words + 1, errors + e, wrong + (e > 0)
    assert errors / (10 * words) == pytest.approx(cer, rel=0.1)
    inside = cer / wer
    assert wrong / words == pytest.approx(wer * (1 - (1 - inside) ** 10), rel=0.1)
