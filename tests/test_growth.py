"""Steps whose cost must grow no faster than their input: draws, distances, splits, counts and sums."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wordloom.functions import labels, scores, text
from wordloom.operators import align, bayesian, decode, ngram, noise, trained
from wordloom.plans import benchmark, registry
from wordloom.sources.scratch import Scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("longest", [12, 70])
def test_draws_are_md5(longest):
    rng = random.Random(3)
    keys = [None, "", *("é" * rng.randint(0, longest // 2) for _ in range(40))]
    rows, places = np.array([rng.randrange(len(keys)) for _ in range(3000)]), np.array([rng.choice([0, 9, 10, 99, 100, rng.randrange(10**6)]) for _ in range(3000)])
    got = noise.digests(noise.prefixes(7, keys), rows, places)
    for i, (r, x) in enumerate(zip(rows.tolist(), places.tolist(), strict=True)):
        whole = hashlib.md5("|".join(["7", *([] if keys[r] is None else [keys[r]]), str(x)]).encode()).hexdigest()
        assert "".join(f"{int(n):08x}" for n in got[:, i]) == whole


def test_distance_of_long_texts():
    rng = random.Random(5)
    a = "".join(rng.choice("etaoinsé") for _ in range(4000))
    b = "".join(c if rng.random() > 0.2 else rng.choice(["", "x", c + "t"]) for c in a)
    x, y = align.align(a, b)
    assert x.replace("⌀", "") == a and y.replace("⌀", "") == b and align.distance(a, b) == sum(p != q for p, q in zip(x, y, strict=True)) == align.distance(b, a)
    assert [align.distance(*p) for p in (("", ""), ("abc", ""), ("abc", "abc"), ("xab", "aby"), ("kitten", "sitting"))] == [0, 3, 0, 2, 3]


def test_boundaries_of_empty_and_missing(spark):
    df = spark.createDataFrame([(0, ["a", "", "bc"]), (1, []), (2, None), (3, ["ab", "c", "😀d", "e"])], "i int, w array<string>")
    assert [r[0] for r in df.orderBy("i").select(scores.boundaries("w")).collect()] == [[1], [], None, [2, 3, 5]]


def test_split_reads_rows_once(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    out = decode.exact_split(df, "k")
    assert "Union" not in plan(out) and out.where("is_train").count() == 4000


def test_grams_are_summed_over_batches():
    run = ngram._counter(6, 128, 64)
    batch = pa.RecordBatch.from_arrays([pa.array(["\x02" + "abc " * 60 + "\x03"] * 3)], names=["t"])
    out = list(run(iter([batch] * 4)))
    assert len(out) == 1 and sum(out[0].column(1).to_pylist()) == 12 * (242 - 5 + 4)


def test_sent_word_model_needs_no_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["a", "b", "a", "c"][: i % 5]) for i in range(60)], "i int, words array<string>")
    sent = decode.WordModel.fit(df).perplexity(df, ["i"])
    assert "Join" not in plan(sent)
    monkeypatch.setattr(decode, "SENT_BYTES", 0)
    joined = decode.WordModel.fit(df).perplexity(df, ["i"])
    got, want = ({r["i"]: (r["n"], pytest.approx(r["nll"])) for r in x.collect()} for x in (sent, joined))
    assert got.keys() == want.keys() and len(got) == 48 and all(got[k] == want[k] for k in got)


def test_contexts_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(decode, "SENT_BYTES", 0)
    df = spark.createDataFrame([(i, ["ab", "c", "abc"][: i % 4], "abcabc"[: i % 7]) for i in range(40)], "i int, words array<string>, text string")
    model = decode.ContextModel.fit(df)
    found = model.label(df, ["i"], "text")
    assert "count(" not in plan(model.counts) and "Scan parquet" in plan(model.counts)
    monkeypatch.setattr(decode, "SENT_BYTES", 1 << 20)
    sent = decode.ContextModel.fit(df).label(df, ["i"], "text")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sent.collect()))


def test_code_points_need_no_digits(spark):
    t = "aé語😀\x02\uffff𝔊 "
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(labels.code_points("t").alias("c"))
    assert "hex(" not in plan(df) and [r["c"] for r in df.collect()] == [[ord(c) for c in t], [], None]


def test_trained_steps_without_sorting(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(12))) for _ in range(60)]
    lengths = [max(0, len(t) - rng.randrange(3)) for t in texts]
    rows = trained.features_of(texts, lengths)
    assert (rows == np.concatenate([trained.features(t)[:n] for t, n in zip(texts, lengths, strict=True)])).all() and len(trained.features_of([], [])) == 0
    y, room = np.arange(len(rows)) % 2, trained.Room(trained.FEATURES)
    monkeypatch.setattr(np, "unique", None)
    weights, squares = np.zeros((2, trained.FEATURES, 2), np.float32)
    for _ in range(3):
        trained.descend(weights, squares, rows, y, room)
    assert set(np.flatnonzero(squares.any(axis=1))) == set(rows.ravel().tolist())


def test_unsupervised_over_all_cores(spark):
    df = spark.createDataFrame([(i, "thecatsatonthemat"[i % 5 :]) for i in range(40)], "k int, text string").coalesce(1)
    model = bayesian.BayesianSegmenter().train(df, epochs=2)
    assert model.segment(df, ["k"]).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_letters_are_asked_for_once(monkeypatch):
    asked, letter = [], bayesian.Letters.letter
    monkeypatch.setattr(bayesian.Letters, "letter", lambda self, gram: asked.append(gram) or letter(self, gram))
    letters = bayesian.Letters({"the": 1, "cat": 1}, 3, 26, 0.5, 2.0, 3.0)
    model = bayesian.PitmanYor({"the": 2, "cat": 1}, {("the", "cat"): 1}, letters, (0.5, 0.5), (2.0, 2.0), 10)
    assert "".join(model.split("thecatthecat", random.Random(1))) == "thecatthecat"
    assert len(asked) == len(set(asked)) and letters.log_letter("the") == np.log(letter(letters, "the"))


def test_scores_of_batches():
    rng = random.Random(4)
    some = lambda: None if rng.random() < 0.1 else [rng.choice(["", "a", "b", "é😀", "abc"]) for _ in range(rng.randrange(7))]
    t, p = [some() for _ in range(300)], [some() for _ in range(300)]
    given = [None if rng.random() < 0.1 else [rng.randrange(6) for _ in range(rng.randrange(5))] for _ in range(300)]
    ends = lambda words: {len("".join(words[:i])) for i in range(1, len(words))}
    ratio = lambda a, b: a / b if b else 0.0

    def one(t, p, e, n):
        f1 = lambda a, b: ratio(2 * (a * b), a + b)
        tp, both, same = len(e & ends(p)), len(set(t) & set(p)), sum(a == b for a, b in zip(t, p, strict=False))
        b, w = (ratio(tp, len(ends(p))), ratio(tp, len(e))), (ratio(both, len(set(p))), ratio(both, len(set(t))))
        return (tp / n if n else 1.0, *b, f1(*b), *w, f1(*w), ratio(same, len(t)), len(t), len(p), both, same)

    a, b, c = (pa.array(x, k) for x, k in ((t, pa.list_(pa.string())), (p, pa.list_(pa.string())), (given, pa.list_(pa.int32()))))
    for cells, want in (
        (scores.measures(a, b), [one(x or [], y or [], ends(x or []), len(ends(x or []))) for x, y in zip(t, p, strict=True)]),
        (scores.measures(a, b, c), [one(x or [], y or [], set(e or []), len(e or [])) for x, y, e in zip(t, p, given, strict=True)]),
        (scores.measures(a[7:90], b[7:90]), [one(x or [], y or [], ends(x or []), len(ends(x or []))) for x, y in zip(t[7:90], p[7:90], strict=True)]),
        (scores.measures(a[:0], b[:0]), []),
    ):
        assert [tuple(r) for r in zip(*(x.tolist() for x in cells), strict=True)] == want


def test_boundary_scores_in_batches(spark):
    df = spark.createDataFrame([(0, [1, 3], [3, 4]), (1, [], None), (2, None, [1]), (3, [2, 2], [2]), (4, [], [5])], "i int, e array<int>, p array<int>")
    out = df.orderBy("i").select(scores.boundary_scores("e", "p").alias("s"))
    assert "array_intersect" not in plan(out)
    assert [tuple(r.s) for r in out.collect()] == [(0.5, 0.5, 0.5, 0.5, 1, 1, 1), (1.0, 0.0, 0.0, 0.0, None, None, None), (0.0, 0.0, 0.0, 0.0, None, None, None), (0.5, 1.0, 1.0, 1.0, 1, 0, 0), (1.0, 0.0, 0.0, 0.0, 0, 1, 0)]


def test_marks_go_character_by_character(spark, monkeypatch):
    # the last two marks are put in order and stay, which only the whole text shows
    t = ["ἄνθρωπος é", "a\u0323\u0301\u0345", "가각", "x\u302e\U0001d165y", "ascii", "", None]
    want = [None if x is None else text.strip_marks(x) for x in t]
    asked, whole = [], text.strip_marks
    monkeypatch.setattr(text, "strip_marks", lambda x: asked.append(x) or whole(x))
    table = text._Unmarked()
    assert [None if x is None else table.strip(x) for x in t * 2] == want * 2 and len(asked) < len(set("".join(x or "" for x in t))) + 3
    df = spark.createDataFrame(list(enumerate(t)), "i int, t string")
    assert [r.x for r in df.orderBy("i").select(text.remove_diacritics("t").alias("x")).collect()] == want


def test_rebuilding_in_batches(spark):
    df = spark.createDataFrame([(0, "abc", [0, 1, 3, 1]), (1, "\xa0a😀b ", [0, 1, 2, 3]), (2, "", [1]), (3, None, [1]), (4, "a", None), (5, "ab", [None, 1])], "i int, t string, l array<int>")
    out = df.orderBy("i").select(labels.rebuild("t", "l").alias("x"))
    assert "zip_with" not in plan(out) and [r.x for r in out.collect()] == ["ab c", "a 😀b", "", None, None, "ab"]


@pytest.mark.parametrize("name, step", [("tei_documents", "regexp_replace(translate("), ("dict_form_verses", "to_json(array(")])
def test_lines_are_cleaned_and_quoted_at_once(spark, name, step):
    analyzed = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert step + "text" in analyzed and step + "lambda" not in analyzed


@pytest.mark.parametrize("scheme", ["binary", "quadri"])
def test_best_labels_are_sent_where_counts_are_too_many(spark, monkeypatch, scheme):
    rng = random.Random(6)
    words = [["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(40)] for _ in range(300)]
    df = spark.createDataFrame([(i, w, "".join(w) + "é" * (i % 2)) for i, w in enumerate(words)], "i int, words array<string>, text string")
    sent = decode.ContextModel.fit(df, scheme=scheme)
    full = sent.tables()
    few = sent.verdicts()
    assert sum(map(len, few.numbers)) < sum(map(len, full.numbers))
    size = sum(map(len, full.numbers)) * 12
    assert sent.sent()
    want = sent.label(df, ["i"], "text", None).collect()
    monkeypatch.setattr(decode, "COUNTED_SHARE", 1)
    monkeypatch.setattr(decode, "SENT_BYTES", size - 1)
    model = decode.ContextModel.fit(df, scheme=scheme)
    segmenter = decode.StandardSegmenter(model, None)
    assert not model.sent() and segmenter.one_row
    found = segmenter.segment(df, ["i"])
    assert "Join" not in plan(found)
    assert sorted((r["i"], " ".join(r["words"])) for r in found.collect()) == sorted((r["i"], r["candidate"]) for r in want)


@pytest.mark.parametrize("scheme", ["binary", "quadri"])
def test_contexts_are_counted_by_numbers(monkeypatch, scheme):
    rng = random.Random(8)
    monkeypatch.setattr(decode.ContextCounts, "WIDE", 9)
    monkeypatch.setattr(decode.ContextCounts, "SOME", 50)
    monkeypatch.setattr(decode.ContextCounts, "ROWS", 7)
    texts = [["".join(rng.choice("abc語😀é" if i % 3 else "abcdefghi") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(6))] for i in range(60)]
    want = {}
    for words in texts:
        t = "\x02" * 3 + "".join(words) + "\x03" * 3
        marks = "".join("I" * (len(w) - 1) + "E" if scheme == "binary" else "S" if len(w) == 1 else "B" + "I" * (len(w) - 2) + "E" for w in words)
        for i, y in enumerate(marks):
            row = want.setdefault(t[i : i + 7], [0] * len(decode.SIGNS[scheme]))
            row[0] += 1
            if k := decode.SIGNS[scheme].index(y):
                row[k] += 1
    counts, names = decode.ContextCounts(scheme), ["context", "n", "e", "b", "s"][: 1 + len(decode.SIGNS[scheme])]
    got = {}
    for lo in range(0, 60, 10):
        some = texts[lo : lo + 10]
        counts.add(["".join(w) for w in some], pa.array([[len(x) for x in w] for w in some], pa.list_(pa.int32())))
        if lo == 30:
            out = list(counts.rows(names))
    for batch in [*out, *counts.rows(names)]:
        for r in batch.to_pylist():
            row = got.setdefault(r["context"], [0] * (len(names) - 1))
            got[r["context"]] = [a + r[c] for a, c in zip(row, names[1:], strict=True)]
    assert got == want


def test_lines_need_no_pattern(spark):
    assert "ArrowEvalPython" in plan(registry.verses_of(spark, DATA))


@pytest.mark.parametrize("name", ["segment_standard", "segment_hierarchical"])
def test_whole_lines_are_segmented(spark, name):
    found = registry.QUERIES[name](spark, DATA).join(registry.QUERIES["verses"](spark, DATA), ["doc_id", "line"])
    kept = found.agg(F.count("*").alias("n"), F.max(F.length("plain")).alias("longest"), F.count_if(F.replace("segmented", F.lit(" "), F.lit("")) != F.lower("plain")).alias("cut")).first()
    assert kept["n"] > 0 and kept["longest"] > 126 and kept["cut"] == 0


def test_held_out_lines_are_scored_whole(spark):
    assert "126" not in registry.SQL["held_out_scores"]
    truth = decode.exact_split(registry.verses_of(spark, DATA), F.concat_ws("|", "doc_id", "line")).where("not is_train")
    words = truth.agg(F.avg(F.size("words"))).first()[0]
    got = {r["metric"]: r["value"] for r in registry.QUERIES["held_out_scores"](spark, DATA).collect()}
    assert got["predicted_words"] > 0.8 * words  # the beginnings alone hold less than half of the words


@pytest.mark.parametrize("labels_n", [2, 4])
def test_best_sequences_by_price(labels_n):
    rng = random.Random(2)
    for i in range(400):
        n, k = rng.randrange(7), rng.randrange(1, 9)
        draw = (lambda: rng.random() + 0.01) if i % 2 else (lambda: rng.choice([1, 1, 2]))
        p = np.array([draw() for _ in range(n * labels_n)], float).reshape(n, labels_n)
        p = p / p.sum(axis=1, keepdims=True)
        got, want = decode.k_best_labels(decode._logs(p), k), decode.k_best_sequences(p.tolist(), k)
        assert [x for x, _ in got] == pytest.approx([x for x, _ in want]) and len({tuple(seq) for _, seq in got}) == len(got)
        for score, seq in got:
            assert score == pytest.approx(sum(np.log(p[j, y]) for j, y in enumerate(seq)))
        if i % 2:
            assert [seq for _, seq in got] == [seq for _, seq in want]


@pytest.mark.parametrize("room", [0, 32 * 15])
def test_pairs_are_judged_once_for_all_candidates(spark, monkeypatch, room):
    rng = random.Random(12)
    words = [[rng.choice(["a", "b", "ab", "ba", "bab", "é"]) for _ in range(rng.randrange(9))] for _ in range(80)]
    df = spark.createDataFrame([(i, w, "".join(w)) for i, w in enumerate(words)], "i int, words array<string>, text string")
    other = df.select("i", F.concat("words", F.array(F.lit("stranger"), F.lit("a"))).alias("words"))
    make = lambda weight: decode.HierarchicalSegmenter(decode.ContextModel.fit(df), decode.WordModel.fit(df), 3, None, weight).segment(df, ["i"])
    sums = lambda d, **how: {r["i"]: (r["n"], pytest.approx(r["nll"])) for r in decode.WordModel.fit(df).perplexity(d, ["i"], **how).collect()}
    want = [{r["i"]: r["words"] for r in make(weight).collect()} for weight in (None, 0.5)], sums(df), sums(other)
    monkeypatch.setattr(decode, "SENT_BYTES", room)
    model = decode.WordModel.fit(df)
    assert model.prepare(spark) is None and len(model.frequent().value.numbers) <= room // 32 and bool(room) == bool(len(model.frequent().value.numbers))
    found = make(None)
    assert plan(found).count("MapInArrow") <= 1  # candidates are written, and their pairs are read once
    assert ([{r["i"]: r["words"] for r in x.collect()} for x in (found, make(0.5))], sums(df), sums(other)) == want
    assert sums(df, seen=True) == want[1]


def test_pairs_are_counted_by_numbers(monkeypatch):
    monkeypatch.setattr(decode, "COUNTED", 2)
    rng = random.Random(3)
    texts = [[rng.choice("abcdé") for _ in range(rng.randrange(5))] for _ in range(40)]
    want = {}
    for w in texts:
        for pair in zip(["", *w], w, strict=False):
            want[pair] = want.get(pair, 0) + 1
    got = {}
    for b in decode._count_pairs(pa.RecordBatch.from_arrays([pa.array(texts[i : i + 8], pa.list_(pa.string()))], names=["words"]) for i in range(0, 40, 8)):
        for r in b.to_pylist():
            got[r["before"], r["word"]] = got.get((r["before"], r["word"]), 0) + r["n"]
    assert got == want


def test_grid_writes_its_texts_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["ab", "c", "abc"][: 1 + i % 3]) for i in range(30)], "i int, words array<string>").withColumn("text", F.array_join("words", " "))
    made = lambda: {tuple(r)[:-1]: pytest.approx(r["value"]) for r in benchmark.grid(df, df, ["i"], [("STANDARD", 1), ("HIERARCHICAL", 3)]).collect()}
    want, settle, names = made(), Scratch.settle, []
    monkeypatch.setattr(Scratch, "settle", lambda self, d: names.append(self.dir.rsplit("/", 1)[1].split("-")[0]) or settle(self, d))
    assert made() == want and "test" not in names
    monkeypatch.setattr(decode, "SENT_BYTES", 0)
    assert made() == want and names.count("test") == 1
