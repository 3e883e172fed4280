import itertools
import math
import random
import types
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.functions import labels, scores, text
from wordloom.operators import align, decode, noise, report
from wordloom.operators.bayesian import BayesianSegmenter, Letters, PitmanYor
from wordloom.sources import corpus


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def brute_rebuild(t, ids):
    return "".join(c + " " * (i in (1, 3)) for c, i in zip(t, ids, strict=False)).strip()


def test_rebuild(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("aβ語😀") for _ in range(rng.randint(0, 9))), [rng.randrange(4) for _ in range(rng.randint(0, 9))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t string, l array<int>")
    assert {r["k"]: r["x"] for r in df.select("k", labels.rebuild("t", "l").alias("x")).collect()} == {k: brute_rebuild(t, i) for k, t, i in rows}


def test_annotations(spark):
    w = text.words(F.lit(" un test t "))
    assert "".join(one(spark, labels.binary(w))) == "IEIIIEE"
    assert "".join(one(spark, labels.quadri(w))) == "BEBIIES"
    assert one(spark, labels.ids(labels.quadri(w), "quadri")) == [2, 1, 2, 0, 0, 1, 3]
    with pytest.raises(ValueError):
        labels.annotate("w", "unknown")
    with pytest.raises(Exception, match="unknown label"):
        one(spark, labels.ids(F.array(F.lit("Q"))))


def test_annotated_corpus(spark):
    df = spark.createDataFrame([("b", "1", "1", "Un test"), ("b", "1", "2", "A-b c"), ("b", "2", "1", "")], "book string, chapter string, verse string, text string")
    got = {r["verse_text"]: r for r in corpus.annotated_corpus(df).collect()}
    assert got["Un test"]["text"] == "untest" and got["Un test"]["labels"] == list("IEIIIE") and got[""]["labels"] == []
    with pytest.raises(ValueError):
        corpus.annotated_corpus(df, "unknown")


@pytest.mark.parametrize("n", [0, 1, 125, 126, 127, 300])
def test_token_labels_and_items(spark, n):
    t, ids = "x" * n, [1] * n
    df = spark.createDataFrame([(t, ids)], "t string, l array<int>")
    r = df.select(labels.token_labels("l").alias("a"), labels.item("t", "l").alias("i")).first()
    k = min(n, 126)
    assert r["a"] == [-100] + [1] * k + [-100] * (127 - k)
    assert len(r["i"]["input_ids"]) == 128 and sum(r["i"]["attention_mask"]) == k + 2 and r["i"]["labels"] == r["a"]


def test_windows(spark):
    df = spark.createDataFrame([(list(range(1, 8)),), ([],)], "t array<int>")
    w = [r["w"] for r in df.select(labels.windows("t", 4, 3).alias("w")).collect()]
    assert [x["input_ids"] for x in w[0]] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 0, 0, 0]] and w[1] == []
    assert w[0][2]["attention_mask"] == [1] * 4


def brute_scores(truth, pred):
    cut = lambda w: set(list(itertools.accumulate(map(len, w)))[:-1])
    e, p = cut(truth), cut(pred)
    tp, fp, fn = len(e & p), len(p - e), len(e - p)
    pr, rc = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    both, same = len(set(truth) & set(pred)), sum(a == b for a, b in zip(truth, pred, strict=False))
    wp, wr = both / len(set(pred)) if pred else 0.0, both / len(set(truth)) if truth else 0.0
    f = lambda a, b: 2 * (a * b) / (a + b) if a + b else 0.0
    return [tp / len(e) if e else 1.0, pr, rc, f(pr, rc), wp, wr, f(wp, wr), same / len(truth) if truth else 0.0, len(truth), len(pred), both, same]


def test_scores(spark):
    rng = random.Random(1)
    split = lambda s: "".join(c + " " * (rng.random() < 0.4) for c in s).split()
    rows = [([], []), (["é"], ["é"]), (["ab", "ab"], ["abab"]), (["b"], [])]
    rows += [(split(s), split(s)) for s in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(200))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, words array<string>, predicted array<string>")
    for r in report.score_rows(df, ["i"]).collect():
        assert list(r)[1:] == brute_scores(*rows[r["i"]])


def brute_project(offsets, source, target, ops):
    out = set()
    for x in offsets:
        if x == len(source):
            out.add(len(target))
        for op, s0, s1, t0, t1 in ops:
            if s0 <= x < s1:
                out.add(t0 + x - s0 if op == "equal" else t0 + int((x - s0) / (s1 - s0) * (t1 - t0)) if op == "replace" else t0)
    return sorted(out)


def test_projection(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
    rows = [(i, word(), word()) for i in range(150)] + [(150, "a" * 11, "b" * 55)]
    df = spark.createDataFrame([(i, s, t, list(range(1, len(s)))) for i, s, t in rows], "i int, s string, t string, o array<int>")
    df = df.withColumn("ops", align.script_column(F.col("s"), F.col("t"))).select("i", scores.project("o", "s", "t", "ops").alias("p"))
    for r in df.collect():
        _, s, t = rows[r["i"]]
        assert r["p"] == brute_project(range(1, len(s)), s, t, align.edit_script(s, t))


def brute_align(t, n):
    """The whole table, and the path back: match, substitution, insertion, deletion."""
    d = [[i + j if not i or not j else 0 for j in range(len(n) + 1)] for i in range(len(t) + 1)]
    for i, j in itertools.product(range(1, len(t) + 1), range(1, len(n) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (t[i - 1] != n[j - 1]))
    i, j, out = len(t), len(n), []
    while i or j:
        if i and j and (t[i - 1] == n[j - 1] or d[i][j] == d[i - 1][j - 1] + 1):
            i, j = i - 1, j - 1
            out.append((t[i], n[j]))
        elif j and d[i][j] == d[i][j - 1] + 1:
            j -= 1
            out.append((text.GAP, n[j]))
        else:
            i -= 1
            out.append((t[i], text.GAP))
    return "".join(x for x, _ in out[::-1]), "".join(y for _, y in out[::-1])


@pytest.mark.parametrize("kept", [1, 3, 64])
def test_alignment(monkeypatch, kept):
    """The same path whatever is kept of the table."""
    monkeypatch.setattr(align, "KEPT", kept)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(0, n)))
    for a, b in [(word(9), word(9)) for _ in range(200)] + [(word(150), word(150)) for _ in range(5)] + [("", ""), ("", "ab"), ("ab", "")]:
        assert align.align(a, b) == brute_align(a, b)
    big = ("ab" * 3000, "ba" * 3000)
    g, n = align.align(*big)
    assert g.replace(text.GAP, "") == big[0] and n.replace(text.GAP, "") == big[1] and sum(x != y for x, y in zip(g, n, strict=True)) == 2


@pytest.mark.parametrize("labels_n,k", [(2, 3), (4, 3), (2, 1)])
def test_k_best_is_exact(spark, labels_n, k):
    rng = random.Random(labels_n)
    for _ in range(5):
        p = [[rng.random() for _ in range(labels_n)] for _ in range(6)]
        df = spark.createDataFrame([(p,)], "p array<array<double>>")
        got = df.select(decode.k_best("p", k).alias("b"), decode.best_labels("p").alias("l")).first()
        every = sorted((sum(math.log(x[i]) for x, i in zip(p, s, strict=True)) for s in itertools.product(range(labels_n), repeat=6)), reverse=True)
        assert [b["score"] for b in got["b"]] == pytest.approx(every[:k])
        assert got["l"] == got["b"][0]["seq"]


def test_k_best_in_workers():
    rng = random.Random(5)
    for _ in range(200):
        ends, k = [rng.choice([0.0, 1.0, 0.5, rng.random()]) for _ in range(rng.randint(0, 7))], rng.randint(1, 9)
        every = sorted((sum(math.log(max(p if s else 1 - p, decode.FLOOR)) for p, s in zip(ends, seq, strict=True)) for seq in itertools.product((0, 1), repeat=len(ends))), reverse=True)[:k]
        for found in (decode.k_best_pairs(ends, k), decode.k_best_sequences([[1 - p, p] for p in ends], k)):
            assert [x for x, _ in found] == pytest.approx(every)
            assert len({tuple(s) for _, s in found}) == len(found)
            for x, seq in found:
                assert x == pytest.approx(sum(math.log(max(p if s else 1 - p, decode.FLOOR)) for p, s in zip(ends, seq, strict=True)))


def test_four_labels(spark):
    """Fitted on four labels, found again; the two ways of looking contexts up agree."""
    rows = [(i, "in principio a erat verbum et b verbum erat".split()) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, words array<string>").withColumn("text", F.array_join("words", ""))
    scorer = decode.ContextModel.fit(df, scheme="quadri")
    want = [w for _, w in rows]
    assert [r["words"] for r in decode.StandardSegmenter(scorer).segment(df, ["i"]).collect()] == want
    assert [r["words"] for r in decode.HierarchicalSegmenter(scorer, decode.WordModel.fit(df), 4).segment(df, ["i"]).collect()] == want
    r = scorer.score(df, ["i"], "text").first()
    assert r["best"] == [{"B": 2, "I": 0, "E": 1, "S": 3}[x] for w in rows[0][1] for x in ("S" if len(w) == 1 else "B" + "I" * (len(w) - 2) + "E")]
    assert all(len(p) == 4 and sum(p) == pytest.approx(1) for p in r["probabilities"])
    by_join = scorer._score_by_join(df.select("i", "text"), ["i"], 126).drop("text")
    assert sorted((r["i"], r["best"]) for r in by_join.collect()) == sorted((r["i"], r["best"]) for r in scorer.score(df, ["i"], "text").collect())
    with pytest.raises(ValueError):
        decode.ContextModel.fit(df, scheme="other")


def test_lookup_equals_dictionaries():
    """Random texts of one, two and four-byte characters, with strangers and NUL, against plain dictionaries of all levels."""
    r = random.Random(5)
    make = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    seen = [Counter() for _ in decode.LEVELS]
    for t in [make(r.randint(1, 60), "abé\0\U0001f600") for _ in range(300)]:
        padded = "\x02\x02\x02" + t + "\x03\x03\x03"
        for i in range(len(t)):
            for level, (left, right) in zip(seen, decode.LEVELS, strict=True):
                level[padded[i + 4 - left : i + 4 + right]] += 1
    kept = [{c: n for c, n in level.items() if n >= (decode.LEAST_SEEN if k + 1 < len(seen) else 1)} for k, level in enumerate(seen)]
    rows = [{"k": k, "c": c, "n": n, "e": n // 2} for k, level in enumerate(kept) for c, n in level.items()]
    tables = decode.Tables.build(pa.Table.from_pylist(rows))
    for limit in (None, 10):
        look = decode.Lookup(types.SimpleNamespace(value=tables), "binary", limit)
        for t in ["", "a", "zz", *(make(r.randint(0, 40), "abcé\0\U0001f600") for _ in range(200))]:
            padded = "\x02\x02\x02" + t + "\x03\x03\x03"
            found = lambda i: next((n for level, (a, b) in zip(kept, decode.LEVELS, strict=True) if (n := level.get(padded[i + 4 - a : i + 4 + b]))), 0)  # noqa: B023, E731
            want = [[n, n // 2] for n in (found(i) for i in range(len(t[:limit])))]
            assert look.counts(t).tolist() == want
    empty = decode.Tables.build(pa.table({c: pa.array([], pa.string() if c == "c" else pa.int64()) for c in ("k", "c", "n", "e")}))
    assert decode.Lookup(types.SimpleNamespace(value=empty), "binary", None).counts("ab").tolist() == [[0, 0], [0, 0]]


def test_contexts_too_many_to_send(spark, monkeypatch):
    rows = [(i, "in principio erat verbum".split()) for i in range(6)] + [(9, [])]
    df = spark.createDataFrame(rows, "i int, words array<string>").withColumn("text", F.array_join("words", ""))
    make = lambda: decode.HierarchicalSegmenter(decode.ContextModel.fit(df), decode.WordModel.fit(df), 3).segment(df, ["i"])
    sent = sorted(map(tuple, make().collect()))
    monkeypatch.setattr(decode, "SENT_BYTES", 0)
    assert sorted(map(tuple, make().collect())) == sent and len(sent) == 7 and sent[-1][1] in ([], None)


def test_the_place_after_the_text_shrinks_the_beam(spark):
    df = spark.createDataFrame([(i, ["ab", "cd"]) for i in range(6)], "i int, words array<string>").withColumn("text", F.array_join("words", ""))
    model, words = decode.ContextModel.fit(df), decode.WordModel.fit(df)
    n = [decode.HierarchicalSegmenter(model, words, 4, decode_separator=s).candidates(df, ["i"]).count() for s in (False, True)]
    assert n[1] < n[0]


def test_softmax(spark):
    got = one(spark, decode.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))))
    assert got == [0.5, 0.5, 0.0]


def test_word_model_is_evaluated_on_held_out_texts(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 4, "words array<string>")
    r = decode.WordModel.fit(df).evaluate(spark.createDataFrame([(["a", "b"],), (["x"],), ([],)], "words array<string>")).first()
    assert r["n_words"] == 3 and r["perplexity"] == pytest.approx(math.exp(r["loss"]))


def test_segmenters(spark):
    rows = [(i, "in principio erat verbum et verbum erat".split()) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, words array<string>").withColumn("text", F.array_join("words", ""))
    scorer = decode.ContextModel.fit(df)
    want = [list(w) for _, w in rows]
    assert [r["words"] for r in decode.StandardSegmenter(scorer).segment(df, ["i"]).collect()] == want
    two = decode.HierarchicalSegmenter(scorer, decode.WordModel.fit(df), 3).segment(df, ["i"])
    assert [r["words"] for r in two.collect()] == want
    by_join = scorer._score_by_join(df.select("i", "text"), ["i"], 126).drop("text")
    by_table = scorer.score(df, ["i"], "text").drop("text")
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, by_table.collect()))
    with pytest.raises(NotImplementedError):
        decode.Segmenter().segment(df, ["i"])
    long = spark.createDataFrame([(1, "ab" * 100)], "i int, text string")
    assert len("".join(decode.StandardSegmenter(scorer).segment(long, ["i"]).first()["words"])) == 126
    assert len("".join(decode.StandardSegmenter(scorer, None).segment(long, ["i"]).first()["words"])) == 200


def test_unsupervised(spark):
    train = spark.createDataFrame([("maremontesque",), ("montesmare",), ("",)], "text string")
    s = BayesianSegmenter().train(train, train, epochs=3, print_each_nth_iteration=2)
    assert len(s.losses) == 1 and s.losses[0] > 0
    word = "circumspectantibus"
    model = PitmanYor({word: 1000, "et": 500}, {("", word): 900, (word, "et"): 500}, Letters({word: 1, "et": 1}, 7, 26, 0.5, 2.0, 6.0), (0.5, 0.5), (2.0, 2.0), 30)
    assert model.split(word + "et" + word, None) == [word, "et", word]
    small = PitmanYor({"ab": 3, "a": 2, "b": 1}, {("ab", "a"): 2, ("a", "b"): 1, ("", "ab"): 2}, Letters({"ab": 1, "a": 1, "b": 1}, 3, 2, 0.5, 2.0, 2.0), (0.4, 0.6), (1.0, 1.5), 4)
    for t in ("abab", "aab", "baabab"):  # the most probable of all segmentations
        cuts = itertools.product((0, 1), repeat=len(t) - 1)
        every = ["".join(c + " " * x for c, x in zip(t, [*cut, 0], strict=True)).split() for cut in cuts]
        every = [w for w in every if max(map(len, w)) <= 4]
        assert small.log_likelihood(small.split(t, None)) == pytest.approx(max(map(small.log_likelihood, every)))
        drawn = Counter(tuple(small.split(t, random.Random(k))) for k in range(3000))
        mass = {tuple(w): math.exp(small.log_likelihood(w)) for w in every}
        assert all(abs(drawn[w] / 3000 - m / sum(mass.values())) < 0.04 for w, m in mass.items())
    assert sum(model.probability(b, w) for w in (word, "et") for b in ["et"]) < 1 and s._longest(5.0, 18, 100) >= 18
    got = s.segment(spark.createDataFrame([(1, "silvaemontium"), (2, "")], "k int, text string"), ["k"]).collect()
    assert "".join(got[0]["words"]) == "silvaemontium" and got[1]["words"] == []


def test_unsupervised_finds_words(spark):
    """Better than words of one width, on texts of words that it never saw apart."""
    rng = random.Random(8)
    known = ["".join(rng.choice("aeioulmnrstdc") for _ in range(rng.choice([2, 3, 4, 5, 7]))) for _ in range(25)]
    texts = [[rng.choice(known) for _ in range(rng.randint(4, 9))] for _ in range(150)]
    df = spark.createDataFrame([(i, "".join(w)) for i, w in enumerate(texts)], "k int, text string")
    found = {r["k"]: r["words"] for r in BayesianSegmenter().train(df, epochs=8).segment(df, ["k"]).collect()}
    ends = lambda words: set(itertools.accumulate(map(len, words[:-1])))

    def f1(got):
        tp, n, m = (sum(len(f(ends(got[i]), ends(w))) for i, w in enumerate(texts)) for f in (lambda a, b: a & b, lambda a, b: a, lambda a, b: b))
        return 2 * tp / (n + m)

    fixed = {i: ["".join(w)[j : j + 4] for j in range(0, len("".join(w)), 4)] for i, w in enumerate(texts)}
    assert f1(found) > 0.45 and f1(found) > 1.5 * f1(fixed)


@pytest.mark.parametrize("tables", [2, 1000, 2_500_000])
def test_all_tables_are_drawn(tables):
    """The strength's mean over all tables, however many there are."""
    from wordloom.operators import bayesian

    class Counting:
        def __init__(self):
            self.rng, self.n = np.random.default_rng(5), 0

        def __getattr__(self, name):
            return getattr(self.rng, name)

        def random(self, n):
            self.n += n
            return self.rng.random(n)

    rng = Counting()
    d, theta = bayesian.drawn_discount(3 * tables, tables, tables // 2, 2.0, 0.5, (1.0, 1.0), (1.0, 1.0), rng)
    assert rng.n == tables - 1 and 0 < d < 1 and theta > 0


def test_noise(spark):
    pairs = spark.createDataFrame([("abcab" + text.GAP, "abdx" + text.GAP + "q")], "gt string, noisy string")
    tables = noise.learn(pairs)
    p = {(r["kind"], r["ch"], r["key"]): r["p"] for r in tables.collect()}
    assert p[("conditional", "a", "substitute")] == 0.5 and p[("substitutions", "c", "d")] == 1.0 and p[("insertions", text.GAP, "q")] == 1.0
    df = spark.createDataFrame([(1, "abc" * 500), (2, ""), (3, None)], "k int, text string")
    got = {r["k"]: r["x"] for r in df.select("k", noise.NoiseModel(tables, 0.2).generate("text", "k").alias("x")).collect()}
    assert got[2] == "" and got[3] is None and got[1] != "abc" * 500
    clean = {r["k"]: r["x"] for r in df.select("k", noise.NoiseModel(tables, 0.0).generate("text", "k").alias("x")).collect()}
    assert clean[1] == "abc" * 500
    out = noise.learn_and_corrupt(df, pairs, {"mild": 0.1, "hard": 0.3}, "k", text.LATIN_ALPHABET, {text.GAP: ""})
    assert {r["level"] for r in out.collect()} == {"mild", "hard"} and noise.learn_and_corrupt(df, pairs.limit(0), {}, "k", "a", {}) is None


def test_text(spark):
    assert len(text.greek_fold()) == 126
    assert one(spark, text.fold(F.lit("ἀϛᾧⲀέ"), text.greek_fold())) == "αστωⲀε"
    assert one(spark, text.remove_diacritics(F.lit("ἀéñ"))) == "αen"
    assert one(spark, text.drop_symbols(F.lit("a’b'c"))) == "abc" and one(spark, text.drop_control(F.lit("a\tb\nc​"))) == "abc"
    refs = ["1Cor.03.04", "B04K5V6", "IncipitK1V1", "X.subscriptio", "B04KInscriptio", "none"]
    df = spark.createDataFrame([(r,) for r in refs], "r string").select(text.chapter_of("r").alias("c"), text.verse_of("r").alias("v"))
    assert [tuple(r) for r in df.collect()] == [("3", "4"), ("5V6", "6"), ("Incipit", "1"), ("Subscriptio", "Subscriptio"), ("Inscriptio", "Inscriptio"), (None, None)]


def test_split_of_repeated_keys(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, "same").otherwise(F.col("id").cast("string")))
    got = decode.exact_split(df, "k")
    assert got.where("is_train").count() == 800 and got.count() == 1000


def test_split_is_exact(spark):
    df = spark.range(1003).withColumn("k", F.col("id").cast("string"))
    got = decode.exact_split(df, "k")
    assert got.where("is_train").count() == 802 and got.count() == 1003
