import difflib
import hashlib
import itertools
import math

import pytest
from conftest import DATA

from wordloom.plans import registry

LINES = ["The quick brown fox jumps over the lazy dog " * 6, "Ein längerer Satz über Äpfel, Öl und süße Flüsse " * 5, "déjà vu à l'été, señor Ñandú", "short one", "日本 語 text 😀 ok"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table of one text whose lines are longer than 126 characters or not ASCII."""
    path = str(tmp_path_factory.mktemp("whole"))
    d = spark.read.parquet(f"{DATA}/documents.parquet").limit(1)
    row = d.first().asDict() | {"doc_id": 5, "text": "\n".join(LINES)}
    spark.createDataFrame([tuple(row[c] for c in d.columns)], d.schema).write.parquet(f"{path}/documents.parquet")
    return path


def drawn(i, line):
    """Characters without spaces and what becomes of each."""
    clean, out = "".join(line.split()).lower(), []
    for k, c in enumerate(clean):
        u = int(hashlib.md5(f"7|5:{i}|{k}".encode()).hexdigest()[:8], 16) / 2**32
        out.append(c if not "a" <= c <= "y" or u >= 0.15 else chr(ord(c) + 1) if u < 0.1 else "")
    return clean, out


def test_noise_of_whole_lines(spark, folder):
    want = {i: (c, "".join(o)) for i, (c, o) in enumerate(map(drawn, range(len(LINES)), LINES))}
    assert max(len(c) for c, _ in want.values()) > 126
    rows = registry.QUERIES["noise_apply"](spark, folder).collect()
    assert {r["line"]: (r["clean"], r["noisy"]) for r in rows} == want
    for r in registry.QUERIES["align_gap"](spark, folder).collect():
        assert (r["gt"].replace("⌀", ""), r["noisy"].replace("⌀", "")) == want[r["line"]] and len(r["gt"]) == len(r["noisy"])


def test_noise_is_learned_from_whole_lines(spark, folder):
    pairs = [(c, o) for i, line in enumerate(LINES) for c, o in zip(*drawn(i, line), strict=True)]
    got = {r["ch"]: r["p"] for r in registry.QUERIES["noise_learn"](spark, folder).collect() if r["kind"] == "character_distribution"}
    assert got == {c: round(sum(x == c for x, _ in pairs) / len(pairs), 9) for c, _ in pairs}


def test_projection_reaches_the_end_of_the_line(spark, folder):
    """A kept boundary has one place only; with the noisy text whole, boundaries near the end are projected near its end."""
    got = {r["line"]: [int(x) for x in r["offsets"].split(",") if x] for r in registry.QUERIES["project_boundaries"](spark, folder).collect()}
    for i, line in enumerate(LINES):
        clean, noisy = drawn(i, line)
        noisy = "".join(noisy)
        at, ends = 0, []
        for w in line.split()[:-1]:
            at += len(w)
            ends.append(at)
        ops = difflib.SequenceMatcher(None, clean, noisy, autojunk=False).get_opcodes()
        sure = {t0 + e - s0 for e in ends for op, s0, s1, t0, t1 in ops if op == "equal" and s0 < e < s1}
        assert sure <= set(got[i]), i
    assert max(got[0]) > 150
    rows = {r["line"]: r for r in registry.QUERIES["noisy_scores"](spark, folder).collect()}
    assert len(rows) == len(LINES)


def test_edit_distance_of_all_lines(spark, folder):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for i, line in enumerate(LINES):
        clean, noisy = drawn(i, line)
        d = distance(clean, "".join(noisy))
        want[i] = (d, round(d / len(clean), 9))
    assert {r["line"]: (r["distance"], r["cer"]) for r in registry.QUERIES["edit_distance_cer"](spark, folder).collect()} == want


def test_kbest_of_whole_lines(spark, folder):
    """Short lines by enumeration; long ones by the best labels and the cheapest changes."""
    got = {}
    for r in registry.QUERIES["kbest"](spark, folder).collect():
        got.setdefault(r["line"], {})[r["rank"]] = r["score"]
    for i, line in enumerate(LINES):
        p = [(ord(c) % 9 + 1) / 11 for c in "".join(line.split())]
        if len(p) <= 12:
            every = sorted((sum(math.log(x if s else 1 - x) for x, s in zip(p, seq, strict=True)) for seq in itertools.product((0, 1), repeat=len(p))), reverse=True)[:3]
        else:
            best, loss = sum(math.log(max(x, 1 - x)) for x in p), sorted(abs(math.log(x / (1 - x))) for x in p)
            every = sorted([best, best - loss[0], best - loss[1], best - loss[0] - loss[1]], reverse=True)[:3]
        assert [got[i][k] for k in range(3)] == pytest.approx(every, abs=1e-6), i
    assert sum(len("".join(x.split())) > 126 for x in LINES) >= 2


def test_noisy_scores_by_brute_force(spark, folder):
    """All measures of words of five characters against boundaries that difflib carries over to the noisy text."""
    got = {r["line"]: r for r in registry.QUERIES["noisy_scores"](spark, folder).collect()}
    assert len(got) == len(LINES)
    for i, line in enumerate(LINES):
        clean, out = drawn(i, line)
        noisy, truth = "".join(out), line.lower().split()
        found = [noisy[k : k + 5] for k in range(0, len(noisy), 5)]
        ops = difflib.SequenceMatcher(None, clean, noisy, autojunk=False).get_opcodes()
        want, at = set(), 0
        for w in truth[:-1]:
            at += len(w)
            op, s0, s1, t0, t1 = next(o for o in ops if o[1] <= at < o[2])
            want.add(t0 + at - s0 if op == "equal" else t0 + int((at - s0) / (s1 - s0) * (t1 - t0)) if op == "replace" else t0)
        have = {k for k in range(5, len(noisy), 5)}
        tp, p, r = len(want & have), len(want & have) / max(1, len(have)), len(want & have) / max(1, len(want))
        both = len(set(truth) & set(found))
        same = sum(a == b for a, b in zip(truth, found, strict=False))
        values = {
            "boundary_accuracy": tp / len(want) if want else 1.0, "boundary_precision": p, "boundary_recall": r, "boundary_f1": 2 * p * r / (p + r) if p + r else 0.0,
            "word_precision": both / len(set(found)), "word_recall": both / len(set(truth)), "sequence_accuracy": same / len(truth),
            "expected_words": len(truth), "predicted_words": len(found), "correct_words": both, "exact_position_matches": same,
        }
        assert {k: got[i][k] for k in values} == pytest.approx(values), i
