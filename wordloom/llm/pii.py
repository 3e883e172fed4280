"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels the tokens that could be personal data (those with a digit, an @ or a sign that
stands for either): a linear chain over adjacent ones, and skip edges between distant ones that repeat each other or are similar
(equal text, the same last digits, the same name before an @, the same four numbers), which share potentials for equal labels.
Labels of base spans are observed; loopy belief propagation carries them through each document until the messages settle, so a
number or name that comes back in a form which fits no pattern is labelled too. Every document with such tokens is labelled,
whether it has base spans or not.

The field is fitted by pseudo-likelihood on whole documents of a bounded sample, given their base spans. As these documents
seldom say what the field has to learn, each gets spans of its own again in other forms, with their labels, and numbers of the
same forms that repeat nothing, without.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import pickle
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
#: Ways in which tokens are alike, each with a skip potential for each label.
ALIKE = ("text", "digits", "masked", "name", "numbers")
#: Hashed features; about so many rows are sampled to fit on; steps and decay of fitting; least belief of an added span.
FEATURES, SAMPLE, STEPS, DECAY, LEAST_BELIEF = 1 << 12, 8_000, 300, 0.03, 0.5
#: Propagation ends when no message moves by more than this, or after so many rounds (then with what it has).
SETTLED, ROUNDS = 1e-4, 200
#: Tokens of a number that is written in parts.
PARTS = 5

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]|[\[(]at[\])]|[*•]{3}", re.IGNORECASE)
BOUND = re.compile(r"""[\s,;|<>"]""")
AT = re.compile(r"@|[\[(]at[\])]", re.IGNORECASE)
MASK = re.compile(r"[*•]{2,}|[xX]{2,}")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the address pattern, in time linear in the text."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        else:
            end = at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind as in KINDS, then by start."""
    out = list(emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the field


def core(s: str) -> tuple[int, int]:
    """The token without punctuation around it."""
    a, b = 0, len(s)
    while a < b and not (s[a].isalnum() or s[a] in "+*•" or s[a] == "(" and ")" in s):
        a += 1
    while b > a and not (s[b - 1].isalnum() or s[b - 1] in "*•" or s[b - 1] == ")" and "(" in s[a:b]):
        b -= 1
    return a, b


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that could be personal data."""
    out, end, m = [], 0, SIGN.search(text)
    while m:
        at = m.start()
        while at > end and not BOUND.match(text, at - 1):
            at -= 1
        stop = BOUND.search(text, m.end())
        end = stop.start() if stop else len(text)
        a, b = core(text[at:end])
        if a < b:
            out.append((at + a, at + b))
        m = SIGN.search(text, end)
    return out


def shape(s: str) -> str:
    """Runs of digits by their length, letters as a, each run once."""
    return re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", s))


def keys_of(s: str) -> Iterator[tuple[int, str]]:
    """What other tokens must have in common with this one to be alike, and in which way."""
    d, low = only_digits(s), s.lower()
    if sum(map(str.isalnum, s)) >= 5:
        yield 0, low
    if len(d) >= 7:
        yield 1, d[-7:]
    if MASK.search(s) and len(d) >= 3 or len(d) >= 9:
        yield 2, d[-4:]
    if m := AT.search(s):
        low = low[: m.start()]
    if len(low) >= 4 and any(c.isalpha() for c in low):
        yield 3, low
    numbers = re.findall("[0-9]+", s)
    if len(numbers) == 4 and all(len(x) <= 3 for x in numbers):
        yield 4, ".".join(numbers)
        yield 4, ".".join(numbers[:3]) + ".*"
    elif len(numbers) == 3 and all(len(x) <= 3 for x in numbers) and re.search("[xX*]$", s):
        yield 4, ".".join(numbers) + ".*"


def _alike(a: str, b: str, way: int) -> bool:
    """Tokens alike in a masked way must differ in being masked: four last digits of two whole numbers mean nothing."""
    return way != 2 or bool(MASK.search(a)) != bool(MASK.search(b))


class Graph:
    """A document's tokens, features, observed labels (-1: none), chain edges and skip edges with their ways."""

    def __init__(self, text: str, spans: list[Span]):
        self.places = tokens(text)
        n = len(self.places)
        self.observed = np.full(n, -1)
        order = sorted((a, b, 1 + KINDS.index(k)) for k, a, b in spans)
        reach = list(itertools.accumulate((b for _, b, _ in order), max))
        for i, (a, b) in enumerate(self.places):
            j = bisect.bisect_right(reach, a)  # nothing before this ends beyond a
            while j < len(order) and order[j][0] < b:
                if order[j][1] > a:
                    self.observed[i] = order[j][2]
                    break
                j += 1
        words = [text[a:b] for a, b in self.places]
        self.features = [self._features(text, i) for i in range(n)]
        gap = lambda i: text[self.places[i][1] : self.places[i + 1][0]]
        near = [self.places[i + 1][0] - self.places[i][1] <= 8 and not gap(i).strip(" ().,;:-") for i in range(n - 1)]
        self.chain = [i for i in range(n - 1) if near[i]]
        alike: dict[tuple[int, str], list[int]] = defaultdict(list)
        for i, s in enumerate(words):
            for key in keys_of(s):
                alike[key].append(i)
            # a number in parts is alike as a whole
            digits, j = only_digits(s), i
            while j + 1 < n and near[j] and j + 1 - i < PARTS:
                j += 1
                digits += only_digits(words[j])
                if len(digits) >= 7:
                    for k in range(i, j + 1):
                        alike[1, digits[-7:]].append(k)
                    if len(digits) >= 9:
                        alike[2, digits[-4:]].append(j)
        chained = {(i, i + 1) for i in self.chain}
        pairs: set[tuple[int, int, int]] = set()
        for (way, _), v in alike.items():
            v = sorted(set(v))
            for p, q in [*zip(v, v[1:], strict=False), *((v[0], x) for x in v[2:])]:
                if (p, q) not in chained and _alike(words[p], words[q], way):
                    pairs.add((p, q, way))
        self.skip = sorted(pairs)

    def _features(self, text: str, i: int) -> list[int]:
        a, b = self.places[i]
        s, d = text[a:b], len(only_digits(text[a:b]))
        before, after = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
        names = ["1", "s" + shape(s), f"d{min(d, 20)}", f"l{min(b - a, 40) // 4}", f"@{bool(AT.search(s))}", f".{min(s.count('.'), 4)}", f"m{bool(MASK.search(s))}", "+" if s[0] == "+" else "-", "p" + (shape(before[-1]) if before else ""), "n" + (shape(after[0]) if after else "")]
        return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=4).digest(), "little") % FEATURES for x in names]


# ---- what the field is fitted on


def other_forms(kind: str, s: str, rng: random.Random) -> str:
    """A span in a form that fits no pattern."""
    d = only_digits(s)
    if kind == "email":
        name, _, domain = s.partition("@")
        return rng.choice([f"{name}[at]{domain}", f"{name}(at){domain}", f"{name}[AT]{domain.replace('.', '[dot]')}", f"{name}@{domain.split('.')[0]}"])
    if kind == "ip":
        p = s.split(".")
        return rng.choice(["-".join(p), "[.]".join(p), "(.)".join(p), ".".join(p[:3]) + ".x", ".".join(p[:3]) + ".*"])
    if kind == "card":
        return rng.choice([".".join(d[k : k + 4] for k in range(0, len(d), 4)), "/".join(d[k : k + 4] for k in range(0, len(d), 4)), "*" * (len(d) - 4) + d[-4:], "XXXX-XXXX-XXXX-" + d[-4:]])
    d = d[-10:]
    return rng.choice([f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[:-7]} {d[-7:-4]} {d[-4:]}", d, f"***-***-{d[-4:]}"])


def another(kind: str, s: str, rng: random.Random) -> str:
    """As s in form, with other digits and another name."""
    if kind == "email":
        return f"{''.join(rng.choices('abcdefghijklmnoprstuw', k=6))}.{rng.randint(1, 99)}@{s.partition('@')[2]}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    return "".join(str(rng.randint(0, 9)) if "0" <= c <= "9" else c for c in s)


def with_other_forms(text: str, rng: random.Random) -> tuple[str, list[Span], list[Span]]:
    """The text with some of its base spans again in other forms and about as many numbers that repeat nothing; the new places of
    the former with their kinds, and of the latter."""
    base, blanks = base_spans(text), [m.start() for m in re.finditer(" ", text)]
    put = []
    for kind, a, b in base:
        if rng.random() < 0.5 and blanks:
            put.append((rng.choice(blanks), other_forms(kind, text[a:b], rng), kind, True))
        if rng.random() < 0.5 and blanks:
            put.append((rng.choice(blanks), other_forms(kind, another(kind, text[a:b], rng), rng), kind, False))
    out, at, length, spans = [], 0, 0, ([], [])
    for place, s, kind, same in sorted(put):
        out += [text[at:place], " ", s]
        length += place - at + 1
        spans[not same].append((kind, length, length + len(s)))
        length, at = length + len(s), place
    return "".join([*out, text[at:]]), *spans


def example(text: str) -> dict[str, np.ndarray]:
    """A whole document as what `fit` takes: features, labels, which tokens are judged, edges."""
    text, planted, _ = with_other_forms(text, random.Random(hashlib.blake2b(text.encode("utf-8", "replace")).digest()))
    base = base_spans(text)
    g, truth = Graph(text, base), Graph(text, [*base, *planted])
    return {"features": np.array(g.features, np.int32).reshape(len(g.places), -1), "labels": np.maximum(truth.observed, 0), "judged": g.observed < 0, "chain": np.array(g.chain, np.int32), "skip": np.array(g.skip, np.int32).reshape(-1, 3)}


def fit(examples: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Unary weights, chain and skip potentials by pseudo-likelihood of the judged tokens (AdaGrad on full batches)."""
    w, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((len(ALIKE), LABELS))
    examples = [e for e in examples if len(e["labels"])]
    if not examples:
        w[:, 0] = 1.0  # nothing to learn from: nothing is added
        return {"w": w, "chain": chain, "skip": skip}
    at = np.cumsum([0, *(len(e["labels"]) for e in examples)])
    feats, y, judged = (np.concatenate([e[k] for e in examples]) for k in ("features", "labels", "judged"))
    left = np.concatenate([e["chain"] + o for e, o in zip(examples, at, strict=False)]).astype(np.int64)
    sa, sb = (np.concatenate([e["skip"][:, k] + o for e, o in zip(examples, at, strict=False)]).astype(np.int64) for k in (0, 1))
    way, one, n = np.concatenate([e["skip"][:, 2] for e in examples]).astype(np.int64), np.eye(LABELS), int(at[-1])
    same = np.zeros((len(ALIKE), n, LABELS))  # neighbours of each label over skip edges
    np.add.at(same, (way, sa), one[y[sb]])
    np.add.at(same, (way, sb), one[y[sa]])
    total = [np.full(v.shape, 1e-6) for v in (w, chain, skip)]
    flat = feats.ravel()
    for _ in range(STEPS):
        s = w[feats].sum(axis=1) + (skip[:, None, :] * same).sum(axis=0)
        np.add.at(s, left + 1, chain[y[left]])
        np.add.at(s, left, chain[:, y[left + 1]].T)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = (one[y] - p / p.sum(axis=1, keepdims=True)) * judged[:, None]
        gw = np.stack([np.bincount(flat, np.repeat(g[:, k], feats.shape[1]), FEATURES) for k in range(LABELS)], axis=1)
        gc = np.zeros_like(chain)
        np.add.at(gc, y[left], g[left + 1])
        np.add.at(gc.T, y[left + 1], g[left])
        for v, grad, sums in zip((w, chain, skip), (gw - DECAY * w, gc - DECAY * chain, (same * g).sum(axis=1) - DECAY * skip), total, strict=True):
            sums += grad * grad
            v += 0.5 * grad / np.sqrt(sums)
    return {"w": w, "chain": chain, "skip": skip}


# ---- inference


def beliefs(g: Graph, model: dict[str, np.ndarray]) -> np.ndarray:
    """Marginals of each token's labels by loopy belief propagation; observed labels are certain."""
    logs = model["w"][np.array(g.features, np.int64)].sum(axis=1)
    seen = g.observed >= 0
    logs[seen] = -50.0
    logs[seen, g.observed[seen]] = 0.0
    # tokens that are alike in several ways share one edge with the sum of the potentials
    joined_by: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(LABELS))
    for p, q, way in g.skip:
        joined_by[p, q] = joined_by[p, q] + model["skip"][way]
    edges = np.array([*((i, i + 1) for i in g.chain), *joined_by], np.int64).reshape(-1, 2)
    pot = np.concatenate([np.repeat(model["chain"][None], len(g.chain), 0), np.array([np.diag(x) for x in joined_by.values()]).reshape(-1, LABELS, LABELS)])
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot, back = np.concatenate([pot, pot.transpose(0, 2, 1)]), np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(a), LABELS))
    sums = lambda: logs + np.stack([np.bincount(b, message[:, k], len(logs)) for k in range(LABELS)], axis=1)
    for _ in range(ROUNDS if len(a) else 0):
        out = (sums()[a] - message[back])[:, :, None] + pot
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
        new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        moved, message = np.abs(new - message).max(), new
        if moved < SETTLED:
            break
    total = sums() if len(a) else logs
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], model: dict[str, np.ndarray]) -> list[Span]:
    """What the field labels beside the base spans; adjacent tokens of one label are one span."""
    g = Graph(text, base)
    if not g.places or (g.observed >= 0).all():
        return []
    p = beliefs(g, model)
    best = p.argmax(axis=1)
    good = (g.observed < 0) & (best > 0) & (p[np.arange(len(p)), best] >= LEAST_BELIEF)
    chained, out = set(g.chain), []
    for i in np.flatnonzero(good):
        kind, (a, b) = KINDS[best[i] - 1], g.places[i]
        if out and i and good[i - 1] and best[i - 1] == best[i] and i - 1 in chained:
            out[-1] = kind, out[-1][1], b
        else:
            out.append((kind, a, b))
    return out


def fit_on(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit on about `sample` whole documents, chosen by a hash of the text; the driver gets their tokens' features and edges."""
    n = df.count()
    some = df.select(F.col(text_col).cast("string").alias("text")).where("text is not null").where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (example(t) for t in (x.decode("utf-8", "replace") for x in texts(b.column(0))) if SIGN.search(t))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(e) for e in found if len(e["labels"])], pa.binary())], names=["example"])

    got = some.mapInArrow(take, "example binary").toPandas()["example"]
    return fit([pickle.loads(x) for x in sorted(got)])


def by_kind(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(df: DataFrame, model: dict[str, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind:start:end in code points).

    Null texts are taken as empty. Rows repeat as they come, null ids stay null, other columns are left out.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model or fit_on(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            counts, digest, found = [], [], []
            for t in texts(b.column(1)):
                text = t.decode("utf-8", "replace")
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in KINDS])
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append(joined(by_kind(base + added_spans(text, base, field))))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(n[:, i]) for i in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(found, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """Each span as its kind in brackets; of overlapping spans the outermost counts."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = -b
        elif -b > at:
            at = -b
    return "".join([*out, text[at:]])


def redact_pii(df: DataFrame, model: dict[str, np.ndarray] | None = None, text_col: str = "text") -> DataFrame:
    """df with all spans of text_col replaced; null texts stay null, all other columns and rows stay as they are."""
    names = df.columns
    at = names.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model or fit_on(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                if t is not None:
                    text = t.decode("utf-8", "replace")
                    base = base_spans(text)
                    found = base + added_spans(text, base, shared.value)
                    t = redact(text, found).encode() if found else t
                out.append(t)
            new = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(len(names))], names=names)

    return df.mapInArrow(run, df.schema)
