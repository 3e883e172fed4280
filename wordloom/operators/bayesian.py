"""Unsupervised segmentation by a nested Pitman-Yor language model (after Mochihashi, Yamada and Ueda 2009), in parallel.

Words follow a Pitman-Yor bigram that backs off to a unigram, and that to a base of letters: an n-gram of up to n_dim letters,
smoothed like a Pitman-Yor process at each order, times a Poisson length. One epoch samples a segmentation of every text given the
last epoch's counts (forward filtering, backward sampling, seeded by epoch and text), then counts words and pairs by a grouped
aggregation, and draws discounts and strengths anew. Seats are not simulated: a type counts as one table (the minimal seating), the
letters are counted once from types. So it is an approximate, parallel Gibbs sampler. Prediction is Viterbi over bigrams.
"""

from __future__ import annotations

import hashlib
import logging
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import spread
from .decode import Segmenter

#: Bytes of a count table that are sent to every worker at most; a row is taken to need so many. Larger ones are refused, not cut.
SENT_BYTES, ROW_BYTES = 256 << 20, 120
#: Share of the probability of lengths that may lie beyond the longest word looked for.
TAIL = 1e-9

log = logging.getLogger(__name__)


class Letters:
    """Probabilities of words by their letters: Pitman-Yor n-grams over types, and Poisson lengths."""

    def __init__(self, words: dict[str, int], order: int, alphabet: int, d: float, theta: float, mean: float):
        self.order, self.d, self.theta, self.mean = max(order, 1), d, theta, mean
        self.seen: dict[str, int] = {}
        self.types: dict[str, int] = {}
        self.after: dict[str, int] = {}
        self.uniform = 1.0 / (alphabet + 1)
        for w in words:
            padded = "\x02" * (self.order - 1) + w + "\x03"
            for i in range(self.order - 1, len(padded)):
                for k in range(self.order):
                    gram = padded[i - k : i + 1]
                    n = self.seen.get(gram, 0)
                    self.seen[gram] = n + 1
                    if not n:
                        self.types[gram[:-1]] = self.types.get(gram[:-1], 0) + 1
                    self.after[gram[:-1]] = self.after.get(gram[:-1], 0) + 1
        self.memory: dict[str, float] = {}
        self.logs: dict[str, float] = {}

    def letter(self, gram: str) -> float:
        """P(last | the others), each order backed off to the next shorter one."""
        p = self.uniform
        for k in range(len(gram) - 1, -1, -1):
            context = gram[k:-1]
            total = self.after.get(context)
            if not total:
                break
            p = (max(self.seen.get(gram[k:], 0) - self.d, 0.0) + (self.theta + self.d * self.types[context]) * p) / (self.theta + total)
        return p

    def log_letter(self, gram: str) -> float:
        """The logarithm of letter, kept: a place of a text asks for the grams of all words that reach over it."""
        found = self.logs.get(gram)
        if found is None:
            if len(self.logs) >= 1 << 20:
                self.logs.clear()
            found = self.logs[gram] = math.log(self.letter(gram))
        return found

    def log_probability(self, w: str) -> float:
        found = self.memory.get(w)
        if found is None:
            padded, out = "\x02" * (self.order - 1) + w, 0.0
            for i in range(self.order - 1, len(padded)):
                out += self.log_letter(padded[i - self.order + 1 : i + 1])
            found = out - self.mean + len(w) * math.log(self.mean) - math.lgamma(len(w) + 1)
            if len(self.memory) >= 1 << 20:
                self.memory.clear()
            self.memory[w] = found
        return found


class PitmanYor:
    """P(word | word before) from counts of words and pairs, discounts and strengths of both orders, and letters."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], letters: Letters, d: tuple[float, float], theta: tuple[float, float], longest: int):
        self.words, self.pairs, self.letters, self.d, self.theta, self.longest = words, pairs, letters, d, theta, longest
        self.types = len(words)
        self.total = sum(words.values())
        self.after: dict[str, list[int]] = {}
        for (before, _), n in pairs.items():
            row = self.after.setdefault(before, [0, 0])
            row[0] += n
            row[1] += 1

    def unigram(self, w: str) -> float:
        base = math.exp(max(self.letters.log_probability(w), -600.0))
        (d, _), (theta, _) = self.d, self.theta
        return (max(self.words.get(w, 0) - d, 0.0) + (theta + d * self.types) * base) / (theta + self.total)

    def probability(self, before: str, w: str, unigram: float | None = None) -> float:
        p = self.unigram(w) if unigram is None else unigram
        row = self.after.get(before)
        if row is None:
            return p
        (_, d), (_, theta) = self.d, self.theta
        return (max(self.pairs.get((before, w), 0) - d, 0.0) + (theta + d * row[1]) * p) / (theta + row[0])

    def unigrams(self, text: str) -> list[list[float]]:
        """P(word) of text[i - k : i] at [i][k], letter by letter from each place."""
        letters, (d, _), (theta, _) = self.letters, self.d, self.theta
        lengths = [k * math.log(letters.mean) - letters.mean - math.lgamma(k + 1) for k in range(self.longest + 1)]
        out = [[0.0] * (min(i, self.longest) + 1) for i in range(len(text) + 1)]
        for j in range(len(text)):
            part, total = "\x02" * (letters.order - 1) + text[j : j + self.longest], 0.0
            for k in range(1, len(part) - letters.order + 2):
                total += letters.log_letter(part[k - 1 : k - 1 + letters.order])
                seen = max(self.words.get(text[j : j + k], 0) - d, 0.0)
                out[j + k][k] = (seen + (theta + d * self.types) * math.exp(max(total + lengths[k], -600.0))) / (theta + self.total)
        return out

    def split(self, text: str, rng: random.Random | None) -> list[str]:
        """A sampled segmentation, or the most probable one without a source of chance.

        States are (end, length of the last word). A word that was never seen stands in no known pair, so what came before is summed
        (or its best taken) once for all such words; only known words look at each word before them.
        """
        n = len(text)
        if not n:
            return []
        unigram, (_, d), (_, theta) = self.unigrams(text), self.d, self.theta
        score: list[list[float]] = [[]]
        behind: list[list[float]] = [[]]  # score and what backing off after this word costs
        back, whole, first = [[0]], [0.0], [0]
        for i in range(1, n + 1):
            row, came, off = [-math.inf], [0], [-math.inf]
            for k in range(1, min(i, self.longest) + 1):
                j, w, p = i - k, text[i - k : i], unigram[i][k]
                if not j:
                    best, at = math.log(self.probability("", w, p)), 0
                elif w not in self.words:
                    best, at = whole[j] + math.log(p), first[j]
                else:
                    lp = math.log(p)
                    options = [score[j][m] + math.log(self.probability(b, w, p)) if (b := text[j - m : j], w) in self.pairs else behind[j][m] + lp for m in range(1, len(score[j]))]
                    top = max(options)
                    best, at = (top, options.index(top) + 1) if rng is None else (top + math.log(sum(math.exp(x - top) for x in options)), 0)
                row.append(best)
                came.append(at)
                after = self.after.get(w)
                off.append(best if after is None else best + math.log((theta + d * after[1]) / (theta + after[0])))
            top = max(off)
            score.append(row)
            back.append(came)
            behind.append(off)
            first.append(off.index(top))
            whole.append(top if rng is None else top + math.log(sum(math.exp(x - top) for x in off[1:])))
        out, i = [], n
        if rng is None:
            k = max(range(1, len(score[n])), key=score[n].__getitem__)
            while i:
                out.append(text[i - k : i])
                i, k = i - k, back[i][k]
            return out[::-1]
        weights, w = score[n][1:], None
        while i:
            if w is not None:  # the word before, given the one after it
                p = unigram[i + len(w)][len(w)]
                weights = [score[i][m] + math.log(self.probability(text[i - m : i], w, p)) for m in range(1, len(score[i]))]
            top = max(weights)
            k = rng.choices(range(1, len(weights) + 1), [math.exp(x - top) for x in weights])[0]
            w = text[i - k : i]
            out.append(w)
            i -= k
        return out[::-1]

    def log_likelihood(self, words: list[str]) -> float:
        return sum(math.log(self.probability(b, w)) for b, w in zip(["", *words], words, strict=False))


#: Tables that are drawn at once.
DRAWN = 1_000_000


def drawn_discount(total: int, types: int, single: int, theta: float, d: float, theta_prior: tuple[float, float], d_prior: tuple[float, float], rng: np.random.Generator) -> tuple[float, float]:
    """New discount and strength by Teh's auxiliary variables, under minimal seating: each of the types has one table, `single` of
    them one guest; the beta and gamma priors are those of the arguments."""
    if total < 2 or types < 1:
        return d, theta
    x = rng.beta(theta + 1, total - 1) if total > 1 else 1.0
    # one draw for each table beyond the first, in blocks
    yes = float(sum((rng.random(len(i)) < theta / (theta + d * i)).sum() for lo in range(1, types, DRAWN) for i in [np.arange(lo, min(types, lo + DRAWN))]))
    alone = (types - single) * 1.0  # types with more than one guest: at least one guest beyond the first, who paid 1 - d
    d = rng.beta(d_prior[0] + (types - 1 - yes), d_prior[1] + alone)
    theta = rng.gamma(theta_prior[0] + yes, 1.0 / (theta_prior[1] - math.log(max(x, 1e-300))))
    return float(min(max(d, 0.01), 0.99)), float(max(theta, 1e-3))


class BayesianSegmenter(Segmenter):
    """Arguments are those of the published model's usual interface (fixed names and defaults).

    n_dim: letters of the longest letter n-gram. init_d, init_theta: discount and strength to begin with, of words and of letters.
    init_a, init_b: gamma prior (shape, rate) of the mean length. beta_stops, beta_passes: beta prior of ending a word, which gives the
    mean length to begin with. d_a, d_b: beta prior of discounts. theta_alpha, theta_beta: gamma prior of strengths.
    """

    def __init__(self, n_dim=7, init_d=0.5, init_theta=2.0, init_a=6.0, init_b=0.83333333, beta_stops=1.0, beta_passes=1.0, d_a=1.0, d_b=1.0, theta_alpha=1.0, theta_beta=1.0):
        self.n_dim, self.d, self.theta = n_dim, (init_d, init_d), (init_theta, init_theta)
        self.letter_d, self.letter_theta = init_d, init_theta
        self.length_prior, self.stops = (init_a, init_b), (beta_stops, beta_passes)
        self.d_prior, self.theta_prior = (d_a, d_b), (theta_alpha, theta_beta)
        self.model: PitmanYor | None = None
        self.losses: list[float] = []

    def _split(self, df: DataFrame, keys: list[str], text_col: str, epoch: int | None) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.model)  # checked against SENT_BYTES where it was collected
        src = df.select(*keys, F.col(text_col).alias("__text"))
        schema = src.drop("__text").withColumn("words", F.lit(None).cast("array<string>")).schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seed = lambda t: None if epoch is None else random.Random(hashlib.md5(f"{epoch}|{t}".encode()).digest())
                yield b[keys].assign(words=[shared.value.split(t or "", seed(t)) for t in b["__text"]])

        return src.mapInPandas(run, schema)

    @staticmethod
    def _collected(table: DataFrame, what: str) -> pd.DataFrame:
        """The whole table on the driver; refuses one that would not fit a worker rather than cutting it."""
        if (n := table.count()) * ROW_BYTES > SENT_BYTES:
            raise ValueError(f"{n} {what} do not fit the {SENT_BYTES >> 20} MB that are sent to each worker")
        return table.toPandas()

    def _longest(self, mean: float, seen: int, most: int) -> int:
        """The longest word that is looked for: the longest seen, or where the lengths' tail ends, whichever is more."""
        k, p, left = 0, math.exp(-mean), 1.0 - math.exp(-mean)
        while left > TAIL and k < most:
            k += 1
            p *= mean / k
            left -= p
        return max(1, min(most, max(k, seen)))

    def train(self, train: DataFrame, dev: DataFrame | None = None, epochs: int = 20, d_theta_learning: bool = True, poisson_learning: bool = True, print_each_nth_iteration: int = 5, text_col: str = "text") -> BayesianSegmenter:
        """Fits on texts without spaces; empty and null ones are passed over.

        d_theta_learning draws discounts and strengths anew each epoch, poisson_learning the mean length. dev texts are segmented and
        their mean loss per character logged every print_each_nth_iteration epochs and kept in `losses`.
        """
        texts = spread(train.select(F.col(text_col).alias("text")).where("text <> ''")).persist()
        chars = texts.select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c")).distinct().count()
        most = texts.agg(F.coalesce(F.max(F.length("text")), F.lit(1)).alias("n")).first()["n"]
        stops, passes = self.stops
        mean = max(1.0, (stops + passes) / stops * self.length_prior[0] * self.length_prior[1] / 2)
        self.model = PitmanYor({}, {}, Letters({}, self.n_dim, chars, self.letter_d, self.letter_theta, mean), self.d, self.theta, self._longest(mean, 0, most))
        self.losses = []
        for epoch in range(epochs):
            rng = np.random.default_rng([epoch, 11])
            sampled = self._split(texts.withColumn("k", F.lit(0)), ["k"], "text", epoch).select("words").persist()
            before = F.concat(F.array(F.lit("")), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
            rows = sampled.select(F.explode(F.arrays_zip(before.alias("b"), F.col("words").alias("w"))).alias("p")).select("p.b", "p.w").groupBy("b", "w").agg(F.count("*").alias("n"))
            got = self._collected(rows, "pairs of words")
            sampled.unpersist()
            pairs = dict(zip(zip(got["b"], got["w"], strict=True), got["n"].tolist(), strict=True))
            words = got.groupby("w")["n"].sum().to_dict()
            n = sum(words.values()) or 1
            if poisson_learning and words:  # a draw from the gamma posterior
                a, b = self.length_prior
                mean = max(1.0, float(rng.gamma(a + sum(len(w) * c for w, c in words.items()), 1.0 / (b + n))))
            if d_theta_learning:
                ones = sum(c == 1 for c in words.values())
                d1, t1 = drawn_discount(n, len(words), ones, self.theta[0], self.d[0], self.theta_prior, self.d_prior, rng)
                d2, t2 = drawn_discount(n, len(pairs), sum(c == 1 for c in pairs.values()), self.theta[1], self.d[1], self.theta_prior, self.d_prior, rng)
                self.d, self.theta = (d1, d2), (t1, t2)
            letters = Letters(words, self.n_dim, chars, self.letter_d, self.letter_theta, mean)
            self.model = PitmanYor(words, pairs, letters, self.d, self.theta, self._longest(mean, max(map(len, words), default=1), most))
            if dev is not None and print_each_nth_iteration and (epoch + 1) % print_each_nth_iteration == 0:
                self.losses.append(self.loss(dev, text_col))
                log.info("epoch %d: loss per character of held-out texts %.4f", epoch + 1, self.losses[-1])
        texts.unpersist()
        return self

    def loss(self, df: DataFrame, text_col: str = "text") -> float:
        """Mean negative log-likelihood per character of the most probable segmentations."""
        shared = df.sparkSession.sparkContext.broadcast(self.model)
        src = df.select(F.col(text_col).alias("t")).where("t <> ''")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"l": [-shared.value.log_likelihood(shared.value.split(t, None)) for t in b["t"]], "n": [len(t) for t in b["t"]]})

        r = src.mapInPandas(run, "l double, n long").agg(F.sum("l").alias("l"), F.sum("n").alias("n")).first()
        return float("nan") if not r["n"] else r["l"] / r["n"]

    def segment(self, df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
        if self.model is None:
            raise ValueError("train first")
        return self._split(spread(df), keys, text_col, None)
