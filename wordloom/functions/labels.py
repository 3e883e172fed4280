"""Column functions for character labels: annotation, ids, rebuilding, alignment with tokens, windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import characters, col, let

#: Label ids of the two schemes, the id that training passes over.
BINARY = {"I": 0, "E": 1}
QUADRI = {"I": 0, "E": 1, "B": 2, "S": 3}
IGNORED = -100
SCHEMES = ("binary", "quadri")


def _repeat(label: str, n: Column) -> Column:
    return F.array_repeat(F.lit(label), n.cast("int"))


def binary(words) -> Column:
    """n - 1 times I and one E for a word of n characters."""
    return F.flatten(F.transform(col(words), lambda w: F.concat(_repeat("I", F.length(w) - 1), F.array(F.lit("E")))))


def quadri(words) -> Column:
    """S for a word of one character, else B, I's and E."""
    long = lambda w: F.concat(F.array(F.lit("B")), _repeat("I", F.length(w) - 2), F.array(F.lit("E")))
    return F.flatten(F.transform(col(words), lambda w: F.when(F.length(w) == 1, F.array(F.lit("S"))).otherwise(long(w))))


def annotate(words, scheme: str = "binary") -> Column:
    if scheme not in SCHEMES:
        raise ValueError(f"unknown annotation scheme: {scheme}")
    return binary(words) if scheme == "binary" else quadri(words)


def ids(labels, scheme: str = "binary") -> Column:
    """Numbers of trimmed label names; an unknown name is an error when the row is read."""
    table = F.create_map(*[F.lit(x) for pair in (BINARY if scheme == "binary" else QUADRI).items() for x in pair])
    known = lambda l: F.coalesce(F.try_element_at(table, F.trim(l)), F.raise_error(F.concat(F.lit("unknown label: "), l)).cast("int"))  # noqa: E731, E741
    return F.transform(col(labels), known)


def rebuild(text, label_ids) -> Column:
    """Characters with a space after each labelled 1 or 3, ends stripped; what is longer, text or labels, is cut."""

    @F.arrow_udf("string")
    def run(t: pa.Array, given: pa.Array) -> pa.Array:
        ends = given.offsets.to_numpy()
        cells = given.values.to_numpy(zero_copy_only=False)
        spaced = np.isin(cells, (1, 3))
        known = given.is_valid().to_pylist()
        return pa.array([None if x is None or not ok else _spaced(x, spaced[a:b]) for x, ok, a, b in zip(t.to_pylist(), known, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())

    return run.asNondeterministic()(col(text), col(label_ids))


def _spaced(t: str, spaced: np.ndarray) -> str:
    """The characters that have a label, a space behind each that is marked."""
    t = t[: len(spaced)]
    cuts = (np.flatnonzero(spaced[: len(t)]) + 1).tolist()
    return " ".join(t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)).strip()


def token_labels(label_ids, max_length: int = 128) -> Column:
    """Label ids at the places of a text's tokens: start, characters, end, padding; only characters count."""
    body = F.slice(col(label_ids), 1, max_length - 2)
    return F.concat(F.array(F.lit(IGNORED)), body, F.array_repeat(F.lit(IGNORED), F.lit(max_length - 1) - F.size(body)))


def code_points(text) -> Column:
    """The text's code points as numbers."""
    return F.transform(characters(text), lambda c: F.ascii(c))


def item(text, label_ids, max_length: int = 128, start: int = 57344, end: int = 57345, pad: int = 0) -> Column:
    """input_ids, attention_mask, labels of fixed length; characters are their code points between two special tokens."""
    body = F.slice(code_points(text), 1, max_length - 2)
    n = F.size(body) + 2
    fill = F.lit(max_length) - n
    return F.struct(
        F.concat(F.array(F.lit(start)), body, F.array(F.lit(end)), F.array_repeat(F.lit(pad), fill)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
        token_labels(label_ids, max_length).alias("labels"),
    )


def windows(tokens, max_length: int = 512, stride: int = 128, pad: int = 0) -> Column:
    """Structs start, input_ids, attention_mask, labels: a window every `stride` tokens, the last ones padded; mask all ones."""

    def cut_all(t: Column) -> Column:
        cut = lambda i: F.slice(F.concat(F.slice(t, i + 1, max_length), F.array_repeat(F.lit(pad), max_length)), 1, max_length)
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), cut(i).alias("input_ids"), F.array_repeat(F.lit(1), max_length).alias("attention_mask"), cut(i).alias("labels")))

    return let(col(tokens), cut_all)


def alignment_report(df: DataFrame, keys: list[str], text_col: str = "text", labels_col: str = "label_ids", max_length: int = 128) -> DataFrame:
    """keys, place, token, label of each token of a text: the marks [CLS] and [SEP] around its characters, whose labels are IGNORED.

    What is longer is cut as items are; tokens count from 0. A row shows at a glance whether labels stand where their characters do.
    """
    body = F.slice(characters(text_col), 1, max_length - 2)
    tokens = F.concat(F.array(F.lit("[CLS]")), body, F.array(F.lit("[SEP]")))
    marks = F.slice(token_labels(labels_col, max_length), 1, F.size(body) + 2)
    return df.select(*keys, F.posexplode(F.arrays_zip(tokens.alias("token"), marks.alias("label"))).alias("place", "t")).select(*keys, "place", "t.token", "t.label")
