"""Column functions that clean and parse text. Lengths and places are in code points."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The gap sign, the letters kept for each alphabet, the manuscripts' name prefixes.
GAP = "⌀"
GREEK_ALPHABET = "αβγδεζηθικλμνξοπρστυφχψως "
LATIN_ALPHABET = "abcdefghijklmnopqrstuvwxyz "
APOSTROPHES = "'’"

#: Unicode white space and the separators \x1c to \x1f; listed, as a class of properties is looked up for every character.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip_marks(text: str) -> str:
    """Decomposed, without nonspacing marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def greek_fold() -> dict[str, str]:
    """Variant letters to plain ones: composed small letters with breathings, accents or iota below, but neither the oxia
    doubles of tonos letters nor bare dialytika; four special signs; the gap goes."""
    composed = [chr(c) for c in range(0x1F00, 0x2000)] + list("άέήίόύώΐΰ")
    plain = {c: strip_marks(c) for c in composed if unicodedata.normalize("NFC", c) == c}
    return {c: p for c, p in plain.items() if len(p) == 1 and p in "αεηιορυω" and p != c} | {"ϲ": "σ", "ϛ": "στ", "ͻ": "σ", "Ϲ": "Σ", GAP: ""}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda, an expression is otherwise computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(c) -> Column:
    """The text's characters. Take parts of long texts from this array: substring walks from the start each time."""
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def without_spaces(c) -> Column:
    """Only U+0020 goes."""
    return F.replace(col(c), F.lit(" "), F.lit(""))


def words(c) -> Column:
    """Parts between Unicode white space, none empty; null gives null."""
    return F.filter(F.split(col(c), WHITE), lambda w: w != "")


def collapse(c) -> Column:
    return F.array_join(words(c), " ")


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


class _Unmarked(dict):
    """What each character becomes without marks, found when it is first met; a table for str.translate.

    Decomposition puts marks in order across characters, so `kept`, those that stay though they are put in order, need the whole text.
    """

    def __init__(self):
        self.kept: set[str] = set()

    def __missing__(self, point: int) -> str:
        out = self[point] = strip_marks(chr(point))
        self.kept.update(c for c in out if unicodedata.combining(c))
        return out

    def strip(self, text: str) -> str:
        if text.isascii():
            return text
        out = text.translate(self)
        return strip_marks(text) if any(c in out for c in self.kept) else out


UNMARKED = _Unmarked()


@F.arrow_udf(StringType())
def _strip_marks(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else UNMARKED.strip(x) for x in s.to_pylist()], pa.string())


def remove_diacritics(c) -> Column:
    """Exact for every script, by Arrow; see fold_latin for the plan without Python."""
    return _strip_marks(col(c))


def fold_latin(c) -> Column:
    """remove_diacritics for text of Latin letters up to U+024F, by one translate."""
    pairs = {chr(i): strip_marks(chr(i)) for i in range(0xC0, 0x250)}
    pairs = {a: b for a, b in pairs.items() if len(b) == 1 and a != b}
    return F.regexp_replace(F.translate(col(c), "".join(pairs), "".join(pairs.values())), r"\p{Mn}", "")


def drop_symbols(c, symbols: str = APOSTROPHES) -> Column:
    return F.translate(col(c), symbols, "")


def drop_control(c) -> Column:
    """All code points of the categories C*, line ends and tabs among them."""
    return F.regexp_replace(col(c), r"\p{C}", "")


def fold(c, table: dict[str, str]) -> Column:
    """Replace by a table whose outputs are not among its keys, so order does not matter."""
    ones = {a: b for a, b in table.items() if len(b) == 1}
    out = F.translate(col(c), "".join(ones) + "".join(a for a, b in table.items() if not b), "".join(ones.values()))
    for a, b in table.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def keep_alphabet(c, alphabet: str) -> Column:
    return F.regexp_replace(col(c), "[^" + alphabet + "]", "")


def name_parts(c) -> Column:
    """(part 2, part 3) of a name in parts joined by _, null where missing."""
    p = F.split(col(c), "_")
    return F.struct(F.try_element_at(p, F.lit(3)).alias("number"), F.try_element_at(p, F.lit(4)).alias("book"))


REFERENCE = r"^(\d?[A-Za-z]+)\.(\d+)\.(\d+)$"


#: What a special reference holds, in lower case, and what it is called.
SPECIAL_CHAPTERS = {"incip": "Incipit", "subscrip": "Subscriptio", "inscript": "Inscriptio"}
SPECIAL_VERSES = {"subscrip": "Subscriptio", "inscript": "Inscriptio"}


def _reference(c: Column, place: int, special: dict[str, str], mark: str) -> Column:
    number = F.regexp_replace(F.regexp_extract(c, REFERENCE, place), "^0+(?=.)", "")
    out = F.when(c.rlike(REFERENCE), number).otherwise(F.try_element_at(F.split(c, mark), F.lit(2)))
    for part, name in reversed(special.items()):
        out = F.when(F.lower(c).contains(part), name).otherwise(out)
    return out


def chapter_of(c) -> Column:
    """The chapter of a reference, as a string; null where the text has neither form."""
    return _reference(col(c), 2, SPECIAL_CHAPTERS, "K")


def verse_of(c) -> Column:
    return _reference(col(c), 3, SPECIAL_VERSES, "V")
