"""TEI transcriptions to verses, in document order."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFERENCE, SPECIAL_CHAPTERS, SPECIAL_VERSES, chapter_of, verse_of

NS = "{http://www.tei-c.org/ns/1.0}"
SCHEMA = "struct<title:string,verses:array<struct<chapter:string,verse:string,text:string>>,error:string>"


def _number(ref: str, group: int, special: dict[str, str], mark: str) -> str:
    for part, name in special.items():
        if part in ref.lower():
            return name
    m = re.match(REFERENCE, ref)
    return str(int(m.group(group))) if m else ref.split(mark)[1]


def _readings(app, variant: str):
    """The words of readings of the variant, or of no type; nested pieces apart."""
    for rdg in app.iter(NS + "rdg"):
        if rdg.get("type", variant) == variant:
            for w in rdg.iter(NS + "w"):
                yield from [w.text] if w.text else [x.text for x in w.iter() if x.text]


def _word(w, reconstructed: bool) -> str:
    if not w.text:
        return "".join((x.text or "") + (x.tail or "") for x in w.iter())
    return "".join(w.itertext()) if reconstructed else w.text


def parse(xml: str, book_id: str = "B20", variant: str = "orig", reconstructed: bool = True) -> tuple[str, list[tuple[str, str, str]]]:
    """Title and verses (chapter, verse, text). The walk ends at the first other book; repeated verses are continued."""
    root = ElementTree.fromstring(re.sub(r'<lb(?: break="no")?/>', "", xml))
    found: dict[tuple[str, str], list[str]] = {}
    chapter, verse = None, "0"
    for e in root.iter():
        kind = e.get("type") if e.tag == NS + "div" else None
        if kind == "book" and e.get("n") != book_id:
            break
        if kind in ("chapter", "incipit"):
            chapter = _number(e.attrib["n"], 2, SPECIAL_CHAPTERS, "K")
        if e.tag != NS + "ab":
            continue
        if e.get("n"):
            verse = _number(e.attrib["n"], 3, SPECIAL_VERSES, "V")
        if chapter is None:
            raise ValueError("a verse before any chapter")
        parts = found.setdefault((chapter, verse), [])
        for child in e:
            if child.tag == NS + "w":
                parts.append(_word(child, reconstructed))
            elif child.tag == NS + "app":
                parts.extend(_readings(child, variant))
    return root.find(f".//{NS}title").attrib["n"], [(c, v, " ".join(" ".join(p).split())) for (c, v), p in found.items()]


def parse_transcriptions(df: DataFrame, xml_col: str = "xml", **options) -> DataFrame:
    """df with the struct `parsed` (title, verses, error); a text that is no such document gives an error, not a failure."""

    @F.arrow_udf(SCHEMA)
    def run(column: pa.Array) -> pa.Array:
        titles, errors, ends, cells = [], [], [0], []
        for x in column.to_pylist():
            title = error = None
            try:
                title, verses = parse(x, **options)
                cells += verses
            except (ElementTree.ParseError, AttributeError, KeyError, IndexError, ValueError, TypeError) as e:
                error = f"{type(e).__name__}: {e}"
            titles.append(title)
            errors.append(error)
            ends.append(len(cells))
        parts = [pa.array(c, pa.string()) for c in (zip(*cells, strict=True) if cells else [()] * 3)]
        missing = pa.array([e is not None for e in errors], pa.bool_())
        verses = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["chapter", "verse", "text"]), mask=missing)
        return pa.StructArray.from_arrays([pa.array(titles, pa.string()), verses, pa.array(errors, pa.string())], names=["title", "verses", "error"])

    return df.withColumn("parsed", run(F.col(xml_col)))


# ---- documents in dict form: elements as objects, attributes as @name, text as #text


def collect_text(node) -> list:
    """What stands under #text and w (of an object with unclear: that), at any depth, in order; other strings are no text."""
    if isinstance(node, list):
        return [t for x in node for t in collect_text(x)]
    if not isinstance(node, dict):
        return []
    out = []
    for key, value in node.items():
        if key == "w" and isinstance(value, dict) and "unclear" in value:
            out.append(value["unclear"])
        elif key in ("#text", "w"):
            out.append(value)
        else:
            out += collect_text(value)
    return out


def original_words(node) -> list[str]:
    """Words (w, or its #text) of the readings of type orig, at any depth; what lies beside the readings of an object is passed over."""
    if isinstance(node, list):
        return [t for x in node for t in original_words(x)]
    if not isinstance(node, dict):
        return []
    if "rdg" not in node:
        return [t for x in node.values() for t in original_words(x)]
    words = [r["w"] for r in node["rdg"] if isinstance(r, dict) and r.get("@type") == "orig" and "w" in r]
    words = [w.get("#text") if isinstance(w, dict) else w for w in words]
    return [w for w in words if isinstance(w, str)]


def _from_json(read, kind: str):
    """A column function that applies read to parsed JSON; null for null and for what is no JSON."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        out = []
        for x in column:
            try:
                out.append(None if x is None else read(json.loads(x)))
            except ValueError:
                out.append(None)
        return pd.Series(out)

    return run


def texts_of(json_col: str) -> Column:
    """collect_text of a JSON column; what is no string is given as JSON."""
    return _from_json(lambda x: [t if isinstance(t, str) else json.dumps(t, ensure_ascii=False) for t in collect_text(x)], "array<string>")(F.col(json_col))


def original_words_of(c: Column) -> Column:
    return _from_json(original_words, "array<string>")(c)


def dict_verses(df: DataFrame, keys: list[str], json_col: str = "json") -> DataFrame:
    """keys, chapter, verse, pos, text of documents in dict form (TEI, text, body, div, div, ab); verses that come again are continued.

    A verse is an object with @n in a list ab. Of its words (a list w) strings are added with a blank behind each, without line ends; of
    objects only that they are supplied, as the word SUPPLIED; then come the original words of app. Documents that are no JSON, and all
    that has another form, give no rows.
    """
    doc = df.select(*keys, F.try_parse_json(json_col).alias("d"))
    items = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    divs = doc.select(*keys, F.posexplode(items("d", "$.TEI.text.body.div.div")).alias("i", "div"))
    verses = divs.select(*keys, "i", F.posexplode(items("div", "$.ab")).alias("j", "ab"))
    n = F.try_variant_get("ab", "$['@n']", "string")
    is_object = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    word = lambda x: F.when(is_object(x), F.when(F.try_variant_get(x, "$.supplied", "variant").isNotNull(), "SUPPLIED").otherwise("")).otherwise(F.concat(F.replace(x.cast("string"), F.lit("\n"), F.lit("")), F.lit(" ")))
    words = F.array_join(F.transform(F.filter(items("ab", "$.w"), lambda x: x.isNotNull()), word), "")
    app = F.to_json(F.try_variant_get("ab", "$.app", "variant"))
    read = F.when(app.isNotNull(), F.concat(F.replace(F.array_join(F.coalesce(original_words_of(app), F.array().cast("array<string>")), " "), F.lit("\n"), F.lit("")), F.lit(" ")))
    parts = verses.select(*keys, "i", "j", n.alias("n"), F.concat(F.coalesce(words, F.lit("")), F.coalesce(read, F.lit(""))).alias("t")).where("n is not null")
    parts = parts.select(*keys, F.struct("i", "j").alias("pos"), chapter_of("n").alias("chapter"), verse_of("n").alias("verse"), "t")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "")  # a verse's own parts
    return parts.groupBy(*keys, "chapter", "verse").agg(F.min("pos").alias("pos"), joined.alias("text"))
