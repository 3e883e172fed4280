"""Readers and writers of corpora. A corpus is a table book, chapter, verse, text, with pos for the order in the file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import labels, text
from .scratch import Scratch

NESTED = "map<string,map<string,map<string,string>>>"
#: Corpora by language; noise levels (target character error rate) by corpus.
CORPORA = {"grc": "sblgnt", "lat": "vulgata", "seals": "seals"}
NOISE_LEVELS = {"greek": {"mild": 0.02, "sota": 0.05, "severe": 0.10}, "lat": {"mild": 0.02, "sota": 0.04, "severe": 0.10}, "seals": {"mild": 0.15, "sota": 0.30}}


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file book / chapter / verse to text, one row for each verse. Positions keep the file's order."""
    raw = spark.read.text(path, wholetext=True).select(F.map_entries(F.from_json("value", NESTED)).alias("m"))
    books = raw.select(F.posexplode("m").alias("b", "book"))
    chapters = books.select("b", F.col("book.key").alias("book"), F.posexplode(F.map_entries("book.value")).alias("c", "chapter"))
    verses = chapters.select("b", "c", "book", F.col("chapter.key").alias("chapter"), F.posexplode(F.map_entries("chapter.value")).alias("v", "verse"))
    return verses.select("book", "chapter", F.col("verse.key").alias("verse"), F.col("verse.value").alias("text"), F.struct("b", "c", "v").alias("pos"))


#: Strings of a file that one task numbers.
STRETCH = 1 << 16


def read_nested_split(spark: SparkSession, path: str) -> DataFrame:
    """What read_nested gives, with each range of a large file read by a task of its own.

    The text is read in pieces that end at quotes, which is where a file can be split. A quote after an odd number of backslashes stands
    inside a string, so the number of other quotes before a piece says which string or gap it belongs to: those of a range are counted
    within it, and the sums of the ranges before are added. Braces in gaps give the depth, a colon behind a string makes it a key, and
    each value takes the last key of each depth; both are carried over stretches of strings in the same two steps.
    """
    work = Scratch(spark, "nested")
    pieces = spark.read.option("lineSep", '"').text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    pieces = work.settle(pieces.withColumn("quote", 1 - F.length(F.regexp_extract("value", r"(\\*)$", 1)) % 2))
    so_far = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("file", "block").agg(F.sum("quote").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(so_far("file", "block")), F.lit(0)).alias("before"))
    placed = pieces.withColumn("n", F.coalesce(F.sum("quote").over(so_far("file", "block", "at")), F.lit(0))).join(ranges, ["file", "block"])
    # a string and the gap behind it share k; the gap before the first string has k = 0
    placed = placed.withColumn("s", F.col("n") + F.col("before")).withColumn("k", F.floor((F.col("s") + 1) / 2))
    whole = lambda odd: F.array_join(F.transform(F.filter("all", lambda x: x["s"] % 2 == odd), lambda x: x["value"]), '"')
    strings = placed.groupBy("file", "k").agg(F.sort_array(F.collect_list(F.struct("s", "block", "at", "value"))).alias("all")).select("file", "k", whole(1).alias("string"), whole(0).alias("gap"))
    strings = work.settle(strings.withColumn("stretch", F.floor(F.col("k") / STRETCH)).withColumn("opens", F.length(F.regexp_replace("gap", "[^{]", "")) - F.length(F.regexp_replace("gap", "[^}]", ""))))
    deeper = strings.groupBy("file", "stretch").agg(F.sum("opens").alias("n")).select("file", "stretch", F.coalesce(F.sum("n").over(so_far("file", "stretch")), F.lit(0)).alias("deep"))
    depth = F.coalesce(F.sum("opens").over(so_far("file", "stretch", "k")), F.lit(0)) + F.col("deep")
    named = strings.join(deeper, ["file", "stretch"]).withColumn("depth", depth).where("k > 0")
    named = named.withColumn("string", F.from_json(F.concat(F.lit('["'), "string", F.lit('"]')), "array<string>")[0]).withColumn("is_key", F.col("gap").rlike(r"^\s*:"))
    names = ("book", "chapter", "verse")
    keys = [F.when(F.col("is_key") & (F.col("depth") == d), F.struct("k", F.col("string").alias("name"))).alias(c) for d, c in enumerate(names, 1)]
    named = named.select("file", "k", "stretch", "string", "gap", "depth", "is_key", *keys)
    # the last keys within a stretch, else those of the stretches before
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    carried = named.groupBy("file", "stretch").agg(*[F.max(c).alias(c) for c in names]).select("file", "stretch", *[last(c, so_far("file", "stretch")).alias(f"{c}_before") for c in names])
    here = Window.partitionBy("file", "stretch").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = named.join(carried, ["file", "stretch"]).select("file", "k", "string", "gap", "depth", "is_key", *[F.coalesce(last(c, here), f"{c}_before")["name"].alias(c) for c in names])
    bare = F.regexp_extract("gap", r"^\s*:\s*([^\s,{}\[\]]+)", 1)  # a value that is no string
    verses = filled.where("depth = 3").withColumn("bare", F.when(F.col("is_key"), bare).otherwise("")).where("not is_key or bare <> ''")
    text_ = F.when(~F.col("is_key"), F.col("string")).when(F.col("bare") != "null", F.col("bare"))
    return verses.select(*names, text_.alias("text"), F.struct("file", "k").alias("pos"))


def write_nested(df: DataFrame, path: str) -> None:
    """One JSON object for each book (a line each), non-ASCII kept; read_nested_split reads it back (read_nested: files of one book)."""
    by_pos = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    order = lambda key, value: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", key, value)), by_pos), lambda x: F.struct(x[key], x[value])))
    if "pos" not in df.columns:
        df = df.withColumn("pos", F.struct("book", "chapter", "verse"))
    c = df.groupBy("book", "chapter").agg(F.min("pos").alias("p"), order("verse", "text").alias("verses")).withColumnRenamed("p", "pos")
    b = c.groupBy("book").agg(order("chapter", "verses").alias("chapters"))
    b.select(F.to_json(F.map_from_arrays(F.array("book"), F.array("chapters"))).alias("value")).write.mode("overwrite").text(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer tasks than there are cores, as files of one row group do; else df itself.

    One exchange of the rows, only ever of a table too small to keep the cores busy; texts of any length land anywhere, no key is hot.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents_as_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus: a verse for each line with a word; book = source, chapter = doc_id, verse = line."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("book"), "doc_id", "lang", "text"))
    found = docs.select("book", "doc_id", "lang", _lines.asNondeterministic()("text").alias("found")).select("book", "doc_id", "lang", F.inline("found"))
    return found.select("book", "doc_id", "lang", "line", F.split("text", " ").alias("words"), "text")


@F.arrow_udf(ArrayType(StructType([StructField("line", IntegerType()), StructField("text", StringType())])))
def _lines(texts: pa.Array) -> pa.Array:
    """Each line with a word, its words one blank apart: Python splits at the white space of `text.WHITE`."""
    ends, place, out = [0], [], []
    for t in texts.to_pylist():
        for k, raw in enumerate((t or "").split("\n")):
            if line := " ".join(raw.split()):
                place.append(k)
                out.append(line)
        ends.append(len(out))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(out, pa.string())], names=["line", "text"]))


def unspaced_texts(df: DataFrame) -> DataFrame:
    """Texts without U+0020, those that become empty dropped."""
    return df.withColumn("text", text.without_spaces("text")).where("text <> ''")


def annotated_corpus(df: DataFrame, scheme: str = "binary") -> DataFrame:
    """Keys, text (without spaces, lower case), labels (of the original), verse_text; same_length tells where they disagree."""
    if scheme not in labels.SCHEMES:
        raise ValueError(f"unknown annotation scheme: {scheme}")
    out = df.withColumn("verse_text", F.col("text")).withColumn("labels", labels.annotate(text.words("text"), scheme))
    out = out.withColumn("text", F.lower(text.without_spaces("text")))
    return out.withColumn("same_length", F.length("text") == F.size("labels"))


def write_annotated(df: DataFrame, path: str) -> None:
    """Lines `text - ['I', 'E'] - verse`."""
    shown = F.concat(F.lit("['"), F.array_join("labels", "', '"), F.lit("']"))
    df.select(F.concat_ws(" - ", "text", shown, "verse_text").alias("value")).write.mode("overwrite").text(path)


def read_annotated(spark: SparkSession, path: str, scheme: str = "binary") -> DataFrame:
    """text, label_ids of the lines of write_annotated; a line that does not part at - into three is an error when read."""
    parts = F.split("value", "-")
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three parts: "), F.col("value"))))
    named = F.split(F.regexp_replace(F.element_at("p", 2), r"[\[\]']", ""), ",")
    return spark.read.text(path).select(checked.alias("p")).select(text.strip(F.element_at("p", 1)).alias("text"), labels.ids(F.transform(named, F.trim), scheme).alias("label_ids"))


def annotated_texts(spark: SparkSession, path: str) -> DataFrame:
    """What stands before the first - of each line."""
    return spark.read.text(path).select(text.strip(F.substring_index("value", "-", 1)).alias("text"))


def read_morphology(spark: SparkSession, path: str) -> DataFrame:
    """Seven columns by single blanks: verses of words, each followed by a blank; the book is part 2 of the file name at -.

    Words stand in the order of the lines; a repeated reference goes on where it stopped.
    """
    raw = spark.read.text(path).select(F.split(F.col("_metadata.file_name"), "-").alias("n"), F.monotonically_increasing_id().alias("at"), F.split("value", " ").alias("f"))
    rows = raw.where(F.size("f") >= 5).select(F.regexp_replace(F.element_at("n", 2), r"\..*$", "").alias("book"), "at", F.substring(F.col("f")[0], 3, 2).cast("int").cast("string").alias("chapter"), F.substring(F.col("f")[0], 5, 2).cast("int").cast("string").alias("verse"), F.col("f")[4].alias("word"))
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " "), F.lit(" "))
    return rows.groupBy("book", "chapter", "verse").agg(F.min("at").alias("pos"), joined.alias("text"))


def read_ocr_pairs(spark: SparkSession, folder: str, suffix: str, alphabet: str, table: dict[str, str]) -> DataFrame:
    """base, gt, noisy of files X.txt and X_gt.txt whose X ends with suffix; both lower-cased, folded, kept to the alphabet."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("base"), F.col("value").alias("t"))
    clean = lambda c: text.keep_alphabet(text.fold(F.lower(text.strip(c)), table), alphabet)
    truth = files.where(F.endswith("base", F.lit("_gt"))).select(F.regexp_replace("base", "_gt$", "").alias("base"), clean("t").alias("gt"))
    noisy = files.where(~F.endswith("base", F.lit("_gt")) & F.endswith("base", F.lit(suffix))).select("base", clean("t").alias("noisy"))
    return truth.join(noisy, "base")


def manuscript_ids(spark: SparkSession, uncials: tuple[int, int] | None = (1, 326), papyri: tuple[int, int] | None = (1, 135), minuscules: tuple[int, int] | None = (1, 500)) -> DataFrame:
    """pos, ms_id: prefix 2, 1 or 3 and the number in four digits; range ends excluded; a missing range gives none."""
    parts = [(prefix, r) for prefix, r in (("2", uncials), ("1", papyri), ("3", minuscules)) if r and r[0] < r[1]]
    out = spark.createDataFrame([], "pos long, ms_id string")
    at = 0
    for prefix, (a, b) in parts:
        out = out.union(spark.range(a, b).select((F.col("id") - a + at).alias("pos"), F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 4, "0"))))
        at += b - a
    return out


def write_distributions(tables: DataFrame, path: str, exclude: str = text.GAP) -> None:
    """Noise tables (kind, ch, key, p) as JSON lines, without the rows of excluded characters."""
    tables.where(~F.contains(F.lit(exclude), F.col("ch"))).write.mode("overwrite").json(path)


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, ch string, key string, p double").json(path)


def write_distributions_nested(tables: DataFrame, path: str, exclude: str = text.GAP) -> None:
    """Noise tables as one JSON object in the published layout: character_distribution by character, the other kinds by character and
    key. Excluded characters go as outer keys; inner keys may still be one. The tables are small: an alphabet's rows times its letters."""
    rows = tables.where(~F.contains(F.lit(exclude), F.col("ch")))
    plain = rows.where(F.col("key").isNull()).groupBy("kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ch", "p")))).alias("plain"))
    by_key = rows.where(F.col("key").isNotNull()).groupBy("kind", "ch").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "p")))).alias("keys"))
    nested = by_key.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("ch", "keys"))).alias("nested"))
    entry = lambda c: F.concat(F.lit('"'), "kind", F.lit('": '), F.to_json(c)).alias("v")
    parts = plain.select(entry("plain")).unionByName(nested.select(entry("nested")))
    parts.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("v")), ", "), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def read_distributions_nested(spark: SparkSession, path: str) -> DataFrame:
    """kind, ch, key, p of a file in the published layout; kinds that it lacks give no rows."""
    kinds = "character_distribution map<string,double>, " + ", ".join(f"{k} map<string,map<string,double>>" for k in ("conditional", "substitutions", "insertions"))
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("d")).select("d.*")
    plain = raw.select(F.explode("character_distribution").alias("ch", "p")).select(F.lit("character_distribution").alias("kind"), "ch", F.lit(None).cast("string").alias("key"), "p")
    for kind in ("conditional", "substitutions", "insertions"):
        by_key = raw.select(F.explode(kind).alias("ch", "keys")).select(F.lit(kind).alias("kind"), "ch", F.explode("keys").alias("key", "p"))
        plain = plain.unionByName(by_key)
    return plain


def write_scores(summary: DataFrame, path: str) -> None:
    """metric, value as one CSV file."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_segments(df: DataFrame, path: str, words_col: str = "words", text_col: str = "text") -> None:
    """Lines `(['in', 'principio'], 'in principio')`: words found and the verse, quoted as Python quotes strings.

    Null words are an empty list and a null verse the empty string; line ends are escaped, so a row is always one line.
    """

    def quoted(c):
        plain = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        double = F.contains(plain, F.lit("'")) & ~F.contains(plain, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))

    shown = F.coalesce(F.array_join(F.transform(words_col, quoted), ", "), F.lit(""))
    line = F.concat(F.lit("(["), shown, F.lit("], "), quoted(F.coalesce(text_col, F.lit(""))), F.lit(")"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
