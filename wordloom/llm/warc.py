"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing: a row holds one record (headers, blank line, block) and the line separator is the two line ends that close a record, so
the files are plain WARC and follow Spark's commit protocol in any store. Reading: the files are split at every occurrence of
the record magic, whatever it stands in; tasks emit for each candidate record its offset and that of the successor its length
points to; pointer jumping from offset 0 of every file doubles the reach of the marks until no new candidate is reached.
Magic inside payloads is never reached; a payload that holds some is put together again from its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, maybe_broadcast

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
RECORDS_PER_FILE = 2048
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, work: Workspace, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to: who is kept whole and who refers to whom."""
    payload = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    hashed = payload.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    groups = hashed.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("whole"), F.count("*").alias("n")).where("n > 1 and whole is not null")
    groups = work.settle(groups.select("digest", "whole"), "equal-payloads")
    joined = hashed.join(maybe_broadcast(groups), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("whole")), F.col("whole")).alias("refers_to"))


def write_archives(pages: DataFrame, work: Workspace, least_bytes: int = 1000) -> str:
    """One record for each row of page_id, url, html; returns the folder."""
    rows = with_record_types(pages, work, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    rows = rows.select("*", block.alias("block"))
    record = F.concat(
        F.lit(MAGIC),
        F.concat_ws(
            "\r\n",
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", urn("page_id")),
            line("WARC-Target-URI", url),  # null: no such line
            F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
            F.when(revisit, line("WARC-Refers-To", urn("refers_to"))),
            F.lit("Content-Type: application/http; msgtype=response"),
            line("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.lit(END),
        F.col("block"),
    )
    path = work.path("archives")
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def _segments(spark, path: str) -> DataFrame:
    """What stands before the first magic of a file and after each: file, block, seq (its order within the block), value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _parse(block: F.Column, http: F.Column) -> F.Column:
    """The payload of a record's block (binary): without the HTTP headers where it has some."""
    head = F.substring_index(block.cast("string"), END, 1)
    return F.when(http, F.substring(block, F.octet_length(head) + 5, F.octet_length(block))).otherwise(block)


def _reachable(candidates: DataFrame, work: Workspace) -> DataFrame:
    """file, at of all candidates on the chain from offset 0, by pointer jumping on file, at, next."""
    jumps = nodes = work.settle(candidates.select("file", "at", F.col("next").alias("to")), "jumps-0")
    marks, n, k = work.settle(jumps.where("at = 0").select("file", "at"), "marks-0"), 0, 0
    while (now := marks.count()) != n:
        n, k = now, k + 1
        reached = marks.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        target = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        before = marks, jumps
        marks = work.settle(marks.union(reached.join(nodes, ["file", "at"], "left_semi")).distinct(), f"marks-{k}")
        jumps = work.settle(jumps.join(target, ["file", "to"]).select("file", "at", F.col("further").alias("to")), f"jumps-{k}")
        work.drop(*[t for t in before if t is not nodes])
    return marks


def read_archives(spark, path: str, work: Workspace) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each true record, payloads re-hashed as read.

    A revisit record takes bytes and digest from the response it refers to. Candidates without a whole header are no records.
    """
    field = lambda name: F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    parts = _segments(spark, path).select("file", "block", "seq", "value", F.octet_length("value").cast("long").alias("bytes"), F.when(F.contains("value", F.lit(END)), F.substring_index("value", END, 1)).alias("header"))
    parts = parts.select("*", F.octet_length("header").alias("head"), F.expr("try_cast(" + "regexp_extract(header, '(?im)^content-length:[ \\\\t]*([0-9]+)[ \\\\t]*$', 1) as bigint)").alias("length"))
    inside = F.substring(F.col("value").cast("binary"), F.col("head") + 5, F.col("length").cast("int"))
    whole = F.col("bytes") >= F.col("head") + 4 + F.col("length")
    http = field("content-type").startswith("application/http")
    payload = _parse(inside, http)
    parts = parts.select(
        "file", "block", "seq", "bytes", "head", "length", field("warc-type").alias("kind"), field("warc-record-id").alias("id"), field("warc-refers-to").alias("refers"), F.nullif(field("warc-target-uri"), F.lit("")).alias("url"), http.alias("http"),
        whole.alias("whole"), F.when(whole, F.struct(F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))).alias("payload"),
    )
    # files by number: paths are long, and every candidate names its file
    parts = work.settle(parts, "named-candidates")
    files = work.settle(parts.select("file").distinct().select("file", F.monotonically_increasing_id().alias("number")), "files")
    numbered = lambda rows: rows.join(maybe_broadcast(files), "file").withColumn("file", F.col("number")).drop("number")
    named, parts = parts, work.settle(numbered(parts), "candidates")
    work.drop(named)
    # offsets: sums of lengths within a block, then over the blocks of a file
    step, in_block = F.col("bytes") + len(MAGIC), Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("file", "block").agg(F.sum(step).alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = work.settle(blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("base")), "blocks")
    placed = parts.withColumn("inner", F.coalesce(F.sum(step).over(in_block), F.lit(0))).join(maybe_broadcast(blocks), ["file", "block"])
    placed = placed.withColumn("at", F.col("base") + F.col("inner") - len(MAGIC)).drop("base", "inner")
    placed = work.settle(placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + 4 + F.col("length") + len(END)), "placed")
    work.drop(parts)
    true = work.settle(placed.where("next is not null").join(_reachable(placed.where("at >= 0 and next is not null"), work), ["file", "at"], "left_semi"), "records")
    good = true.where("whole").select("id", "url", "kind", "refers", "payload.digest", "payload.size")
    broken = true.where("not whole").select("file", "at", "next", "head", "length", "id", "url", "kind", "refers", "http")
    if broken.take(1):  # payloads that hold the magic: put together what was taken apart
        spans = broken.select("file", F.col("at").alias("from"), "next")
        pieces = placed.select("file", "block", "seq", "at").join(spans, "file").where("at >= from and at < next").select("file", "block", "seq", "at", "from")
        values = numbered(_segments(spark, path)).join(work.settle(pieces, "pieces"), ["file", "block", "seq"])
        text = values.groupBy("file", "from").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value")).withColumnRenamed("from", "at")
        block = F.substring(F.col("value").cast("binary"), F.col("head") + 5, F.col("length").cast("int"))
        put = broken.join(text, ["file", "at"]).select("id", "url", "kind", "refers", _parse(block, F.col("http")).alias("payload"))
        good = good.union(put.select("id", "url", "kind", "refers", F.sha1("payload"), F.octet_length("payload").cast("long")))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    records = work.settle(good.select(number("id").alias("page_id"), "url", "kind", number("refers").alias("refers_to"), "digest", "size"), "payloads")
    named = work.settle(records.where("kind = 'response' and page_id is not null").join(records.where("kind = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.min("digest").alias("whole_digest"), F.min("size").alias("whole_size")), "referred")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = records.withColumn("payload_bytes", F.col("size")).withColumn("payload_digest", F.col("digest")).withColumn("record_type", F.col("kind"))
    # only revisits look up what they refer to: the others would all meet under the null
    visits = records.where("kind = 'revisit'").join(maybe_broadcast(named.withColumnRenamed("page_id", "refers_to")), "refers_to", "left")
    visits = visits.select("page_id", "url", F.col("whole_size").alias("payload_bytes"), F.col("whole_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    return plain.where("kind is null or kind <> 'revisit'").select(*columns).unionByName(visits.select(*columns))


def round_trip(pages: DataFrame, work: Workspace, least_bytes: int = 1000) -> DataFrame:
    """Write page_id, url, html as archives, read them back: one row for each page.

    Null html is an empty payload, null url leaves the target out, a null page_id comes back as null. Of records with equal
    payloads of at least least_bytes that with the largest page_id is the response and the others revisit it (rows that repeat
    this id are responses too). Line ends in a url are escaped. Other columns are left out; empty input gives an empty result.
    """
    path = write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), work, least_bytes)
    return read_archives(pages.sparkSession, path, work).drop("url")
