"""Allow and block rules for addresses as a sort-merge range join of reversed-host keys, in DataFrame functions only.

A host's labels in reverse, each followed by a full stop, make a key in which "this host and all its subdomains" is a prefix, and so
an interval of the sorted keys; with a slash and a path behind it, the same holds for "all paths that start so". Addresses and rules
are cut into the same key ranges, a rule going to each range that its interval meets, and each range is swept in key order. The sweep
keeps a stack: for each depth of nesting the rule opened last. A rule that is deeper in the stack lies inside the ones before it, and
a rule is popped when a key no longer starts with it. The first sweep finds the rule hosts around each address, the second one the
longest path among the rules of each of these hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Key ranges for each shuffle partition; sampled rows for each range; characters of a key that bounds a range.
RANGES, SAMPLED, EDGE = 4, 32, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty where url is null or has no "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at == 0, "").otherwise(F.substr(url, at + 3))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _edges(rows: DataFrame, n: int) -> list[str]:
    """Sorted keys that cut the rows into about n equal ranges, from a sample of about SAMPLED * n rows whatever the input.

    They decide which rows are swept together and nothing else. A key that holds more than a range's share comes several times.
    """
    total = rows.count()
    if not total:
        return []
    keys = sorted(r["key"] for r in rows.select(F.substring("key", 1, EDGE).alias("key")).sample(min(1.0, SAMPLED * n / total), seed=11).collect())
    keys = sorted(keys, key=lambda k: k.encode())  # Spark orders strings by their bytes
    return [keys[len(keys) * i // n] for i in range(1, n)] if keys else []


def _before(edges: list[str], below) -> Column:
    """How many edges, all leading ones, satisfy `below`: by binary search."""
    if not edges:
        return F.lit(0)
    ordered = F.lit(edges)

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & below(F.element_at(ordered, F.least(mid, F.lit(len(edges) - 1)) + 1))
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(edges).bit_length())), start, halve, lambda s: s["lo"])


def sweep(rows: DataFrame, rules: DataFrame, depth: int, salt: Column) -> DataFrame:
    """rows plus stack: prefix and verdict of all rules that their key starts with, outermost first.

    rows: key and others, none called range, kind, opened, depth or stack. rules: prefix, verdict, depth (1 where no other rule's
    prefix starts it, and so on), no prefix twice. Rows of one key may be dealt to any of the ranges that hold it; the salt says to
    which, so a frequent key is no hot range.
    """
    edges = _edges(rows, RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first, last = _before(edges, lambda e: e < F.col("key")), _before(edges, lambda e: e <= F.col("key"))
    dealt = rows.withColumn("range", first).withColumn("range", F.col("range") + F.pmod(salt, last - F.col("range") + 1).cast("int"))
    # a rule meets the ranges from the first that may hold its prefix to the last that may hold a key that starts with it
    meets = F.sequence(_before(edges, lambda e: e < F.col("prefix")), _before(edges, lambda e: F.substr(e, F.lit(1), F.length("prefix")) <= F.col("prefix")))
    opened = rules.select(F.explode(meets).alias("range"), F.col("prefix").alias("key"), F.struct("prefix", "verdict").alias("opened"), "depth", F.lit(0).alias("kind"))
    events = dealt.withColumn("kind", F.lit(1)).unionByName(opened, allowMissingColumns=True)
    w = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"opened{d}" for d in range(1, depth + 1)]
    swept = events.select("*", *[F.last(F.when(F.col("depth") == d, F.col("opened")), ignorenulls=True).over(w).alias(n) for d, n in enumerate(names, 1)]).where("kind = 1")
    stack = F.filter(F.array(*names), lambda r: r.isNotNull() & F.startswith("key", r["prefix"])) if names else F.array().cast("array<struct<prefix:string,verdict:string>>")
    return swept.select(*rows.columns, stack.alias("stack"))


def _nested(rules: DataFrame, ends: Column) -> tuple[DataFrame, int]:
    """rules (prefix) plus depth, and the largest depth. ends: the lengths at which another rule's prefix may end inside."""
    inner = rules.select("prefix", F.explode(ends).alias("n")).select(F.col("prefix").alias("whole"), F.substr("prefix", F.lit(1), F.col("n")).alias("prefix"))
    around = inner.join(rules.select("prefix"), "prefix").groupBy(F.col("whole").alias("prefix")).agg(F.count("*").alias("n"))
    out = rules.join(around, "prefix", "left").withColumn("depth", F.coalesce("n", F.lit(0)).cast("int") + 1).drop("n")
    return out, out.agg(F.max("depth")).first()[0] or 0


def judge(df: DataFrame, rules: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of each row, repeated rows each by itself.

    rules: verdict, host, path. A rule fits an address of its host or a subdomain whose path starts with the rule's. The longest rule
    (characters of host and path) wins, of equally long ones that with the longer host, of the same one twice the larger verdict
    (block before allow). Rules with a null, or whose host holds / ? or #, fit nothing. Where no rule fits, rule is null and the
    verdict is `default`. Null addresses and those without "://" have an empty host and path; null ids stay. Without rules all get
    the default; empty input gives an empty result. Other columns are left out.
    """
    given = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").where("h is not null and p is not null and verdict is not null")
    given = given.where(~F.col("h").rlike("[/?#]")).select(F.translate("h", UPPER, LOWER).alias("h"), "p", "verdict")
    given = given.groupBy("h", "p").agg(F.max("verdict").alias("verdict")).withColumn("at", reversed_host(F.col("h")))
    given = work.settle(given.withColumn("prefix", F.concat("at", F.lit("/"), "p")), "rules")

    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    stops = lambda k: F.filter(F.sequence(F.lit(1), F.length(k) - 1), lambda i: F.substr(k, i, F.lit(1)) == ".")
    hosts = given.select(F.col("at").alias("prefix"), F.lit(None).cast("string").alias("verdict")).distinct()
    hosts, depth = _nested(hosts, F.when(F.length("prefix") > 1, stops(F.col("prefix"))))
    # the row numbers count from here on, as the table is written once
    around = sweep(rows, hosts, depth, F.xxhash64("id", "path", F.monotonically_increasing_id())).select(F.monotonically_increasing_id().alias("row"), "id", "host", "path", F.col("stack.prefix").alias("stack"))
    around = work.settle(around, "hosts")

    lengths = sorted(r[0] for r in given.select(F.length("prefix")).distinct().collect())  # no more than the longest rule has characters
    inner = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: (n > F.length("at")) & (n < F.length("prefix")))
    nested, depth = _nested(given, inner)
    asked = around.where(F.size("stack") > 0).select("row", "id", "host", "path", F.explode("stack").alias("at")).select("row", "id", "host", "path", F.concat("at", F.lit("/"), "path").alias("key"))
    found = sweep(asked, nested.select("prefix", "verdict", "depth"), depth, F.xxhash64("row"))
    # the deepest rule of each host is its longest
    found = found.select("row", "id", "host", "path", F.get("stack", F.size("stack") - 1).alias("r"))
    cut = F.locate("/", F.col("r.prefix"))
    own = F.substr("r.prefix", F.lit(1), cut - 2)
    name = F.concat(F.array_join(F.reverse(F.split(own, r"\.")), "."), F.substr("r.prefix", cut + 1))
    hit = F.when(F.col("r").isNotNull(), F.struct(F.length(name).alias("n"), F.length(own).alias("m"), name.alias("rule"), F.col("r.verdict").alias("verdict")))
    best = found.groupBy("row", "id", "host", "path").agg(F.max(hit).alias("hit"))
    said = best.select("id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
    none = around.where(F.size("stack") == 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return said.unionByName(none).withColumnRenamed("id", id_col)
