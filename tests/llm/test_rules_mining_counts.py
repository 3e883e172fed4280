"""URL filters, hard negatives and dominance counts against brute force, with nulls, ties, repeats, long values and name clashes."""

import random
import zlib
from collections import Counter
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import dominance, hard_negatives, queries, url_filter
from wordloom.llm.common import Workspace

# ---- URL filters


def brute_judge(url, rules, default="allow"):
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if None not in (v, h, p) and not set(h) & set("/?#") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, rows, rules):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, range int")
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = url_filter.judge(df, given, Workspace(spark, "urls"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return Counter(map(tuple, out.collect()))


def check_judged(spark, rows, rules):
    assert judged(spark, rows, rules) == Counter((i, *brute_judge(u, rules)) for i, u in rows)


def test_rules_by_brute_force(spark):
    rng = random.Random(2)
    labels, parts = ["com", "net", "example", "www", "a", "a-b", "", "é", "x" * 70], ["", "/", "/en", "/en/", "/en/a", "/e", "/en/a/b", "/EN/", "//", "/" + "y" * 300]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice(parts)) for _ in range(60)]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice([host(), host().upper()])}{rng.choice(parts)}{rng.choice(['', 'tail', '/more', '?q=/en/', '#/en/'])}" for _ in range(600)]
    check_judged(spark, list(enumerate(urls)), rules)


def test_rules_odd_rows(spark):
    rules = queries.RULES + [("block", None, "/"), ("block", "a.b", None), (None, "a.b", "/"), ("block", "a/b", "/"), ("allow", "net", "/es/"), ("block", "", ""), ("allow", "org.", "/")]
    urls = [None, "", "no scheme.com/en/", "http://", "http://example.com", "http://example.com/en/", "http://WWW.Example.COM/en/?x=://net/es/", "http://user@example.com:80/en/", "x://http://a.net/es/", "http://example.com./en/", "http://b.org./x", "http://net/es/1", "http://notnet/es/", "http://a.net/es\n/", "://net/fr/"]
    urls += ["http://" + "a." * 5000 + "net/fr/" + "z" * 100_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://net/es/")] * 3 + [(5, "http://example.com/en/")] * 2
    check_judged(spark, rows, rules)
    check_judged(spark, rows, [])
    assert judged(spark, [], rules) == Counter()


def test_rules_of_one_host_and_address(spark):
    """One address and one rule host hold most rows; rules are nested as deep as paths are long."""
    rules = [("block" if n % 2 else "allow", "big.com", "/" + "p" * n) for n in range(40)] + [("allow", "com", "/")]
    rows = [(i, "http://s.big.com/" + "p" * (i % 50)) for i in range(400)] + [(7, "http://s.big.com/ppp")] * 3000
    check_judged(spark, rows, rules)


def test_rules_use_data_frame_functions_only(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    plan = url_filter.judge(df, spark.createDataFrame(queries.RULES, "verdict string, host string, path string"), Workspace(spark, "urls"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- hard negatives


def brute_mine(rows, every=100, k=5, m=10):
    ok = [(i, lab, [int(np.floor(float(x) * 256)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, lab, v in sorted(ok):
        if i % every == 0:
            first.setdefault(i, (lab, v))
    out = Counter()
    for i, (lab, v) in first.items():
        score = lambda w, v=v: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))
        others = [(-score(w), j, of == lab) for j, of, w in ok if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in others if x[2])[:k]:
            inside = sorted((t, n) for t, n, same in others if not same and 30 * -s <= 100 * -t <= 90 * -s)
            out.update((i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(inside[:m], 1))
    return out


def mined(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"vec_id long, label int, embedding array<{kind}>, block string, n int")
    return Counter(map(tuple, hard_negatives.mine(df, Workspace(spark, "mine"), F.col("vec_id") % 100 == 0, F.col("label")).collect()))


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_mining_by_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(5, dim))
    rows = [(i, int(c), [float(np.float32(x)) for x in centres[c] * 0.5 + rng.normal(size=dim) * 0.7]) for i, c in enumerate(rng.integers(0, 5, 900))]
    got = mined(spark, rows)
    assert got == brute_mine(rows) and (dim == 1 or len(got) > 100)


def test_mining_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [1.0, float(i % 7) / 7]) for i in range(60)]  # ties
    rows += [(100 * i, i % 3, [1.0, 0.5]) for i in range(4)] + [(100, 1, [1.0, 0.25]), (31, 2, [0.7, 0.1]), (31, 2, [0.7, 0.1])]  # repeated ids and rows
    rows += [(200, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (301, 1, None), (302, 1, [1.0, nan]), (303, 1, [inf, 1.0]), (304, 1, [None, 1.0]), (400, 2, []), (401, 2, []), (402, 1, []), (500, 1, [0.0, 0.0])]
    rows += [(600 + i, i % 2, [float(x) for x in rng.normal(size=3)]) for i in range(30)]
    assert mined(spark, rows) == brute_mine(rows)
    assert mined(spark, []) == Counter() and mined(spark, [(100, 1, None)]) == Counter()


def test_mining_large_numbers(spark):
    """Whole numbers beyond 32 and beyond 63 bits."""
    rng = np.random.default_rng(6)
    for size in (1e9, 1e30):
        rows = [(i * 10, i % 3, [float(x) for x in size * (1 + rng.random(4))]) for i in range(60)]
        assert mined(spark, rows, "double") == brute_mine(rows)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(2000, 64)) * 32)
    block = hard_negatives.Block(np.arange(2000), np.zeros(2000, np.int64), v)
    q = v[:20]
    upper, below = block.bounds(q, 0, 2000)
    exact = (block.vectors.astype(np.int64) @ q.T.astype(np.int64)).T
    assert (exact <= upper).all() and (exact >= upper - below[:, None]).all()
    looked = []
    block.exact, whole = lambda rows, a: looked.append(len(rows)) or hard_negatives.Block.exact(block, rows, a), block.exact
    list(block.positives(q, np.arange(20), 0, 5))
    assert sum(looked) < 0.2 * 20 * 2000


# ---- dominance counts


def brute_counts(points):
    """points: slot, level, weight."""
    out = []
    for s, x, _ in points:
        over = [(w or 1) for t, y, w in points if None not in (s, x, t, y) and t <= s and y > x]
        out.append((s, x, None, None) if None in (s, x) else (s, x, len(over), sum(over)))
    return out


def counted(spark, points):
    df = spark.createDataFrame([(i, *p, "x") for i, p in enumerate(points)], "id long, a long, b long, weight long, shard string")
    out = dominance.count_above(df.withColumn("Slot", F.lit("old")), Workspace(spark, "above"), F.col("a"), F.col("b"), F.col("weight"))
    assert out.columns == ["id", "a", "b", "weight", "shard", "slot", "level", "n_sales", "n_rows"]
    return {r["id"]: (r["slot"], r["level"], r["n_sales"], r["n_rows"]) for r in out.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_counts_by_brute_force(spark, seed):
    rng = random.Random(seed)
    n, slots, levels = 1500, rng.choice([1, 9, 10**15]), rng.choice([1, 40, 10**18])
    points = [(rng.choice([None, *[rng.randint(-slots, slots)] * 30]), rng.choice([None, *[rng.randint(-levels, levels)] * 30]), rng.choice([None, 1, 2, 3])) for _ in range(n)]
    points += [(slots // 2, levels // 2, 2)] * 700  # one point holds a third of the rows
    points += [(slots // 3, rng.randint(-levels, levels), 1) for _ in range(300)] + [(rng.randint(-slots, slots), levels // 3, 1) for _ in range(300)]
    rng.shuffle(points)
    assert counted(spark, points) == dict(enumerate(brute_counts(points)))


def test_counts_of_few_rows(spark):
    for points in ([], [(1, 1, 1)], [(None, 1, 1), (1, None, 1)], [(1, 5, 2), (1, 5, 2), (1, 4, 1), (0, 9, 3), (2, 4, 1)]):
        assert counted(spark, points) == dict(enumerate(brute_counts(points)))


def test_runs_are_few():
    runs, rng = dominance.Runs(), np.random.default_rng(1)
    level, weight = rng.integers(0, 1000, 60_000), rng.integers(1, 4, 60_000)
    rows, weights = runs.pass_through(level, weight)
    for i in rng.integers(0, 60_000, 50):
        over = level[:i] > level[i]
        assert rows[i] == over.sum() and weights[i] == weight[:i][over].sum()
    assert len(runs.runs) <= 8 and [len(r[0]) for r in runs.runs] == sorted((len(r[0]) for r in runs.runs), reverse=True)


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland", "America/Los_Angeles"])
def test_slots_and_levels_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moments = [datetime(2024, 1, 1), datetime(2024, 3, 31, 23, 59, 59, 999999), datetime(1969, 12, 31, 23, 59, 59), None]
        text = [None if m is None else str(m) for m in moments]
        ntz = spark.createDataFrame([(t,) for t in text], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
        ltz = spark.createDataFrame([(t and t + "Z",) for t in text], "t string").select(F.col("t").cast("timestamp").alias("t"))
        want = [None if m is None else (m.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(days=1) for m in moments]
        for df in (ntz, ltz):
            assert [r[0] for r in df.select(dominance.day_of("t", df)).collect()] == want
        days = spark.createDataFrame([(date(1970, 1, 2),)], "t date")
        assert days.select(dominance.day_of("t", days)).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    totals = [0.0, 9.994, 9.995, 10221.56, -0.01, 1e15, 1e300, float("nan"), float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in totals], "t double").select(dominance.level_of(F.col("t"))).collect()]
    assert got == [int(np.floor(np.floor(100 * t + 0.5) / 1000)) if t is not None and abs(t) < 1e18 else None for t in totals]
    ids = [0, 7, 123456789, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(dominance.repeats_of(F.col("i"))).collect()]
    assert got == [1 + (zlib.crc32(str(i).encode()) % 3 if i is not None else 0) for i in ids]
