"""Segmented scans against plain windows, with one key of nine rows in ten."""

import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagequarry.operators import assets, metrics, ranking
from pagequarry.plans import catalogue
from tests.conftest import MEDIUM
from tests.oracle import compare, connection


def hot_rows(n=4000):
    rng = random.Random(2)
    rows = [(None if i % 97 == 0 else "hot" if i % 10 else f"k{i % 7}", i // 2, i, rng.choice(["a", "b", None]), rng.randint(-5, 9)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def hot(spark):
    return spark.createDataFrame(hot_rows(), "k string, ts long, id long, state string, size int")


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_in_ranges(hot, monkeypatch, ahead):
    step = F.lead if ahead else F.lag
    want = hot.withColumn("other", step("state").over(Window.partitionBy("k").orderBy("ts", "id")))
    plain = ranking.beside(hot, ["k"], ["ts", "id"], "state", "other", ahead)
    monkeypatch.setattr(ranking, "MOST_ROWS", 0)
    cut = ranking.beside(hot, ["k"], ["ts", "id"], "state", "other", ahead)
    assert cut.columns == want.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(plain) == rows(want) == rows(cut)


def test_sums_in_ranges(hot, monkeypatch):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = hot.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(ranking.sum_before(hot, ["k"], ["ts", "id"], "size", "before")) == rows(want)
    monkeypatch.setattr(ranking, "MOST_ROWS", 0)
    assert rows(ranking.sum_before(hot, ["k"], ["ts", "id"], "size", "before")) == rows(want)
    assert ranking.sum_before(hot.limit(0), ["k"], ["ts"], "size", "before").count() == 0


def test_a_hot_key_is_spread(hot):
    """The largest partition has no more than twice the rows of the median one, and the window needs no exchange after the dealing."""
    dealt = ranking.in_ranges(hot, ["k"], ["ts", "id"])
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * median(sizes)
    scanned = dealt.withColumn("x", F.lag("state").over(Window.partitionBy("k", "_range").orderBy("ts", "id")))
    assert scanned._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_changes_and_budget_of_a_hot_key(hot, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_ROWS", 100)
    by_key = {}
    for r in hot_rows():
        by_key.setdefault(r[0], []).append(r)
    changed, cheap = set(), set()
    for k, rows in by_key.items():
        rows.sort(key=lambda r: (r[1], r[2]))
        changed |= {(k, b[2], a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False) if a[3] and b[3] and a[3] != b[3]}
        total = 0
        for r in rows:
            cheap |= {(r[2], total)} if total < 50 else set()
            total += r[4]
    got = metrics.changes(hot, "k", "ts", "id", F.col("state")).select("k", "id", "previous", "status").collect()
    assert {tuple(r) for r in got} == changed and len(got) == len(changed)
    sized = hot.select(F.col("k").alias("page_id"), F.struct("ts", "id").alias("pos"), "size", "id")
    assert {(r["id"], r["before"]) for r in assets.within_budget(sized, "size", 50).collect()} == cheap


@pytest.mark.parametrize("name", ["common_lines", "status_change", "asset_byte_budget"])
def test_queries_in_ranges(spark, monkeypatch, name):
    monkeypatch.setattr(ranking, "MOST_ROWS", 0)
    differs, _, _ = compare(spark, connection(MEDIUM), catalogue.QUERIES[name], catalogue.SQL[name], MEDIUM)
    assert differs is None


def test_sketches_merge(spark):
    """Hours merged to days are as good as days; estimates hold their stated errors; nulls count in n only."""
    rng = random.Random(7)
    rows = [(f"2024-01-0{1 + i % 3} {i % 24:02}:10:00", i % 2, i % 5 != 0, rng.random() if i % 11 else None, f"m{rng.randint(0, 3000)}" if i % 13 else None) for i in range(20_000)]
    frame = spark.createDataFrame([(*r[1:], r[0]) for r in rows], "k int, ok boolean, value double, member string, at string").withColumn("ts", F.to_timestamp("at"))
    hourly = metrics.sketched(frame, "ts", ["k"], F.col("ok"), "value", "member")
    got = {(r["k"], r["start"].day): r for r in metrics.read_sketches(metrics.rolled(hourly, ["k"], "1 day"), ["k"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert len(got) == 6
    for (k, day), r in got.items():
        own = [x for x in rows if x[1] == k and int(x[0][8:10]) == day]
        values, members = sorted(x[3] for x in own if x[3] is not None), {x[4] for x in own if x[4]}
        assert r["n"] == len(own) and r["ratio"] == sum(not x[2] for x in own) / len(own)
        assert abs(r["distinct"] - len(members)) <= 0.06 * len(members)
        assert values[int(0.47 * len(values))] <= r["p50"] <= values[int(0.53 * len(values))] and values[int(0.92 * len(values))] <= r["p95"] <= values[int(0.98 * len(values))]
    nothing = frame.filter("value IS NULL").limit(3)
    assert [r["p50"] for r in metrics.read_sketches(metrics.sketched(nothing, "ts", [], F.col("ok"), "value", "member"), [], {"p50": 0.5}).collect()] == [None] * nothing.select("ts").distinct().count()
    # a length that is no multiple of the slide
    odd = metrics.windowed_ratio(frame, "ts", F.col("ok"), "50 minutes", "20 minutes")
    assert odd.agg(F.sum("n")).first()[0] == frame.select(F.window("ts", "50 minutes", "20 minutes")).count()


def test_a_keyword_pair_on_many_pages_is_cut_into_tiles(spark):
    from pagequarry.operators import related

    rng = random.Random(9)
    sets = [sorted({"hot", "pair", f"w{i}", *rng.sample(["a", "b", "c"], rng.randint(0, 2))}) for i in range(60)] + [sorted(rng.sample(["a", "b", "c", "d", "hot"], 3)) for _ in range(10)]
    distinct = sorted({tuple(s) for s in sets})
    classes = spark.createDataFrame([(list(s), sets.count(list(s))) for s in distinct], "keywords array<string>, pages long")
    want = {(a, b, len(set(a) & set(b))) for a in distinct for b in distinct if len(set(a) & set(b)) >= 2}
    for tile in (7, 512):
        got = [(tuple(r["a"]), tuple(r["b"]), r["n"]) for r in related.overlapping_classes(classes, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_common_lines_of_long_texts(spark):
    """The other text is cut into lines once, not once for each line."""
    import time

    from pagequarry.functions import text

    a = [f"line number {n}" for n in range(12_000)]
    b = [f"  line number {n}\t" for n in range(6_000, 18_000)] + ["short"]
    rows = [("\n".join(["short", *a, a[7_000]]), "\n".join(b)), ("a line of one text", "a line of the other"), (None, "x"), ("x", None)]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(text.common_lines(F.col("a"), F.col("b"))).collect()]
    assert got == ["\n".join([*a[6_000:], a[7_000]]), "", None, None]
    assert time.time() - began < 30


def test_rolled_members_within_five_percent(spark):
    """40,000 members in each of 75 groups, merged from four hours: slo_sketches promises 5 % for some thousands of windows, so the worst of few must stay well within."""
    rows = spark.range(0, 3_000_000, numPartitions=8).select((F.col("id") % 75).alias("g"), F.col("id").alias("m"), F.timestamp_seconds(F.col("id") % 4 * 3600).alias("ts"), F.lit(1.0).alias("v"))
    hourly = metrics.sketched(rows, "ts", ["g"], F.lit(True), "v", "m")
    got = metrics.read_sketches(metrics.rolled(hourly, ["g"], "1 day"), ["g"], {"p95": 0.95})
    worst = got.agg(F.count("*"), F.max(F.abs(F.col("distinct") / 40_000 - 1))).first()
    assert worst[0] == 75 and worst[1] < 0.03, worst
