"""Chunked sequence operators against plain Python on literal and random pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio_spark.operators import ledger as L
from folio_spark.operators import sequence as Q


def ends(df):
    return {r["book"]: r["end_page"] for r in df.collect()}


def reference_end(pages, n, same):
    """The page at which a run of n pages like its first page completes."""
    anchor, count = None, 0
    for page, value in pages:
        if anchor is None:
            anchor, count = value, 0
        elif same(anchor, value):
            count += 1
            if count >= n - 1:
                return page
        else:
            anchor, count = value, 0
    return None


def sequences(seed, books=30, size=60, values=3):
    rng = random.Random(seed)
    return {b: [(p, rng.randrange(values)) for p in range(rng.randrange(1, size))] for b in range(books)}


@pytest.mark.parametrize("width", [4, 7, 4096])
@pytest.mark.parametrize("n", [2, 3, 5])
def test_exact_end(spark, n, width):
    books = sequences(n * 100 + width)
    df = spark.createDataFrame([(b, p, v) for b, ps in books.items() for p, v in ps], "book int, page bigint, v int")
    got = ends(Q.end_of_sequence(df, "book", "page", "v", n=n, width=max(width, n)))
    want = {b: reference_end(ps, n, lambda a, c: a == c) for b, ps in books.items()}
    assert got == {b: e for b, e in want.items() if e is not None}


@pytest.mark.parametrize("width", [4, 9, 4096])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_anchored_end(spark, n, width):
    books = sequences(n * 10 + width, values=64)
    df = spark.createDataFrame(
        [(b, p + 1, [v]) for b, ps in books.items() for p, v in ps], "book int, page bigint, s array<bigint>"
    )
    got = ends(Q.end_of_sequence(df, "book", "page", "s", n=n, threshold=2, width=width))
    near = lambda a, c: bin(a ^ c).count("1") <= 2
    want = {b: reference_end([(p + 1, v) for p, v in ps], n, near) for b, ps in books.items()}
    assert got == {b: e for b, e in want.items() if e is not None}


def test_anchor_does_not_drift(spark):
    # Distances 0, 4, 8 from the first page: the third differs from the anchor.
    df = spark.createDataFrame([(1, 1, [0]), (1, 2, [0xF]), (1, 3, [0xFF])], "book int, page bigint, s array<bigint>")
    assert ends(Q.end_of_sequence(df, "book", "page", "s", n=3, threshold=5)) == {}
    same = spark.createDataFrame([(1, p, [v]) for p, v in enumerate([7, 9, 9, 9], 1)], "book int, page bigint, s array<bigint>")
    assert ends(Q.end_of_sequence(same, "book", "page", "s", n=3, threshold=0)) == {1: 4}
    broken = spark.createDataFrame([(1, p, v) for p, v in enumerate("AABAA", 1)], "book int, page bigint, v string")
    assert ends(Q.end_of_sequence(broken, "book", "page", "v", n=3)) == {}


@pytest.mark.parametrize("width", [5, 4096])
def test_failure_alarm_and_cut(spark, width):
    rng = random.Random(width)
    rows = [(b, p, rng.random() < 0.6) for b in range(20) for p in range(1, rng.randrange(2, 60))]
    df = spark.createDataFrame(rows, "book int, page bigint, failed boolean")
    got = {r["book"]: r["abort_page"] for r in Q.failure_alarm(df, "book", "page", "failed", 5, width=width).collect()}
    want = {}
    for b in range(20):
        run = 0
        for _, p, bad in sorted(r for r in rows if r[0] == b):
            run = run + 1 if bad else 0
            if run == 5:
                want[b] = p
                break
    assert got == want
    kept = Q.abort_on_failure_run(df, "book", "page", "failed", 5, width=width)
    assert kept.count() == sum(1 for b, p, _ in rows if p <= want.get(b, 10**9))


def test_numbering_over_chunks(spark):
    rng = random.Random(5)
    rows = [(b, rng.randrange(1000), i) for b in range(10) for i in range(rng.randrange(1, 80))]
    df = spark.createDataFrame(rows, "book int, t int, i int")
    got = Q.number_pages(df, "book", ["t", "i"], F.floor(F.col("t") / 50))
    for b in range(10):
        mine = [(r["t"], r["i"]) for r in sorted(got.filter(F.col("book") == b).collect(), key=lambda r: r["page"])]
        assert mine == sorted((t, i) for bb, t, i in rows if bb == b)


def test_one_book_holds_most_pages(spark):
    """The hot book is spread over chunks: no task sees more than a chunk of it."""
    hot = spark.range(50_000).select(F.lit(1).alias("book"), F.col("id").alias("page"), (F.col("id") % 1000).alias("v"))
    cold = spark.range(100).select(F.lit(2).alias("book"), F.col("id").alias("page"), F.lit(0).alias("v"))
    df = hot.unionByName(cold)
    chunks = Q.with_neighbours(df, "book", "page", before=1, width=512).groupBy("book", "_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] <= 513
    assert ends(Q.end_of_sequence(df, "book", "page", "v", n=3, width=512)) == {2: 2}


def test_plan_has_no_window_by_book(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("book"), F.col("id").alias("page"), F.col("id").alias("v"))
    plan = Q.end_of_sequence(df, "book", "page", "v")._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all(w.startswith("book#") and w.split(", ")[1].startswith("_chunk#") for w in windows)


def test_input_laid_out_by_book_is_spread_again(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("book"), F.col("id").alias("page"), F.col("id").alias("v"))
    df = df.repartition("book")
    plan = Q.previous_page(df, "book", "page", {"p": "v"})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(book#\d+L, _chunk#\d+L", plan)


def test_cut_joins_by_book_and_share_of_chunks(spark):
    """A book's chunks are dealt to shares, and no join is by the book alone."""
    pages = spark.range(1000).select((F.col("id") % 2).alias("book"), F.floor(F.col("id") / 2).alias("page"))
    cuts = spark.createDataFrame([(1, 300)], "book bigint, cut bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = Q.cut_after(pages, cuts, "book", "page", "cut", width=64)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        outer = [line for line in plan.splitlines() if "LeftOuter" in line]
        assert outer and all("book#" in line and "_salt#" in line for line in outer)
        assert {r["book"]: r["count"] for r in kept.groupBy("book").count().collect()} == {0: 500, 1: 301}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expected_and_resume(spark):
    states = spark.createDataFrame(
        [("a", 3, 5, "in_progress"), ("b", 5, 5, "completed"), ("c", 0, 2, "in_progress"), ("d", 4, 4, "in_progress")],
        "book string, current_page bigint, total_pages bigint, status string",
    )
    got = sorted((r["book"], r["page"]) for r in L.resume_todo(states, "book").collect())
    assert got == [("a", 4), ("a", 5), ("c", 1), ("c", 2)]
    many = spark.createDataFrame([("z", 10_000)], "book string, n bigint")
    pages = L.expected_pages(many, "book", F.lit(1), F.col("n"))
    assert pages.count() == 10_000 and pages.distinct().count() == 10_000


def test_similar_pages_and_score(spark):
    pairs = spark.createDataFrame([([0, 1], [0, 3]), ([0, 0], [255, 255])], "a array<bigint>, b array<bigint>")
    rows = Q.similar_pages(pairs, "a", "b", threshold=5, bits=128).collect()
    assert [r["distance"] for r in rows] == [1, 16]
    assert [r["similar"] for r in rows] == [True, False]
    assert rows[0]["score"] == 1 - 1 / 128
