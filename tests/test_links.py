"""Chains by cursor and trees of any depth: ends, gaps, cycles and forests."""

from __future__ import annotations

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators import links


def test_cursor_chains(spark):
    rng = random.Random(2)
    rows = []
    for crawl, n in (("whole", 37), ("one", 1), ("short", 10), ("gap", 20), ("cycle", 9), ("self", 3)):
        names = [None, *(f"{crawl}{rng.random()}" for _ in range(n - 1)), None]
        pages = [(crawl, names[k], names[k + 1], 10, n * 10 if crawl != "short" else 120) for k in range(n)]
        if crawl == "gap":
            pages.pop(12)
        if crawl == "cycle":
            pages[-1] = (*pages[-1][:2], names[4], 10, 90)
        if crawl == "self":
            pages[-1] = (*pages[-1][:2], names[2], 10, None)
        rows += pages
    rows += [("no first", "x", "y", 5, 5), (None, None, None, 3, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "crawl string, cursor string, next string, cards int, stated int")
    runs = {r["crawl"]: tuple(r)[1:] for r in links.cursor_runs(df, ["crawl"]).collect()}
    assert runs == {
        "whole": (37, 370, "end", True), "one": (1, 10, "end", True), "short": (10, 100, "end", False), "gap": (12, 120, "gap", False),
        "cycle": (9, 90, "cycle", False), "self": (3, 30, "cycle", False), None: (1, 3, "end", True),
    }
    placed = links.cursor_pages(df, ["crawl"])
    assert placed.count() == len(rows)
    by = {}
    for r in placed.where("place IS NOT NULL").collect():
        by.setdefault(r["crawl"], {})[r["place"]] = r
    for pages in by.values():
        assert sorted(pages) == list(range(len(pages))) and all(pages[k]["next"] == pages[k + 1]["cursor"] for k in range(len(pages) - 1))
    assert placed.where("crawl = 'gap' AND place IS NULL").count() == 7 and placed.where("crawl = 'no first' AND place IS NULL").count() == 1
    assert links.cursor_runs(df.limit(0), ["crawl"]).count() == 0


def test_pages_that_repeat_a_cursor(spark):
    rows = [("c", None, "a"), ("c", None, "b"), ("c", "a", None), ("c", "b", None), ("c", "a", None)]
    df = spark.createDataFrame(rows, "crawl string, cursor string, next string").withColumns({"cards": F.lit(1), "stated": F.lit(2)})
    assert [tuple(r) for r in links.cursor_runs(df, ["crawl"]).collect()] == [("c", 2, 2, "end", True)]


def _odd_pages(spark):
    """Pages of crawls of many kinds, and the place of each."""
    rng, rows = random.Random(5), []
    for crawl in [None, *range(40)]:
        n = rng.choice([1, 2, 7, 30, 64, 65])
        names = [None, *(f"{rng.random()} é" for _ in range(n - 1)), None]
        gap = rng.randrange(1, n) if crawl is not None and crawl % 5 == 0 and n > 2 else None
        if crawl is not None and crawl % 7 == 0 and n > 1:
            names[-1] = rng.choice(names[1:-1])
        for k in range(n):
            place = k if gap is None or k < gap else None
            rows += [(crawl, names[k], names[k + 1], place)] * (k != gap)
            rows += [(crawl, names[k], names[k + 1], place)] * (k % 9 == 4 and k != gap)
            rows += [(crawl, names[k], "~", None)] * (k % 9 == 5 and k != gap and names[k + 1] is not None)
        rows += [(crawl, "nobody's", names[-2] if n > 1 else "x", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "crawl long, cursor string, next string, wanted long")
    return df.withColumns({"row": F.monotonically_increasing_id(), "text": F.array("cursor", "next")}).localCheckpoint()


@pytest.mark.parametrize(("kind", "most"), [("string", 0), ("string", 4000), ("string", 16 << 20), ("binary", 16 << 20), ("double", 16 << 20)])
def test_crawls_are_walked_or_joined(spark, monkeypatch, kind, most):
    monkeypatch.setattr(links, "WALK_BYTES", most, raising=False)
    pages = _odd_pages(spark)
    if kind == "double":
        number = lambda c: F.when(F.col(c) == "~", F.lit(float("inf"))).otherwise(F.xxhash64(c).cast("double"))
        pages = pages.withColumns({c: F.when(F.col(c).isNotNull(), number(c)) for c in ("cursor", "next")})
    else:
        # not all of them are UTF-8
        bytes_ = lambda c: F.concat(F.unhex(F.lit("FF")), F.col(c).cast("binary")).cast(kind)
        pages = pages.withColumns({c: bytes_(c) for c in ("cursor", "next")})
    pages = pages.localCheckpoint()
    got = links.cursor_pages(pages, ["crawl"])
    assert got.columns == [*pages.columns, "place"] and dict(got.dtypes)["place"] == "bigint"
    assert got.count() == pages.count() == got.select("row").distinct().count()
    assert got.where("NOT place <=> wanted").count() == 0


def test_small_crawls_are_dealt_out_once_and_kept_nowhere(spark):
    pages = spark.range(6000).selectExpr("id % 300 AS crawl", "id DIV 300 AS k").withColumn("at", F.row_number().over(Window.partitionBy("crawl").orderBy("k")))
    pages = pages.select("crawl", F.when(F.col("k") > 0, F.col("k")).alias("cursor"), F.when(F.col("k") < 19, F.col("k") + 1).alias("next"), "k", "at")
    placed = links.cursor_pages(pages, ["crawl"])
    assert placed.where("place = k AND at = k + 1").count() == 6000
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rounds_leave_nothing(spark, monkeypatch):
    monkeypatch.setattr(links, "WALK_BYTES", 0, raising=False)
    pages = spark.range(900).select(F.lit("c").alias("crawl"), F.when(F.col("id") > 0, F.col("id")).alias("cursor"), F.when(F.col("id") < 899, F.col("id") + 1).alias("next"))
    links.cursor_pages(pages.limit(1), ["crawl"])
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    before = {p.name for p in folder.iterdir()}
    cleanup = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    placed = links.cursor_pages(pages, ["crawl"])
    assert placed.where("place = coalesce(cursor, 0)").count() == 900
    # which crawls are large, and the places
    assert len({p.name for p in folder.iterdir()} - before) <= 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == cleanup


def test_trees_of_any_depth(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("n").alias("name"))
    depths = links.tree_nodes(chain, paths=False)
    assert depths.agg(F.count("*"), F.sum("depth"), F.max("root"), F.count_if(F.col("kind") != "node"), F.count_if(F.col("depth") != F.col("id"))).first()[:] == (n, n * (n - 1) // 2, 0, 0, 0)
    rows = [(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, None, "s"), (5, 4, "c"), (6, 7, "x"), (7, 6, "y"), (8, 7, "z"), (9, 99, "o"), (10, 9, "p"), (11, 11, "me")]
    got = {r["id"]: tuple(r)[1:] for r in links.tree_nodes(spark.createDataFrame(rows, "id int, parent int, name string")).collect()}
    assert got == {
        1: (1, 0, "node", "r"), 2: (1, 1, "node", "r/a"), 3: (1, 2, "node", "r/a/b"), 4: (4, 0, "node", "s"), 5: (4, 1, "node", "s/c"),
        9: (9, 0, "orphan", "o"), 10: (9, 1, "orphan", "o/p"), **{k: (None, None, "cycle", None) for k in (6, 7, 8, 11)},
    }
    assert links.tree_nodes(chain.limit(0)).count() == 0
