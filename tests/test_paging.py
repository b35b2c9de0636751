"""Landed pages, and crawls by each rule: where they end, gaps, errors, repeated pages and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import paging
from jobloom.sources import landed

PAGE = "crawl string, place long, status int, items int, total long"


def _runs(spark, rows, **how):
    df = spark.createDataFrame([(*r, None)[:5] for r in rows], PAGE)
    return {r["crawl"]: tuple(r)[1:] for r in paging.paged_runs(df, ["crawl"], F.col("place"), how.pop("ends", F.lit(False)), **how).collect()}


def test_ends_of_crawls(spark):
    whole = [(k, 200, 10) for k in range(4)]
    rows = [("end", *p) for p in whole] + [("end", 4, 200, 3), ("end", 5, 200, 9)]
    rows += [("empty", *p) for p in whole] + [("empty", 4, 200, 0), ("empty", 5, 200, 10)]
    rows += [("gone", *p) for p in whole] + [("gone", 4, 404, None)] + [("error", *p) for p in whole[:2]] + [("error", 2, 503, None), ("error", 3, 200, 4)]
    rows += [("gap", *p) for p in whole if p[0] != 2] + [("late", 1, 200, 10), ("null status", 0, None, 10), (None, 0, 200, 2)]
    rows += [("twice", 0, 200, 10), ("twice", 0, 200, 10), ("twice", 1, 200, 4), ("twice", 1, 404, None), ("no items", 0, 200, None)]
    got = _runs(spark, rows, ends=paging.by_size(F.col("items"), F.lit(10)))
    assert got == {
        "end": (5, 43, "end", True), "empty": (4, 40, "empty", True), "gone": (4, 40, "gone", True), "error": (2, 20, "error", False), "gap": (2, 20, "gap", False),
        "late": (0, 0, "gap", False), "null status": (0, 0, "error", False), None: (1, 2, "end", True), "twice": (2, 14, "end", True), "no items": (0, 0, "empty", True),
    }
    assert _runs(spark, rows[:6], most=3) == {"end": (3, 30, "gap", False)}
    assert _runs(spark, rows[:6], stops=F.col("place") == 2) == {"end": (2, 20, "stop", True)}
    assert _runs(spark, []) == {}


def test_counts_and_probes(spark):
    df = spark.createDataFrame([("a", 0, 200, 10), ("a", 10, 200, 10), ("a", 20, 200, 1), ("b", 0, 200, 10), ("b", 10, 200, 10)], "crawl string, place long, status int, items int")
    probes = spark.createDataFrame([("a", 20), ("a", 15), ("c", 3)], "crawl string, total long")
    pages = paging.with_probes(df, probes, ["crawl"])
    runs = paging.paged_runs(pages, ["crawl"], F.col("place") / 10, paging.by_count(F.col("place"), F.lit(10), F.col("total")), total="total")
    assert {r["crawl"]: tuple(r)[1:] for r in runs.collect()} == {"a": (2, 20, "end", True), "b": (2, 20, "gap", False)}
    few = paging.with_probes(df, probes.withColumn("total", F.lit(25)), ["crawl"])
    runs = paging.paged_runs(few, ["crawl"], F.col("place") / 10, paging.by_count(F.col("place"), F.lit(10), F.col("total")), total="total")
    assert {r["crawl"]: tuple(r)[1:] for r in runs.collect()}["a"] == (3, 21, "end", False)


def test_landed_pages(spark, tmp_path):
    made = [("s/1", 0, 200, "<p>\n\n</p>\n"), ("s/1", 1, 404, None), ("x", 0, 200, "é\r\n"), ("x", 10, 200, "")]
    landed.land(spark.createDataFrame(made, "source string, place long, status int, body string"), str(tmp_path / "l"))
    got = landed.landed(spark, str(tmp_path / "l"))
    assert sorted(map(tuple, got.collect())) == [("s/1", 0, 200, "<p>\n\n</p>\n"), ("s/1", 1, 404, ""), ("x", 0, 200, "é\r\n"), ("x", 10, 200, "")]
    plan = got.where("source = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and got.where("source = 'x'").count() == 2


def test_files_go_by_sources_not_by_pages(spark, tmp_path):
    made = spark.range(600, numPartitions=3).selectExpr("concat('s', id % 2) AS source", "id AS place", "IF(id % 50 = 0, 404, 200) AS status", "concat('page ', id, '\\n') AS body")
    for _ in range(2):
        landed.land(made, str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").rglob("*") if p.is_dir()) == ["source=s0", "source=s1"]
    assert len(list((tmp_path / "l").rglob("part-*"))) <= 2 * 3 * 2
    got = landed.landed(spark, str(tmp_path / "l"))
    assert sorted(map(tuple, got.collect())) == sorted([*map(tuple, made.select(got.columns).collect())] * 2)
    landed.land(made.limit(0), str(tmp_path / "none"))
    assert landed.landed(spark, str(tmp_path / "none")).count() == 0
