"""Choices of viewers, trees, pages and streams on awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text, urls
from jobloom.operators import cleaning, views
from jobloom.sources import feeds
from jobloom.streaming import limits


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pasted_urls(spark):
    of = lambda s: _one(spark, urls.pasted_url(F.lit(s)))
    assert of(None) == "" and of("   ") == ""
    assert of("not a url") == "not a url" or of("not a url").startswith("https://not")
    assert of("x.hu?Utm_Source=1&EBP=2&b=3#part") == "https://x.hu/?b=3#part"
    assert of("https://de.linkedin.com/jobs/view/12/?x=1") == "https://www.linkedin.com/jobs/view/12/"
    assert of("https://notlinkedin.com/jobs/view/12") == "https://notlinkedin.com/jobs/view/12"


def test_cookies_and_keys(spark):
    of = lambda s, n="id": _one(spark, text.cookie(F.lit(s), n))
    assert of(None) == "" and of("") == "" and of("id") == "" and of("idx=1") == ""
    assert of("a=1; id=x%20y=z; id=2") == "x y=z" and of("id=") == ""
    assert _one(spark, text.limit_key(F.lit("unknown"), F.lit(None).cast("string"))) is None
    assert _one(spark, text.limit_key(F.lit(None).cast("string"), F.lit("v"))) == "visitor:v"
    assert _one(spark, text.localized_slug(F.lit('{"broken'), "hu")) in ("", None)


def test_labels_and_sources_of_empty_and_null_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, [], ""), (3, ["A"], "AI - x")], "id int, labels array<string>, source string")
    ids = lambda c: {r["id"] for r in rows.where(c).collect()}
    labels, source = F.col("labels"), F.col("source")
    assert ids(views.of_labels_chosen(labels, [], [], "none")) == {1, 2, 3}
    assert ids(views.of_labels_chosen(labels, ["none"], ["A"], "none")) == {1, 2}
    assert ids(views.of_labels_chosen(labels, [], ["A"])) == {1, 2}
    assert ids(views.of_sources_chosen(source, ["AI-scraped"], [], {"AI-scraped": "AI - "})) == {3}
    assert ids(views.of_sources_chosen(source, [], ["AI-scraped"], {"AI-scraped": "AI - "})) == {1, 2}
    assert views.awake([], rows) == []


def test_programme_of_a_subject(spark):
    rows = [
        (1, "A", "N/A", "MB"), (2, " A ", "u", "mi"), (3, "A", "v", None),  # somebody says MI twice
        (4, "B", "u", "MI"), (5, "B", "v", "MB"),  # both
        (6, "C", None, "MB"),  # nobody
        (7, "D", "u", "XX"),  # one alone, unknown
        (8, "E", "u", "XX"), (9, "E", "v", "XX"),  # two, unknown
    ]
    df = spark.createDataFrame(rows, "seq int, name string, user string, programme string")
    out = {r["name"]: (r["programme"], r["n"]) for r in views.programmes_by_subject(df, "name", "user", "programme", "seq").collect()}
    assert out == {"A": ("MI", 2), "B": ("MIMB", 2), "C": ("MB", 0), "D": ("XX", 1), "E": ("MB", 2)}


def test_trees(spark):
    chain = [(0, None, "r")] + [(k, k - 1, f"n{k}") for k in range(1, 12)] + [(50, 51, "loop"), (51, 50, "loop"), (60, 99, "orphan")]
    nodes = spark.createDataFrame(chain, "id int, parent int, name string")
    paths = {r["id"]: r["path"] for r in feeds.tree_paths(spark, nodes).collect()}
    assert set(paths) == set(range(12)) and paths[3] == "r/n1/n2/n3"
    assert feeds.tree_paths(spark, nodes.limit(0)).count() == 0


def test_a_tree_deeper_than_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(feeds, "MOST_LEVELS", 3)
    nodes = spark.createDataFrame([(0, None, "r"), (1, 0, "a"), (2, 1, "b"), (3, 2, "c")], "id int, parent int, name string")
    with pytest.raises(ValueError, match="levels"):
        feeds.tree_paths(spark, nodes)


def test_rows_that_stand_in_their_page(spark):
    pages = spark.createDataFrame([(1, "<a href='/job/1'>"), (2, "https://x.hu/job/2"), (3, None)], "page int, html string")
    rows = [(1, "https://x.hu/job/1"), (2, "https://x.hu/job/2"), (1, "https://x.hu/job/9"), (3, "https://x.hu/job/3"), (4, "https://x.hu/")]
    out = cleaning.present_in(spark.createDataFrame(rows, "page int, url string"), pages, "page")
    assert sorted((r["page"], r["url"]) for r in out.collect()) == [(1, "https://x.hu/job/1"), (2, "https://x.hu/job/2")]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 10:05:00", "a"), (1, "2024-01-01 10:05:00", "a"), (2, "2024-01-01 10:59:59", "a"), (3, "2024-01-01 11:00:00", "a"), (4, "2024-01-01 10:00:00", "b")]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = limits.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in spark.table("windowed").collect()}
    assert got == {("2024-01-01 10:00:00", "a"): 2, ("2024-01-01 11:00:00", "a"): 1, ("2024-01-01 10:00:00", "b"): 1}
