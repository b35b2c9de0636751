"""Rules and operators on cases that are not in the tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from jobloom.functions import gates, levels, text, urls
from jobloom.operators import cleaning, listing, records, rollups
from jobloom.sources import feeds


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keywords_in_one_pass_are_those_one_by_one(spark):
    words = ["html", "c++", ".net", "java", "node.js", "node", "c", "machine learning", "machine", "es6", "5g"]
    texts = ["HTML5 and C++11, java", "javascript .NET", "asp.net node.js machine learning", "c4 es6 5g 5ghz html_5", "", "nodejs c", "machine  learning C#", "é java é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for digit, one in ((True, text.has_technology), (False, lambda s, k: text.has_keyword(s, [k]))):
        got = rows.select("t", text.keywords_in(F.col("t"), words, digit).alias("k"), F.array_compact(F.array(*[F.when(one(F.col("t"), k), F.lit(k)) for k in words])).alias("w")).collect()
        assert all(r["k"] == r["w"] for r in got), [tuple(r) for r in got if r["k"] != r["w"]]
    assert _one(spark, text.labels_in(F.lit("Java, ES6 and java"), [("es6", "JS"), ("java", "Java"), ("js", "JS")]), text.labels_in(F.lit("x"), [("a", "A")])) == ("JS, Java", None)


def test_work_modes_go_in_their_order(spark):
    # 'orszagos' goes first and leaves 'an', so the longer word keeps a posting out
    assert _one(spark, levels.in_budapest(F.lit("Országos")), levels.in_budapest(F.lit("Országosan"))) == (True, False)


def test_gates(spark):
    assert _one(spark, gates.budapest_in_text(F.lit("iroda: Bp. 1052")), gates.budapest_in_text(F.lit("1352 db")), gates.budapest_in_text(F.lit(None).cast("string"))) == (True, False, False)
    assert _one(spark, gates.budapest_among(F.lit(None).cast("array<string>")), gates.budapest_among(F.array(F.lit("Pécs"), F.lit("V. Kerület")))) == (False, True)
    assert _one(spark, gates.not_elsewhere(F.lit(None).cast("string")), gates.not_elsewhere(F.lit("at")), gates.latin_script(F.lit("Яa")), gates.is_it_job(F.lit(""), ["x"])) == (True, False, False, False)


def test_parsers(spark):
    assert _one(spark, text.encoded_newlines(F.lit("a\nb")), text.decoded_newlines(F.lit("a\\nb")), text.trim_without_accents(F.lit(" Élő  Ő "))) == ("a\\nb", "a\nb", "Elo  O")
    assert _one(spark, text.token_expiry(F.lit("no token")), text.http_code(F.lit("HTTP")), text.student_job_stem(F.lit("Pultos - diákmunka"))) == (None, None, "Pultos")
    assert _one(spark, text.known_only(F.array(*map(F.lit, "BAAC")), ["A", "B"]), text.query_parameters(F.lit(""))) == (["B", "A"], {})
    assert _one(spark, text.append_unseen(F.array(F.lit("A")), F.array(F.lit("a"), F.lit("b"))), text.strip_control(F.lit("a\x00b\n")), text.short_slug(F.lit("Á b"), 2)) == (["A", "b"], "ab\n", "a-")


def test_budget_windows_begin_with_a_write(spark):
    rows = [(1, 0, 0), (2, 10, 30), (3, 20, 30), (4, 3609, 5), (5, 3610, 60), (6, 3611, 1), (7, 9000, 2)]
    df = spark.createDataFrame([row for row in rows], "event_id int, s long, rows int").select("event_id", F.timestamp_seconds("s").alias("ts"), "rows", F.lit("k").alias("key"))
    got = {r["event_id"]: r["granted"] for r in rollups.budget_granted(df, "key", "ts", "event_id", "rows", 50, 3600).collect()}
    assert got == {1: 0, 2: 30, 3: 20, 4: 0, 5: 50, 6: 0, 7: 2}
    assert rollups.budget_granted(df.limit(0), "key", "ts", "event_id", "rows", 50, 3600).count() == 0


def test_orders(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "á", 7)], "id int, label string, at long")
    assert [r["id"] for r in listing.latest_first(rows.withColumn("at", F.timestamp_seconds("at")), "at", "id").collect()] == [3, 1, 2]
    facets = spark.createDataFrame([("zs", 1), ("ádám", 1), ("b", 1), ("x", 9)], "label string, n int")
    assert [r["label"] for r in listing.facet_order(facets).collect()] == ["x", "ádám", "b", "zs"]
    pinned = listing.pinned_first(rows, F.col("id") == 3, "id")
    assert [r["id"] for r in pinned.collect()] == [3, 1, 2]
    assert [r["id"] for r in listing.pinned_first(rows, F.col("id") == 3, "id", filtered=True).collect()] == [1, 2, 3]
    assert [r["id"] for r in listing.page_or_all(rows, "id", 1, 1, whole=2).collect()] == [2]


def test_feeds(spark, tmp_path):
    (tmp_path / "one.xml").write_text("<rss><channel><item><title>A</title><link>u</link></item></channel></rss>")
    assert [(r["title"], r["link"]) for r in feeds.rss_items(spark, str(tmp_path / "one.xml")).collect()] == [("A", "u")]
    (tmp_path / "k1.json").write_text('{"a":\n 1}')
    assert [tuple(r) for r in feeds.documents_by_key(spark, str(tmp_path / "k1.json"), "a int").collect()] == [(1, "k1")]
    xml = F.lit("<urlset><loc> a </loc><loc>b</loc><loc>a</loc></urlset>")
    page = F.lit('<script type="application/ld+json">{"@type": "JobPosting"}</script><script type="application/ld+json">{"@type": "Other"}</script>')
    name = F.create_map(F.lit("hu"), F.lit("név"), F.lit("en"), F.lit("name"))
    assert _one(spark, feeds.sitemap_urls(xml), feeds.json_ld_postings(page), feeds.localized(name, "de"), feeds.localized(name, "en")) == (["a", "b"], ['{"@type": "JobPosting"}'], "név", "name")


def test_presence_and_expiry(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source string, id int")
    assert [r["_1"] for r in spark.createDataFrame([(x.name,) for x in rows.schema], "_1 string").collect()] == ["source", "id"]
    assert cleaning.with_job_shape(rows.withColumn("url", F.lit("/x")), spark.createDataFrame([("a", "/y")], "source string, pattern string")).select("id").collect()[0][0] == 2
    assert rollups.within_bytes(rows.limit(0), "id", 0).first() == (0, True)


def test_url_rules(spark):
    assert _one(spark, urls.listing_url(F.lit("no url")), urls.network_url(F.lit("https://x.hu")), urls.on_host(F.lit(None).cast("string"), "x")) == ("no url", "https://x.hu/", False)
    assert re.fullmatch(r"job:s:t", _one(spark, urls.job_key(F.lit("s"), F.lit(""), F.lit("t")))[0])


def test_categories_that_nobody_knows(spark):
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "category string")
    kept, unknown = cleaning.by_category(of("a", "a", "b", "c", "c", None), "category", of("a", "a"), of("b"))
    assert [r[0] for r in kept.collect()] == ["a", "a"] and [tuple(r) for r in unknown.collect()] == [("c", 2)]


def test_ranking_of_categories(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("z",), ("y",)], "c string")
    got = rollups.ranked_histogram(rows, F.col("c"), ["none", "b", "a"]).collect()
    assert sorted((r["place"], r["category"], r["n"]) for r in got) == [(1, "b", 2), (2, "a", 2), (3, "y", 1), (4, "z", 1)]
    assert rollups.ranked_histogram(rows.limit(0), F.col("c"), ["a"]).count() == 0


def test_purges_by_list(spark):
    rows = spark.createDataFrame([(1, "p1", "u", 1), (2, "p2", "u", 9), (3, "q", "u", 1), (4, "p", "v", 1), (5, None, "u", 1), (6, "p", "u", None), (7, "p", None, 1)], "id int, source string, url string, first_seen long")
    rows = rows.withColumn("first_seen", F.timestamp_seconds("first_seen"))
    urls = spark.createDataFrame([("u",), ("u",), (None,)], "url string")
    assert sorted(r["id"] for r in records.purge_listed(rows, urls, "p", "1970-01-01 00:00:05").collect()) == [2, 3, 4, 5, 6, 7]
