"""Parsers, extractors and crawls on cases that are not in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import extraction, levels
from jobloom.operators import crawls, listing, records
from jobloom.plans import snapshots
from jobloom.sources import feeds, html, payloads

PAGE = "page_id long, url string, html string"


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def _pages(spark, *markup):
    return spark.createDataFrame([(k, "https://x.hu/list", m) for k, m in enumerate(markup)], PAGE)


def test_entities_and_attributes(spark):
    got = _one(spark, html.decoded(F.lit("a&#233;&#x2013;&amp;&#0;&#1114112;&#9999999;x&#;")), html.decoded(F.lit(None).cast("string")), html.decoded(F.lit("plain")))
    assert got == ("aé–&���x&#;", None, "plain")
    tag = F.lit("""<x a='1' title="q > r" data-page='{"k":1}'>""")
    assert _one(spark, html.attribute(tag, "x", "data-page"), html.attribute(tag, "x", "none"), html.attribute(tag, "y", "a")) == ('{"k":1}', None, None)
    assert _one(spark, html.padded_text(F.lit("<ul><li>a</li><li><b>b</b>c</li></ul><script>no</script>"))) == ("a bc",)


def test_pages_without_markup_give_no_candidates(spark):
    pages = _pages(spark, None, "", "no tags", "<a>no link</a><a href=''>x</a><a href='http://['>bad address</a>")
    for rows in (html.link_candidates(pages), html.card_candidates(pages), html.search_cards(pages), payloads.headed_sections(pages)):
        assert rows.collect() == []
    assert [tuple(r) for r in html.scoped_texts(pages, ".x").orderBy("page_id").collect()][:3] == [(0, "", ""), (1, "", ""), (2, "", "no tags")]
    assert html.link_candidates(pages.limit(0)).collect() == []


def test_deep_and_unclosed_markup_is_read(spark):
    deep = "<p>" * 5000 + "<a href='/deep'>Deep link</a>"
    assert [r["url"] for r in html.link_candidates(_pages(spark, deep)).collect()] == ["https://x.hu/deep"]


def test_a_word_with_a_tag_inside_stays_one(spark):
    rows = html.run_recipe(_pages(spark, "<div class='c'><a href='/1'><b>Dev</b>Ops</a></div>"), {"card": ".c", "title": "a", "url": "a@href"})
    assert [(r["title"], r["url"]) for r in rows.collect()] == [("DevOps", "https://x.hu/1")]


def test_paused_and_repeated_headings_give_no_posting(spark):
    page = "<h4>A</h4><h5>Jelentkezési határidő: szünetel</h5><h4>B</h4><h4>C</h4><h5>Jelentkezési határidő: ma</h5>c<h4>C</h4><h5>Jelentkezési határidő: ma</h5>d"
    assert [(r["title"], r["section"]) for r in payloads.headed_sections(_pages(spark, page)).collect()] == [("C", "Jelentkezési határidő: ma c")]


def test_locations_of_broken_json(spark):
    assert _one(spark, payloads.json_ld_location(F.lit("<script type='application/ld+json'>{</script>")), payloads.json_ld_location(F.lit(""))) == ("", "")
    assert _one(spark, payloads.labelled_value(F.lit("<h3>Hely</h3>Pécs<p>x"), "hely"), payloads.labelled_value(F.lit("<p>x"), "hely")) == ("Pécs", "")


def test_fragments_of_odd_payloads(spark):
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"rows":[],"total":"x"}'), (4, '{"rows":{"url":"u","row":"r"}}')], "id long, p string")
    assert [tuple(r) for r in payloads.fragment_rows(rows, "p").collect()] == [(4, "u", "r", None)]


def test_details_and_terms(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string")
    details = spark.createDataFrame([(1, None, "x"), (2, "B", "y"), (None, "C", "z")], "id long, v string, w string")
    got = payloads.with_details(rows, details, "id", ["v", "w"]).select("v", "w").collect()
    assert sorted(map(tuple, got), key=repr) == [("B", "y"), ("a", "x"), ("c", None)]
    tagged = spark.createDataFrame([(1, [2, 9, 1]), (2, []), (3, None)], "k long, ids array<long>")
    terms = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    assert [r["t"] for r in payloads.with_terms(tagged, "ids", "k", terms, "t").orderBy("k").collect()] == [["two", "one"], [], []]


def test_crawls(spark):
    columns = "s string, page int, status int, cards int, has_next boolean, stated int"
    pages = [("whole", 1, 200, 9, True, 10), ("whole", 2, 404, None, None, None), ("short", 1, 200, 8, False, 10), ("failed", 1, 200, 5, True, None), ("failed", 2, None, None, None, None)]
    pages += [("open", 1, 200, 3, True, None), ("empty", 1, 200, 0, False, None)]
    got = crawls.crawl_runs(spark.createDataFrame(pages, columns), ["s"])
    assert {r["s"]: (r["n_pages"], r["cards"], r["complete"]) for r in got.collect()} == {
        "whole": (1, 9, True), "short": (1, 8, False), "failed": (1, 5, False), "open": (1, 3, False), "empty": (1, 0, True),
    }
    strict = crawls.crawl_runs(spark.createDataFrame(pages, columns), ["s"], empty_fails=True)
    assert {r["s"] for r in strict.where("complete").collect()} == {"whole"}


def test_reposts(spark):
    posted = spark.createDataFrame([(1, "k", "u1", False, 1), (2, "k", "u2", False, 2), (3, "a", "u3", True, 1), (4, None, "u4", False, 1)], "id int, key string, url string, active boolean, first_seen int")
    batch = spark.createDataFrame([(1, "k", "n1"), (2, "k", "n2"), (3, "a", "n3"), (4, None, "n4"), (5, None, "n5"), (6, "z", "u4")], "seq int, key string, url string")
    assert sorted(r["url"] for r in crawls.without_own_reposts(batch, posted, F.col("key"), ["seq"]).collect()) == ["n1", "n4", "n5", "u4"]
    assert [tuple(r) for r in crawls.repost_moves(batch, posted, F.col("key"), ["seq"]).collect()] == [(2, "n1")]


def test_extractors(spark):
    assert _one(spark, extraction.company_in_prose(F.lit("Megbízónk, a Duna Kft többek közt. x")), extraction.company_in_prose(F.lit("Partnerünk, a Duna ZRT.")), extraction.company_in_prose(F.lit("nobody"))) == (None, "Duna ZRT.", None)
    assert _one(spark, extraction.title_before_mark(F.lit("Dev FRISS NEW")), extraction.title_before_colon(F.lit("Diákmunka :"))) == ("Dev FRISS", "Diákmunka")
    assert _one(spark, extraction.repaired_latin1(F.lit("/Ã¡llÃ¡s")), extraction.repaired_latin1(F.lit("állás")), extraction.repaired_latin1(F.lit("ő Ã¡"))) == ("/állás", "állás", "ő Ã¡")
    assert _one(spark, extraction.requirements_section(F.lit("x What you need to succeed: y")), extraction.requirements_section(F.lit("x"))) == ("What you need to succeed: y", None)
    assert _one(spark, extraction.student_before_junior(F.lit("Junior dev"), F.lit("3 years"))) == ("diákmunka",)
    assert _one(spark, levels.says_junior(F.lit("Entry level")), levels.says_junior(F.lit("pályakezdő")), levels.suits_junior(F.lit("10 év")), levels.suits_medior(F.lit("1-2 év"))) == (True, False, False, False)


def test_order_and_documents(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (1, None)], "s int, n string")
    assert [tuple(r) for r in listing.review_order(rows, ["s", "n"]).collect()] == [(1, "b"), (1, None), (None, "a")]
    assert _one(spark, records.merged_documents(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("1")))) == ({"a": "1"},)


def test_archive_and_backup(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, gone boolean")
    assert snapshots.archive(rows, F.col("gone"), str(tmp_path), "t", str(tmp_path / "old")) == 1
    assert sorted(r["id"] for r in snapshots.current(spark, str(tmp_path), "t").collect()) == [2, 3]
    assert [r["id"] for r in spark.read.json(str(tmp_path / "old")).collect()] == [1]
    root = str(tmp_path / "backups")
    for day in ("2024-01-01", "2024-01-10", "2024-01-15"):
        snapshots.backup(rows, root, "t", day)
    assert sorted(p.name for p in (tmp_path / "backups").iterdir()) == ["t-2024-01-10", "t-2024-01-15"]
    snapshots.export_json(spark.createDataFrame([("", 1)], "a string, b int"), str(tmp_path / "export"))
    assert [tuple(r) for r in spark.read.schema("a string, b int").json(str(tmp_path / "export")).collect()] == [(None, 1)]


def test_feeds(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>l</link></item></channel></rss>")
    assert [(r["title"], r["link"]) for r in feeds.rss_items(spark, str(tmp_path / "feed.xml")).collect()] == [("T", "l")]
    assert _one(spark, feeds.sitemap_urls(F.lit("<loc> a </loc><loc>b</loc><loc>a</loc>"))) == (["a", "b"],)
    (tmp_path / "doc.json").write_text('{\n"a": 1}')
    assert [tuple(r) for r in feeds.documents_by_key(spark, str(tmp_path / "doc.json"), "a int").collect()] == [(1, "doc")]
    names = F.create_map(F.lit("hu"), F.lit("név"))
    assert _one(spark, feeds.localized(names, "de"), F.size(feeds.json_ld_postings(F.lit('<script type="application/ld+json">{"@type":"JobPosting"}</script>')))) == ("név", 1)


def test_companies_in_openings(spark):
    said = {
        "Nemzetközi Partnercégünk, a Duna &amp; Fiai Kft. keres": "Duna & Fiai Kft.", "Partnerünk, a Duna és Tisza Zrt, többek": "Duna és Tisza Zrt.", "Megbízónk, a Kis Duna-Ipari Bt. Pesten, Vácon.": "Kis Duna-Ipari Bt.",
        "Partnerünk, a duna keres": None, "Az Élő Föld keres": "Élő Föld", "A Duna és partner keres": "Duna és", "A Duna és 3 más": "Duna", "A Duna 3": None, "A duna keres": None, "Acme2 is a firm": "Acme2",
        "Acme is one of the": "Acme", "Acme is an": None, "We love (Zeta's team) work": "Zeta", "at Zeta’s history.": "Zeta", "Zeta's people and Beta's mission": "Beta", "": None, None: None, "A": None, "Partnerünk,": None,
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r["t"]: r["c"] for r in rows.select("t", extraction.company_in_prose(F.col("t")).alias("c")).collect()} == said
