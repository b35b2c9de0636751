"""What differs by source: experience, keys, moves, envelopes, buckets and the order of files, on awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text, urls
from jobloom.operators import marks, records, rollups, state, views
from jobloom.sources import experience, payloads


def _experience(spark, *pages):
    df = spark.createDataFrame([(k, s, h, "x") for k, (s, h) in enumerate(pages)], "page_id int, source string, html string, experience string")
    return [r["experience"] for r in experience.experience_in_pages(df).orderBy("page_id").collect()]


def test_experience_by_source(spark):
    box = '<div id="box_az-allashoz-tartozo-elvarasok"><ul><li>végzettség</li><li>3-5 év</li></ul></div>'
    talent = '<div class="jobDescriptionColumn_a">no years</div><script id="__NEXT_DATA__">{}</script>'.format
    assert _experience(
        spark,
        ("linkedin", "<div class='description'>2 years</div><div class='description'>4 years</div>"), ("linkedin", "<p>5 years</p>"), ("profession", box), ("profession", "<p>5 years</p>"),
        ("bluebird", "<section class='tcb-post-content'>a</section><section class='tcb-post-content'>2 years</section>7 years"),
        ("talent", talent('{"props":{"pageProps":{"d":"\\u00fcgyes, 4 \\u00e9v"}},"x":"9 years"}')), ("talent", talent('{"x":"9 years"}') + "8 years"), ("talent", talent("9 years") + "8 years"),
        ("kuka", "8 years<h2>What you need to succeed</h2>2 years"), ("kuka", "8 years"), ("kuka", "8 years<h2>What you need to succeed</h2>"),
        ("other", "<li>végzettség</li><li>3 év</li>"), (None, "1 year"), ("linkedin", None), ("other", None), ("talent", ""), ("linkedin", "<div class='description'>2 <b>years"),
    ) == ["2 years", None, "3-5 év", "5 years", "2 years", "4 év", "9 years", "8 years", "2 years", "8 years", None, "3 év", "1 year", None, None, None, "2 years"]
    assert experience.experience_in_pages(spark.createDataFrame([], "page_id long, source string, html string")).collect() == []


@pytest.mark.parametrize(
    ("source", "one", "other", "same"),
    [
        ("profession", "https://x.hu/allas/net-2875224", "https://x.hu/allas/net-2899456", True),
        ("profession", "https://x.hu/allas/net-2875224", "https://x.hu/allas/nett-2875224", False),
        ("profession", "https://x.hu/allas/net-28", "https://x.hu/allas/net-29", False),
        ("muisz", "https://x.hu/a--1", "https://x.hu/a--22", True),
        ("zyntern", "https://zyntern.com/job/1-a-2", "https://zyntern.com/job/77-a-2", True),
        ("zyntern", "https://zyntern.com/job/1-a-2", "https://zyntern.com/job/1-a-3", False),
        ("schonherz", "https://x.hu/pecs/1-a", "https://x.hu/eger/1-a", False),
        ("dreamjobs", "https://dreamjobs.hu/en/job/a/b-1", "https://dreamjobs.hu/hu/job/a/b-2", True),
        ("dreamjobs", "https://dreamjobs.hu/en/job/a/b-1", "https://dreamjobs.hu/en/job/ab/b-1", False),
        ("otp", "https://karrier.otpbank.hu/otp/job/old/12/", "https://karrier.otpbank.hu/job/new/12", True),
        ("mfb", "https://x.hu/JobAdvertisement/339/dev/allasok", "https://x.hu/JobAdvertisement/345/dev/allasok", True),
        ("kh", None, None, False),
        (None, "https://x.hu/a-1", "https://x.hu/a-1", False),
    ],
)
def test_volatile_keys(spark, source, one, other, same):
    key = lambda url: urls.volatile_key(F.lit(source), F.lit(url).cast("string"))
    assert spark.range(1).select(F.coalesce(key(one) == key(other), F.lit(False))).first()[0] is same


def test_moves_by_one_key_and_then_by_the_next(spark):
    rows = [("kh", "a-1", False, 1), ("kh", "b-2", True, 1), ("kh", "c-3", True, 1), ("kh", "plain", True, 1), ("kh", "other", True, 1), ("aam", "a-1", True, 1), ("kh", "a-0", True, 1)]
    table = spark.createDataFrame([(*r, False, k) for k, r in enumerate(rows)], "source string, url string, active boolean, first_seen int, sweep_dead boolean, id int")
    batch = spark.createDataFrame([("kh", u) for u in ("a-9", "bb-2", "c-3", "cc-3", "new-1", "a-9")], "source string, url string")
    keys = [of(F.col("source"), F.col("url")) for of in (urls.volatile_key, urls.number_key)]
    moved = {r["id"]: r["url"] for r in state.migrate_urls(table, batch, *keys).collect()}
    # of a-1 and a-0 the active one takes a-9; the number of a-1 is that of new-1; c-3 is still listed
    assert moved == {0: "new-1", 1: "bb-2", 2: "c-3", 3: "plain", 4: "other", 5: "a-1", 6: "a-9"}
    assert {r["url"] for r in state.migrate_urls(table, batch, keys[0]).collect()} == {"a-1", "b-2", "c-3", "plain", "other", "a-9"}
    assert state.migrate_urls(table.limit(0), batch, *keys).count() == 0


def test_buckets_of_found_urls(spark):
    rows = [("a", "x", True), ("a", "x", True), ("a", "y", None), ("b", None, False), (None, "z", True)]
    df = spark.createDataFrame(rows, "source string, url string, ok boolean")
    got = rollups.found_by_source(df, "source", "url", "ok").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", "x", False), ("a", "y", False), ("b", None, False), (None, "z", True)], key=repr)
    assert rollups.found_by_source(df.limit(0), "source", "url", "ok").columns == ["source", "url", "complete"]


def test_files_in_the_order_that_people_read(spark):
    names = ["10_b", "2_z", "éva", "Eva", "eva", "zoli", "Zita", "ádám", "2_a", " 1_x"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in df.orderBy(*views.file_order(F.col("name") == "zoli", F.col("name"))).collect()]
    assert got == ["zoli", "2_a", "2_z", "10_b", " 1_x", "ádám", "eva", "Eva", "éva", "Zita"]


def test_links_in_attributes(spark):
    html = """<i data-u='/job/1/a&amp;b'></i><i  DATA-U = "x/job/2"><i data-u="/none"><i data-u=''><i data-url="/job/3"></i>"""
    df = spark.createDataFrame([(1, "https://x.hu/p/q", html), (2, None, html), (3, "https://x.hu", None)], "page_id int, url string, html string")
    got = payloads.attribute_links(df, "data-u", r"/job/\d").collect()
    assert sorted(map(tuple, got)) == [(1, "https://x.hu/job/1/a&b"), (1, "https://x.hu/p/x/job/2")]
    held = spark.createDataFrame([(1, "u", '{"view":"<p>"}'), (2, "u", "broken"), (3, "u", None)], "page_id int, url string, body string")
    assert [r["html"] for r in payloads.in_envelope(held, "body", "view").orderBy("page_id").collect()] == ["<p>", None, None]


def test_dates_junk_and_rejected_names(spark):
    said = ["X 2026. 07. 09.", "X 2026.07.09.", "X 2026. 07. 09. ", " X", None, "X 2026. 07. 09.\n", "2026. 07. 09."]
    df = spark.createDataFrame([(x,) for x in said], "s string")
    got = [tuple(r) for r in df.select(text.strip_written_date(F.col("s")), text.strip_date_suffix(F.col("s"))).collect()]
    assert got == [("X", "X"), ("X 2026.07.09.", "X"), ("X 2026. 07. 09. ", "X"), (" X", "X"), (None, None), ("X 2026. 07. 09.\n", "X"), ("2026. 07. 09.", "2026. 07. 09.")]
    at = ["https://x.hu/fiokom?a", "https://x.hu/tagok/1", "https://x.hu/a/tag", "https://x.hu", "/tag", None, "https://x.hu/Tag"]
    df = spark.createDataFrame([(x,) for x in at], "url string")
    assert [r[0] for r in df.select(urls.is_junk(F.col("url"))).collect()] == [True, True, False, False, True, True, False]
    known, more = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["a", " b"], [" a ", "b", "", None, "\tc\n", "c"]))
    assert sorted(r["name"] for r in records.add_rejected(known, more, "name").collect()) == [" b", "a", "b", "c"]
    assert records.add_rejected(known.limit(0), more.limit(0), "name").count() == 0


_POSTED = "id int, source string, url string, hidden boolean, active boolean, sweep_dead boolean, title string"


def _posted(spark):
    rows = [(1, "a", "u", False, True, False, "x"), (2, "b", "u", False, True, False, "x"), (3, "a", "v", True, True, False, "x"), (4, None, "w", None, False, False, "x"), (5, "a", None, False, True, False, "x")]
    return spark.createDataFrame(rows, _POSTED)


def test_hidden_by_url_or_source(spark):
    said = [(" u ", None, True, 1), ("u", "b", False, 2), ("u", "b", True, 1), ("v", "", False, 1), ("v", "", True, 1), ("w", "a", True, 1), ("w", " ", None, 3), (None, None, True, 1), ("u" * 3000, None, True, 1), ("u", "a", False, None)]
    table = _posted(spark)
    got = marks.set_hidden(table, spark.createDataFrame(said, "url string, source string, hidden boolean, at int"))
    assert got.columns == table.columns and {r["id"]: r["hidden"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: None, 5: False}


def test_fixes_are_judged(spark):
    said = [("u", None, 1, "p", None), ("u", "b", 2, "q", None), ("u", "b", 3, None, False), ("v", None, 1, "r", False), ("v", "a", 2, "s", None), ("w", "", 1, "t", True), ("none", None, 1, "x", True), ("v", "zz", 1, "x", True), (None, "a", 1, "x", False)]
    table, judged = marks.fix_fields(_posted(spark), spark.createDataFrame(said, "url string, source string, at int, title string, active boolean"), ["title", "active"])
    assert {r["id"]: (r["title"], r["active"]) for r in table.collect()} == {1: ("x", True), 2: ("q", False), 3: ("s", False), 4: ("t", True), 5: ("x", True)}
    outcomes = {("u", None): "ambiguous", ("u", "b"): "updated", ("v", None): "updated", ("v", "a"): "updated", ("w", None): "updated", ("none", None): "not found", ("v", "zz"): "not found"}
    assert {(r["url"], r["source"]): r["outcome"] for r in judged.collect()} == outcomes and judged.count() == len(outcomes)


def test_postings_that_are_over(spark):
    named = spark.createDataFrame([("u",), ("u",), ("w",), ("none",), (None,)], "url string")
    table, asked = marks.deactivate(_posted(spark), named, "a")
    assert {r["id"]: (r["active"], r["sweep_dead"]) for r in table.collect()} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    assert sorted(map(tuple, asked.collect())) == [("none", False), ("u", True), ("w", False)]
