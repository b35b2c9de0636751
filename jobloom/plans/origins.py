"""Queries of what differs by source, and of marks on single postings, each with the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions import text, urls
from jobloom.operators import marks, records, rollups, state, views
from jobloom.plans.markup import _HOST, _NAMED, _NAMES, _pages
from jobloom.plans.queries import _POSTINGS, _query, postings
from jobloom.sources import experience, html, payloads
from jobloom.sources.tables import table

#: By source, an address with a slug (@), a number that changes (#) and one that stays (~), and its key.
_FORMS = [
    ("profession", "https://www.profession.hu/allas/@-1000#", "https://www.profession.hu/allas/@"),
    ("profession", "https://www.profession.hu/allas/@-12", None),
    ("kh", "https://kh.hu/allas/@-#", "https://kh.hu/allas/@"),
    ("muisz", "https://muisz.hu/hu/diakmunkaink/@--#", "https://muisz.hu/hu/diakmunkaink/@"),
    ("zyntern", "https://zyntern.com/job/#-@", "https://zyntern.com/job/|@"),
    ("schonherz", "https://schonherz.hu/diakmunka/pecs/it/#-@", "https://schonherz.hu/diakmunka/pecs/it/|@"),
    ("mbh", "https://mbh.hu/JobAdvertisement/#/@/it", "https://mbh.hu/JobAdvertisement/|/@/it"),
    ("mfb", "https://mfb.hu/JobAdvertisement/@", None),
    ("smartrecruiters", "https://jobs.smartrecruiters.com/Acme~/#-@", "https://jobs.smartrecruiters.com/Acme~/|@"),
    ("dreamjobs", "https://dreamjobs.hu/en/job/acme/@-#", "acme|@"),
    ("otp", "https://karrier.otpbank.hu/leanyvallalatok/job/@/~/", "~"),
    ("other", "https://other.hu/@-#", None),
]
_SQL_FORMS = ", ".join(f"({k}, '{s}', '{u}', {f"'{key}'" if key else 'NULL'})" for k, (s, u, key) in enumerate(_FORMS))


def _filled(text, slug, changing, staying):
    out = text
    for mark, value in (("@", slug), ("#", changing), ("~", staying)):
        out = F.replace(out, F.lit(mark), value)
    return out


@_query(f"""SELECT p_partkey, source, url, replace(replace(key, '@', slug), '~', CAST(p_size AS VARCHAR)) AS key, CASE WHEN source = 'kh' THEN CAST(p_partkey AS VARCHAR) END AS number FROM
 (SELECT p_partkey, p_size, source, key, slug, replace(replace(replace(form, '@', slug), '#', CAST(p_partkey AS VARCHAR)), '~', CAST(p_size AS VARCHAR)) AS url FROM
 (SELECT *, replace(p_name, ' ', '-') AS slug FROM part) JOIN (VALUES {_SQL_FORMS}) v(k, source, form, key) ON p_partkey % {len(_FORMS)} = k)""")
def volatile_keys(spark, d):
    forms = F.get(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(u).alias("form")) for s, u, _ in _FORMS]), (F.col("p_partkey") % len(_FORMS)).cast("int"))
    rows = table(spark, d, "part").withColumn("form", forms)
    url = _filled(F.col("form.form"), F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    rows = rows.select("p_partkey", "form.source", url.alias("url"))
    key = F.replace(urls.volatile_key(F.col("source"), F.col("url")), F.lit("\n"), F.lit("|"))
    return rows.withColumns({"key": key, "number": urls.number_key(F.col("source"), F.col("url"))})


@_query(f"""WITH {_POSTINGS} SELECT id, CASE WHEN id % 4 = 0 THEN 'https://erste.hu/allas/job' || id || '-' || (id + 9000000) WHEN id % 4 = 1 THEN 'https://erste.hu/allas/new' || id || '-' || id
 WHEN id % 4 = 2 THEN 'https://erste.hu/allas/job' || id || '-' || id ELSE 'https://erste.hu/job/' || id END AS url, active OR id % 4 IN (0, 1) AS active FROM postings""")
def volatile_moves(spark, d):
    """Renumbered, retitled under their number, listed as they were, and with addresses of no form."""
    rows = postings(spark, d).withColumn("source", F.lit("erste"))
    at = lambda name, number: F.concat(F.lit(f"https://erste.hu/allas/{name}"), "id", F.lit("-"), number)
    old = rows.withColumn("url", F.when(F.col("id") % 4 != 3, at("job", F.col("id"))).otherwise(F.concat(F.lit("https://erste.hu/job/"), "id")))
    new = F.when(F.col("id") % 4 == 0, at("job", F.col("id") + 9000000)).when(F.col("id") % 4 == 1, at("new", F.col("id"))).otherwise(at("job", F.col("id")))
    batch = rows.where("id % 4 <> 3").select("source", new.alias("url"))
    keys = [of(F.col("source"), F.col("url")) for of in (urls.volatile_key, urls.number_key)]
    return state.migrate_urls(old, batch, *keys).select("id", "url", "active")


_SOURCES = ["linkedin", "profession", "bluebird", "talent", "kuka", "aam", "linkedin", "talent"]


@_query(f"""SELECT page_id, CASE k WHEN 6 THEN NULL WHEN 7 THEN (p_size % 9 + 4) || ' years' WHEN 5 THEN (p_size % 9 + 1) || ' years, ' || (p_size % 9 + 3) || ' years' ELSE (p_size % 9 + 1) || ' years' END AS experience
 FROM (SELECT page_id, page_id % {len(_SOURCES)} AS k, p_size FROM {_NAMED})""")
def experience_by_source(spark, d):
    own = "<p>@ developer</p><ul><li>skills</li><li>~ years of work</li></ul>"
    other = "<aside>other jobs: <b>% years</b></aside>"
    markup = [
        f"<div class='description'>{own}</div>{other}", f"<div id='box_az-allashoz-tartozo-elvarasok'>{own}</div>{other}",
        f"<section class='tcb-post-content'>$</section><section class='tcb-post-content'>{own}</section>{other}", f"<div class='x_jobDescriptionColumn__1'>{own}</div>{other}",
        f"{other}<h2>What you need to succeed</h2>{own}", f"{own}{other}", f"<div class='description'>$</div>{other}",
        """<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"d":"@"}}}</script><script type="application/ld+json">{broken 1 years}</script>"""
        f"""<script type="application/ld+json">{{"description":"! years"}}</script>{other}""",
    ]
    which = (F.col("page_id") % len(_SOURCES)).cast("int")
    pages = _pages(spark, d, "@\n$").withColumn("named", F.split("html", "\n"))
    size = table(spark, d, "part").select(F.col("p_name"), F.col("p_partkey"), (F.col("p_size") % 9).cast("int").alias("n"))
    pages = pages.join(size, F.col("p_partkey") == F.col("page_id") % _NAMES)
    text = F.get(F.array(*[F.lit(x) for x in markup]), which)
    for mark, value in (("~", F.col("n") + 1), ("%", F.col("n") + 3), ("!", F.col("n") + 4), ("@", F.get("named", F.lit(0))), ("$", F.get("named", F.lit(1)))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return experience.experience_in_pages(pages.select("page_id", F.get(F.array(*[F.lit(x) for x in _SOURCES]), which).alias("source"), text.alias("html")))


@_query(f"""SELECT page_id, p_name AS title, {_HOST} || '/allas/it/job/' || page_id AS url FROM {_NAMED}
 UNION ALL SELECT page_id, NULL, {_HOST} || '/JobAdvertisement/' || page_id || '/dev' FROM {_NAMED}""")
def fragment_envelopes(spark, d):
    view = _pages(spark, d, """{"view":"<article class='card'><div class='card-body'><a href='/allas/it/job/#'><h3 class='card-title'>@</h3></a></div></article><article class='card'><h3 class='card-title'>$</h3></article>"}""")
    cards = html.run_recipe(payloads.in_envelope(view, "html", "view"), {"card": "article.card", "title": ".card-title", "url": ".card-body a[href*='/allas/']@href"})
    listed = _pages(spark, d, """<div data-position-url="/JobAdvertisement/#/dev?utm_source=x"></div><div data-position-url='JobAdvertisement/#/dev'></div><div data-position-url="/JobAdvertisement/@"></div>""")
    links = payloads.attribute_links(listed.withColumn("url", F.regexp_extract("url", "^(https?://[^/]+)", 1)), "data-position-url", r"(?i)/JobAdvertisement/\d+/")
    return cards.select("page_id", "title", "url").unionByName(links.select("page_id", F.lit(None).cast("string").alias("title"), "url"))


@_query("""SELECT event_type, url, complete FROM (SELECT event_type, bool_and(value < 400) AS complete FROM events GROUP BY 1) LEFT JOIN
 (SELECT DISTINCT event_type, 'https://x.hu/' || user_id AS url FROM events WHERE value < 400) USING (event_type)""")
def found_urls(spark, d):
    url = F.when(F.col("value") < 400, F.concat(F.lit("https://x.hu/"), "user_id"))
    pages = table(spark, d, "events").select("event_type", url.alias("url"), (F.col("value") < 400).alias("ok"))
    return rollups.found_by_source(pages, "event_type", "url", "ok")


@_query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 5 <> 0, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 9999 END,
 p_name, p_partkey % 3 = 0, p_partkey) AS INTEGER) AS place FROM part""")
def collated_files(spark, d):
    cased = F.when(F.col("p_partkey") % 3 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    name = F.when(F.col("p_size") % 2 == 0, F.concat_ws("_", "p_size", cased)).otherwise(cased)
    order = views.file_order(F.col("p_size") % 5 == 0, name)
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order, "p_partkey")).alias("place"))


@_query("""SELECT c_custkey FROM customer WHERE c_custkey % 9 > 6 UNION ALL SELECT page_id FROM pages""")
def junk_paths(spark, d):
    """Addresses of customers on paths of which seven lead to no posting, and those of the pages."""
    prefix = F.get(F.array(*[F.lit(x) for x in (*urls.JUNK_PATHS, "/allas/tag", "/Tag")]), (F.col("c_custkey") % 9).cast("int"))
    made = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("https://www.x.hu"), prefix, F.lit("s/"), "c_custkey").alias("url"))
    rows = made.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("c_custkey"), "url"))
    return rows.where(~urls.is_junk(F.col("url"))).select("c_custkey")


@_query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' 2026.07.' || (10 + p_size % 20) || '.' || CASE WHEN p_size % 3 = 2 THEN ' ' ELSE '' END END AS detail,
 p_name AS aggregate FROM part""")
def click_targets(spark, d):
    gap = F.when(F.col("p_size") % 3 == 0, " ").otherwise("")
    end = F.when(F.col("p_size") % 3 == 2, " ").otherwise("")
    clicked = F.concat("p_name", F.lit(" 2026."), gap, F.lit("07."), gap, (F.lit(10) + F.col("p_size") % 20).cast("string"), F.lit("."), end)
    return table(spark, d, "part").select("p_partkey", text.strip_written_date(clicked).alias("detail"), text.strip_date_suffix(clicked).alias("aggregate"))


@_query("""SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT trim(c_mktsegment) FROM customer UNION ALL SELECT o_orderpriority FROM orders)""")
def rejected_names(spark, d):
    segment = F.when(F.col("c_custkey") % 7 == 0, "  ").when(F.col("c_custkey") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("\n")))
    more = table(spark, d, "customer").select(segment.alias("name")).unionByName(table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")))
    return records.add_rejected(table(spark, d, "part").select(F.col("p_name").alias("name")), more, "name")


_MIRRORED = f"""{_POSTINGS}, mirrored AS (SELECT id, source, url, active, hidden, id AS base FROM postings
 UNION ALL SELECT -id, 'mirror', url, active, hidden, id FROM postings WHERE id % 5 = 0)"""


def _mirrored(spark, d):
    """Postings, each fifth of which another source has as well."""
    rows = postings(spark, d)
    return rows, rows.unionByName(rows.where("id % 5 = 0").withColumns({"id": -F.col("id"), "source": F.lit("mirror")}))


@_query(f"""WITH {_MIRRORED} SELECT id, CASE WHEN id < 0 THEN false WHEN id % 4 = 0 THEN false WHEN id % 3 = 0 THEN true ELSE hidden END AS hidden FROM mirrored""")
def hidden_toggles(spark, d):
    rows, both = _mirrored(spark, d)
    mark = lambda which, source, hidden, at: rows.where(which).select("url", source.alias("source"), F.lit(hidden).alias("hidden"), F.lit(at).alias("at"))
    said = mark("id % 3 = 0", F.lit(" "), True, 1).unionByName(mark("id % 5 = 0", F.lit("mirror"), False, 2)).unionByName(mark("id % 4 = 0", F.col("source"), False, 3))
    return marks.set_hidden(both, said).select("id", "hidden")


def _fixes(spark, d):
    rows, both = _mirrored(spark, d)
    fix = lambda which, source, active: rows.where(which).select("url", F.lit(source).cast("string").alias("source"), F.lit(1).alias("at"), F.lit(active).alias("active"))
    said = fix("id % 2 = 0", None, False).unionByName(fix("id % 6 = 1", "nobody", True)).unionByName(fix("id % 10 = 5", "mirror", True))
    return marks.fix_fields(both, said, ["active"])


@_query(f"""WITH {_MIRRORED} SELECT id, CASE WHEN id > 0 AND id % 2 = 0 AND id % 5 <> 0 THEN false WHEN id < 0 AND base % 10 = 5 THEN true ELSE active END AS active FROM mirrored""")
def field_fixes(spark, d):
    return _fixes(spark, d)[0].select("id", "active")


@_query(f"""WITH {_POSTINGS} SELECT url, NULL AS source, CASE WHEN id % 5 = 0 THEN 'ambiguous' ELSE 'updated' END AS outcome FROM postings WHERE id % 2 = 0
 UNION ALL SELECT url, 'nobody', 'not found' FROM postings WHERE id % 6 = 1 UNION ALL SELECT url, 'mirror', 'updated' FROM postings WHERE id % 10 = 5""")
def fix_outcomes(spark, d):
    return _fixes(spark, d)[1]


@_query(f"""WITH {_POSTINGS} SELECT id, url, active AND source <> '1-URGENT' AS active, sweep_dead OR (active AND source = '1-URGENT') AS sweep_dead, active AND source = '1-URGENT' AS deactivated FROM postings""")
def deactivations(spark, d):
    rows = postings(spark, d)
    table_, asked = marks.deactivate(rows, rows.select("url"), "1-URGENT")
    return table_.join(asked, "url").select("id", "url", "active", "sweep_dead", "deactivated")
