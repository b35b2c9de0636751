"""Queries of parsers, extractors and crawls, each with the SQL that must give its rows.

The pages' own markup holds no postings, so most queries put one of a known form around each page's id and address.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import extraction
from jobloom.operators import crawls, listing, records, views
from jobloom.plans.markup import _HOST, _NAMED, _pages
from jobloom.plans.queries import _query
from jobloom.sources import html, payloads
from jobloom.sources.tables import table

DICTIONARY = [("java", "Java"), ("spark", "Spark"), ("sql", "SQL")]


@_query(f"""SELECT page_id, p_name || ' Developer ' || page_id AS title, {_HOST} || '/job/' || page_id AS url, 'About ' || p_name AS description, c_name AS company, c_name || ' utca' AS location FROM {_NAMED}
 UNION ALL SELECT page_id, 'Short text', {_HOST} || '/other', NULL, 'jó cég', NULL FROM {_NAMED}""")
def link_rules(spark, d):
    pages = _pages(spark, d, """<body><article><img alt='$ karrier, állás és munka'><h3>@ Developer #</h3><p>About <b>@</b></p><span id='x-details-location'>$ utca</span>
 <a href='/job/#?utm_source=x'>Részletek</a></article><a href='/logo.png'>Picture</a><a href='mailto:x@y.hu'>Write us</a><div><a href='/other'>Short text</a>
 <a href='/job/#'>The same once more</a><a href='/allasok/jó-cég/1,0,0,0,0,0,0,0,0,0,'>abc</a></div>""")
    return html.link_candidates(pages).select("page_id", "title", "url", "description", "company", "location")


@_query(f"""SELECT page_id, replace(replace(t, '@', p_name), '$', c_name) AS title, {_HOST} || p || page_id AS url, p = '/a/' AS described FROM {_NAMED},
 (VALUES ('/a/', '@ Engineer'), ('/b/', 'Web $'), ('/d/', '@ fejlesztő'), ('/e/', '@')) v(p, t)""")
def card_rules(spark, d):
    pages = _pages(spark, d, """<div data-href='/a/#'><h4>@ Engineer</h4><p>Pipelines</p></div><div onclick="location.href='/b/#'"><strong>Web $</strong></div>
 <ul><li><a href='/c/#'>Megnézem</a></li><li class='job new'><a href='/d/#'>@ fejlesztő</a></li></ul><app-card routerlink='/e/#'><span class='name'>@</span></app-card>
 <div data-href='/f/#'><h4>abc</h4></div>""")
    return html.card_candidates(pages).select("page_id", "title", "url", F.col("description").isNotNull().alias("described"))


@_query(f"""SELECT page_id, p_name || ' fejleszto' AS title, lower(c_name) AS company, p_name || ' utca' AS location FROM {_NAMED}
 UNION ALL SELECT page_id, 'other', '', 'other here' FROM pages""")
def search_card_rows(spark, d):
    pages = _pages(spark, d, """<ul class='jobs-search__results-list'><li><a class='base-card__full-link' href='https://hu.linkedin.com/jobs/view/dev-#'></a>
 <h3 class='base-search-card__title'> @ Fejlesztő </h3><h4 class='base-search-card__subtitle'>$</h4><span class='job-search-card__location'>@ utca</span></li>
 <li><a class='base-card__full-link' href='https://hu.linkedin.com/jobs/view/dev-#9?refId=1'></a><h3 class='base-search-card__title'>@ Fejlesztő</h3></li>
 <li><a class='base-card__full-link' href='/jobs/view/#'></a><h3 class='base-search-card__title'>Other</h3> here</li><li><h3 class='base-search-card__title'>None</h3></li></ul>
 <li><h3 class='base-search-card__title'>Outside</h3><a class='base-card__full-link' href='/x'></a></li>""")
    return html.search_cards(pages).select("page_id", "title", "company", "location")


@_query(f"SELECT page_id, p_name || ' Engineer ' || page_id AS title, {_HOST} || '/view?id=' || page_id AS url, c_name AS company FROM {_NAMED}")
def heading_rows(spark, d):
    pages = _pages(spark, d, """<main><section><div class='JobCard_company__x1'>$</div><div><h2>@ Engineer #</h2><p><a href='/view?id=#'>open</a></p></div></section></main>""")
    return html.heading_candidates(pages, "a[href*='/view?id=']", "[class*=JobCard_company]").select("page_id", "title", "url", "company")


@_query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Java' WHEN 1 THEN 'Spark, SQL' WHEN 2 THEN 'SQL' WHEN 3 THEN 'Java, SQL' END AS technologies,
 CASE page_id % 5 WHEN 0 THEN '3-5 év' WHEN 4 THEN '7 years' END AS years FROM pages""")
def description_cascade(spark, d):
    kinds = [
        "<div class='description'><ul><li>végzettség</li><li>3-5 év</li></ul> Java5</div><p>sql, 9 years</p><div data-href='/x'>spark</div>",
        "<job-profile :data='{&quot;description&quot;:&quot;&lt;p&gt;Spark&lt;/p&gt;&quot;,&quot;skills&quot;:[{&quot;name&quot;:&quot;SQL&quot;},&quot;x&quot;]}'></job-profile><p>java</p>",
        """<script type="application/ld+json">{"@graph":[{"@type":"Place"},{"@type":"JobPosting","description":"<li>a</li><li>sql</li>"}]}</script><p>java</p>""",
        "<h4 id='job-details'>Részletek</h4><p>java, sql</p>",
        f"<div class='description'>{'long words ' * 30}</div><p>java, 7 years</p><div data-href='/x'>spark 3 years</div>",
    ]
    pages = table(spark, d, "pages").select("page_id", "url", F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 5 + 1).cast("int")).alias("html"))
    texts = html.scoped_texts(pages, ".description, .job-description, #job-details, [class*=jobDescriptionColumn]", without="[data-href]")
    rows = pages.join(texts, "page_id")
    page = F.col("html")
    said = extraction.first_said(F.col("scoped"), payloads.embedded_profile(page), payloads.json_ld_description(page), payloads.next_data(page, "props.pageProps.job"))
    # columns of their own: the expressions below read them many times
    rows = rows.withColumn("said", said)
    technologies = extraction.technologies_of(F.col("said"), F.col("body"), DICTIONARY)
    return rows.select("page_id", technologies.alias("technologies"), extraction.years_in(F.col("scoped"), F.col("body")).alias("years"))


@_query("""SELECT page_id, 'https://x.hu/' || page_id AS url, 'Fejlesztő & more' AS title, CAST(3 AS BIGINT) AS total FROM pages
 UNION ALL SELECT page_id, 'https://x.hu/b', 'é–B', 3 FROM pages""")
def json_fragments(spark, d):
    row = lambda url, text: F.struct(url.alias("url"), F.lit(text).alias("row"))
    own = F.concat(F.lit("https://x.hu/"), F.col("page_id"))
    rows = F.array(row(F.lit(None).cast("string"), "none"), row(own, "<h3>Fejlesztő</h3> &amp; more"), row(own, "again"), row(F.lit("https://x.hu/b"), "&#233;&#x2013;B"))
    pages = table(spark, d, "pages").select("page_id", F.to_json(F.struct(rows.alias("rows"), F.lit(3).alias("total"))).alias("payload"))
    return payloads.fragment_rows(pages, "payload")


@_query(f"SELECT page_id, 'v\"' || page_id AS version, c_name || ' címe' AS title FROM {_NAMED}")
def page_props(spark, d):
    pages = _pages(spark, d, """<div id="app" title="a > b" data-page="{&quot;version&quot;:&quot;v\\&quot;#&quot;,&quot;props&quot;:{&quot;positions&quot;:[{&quot;title&quot;:&quot;$ címe&quot;}]}}"></div>""")
    return pages.select("page_id", payloads.page_props(F.col("html"), "version").alias("version"), payloads.page_props(F.col("html"), "props.positions[0].title").alias("title"))


@_query(f"""SELECT page_id, p_name || ' ' || page_id AS title, 'Jelentkezési határidő: ma 3 év ' || c_name AS section FROM {_NAMED} UNION ALL
 SELECT page_id, 'Tester', 'Jelentkezési határidő: holnap ' || p_name FROM {_NAMED}""")
def headed_postings(spark, d):
    pages = _pages(spark, d, """<h4>@ #</h4><h5>Jelentkezési <b>határidő</b>: ma</h5><p>3 év</p><ul><li>$</li></ul><h4>No deadline</h4><h5>Tester</h5><h4>Jelentkezési határidő: holnap</h4>@
 <h4>@ #</h4><h5>Jelentkezési határidő: ma</h5><h4>Closed</h4><h5>Jelentkezési határidő: a keresés szünetel</h5>""")
    return payloads.headed_sections(pages).select("page_id", "title", "section")


@_query(f"SELECT page_id, c_name || ' | HU-BU | 1138 | Iroda ' || page_id AS stated, p_name || ' kerület' AS labelled FROM {_NAMED}")
def posting_places(spark, d):
    pages = _pages(spark, d, """<script type='application/ld+json'>[{"jobLocation":{"name":"Iroda #","address":{"addressLocality":"$","addressRegion":"HU-BU","postalCode":"1138"}}}]</script>
 <script type="application/ld+json">broken</script><h5>Munkavégzés helye</h5> <div>@ <b>kerület</b></div><p>y</p>""")
    return pages.select("page_id", payloads.json_ld_location(F.col("html")).alias("stated"), payloads.labelled_value(F.col("html"), "munkavegzes helye").alias("labelled"))


_CRAWLED = """(SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) q, max(l_returnflag) f,
 CASE WHEN min(l_partkey) % 37 = 0 THEN 500 WHEN min(l_partkey) % 11 = 0 THEN 404 ELSE 200 END s FROM lineitem GROUP BY 1, 2)"""


@_query(f"""SELECT l_orderkey, count(*) FILTER (s = 200) AS n_pages, coalesce(CAST(sum(q) FILTER (s = 200) AS BIGINT), 0) AS cards,
 count(*) FILTER (s = 500) = 0 AND NOT arg_max(f = 'R', l_linenumber) AND coalesce(sum(q) FILTER (s = 200), 0) >= 0.9 * arg_min(q, l_linenumber)
 AS complete FROM {_CRAWLED} GROUP BY 1""")
def crawl_completeness(spark, d):
    part = F.min("l_partkey")
    status = F.when(part % 37 == 0, 500).when(part % 11 == 0, 404).otherwise(200)
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("page"))
    cards = F.sum("l_quantity").cast("long")
    pages = lines.agg(status.alias("status"), cards.alias("cards"), (F.max("l_returnflag") == "R").alias("has_next"), cards.alias("stated"))
    return crawls.crawl_runs(pages, ["l_orderkey"])


@_query("""SELECT l_orderkey, l_linenumber AS page, n_new FROM (SELECT *, min(n_new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 0 ok FROM
 (SELECT l_orderkey, l_linenumber, count(f) FILTER (f = l_linenumber) AS n_new FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN
 (SELECT l_orderkey, l_suppkey % 3 u, min(l_linenumber) f FROM lineitem GROUP BY 1, 2) x USING (l_orderkey) GROUP BY 1, 2)) WHERE ok""")
def crawl_until_nothing_new(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_suppkey") % 3).cast("string").alias("url"))
    pages = crawls.with_new_urls(rows.select("l_orderkey", "page").distinct(), rows, ["l_orderkey"])
    return crawls.pages_read(pages, ["l_orderkey"], F.col("n_new") == 0)


@_query("SELECT DISTINCT p_brand AS shard, p_name AS keyword, 'https://x.hu/search?q=' || replace(p_name, ' ', '+') || '&l=hu' AS url FROM part")
def search_shards(spark, d):
    return payloads.search_urls(table(spark, d, "part").select(F.col("p_brand").alias("shard"), F.col("p_name").alias("keyword")), "https://x.hu/search?q={}&l=hu")


@_query("""SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS o_orderpriority, c_name FROM orders LEFT JOIN
 (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END c_mktsegment FROM customer) ON c_custkey = o_custkey""")
def list_with_details(spark, d):
    details = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return payloads.with_details(rows, details, "o_custkey", ["o_orderpriority", "c_name"]).select("o_orderkey", "o_orderpriority", "c_name")


@_query("""SELECT s_suppkey, coalesce((SELECT n_name FROM nation WHERE n_nationkey = s_nationkey), '') || '/' || coalesce((SELECT n_name FROM nation WHERE n_nationkey = s_suppkey % 50), '') AS names FROM supplier""")
def taxonomy_names(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.array("s_nationkey", (F.col("s_suppkey") % 50).cast("int")).alias("ids"))
    terms = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    named = payloads.with_terms(rows, "ids", "s_suppkey", terms, "names")
    return named.select("s_suppkey", F.when(F.size("names") == 2, F.array_join("names", "/")).otherwise(F.concat(F.array_join("names", ""), F.lit("/"))).alias("names"))


@_query("""SELECT c_nationkey AS site, c_name AS title FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey, s_name FROM supplier
 WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def recipe_fallback(spark, d):
    by_recipe = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("site"), F.col("c_name").alias("title"))
    extracted = table(spark, d, "supplier").select(F.col("s_nationkey").alias("site"), F.col("s_name").alias("title"))
    return crawls.recipe_or_extracted(by_recipe, extracted, "site")


def _posted(spark, d):
    """Parts as postings: name and type are what reposts share, the size tells active from inactive ones, brands make the urls."""
    part = table(spark, d, "part").withColumn("key", F.concat_ws("/", "p_name", "p_type"))
    posted = part.select(F.col("p_partkey").alias("id"), "key", F.concat("p_brand", F.lit("/"), "p_partkey").alias("url"), (F.col("p_size") > 25).alias("active"), F.col("p_retailprice").alias("first_seen"))
    batch = part.select("key", F.concat(F.lit("new/"), "p_partkey").alias("url"), F.col("p_partkey").alias("seq"))
    return posted, batch


@_query("SELECT p_name || '/' || p_type AS key, 'new/' || min(p_partkey) AS url FROM part GROUP BY 1 HAVING max(p_size) <= 25")
def own_reposts(spark, d):
    posted, batch = _posted(spark, d)
    return crawls.without_own_reposts(batch, posted, F.col("key"), ["seq"]).select("key", "url")


@_query("""SELECT id, 'new/' || first AS url FROM (SELECT p_name, p_type, arg_max(p_partkey, (p_retailprice, p_partkey)) id FROM part WHERE p_size <= 25 GROUP BY 1, 2)
 JOIN (SELECT p_name, p_type, min(p_partkey) first FROM part GROUP BY 1, 2) USING (p_name, p_type)""")
def repost_moves(spark, d):
    posted, batch = _posted(spark, d)
    return crawls.repost_moves(batch, posted, F.col("key"), ["seq"])


@_query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Lesaffre' WHEN 1 THEN 'PEPCO Hungary Kft.' WHEN 2 THEN 'Acme' || c_custkey WHEN 3 THEN 'Zeta' END AS company FROM customer""")
def prose_company(spark, d):
    n = F.col("c_custkey")
    said = F.when(n % 5 == 0, "A Lesaffre a világ egyik cége").when(n % 5 == 1, "Partnerünk, a PEPCO Hungary Kft. Lengyelországban, kínál")
    said = said.when(n % 5 == 2, F.concat(F.lit("Acme"), n, F.lit(" is one of many"))).when(n % 5 == 3, "With Zeta’s mission").otherwise("Partnerünk kedvező árakat ad")
    return table(spark, d, "customer").select("c_custkey", extraction.company_in_prose(said).alias("company"))


@_query("""SELECT p_partkey, p_name AS marked, p_name AS bare FROM part""")
def title_cleaners(spark, d):
    marked = F.concat("p_name", F.lit(" - ÚJ állás NEW"))
    return table(spark, d, "part").select(
        "p_partkey", extraction.title_before_mark(marked).alias("marked"),
        extraction.title_before_colon(F.concat(F.lit("Diákmunka  "), "p_name", F.lit(" : feladatok: x"))).alias("bare"),
    )


@_query("""SELECT p_partkey, e IN (0, 2, 4, 5) AS junior, e IN (1, 2, 3, 5) AS medior, e IN (0, 1, 2, 3, 4, 5) AS both_ FROM (SELECT p_partkey,
 CASE WHEN p_size % 7 = 2 AND contains(p_name, 'blue') THEN 1 WHEN p_size % 7 = 6 THEN 99 ELSE p_size % 7 END e FROM part)""")
def experience_tracks(spark, d):
    n = F.col("p_size") % 7
    said = F.when(n == 0, "Junior").when(n == 1, "medior, 3 év").when(n == 2, "-").when(n == 3, "3-5 év").when(n == 4, "1 év").when(n == 5, F.lit(None).cast("string")).otherwise("gyakornok")
    title = F.when((n == 2) & F.col("p_name").contains("blue"), "Medior dev").otherwise("Dev")
    on = lambda j, m: views.on_track(title, F.lit(None).cast("string"), F.lit("x"), said, ["gyakornok", "intern"], ["diak"], j, m)
    return table(spark, d, "part").select("p_partkey", on(True, False).alias("junior"), on(False, True).alias("medior"), on(True, True).alias("both_"))


@_query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'junior' WHEN 1 THEN 'medior' WHEN 2 THEN '3 years' ELSE '-' END AS experience,
 CASE WHEN p_size % 4 = 1 THEN 'Szenior' END AS bracket FROM part""")
def resolved_levels(spark, d):
    n = F.col("p_size") % 4
    title = F.when(n == 0, "Junior dev").when(n == 1, "Dev (x) (Szenior)").otherwise("Dev")
    level = F.when(n < 2, " Középszint ")
    resolved = extraction.resolved_experience(title, F.when(n != 3, "at least 3 years of work, 3 years").otherwise("none"), level, {"középszint": "medior"})
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(resolved, "^at least ", "").alias("experience"), extraction.level_in_brackets(title).alias("bracket"))


@_query("SELECT doc_id, md5(text) AS repaired, md5(text) AS same FROM documents")
def latin1_repair(spark, d):
    text = F.col("text")
    broken = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.md5(extraction.repaired_latin1(broken)).alias("repaired"), F.md5(extraction.repaired_latin1(text)).alias("same"))


@_query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'DISABLED' END AS status FROM pages")
def anchored_status(spark, d):
    pages = _pages(spark, d, """{"/posting/other?":{"status":"PUBLISHED"},"/posting/dev-#?x":{"status":"DISABLED"}}""")
    anchor = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"/posting/dev-'), "page_id", F.lit("?"))).otherwise('"/posting/none?')
    return pages.select("page_id", extraction.status_near(F.col("html"), anchor, r'"status"\s*:\s*"([A-Z_]+)"', 400).alias("status"))


@_query("SELECT c_custkey, unnest([c_name, c_mktsegment]) AS said, unnest([c_nationkey, NULL]) AS nation FROM customer")
def parallel_arrays(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("said"), F.array("c_nationkey").alias("nation"))
    return records.unnested(rows, ["said", "nation"])


@_query("SELECT n_nationkey, n_name || '|new|' || coalesce(r_name, '') AS fields FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def merged_documents(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_nationkey"), "left")
    merged = records.merged_documents(F.create_map(F.lit("a"), "n_name", F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.coalesce("r_name", F.lit(""))))
    return rows.select("n_nationkey", F.concat_ws("|", merged["a"], merged["b"], merged["c"]).alias("fields"))


@_query("""SELECT lang, arg_min(doc_id, (-length(coalesce(text, '')), doc_id)) AS doc_id FROM documents GROUP BY 1""")
def longest_text(spark, d):
    return listing.longest(table(spark, d, "documents"), "lang", "text", "doc_id")
