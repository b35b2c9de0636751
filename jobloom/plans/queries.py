"""Queries over the driver's tables that exercise the operators, each with the SQL that must give its rows.

orders stand for postings (o_orderpriority is the source, o_orderstatus O active and P hidden), events for
clicks, documents for descriptions, conversations for reviews by subject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions import levels, text, urls
from jobloom.operators import cleaning, listing, records, rollups, state, views
from jobloom.sources import feeds, html
from jobloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}

AS_OF = "2001-08-01"
SINCE = "2001-07-02"
TIME_BASED = ["5-LOW"]
WORDS = ["the", "tion", "der", "les", "que", "and", "than", "shion", "erth"]
#: A small technology dictionary of words that occur in the texts.
TECHNOLOGIES = [("the", "The"), ("ing", "Ing"), ("der", "Der"), ("des", "Des"), ("les", "Les"), ("license", "License"), ("gnu", "GNU")]
CATEGORIES = [("DevOps", ["small"]), ("Fejlesztő", ["ring", "widget"]), ("Hardware", ["bolt", "blue"]), ("Hálózat / Infra", ["red"]), ("Mobil", ["gear"])]
SPAM = ["lorem", "widget"]


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def _day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("https://x.example/p-"), "o_orderkey").alias("url"),
        F.col("o_orderdate").alias("first_seen"), (F.col("o_orderstatus") == "O").alias("active"), (F.col("o_orderstatus") == "P").alias("hidden"),
        (F.col("o_orderkey") % 7 == 0).alias("sweep_dead"),
    )


_POSTINGS = """postings AS (SELECT o_orderkey id, o_orderpriority source, 'https://x.example/p-' || o_orderkey url, o_orderdate first_seen,
 o_orderstatus = 'O' active, o_orderstatus = 'P' hidden, o_orderkey % 7 = 0 sweep_dead FROM orders)"""


@_query(f"""WITH {_POSTINGS} SELECT id, source, strftime(first_seen, '%Y-%m-%d') AS first_day FROM postings WHERE NOT hidden
 AND (first_seen >= TIMESTAMP '{SINCE}' OR (source <> '5-LOW' AND active)) ORDER BY first_seen DESC, id DESC LIMIT 500""")
def visible_recent(spark, d):
    rows = postings(spark, d).where(listing.visible(F.col("hidden")) & listing.alive(F.col("source"), F.col("active"), F.col("first_seen"), AS_OF, TIME_BASED))
    return listing.newest(rows, "first_seen", "id").select("id", "source", _day("first_seen").alias("first_day"))


@_query("""SELECT w AS span, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-30' - to_days(n)) AS n
 FROM (VALUES ('24h', 1), ('7d', 7), ('30d', 30)) v(w, n)""")
def window_24h_7d_30d(spark, d):
    events = table(spark, d, "events")
    counts = events.agg(*[F.count_if(listing.within(F.col("ts"), "2024-01-30", w)).alias(w) for w in ("24h", "7d", "30d")])
    return counts.unpivot([], ["24h", "7d", "30d"], "span", "n")


@_query("""SELECT k.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('refund'), ('error')) k(event_type)
 LEFT JOIN events e USING (event_type) GROUP BY 1""")
def source_counts_zero_fill(spark, d):
    wanted = spark.createDataFrame([("click",), ("view",), ("refund",), ("error",)], "event_type string")
    return listing.counts_with_zeros(table(spark, d, "events"), "event_type", wanted)


@_query(f"""WITH {_POSTINGS} SELECT source, count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (hidden) AS hidden,
 count(*) FILTER (sweep_dead) AS dead FROM postings GROUP BY 1""")
def audit_summary(spark, d):
    return listing.conditional_counts(postings(spark, d), ["source"], {"active": F.col("active"), "hidden": F.col("hidden"), "dead": F.col("sweep_dead")})


@_query("""SELECT strftime(m, '%Y-%m') AS month, CAST(coalesce(sum(l), 0) AS BIGINT) AS total
 FROM (SELECT unnest(generate_series(DATE '2001-04-01', DATE '2001-09-01', INTERVAL 1 MONTH)) m) LEFT JOIN
 (SELECT date_trunc('month', o_orderdate) d, 1 l FROM orders) ON d = m GROUP BY 1""")
def monthly_totals_spine(spark, d):
    return rollups.monthly_totals(table(spark, d, "orders"), "o_orderdate", F.lit(1).cast("long"), rollups.months(spark, "2001-09-01", 6))


def _categories(spark, d):
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("intern:"), "p_type")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select(name.alias("category"), F.col("p_size").cast("long").alias("count"))


_CATEGORIES = "c AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'intern:' || p_type ELSE p_type END category, p_size FROM part)"


@_query(f"WITH {_CATEGORIES} SELECT category, CAST(sum(p_size) AS BIGINT) AS total FROM c WHERE category NOT LIKE 'intern:%' GROUP BY 1")
def category_sums(spark, d):
    return rollups.category_sums(_categories(spark, d), "category", "count", intern=False)


@_query(f"WITH {_CATEGORIES} SELECT substring(category, 8) AS category, CAST(sum(p_size) AS BIGINT) AS total FROM c WHERE category LIKE 'intern:%' GROUP BY 1")
def intern_category_sums(spark, d):
    return rollups.category_sums(_categories(spark, d), "category", "count", intern=True)


@_query("SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE user_id NOT IN (1, 2, 3) GROUP BY 1")
def unique_target_counts(spark, d):
    return rollups.target_counts(table(spark, d, "events"), "user_id", "event_type", [1, 2, 3])


@_query("""SELECT count(*) AS n FROM (SELECT min(ts) a, max(ts) b FROM events GROUP BY user_id)
 WHERE CAST(b AS DATE) >= DATE '2024-01-15' AND CAST(a AS DATE) < CAST(b AS DATE)""")
def returning_users(spark, d):
    return rollups.returning(table(spark, d, "events"), "user_id", "ts", "2024-01-15")


@_query("""SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1
 ORDER BY CASE WHEN c_nationkey = 7 THEN 0 ELSE 1 END, min(c_acctbal) NULLS LAST, c_nationkey LIMIT 5)""")
def first_n_groups_all_rows(spark, d):
    rows = table(spark, d, "customer").withColumn("name", F.col("c_nationkey").cast("string"))
    return listing.first_groups(rows, "name", "c_acctbal", 5, pinned="7").select("c_custkey", "c_mktsegment", "c_nationkey")


@_query("""SELECT conv_id AS key, count(*) AS n, array_to_string(list(role ORDER BY turn), '>') AS roles,
 array_to_string(list_sort(list(DISTINCT role)), ',') AS tags, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def grouped_reviews(spark, d):
    rows = table(spark, d, "conversations")
    entry = F.struct("role", F.length("text").cast("long").alias("chars"))
    out = listing.grouped_entries(rows, F.col("conv_id"), ["turn"], entry, "role")
    chars = F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    roles = F.array_join(F.transform("entries", lambda x: x["role"]), ">")
    return out.select("key", F.size("entries").cast("long").alias("n"), roles.alias("roles"), F.array_join("tags", ",").alias("tags"), chars.alias("chars"))


@_query("""SELECT event_type, round(avg(n), 1) AS mean, round(median(n), 1) AS median FROM (SELECT CAST(ts AS DATE) d, event_type, count(*) n
 FROM events GROUP BY 1, 2) GROUP BY 1""")
def daily_mean_median(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return listing.mean_and_median(daily, ["event_type"], "n")


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", text.labels_array(F.col("text"), TECHNOLOGIES).alias("technologies"))


def _label_sql(where: str) -> str:
    parts = [f"SELECT '{label}' AS label, count(*) AS n FROM documents WHERE {where} regexp_matches(lower(text), '(^|[^a-z0-9]){k}([^a-z0-9]|$|[0-9])')" for k, label in TECHNOLOGIES]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@_query(_label_sql(""))
def facet_counts(spark, d):
    return listing.facet_counts(_labelled(spark, d), "technologies")


@_query(_label_sql("lang IN ('en', 'de') AND"))
def facet_counts_filtered(spark, d):
    return listing.facet_counts(_labelled(spark, d).where(listing.chosen(F.col("lang"), ["en", "de"], ["de"])), "technologies")


def _keyword_sql(condition: str) -> str:
    return " UNION ALL ".join(f"SELECT '{w}' AS word, count(*) AS n FROM documents WHERE {condition.format(w=w)}" for w in WORDS)


def _keywords(spark, d, match) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.agg(*[F.count_if(match(F.col("text"), w)).alias(w) for w in WORDS]).unpivot([], WORDS, "word", "n")


def _keywords_in_one_pass(spark, d, digit_may_follow: bool) -> DataFrame:
    found = table(spark, d, "documents").select(F.explode(text.keywords_in(F.col("text"), WORDS, digit_may_follow)).alias("word"))
    return listing.counts_with_zeros(found, "word", spark.createDataFrame([(w,) for w in WORDS], "word string"))


@_query(_keyword_sql("regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"))
def keyword_boundary(spark, d):
    return _keywords_in_one_pass(spark, d, digit_may_follow=False)


@_query(_keyword_sql("regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$|[0-9])')"))
def keyword_tech(spark, d):
    return _keywords_in_one_pass(spark, d, digit_may_follow=True)


@_query(_keyword_sql("contains(lower(text), '{w}')"))
def keyword_substring(spark, d):
    return _keywords(spark, d, lambda t, w: F.lower(t).contains(w))


_CATEGORY_SQL = """WITH m AS (SELECT p_partkey, p_name, contains(p_name, 'small') s, regexp_matches(p_name, '(^|[^a-z0-9])(ring|widget)([^a-z0-9]|$)') f,
 regexp_matches(p_name, '(^|[^a-z0-9])(bolt|blue)([^a-z0-9]|$)') h, regexp_matches(p_name, '(^|[^a-z0-9])red([^a-z0-9]|$)') r,
 regexp_matches(p_name, '(^|[^a-z0-9])gear([^a-z0-9]|$)') g FROM part)
 SELECT p_partkey, CASE WHEN s THEN 'DevOps' WHEN g THEN 'Mobil' WHEN h THEN 'Hardware' WHEN r THEN 'Hálózat / Infra' WHEN f THEN 'Fejlesztő' ELSE 'Egyéb' END AS category FROM m"""


@_query(_CATEGORY_SQL)
def category_classify(spark, d):
    return table(spark, d, "part").select("p_partkey", levels.category_of(F.col("p_name"), CATEGORIES).alias("category"))


@_query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers, coalesce(regexp_matches(lower(strip_accents(text)),
 '(^|[^a-z0-9_])(senior|szenior|lead)([^a-z0-9_]|$)') OR list_min(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT))) >= 5, false) AS senior
 FROM documents""")
def senior_min_number(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", levels.numbers_in(F.col("text")).alias("numbers"))
    return docs.select("doc_id", F.size("numbers").cast("long").alias("numbers"), levels.is_senior(F.col("text"), numbers=F.col("numbers")).alias("senior"))


@_query("""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS normal FROM documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal"))


@_query("""SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' Élan ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS accents_out,
 regexp_replace(regexp_replace(lower(strip_accents(c_name || ' Élan ' || c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM customer""")
def slug(spark, d):
    name = F.concat("c_name", F.lit(" Élan "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", text.slug_keeping_accents_out(name).alias("accents_out"), text.slug(name).alias("slug"))


_CANONICAL_SQL = """concat(split_part(split_part(url, '#', 1), '?', 1), CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END)"""
_QUERY_SQL = """(SELECT *, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN
 ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid')) q FROM pages)"""


@_query(f"SELECT page_id, {_CANONICAL_SQL} AS canonical FROM {_QUERY_SQL}")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@_query("""SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/') AS path,
 split_part(regexp_extract(url, '://([^/?#]+)', 1), '.', -2) AS source FROM pages""")
def url_host_path(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.url_host(url).alias("host"), urls.url_path(url).alias("path"), urls.source_of(url).alias("source"))


_DROP_SQL = "".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>|" for t in ("script", "style", "svg", "head", "noscript")) + "<!--.*?-->"


@_query(f"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '{_DROP_SQL}', ' ', 'gis'),
 '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS chars FROM pages""")
def html_text_len(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(html.text_of(F.col("html"))).cast("long").alias("chars"))


@_query("""SELECT page_id, CAST(len(h) AS BIGINT) AS n, array_to_string(h, ' ') AS hrefs FROM (SELECT page_id,
 regexp_extract_all(html, '<a\\b[^>]*?\\shref="([^"]*)"', 1) h FROM pages)""")
def html_anchors(spark, d):
    return table(spark, d, "pages").select("page_id", html.anchors(F.col("html")).alias("h")).select("page_id", F.size("h").cast("long").alias("n"), F.array_join("h", " ").alias("hrefs"))


@_query("""SELECT page_id, seq, t AS title, host || h AS url FROM (SELECT page_id, host, unnest(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) AS h,
 unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS t, unnest(range(len(regexp_extract_all(nav, '<a href="')))) AS seq FROM
 (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages)) WHERE t <> ''""")
def html_recipe(spark, d):
    # the recipe names neither company nor location
    return html.run_recipe(table(spark, d, "pages"), {"card": "nav li", "title": "a", "url": "a@href"}).select("page_id", "seq", "title", "url")


@_query("""SELECT page_id, min(seq) AS seq, arg_min(t, seq) AS title, url, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS location FROM
 (SELECT page_id, t, host || h AS url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq FROM (SELECT page_id, host, unnest(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) AS h,
 unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS t, unnest(range(len(regexp_extract_all(nav, '<a href="')))) AS i FROM
 (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS host, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages)) WHERE length(t) >= 4) GROUP BY page_id, url""")
def html_link_candidates(spark, d):
    return html.link_candidates(table(spark, d, "pages"))


@_query("""SELECT min(doc_id) AS doc_id, key FROM (SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS key FROM documents) GROUP BY key""")
def dedupe_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("key"))
    return cleaning.first_per_key(rows, ["key"], ["doc_id"])


@_query(f"""WITH {_POSTINGS} SELECT source, url, id % 3 = 0 AS is_new FROM postings""")
def insert_if_absent(spark, d):
    # every posting is in the table or in the batch, some are in both
    rows = postings(spark, d).select("id", "source", "url")
    return state.insert_absent(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0 OR id % 5 = 0"), ["source", "url"], ["id"]).select("source", "url", "is_new")


@_query("""SELECT c_custkey, CASE WHEN o AND NOT (e IN ('', '-')) THEN e WHEN o THEN coalesce(ne, e) ELSE ne END AS experience,
 CASE WHEN o THEN coalesce(s, ns) ELSE ns END AS company FROM (SELECT c_custkey, c_custkey % 2 = 0 o,
 CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE 'junior' END e, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 3 = 0 THEN 'senior' END ne,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END s, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 3 = 0 THEN 'filled' END ns FROM customer)""")
def fill_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 4 == 0, "-").otherwise("junior").alias("experience"),
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("company"),
    )
    new = c.where("c_custkey % 2 = 1 OR c_custkey % 3 = 0").select("c_custkey", F.lit("senior").alias("experience"), F.lit("filled").alias("company"))
    fills = {"experience": F.col("experience").isin("", "-") | F.col("experience").isNull(), "company": F.col("company").isNull()}
    return state.fill_upsert(old, new, ["c_custkey"], fills)


@_query(f"""WITH {_POSTINGS}, r AS (SELECT *, id % 2 = 0 AND source <> '3-MEDIUM' found, source IN ('1-URGENT', '2-HIGH') complete, source <> '3-MEDIUM' counts FROM postings),
 h AS (SELECT *, counts AND found AND NOT (source = '2-HIGH' AND sweep_dead) hit FROM r)
 SELECT id, CASE WHEN hit THEN true WHEN counts AND complete AND NOT found AND first_seen < TIMESTAMP '2001-07-29' THEN false ELSE active END AS active,
 sweep_dead AND NOT hit AS sweep_dead FROM h""")
def reconcile_states(spark, d):
    rows = postings(spark, d)
    runs = rows.select("source").distinct().withColumns({"complete": F.col("source").isin("1-URGENT", "2-HIGH"), "empty_is_valid": F.lit(False)})
    found = rows.where("id % 2 = 0 AND source <> '3-MEDIUM'").select("source", "url")
    return state.reconcile(rows, found, runs, AS_OF, ["2-HIGH"]).select("id", "active", "sweep_dead")


@_query(f"""WITH {_POSTINGS} SELECT id, CASE WHEN id % 4 = 0 THEN url || '-' || (id + 1000000) ELSE url || '-' || id END AS url,
 active OR id % 4 = 0 AS active FROM postings""")
def migrate_urls(spark, d):
    rows = postings(spark, d)
    old = rows.withColumn("url", F.concat("url", F.lit("-"), "id"))
    batch = rows.where("id % 4 = 0").select("source", F.concat("url", F.lit("-"), F.col("id") + 1000000).alias("url"))
    return state.migrate_urls(old, batch, urls.stable_key(F.col("url"))).select("id", "url", "active")


def _probes(rows: DataFrame) -> DataFrame:
    status = lambda n: F.when(F.col("id") % n == 0, 404).otherwise(200)
    dead = lambda n: state.is_dead(status(n), F.col("url"), F.col("url"), F.lit(""), F.lit(False), F.lit(None).cast("string"))
    return rows.where("id % 11 <> 0").select("source", "url", dead(3).alias("dead1"), dead(6).alias("dead2"), F.lit(True).alias("answered"))


@_query(f"""WITH {_POSTINGS} SELECT id, active AND NOT (id % 6 = 0 AND id % 11 <> 0) AS active,
 sweep_dead OR (active AND id % 6 = 0 AND id % 11 <> 0) AS sweep_dead FROM postings""")
def sweep_dead(spark, d):
    rows = postings(spark, d)
    return state.sweep(rows, _probes(rows)).select("id", "active", "sweep_dead")


@_query(f"""WITH {_POSTINGS}, b AS (SELECT *, NOT active AND (sweep_dead OR source = '1-URGENT') AND first_seen >= TIMESTAMP '2001-06-17'
 AND id % 3 <> 0 AND id % 11 <> 0 AND source <> '5-LOW' back FROM postings) SELECT id, active OR back AS active, sweep_dead AND NOT back AS sweep_dead FROM b""")
def revive_dead(spark, d):
    rows = postings(spark, d)
    return state.revive(rows, _probes(rows), AS_OF, ["1-URGENT"], TIME_BASED).select("id", "active", "sweep_dead")


@_query(f"""WITH {_POSTINGS} SELECT source, (source = '5-LOW' AND first_seen < TIMESTAMP '{SINCE}') OR (NOT active AND first_seen < TIMESTAMP '2001-06-02') AS archived,
 count(*) AS n FROM postings GROUP BY 1, 2""")
def archive_split(spark, d):
    rows = postings(spark, d)
    archived = state.to_archive(F.col("source"), F.col("active"), F.col("first_seen"), AS_OF, TIME_BASED)
    return rows.groupBy("source", archived.alias("archived")).agg(F.count("*").alias("n"))


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 20 <> 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def batch_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = rows.where("c_custkey % 10 = 0").select("c_custkey", F.when(F.col("c_custkey") % 20 != 0, "CHANGED").alias("c_mktsegment"))
    return state.batch_update(rows, changes, "c_custkey", ["c_mktsegment"])


@_query(f"""WITH {_POSTINGS} SELECT id, CASE WHEN active THEN 'live' ELSE 'cached' END AS origin FROM postings WHERE id % 9 = 0""")
def applied_view(spark, d):
    rows = postings(spark, d)
    live = rows.where("active").select("id", "url", F.lit("live").alias("origin"))
    cached = rows.where("id % 9 = 0").select("id", "url", F.lit("cached").alias("origin"))
    return listing.live_or_cached(live, cached, "url").select("id", "origin")


@_query("""SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10)""")
def cross_source_dups(spark, d):
    digits = lambda c: F.concat(F.lit("Role "), F.col(c) % 10)
    company = lambda c: F.concat(F.lit("The Firm"), F.col(c), F.lit(" Ltd"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.lit("a").alias("source"), company("s_nationkey").alias("company"), digits("s_suppkey").alias("title"))
    others = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.lit("b").alias("source"), company("c_nationkey").alias("company"), digits("c_custkey").alias("title"))
    return cleaning.listed_elsewhere(rows, others).select("s_suppkey")


@_query("""SELECT event_id, count(*) OVER w AS hits, count(*) OVER w <= 3 AS allowed, CASE WHEN count(*) OVER w > 3
 THEN CAST(ceil((min(epoch_us(ts)) OVER w + 14400000000 - epoch_us(ts)) / 1000000.0) AS BIGINT) END AS retry_after
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 14399999999 PRECEDING AND CURRENT ROW)""")
def rate_limit_sliding(spark, d):
    return rollups.sliding_limit(table(spark, d, "events"), "user_id", "ts", 3, 14400).select("event_id", "hits", "allowed", "retry_after")


@_query("""SELECT event_id, CAST(greatest(0, least(k, 50 - u)) AS BIGINT) AS granted FROM (SELECT event_id, k, coalesce(sum(k) OVER (PARTITION BY user_id, s
 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) u FROM (SELECT *, event_id % 23 k, epoch_us(ts) // 86400000000 s FROM events))""")
def rate_limit_fixed(spark, d):
    rows = table(spark, d, "events").withColumn("rows", F.col("event_id") % 23)
    return rollups.fixed_limit(rows, "user_id", "ts", "rows", 50, 86400).select("event_id", "granted")


@_query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get(feeds.json_rows(F.col("props"), "struct<k:long>"), F.lit(0))["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"))


@_query("SELECT s_suppkey FROM supplier WHERE NOT (s_nationkey % 2 = 0 AND s_suppkey % 10 = 3)")
def blocklist_anti(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 2).cast("string").alias("source"), F.concat(F.lit("Cég "), F.col("s_suppkey") % 10).alias("company"))
    return cleaning.without_blocked(rows, spark.createDataFrame([("0", "CEG  3")], "source string, company string")).select("s_suppkey")


@_query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(^| )(lorem|widget)( |$)') THEN 'denied' WHEN p_size < 5 THEN 'small' END AS reason FROM part")
def denylist_reasons(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return cleaning.reasons(rows, [("denied", cleaning.denied(F.col("p_name"), SPAM)), ("small", F.col("p_size") < 5)]).select("p_partkey", "reason")


@_query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey id, NULL parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer), w AS (SELECT id, name AS path FROM n WHERE parent IS NULL
 UNION ALL SELECT n.id, w.path || '/' || n.name FROM n JOIN w ON n.parent = w.id) SELECT id, path FROM w""")
def folder_tree(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    nodes = table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(table(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    return feeds.tree_paths(spark, nodes)


@_query("""SELECT p_partkey, 10000 + list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))),
 lambda h, c: (h * 31 + c) & 2147483647) % 90000 AS hash FROM part""")
def title_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_hash(F.col("p_name")).alias("hash"))


@_query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7 OFFSET 3")
def offset_page(spark, d):
    return listing.page(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 3, 7)


@_query("""SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 1) AS percent, round(CAST(n AS DOUBLE) / max(n) OVER (), 3) AS of_most
 FROM (SELECT event_type, count(*) n FROM events GROUP BY 1)""")
def category_shares(spark, d):
    return listing.shares(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "n")


@_query("""SELECT user_id, event_type AS applied_by, true AS applied FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0 AND event_type <> 'error')
 UNION SELECT user_id, event_type, true FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' UNION SELECT o.user_id, o.event_type, true FROM events o
 WHERE o.event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_id % 2 = 1 AND n.user_id = o.user_id AND n.event_type = o.event_type)""")
def upsert_or_delete(spark, d):
    keys = ["user_id", "applied_by"]
    of = lambda k: table(spark, d, "events").where(f"event_id % 2 = {k}").select("user_id", F.col("event_type").alias("applied_by")).distinct()
    old = of(0).withColumns({"applied": F.lit(True), "job_data": F.lit('{"a":1}')})
    change = of(1).withColumns({"applied": F.col("applied_by") != "error", "job_data": F.lit("{}")})
    return state.upsert_or_delete(old, change, keys, ["applied"], "job_data").select(*keys, "applied")


_YEARS_SAID = ["végzettség1-5 év", "we ask 5–7+ years", "minimum 3 years", "több mint 20 éves tapasztalattal", "2  years or 2 Years"]


@_query("""WITH t AS (SELECT doc_id, regexp_replace(text, '(\\p{L})(\\d)', '\\1 \\2', 'g') t FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), s FROM (VALUES @SAID@) v(s))),
 f AS (SELECT doc_id, flatten([regexp_extract_all(t, '(?i)' || p) FOR p IN ['\\b\\d+\\s?(?:[-–]\\s?\\d+)?\\s?\\+?\\s?(?:év|éves|eves|years?|yrs?)\\b', '\\bminimum\\s?\\d+\\s?(?:év|eves|years?|yrs?)\\b',
 '\\bat least\\s?\\d+\\s?\\+?\\s?years?\\b', '\\blegal[áa]bb\\s+\\d+\\s?(?:[ée]ves|[ée]v|years?)\\b', '\\btobb\\s?eves\\b', '\\bseveral\\s?years?\\b']]) m FROM t),
 s AS (SELECT doc_id, [lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) FOR x IN m IF len([n FOR n IN regexp_extract_all(x, '\\d+') IF TRY_CAST(n AS BIGINT) > 15]) = 0] p FROM f),
 q AS (SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i) q FROM s)
 SELECT doc_id, nullif(array_to_string([x FOR x IN q IF len([o FOR o IN q IF o <> x AND contains(o, x)]) = 0], ', '), '') AS years FROM q
 """.replace("@SAID@", ", ".join(f"('{x}')" for x in _YEARS_SAID)))
def years_extract(spark, d):
    # literal phrases beside the texts, which hold few of their own
    said = spark.createDataFrame([(-k, x) for k, x in enumerate(_YEARS_SAID, 1)], "doc_id long, text string")
    texts = table(spark, d, "documents").select("doc_id", "text").unionByName(said)
    return texts.select("doc_id", levels.years_phrases(F.col("text")).alias("years"))


@_query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS interns FROM orders
 WHERE o_orderkey % 9 < 5 GROUP BY 1""")
def daily_totals(spark, d):
    rows = table(spark, d, "orders").withColumn("experience", F.concat(F.col("o_orderkey") % 9, F.lit("-10 years")))
    out = rollups.daily_totals(rows, "o_orderdate", "experience", F.col("o_orderkey") % 3 == 0)
    return out.select(_day("day").alias("day"), "total", "interns")


@_query("""SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1""")
def local_day_counts(spark, d):
    # Budapest is an hour ahead of UTC in January
    return table(spark, d, "events").groupBy(_day(views.local_day(F.col("ts"), "Europe/Budapest")).alias("day")).agg(F.count("*").alias("n"))


@_query("""SELECT p_partkey, contains(lower(p_name), 'red') AS live, contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'eco') AS saved FROM part""")
def free_text_search(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    saved = views.searched([name], None, ["bolt"]) | views.searched([kind], "  ", ["ECO"])
    return table(spark, d, "part").select("p_partkey", views.searched([name], " RED ", ["bolt"]).alias("live"), saved.alias("saved"))


@_query("""SELECT p_partkey, (regexp_matches(lower(p_name || ' ' || p_type), 'ring|small') AND NOT contains(p_name, 'junior')) OR contains(p_brand, '#3') AS intern FROM part""")
def intern_mode(spark, d):
    intern = views.intern_mode(F.col("p_name"), F.col("p_type"), F.col("p_brand"), ["ring", "small"], ["brand#3"])
    return table(spark, d, "part").select("p_partkey", intern.alias("intern"))


@_query("""SELECT p_partkey, CASE WHEN p_size >= 5 THEN NULL WHEN p_partkey % 4 = 0 THEN 'medior' WHEN p_size IN (0, 1) THEN 'junior' ELSE 'any' END AS track FROM part""")
def level_track(spark, d):
    title = F.when(F.col("p_partkey") % 4 == 0, "Mid-level dev").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", views.track(title, F.concat("p_size", F.lit(" év"))).alias("track"))


@_query("""SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'AI-scraped' ELSE o_orderpriority END AS shown, count(*) AS n FROM orders GROUP BY 1""")
def shown_sources(spark, d):
    source = F.when(F.col("o_orderpriority").rlike("^[12]"), F.concat(F.lit("AI - "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy(views.shown_source(source).alias("shown")).agg(F.count("*").alias("n"))


@_query("""SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')), 'cion') OR contains(lower(source), 'cion')""")
def review_search(spark, d):
    return table(spark, d, "documents").where(views.review_search(F.col("text"), F.col("source"), "ción")).select("doc_id")


@_query("""SELECT n_name, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END, CASE WHEN n_nationkey % 3 = 0 THEN 9999 ELSE n_nationkey END,
 CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_nationkey || ' ' || n_name END) AS INTEGER) AS place FROM nation""")
def file_order(spark, d):
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat_ws(" ", "n_nationkey", "n_name"))
    order = views.file_order(F.col("n_regionkey") == 1, name)
    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(*order)).alias("place"))


@_query("""SELECT p_partkey, nullif(concat_ws('; ', CASE WHEN contains(p_name, 'red') THEN 'warm' END, CASE WHEN contains(p_name, 'ring') THEN 'round' END), '') AS notes FROM part""")
def keyword_notes(spark, d):
    notes = F.array_join(views.notes_for(F.col("p_name"), {"red": "warm", "Ring": "round"}), "; ")
    return table(spark, d, "part").select("p_partkey", F.nullif(notes, F.lit("")).alias("notes"))


@_query("""SELECT n, array_to_string(list_sort(f), ',') AS first FROM (SELECT count(*) n FROM customer WHERE lower(c_name) LIKE '%customer#00000000_%'),
 (SELECT list(c_name) f FROM (SELECT c_name FROM customer WHERE lower(c_name) LIKE '%customer#00000000_%' ORDER BY 1 LIMIT 5))""")
def like_count_and_first(spark, d):
    return views.truncated_list(table(spark, d, "customer"), "CUSTOMER#00000000_", "c_name", 5).select("n", F.array_join("first", ",").alias("first"))


@_query("""SELECT user_id, epoch_us(coalesce(min(ts) FILTER (event_id % 3 = 0), min(ts))) AS created_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1""")
def visitor_touch(spark, d):
    at = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    old = at.where("event_id % 3 = 0").groupBy("user_id").agg(F.min("at").alias("created_at"), F.max("at").alias("last_at"))
    out = records.touch(old, at.where("event_id % 3 <> 0").select("user_id", "at"), "user_id")
    return out.select("user_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_at").alias("last_us"))


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer""")
def whitelist_patch(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    new = F.when(F.col("c_custkey") % 6 == 0, "patched").when(F.col("c_custkey") % 6 == 2, "N/A")
    patches = rows.where("c_custkey % 2 = 0").select("c_custkey", new.alias("c_mktsegment"), F.lit("refused").alias("c_name"))
    return records.patch(rows, patches, "c_custkey", ["c_mktsegment"])


@_query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 'widget')")
def purge_by_word(spark, d):
    return records.purge(records.purge(table(spark, d, "part"), "p_name", "Widget"), "p_name", "ri").select("p_partkey")


@_query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_custkey % 2 = 0)")
def owner_scoped_delete(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    wanted = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-1).alias("o_custkey"))
    return records.owned(rows, "o_custkey", wanted, "o_orderkey").select("o_orderkey")


@_query("""SELECT user_id, arg_max(event_id, (event_id % 2, ts, event_id)) AS event_id FROM events GROUP BY 1""")
def registry_merge(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return records.merge_registry(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "at").select("user_id", "event_id")


@_query("""SELECT DISTINCT 'reviews-' || strftime(o_orderdate, '%Y-%m-%d') || '.json' AS key FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-22' UNION SELECT 'latest.json'""")
def backup_retention(spark, d):
    keys = table(spark, d, "orders").select(F.concat(F.lit("reviews-"), _day("o_orderdate"), F.lit(".json")).alias("key")).distinct()
    return records.kept_backups(keys.unionByName(spark.createDataFrame([("latest.json",)], "key string")), "key", AS_OF)


@_query("SELECT event_id FROM events ORDER BY ts DESC LIMIT 26")
def report_index(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return records.capped_index(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "ts").select("event_id")


@_query("""SELECT w.c_mktsegment, count(c_custkey) AS n FROM (VALUES ('MACHINERY'), ('nothing')) w(c_mktsegment) LEFT JOIN customer USING (c_mktsegment) GROUP BY 1""")
def ambiguity_check(spark, d):
    return records.ambiguous(table(spark, d, "customer"), spark.createDataFrame([("MACHINERY",), ("nothing",)], "c_mktsegment string"), "c_mktsegment")


@_query("""SELECT CASE WHEN p_size < 5 THEN 'small' ELSE 'new' END AS outcome, count(*) AS n FROM part GROUP BY 1""")
def run_metrics(spark, d):
    return records.run_metrics(table(spark, d, "part"), F.when(F.col("p_size") < 5, "small"))


@_query("""SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(html, '@DROP@', ' ', 'gis'), '\\s+', ' ', 'g'))) AS BIGINT) AS chars FROM pages""".replace("@DROP@", _DROP_SQL))
def html_reduced_len(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(html.reduced(F.col("html"))).cast("long").alias("chars"))


from jobloom.plans import chains, choices, extracts, origins, rules  # noqa: E402,F401  register their queries
