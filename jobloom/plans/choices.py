"""Queries of what viewers choose and send: facets, review filters, pasted addresses, cookies and limits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions import text, urls
from jobloom.operators import records, rollups, state, views
from jobloom.plans.queries import _POSTINGS, _query, postings
from jobloom.sources.tables import evolved, table

_SOURCE = """(SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'AI - ' || o_custkey
 WHEN o_orderpriority = '2-HIGH' THEN 'AI-scraped' ELSE o_orderpriority END s FROM orders)"""


@_query(f"""SELECT o_orderkey, coalesce(s LIKE 'AI%' OR s = '5-LOW', false) AS included, NOT coalesce(s LIKE 'AI%' OR s = '5-LOW', false) AS excluded,
 coalesce(s = '5-LOW', false) AS first_wins FROM {_SOURCE}""")
def tri_state_sources(spark, d):
    source = F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("AI - "), "o_custkey"))
    source = source.when(F.col("o_orderpriority") == "2-HIGH", "AI-scraped").otherwise(F.col("o_orderpriority"))
    chosen = lambda a, b: views.of_sources_chosen(source, a, b, {"AI-scraped": "AI - "})
    both = ["AI-scraped", "5-LOW"]
    return table(spark, d, "orders").select("o_orderkey", chosen(both, []).alias("included"), chosen([], both).alias("excluded"), chosen(["5-LOW"], both).alias("first_wins"))


@_query("""SELECT p_partkey, p_size % 4 IN (0, 2, 3) AS included, p_size % 4 = 1 AS excluded, p_size % 4 NOT IN (1, 2) AS unnamed, p_size % 4 IN (1, 2) AS awake FROM part""")
def tri_state_labels(spark, d):
    n = F.col("p_size") % 4
    labels = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("A"))).when(n == 2, F.array(F.lit("A"), F.lit("B")))
    rows = table(spark, d, "part").select("p_partkey", labels.alias("labels"))
    there = views.awake(["A", "asleep"], rows.select(F.explode("labels").alias("label")))
    chosen = lambda a, b, none: views.of_labels_chosen(F.col("labels"), a, b, none)
    return rows.select(
        "p_partkey", chosen(["Egyéb", "B"], ["A"], "Egyéb").alias("included"), chosen([], ["Egyéb", "B"], "Egyéb").alias("excluded"),
        chosen([], ["A"], None).alias("unnamed"), chosen(there, [], None).alias("awake"),
    )


@_query("""SELECT event_id, event_id % 4 < 2 AS without, event_id % 4 = 2 AS third, user_id % 2 = 0 AS mine, event_type = 'click' AS only_mi, event_type IN ('view', 'error') AS mb_both,
 event_type IN ('click', 'view', 'error') AS both_ FROM events""")
def review_filters(spark, d):
    n = F.col("event_id") % 4
    semester = F.when(n == 1, "N/A").when(n > 1, (n + 1).cast("string"))
    kind = F.col("event_type")
    programme = F.when(kind == "click", "mi").when(kind == "view", "MB").when(kind == "error", "MIMB")
    mine = F.col("user_id") % 2 == 0
    return table(spark, d, "events").select(
        "event_id", views.of_semester(semester, "none", mine).alias("without"), views.of_semester(semester, "3", mine).alias("third"),
        views.of_semester(semester, "mine", mine).alias("mine"), views.of_programme(programme, "MI").alias("only_mi"),
        views.of_programme(programme, "MB_BOTH").alias("mb_both"), views.of_programme(programme, "").alias("both_"),
    )


@_query("""WITH r AS (SELECT user_id, event_id, event_id % 3 <> 0 AS somebody, CASE event_type WHEN 'view' THEN 'MB' WHEN 'error' THEN 'MIMB' ELSE 'MI' END AS said FROM events),
 g AS (SELECT user_id, count(*) FILTER (somebody AND said <> 'MB') AS mi, count(*) FILTER (somebody AND said <> 'MI') AS mb, count(*) FILTER (somebody) AS n,
 arg_min(somebody, event_id) AS f, arg_min(said, event_id) AS s FROM r GROUP BY 1)
 SELECT 'S ' || user_id AS name, CASE WHEN n = 0 THEN s WHEN mi > 0 AND mb > 0 THEN 'MIMB' WHEN mi > 0 THEN 'MI' ELSE 'MB' END AS programme, n FROM g""")
def programmes_by_subject(spark, d):
    kind = F.col("event_type")
    said = F.when(kind == "click", "mi").when(kind == "view", "MB").when(kind == "error", "MIMB")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit(" S   "), "user_id").alias("name"), F.when(F.col("event_id") % 3 == 0, "N/A").otherwise("u").alias("user"), said.alias("programme"))
    return views.programmes_by_subject(rows, "name", "user", "programme", "event_id")


@_query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.x.hu/p/' || page_id || '?a=' || page_id || '#f' WHEN 3 THEN '' WHEN 4 THEN 'https://x.hu/' || page_id
 ELSE 'https://www.linkedin.com/jobs/view/' || page_id || '/' END AS pasted FROM pages""")
def pasted_urls(spark, d):
    n = F.col("page_id")
    of = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    raw = F.when(n % 5 == 0, of(" www.x.hu/p/", n, "?UTM_any=1&a=", n, "&gclid=2#f")).when(n % 5 == 1, of("https://hu.linkedin.com/jobs/search?eBP=1&currentJobId=", n))
    raw = raw.when(n % 5 == 2, of("linkedin.com/jobs/view/", n, "?refId=4")).when(n % 5 == 3, "  ").otherwise(of("https://X.hu/", n, "?trackingId=4"))
    return table(spark, d, "pages").select("page_id", urls.pasted_url(raw).alias("pasted"))


@_query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'job:s:https://x.hu/' || c_custkey ELSE 'job:s:Title' || c_custkey END AS key FROM customer""")
def mark_migration(spark, d):
    n = F.col("c_custkey")
    marks = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("job:s:Title"), n).alias("key"))
    long = F.concat(F.lit("https://x.hu/"), F.repeat(F.lit("long"), 200), n)
    url = F.when(n % 3 == 0, F.concat(F.lit("x.hu/"), n, F.lit("?utm_source=y"))).when(n % 3 == 1, long)
    return urls.migrated_keys(marks, marks.select("key", F.lit("s").alias("source"), url.alias("url")))


@_query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a b+c=' || c_custkey WHEN 1 THEN '' ELSE '%zz' END AS cookie, CASE c_custkey % 4 WHEN 0 THEN 'dev-' || c_custkey WHEN 1 THEN 'fejleszto'
 WHEN 2 THEN '' ELSE 'engineer' END AS slug, CASE c_custkey % 3 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.2' ELSE 'unknown' END AS address FROM customer""")
def request_fields(spark, d):
    n = F.col("c_custkey")
    header = F.when(n % 3 == 0, F.concat(F.lit("x; sid=no; id=a%20b+c%3D"), n, F.lit("; id=second"))).when(n % 3 == 1, "idx=1; x=id").otherwise(" id = %zz ")
    slug = F.when(n % 4 == 0, F.concat(F.lit(" dev-"), n)).when(n % 4 == 1, '{"en":"developer","hu":"fejleszto"}').when(n % 4 == 2, "two words").otherwise('{"en":"engineer"}')
    address = text.client_address(F.when(n % 3 == 0, "10.0.0.1, 10.9.9.9"), F.when(n % 3 == 1, " 10.0.0.2 "), F.lit(""))
    return table(spark, d, "customer").select("c_custkey", text.cookie(header, "id").alias("cookie"), text.localized_slug(slug, "ro").alias("slug"), address.alias("address"))


@_query("""WITH e AS (SELECT event_id, epoch_us(ts) t, CASE WHEN event_id % 5 <> 0 THEN 'ip:' || user_id WHEN event_id % 10 <> 0 THEN 'visitor:v' || user_id END k FROM events)
 SELECT event_id, k IS NULL OR count(*) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) <= 1 AS allowed FROM e""")
def limit_by_address_or_visitor(spark, d):
    n = F.col("event_id")
    address = F.when(n % 5 == 0, "unknown").otherwise(F.col("user_id").cast("string"))
    visitor = F.when(n % 10 != 0, F.concat(F.lit("v"), "user_id"))
    rows = table(spark, d, "events").select("event_id", "ts", text.limit_key(address, visitor).alias("key"))
    held = rollups.sliding_limit(rows.where("key IS NOT NULL"), "key", "ts", 1, 300).select("event_id", "allowed")
    return held.unionByName(rows.where("key IS NULL").select("event_id", F.lit(True).alias("allowed")))


@_query(f"WITH {_POSTINGS} SELECT id, active AND NOT (source = '2-HIGH' AND first_seen < TIMESTAMP '2001-07-02') AS active FROM postings")
def expire_pushed(spark, d):
    return state.expire(postings(spark, d), "2-HIGH", "2001-08-01", 30).select("id", "active")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'none' ELSE n_name END AS n_name, true AS active FROM nation")
def evolved_rows(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).alias("n_name"), "n_regionkey")
    schema = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("active", T.BooleanType())])
    return evolved(rows, schema, {"n_name": "none", "active": True})


@_query("""SELECT r_regionkey, r_name AS name, 'u' || r_regionkey AS url FROM region UNION ALL SELECT r_regionkey, n_name, 'n' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey""")
def flattened_groups(spark, d):
    item = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    members = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(item(F.col("n_name"), F.concat(F.lit("n"), "n_nationkey"))).alias("members"))
    none = F.lit(None).cast("array<struct<name:string,url:string>>")
    entry = lambda name, url, group: F.struct(name.alias("name"), url.alias("url"), group.alias("group"))
    own = entry(F.col("r_name"), F.concat(F.lit("u"), "r_regionkey"), none)
    group = F.when(F.col("members").isNotNull(), F.array(entry(F.lit("all"), F.lit(""), F.col("members"))))
    rows = table(spark, d, "region").join(members, "r_regionkey", "left").select("r_regionkey", F.concat(F.array(own), F.coalesce(group, F.array_except(F.array(own), F.array(own)))).alias("items"))
    return views.flattened(rows, "items", "group").select("r_regionkey", "entry.name", "entry.url")


@_query("""SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT s_nationkey, min(s_name) FROM supplier WHERE s_nationkey >= 10 GROUP BY 1""")
def added_findings(spark, d):
    known = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return records.add_findings(known, table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name")), "key", "name")
