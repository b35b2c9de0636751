"""Queries of gates, URL rules, dictionaries, order and mutations, each with the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions import gates, levels, text, urls
from jobloom.operators import cleaning, listing, rollups, state
from jobloom.plans.queries import _POSTINGS, _query, postings
from jobloom.sources.tables import table

#: Keywords of the whole-dictionary query: the words of the texts with the most occurrences, as many as a large dictionary has.
DICTIONARY_WORDS = 376
AS_OF = "2001-08-01"


@_query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) w FROM documents),
 k AS (SELECT w, count(*) n FROM w WHERE regexp_full_match(w, '[a-z]{{3,}}') GROUP BY 1 ORDER BY n DESC, w LIMIT {DICTIONARY_WORDS})
 SELECT upper(k.w) AS label, count(DISTINCT doc_id) AS n FROM k JOIN (SELECT doc_id, regexp_extract(w, '^([a-z]+)(?:[0-9].*)?$', 1) w FROM w) s ON s.w = k.w GROUP BY 1""")
def dictionary_facets(spark, d):
    docs = table(spark, d, "documents").select("text")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    most = words.where(F.col("w").rlike("^[a-z]{3,}$")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS)
    dictionary = [(r["w"], r["w"].upper()) for r in most.collect()]
    return listing.facet_counts(docs.select(text.labels_array(F.col("text"), dictionary).alias("technologies")), "technologies")


@_query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 23 k, epoch_us(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) i FROM events),
 w AS (SELECT user_id, event_id, i, CASE WHEN k > 0 THEN t END s, least(k, 50) u, least(k, 50) g FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN s IS NULL OR t - s >= 86400000000 THEN CASE WHEN k > 0 THEN t END ELSE s END,
 CASE WHEN s IS NULL OR t - s >= 86400000000 THEN least(k, 50) ELSE u + least(k, 50 - u) END,
 CASE WHEN s IS NULL OR t - s >= 86400000000 THEN least(k, 50) ELSE least(k, 50 - u) END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
 SELECT event_id, CAST(g AS BIGINT) AS granted FROM w""")
def write_budget(spark, d):
    rows = table(spark, d, "events").withColumn("rows", F.col("event_id") % 23)
    return rollups.budget_granted(rows, "user_id", "ts", "event_id", "rows", 50, 86400)


_PLACE = "CASE p_size % 6 WHEN 0 THEN 'Budapest' WHEN 1 THEN 'BUDAPEST, XI. kerület' WHEN 2 THEN '1117 Bp.' WHEN 3 THEN 'Győr' WHEN 4 THEN 'Home  Office' ELSE '' END"
_PLAIN = f"lower(strip_accents(trim(regexp_replace({_PLACE}, '\\s+', ' ', 'g'))))"


@_query(f"""SELECT p_partkey, contains({_PLAIN}, 'budapest') AS named, {_PLAIN} = 'budapest' AS alone,
 contains({_PLAIN}, 'budapest') OR regexp_matches({_PLAIN}, '\\b1\\d\\d\\d\\b') AS post_code,
 regexp_matches(lower({_PLACE}), '\\bbudapest|\\bbp\\b|\\b1[0-2]\\d\\d\\b') AS in_text,
 CASE WHEN {_PLAIN} <> '' THEN contains({_PLAIN}, 'budapest') ELSE contains(p_name, 'red') END AS by_text,
 contains({_PLAIN}, 'budapest') OR contains({_PLAIN}, 'home office') AS home,
 contains(lower({_PLACE}), 'kerület') OR contains(lower({_PLACE}), 'budapest') AS listed FROM part""")
def place_gates(spark, d):
    part = table(spark, d, "part").withColumn("place", F.expr(_PLACE))
    place, title = F.col("place"), F.when(F.col("p_name").contains("red"), "Munka Budapesten").otherwise(F.col("p_name"))
    return part.select(
        "p_partkey", gates.names_budapest(place).alias("named"), gates.is_budapest(place).alias("alone"), gates.budapest_or_post_code(place).alias("post_code"),
        gates.budapest_in_text(place).alias("in_text"), gates.budapest_by_place_or_text(place, title, F.lit(None).cast("string")).alias("by_text"),
        gates.budapest_or_home(place).alias("home"), gates.budapest_among(F.array(F.lit("x"), place)).alias("listed"),
    )


@_query("""SELECT c_custkey, c_nationkey = 7 OR c_nationkey % 5 = 0 AS inside, c_nationkey IN (3, 7) OR c_nationkey % 2 = 0 AS open,
 c_nationkey % 4 <> 0 AS latin FROM customer""")
def country_and_script_gates(spark, d):
    nation = F.col("c_nationkey")
    stated = F.when(nation % 5 == 0, "Work in HUNGARY").otherwise("elsewhere")
    code = F.when(nation % 2 == 0, F.when(nation % 4 == 0, "").otherwise("HU")).when(nation == 3, F.lit(None).cast("string")).when(nation == 7, "hu").otherwise("AT")
    title = F.when(nation % 4 == 0, "Инженер x").otherwise("Mérnök")
    inside = gates.in_country(F.when(nation == 7, "HU"), stated)
    return table(spark, d, "customer").select("c_custkey", inside.alias("inside"), gates.not_elsewhere(code).alias("open"), gates.latin_script(title).alias("latin"))


@_query("""SELECT p_partkey, regexp_matches(p_name, '(^|[^a-z0-9])(ring|blue|ai)([^a-z0-9]|$)') OR p_size = 3 AS it FROM part""")
def it_gate(spark, d):
    title = F.when(F.col("p_size") == 3, F.concat("p_name", F.lit("Analyst"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", gates.is_it_job(title, ["Ring", "blue"]).alias("it"))


@_query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.profession.hu/allas/job-' || page_id WHEN page_id % 3 = 1
 THEN 'https://www.profession.hu/allas/job-' || page_id || '/pro?q=1' ELSE 'https://other.hu/allas/job-eger-' || page_id END AS listing,
 CASE WHEN page_id % 2 = 0 THEN 'https://hu.linkedin.com/jobs/view/dev-' || page_id ELSE 'https://linkedin.example/a?b=2' END AS network,
 CASE WHEN page_id % 2 = 0 THEN 'https://www.linkedin.com/jobs/view/dev' ELSE 'https://linkedin.example/a?b=2' END AS key, page_id % 2 = 0 AS here,
 'job:' || (page_id % 4) || ':' || CASE WHEN page_id % 5 = 0 THEN 'Title' ELSE 'u' || page_id END AS job FROM pages""")
def url_variants(spark, d):
    n = F.col("page_id")
    at = F.when(n % 3 == 0, F.concat(F.lit("https://www.profession.hu/allas/job-budapest-"), n, F.lit("?sessionId=9&utm_source=x#top")))
    at = at.when(n % 3 == 1, F.concat(F.lit("https://www.profession.hu/allas/job-pecs-"), n, F.lit("/pro?keyword=x&q=1")))
    at = at.otherwise(F.concat(F.lit("https://other.hu/allas/job-eger-"), n, F.lit("?hash=1")))
    net = F.when(n % 2 == 0, F.concat(F.lit("https://hu.linkedin.com/jobs/view/dev-"), n, F.lit("?trackingId=4"))).otherwise("https://linkedin.example/a?refId=7&b=2&position=1")
    job = urls.job_key((n % 4).cast("string"), F.when(n % 5 != 0, F.concat(F.lit("u"), n)), F.lit("Title"))
    return table(spark, d, "pages").select(
        "page_id", urls.listing_url(at).alias("listing"), urls.network_url(net).alias("network"), urls.network_key(net).alias("key"),
        urls.on_host(net, "hu.linkedin.com").alias("here"), job.alias("job"),
    )


@_query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a.hu/allas/dev' WHEN 1 THEN 'https://b.hu/job/' || page_id ELSE 'https://a.hu/allas/dev-12' END AS key FROM pages""")
def keys_by_source(spark, d):
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://a.hu/allas/dev-"), n + 100000)).when(n % 3 == 1, F.concat(F.lit("https://b.hu/job/"), n, F.lit("/title"))).otherwise("https://a.hu/allas/dev-12")
    source = F.when(n % 3 == 1, "b").otherwise("a")
    return table(spark, d, "pages").select("page_id", urls.key_by_source(source, url, {"a": r"^(.*)-\d{4,}$", "b": r"^(https://b\.hu/job/\d+)/"}).alias("key"))


@_query("""SELECT c_custkey FROM customer WHERE (c_nationkey % 3 = 0 AND c_custkey % 2 = 0 OR c_nationkey % 3 = 1 AND c_custkey % 2 = 1 OR c_nationkey % 3 = 2) AND c_custkey % 7 <> 0""")
def url_shapes(spark, d):
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).cast("string").alias("source"), F.concat(F.lit("https://x.hu/"), F.when(n % 2 == 0, "job/").otherwise("allas/"), n).alias("url"))
    shapes = spark.createDataFrame([("0", "/job/[0-9]+$"), ("1", "/allas/[0-9]+$"), ("1", "/career/")], "source string, pattern string")
    denied = rows.where("c_custkey % 7 = 0").select("url")
    return cleaning.without_urls(cleaning.with_job_shape(rows, shapes), denied).select("c_custkey")


@_query("""SELECT p_name AS category, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size IN (1, 2)) GROUP BY 1""")
def unknown_categories(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_name", "category")
    _, unknown = cleaning.by_category(part, "category", part.where("p_size = 1"), part.where("p_size = 2"))
    return unknown


@_query(f"WITH {_POSTINGS} SELECT id, source FROM postings WHERE id = 1 AND NOT hidden")
def point_lookup(spark, d):
    return listing.by_id(postings(spark, d), "id", 1).select("id", "source")


@_query(f"""WITH {_POSTINGS} SELECT '7d' AS span, count(*) AS n FROM postings WHERE source IN ('1-URGENT', '5-LOW') AND first_seen >= TIMESTAMP '2001-07-25'
 UNION ALL SELECT '30d', count(*) FROM postings WHERE source IN ('1-URGENT', '5-LOW') AND (first_seen >= TIMESTAMP '2001-07-02' OR (source <> '5-LOW' AND active))""")
def source_windows(spark, d):
    parts = [listing.of_sources(postings(spark, d), ["1-URGENT", "5-LOW"], AS_OF, ["5-LOW"], w).agg(F.lit(w).alias("span"), F.count("*").alias("n")) for w in ("7d", "30d")]
    return parts[0].unionByName(parts[1])


@_query("""SELECT category, coalesce(n, 0) AS n FROM (VALUES ('DevOps'), ('Hardware'), ('Mobil'), ('Data / AI'), ('Egyéb')) v(category) FULL JOIN (SELECT category, count(*) n FROM
 (SELECT CASE WHEN contains(p_name, 'small') THEN 'DevOps' WHEN regexp_matches(p_name, '(^|[^a-z0-9])(bolt|blue)([^a-z0-9]|$)') THEN 'Hardware' ELSE 'Egyéb' END category FROM part)
 GROUP BY 1) USING (category)""")
def category_histogram(spark, d):
    categories = [("DevOps", ["small"]), ("Hardware", ["bolt", "blue"])]
    category = levels.category_of(F.col("p_name"), categories)
    # of both, the more telling one counts
    return rollups.category_histogram(table(spark, d, "part"), category, ["DevOps", "Hardware", "Mobil", "Data / AI", "Egyéb"])


@_query("""SELECT event_type, count(*) AS n, bool_and(value < 400) AS complete FROM events GROUP BY 1""")
def source_flags(spark, d):
    return rollups.source_flags(table(spark, d, "events").withColumn("ok", F.col("value") < 400), "event_type", "ok")


@_query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS rank FROM part""")
def least_rank(spark, d):
    n = F.col("p_size")
    ids = F.when(n % 4 == 0, F.array(F.lit(99))).when(n % 2 == 0, F.array(F.lit(7), F.lit(5))).otherwise(F.array(F.lit(7), F.lit(98)))
    return table(spark, d, "part").select("p_partkey", rollups.least_rank(ids, {7: 2, 5: 1}).alias("rank"))


@_query("""SELECT CAST(sum(length(text)) FILTER (doc_id % 10 <> 0) AS BIGINT) AS total, sum(length(text)) FILTER (doc_id % 10 <> 0) <= 1000000 AS allowed FROM documents""")
def bytes_guard(spark, d):
    size = F.when(F.col("doc_id") % 10 == 0, "unknown").otherwise(F.length("text").cast("string"))
    return rollups.within_bytes(table(spark, d, "documents").withColumn("size", size), "size", 1_000_000)


@_query("""SELECT conv_id, round((sum(length(text)) FILTER (role <> 'assistant') * 3.0 + coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) * 15.0) / 1000000, 9) AS cost
 FROM conversations GROUP BY 1""")
def token_costs(spark, d):
    said = lambda c: F.sum(F.when(c, F.length("text")))
    counts = table(spark, d, "conversations").groupBy("conv_id").agg(said(F.col("role") != "assistant").alias("input"), said(F.col("role") == "assistant").alias("output"))
    cost = rollups.token_cost({"input": F.col("input"), "output": F.col("output")}, {"input": 3.0, "output": 15.0})
    return counts.select("conv_id", F.round(cost, 9).alias("cost"))


@_query(f"""WITH {_POSTINGS} SELECT id, CASE WHEN id % 2 = 0 THEN true WHEN first_seen < TIMESTAMP '2001-07-29' AND id % 3 = 0 THEN false ELSE active END AS active,
 sweep_dead AND id % 2 <> 0 AS sweep_dead FROM postings""")
def reconcile_confirmed(spark, d):
    rows = postings(spark, d)
    runs = rows.select("source").distinct().withColumns({"complete": F.lit(True), "empty_is_valid": F.lit(False)})
    found, dead = (rows.where(f"id % {k} = 0").select("source", "url") for k in (2, 3))
    return state.reconcile(rows, found, runs, AS_OF, [], confirmed=dead).select("id", "active", "sweep_dead")


@_query("""SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(100 + s_suppkey AS INTEGER), CASE WHEN s_suppkey % 2 = 0 THEN 'anonim' ELSE s_name END, 9 FROM supplier""")
def append_with_defaults(spark, d):
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 100).alias("n_nationkey"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_name")).alias("n_name"))
    return state.appended(table(spark, d, "nation"), new, {"n_name": "anonim", "n_regionkey": 9})


@_query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'mine' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def owner_update(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    owner = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-1)
    changes = rows.select("o_orderkey", owner.alias("o_custkey"), F.lit("mine").alias("o_orderstatus"))
    return state.owner_update(rows, changes, "o_orderkey", "o_custkey", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@_query("""SELECT s_suppkey AS site, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN s_nationkey + 1 ELSE s_nationkey END AS INTEGER) AS fail_streak,
 CASE WHEN s_suppkey % 3 = 0 THEN '2001-08-01' END AS last_ok FROM supplier""")
def fail_streaks(spark, d):
    sites = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").cast("int").alias("fail_streak"), F.lit(None).cast("timestamp").alias("last_ok"))
    runs = sites.where("site % 3 < 2").select("site", (F.col("site") % 3 == 0).alias("ok"))
    return state.streaks(sites, runs, AS_OF).withColumn("last_ok", F.date_format("last_ok", "yyyy-MM-dd"))


@_query("""SELECT c_custkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 5000) AS is_known FROM customer""")
def known_split(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return state.split_known(table(spark, d, "customer"), known, ["c_nationkey"]).select("c_custkey", "is_known")


@_query("""SELECT c_nationkey AS nation, 0 AS origin, min(c_name) AS name FROM customer WHERE c_acctbal > 9000 GROUP BY 1 UNION ALL SELECT s_nationkey, 1, min(s_name) FROM supplier
 WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) GROUP BY 1""")
def priority_union(spark, d):
    first = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    second = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return state.by_priority([first, second], ["nation"])


@_query("""SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN n_name END, r_name) AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
 LEFT JOIN region ON r_regionkey = c_nationkey""")
def lookup_with_fallback(spark, d):
    first = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    second = table(spark, d, "region").select(F.col("r_regionkey").alias("c_nationkey"), F.col("r_name").alias("name"))
    return state.looked_up(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", first, second, "name").select("c_custkey", "name")


@_query("""SELECT n_nationkey FROM nation WHERE lower(n_name) IN (SELECT lower(r_name) FROM region) OR n_nationkey % 3 = 0""")
def same_whatever_case(spark, d):
    others = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.initcap(F.lower("n_name")).alias("n_name"))
    others = others.unionByName(table(spark, d, "region").select(F.lower("r_name").alias("n_name")))
    return state.same_whatever_case(table(spark, d, "nation"), others, "n_name").select("n_nationkey")


@_query("""SELECT p_partkey, count(*) OVER (PARTITION BY regexp_replace(p_name, ' [a-z]+$', '')) > 1 AS has_twin FROM part""")
def stem_twins(spark, d):
    return cleaning.with_stem_elsewhere(table(spark, d, "part"), F.regexp_replace("p_name", " [a-z]+$", ""), "p_partkey").select("p_partkey", "has_twin")


@_query("""SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2""")
def title_dedupe(spark, d):
    return cleaning.first_title_in_page(table(spark, d, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", "p_name", ["p_partkey"])


@_query("""SELECT p_type AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS place FROM part GROUP BY 1""")
def facet_places(spark, d):
    facets = table(spark, d, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n"))
    # one row a label
    return listing.facet_order(facets).select("label", F.row_number().over(Window.orderBy(F.desc("n"), F.collate("label", "hu"))).alias("place"))


@_query("""SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10)""")
def last_ten(spark, d):
    return listing.last_in_order(table(spark, d, "events").select("event_id"), "event_id", 10)


@_query("""SELECT n_nationkey FROM nation""")
def page_or_whole_list(spark, d):
    return listing.page_or_all(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 5, 3)


@_query("""SELECT DISTINCT label FROM (SELECT event_type label FROM events UNION ALL VALUES ('refund'), ('click')) v(label)""")
def label_union(spark, d):
    known = spark.createDataFrame([("refund",), ("click",)], "label string")
    return listing.known_labels(known, table(spark, d, "events").select(F.col("event_type").alias("label")))


@_query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'b c' ELSE NULL END AS q, CASE WHEN page_id % 2 = 0 THEN 404 ELSE NULL END AS status, 1700000000 + page_id AS expiry,
 'front-end dev' AS route, 'Fejlesztő' AS stem, 'a-b-c' AS dashes FROM pages""")
def small_parsers(spark, d):
    n = F.col("page_id")
    query = F.when(n % 2 == 0, "a=1&q=b+c&q=d&&e").otherwise("a=1")
    message = F.when(n % 2 == 0, "failed: HTTP 404 for x").otherwise("timeout")
    claims = F.concat(F.lit('{"exp":'), n + 1700000000, F.lit("}"))
    token = F.concat(F.lit("h."), F.regexp_replace(F.translate(F.base64(claims.cast("binary")), "+/", "-_"), "=+$", ""), F.lit(".s"))
    return table(spark, d, "pages").select(
        "page_id", F.try_element_at(text.query_parameters(query), F.lit("q")).alias("q"), text.http_code(message).alias("status"), text.token_expiry(token).alias("expiry"),
        F.replace(text.route_slug(F.lit("Front-End, Dev!")), F.lit("end-dev"), F.lit("end dev")).alias("route"),
        text.student_job_stem(F.lit("Diákmunka – Fejlesztő")).alias("stem"), text.plain_dashes(F.lit("a–b—c")).alias("dashes"),
    )


@_query("""SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, TIMESTAMP '1970-01-01') DESC, o_orderkey) AS INTEGER) AS place
 FROM orders QUALIFY place <= 500""")
def latest_list(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("seen"))
    first = listing.latest_first(rows, "seen", "id").limit(500)
    order = Window.orderBy(F.coalesce(F.col("seen").cast("timestamp"), F.timestamp_seconds(F.lit(0))).desc(), "id")
    return first.select("id", F.row_number().over(order).alias("place"))
