"""Queries of limits with busy keys, keywords, chains, trees and documents, each with the SQL that must give its rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions import documents, levels, text, urls
from jobloom.operators import links, listing, paging, records, rollups
from jobloom.plans import snapshots
from jobloom.plans.queries import _POSTINGS, _query, postings
from jobloom.sources import landed
from jobloom.sources.tables import table
from jobloom.streaming import liveness


@_query("""SELECT event_id, count(*) OVER w AS hits, count(*) OVER w <= 30 AS allowed, CASE WHEN count(*) OVER w > 30
 THEN CAST(ceil((min(t) OVER w + 3600000000 - t) / 1000000.0) AS BIGINT) END AS retry_after FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN user_id ELSE -1 END k, epoch_us(ts) t FROM events)
 WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")
def rate_limit_busy_key(spark, d):
    busy = F.when(F.col("event_id") % 10 == 0, F.col("user_id")).otherwise(-1)
    return rollups.sliding_limit(table(spark, d, "events").withColumn("key", busy), "key", "ts", 30, 3600).select("event_id", "hits", "allowed", "retry_after")


@_query(f"""WITH {_POSTINGS}, a AS (SELECT * EXCLUDE (active, sweep_dead), CASE WHEN id % 2 = 0 AND NOT (source = '2-HIGH' AND sweep_dead) THEN true
 WHEN id % 2 = 1 AND first_seen < TIMESTAMP '2001-07-17' THEN false ELSE active END AS active,
 sweep_dead AND NOT (id % 2 = 0 AND source <> '2-HIGH') AS sweep_dead FROM postings),
 b AS (SELECT * EXCLUDE (active, sweep_dead), CASE WHEN NOT ran THEN active WHEN id % 3 = 0 AND NOT (source = '2-HIGH' AND sweep_dead) THEN true
 WHEN id % 3 <> 0 AND first_seen < TIMESTAMP '2001-07-29' THEN false ELSE active END AS active,
 sweep_dead AND NOT (ran AND id % 3 = 0 AND NOT (source = '2-HIGH' AND sweep_dead)) AS sweep_dead FROM (SELECT *, source IN ('1-URGENT', '2-HIGH') AS ran FROM a
 WHERE NOT (source = '5-LOW' AND first_seen < TIMESTAMP '2001-06-20' OR NOT active AND first_seen < TIMESTAMP '2001-05-21'))),
 c AS (SELECT * EXCLUDE (active, sweep_dead), active AND id % 5 <> 0 AS active, sweep_dead OR active AND id % 5 = 0 AS sweep_dead FROM b)
 SELECT id, active, sweep_dead FROM c WHERE NOT (source = '5-LOW' AND first_seen < TIMESTAMP '2001-07-02' OR NOT active AND first_seen < TIMESTAMP '2001-06-02')""")
def liveness_stream(spark, d):
    """Two landings of crawls, of found postings, runs and probes; its snapshots stay in a folder of their own in the shared one."""
    root, rows = snapshots.new_root(spark, "liveness"), postings(spark, d)
    snapshots.commit(rows, root, "postings")
    flags = [F.lit(True).alias(c) for c in ("complete", "empty_is_valid", "dead1", "dead2")]
    change = lambda df, kind, at: df.select(F.lit(kind).alias("kind"), "source", "url", *flags, F.lit(at).cast("timestamp").alias("at"))
    runs = rows.select("source", F.lit(None).cast("string").alias("url")).distinct()
    first = change(rows.where("id % 2 = 0"), "found", "2001-07-20").unionByName(change(runs, "run", "2001-07-20"))
    second = change(rows.where("id % 3 = 0"), "found", "2001-08-01").unionByName(change(runs.where("source IN ('1-URGENT', '2-HIGH')"), "run", "2001-08-01"))
    second = second.unionByName(change(rows.where("id % 5 = 0"), "probe", "2001-08-01"))
    for landing in (first, second):
        landing.write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(liveness.CHANGES).parquet(f"{root}/landed")
        query = liveness.follow(stream, "crawls", root, "postings", liveness.liveness(["2-HIGH"]), f"{root}/checkpoint", liveness.archived(["5-LOW"]))
        query.awaitTermination()
    return snapshots.current(spark, root, "postings").select("id", "active", "sweep_dead")


#: Keywords of two words each in keyword_phrases.
PHRASES = 376


@_query(f"""WITH t AS (SELECT doc_id, lower(text) t FROM documents),
 k AS (SELECT k, count(*) n FROM (SELECT unnest(regexp_extract_all(t, '[a-z]{{2,}} [a-z]{{2,}}')) k FROM t) GROUP BY 1 ORDER BY n DESC, k LIMIT {PHRASES})
 SELECT upper(k) AS label, count(*) AS n FROM k JOIN t ON contains(t, k) AND regexp_matches(t, '(^|[^a-z0-9])' || k || '([^a-z0-9]|$|[0-9])') GROUP BY 1""")
def keyword_phrases(spark, d):
    docs = table(spark, d, "documents").select("text")
    pairs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,} [a-z]{2,}"), F.lit(0))).alias("k"))
    most = pairs.groupBy("k").count().orderBy(F.desc("count"), "k").limit(PHRASES)
    dictionary = [(r["k"], r["k"].upper()) for r in most.collect()]
    return listing.facet_counts(docs.select(text.labels_array(F.col("text"), dictionary).alias("technologies")), "technologies")


#: Keywords of other shapes than a word, two of them for one label.
_LISTED = [("c++", "C++"), ("node.js", "Node.js"), (".net", ".NET"), ("anodized tin", "Tin"), ("tin", "Tin"), ("small", "Small"), ("brand#1", "Brand 1"), ("c#", "C#")]
_LISTED_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(x), '(^|[^a-z0-9]){k.replace('+', chr(92) + '+').replace('.', chr(92) + '.')}([^a-z0-9]|$|[0-9])') THEN '{label}' END" for k, label in _LISTED)
_LISTED_ITEMS = "p_name || ', ' || p_type || ', ' || p_brand || CASE p_size % 5 WHEN 0 THEN ', C++11, Node.JS' WHEN 1 THEN ', ASP.NET' WHEN 2 THEN ', .Net 8/c#' WHEN 3 THEN ', cc++, node js' ELSE '' END"


@_query(f"""SELECT p_partkey, nullif(array_to_string(list_distinct_ordered, ', '), '') AS labels FROM (SELECT p_partkey,
 list_filter([{_LISTED_SQL}], lambda l, i: l IS NOT NULL AND list_position([{_LISTED_SQL}], l) = i) AS list_distinct_ordered FROM (SELECT p_partkey, {_LISTED_ITEMS} x FROM part))""")
def canonical_list(spark, d):
    return table(spark, d, "part").select("p_partkey", text.canonical_labels(F.expr(_LISTED_ITEMS), _LISTED).alias("labels"))


#: A crawl by cursor for each user: pages are events in order of time; of users whose number is divisible by 5 one page is missing, by 7 the last leads back to the first.
_CURSORS = """e AS (SELECT user_id, event_id, row_number() OVER w - 1 place, lead(event_id) OVER w next_id, count(*) OVER (PARTITION BY user_id) stated,
 first_value(event_id) OVER w first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 p AS (SELECT *, user_id % 5 = 0 AND place = 2 missing FROM e),
 r AS (SELECT *, bool_or(missing) OVER (PARTITION BY user_id ORDER BY place) cut FROM p)"""


def _cursors(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cursor = lambda c: F.md5(F.concat_ws(":", "user_id", c))
    rows = table(spark, d, "events").select("user_id", "event_id", "ts").withColumns({"place": F.row_number().over(order) - 1, "next_id": F.lead("event_id").over(order), "second": F.nth_value("event_id", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = rows.where("NOT (user_id % 5 = 0 AND place = 2)").withColumn("stated", F.count("*").over(Window.partitionBy("user_id")))
    back = F.when(F.col("user_id") % 7 == 0, cursor("second"))
    return rows.select("user_id", "event_id", F.when(F.col("place") > 0, cursor("event_id")).alias("cursor"), F.coalesce(F.when(F.col("next_id").isNotNull(), cursor("next_id")), F.when(F.col("second").isNotNull(), back)).alias("next"), F.lit(1).alias("cards"), "stated")


@_query(f"""WITH {_CURSORS} SELECT event_id, CASE WHEN NOT cut THEN place END AS place FROM r WHERE NOT missing""")
def cursor_places(spark, d):
    return links.cursor_pages(_cursors(spark, d), ["user_id"]).select("event_id", "place")


@_query(f"""WITH {_CURSORS}, n AS (SELECT user_id, count(*) FILTER (NOT cut) AS n_pages, bool_or(missing) gap, count(*) FILTER (NOT missing) total FROM r GROUP BY 1)
 SELECT user_id, n_pages, n_pages AS cards, CASE WHEN gap THEN 'gap' WHEN user_id % 7 = 0 AND total > 1 THEN 'cycle' ELSE 'end' END AS ending,
 NOT gap AND NOT (user_id % 7 = 0 AND total > 1) AS complete FROM n""")
def cursor_crawls(spark, d):
    return links.cursor_runs(_cursors(spark, d), ["user_id"])


@_query("""WITH RECURSIVE n AS (SELECT o_orderkey id, CASE WHEN o_orderkey % 64 <> 0 THEN o_orderkey - 1 END parent FROM orders),
 w AS (SELECT id, id AS root, 0 AS depth, parent IS NULL AS rooted FROM n WHERE parent IS NULL OR parent NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT n.id, w.root, w.depth + 1, w.rooted FROM n JOIN w ON n.parent = w.id) SELECT id, root, depth, CASE WHEN rooted THEN 'node' ELSE 'orphan' END AS kind FROM w""")
def deep_forest(spark, d):
    key = F.col("o_orderkey")
    nodes = table(spark, d, "orders").select(key.alias("id"), F.when(key % 64 != 0, key - 1).alias("parent"), F.col("o_orderstatus").alias("name"))
    return links.tree_nodes(nodes, paths=False)


@_query("""SELECT p_partkey, lower(strip_accents(chr(CAST(192 + p_partkey % 384 AS INTEGER)) || p_name || chr(CAST(7680 + p_partkey % 256 AS INTEGER)))) AS folded,
 nfc_normalize(p_name || ' ' || chr(CAST(97 + p_partkey % 26 AS INTEGER)) || chr(CAST(768 + p_size % 13 AS INTEGER)) || CASE WHEN p_partkey % 3 = 0 THEN chr(803) ELSE '' END) AS composed FROM part""")
def letters_and_marks(spark, d):
    n, chr_ = F.col("p_partkey"), lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
    accented = F.concat(chr_(n % 384 + 192), F.col("p_name"), chr_(n % 256 + 7680))
    marked = F.concat(F.col("p_name"), F.lit("  "), chr_(n % 26 + 97), chr_(F.col("p_size") % 13 + 768), F.when(n % 3 == 0, "̣").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.lower(text.strip_accents(accented)).alias("folded"), text.normalize_name(marked).alias("composed"))


@_query("""SELECT c_custkey, '{"a":"' || c_name || '","b":{' || CASE WHEN c_custkey % 2 = 1 THEN '"deep":{"k":"' || c_mktsegment || '","l":"old"},' ELSE '' END
 || '"x":' || c_nationkey || ',"y":' || CASE WHEN c_custkey % 3 = 0 THEN '[1,2]' ELSE '{"z":true}' END || CASE WHEN c_custkey % 2 = 0 THEN '},"c":null}' ELSE '}}' END AS merged,
 c_custkey % 4 <> 3 AS same, c_custkey % 5 IN (0, 1, 2) AS is_empty, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS k FROM customer""")
def json_documents(spark, d):
    n, name = F.col("c_custkey"), lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    odd = F.when(n % 2 == 1, F.concat(F.lit(', "deep": {"l": "old", "k": "x"}'))).otherwise("")
    old = F.concat(F.lit('{"b": {"x": '), "c_nationkey", F.lit(', "y": 0'), odd, F.lit('}, "a": "old"}'))
    deep = F.when(n % 2 == 1, F.concat(F.lit(', "deep": { "k" :'), name(F.col("c_mktsegment")), F.lit("}}"))).otherwise('}, "c": null')
    new = F.concat(F.lit('{ "a" : '), name(F.col("c_name")), F.lit(',\n"b":{"y": '), F.when(n % 3 == 0, "[1, 2]").otherwise('{"z":true}'), deep, F.lit("}"))
    other = F.when(n % 4 == 0, ' { "q" : [1, {"b":2,"a":1}] , "p":1}').when(n % 4 == 3, '{"q":[{"a":1,"b":2},1],"p":1}').otherwise('{"p": 1, "q": [1, {"a": 1, "b": 2}]}')
    blank = F.when(n % 5 == 0, "{ }").when(n % 5 == 1, " []").when(n % 5 == 2, " ").when(n % 5 == 3, '{"a":{}}').otherwise("{broken")
    merged = documents.merged_json(old, new)
    return table(spark, d, "customer").select(
        "c_custkey", merged.alias("merged"), documents.same_json(other, F.lit('{"p":1,"q":[1,{"a":1,"b":2}]}')).alias("same"), documents.is_empty_json(blank).alias("is_empty"),
        documents.field(merged, "$.b.deep.k", "string").alias("k"),
    )


#: Crawls of 40 events a page, one for each residue of user_id by 25; how a crawl ends goes by the residue by 5.
_PAGED = """e AS (SELECT user_id % 25 AS crawl, count(*) n FROM events GROUP BY 1), p AS (SELECT crawl, n, CAST(ceil(n / 40) AS BIGINT) p FROM e),
 r AS (SELECT crawl, CASE WHEN crawl % 5 = 1 AND crawl % 2 = 0 AND p > 2 THEN 2 WHEN crawl % 5 = 4 AND crawl % 2 = 0 AND p > 1 THEN 1 ELSE p END AS n_pages, n, p FROM p)"""


@_query(f"""WITH {_PAGED} SELECT crawl, n_pages, CAST(least(n, n_pages * 40) AS BIGINT) AS items, CASE WHEN n_pages < p AND crawl % 5 = 4 THEN 'error' WHEN n_pages < p THEN 'gap'
 WHEN crawl % 5 = 2 AND n % 40 = 0 THEN 'empty' WHEN crawl % 5 = 3 THEN 'gone' ELSE 'end' END AS ending, n_pages = p AS complete FROM r""")
def paged_crawls(spark, d):
    """Crawls of five kinds, landed as files and walked by their rules; the files stay in a folder of their own in the shared one."""
    n, index = F.col("n"), F.col("index")
    events = table(spark, d, "events").select((F.col("user_id") % 25).alias("crawl"), "event_id")
    numbered = events.withColumn("at", F.row_number().over(Window.partitionBy("crawl").orderBy("event_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("crawl")))
    pages = numbered.groupBy("crawl", F.floor(F.col("at") / 40).alias("index")).agg(F.collect_list("event_id").alias("data"), F.max("n").alias("n"), F.lit(200).alias("status"))
    last = F.ceil(n / 40)
    beyond = pages.where(index + 1 == last).select("crawl", (index + 1).alias("index"), F.array().cast("array<bigint>").alias("data"), "n", F.when(F.col("crawl") % 5 == 3, 404).otherwise(200).alias("status"))
    kind, even = F.col("crawl") % 5, F.col("crawl") % 2 == 0
    pages = pages.unionByName(beyond).where(~((kind == 1) & even & (index == 2))).withColumn("status", F.when((kind == 4) & even & (index == 1), 500).otherwise(F.col("status")))
    # by page from 1, or by offset
    place = F.when(kind.isin(0, 4), index + 1).when(kind == 2, index).otherwise(index * 40)
    following = F.when(index + 1 < last, F.concat(F.lit("/list?page="), index + 2))
    body = F.to_json(F.struct("data", F.struct(F.when(kind == 0, last).alias("last_page"), F.when(kind == 1, n).alias("total")).alias("meta"), F.when(kind == 4, following).alias("next")))
    root = snapshots.new_root(spark, "landed")
    landed.land(pages.select(F.concat(F.lit("s"), "crawl").alias("source"), place.alias("place"), "status", body.alias("body")), root)

    read = landed.landed(spark, root).withColumn("page", F.from_json("body", "data array<long>, meta struct<last_page:long,total:long>, next string"))
    read = read.select(F.substring("source", 2, 9).cast("long").alias("crawl"), "place", "status", F.size("page.data").alias("items"), "page.meta.last_page", "page.meta.total", "page.next")
    read = read.withColumn("size", paging.first_of("items", ["crawl"]))
    rules = [
        (F.col("place") - 1, paging.by_last_page(F.col("place"), F.col("last_page"))), (F.col("place") / 40, paging.by_count(F.col("place"), F.lit(40), F.col("total"))),
        (F.col("place"), paging.by_size(F.col("items"), F.lit(40))), (F.col("place") / F.col("size"), F.lit(False)), (F.col("place") - 1, F.col("next").isNull()),
    ]
    runs = [paging.paged_runs(read.where(F.col("crawl") % 5 == k), ["crawl"], at, ends, total="total") for k, (at, ends) in enumerate(rules)]
    return functools.reduce(DataFrame.unionByName, runs)


@_query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://shop.example/jobs/item-' || page_id WHEN 1 THEN 'https://other.example:8443/x' WHEN 2 THEN 'https://shop.example/jobs/list/item-' || page_id || '?q=1#f'
 WHEN 3 THEN 'https://shop.example/jobs/list/' || page_id || '?page=2' WHEN 4 THEN 'https://shop.example/item-' || page_id || '/' WHEN 5 THEN 'mailto:a@b.example'
 WHEN 6 THEN 'https://shop.example/jobs/list/' || page_id || '?a=b' ELSE NULL END AS resolved,
 'https://shop.example/b/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/?q=..' ELSE '' END AS canonical FROM pages""")
def resolved_links(spark, d):
    n = F.col("page_id")
    base = F.when(n % 8 == 7, "no url").otherwise(F.concat(F.lit("HTTPS://Shop.example:443/jobs/list/"), n, F.lit("?a=b#top")))
    item = F.concat(F.lit("item-"), n)
    link = F.when(n % 8 == 0, F.concat(F.lit(" ../"), item)).when(n % 8 == 1, "//other.example:8443/y/../x").when(n % 8 == 2, F.concat(F.lit("./"), item, F.lit("?q=1#f"))).when(n % 8 == 3, "?page=2")
    link = link.when(n % 8 == 4, F.concat(F.lit("/a/%2E%2e/../"), item, F.lit("/z/.."))).when(n % 8 == 5, "mailto:a@b.example").when(n % 8 == 6, "").otherwise("/x")
    dotted = F.concat(F.lit("https://shop.example:443/a/./../b/"), n, F.when(n % 2 == 0, "/c/..?q=..&utm_source=x").otherwise("#x"))
    return table(spark, d, "pages").select("page_id", urls.resolved_url(base, link).alias("resolved"), urls.canonical_url(dotted).alias("canonical"))


_KINDS = ["DevOps", "Hardware", "Mobil", "Data / AI", "Egyéb"]


@_query("""SELECT category, n, CAST(row_number() OVER (ORDER BY n DESC, list_position(['DevOps', 'Hardware', 'Mobil', 'Data / AI', 'Egyéb'], category)) AS INTEGER) AS place FROM
 (SELECT CASE WHEN contains(p_name, 'small') THEN 'DevOps' WHEN regexp_matches(p_name, '(^|[^a-z0-9])(bolt|blue)([^a-z0-9]|$)') THEN 'Hardware' ELSE 'Egyéb' END category, count(*) n
 FROM part GROUP BY 1)""")
def category_ranking(spark, d):
    category = levels.category_of(F.col("p_name"), [("DevOps", ["small"]), ("Hardware", ["bolt", "blue"])])
    return rollups.ranked_histogram(table(spark, d, "part"), category, _KINDS)


@_query(f"""WITH {_POSTINGS} SELECT id FROM postings WHERE NOT (source IN ('1-URGENT') AND id % 3 = 0 AND first_seen < TIMESTAMP '2001-07-02')""")
def purge_by_list(spark, d):
    rows = postings(spark, d)
    return records.purge_listed(rows, rows.where("id % 3 = 0").select("url"), "1-", "2001-07-02").select("id")
