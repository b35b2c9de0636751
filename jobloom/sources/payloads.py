"""Payloads whose rows stand in other payloads: HTML in JSON, JSON in HTML, details beside lists, headings in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import normalize_text, normalize_whitespace, once, title_hash
from jobloom.functions.urls import canonical_url, resolved_url
from jobloom.sources.feeds import json_rows
from jobloom.sources.html import attribute, decoded, padded_text, text_of

_LD_BLOCK = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_NEXT_DATA = r'(?is)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>'
_HEAD = r"(?is)<h[45]\b[^>]*>(.*?)</h[45]\s*>"
# What a deadline's heading says, and what a closed one does, without accents.
DEADLINE = "jelentkezesi hatarido"
PAUSED = "szunetel"
#: Parts of an embedded profile that are its description.
PROFILE_PARTS = ["description", "requirements", "offer"]


def search_urls(shards: DataFrame, template: str) -> DataFrame:
    """shard, keyword, url of each distinct search of shards (shard, keyword); {} in the template is the encoded keyword."""
    return shards.select("shard", "keyword").distinct().withColumn("url", F.replace(F.lit(template), F.lit("{}"), F.url_encode("keyword")))


def with_details(rows: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns of their details by key; where a row has none, or null, its own value stays."""
    named = details.select(key, *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates([key])
    own = lambda c: [F.col(c)] if c in rows.columns else []
    joined = rows.join(named, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), *own(c)) for c in columns})
    return joined.drop(*[f"_{c}" for c in columns])


def with_terms(rows: DataFrame, ids: str, key: str, terms: DataFrame, into: str) -> DataFrame:
    """rows with the names of the terms (id, name) that the array `ids` names, in its order; unknown ids are left out."""
    said = rows.select(key, F.posexplode(ids).alias("_at", "id")).join(terms.select("id", "name"), "id")
    names = said.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "name")))["name"].alias(into))
    return rows.join(names, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def fragment_rows(pages: DataFrame, payload: str, total: str = "total") -> DataFrame:
    """Columns of pages but payload, and url, title, total for each row of a payload {rows: [{url, row}], total}; row is HTML.

    Rows without url are left out, and of one url the first of a payload counts.
    """
    rest = [c for c in pages.columns if c != payload]
    rows = json_rows(F.col(payload), "struct<url:string,row:string>", "rows")
    stated = F.get_json_object(payload, f"$.{total}").try_cast("long").alias("total")
    out = pages.select(*rest, stated, F.posexplode(F.filter(rows, lambda r: r["url"].isNotNull())).alias("_at", "_r"), F.transform(rows, lambda r: r["url"]).alias("_urls"))
    first = F.array_position(F.filter("_urls", lambda u: u.isNotNull()), F.col("_r.url")) == F.col("_at") + 1
    return out.where(first).select(*rest, F.col("_r.url").alias("url"), text_of(F.col("_r.row")).alias("title"), "total")


def in_envelope(pages: DataFrame, payload: str, name: str) -> DataFrame:
    """page_id, url, html of pages whose HTML is a member of a JSON payload, such as {view: html}; what is no such JSON has a null html."""
    return pages.select("page_id", "url", F.get_json_object(payload, f"$.{name}").alias("html"))


def attribute_links(pages: DataFrame, name: str, pattern: str) -> DataFrame:
    """page_id, url: the addresses, resolved against a page's url, that any tag's attribute names and a pattern finds, each once a page."""
    quoted = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    said = F.regexp_extract_all("html", F.lit(quoted), F.lit(0))
    value = lambda x: decoded(F.coalesce(F.nullif(F.regexp_extract(x, quoted, 1), F.lit("")), F.regexp_extract(x, quoted, 2)))
    links = F.transform(said, lambda x: once(once(value(x), lambda v: resolved_url(F.col("url"), v)), lambda u: canonical_url(u)))
    return pages.select("page_id", F.explode(F.array_distinct(F.filter(links, lambda x: x.rlike(pattern)))).alias("url"))


def page_props(html: Column, path: str) -> Column:
    """JSON at a path of the object that a page carries in its data-page attribute; null without one."""
    return F.get_json_object(attribute(html, r"\w+", "data-page"), f"$.{path}")


def headed_sections(pages: DataFrame) -> DataFrame:
    """page_id, title, url, section of each heading that a deadline's heading follows; section is the text down to the next title.

    Paused postings and repeats of a title on its page are left out. The url is the page's with the title's hash.
    """
    parts = F.split(F.concat(F.lit("\n"), F.coalesce("html", F.lit(""))), r"(?is)(?=<h[45]\b)", -1)
    rows = pages.select("page_id", "url", parts.alias("parts"))
    rows = rows.select("page_id", "url", F.slice("parts", F.lit(2), F.size("parts")).alias("chunks"))
    heads = F.transform("chunks", lambda c: normalize_whitespace(text_of(F.regexp_extract(c, _HEAD, 1))))
    rows = rows.withColumn("heads", heads).withColumn("deadline", F.transform("heads", lambda h: normalize_text(h).contains(DEADLINE)))
    rows = rows.select("*", F.posexplode("heads").alias("at", "title"))
    after = F.get("heads", F.col("at") + 1)
    own = (F.col("title") != "") & ~F.get("deadline", F.col("at")) & F.coalesce(F.get("deadline", F.col("at") + 1), F.lit(False))
    rows = rows.where(own & ~normalize_text(after).contains(PAUSED))
    next_title = F.array_position(F.slice("deadline", F.col("at") + 2, F.size("deadline")), False)
    n = F.when(next_title > 0, next_title).otherwise(F.size("chunks") - F.col("at")).cast("int")
    section = F.regexp_replace(F.array_join(F.slice("chunks", F.col("at") + 1, n), " "), r"(?is)^<h[45]\b[^>]*>.*?</h[45]\s*>", "")
    at = F.concat(F.regexp_replace("url", "/$", ""), F.lit("?"), title_hash(F.col("title")))
    rows = rows.select("page_id", "at", "title", at.alias("url"), padded_text(section).alias("section"))
    first = F.min_by(F.struct("url", "section"), "at").alias("first")
    return rows.groupBy("page_id", "title").agg(first).select("page_id", "title", "first.url", "first.section")


def _ld_nodes(html: Column) -> Column:
    """Objects of the JSON-LD blocks of a page, those of a @graph included, as JSON."""
    blocks = F.regexp_extract_all(html, F.lit(_LD_BLOCK), F.lit(1))
    graph = lambda node: F.from_json(F.get_json_object(node, "$['@graph']"), "array<string>")
    nodes = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.when(F.trim(b).startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b)), F.array().cast("array<string>"))))
    return F.flatten(F.transform(nodes, lambda n: F.coalesce(graph(n), F.array(n))))


def json_ld_location(html: Column) -> Column:
    """Town, region, post code and name of each place of the page's JSON-LD objects, joined by ' | '; '' without any."""
    address = "addressLocality:string,addressRegion:string,postalCode:string"
    places = lambda node: json_rows(F.get_json_object(node, "$.jobLocation"), f"struct<name:string,address:struct<{address}>>")
    parts = lambda p: F.array(p["address"]["addressLocality"], p["address"]["addressRegion"], p["address"]["postalCode"], p["name"])
    found = F.flatten(F.filter(F.transform(_ld_nodes(html), places), lambda x: x.isNotNull()))
    said = F.flatten(F.transform(F.filter(found, lambda p: p.isNotNull()), parts))
    return F.coalesce(F.array_join(F.filter(said, lambda x: x.isNotNull() & (x != "")), " | "), F.lit(""))


def labelled_value(html: Column, label: str) -> Column:
    """Text of what follows the heading (h3 to h5) that holds the label, both without accents; '' without one."""
    chunks = F.split(F.concat(F.lit("\n"), html), r"(?is)(?=<h[345]\b)", -1)
    head = lambda c: normalize_text(text_of(F.regexp_extract(c, r"(?is)^<h[345]\b[^>]*>(.*?)</h[345]\s*>", 1)))
    mine = F.get(F.filter(chunks, lambda c: head(c).contains(label)), F.lit(0))
    value = F.regexp_extract(mine, r"(?is)</h[345]\s*>\s*(<(\w+)\b[^>]*>.*?</\2\s*>|[^<]+)", 1)
    return F.coalesce(text_of(value), F.lit(""))


def embedded_profile(html: Column, tag: str = "job-profile", name: str = ":data") -> Column:
    """Text of the posting that an element carries as JSON in an attribute: PROFILE_PARTS and its skills; '' without any."""

    def said(data: Column) -> Column:
        skills = F.transform(F.from_json(F.get_json_object(data, "$.skills"), "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
        parts = F.concat(F.array(*[F.get_json_object(data, f"$.{p}") for p in PROFILE_PARTS]), F.coalesce(skills, F.array().cast("array<string>")))
        return F.coalesce(padded_text(F.array_join(F.filter(parts, lambda x: x != ""), " ")), F.lit(""))

    return once(attribute(html, tag, name), said)


def json_ld_description(html: Column) -> Column:
    """Text of the first job posting's description in JSON-LD; '' without any."""
    postings = F.filter(_ld_nodes(html), lambda n: (F.get_json_object(n, "$['@type']") == "JobPosting") & (F.get_json_object(n, "$.description") != ""))
    return F.coalesce(padded_text(F.get_json_object(F.get(postings, F.lit(0)), "$.description")), F.lit(""))


def next_data(html: Column, path: str) -> Column:
    """JSON at a path of the state that a page was rendered from; null without one."""
    return F.get_json_object(F.nullif(F.regexp_extract(html, _NEXT_DATA, 1), F.lit("")), f"$.{path}")
