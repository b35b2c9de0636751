"""Addresses against the standard library's: dots, ports and relative links."""

from __future__ import annotations

import itertools
from urllib.parse import urljoin

from pyspark.sql import functions as F

from jobloom.functions import urls


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_relative_links(spark):
    bases = ["http://a/b/c/d;p?q", "https://x.hu", "https://x.hu/", "http://x.hu:8080/a/b/?q=/../#f", "https://u:p@x.hu/a/b"]
    links = [
        "g", "./g", "g/", "/g", "//g/x", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g",
        "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/./x", "g#s/../x", "https://z.hu/a/b?c#d", "HTTP://Z.hu", "a:b", "/a//b/../c", "é/ű",
    ]
    rows = spark.createDataFrame(list(itertools.product(bases, links)), "base string, link string")
    special = {"a:b"}

    def wanted(base, link):
        if link in special:
            return link
        # an empty link leaves the fragment out, a host alone has the root as its path, and schemes and hosts are in lower case
        out = urljoin(base, link) if link else base.split("#")[0]
        head, _, tail = out.partition("://")
        host, slash, path = tail.partition("/")
        return f"{head.lower()}://{host.lower()}/{path}" if slash else f"{head.lower()}://{host.lower().split('?')[0].split('#')[0]}/{tail[len(host.split('?')[0].split('#')[0]) :]}"

    got = {(r["base"], r["link"]): r["out"] for r in rows.select("*", urls.resolved_url(F.col("base"), F.col("link")).alias("out")).collect()}
    assert [(k, v, wanted(*k)) for k, v in got.items() if v != wanted(*k)] == []


def test_odd_links(spark):
    link = lambda base, x: urls.resolved_url(F.lit(base), F.lit(x))
    assert _one(spark, link("no url", "x"), link("no url", "https://a.hu:443/%2e%2E/b/%2e"), link("https://a.hu/x/", "  y \n"), link("https://a.hu/x/", "a\nb"), link(None, "x"), link("https://a.hu", None)) == (
        None, "https://a.hu/b/", "https://a.hu/x/y", "https://a.hu/x/ab", None, None,
    )
    # an empty segment is one
    assert _one(spark, link("https://a.hu/a//b", "../g"), link("https://a.hu/a//b", "g"), link("https://a.hu", "//b.hu//c/..")) == ("https://a.hu/a/g", "https://a.hu/a//g", "https://b.hu//")
    assert _one(spark, link("https://a.hu/x", "javascript:void(0)"), link("http://a.hu:80/", "b"), link("http://a.hu:443/", "b"), link("https://a.hu:/q", "b")) == ("javascript:void(0)", "http://a.hu/b", "http://a.hu:443/b", "https://a.hu/b")


def test_canonical_addresses(spark):
    c = lambda x, **how: urls.canonical_url(F.lit(x), **how)
    assert _one(spark, c("https://X.hu:443/a/../b?utm_source=1&q=..#f"), c("http://x.hu:80"), c("https://x.hu/a/b/./"), c("../a"), c("../a", else_null=True), c("ftp://x.hu/a/..", http_only=True)) == (
        "https://x.hu/b?q=..", "http://x.hu/", "https://x.hu/a/b/", "../a", None, "ftp://x.hu/a/..",
    )
    assert _one(spark, c("https://x.hu/a?b#c", keep_fragment=True), c(None), c(""), c("ftp://x.hu/a/..", http_only=True, else_null=True)) == ("https://x.hu/a?b#c", None, "", None)
    parts = _one(spark, urls.url_parts(F.lit("HTTPS://u@X.hu:1/a?b#c")), urls.url_parts(F.lit("a/b")), urls.without_dots(F.lit("/../a/./b/..")))
    assert (tuple(parts[0]), tuple(parts[1]), parts[2]) == (("https", "u@x.hu:1", "/a", "?b", "#c"), ("", "", "a/b", "", ""), "/a/")
