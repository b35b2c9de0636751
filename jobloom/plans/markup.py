"""Pages of a known form around each page's id and address, with names of parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.sources.tables import table

_HOST = "lower(regexp_extract(url, '^(https?://[^/]+)', 1))"
#: Pages with a part and a customer; both have more than so many rows.
_NAMES = 150
_NAMED = f"pages JOIN part ON p_partkey = page_id % {_NAMES} JOIN customer ON c_custkey = page_id % {_NAMES}"


def _pages(spark, d, markup: str):
    """pages with html in place of their own: a text in which # is the page's id, @ the name of a part and $ that of a customer."""
    part, customer = table(spark, d, "part").select(F.col("p_partkey").alias("_n"), "p_name"), table(spark, d, "customer").select(F.col("c_custkey").alias("_n"), "c_name")
    named = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % _NAMES).alias("_n")).join(part, "_n").join(customer, "_n")
    html_ = F.lit(markup)
    for mark, value in (("#", F.col("page_id").cast("string")), ("@", F.col("p_name")), ("$", F.col("c_name"))):
        html_ = F.replace(html_, F.lit(mark), value)
    return named.select("page_id", "url", html_.alias("html"))
