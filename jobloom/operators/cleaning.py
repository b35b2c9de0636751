"""Candidates before they are stored: validation, dedupe, denylists and gates, with the reason of each refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.functions.text import company_key, has_keyword, normalize_text, normalize_whitespace
from jobloom.functions.urls import canonical_url

#: Longest values that are kept, and the shortest title.
MOST = {"title": 300, "company": 200, "description": 800, "experience": 100}
LEAST_TITLE = 3


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of arrival."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_by_url(rows: DataFrame, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """First row of each canonical url, which replaces the url; with `by`, of each in such a group."""
    return first_per_key(rows.withColumn("url", canonical_url(F.col("url"))), [*(by or []), "url"], [order])


def sanitized(rows: DataFrame) -> DataFrame:
    """Rows with a title and an http(s) url, values cut to MOST."""
    out = rows.withColumn("url", canonical_url(F.col("url"), http_only=True, else_null=True, keep_fragment=True))
    for name, most in MOST.items():
        if name in rows.columns:
            out = out.withColumn(name, F.substring(normalize_whitespace(F.col(name)), 1, most))
    return out.where(F.col("url").isNotNull() & (F.length("title") >= LEAST_TITLE))


def present_in(rows: DataFrame, pages: DataFrame, page_key: str) -> DataFrame:
    """Rows whose url or path stands in the html they were read from."""
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]+([^?#]*)", 1)
    joined = rows.join(pages.select(page_key, "html"), page_key)
    return joined.where(F.col("html").contains(F.col("url")) | ((path != "") & F.col("html").contains(path))).select(rows.columns)


def denied(title: Column, words: list[str]) -> Column:
    """Whether a word of the list stands in the title, both without accents."""
    return has_keyword(normalize_text(title), words) if words else F.lit(False)


def without_blocked(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose company is not blocked for their source (blocked: source, company); a null company passes."""
    names = blocked.select("source", normalize_text(F.col("company")).alias("_company")).distinct()
    keyed = rows.withColumn("_company", F.when(F.col("company").isNotNull(), normalize_text(F.col("company"))))
    return keyed.join(names, ["source", "_company"], "left_anti").select(rows.columns)


def posting_key(company: Column, title: Column) -> Column:
    """What one posting has in common over sources."""
    return F.concat_ws("|", company_key(company), normalize_text(title))


def listed_elsewhere(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose posting_key() no row of another source has."""
    known = others.select(posting_key(F.col("company"), F.col("title")).alias("_key"), F.col("source").alias("_source")).distinct()
    keyed = rows.withColumn("_key", posting_key(F.col("company"), F.col("title")))
    return keyed.join(known, (keyed["_key"] == known["_key"]) & (keyed["source"] != known["_source"]), "left_anti").select(rows.columns)


def reasons(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with reason: the first rule that refuses the row, null if none does."""
    return rows.withColumn("reason", F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules], F.lit(None).cast("string")))


def with_job_shape(rows: DataFrame, shapes: DataFrame, source: str = "source", url: str = "url") -> DataFrame:
    """Rows whose url has a shape (source, pattern) of its source; sources without a shape pass. shapes is a small dimension."""
    known = shapes.groupBy(source).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("(?:"), "pattern", F.lit(")")))), "|").alias("_shape"))
    joined = rows.join(known, source, "left")
    return joined.where(F.col("_shape").isNull() | F.expr(f"`{url}` rlike _shape")).drop("_shape")


def without_urls(rows: DataFrame, denied: DataFrame, url: str = "url") -> DataFrame:
    return rows.join(denied.select(url), url, "left_anti")


def by_category(rows: DataFrame, category: str, allowed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of allowed categories, and the categories among the others that nobody knows, with their number of rows.

    allowed and known have the one column category. A row without a category is of none.
    """
    kept = rows.join(allowed.select(category), category, "left_semi")
    counts = rows.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    return kept, counts.join(allowed.select(category).unionByName(known.select(category)), category, "left_anti")


def first_title_in_page(rows: DataFrame, page: str, title: str, order: list[str]) -> DataFrame:
    """One row for each title of a page, the first."""
    return first_per_key(rows, [page, title], order)


def with_stem_elsewhere(rows: DataFrame, stem: Column, key: str) -> DataFrame:
    """Rows with has_twin: whether another row has the same stem."""
    stems = rows.groupBy(stem.alias("_stem")).agg(F.count_distinct(key).alias("_n"))
    joined = rows.withColumn("_stem", stem).join(stems, "_stem")
    return joined.withColumn("has_twin", F.col("_n") > 1).drop("_stem", "_n")
