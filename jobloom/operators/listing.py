"""The read side: visibility, liveness, time windows, counts, facets, pages and summaries of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from jobloom.functions.text import split_list

DEFAULT_LIMIT, MOST_ROWS = 500, 5000
# What a time window may be called.
WINDOWS = {"24h": 1, "1d": 1, "onlynew": 1, "7d": 7, "1w": 7, "week": 7, "30d": 30, "1m": 30, "month": 30}


def limit_of(value: str | None) -> int:
    """Rows of a listing: DEFAULT_LIMIT if absent, MOST_ROWS at most and for zero or what is no number."""
    if value is None:
        return DEFAULT_LIMIT
    try:
        return min(int(value) or MOST_ROWS, MOST_ROWS)
    except ValueError:
        return MOST_ROWS


def visible(hidden: Column, privileged: bool = False) -> Column:
    return F.lit(True) if privileged else ~F.coalesce(hidden, F.lit(False))


def within(ts: Column, as_of: str, window: str) -> Column:
    return ts >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {WINDOWS[window.lower()]} DAYS")


def alive(source: Column, active: Column, ts: Column, as_of: str, time_based: list[str]) -> Column:
    """Postings of time-based sources live 30 days; others while active, and 30 days in any case."""
    young = within(ts, as_of, "30d")
    return young | (~source.isin(*time_based) & active)


def newest(rows: DataFrame, ts: str, key: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return rows.orderBy(F.col(ts).desc_nulls_first(), F.col(key).desc_nulls_first()).limit(limit)


def counts_with_zeros(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """count of rows for each key of wanted (a small dimension), 0 where there are none."""
    return wanted.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def conditional_counts(rows: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def facet_counts(rows: DataFrame, labels: str) -> DataFrame:
    """Rows for each label of an array or of a comma-joined column; a label counts once a row."""
    items = F.col(labels) if isinstance(rows.schema[labels].dataType, ArrayType) else split_list(F.col(labels))
    each = rows.select(F.explode(F.array_distinct(items)).alias("label"))
    return each.groupBy("label").agg(F.count("*").alias("n"))


def chosen(value: Column, include: list[str], exclude: list[str]) -> Column:
    """Include wins; exclude counts only if nothing is included."""
    if include:
        return value.isin(*include)
    return ~value.isin(*exclude) if exclude else F.lit(True)


def page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(key).offset(offset).limit(limit)


def first_groups(rows: DataFrame, name: str, order: str, limit: int, pinned: str | None = None) -> DataFrame:
    """All rows of the first `limit` groups by a pinned name, least order (null last) and name."""
    groups = rows.groupBy(name).agg(F.min(order).alias("least"))
    first = F.lit(0) if pinned is None else F.when(F.lower(F.trim(name)) == pinned.lower(), 0).otherwise(1)
    kept = groups.orderBy(first, F.col("least").asc_nulls_last(), name).limit(limit).select(name)
    return rows.join(kept, name, "left_semi")


def live_or_cached(live: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Live rows whose key is cached, and cached rows that are not live."""
    columns = live.columns
    return live.join(cached, key, "left_semi").unionByName(cached.join(live, key, "left_anti").select(columns))


def grouped_entries(rows: DataFrame, key: Column, order: list[str], entry: Column, tag: str) -> DataFrame:
    """One row for each key with its entries in order, null entries left out, and its set of tags."""
    # the order's columns lead the struct, so sorting the array is sorting by them
    item = F.when(entry.isNotNull(), F.struct(*order, entry.alias("entry")))
    grouped = rows.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_set(tag)).alias("tags"))
    return grouped.select("key", F.transform("items", lambda x: x["entry"]).alias("entries"), "tags")


def mean_and_median(daily: DataFrame, by: list[str], value: str) -> DataFrame:
    return daily.groupBy(*by).agg(F.round(F.avg(value), 1).alias("mean"), F.round(F.median(value), 1).alias("median"))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """Each row's share of the total in percent and of the largest; one row a group goes to the window."""
    everything = Window.partitionBy()
    return rows.withColumn("percent", F.round(100 * F.col(value) / F.sum(value).over(everything), 1)).withColumn(
        "of_most", F.round(F.col(value) / F.max(value).over(everything), 3)
    )


def by_id(rows: DataFrame, key: str, value: int, privileged: bool = False) -> DataFrame:
    """The one row of an id, if it may be seen."""
    return rows.where((F.col(key) == value) & visible(F.col("hidden"), privileged))


def of_sources(rows: DataFrame, sources: list[str], as_of: str, time_based: list[str], window: str | None = None) -> DataFrame:
    """Rows of some sources within a day or a week; any other window means the rows that are alive."""
    days = WINDOWS.get((window or "").lower())
    when = within(F.col("first_seen"), as_of, window) if days in (1, 7) else alive(F.col("source"), F.col("active"), F.col("first_seen"), as_of, time_based)
    return rows.where(F.col("source").isin(*sources) & when)


def facet_order(facets: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """The commonest first, then by label as Hungarian has it."""
    return facets.orderBy(F.col(n).desc(), F.collate(F.col(label), "hu"))


def latest_first(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """Newest first, rows without a time as if of 1970."""
    return rows.orderBy(F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.lit(0))).desc(), key)


def last_in_order(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n greatest rows, the smallest of them first."""
    return rows.orderBy(F.col(key).desc()).limit(n).orderBy(key)


def page_or_all(rows: DataFrame, key: str, offset: int, limit: int, whole: int = 60) -> DataFrame:
    """A page; the whole list where it has at most `whole` rows."""
    return rows.orderBy(key) if rows.limit(whole + 1).count() <= whole else page(rows, key, offset, limit)


def pinned_first(rows: DataFrame, pinned: Column, seq: str, filtered: bool = False) -> DataFrame:
    """Pinned rows before the others in their own order, unless the list is filtered."""
    return rows.orderBy(seq) if filtered else rows.orderBy(pinned.desc(), seq)


def known_labels(known: DataFrame, observed: DataFrame, label: str = "label") -> DataFrame:
    """Labels that are known or observed, each once."""
    return known.select(label).unionByName(observed.select(label)).distinct()


def review_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """By the columns in turn, nulls last."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def longest(rows: DataFrame, by: str, text: str, key: str) -> DataFrame:
    """by, key of the row with the longest text of each group; of ties the smallest key."""
    best = F.min(F.struct((-F.length(F.coalesce(text, F.lit("")))).alias("n"), key))
    return rows.groupBy(by).agg(best[key].alias(key))
