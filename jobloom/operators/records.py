"""Small keyed records: touches, patches, purges, registries, backups and report indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators.cleaning import first_per_key


def touch(table: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, created_at, last_at: a key that is seen gets its last time, a new one both times."""
    new = seen.groupBy(key).agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    both = table.join(new, key, "full")
    return both.select(key, F.coalesce("created_at", "_from").alias("created_at"), F.greatest("last_at", "_to").alias("last_at"))


def patch(table: DataFrame, patches: DataFrame, key: str, allowed: list[str], skip: str = "N/A") -> DataFrame:
    """Allowed columns take the patch's values; null and `skip` leave the old one."""
    new = patches.select(key, *[F.nullif(F.col(c), F.lit(skip)).alias(f"_{c}") for c in allowed])
    return table.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in allowed}).select(table.columns)


def purge(table: DataFrame, column: str, word: str, least: int = 3) -> DataFrame:
    """table without rows whose column holds the word; words shorter than `least` purge nothing."""
    if len(word) < least:
        return table
    return table.where(~F.coalesce(F.lower(column).contains(word.lower()), F.lit(False)))


def purge_listed(table: DataFrame, urls: DataFrame, source: str, before: str) -> DataFrame:
    """table without the listed urls of sources that begin with `source`, as far as they were first seen before a time.

    So a row that comes back later stays. Defined cases: a row without a source or time stays; urls may repeat.
    """
    named = urls.select("url").distinct().withColumn("_listed", F.lit(True))
    joined = table.join(named, "url", "left")
    gone = F.col("_listed") & F.col("source").startswith(source) & (F.col("first_seen") < F.lit(before).cast("timestamp"))
    return joined.where(~F.coalesce(gone, F.lit(False))).select(table.columns)


def owned(table: DataFrame, owner: str, changes: DataFrame, key: str) -> DataFrame:
    """table without the rows that changes (key, owner) name with their right owner."""
    return table.join(changes.select(key, owner), [key, owner], "left_anti").select(table.columns)


def merge_registry(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Entries by key, the last one winning; both sides may repeat keys."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(at)))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_new")


def add_findings(known: DataFrame, found: DataFrame, key: str, order: str) -> DataFrame:
    """known, and the first of each key of found that it lacks."""
    return known.unionByName(first_per_key(found, [key], [order]).join(known.select(key), key, "left_anti").select(known.columns))


def add_rejected(known: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """name: those of known as they are, and trimmed ones of more that it lacks, each once; blank and null ones of more add nothing."""
    new = more.select(F.regexp_replace(F.col(name).cast("string"), r"^\s+|\s+$", "").alias(name)).where(F.col(name) != "")
    return known.select(name).unionByName(new).distinct()


def kept_backups(keys: DataFrame, column: str, as_of: str, days: int = 10) -> DataFrame:
    """Keys whose date, as it stands in them, is within the retention; keys without a date stay."""
    day = F.try_to_date(F.regexp_extract(column, r"(\d{4}-\d{2}-\d{2})", 1))
    return keys.where(F.coalesce(day >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(True)))


def capped_index(index: DataFrame, report: DataFrame, at: str, most: int = 26) -> DataFrame:
    """The newest entries of index and report."""
    return index.unionByName(report).orderBy(F.desc(at)).limit(most)


def ambiguous(table: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Wanted values with the number of rows they match: 0 is not found, over 1 is ambiguous."""
    counts = table.join(wanted.distinct(), column, "left_semi").groupBy(column).agg(F.count("*").alias("n"))
    return wanted.distinct().join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def run_metrics(rows: DataFrame, reason: Column) -> DataFrame:
    """Rows of a run by what became of them; null is new."""
    return rows.groupBy(F.coalesce(reason, F.lit("new")).alias("outcome")).agg(F.count("*").alias("n"))


def unnested(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """A row for each place of parallel arrays; where one is shorter, null."""
    rest = [c for c in rows.columns if c not in arrays]
    return rows.select(*rest, F.inline(F.arrays_zip(*arrays)))


def merged_documents(old: Column, new: Column) -> Column:
    """Fields of two maps, the new ones winning; a null map has none."""
    none = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, none)
    return F.map_concat(F.map_filter(F.coalesce(old, none), lambda k, _: ~F.map_contains_key(new, k)), new)
