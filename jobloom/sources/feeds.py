"""Feeds and JSON payloads that a landing job has written."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files; one item is a row like many."""
    fields = "title string, link string, description string, pubDate string"
    return spark.read.format("xml").option("rowTag", "item").schema(fields).load(path)


def sitemap_urls(xml: Column) -> Column:
    """Distinct locations of a sitemap."""
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))


def json_rows(payload: Column, item: str, path: str | None = None) -> Column:
    """Rows of a JSON payload, at its top or under a key; an object in place of a list is one row."""
    body = F.get_json_object(payload, f"$.{path}") if path else payload
    many = F.from_json(body, f"array<{item}>")
    return F.when(F.trim(body).startswith("["), many).otherwise(F.array_compact(F.array(F.from_json(body, item))))


def localized(names: Column, language: str) -> Column:
    """A map's value in the language, else in Hungarian, else in English."""
    return F.coalesce(F.try_element_at(names, F.lit(language)), F.try_element_at(names, F.lit("hu")), F.try_element_at(names, F.lit("en")))


def json_ld_postings(html: Column) -> Column:
    """JSON-LD blocks of html that hold a job posting."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.filter(blocks, lambda b: b.rlike(r'"@type"\s*:\s*"JobPosting"'))


def documents_by_key(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with the file's name as their key."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("key", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def with_checkpoints(spark: SparkSession) -> None:
    """Where checkpoints go: the cluster's shared folder, or on a local master without one a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="jobloom-"))


#: Levels that tree_paths() follows; a deeper tree, or a node that is its own ancestor, is refused.
MOST_LEVELS = 100


def tree_paths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """id and path of every node of (id, parent, name); roots have no parent, and nodes under no root are left out.

    Every round is one join of the nodes with a level's paths, so the rows of a tree have no bound; its levels have, MOST_LEVELS; links.tree_nodes() takes deeper ones, and cycles.
    """
    with_checkpoints(spark)
    level = nodes.where("parent IS NULL").select("id", F.col("name").alias("path"))
    found = level
    for _ in range(MOST_LEVELS):
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("_above"))
        level = nodes.join(above, "parent").select("id", F.concat("_above", F.lit("/"), "name").alias("path"))
        level = level.checkpoint()
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"a tree has more than {MOST_LEVELS} levels, or a cycle")
