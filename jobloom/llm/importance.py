"""Target-distribution importance resampling over hashed runs of words, by tries local to a partition.

A trie holds the runs of one to LONGEST words of up to SHARD_WORDS words of documents. A node is a run: its parent
is the run without the last word, and its CRC state the parent's, carried on over that word. Its count goes to its
state's bucket; a task's totals of buckets are merged with the others'. To score documents, the tries are made
again with each bucket's gain attached to its nodes, summed along the path from the root; a document's weight is the
sum of the deepest nodes that walks from each of its words reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.scratch import discard, table, written
from jobloom.llm.words import overlapping_slices

BUCKETS = 10_000
LONGEST = 3
#: Words of one trie; a longer document goes to several.
SHARD_WORDS = 1 << 19
SEED = 42
#: Share of the documents that are drawn, and the words that a document needs to be among them.
PERCENT = 5
LEAST_WORDS = 20


class _Numbers(dict):
    """Numbers of words from 1, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class Trie:
    """The trie of parts: words, and how many of them begin runs; the others only end some."""

    def __init__(self, parts: list[tuple[list[bytes], int]], longest: int = LONGEST):
        numbers = _Numbers()
        sizes = np.array([len(words) + 1 for words, _ in parts])
        self.begins = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()) + longest, np.int64)
        begins = np.zeros(len(ids), bool)
        for at, (words, own) in zip(self.begins.tolist(), parts, strict=True):
            ids[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            begins[at : at + own] = True
        words = list(numbers)
        #: Places in ids where a walk begins.
        self.starts = np.flatnonzero(begins)
        #: By level: the place in starts of each walk that gets so far, and its node; the parent, CRC state and count of each node.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        steps = [b"", *words]
        walks, parents, states = np.arange(len(self.starts)), np.zeros(len(self.starts), np.int64), np.zeros(1, np.int64)
        for depth in range(longest):
            last = ids[self.starts[walks] + depth]
            walks, parents, last = walks[last > 0], parents[last > 0], last[last > 0]
            keys, nodes, counts = np.unique(parents * (len(words) + 1) + last, return_inverse=True, return_counts=True)
            parent, last = np.divmod(keys, len(words) + 1)
            states = np.fromiter(map(zlib.crc32, map(steps.__getitem__, last.tolist()), states[parent].tolist()), np.int64, len(keys))
            self.levels.append((walks, nodes, parent, states, counts))
            parents = nodes
            if not depth:
                steps = [b" " + x for x in steps]

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return sum((np.bincount(states % buckets, counts, buckets).astype(np.int64) for *_, states, counts in self.levels), np.zeros(buckets, np.int64))

    def part_sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part: its runs, and the sum of their gains."""
        deepest, depth = np.zeros(len(self.starts), np.int64), np.zeros(len(self.starts), np.int64)
        attached = np.zeros(1, np.int64)
        for walks, nodes, parent, states, _ in self.levels:
            attached = attached[parent] + gains[states % len(gains)]
            deepest[walks] = attached[nodes]
            depth[walks] += 1
        part = np.searchsorted(self.begins, self.starts, side="right") - 1
        sums = np.zeros((2, len(self.begins)), np.int64)
        np.add.at(sums[0], part, depth)
        np.add.at(sums[1], part, deepest)
        return sums[0], sums[1]


def _tries(texts: Iterator[str | None]) -> Iterator[tuple[list[int], list[int], Trie]]:
    """The text and the own words of each part, and the trie of the parts, for shards of the texts in order."""
    of, parts, held = [], [], 0
    for k, text in enumerate(texts):
        for words, own in overlapping_slices(text, LONGEST - 1):
            of.append(k)
            parts.append((words, own))
            held += len(words)
            if held >= SHARD_WORDS:
                yield of, [x for _, x in parts], Trie(parts)
                of, parts, held = [], [], 0
    if parts:
        yield of, [x for _, x in parts], Trie(parts)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Runs of words in each bucket, of all texts of texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, trie in _tries(x.as_py() for x in batch.column(0)):
                totals += trie.bucket_counts(buckets)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # one row a bucket
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of a bucket's smoothed shares in the target and in the documents."""
    raw, wanted = docs.astype(np.float64), target.astype(np.float64)
    ratio = (wanted + 1) * (raw.sum() + len(raw)) / ((raw + 1) * (wanted.sum() + len(raw)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of docs (doc_id, text), without a shuffle."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, len(batch)), np.int64)
            for of, own, trie in _tries(x.as_py() for x in batch.column(1)):
                for row, values in zip(sums, (own, *trie.part_sums(gains)), strict=True):
                    np.add.at(row, of, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(walk, "doc_id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: the place by score, of the drawn; null of the others.

    Rows are put in order by ranges, numbered in each, and moved on by what the ranges before hold; rows that tie in
    score and doc_id are spread over ranges by a row number.
    """
    spark = scored.sparkSession
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    scored = written(scored.withColumn("able", able), "scored")
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("tie")]
    ranged = scored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at + 1, at + len(batch) + 1))
            at += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part)), places], schema.names)

    schema = T.StructType([*ranged.schema.fields, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])
    numbered = written(ranged.mapInArrow(number, schema), "ranks")
    discard(scored)
    # one row a range
    counts = sorted(map(tuple, numbered.groupBy("part").agg(F.count_if("able")).collect()))
    passed, total = [], 0
    for part, n in counts:
        passed.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(passed, "part long, before long"))
    rank = F.col("before") + F.col("place")
    ranks = numbered.join(before, "part").withColumn("rank", F.when(F.col("able") & (rank <= percent * total // 100), rank))
    return ranks.drop("part", "place", "before", "able")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs (doc_id, text), drawn to be like target (text).

    A score is the weight and Gumbel noise keyed by seed and doc_id, so that the highest scores are a draw without
    replacement. Defined cases: a null or empty text has no runs and weight 0, and is never drawn; a text of any
    length counts whole; rows of one doc_id share their noise and are drawn each; a row without doc_id has the noise
    of the seed alone and goes before its ties; other columns are ignored; an empty target has even shares; an empty
    table gives an empty result.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return drawn(weigh(docs, gains).withColumn("score", F.col("weight") + noise), percent)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
