"""Mixing sources to target weights, by the block.

The words of a source, its documents in hashed order, are cut into blocks of BLOCK_WORDS. An output
shard has SHARD_BLOCKS slots, and how many of them each source gets is a multinomial draw, given what
each source gets over all shards: so every source meets its target to the word. The draw is made
down a binary tree of shards with a generator seeded by the node; any task finds the counts of
its shards, and the slots before them, alone. A source's j-th slot is pass j // n over its n blocks, and a keyed
permutation of that pass maps j % n to a block. Slots then join blocks by their index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jobloom.llm.scratch import table, written

BLOCK_WORDS = 128
SHARD_BLOCKS = 1024
SEED = 20240611
#: A source gives at most so many times its words.
MOST_PASSES = 3
#: Relative weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
#: Rows of a source that share one running sum, and such groups of rows that share the next.
SUM_ROWS = 512
#: Sources, or bundles of sources if there are more, whose slots are drawn by shard: each task of slots() holds a number for each.
MOST_SOURCES = 50_000
#: Slots of a bundled source that one row of its plan stands for.
PLAN_SLOTS = 1 << 16
#: Documents that are cut at once.
CUT_ROWS = 256
#: numpy draws from populations below this size; from larger ones _hypergeometric does.
_MOST_DRAWN = 10**9 - 1


def targets(sizes: list[int], weights: list[int], most: int = MOST_PASSES) -> list[float]:
    """Each source's words in the mix: shares of all words by weight, none above `most` times its size."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > most * sizes[k]]
        for k in over or open_:
            out[k] = float(most * sizes[k]) if over else left * weights[k] / weight
        if not over:
            break
        open_ -= set(over)
        left = total - sum(float(most * sizes[k]) for k in range(len(sizes)) if k not in open_)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: tuple[int, ...], inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network over the next power of four, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(np.random.SeedSequence(key))).integers(0, 1 << 63, 4, dtype=np.uint64)
    out = np.asarray(index, np.uint64).copy()
    walking = np.ones(len(out), bool)
    while walking.any():
        a, b = out[walking] >> np.uint64(half), out[walking] & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (_mixed(a ^ k) & low), a
            else:
                a, b = b, a ^ (_mixed(b ^ k) & low)
        out[walking] = (a << np.uint64(half)) | b
        walking &= out >= np.uint64(n)
    return out.astype(np.int64)


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    rows: int
    size: int
    target: float
    blocks: int
    slots: int
    #: Words of the block in the last slot that count.
    last_take: int


def plan_source(number: int, source: str | None, rows: int, size: int, target: float, block_words: int, seed: int) -> SourcePlan:
    """Slots that hold exactly round(target) words, at most MOST_PASSES times each block."""
    blocks = -(-size // block_words)
    words = min(round(target), MOST_PASSES * size)
    if not words:
        return SourcePlan(source, rows, size, target, blocks, 0, block_words)
    passes, rest = divmod(words, size)
    if not rest:
        return SourcePlan(source, rows, size, target, blocks, passes * blocks, block_words)
    short = block_words - (size - (blocks - 1) * block_words)
    place = int(permuted(np.array([blocks - 1]), blocks, (seed, number, passes), inverse=True)[0])
    held = lambda slots: slots * block_words - short * (place < slots)
    slots = -(-rest // block_words)
    slots += held(slots) < rest
    return SourcePlan(source, rows, size, target, blocks, passes * blocks + slots, rest - held(slots - 1))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw of any size, by inversion in double precision.

    Ratios of neighbouring probabilities are summed from twelve standard deviations below the mode to as many
    above, beyond which less than the generator's resolution is left; memory grows with the deviation.
    """
    low, high, total = max(0, sample - bad), min(good, sample), good + bad
    if low == high:
        return low
    mode = (sample + 1) * (good + 1) // (total + 2)
    deviation = (sample * (good / total) * (bad / total) * ((total - sample) / (total - 1))) ** 0.5
    reach = int(12 * deviation) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.int64)
    ratios = (good - k) / (k + 1) * ((sample - k) / (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratios))])
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(below, rng.random() * below[-1], side="right")), high - low)


@lru_cache(maxsize=4096)
def _large_node(counts: tuple[int, ...], slots: int, key: tuple[int, ...]) -> tuple[int, ...]:
    """How many of `slots` drawn slots each source has, source by source; all shards below a node ask for it."""
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))
    left, rest = [], sum(counts)
    for n in counts:
        rest -= n
        left.append(_hypergeometric(rng, n, rest, slots))
        slots -= left[-1]
    return tuple(left)


def shard_counts(totals: np.ndarray, shard_blocks: int, wanted: range, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, slots of each source in it) of the wanted shards."""
    n_slots = int(totals.sum())

    def descend(low: int, high: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= wanted.start or low >= wanted.stop:
            return
        if high - low == 1:
            yield low, before, counts
            return
        middle = (low + high) // 2
        slots = (middle - low) * shard_blocks
        if counts.sum() > _MOST_DRAWN:
            left = np.array(_large_node(tuple(counts.tolist()), slots, (seed, low, high)), np.int64)
        else:
            rng = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, low, high))))
            left = rng.multivariate_hypergeometric(counts, slots, method="marginals")
        yield from descend(low, middle, left, before)
        yield from descend(middle, high, counts - left, before + left)

    shards = -(-n_slots // shard_blocks)
    if shards:
        yield from descend(0, shards, totals, np.zeros_like(totals))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, more columns, number of words and text hash of docs, written: texts are read once."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    return written(docs.select("doc_id", "source", *more, words.alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")


def plan_mix(sizes: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> list[SourcePlan] | DataFrame:
    """One plan for each source, in code point order, null last: a list of at most MOST_SOURCES, or plan_many()'s table if there are more."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    found = [(r["source"], r["n"], r["size"]) for r in totals.limit(MOST_SOURCES + 1).collect()]
    if len(found) > MOST_SOURCES:
        return plan_many(totals, block_words, seed)
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([size for *_, size in found], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))])
    return [plan_source(k, *x, t, block_words, seed) for k, (x, t) in enumerate(zip(found, wanted, strict=True))]


def plan_many(totals: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """number, mix_source, n, source_size, target, blocks, slots, last_take of each source of totals (source, n, size), written as a table.

    The rounds of targets() are sums over the table: a round shares what is left by weight, and the sources that it would
    take above their most are set to it. Nothing of a source is on the driver.
    """
    order = [F.col("source").isNull(), F.asc("source")]
    rows = written(placed_in_order(totals, order), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", weight)
    most = F.col("size") * MOST_PASSES
    total = rows.agg(F.sum("size").alias("total")).first()["total"] or 0
    share, last = F.lit(0.0), None
    open_ = F.lit(True)
    while True:
        # one row
        now = rows.agg(F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.coalesce(F.sum(F.when(~open_, most)), F.lit(0)).alias("full"), F.count_if(open_).alias("n")).first()
        if not now["n"] or now["n"] == last:
            break
        last, left = now["n"], float(total - now["full"])
        share = left * F.col("weight") / F.lit(float(now["weight"]))
        # what was above its most in a round is so in every later one, as shares only grow
        open_ = ~(share > most)
    target = F.when(open_, share).otherwise(most.cast("double"))
    wanted = rows.withColumn("target", target)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = [plan_source(*r, block_words, seed) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            more = [pa.array([getattr(p, x) for p in plans], pa.int64()) for x in ("blocks", "slots", "last_take")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    names = ["number", "mix_source", "n", "source_size", "target", "blocks", "slots", "last_take"]
    schema = "number long, mix_source string, n long, source_size long, target double, blocks long, slots long, last_take long"
    return written(wanted.select("number", "source", "n", "size", "target").mapInArrow(planned, schema), "mix-plans")


def placed_in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with number, their place from 0 in the order: by ranges, which are numbered each and moved on by those before."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("range", T.LongType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part)), pa.array(np.arange(at, at + len(batch)))], schema.names)
            at += len(batch)

    numbered = written(ranged.mapInArrow(number, schema), "mix-order")
    # one row a range
    counts = sorted(map(tuple, numbered.groupBy("range").count().collect()))
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    before = spark.createDataFrame([(part, start) for (part, _), start in zip(counts, starts, strict=False)], "range long, before long")
    return numbered.join(F.broadcast(before), "range").withColumn("number", F.col("before") + F.col("place")).drop("range", "place", "before")


def many_slots(plans: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """slots() of plan_many()'s sources.

    Sources are dealt to MOST_SOURCES bundles, whose slots are drawn by shard as those of sources are; a keyed
    permutation of a bundle's slots gives each to a slot of one of its sources, which is the same draw.
    """
    spark = plans.sparkSession
    before = Window.partitionBy("bundle").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = plans.withColumn("bundle", F.col("number") % MOST_SOURCES).withColumn("base", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    totals = np.zeros(MOST_SOURCES, np.int64)
    # one row a bundle
    for r in rows.groupBy("bundle").agg(F.sum("slots").alias("slots")).collect():
        totals[r["bundle"]] = r["slots"]
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(PLAN_SLOTS).cast("long")))
    chunks = rows.where("slots > 0").select("number", "bundle", "base", "blocks", "slots", "last_take", chunks.alias("first"))

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, bundle, base, blocks, n, last_take, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                j = np.arange(first, min(n, first + PLAN_SLOTS))
                passes, index = np.divmod(j, blocks)
                block = np.zeros(len(j), np.int64)
                for k in np.unique(passes):
                    block[passes == k] = permuted(index[passes == k], blocks, (seed, number, int(k)))
                take = np.where(j == n - 1, last_take, block_words)
                columns = [np.full(len(j), bundle), base + j, np.full(len(j), number), block, passes, take]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bundle", "index", "number", "block", "pass", "take"])

    def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                ((_, earlier, counts),) = shard_counts(totals, shard_blocks, range(shard, shard + 1), seed)
                some = np.flatnonzero(counts)
                index = [permuted(earlier[b] + np.arange(counts[b]), int(totals[b]), (seed, int(b), MOST_PASSES + 1)) for b in some]
                joined = np.concatenate(index)
                place = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, shard)))).permutation(len(joined))
                arrays = [np.full(len(joined), shard), place, np.repeat(some, counts[some]), joined]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["shard", "slot", "bundle", "index"])

    theirs = chunks.mapInArrow(of_sources, "bundle long, index long, number long, block long, pass long, take long")
    n_shards = -(-int(totals.sum()) // shard_blocks)
    drawn = spark.range(n_shards).mapInArrow(of_shards, "shard long, slot long, bundle long, index long").hint("merge")
    return drawn.join(theirs, ["bundle", "index"]).select("shard", "slot", "number", "block", "pass", "take")


def source_table(spark: SparkSession, plans: list[SourcePlan]) -> DataFrame:
    rows = [(k, p.source, p.rows, p.size, p.target) for k, p in enumerate(plans)]
    return spark.createDataFrame(rows, "number int, mix_source string, n long, source_size long, target double")


def placed(sizes: DataFrame, plans: list[SourcePlan] | DataFrame) -> DataFrame:
    """sizes with number, source_size, target, and start: the words before the document in its source.

    A source's documents are summed in ranges of their hash, about SUM_ROWS rows each, the ranges' totals in
    runs of SUM_ROWS, and the runs' once more; so a source of any size is spread over all tasks.
    """
    if isinstance(plans, list):
        known = F.broadcast(source_table(sizes.sparkSession, plans))
    else:
        known = plans.select("number", "mix_source", "n", "source_size", "target")
    # hash ranges as equal parts of 2^32, which pmod of the hash is uniform over
    parts = F.greatest(F.lit(1), (F.col("n") / SUM_ROWS).cast("long"))
    rank = F.pmod(F.col("h"), F.lit(1 << 32))
    docs = sizes.withColumn("h", F.xxhash64("doc_id", "text_hash"))
    docs = docs.join(known, docs["source"].eqNullSafe(known["mix_source"])).drop("mix_source")
    docs = docs.withColumn("part", F.shiftright(rank * parts, 32)).drop("n")
    until = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, *keys: F.coalesce(F.sum(c).over(until(*keys)), F.lit(0))
    totals = docs.groupBy("number", "part").agg(F.sum("size").alias("part_size")).withColumn("run", F.floor(F.col("part") / SUM_ROWS))
    runs = totals.groupBy("number", "run").agg(F.sum("part_size").alias("run_size"))
    runs = runs.select("number", "run", earlier("run_size", "number", "run").alias("run_start"))
    totals = totals.withColumn("in_run", earlier("part_size", "number", "run", "part")).join(runs, ["number", "run"])
    totals = totals.select("number", "part", (F.col("run_start") + F.col("in_run")).alias("part_start"))
    # where rows have numbers, these order the ones that are alike
    order = ["h", "doc_id", "text_hash", "size", *(c for c in sizes.columns if c == "row")]
    within = Window.partitionBy("number", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["number", "part"])
    return docs.withColumn("start", F.col("part_start") + F.col("within")).drop("part", "part_start", "within", "h")


def slots(spark: SparkSession, plans: list[SourcePlan] | DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """One row for each slot of the mix: shard, slot, number, block, pass, take (words of the block that count)."""
    if not isinstance(plans, list):
        return many_slots(plans, block_words, shard_blocks, seed)
    totals = np.array([p.slots for p in plans], np.int64)
    n_shards = -(-int(totals.sum()) // shard_blocks)
    names = ["shard", "slot", "number", "block", "pass", "take"]

    def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                ((_, before, counts),) = shard_counts(totals, shard_blocks, range(shard, shard + 1), seed)
                columns: list[list[np.ndarray]] = [[] for _ in names]
                for number in np.flatnonzero(counts):
                    p = plans[number]
                    j = before[number] + np.arange(counts[number])
                    passes, index = np.divmod(j, p.blocks)
                    block = np.zeros(len(j), np.int64)
                    for k in np.unique(passes):
                        block[passes == k] = permuted(index[passes == k], p.blocks, (seed, int(number), int(k)))
                    take = np.where(j == p.slots - 1, p.last_take, block_words)
                    for column, values in zip(columns[2:], (np.full(len(j), number), block, passes, take), strict=True):
                        column.append(values)
                joined = [np.concatenate(c) for c in columns[2:]]
                order = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, shard)))).permutation(len(joined[0]))
                arrays = [np.full(len(order), shard), order, *joined]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names)

    return spark.range(n_shards).mapInArrow(of_shards, "shard long, slot long, number long, block long, pass long, take long")


def pieces(docs: DataFrame, mix: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed corpus: for each slot, the documents in its block with the words they give.

    docs are placed() documents; from_word and n_words say which words of the document the slot holds.
    """
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
    held = docs.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    edge = F.col("block") * block_words
    held = held.withColumn("word", F.greatest("start", edge)).withColumn("to", F.least(end, edge + block_words))
    # the planner takes the slots for as few rows as there are shards, so it must not choose to broadcast them
    mix = mix.withColumn("number", F.col("number").cast("long")).hint("merge")
    joined = held.withColumn("number", F.col("number").cast("long")).join(mix, ["number", "block"])
    stop = F.least("to", F.col("block") * block_words + F.col("take"))
    joined = joined.withColumn("n_words", stop - F.col("word")).withColumn("from_word", F.col("word") - F.col("start"))
    return joined.where("n_words > 0").drop("word", "to", "take")


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document of docs (doc_id, text, source).

    Defined cases: a null or wordless text has size 0 and is never taken; a null source is a source, the
    last one; rows of one doc_id are separate documents; a null doc_id is kept; other columns are ignored;
    texts of any length are counted whole; an empty table gives an empty result.
    """
    sizes = sized(docs)
    plans = plan_mix(sizes)
    docs = placed(sizes, plans)
    # a document is known by its source and start, if it has words
    taken = pieces(docs, slots(docs.sparkSession, plans)).groupBy("number", "start").agg(F.sum("n_words").alias("taken"))
    some = docs.where("size > 0").join(taken, ["number", "start"], "left")
    out = ("doc_id", "size", "source_size", "target")
    some = some.select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(docs.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of text in the sorted (first, count) spans, as they stand; where words between are left out, a line break."""
    words = [m.span() for m in _WORDS.finditer(text)]
    runs: list[list[int]] = []
    for first, count in spans:
        if runs and runs[-1][1] == first:
            runs[-1][1] = first + count
        else:
            runs.append([first, first + count])
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs' own columns: a document once for each pass that takes words of it.

    Where a pass takes all words of a document, its text stays as it is; else it is the words taken. A
    column n_chars is brought up to date. Defined cases are those of taken_words(); documents of which
    no word is taken have no row.
    """
    # numbered once: rows may be alike in all columns but those that the mix does not look at
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "mix-rows")
    sizes = sized(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), "row")
    plans = plan_mix(sizes)
    mix = slots(docs.sparkSession, plans)
    taken = pieces(placed(sizes, plans), mix).groupBy("row", "size", "pass")
    taken = taken.agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("spans"))
    # the narrow side is hashed, so that documents need no sort
    joined = rows.join(taken.hint("shuffle_hash"), "row")
    # by position: docs may have columns of any name
    numbered = [F.col(f"doc.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    chosen = joined.select(*numbered, "size", "spans")
    at, schema = docs.columns.index("text"), docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, len(whole_batch), CUT_ROWS):
                batch = whole_batch.slice(first, CUT_ROWS)
                texts = []
                for text, size, spans in zip(batch.column(at), batch.column(-2).to_pylist(), batch.column(-1), strict=True):
                    spans = [(x["from_word"], x["n_words"]) for x in spans.as_py()]
                    whole = sum(n for _, n in spans) == size
                    texts.append(text.as_py() if whole else _cut(text.as_py(), spans))
                columns = [*batch.columns[:-2]]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = chosen.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
