"""Nearest neighbours by largest inner product: multiprobe p-stable hashing, and an exact check of what it left out.

With one more coordinate, sqrt(M^2 - |x|^2), all vectors get the largest norm M, and the largest inner
product is the smallest distance. A table hashes a vector to a cell: PROJECTIONS Gaussian projections,
each cut into CELLS_A_SIDE buckets of WIDTH. Given a query's projections, those of a neighbour at a known
cosine are normal, so every cell's chance to hold it is known; a query visits cells, own bucket and
perturbed ones alike, by their chance for each vector they hold, until the chances add up to a coverage.
Cosine and coverage are measured on a bounded sample of the queries, whose true neighbours are sought in
all vectors: the coverage is the least with which LEAST_RECALL of them are met in any table. What a
query has met in one table it passes over in the next. Candidates of all tables are ranked by their
exact inner product.

What 64 queries say of the others is no more than likely, and rare kinds of rows may be met by none of their
queries. So the check follows: each vector is in the cap of its nearest pivot, and a cap's widest angle and
longest vector bound every inner product in it. A query passes by the caps whose bound reaches its k-th best
score, and there by the vectors that no table has shown it. The result is that of brute force.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jobloom.llm.scratch import discard, table, written

NEAREST = 20
TABLES = 2
WIDTH = 1.0
CELLS_A_SIDE = 9
#: More projections, and so smaller cells, for more vectors; cells are CELLS_A_SIDE ** MOST_PROJECTIONS a table at most.
CELL_ROWS = 128
MOST_PROJECTIONS = 5
#: Share of the sample's true neighbours that lie in visited cells of any table.
LEAST_RECALL = 0.95
#: Queries that measure cosine and coverage, and the quantile of their farthest neighbours' cosines that is taken.
SAMPLE_QUERIES = 64
QUANTILE = 0.1
#: Vectors that one unit holds, and the queries that pass by them in one task.
UNIT_VECTORS = 8192
UNIT_QUERIES = 1 << 16
#: Pivots of the check, chosen from a bounded sample, each the farthest from those before; one for CAP_ROWS vectors at most.
MOST_PIVOTS = 512
SAMPLE_VECTORS = 4096
CAP_ROWS = 32
#: Error of a cosine by angles, as arccos has near 1.
SLACK = 1e-7
SEED = 20240617
_STEP = 256
#: Cells of all queries of a step.
_STEP_CELLS = 1 << 20
_log = logging.getLogger(__name__)


def projections(n: int) -> int:
    return min(MOST_PROJECTIONS, max(1, round(math.log(max(n, 1) / CELL_ROWS, 4)))) if n > CELL_ROWS else 1


class Hashing:
    """Cells of vectors and queries; the same on the driver and in all tasks."""

    def __init__(self, dim: int, most_norm: float, n: int, cosine: float = 0.0):
        self.dim, self.norm, self.count, self.cosine, self.coverage = dim, most_norm, projections(n), cosine, 1.0
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.axes = rng.standard_normal((TABLES, dim + 1, self.count))
        self.shift = rng.random((TABLES, self.count)) * WIDTH
        self.places = CELLS_A_SIDE ** np.arange(self.count)
        half = CELLS_A_SIDE // 2
        self.edges = (np.arange(1, CELLS_A_SIDE) - half) * WIDTH - WIDTH / 2

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """(n, dim + 1) vectors on the unit sphere, by their further coordinate."""
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
        return np.column_stack([scaled, rest])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(TABLES, n) cell numbers of vectors (n, dim)."""
        points = self.points(vectors)
        return np.stack([np.searchsorted(self.edges, points @ a + b, side="right") @ self.places for a, b in zip(self.axes, self.shift, strict=True)])

    def _sides(self, queries: np.ndarray, table_: int) -> np.ndarray:
        """(n, projections, CELLS_A_SIDE) chance of each bucket of each projection to hold a neighbour at the cosine."""
        from math import erf

        # summed in one order, so that all tasks agree to the last bit on what a query visits, whatever queries are beside it
        norm2, at = np.zeros((len(queries), 1)), np.zeros((len(queries), self.count))
        for x, axis in zip(queries.T[:, :, None], self.axes[table_][:-1], strict=True):
            norm2 += x * x
            at += x * axis
        at *= self.cosine / np.sqrt(norm2)
        spread = math.sqrt(max(1e-6, 1 - self.cosine**2))
        z = (self.edges - self.shift[table_][:, None] - at[:, :, None]) / (spread * math.sqrt(2))
        below = (1 + np.vectorize(erf)(z)) / 2
        return np.diff(np.concatenate([np.zeros((*below.shape[:2], 1)), below, np.ones((*below.shape[:2], 1))], axis=2))

    def ratios(self, queries: np.ndarray, table_: int, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, cells) chance of each cell to hold a neighbour of each query at the cosine, and that for each vector it holds."""
        side = self._sides(queries, table_)
        digits = cells[None, :] // self.places[:, None] % CELLS_A_SIDE
        out = side[:, 0][:, digits[0]]
        for k in range(1, self.count):  # the first projection is the lowest digit of a cell's number
            out = side[:, k][:, digits[k]] * out
        return out, out / counts


def _before(ratios: np.ndarray, chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, cells) order of each query's visits, share of all cells' chances before each visit, and vectors before it."""
    order = np.argsort(-ratios, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(chances, order, axis=1), axis=1)
    chance = sums / np.maximum(sums[:, -1:], 1e-300)
    seen = np.cumsum(counts[order], axis=1)
    none = np.zeros((len(ratios), 1))
    return order, np.column_stack([none, chance[:, :-1]]), np.column_stack([none, seen[:, :-1]])


def visited(hashing: Hashing, queries: np.ndarray, table_: int, cells: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, cells) whether each query visits each occupied cell: best first, until the coverage and `least` vectors are met; and the least ratio it visits."""
    chances, ratios = hashing.ratios(queries, table_, cells, counts)
    order, before, before_seen = _before(ratios, chances, counts)
    visits = (before < hashing.coverage) | (before_seen < least)
    last = np.take_along_axis(ratios, order, axis=1)[np.arange(len(queries)), visits.sum(axis=1) - 1]
    return ratios >= last[:, None], last


def measured_coverage(hashing: Hashing, queries: np.ndarray, of: np.ndarray, neighbours: np.ndarray, occupied: np.ndarray) -> float:
    """The least coverage with which LEAST_RECALL of the neighbours, of queries `of` and in cells (n, TABLES), are met."""
    first = np.ones(len(of))
    for t in range(TABLES):
        some = np.flatnonzero(occupied[t])
        chances, ratios = hashing.ratios(queries, t, some, occupied[t][some])
        order, before, _ = _before(ratios, chances, occupied[t][some])
        by_cell = np.empty_like(before)
        np.put_along_axis(by_cell, order, before, axis=1)
        first = np.minimum(first, by_cell[of, np.searchsorted(some, neighbours[:, t])])
    return float(np.quantile(first, LEAST_RECALL, method="higher")) + 1e-9 if len(of) else 1.0


class Caps:
    """Caps of the sphere around pivots: counts, widest angles and longest vectors of those to which each pivot is nearest."""

    def __init__(self, hashing: Hashing, sample: np.ndarray, most: int):
        self.norm = hashing.norm
        points = hashing.points(sample)
        # the pole's cap has what is short
        chosen = [np.eye(hashing.dim + 1)[-1]]
        nearest = points @ chosen[0]
        while len(chosen) < most and nearest.min() < 1 - SLACK:
            chosen.append(points[nearest.argmin()])
            nearest = np.maximum(nearest, points @ chosen[-1])
        self.pivots = np.array(chosen)
        self.counts = np.zeros(len(chosen), np.int64)
        self.angles, self.lengths = np.zeros(len(chosen)), np.zeros(len(chosen))

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cap of each point, and the angle to its pivot."""
        cosines = points @ self.pivots.T
        cap = cosines.argmax(axis=1)
        return cap, np.arccos(np.clip(cosines[np.arange(len(points)), cap], -1, 1))

    def most(self, queries: np.ndarray, caps: np.ndarray) -> np.ndarray:
        """(n, caps) what no inner product of a query with a vector of the cap exceeds."""
        norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        away = np.arccos(np.clip((queries / norms) @ self.pivots[caps, :-1].T, -1, 1)) - self.angles[caps]
        cosines = np.minimum(np.cos(np.maximum(0, away)), self.lengths[caps] / self.norm)
        return (cosines + SLACK) * self.norm * norms


def _with(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more)])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().astype(np.float64).reshape(len(values), -1)


def _longs(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), -1)


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) of the k best allowed vectors of each query, ties to the smaller id; exact scores."""
    met = np.flatnonzero(allowed.any(axis=0))
    rough = queries @ vectors[met].T
    # rough scores are off by a share of the lengths, not of the scores
    off = 1e-11 * np.sqrt((queries * queries).sum(axis=1) * (vectors[met] * vectors[met]).sum(axis=1).max(initial=0))
    for q in range(len(queries)):
        here = np.flatnonzero(allowed[q, met])
        row = rough[q, here]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            here = here[row >= least - off[q]]
        rows = met[here]
        exact = (vectors[rows] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[rows], -exact))[:k]
        yield q, rows[order], exact[order]


class _Unit:
    """The vectors of one unit, by table; with caps, those of some caps, by the first table."""

    def __init__(self, rows: pa.Table, hashing: Hashing, occupied: np.ndarray, caps: Caps | None):
        self.hashing, self.occupied, self.caps, self.ids = hashing, occupied, caps, rows["vec_ids"].to_pylist()
        tables, cells, vectors, cap = rows["table"].to_numpy(), _longs(rows["cells"]), _matrix(rows["embedding"]), rows["cap"].to_numpy()
        smallest = np.array([x[0] for x in self.ids])
        self.parts = []
        for t in np.unique(tables).tolist():
            at = np.flatnonzero(tables == t)
            by_table = [np.unique(cells[at, s], return_inverse=True) for s in range(TABLES)]
            self.parts.append((t, at, by_table, np.unique(cap[at], return_inverse=True), vectors[at], smallest[at]))

    def _at_least(self, asked: np.ndarray, t: int, cells: np.ndarray, place: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(queries, vectors) whether the vector's cell of table t has at least this ratio."""
        _, ratios = self.hashing.ratios(asked, t, cells, self.occupied[t][cells])
        return (ratios >= least[:, None])[:, place]

    def _reaching(self, asked: np.ndarray, bars: np.ndarray, caps: np.ndarray, place: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """(queries, vectors) whether the vector's cap and its length leave an inner product of at least the query's bar."""
        norms = np.sqrt((asked * asked).sum(axis=1, keepdims=True)) * (1 + SLACK)
        long_enough = norms * np.sqrt((vectors * vectors).sum(axis=1)) >= bars[:, None]
        return (self.caps.most(asked, caps) >= bars[:, None])[:, place] & long_enough

    def nearest(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """RESULT_SCHEMA rows, by table: the k nearest of the cells that each query visits and has not met in an earlier table; with caps, of what reaches its bar and was met in none."""
        asked, query_ids = _matrix(queries.column("embedding")), queries.column("vec_id").to_pylist()
        least = _matrix(queries.column("least"))
        bars = queries.column("bar").to_numpy() if self.caps else np.full(len(asked), -np.inf)
        out: list[tuple[int, int, float]] = []
        for t, at, cells, caps, vectors, smallest in self.parts:
            if self.caps:
                allowed, met = self._reaching(asked, bars, *caps, vectors), range(TABLES)
            else:
                # the same cells as on the way here, but for rounding: what is close to the last visit is scored again
                allowed, met = self._at_least(asked, t, *cells[t], least[:, t] * (1 - 1e-9)), range(t)
            for s in met:
                allowed &= ~self._at_least(asked, s, *cells[s], least[:, s] * (1 + 1e-9))
            for q, best, scores in _best(asked, vectors, smallest, allowed, k + 1):
                own, bar = query_ids[q], bars[q]
                pairs = [(-s, x) for r, s in zip(at[best].tolist(), scores.tolist(), strict=True) if s >= bar for x in self.ids[r] if x != own]
                out += [(own, x, -s) for s, x in sorted(pairs)[:k]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def _units(visits: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.ListArray:
    """Units of each query, by the first and last unit of each of the cells (queries, cells) that it visits."""
    wanted = np.zeros((len(visits), int(last.max(initial=0)) + 2), np.int64)
    q, c = np.nonzero(visits)
    np.add.at(wanted, (q, first[c]), 1)
    np.add.at(wanted, (q, last[c] + 1), -1)
    within = np.cumsum(wanted, axis=1)[:, :-1] > 0
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(within.sum(axis=1))), pa.int32()), pa.array(np.nonzero(within)[1], pa.int64()))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, norm2 of vectors that take part; -0.0 becomes 0.0."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    zero = F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)
    return whole.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x + zero).alias("embedding"), norm2.alias("norm2")).where("norm2 > 0")


RESULT_SCHEMA = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) to each of queries.

    Equal vectors are one index entry with their k + 1 smallest ids, which is all that k results can
    need. Cells are laid out in units of about UNIT_VECTORS, a cell with more being dealt over
    several. Queries go to the units that hold cells they visit, and pass by a unit's vectors as a stream;
    then, with the score of their k-th, to those of the caps that may hold a nearer one.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do rows without vec_id or vectors of another length than the commonest (the shorter, if tied);
    a query never finds rows of its own vec_id; without other vectors it has no rows; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors, queries = usable(vectors), usable(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max("norm2").alias("norm2"))
    found = sorted(sizes.collect(), key=lambda r: (-r["n"], r["dim"]))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not found:
        return empty
    dim, norm = found[0]["dim"], math.sqrt(found[0]["norm2"]) * (1 + 1e-12)
    # rows that repeat an id count once among the ids
    same = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    firsts = vectors.where(F.size("embedding") == dim).withColumn("same", same).where(F.col("same") <= k + 1)
    entries = firsts.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("vec_ids"))
    entries = written(entries, "vectors")
    queries = queries.where(F.size("embedding") == dim).select("vec_id", "embedding")
    n, n_queries = entries.count(), queries.count()
    if not n_queries:
        return empty
    hashing = Hashing(dim, norm, n)
    sample = entries.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE_VECTORS).toArrow()
    caps = Caps(hashing, _matrix(sample["embedding"]), max(1, min(MOST_PIVOTS, n // CAP_ROWS)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            cells, (cap, angle) = hashing.cells(vectors), caps.of(hashing.points(vectors))
            both = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * TABLES, pa.int32()), pa.array(cells.T.reshape(-1), pa.int64()))
            check = [pa.array(cap, pa.int64()), pa.array(angle), pa.array(np.sqrt((vectors * vectors).sum(axis=1)))]
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([*batch.columns, both, *check, pa.array(np.full(len(batch), t), pa.int32()), pa.array(cells[t], pa.int64())], index_schema.names)

    check_columns = [("cap", T.LongType()), ("angle", T.DoubleType()), ("length", T.DoubleType())]
    index_schema = _with(entries, ("cells", T.ArrayType(T.LongType())), *check_columns, ("table", T.IntegerType()), ("cell", T.LongType()))
    index = written(entries.mapInArrow(hashed, index_schema), "vector-index")
    first_table = index.where("table = 0")
    # one row for each occupied cell: TABLES * CELLS_A_SIDE ** MOST_PROJECTIONS at most
    occupied = np.zeros((TABLES, CELLS_A_SIDE**hashing.count), np.int64)
    for r in index.groupBy("table", "cell").count().collect():
        occupied[r["table"], r["cell"]] = r["count"]
    starts = np.cumsum(occupied).reshape(occupied.shape) - occupied
    # one row a pivot
    for r in first_table.groupBy("cap").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("length").alias("length")).collect():
        caps.counts[r["cap"]], caps.angles[r["cap"]], caps.lengths[r["cap"]] = r["n"], r["angle"], r["length"]
    cap_starts = np.cumsum(caps.counts) - caps.counts
    _measure(hashing, first_table, queries, occupied, k)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(_STEP, _STEP_CELLS // int((occupied > 0).sum(axis=1).max())))
        some = [np.flatnonzero(x) for x in occupied]
        start, count = (np.concatenate([x[t][some[t]] for t in range(TABLES)]) for x in (starts, occupied))
        first, last = start // UNIT_VECTORS, (start + count - 1) // UNIT_VECTORS
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                asked = _matrix(batch.column("embedding"))
                visits, least = zip(*[visited(hashing, asked, t, some[t], occupied[t][some[t]], 2 * k + 1) for t in range(TABLES)], strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * TABLES, pa.int32()), pa.array(np.stack(least, axis=1).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, _units(np.column_stack(visits), first, last)], probes_schema.names)

    probes_schema = _with(queries, ("least", T.ArrayType(T.DoubleType())), ("units", T.ArrayType(T.LongType())))
    probing = written(queries.mapInArrow(probes, probes_schema), "probes")
    no_bar = probing.withColumn("bar", F.lit(None).cast("double"))
    pairs = _met(index, no_bar, lambda t, cell, cap: (starts[t, cell], occupied[t, cell]), (hashing, occupied, None), k)
    found = written(_ranked(pairs, k), "found")

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(caps.counts)
        first, last = cap_starts[some] // UNIT_VECTORS, (cap_starts[some] + caps.counts[some] - 1) // UNIT_VECTORS
        for whole in batches:
            for at in range(0, len(whole), _STEP):
                batch = whole.slice(at, _STEP)
                reaching = caps.most(_matrix(batch.column("embedding")), some) >= batch.column("bar").to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([*batch.columns, _units(reaching, first, last)], checks_schema.names)

    # a query with fewer than k is to meet all
    bar = F.when(F.count("*") == k, F.min("score")).alias("bar")
    bars = found.groupBy(F.col("query_id").alias("vec_id")).agg(bar)
    barred = probing.drop("units").join(bars, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    checks_schema = _with(barred, ("units", T.ArrayType(T.LongType())))
    checking = written(barred.mapInArrow(remaining, checks_schema), "checks")
    more = _met(first_table, checking, lambda t, cell, cap: (cap_starts[cap], caps.counts[cap]), (hashing, occupied, caps), k)
    discard(entries, index, probing, pairs, checking)
    return _ranked(found.drop("rank").unionByName(more), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of RESULT_SCHEMA rows; a vector found in several tables, or by rows that repeat a query, counts once."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    twice = (F.lag("vec_id").over(by_score) == F.col("vec_id")) & (F.lag("score").over(by_score) == F.col("score"))
    once = pairs.withColumn("twice", F.coalesce(twice, F.lit(False))).where("not twice")
    ranked = once.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(
    index: DataFrame, probing: DataFrame, place: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], unit_of: tuple[Hashing, np.ndarray, Caps | None], k: int
) -> DataFrame:
    """RESULT_SCHEMA rows, written: what queries of probing find in their units; place gives the start and count of the cell by which a vector is dealt."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, count = place(*[batch.column(x).to_numpy() for x in ("table", "cell", "cap")])
            unit = (start + batch.column("spread").to_numpy() % count) // UNIT_VECTORS
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(unit, pa.int64())], units_schema.names)

    units_schema = _with(index, ("unit", T.LongType()))
    spread = F.pmod(F.xxhash64("embedding"), F.lit(1 << 40))
    dealt = index.withColumn("spread", spread).mapInArrow(units, units_schema)
    probing = probing.withColumn("unit", F.explode("units")).drop("units")
    # one row for each unit: a unit with more than UNIT_QUERIES queries is met by blocks of them, and only its vectors are repeated
    asked = probing.groupBy("unit").count().where(F.col("count") > UNIT_QUERIES)
    asked = asked.select("unit", F.ceil(F.col("count") / UNIT_QUERIES).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    left = dealt.join(F.broadcast(asked), "unit", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    of_vectors = {"vec_ids": "array<long>", "table": "int", "cells": "array<long>", "cap": "long"}
    of_queries = {"least": "array<double>", "bar": "double"}
    nothing = lambda kinds: [F.lit(None).cast(kind).alias(x) for x, kind in kinds.items()]
    left = left.select("unit", "block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("vec_id"), "embedding", *of_vectors, *nothing(of_queries))
    right = probing.join(F.broadcast(asked), "unit", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    right = right.select("unit", "block", F.lit(1).alias("side"), "vec_id", "embedding", *nothing(of_vectors), *of_queries)
    sides = left.unionByName(right).repartition("unit", "block").sortWithinPartitions("unit", "block", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the vectors of one unit, and lets its queries pass by."""
        key, held, unit = None, [], None
        for whole in batches:
            where = np.stack([whole.column(x).to_numpy() for x in ("unit", "block", "side")])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), whole.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                *now, side = where[:, begin].tolist()
                if now != key:
                    key, held, unit = now, [], None
                part = whole.slice(begin, end - begin)
                if side == 0:
                    held.append(part)
                    continue
                if held:
                    unit, held = _Unit(pa.Table.from_batches(held), *unit_of), []
                if unit is not None:
                    for at in range(0, len(part), _STEP):
                        yield unit.nearest(part.slice(at, _STEP), k)

    return written(sides.mapInArrow(meet, RESULT_SCHEMA), "neighbours")


def _measure(hashing: Hashing, entries: DataFrame, queries: DataFrame, occupied: np.ndarray, k: int) -> None:
    """Sets cosine and coverage of the hashing: by the true k neighbours, among all entries, of SAMPLE_QUERIES queries."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    asked, asked_ids = np.array([r["embedding"] for r in sample], np.float64), np.array([r["vec_id"] for r in sample])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, at = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0, TABLES), np.int64)
        for batch in batches:
            ids = batch.column("vec_ids")
            firsts = ids.flatten().to_numpy()[np.cumsum(ids.value_lengths().to_numpy()) - ids.value_lengths().to_numpy()]
            scores = asked @ _matrix(batch.column("embedding")).T
            scores[(asked_ids[:, None] == firsts) & (ids.value_lengths().to_numpy() == 1)] = -np.inf
            cells = np.broadcast_to(_longs(batch.column("cells")), (len(asked), len(batch), TABLES))
            top, at = np.column_stack([top, scores]), np.concatenate([at, cells], axis=1)
            order = np.argsort(-top, axis=1, kind="stable")[:, :k]
            top, at = np.take_along_axis(top, order, axis=1), np.take_along_axis(at, order[:, :, None], axis=1)
        q, r = np.nonzero(top > -np.inf)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * TABLES, pa.int32()), pa.array(at[q, r].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(top[q, r], pa.float64()), lists], ["q", "score", "cells"])

    # each task sends its k best of each sampled query
    tops = entries.select("embedding", "vec_ids", "cells").mapInArrow(best, "q long, score double, cells array<long>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cells"))
    kept = tops.withColumn("rank", rank).where(F.col("rank") <= k).collect()
    of = np.array([r["q"] for r in kept], np.int64)
    farthest = np.full(len(asked), np.inf)
    np.minimum.at(farthest, of, np.array([r["score"] for r in kept], np.float64))
    cosines = (farthest / (hashing.norm * np.linalg.norm(asked, axis=1)))[np.isfinite(farthest)]
    hashing.cosine = float(np.clip(np.quantile(cosines, QUANTILE), 0.0, 0.999)) if len(cosines) else 0.0
    cells = np.array([r["cells"] for r in kept], np.int64).reshape(-1, TABLES)
    hashing.coverage = measured_coverage(hashing, asked, of, cells, occupied)
    _log.info("nearest: %d projections, cosine %.3f, coverage %.3f", hashing.count, hashing.cosine, hashing.coverage)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
