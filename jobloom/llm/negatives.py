"""Hard-negative mining by a table of distances to pivots.

With one more coordinate, sqrt(M^2 - |x|^2), all vectors get the largest norm M, and an anchor's inner product with x
is (M^2 + |anchor|^2 - d^2) / 2 of their distance d. Every row stores its distances to PIVOTS pivots; by the triangle
inequality, they bracket d, and so the score. Rows of the same nearest pivot are a cell, which is bracketed as a
whole; anchors pass by the cells that may hold what they look for, in which brackets choose the rows, and only
these get exact scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.scratch import discard, table, written

PIVOTS = 16
#: Rows from which the pivots are chosen, each the farthest from those before; every row is in the table.
SAMPLE_ROWS = 1024
#: Rows of a cell that one task holds, about, and the anchors that pass by them there.
UNIT_ROWS = 4096
UNIT_ANCHORS = 1 << 16
POSITIVES = 5
NEGATIVES = 3
#: Percent of a positive's score that a negative's may have.
LEAST_PERCENT = 50
MOST_PERCENT = 95
#: Error of a distance, as a share of M.
SLACK = 1e-7
_STEP = 128
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, steps: int = 256) -> DataFrame:
    """vec_id, label, vector of vectors (vec_id, label, embedding) that take part, one row a vec_id: components are floor(steps * x), as doubles.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part. Of rows
    of one vec_id the smallest by label and vector counts.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0))
    scaled = lambda x: x.cast("double") * steps
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    rows = kept.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: whole(scaled(x))).alias("vector")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vector")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().astype(np.float64).reshape(len(values), -1)


class Pivots:
    """Distances to the pivots, and the brackets of scores that they give."""

    def __init__(self, points: np.ndarray, most_norm2: float):
        self.points, self.norm2 = points, most_norm2
        self.slack = SLACK * np.sqrt(most_norm2)
        self.rest = self._rest(points)

    def _rest(self, rows: np.ndarray) -> np.ndarray:
        """The coordinate that makes up for what a vector's norm lacks."""
        return np.sqrt(np.maximum(0, self.norm2 - (rows * rows).sum(axis=1)))

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        gone = 2 * (self.norm2 - rows @ self.points.T - self._rest(rows)[:, None] * self.rest)
        return np.sqrt(np.maximum(0, gone))

    def of_anchors(self, anchors: np.ndarray) -> np.ndarray:
        """An anchor's own further coordinate is 0."""
        gone = self.norm2 + (anchors * anchors).sum(axis=1)[:, None] - 2 * anchors @ self.points.T
        return np.sqrt(np.maximum(0, gone))

    def scores(self, anchors: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, k) least and most score, from distances (anchors, k) that are nearest and farthest."""
        base = (self.norm2 + (anchors * anchors).sum(axis=1))[:, None]
        return (base - (farthest + self.slack) ** 2) / 2, (base - np.maximum(0, nearest - self.slack) ** 2) / 2

    def brackets(self, anchors: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, rows) least and most score of rows by their stored distances."""
        own = self.of_anchors(anchors)
        nearest, farthest = np.zeros((len(own), len(stored))), np.full((len(own), len(stored)), np.inf)
        for a, b in zip(own.T, stored.T, strict=True):
            np.maximum(nearest, np.abs(a[:, None] - b), out=nearest)
            np.minimum(farthest, a[:, None] + b, out=farthest)
        return self.scores(anchors, nearest, farthest)

    def cell_brackets(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, cells) least and most score of any row of cells whose rows' distances are between least and most (cells, pivots)."""
        own = self.of_anchors(anchors)[:, None]
        return self.scores(anchors, np.maximum(0, np.maximum(own - most, least - own)).max(axis=2), (own + most).min(axis=2))

    def exact(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(anchors, rows) inner products of whole numbers, in doubles where these hold every sum."""
        if self.norm2 < 2.0**53:
            return anchors @ rows.T
        whole = np.frompyfunc(int, 1, 1)
        return whole(anchors) @ whole(rows).T


def choose_pivots(sample: np.ndarray, norm2: float) -> Pivots:
    """The first of the sample, and each time the row that is farthest from all before; the least number that tells the rows apart, PIVOTS at most."""
    chosen = [0]
    nearest = Pivots(sample[:1], norm2).of_rows(sample)[:, 0]
    while len(chosen) < PIVOTS and nearest.max() > 2 * SLACK * np.sqrt(norm2):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, Pivots(sample[chosen[-1:]], norm2).of_rows(sample)[:, 0])
    return Pivots(sample[chosen], norm2)


class Unit:
    """Rows of one unit, their stored distances, and searches of blocks of anchors among them."""

    def __init__(self, rows: pa.Table, pivots: Pivots):
        order = np.argsort(rows["label"].to_numpy(), kind="stable")
        self.pivots = pivots
        self.labels, self.ids = rows["label"].to_numpy()[order], rows["vec_id"].to_numpy()[order]
        self.vectors, self.stored = _matrix(rows["vector"])[order], _matrix(rows["stored"])[order]

    def best(self, anchors: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int, int]]:
        """anchor, 0, row, score: the k best other rows of each anchor's label here."""
        ids, labels, vectors = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vector"))
        for label in np.unique(labels):
            first, end = np.searchsorted(self.labels, [label, label + 1])
            asked = np.flatnonzero(labels == label)
            if first == end:
                continue
            own, rows = self.ids[first:end], self.vectors[first:end]
            other = own != ids[asked][:, None]
            _, most = self.pivots.brackets(vectors[asked], self.stored[first:end])
            most[~other] = -np.inf
            if len(own) > k:
                # the k most promising rows' exact scores: what cannot reach them is not among the best
                ahead = np.argpartition(-most, k - 1, axis=1)[:, :k]
                sure = np.stack([self.pivots.exact(vectors[a : a + 1], rows[x])[0] for a, x in zip(asked.tolist(), ahead, strict=True)])
                sure[np.take_along_axis(most, ahead, axis=1) == -np.inf] = -(1 << 200) if sure.dtype == object else -np.inf
                survive = other & (most >= sure.min(axis=1).astype(np.float64)[:, None] - self.pivots.slack * self.pivots.slack)
            else:
                survive = other
            some = np.flatnonzero(survive.any(axis=0))
            exact = self.pivots.exact(vectors[asked], rows[some])
            for a, anchor in enumerate(ids[asked].tolist()):
                at = np.flatnonzero(survive[a, some])
                for score, row in _top(exact[a, at], own[some[at]], k):
                    yield anchor, 0, row, score

    def within(self, anchors: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int, int]]:
        """anchor, number of the band, row, score: the k best rows of other labels in each of the anchor's bands of scores."""
        ids, labels, vectors = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vector"))
        lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
        least, most = self.pivots.brackets(vectors, self.stored)
        low, high = np.array([min(x) for x in lows], np.float64), np.array([max(x) for x in highs], np.float64)
        # a long that a double rounds is one that the slack holds
        survive = (self.labels != labels[:, None]) & (most >= low[:, None]) & (least <= high[:, None])
        some = np.flatnonzero(survive.any(axis=0))
        exact = self.pivots.exact(vectors, self.vectors[some])
        for a, anchor in enumerate(ids.tolist()):
            at = np.flatnonzero(survive[a, some])
            scores, rows = exact[a, at], self.ids[some[at]]
            for band, (lo, hi) in enumerate(zip(lows[a], highs[a], strict=True)):
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                for score, row in _top(scores[inside], rows[inside], k):
                    yield anchor, band, row, score


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[kept], ids[kept]
    return [(-s, x) for s, x in sorted(zip((-int(s) for s in scores), ids.tolist(), strict=True))[:k]]


FOUND_SCHEMA = "anchor_id long, band int, row_id long, score long"
Search = Callable[[Unit, pa.RecordBatch], Iterator[tuple[int, int, int, int]]]


class PivotTable:
    """Rows with their cell and stored distances, laid out in units."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        dims = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        self.rows = None
        if not dims:
            return
        rows = written(vectors.where(F.size("vector") == dims[0]["dim"]), "vectors")
        norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        most = rows.agg(F.max(norm2).alias("most")).first()["most"] * (1 + 1e-12)
        # at most SAMPLE_ROWS rows
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
        pivots = self.pivots = choose_pivots(np.array([r["vector"] for r in sample], np.float64), most or 1.0)

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pivots.of_rows(_matrix(batch.column("vector")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(found.argmin(axis=1))], ["vec_id", "label", "vector", "stored", "cell"])

        schema = "vec_id long, label long, vector array<double>, stored array<double>, cell long"
        self.rows = written(rows.mapInArrow(stored, schema), "pivot-table")
        discard(rows)
        # one row a cell, PIVOTS at most
        ends = [f(F.col("stored")[p]).alias(f"{name}{p}") for name, f in (("least", F.min), ("most", F.max)) for p in range(len(pivots.points))]
        cells = sorted(self.rows.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: r["cell"])
        self.least, self.most = (np.array([[r[f"{name}{p}"] for p in range(len(pivots.points))] for r in cells]) for name in ("least", "most"))
        self.units = [-(-r["n"] // UNIT_ROWS) for r in cells]
        self.first = np.cumsum([0, *self.units])
        places = spark.createDataFrame([(r["cell"], int(a), n) for r, a, n in zip(cells, self.first, self.units, strict=False)], "cell long, first long, units long")
        dealt = self.rows.join(F.broadcast(places), "cell")
        self.dealt = dealt.withColumn("unit", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("units"))).drop("cell", "first", "units")

    def search(self, asked: DataFrame, how: Search) -> DataFrame:
        """FOUND_SCHEMA rows of how, for all units that may hold what asked (vec_id, label, vector, lows, highs) looks for."""
        pivots, least, most, first, units = self.pivots, self.least, self.most, self.first, self.units

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), _STEP):
                    batch = whole.slice(at, _STEP)
                    low = np.array([min(x, default=-np.inf) for x in batch.column("lows").to_pylist()], np.float64)
                    high = np.array([max(x, default=np.inf) for x in batch.column("highs").to_pylist()], np.float64)
                    worst, best = pivots.cell_brackets(_matrix(batch.column("vector")), least, most)
                    a, c = np.nonzero((best >= low[:, None]) & (worst <= high[:, None]))
                    counts = np.array(units)[c]
                    unit = np.repeat(first[c] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(np.repeat(a, counts))).columns, pa.array(unit.astype(np.int64))], [*names, "unit"])

        names = ["vec_id", "label", "vector", "lows", "highs"]
        asked = asked.select(*names)
        routed = asked.mapInArrow(route, "vec_id long, label long, vector array<double>, lows array<long>, highs array<long>, unit long")
        blocks = max(1, -(-asked.count() // UNIT_ANCHORS))
        left = self.dealt.withColumns({"side": F.lit(0), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "lows": F.lit(None).cast("array<long>"), "highs": F.lit(None).cast("array<long>")})
        right = routed.withColumns({"side": F.lit(1), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "stored": F.lit(None).cast("array<double>")})
        sides = left.unionByName(right).repartition("unit", "block").sortWithinPartitions("unit", "block", "side")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Holds the rows of one unit, and lets its anchors pass by."""
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
                        unit, held = Unit(pa.Table.from_batches(held), pivots), []
                    for at in range(0, len(part) if unit is not None else 0, _STEP):
                        found = [(a, b, x, max(-_LONG, min(_LONG, s))) for a, b, x, s in how(unit, part.slice(at, _STEP))]
                        columns = list(zip(*found, strict=True)) or [[]] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "band", "row_id", "score"])

        return sides.mapInArrow(meet, FOUND_SCHEMA)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, vector).

    Anchors are the rows for which `anchor` holds. Each anchor's positives are the `positives` best rows of its label,
    and each positive's negatives the `negatives` best rows of other labels whose score is LEAST_PERCENT to MOST_PERCENT
    of its own, ties to the smaller vec_id. Nothing is estimated: brackets only leave out rows that cannot count. Cells
    with more than about UNIT_ROWS rows are dealt over units, so that no label, cell or copy has a task of its own.

    Defined cases: vec_ids are unique, components whole numbers (quantised()); vectors of another length than the
    commonest (the shorter, if tied) take no part; an anchor without positives and a positive without negatives have no
    rows; a positive with a negative score has no band; scores beyond a long are its ends; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    store = PivotTable(vectors.select("vec_id", "label", "vector"))
    if store.rows is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    nothing = F.array().cast("array<long>")
    anchors = store.rows.where(anchor).withColumns({"lows": nothing, "highs": nothing})
    best = _merged(store.search(anchors, lambda unit, some: unit.best(some, positives)), positives)
    best = written(best.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("rank").alias("band"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(p * LEAST_PERCENT / 100), F.floor(p * MOST_PERCENT / 100)
    bands = best.where(low <= high).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("band", low.cast("long").alias("low"), high.cast("long").alias("high")))).alias("bands"))
    asked = anchors.drop("lows", "highs").join(bands, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", F.col("bands.band").alias("of"), F.col("bands.low").alias("lows"), F.col("bands.high").alias("highs"))
    asked = written(asked, "bands")
    found = _merged(store.search(asked, lambda unit, some: unit.within(some, negatives)), negatives)
    # a band is a place in the anchor's list
    order = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode("of").alias("place", "band"))
    named = best.join(order, ["anchor_id", "band"]).select("anchor_id", F.col("place").alias("band"), "positive_id", "positive_score")
    return found.join(named, ["anchor_id", "band"]).select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and band over all units, with their rank from 1."""
    order = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("int"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(quantised(moved), F.col("vec_id") % 50 == 0)
