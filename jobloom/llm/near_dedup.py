"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

A document's set of word shingles is sketched in COORDINATES places. In round i every shingle is
hashed to one place and a value that no later round can beat; after COORDINATES such rounds, round
COORDINATES + i puts every shingle in place i, so all places fill. The share of equal places
estimates the similarity within the bounds of as many independent minima.

Documents with equal sets are one class. Classes that agree in one of BANDS bands of the sketch are
candidates; buckets of the same members count once. In each bucket all are held against the smallest,
and where that leaves some apart, these against each other, by sketch alone and in bounded units. The
sets of documents that may have a partner so are then read from the texts, once, and every pair is
confirmed on them. At the least similarity of a link, 0.8, a pair shares no band with
chance (1 - 0.8^4)^32, less than 5e-8, and has fewer than LEAST_EQUAL equal places with less than 1e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.scratch import discard, table, written

SHINGLE_WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
COORDINATES = 128
BANDS = 32
#: Equal places that a pair needs for its sets to be read: 0.8 of 128 is 102, seven deviations above.
LEAST_EQUAL = 70
#: Members of a bucket that one side of a unit holds.
UNIT_ROWS = 2048
#: Shingles of them, eight bytes each.
UNIT_SHINGLES = 1 << 22
#: Bytes of texts that are hashed at once, and of a batch of texts that is shingled at once (a longer text goes alone).
SLICE = 1 << 18
BATCH_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64

_PLACE_BITS = COORDINATES.bit_length() - 1
_LOW = np.uint64((1 << (56 - _PLACE_BITS)) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(n: int, stream: int) -> np.ndarray:
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream << 32)) * np.uint64(0x9E3779B97F4A7C15))


_ROUNDS = _keys(2 * COORDINATES, 1)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: A random value of each byte (a letter's two cases share it), and powers of an odd base that place it in its word.
_BYTES = _keys(256, 2)[list(_LOWER)]
_BASE = 0x9DDFEA08EB382D6B


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _long_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.translate(_LOWER), digest_size=8).digest(), "little")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each begins and ends in them; null as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    return flat, at - at[0]


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts at[i]..at[i + 1] of flat, and each word's text.

    A word's bytes are a polynomial in powers of an odd base, so that two running sums give it; words of
    more than LONG_WORD bytes, for which such sums are weak, get a digest.
    """
    edge = _WHITE[flat]
    begins = ~edge
    begins[1:] &= edge[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = ~edge[first]
    starts = np.flatnonzero(begins)
    ends_mask = ~edge
    ends_mask[:-1] &= edge[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends_mask[last] = ~edge[last]
    ends = np.flatnonzero(ends_mask) + 1
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    k = 0
    while k < len(starts):
        # words whole in one slice; a longer one alone is left to the digest
        low = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
        a, b = starts[k:stop] - low, np.minimum(ends[k:stop] - low, SLICE)
        part = flat[low : low + b[-1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        out[k:stop] = (sums[b] - sums[a]) * _DOWN[a]
        k = stop
    out = _mixed(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in long:
        out[k] = _long_word(flat[starts[k] : ends[k]].tobytes())
    return out, np.searchsorted(at, starts, side="right") - 1


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingles, bounds) of batches of a column of texts: text first + i has shingles[bounds[i] : bounds[i + 1]].

    These are the sorted 64-bit hashes of its distinct shingles; with fewer words, of all of them as one.
    """
    flat, at = _flat(column)
    first = 0
    while first < len(at) - 1:
        stop = max(first + 1, int(np.searchsorted(at, at[first] + BATCH_BYTES, side="right")) - 1)
        here = at[first : stop + 1] - at[first]
        hashes, text = word_hashes(flat[at[first] : at[stop]], here)
        n_words = np.bincount(text, minlength=stop - first)
        begins = np.cumsum(n_words) - n_words
        counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], np.uint64)
        for take in range(1, size + 1):
            some = np.flatnonzero(n_words == take) if take < size else np.flatnonzero(n_words >= size)
            if not len(some):
                continue
            odd = _keys(take, 1000 + take) | np.uint64(1)
            n = counts[some]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = np.repeat(begins[some], n) + within
            mixed = hashes[word] * odd[0]
            for k in range(1, take):
                mixed = _mixed(mixed) + hashes[word + k] * odd[k]
            out[np.repeat(bounds[some], n) + within] = _mixed(mixed)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[a:b].sort()
        fresh = np.ones(len(out), bool)
        fresh[1:] = out[1:] != out[:-1]
        fresh[bounds[:-1][counts > 0]] = True
        yield first, out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]
        first = stop


def sketches_of(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(n, COORDINATES) 16-bit values of the sets shingles[bounds[i] : bounds[i + 1]]; those of an empty set mean nothing."""
    n = np.diff(bounds)
    found = np.full(len(n) * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(n)) * COORDINATES, n)
    left, place_shift = shingles, np.uint64(64 - _PLACE_BITS)
    for round_ in range(2 * COORDINATES):
        hashed = _mixed(left ^ _ROUNDS[round_])
        places = owner + ((hashed >> place_shift).astype(np.int64) if round_ < COORDINATES else round_ - COORDINATES)
        # the round before the value: a later round is never smaller
        values = np.uint64(round_ << 56) | ((hashed >> np.uint64(8)) & _LOW)
        np.minimum.at(found, places, values)
        empty = (found.reshape(-1, COORDINATES) == np.iinfo(np.uint64).max).any(axis=1)
        more = empty[owner // COORDINATES]
        left, owner = left[more], owner[more]
        if not len(left):
            break
    return (_mixed(found) >> np.uint64(48)).astype("<u2").reshape(-1, COORDINATES)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The shingles of one text."""
    ((_, shingles, _),) = shingle_sets(pa.array([text], pa.string()), size)
    return shingles


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES values of one set that is not empty."""
    return sketches_of(shingles, np.array([0, len(shingles)]))[0]


SKETCH_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_hash binary, sketch array<long>"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """SKETCH_SCHEMA rows of docs (doc_id, text); set_hash and sketch are null for texts without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shingles, bounds in shingle_sets(batch.column(2), size):
                counts = np.diff(bounds)
                marks = sketches_of(shingles, bounds).view("<i8")
                hashes = [set_hash(shingles[a:b]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1) * BANDS, pa.int32()), pa.array(marks.reshape(-1)), mask=pa.array(counts == 0))
                ids, texts = (batch.column(k).slice(first, len(counts)) for k in (0, 1))
                columns = [ids, texts, pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_hash", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(of, SKETCH_SCHEMA)


def set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(values.flatten().to_numpy()).view("<u2").reshape(-1, COORDINATES)


def similar_by_sketch(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link. nodes: node, n_shingles, sketch."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_sketch_matrix(batch.column("sketch_a")) == _sketch_matrix(batch.column("sketch_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= LEAST_EQUAL))

    sizes = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes)
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(keep, "a long, b long")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and shingles (the bytes of its sorted set) of the distinct nodes in wanted, read from docs; a written table.

    Rows that repeat a doc_id and its text give the set once: those of one task are told apart there, and
    only if several tasks had such rows are the sets dealt again.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, shingles, bounds in shingle_sets(batch.column(1), size):
                found: list[tuple[int, bytes]] = []
                for k in range(len(bounds) - 1):
                    mine = shingles[bounds[k] : bounds[k + 1]]
                    if node[first + k] not in seen and set_hash(mine) == hashes[first + k]:
                        seen.add(node[first + k])
                        found.append((node[first + k], mine.tobytes()))
                columns = [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    wanted = wanted.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash", "set_hash"), "node")
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    # the narrow side is hashed, so that texts need no sort
    read = read.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("node", "text", "set_hash")
    out = written(read.mapInArrow(sets, "node long, shingles binary"), "shingle-sets")
    if out.groupBy("node").count().where("count > 1").isEmpty():
        return out
    once = written(out.dropDuplicates(["node"]), "shingle-sets")
    discard(out)
    return once


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that link by their full sets (known: node, shingles); a written table."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in sets)) for sets in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    side = lambda x: known.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")
    return written(both.mapInArrow(link, "a long, b long"), "links")


def components(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """node, component (its smallest node) of every node of links (a, b), and the tables that hold them.

    Each round maps every node with a smaller neighbour to its smallest one, follows these maps to
    their ends by doubling, and maps links likewise; links within one node then go. Only nodes
    smaller than all their neighbours are left, at most half of the linked ones.
    """
    label = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    label = written(label.withColumn("component", F.col("node")), "labels")
    tables, edges = [label], None
    left = links
    while True:
        ordered = left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        ordered = written(ordered, "edges")
        if edges is not None:
            discard(edges)
        edges = ordered
        if edges.isEmpty():
            discard(edges)
            return label, tables
        lower = _ends(edges.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "from"))
        to = lambda x: lower.select(F.col("from").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: E731,B023
        moved = label.join(to("component"), "component", "left")
        moved = written(moved.select("node", F.coalesce("to_component", "component").alias("component")), "labels")
        left = edges.join(to("a"), "a").join(to("b"), "b", "left").select(F.col("to_a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        left = written(left, "edges")
        discard(edges, tables.pop(), lower)
        label, edges = moved, left
        tables.append(label)


def _ends(steps: DataFrame) -> DataFrame:
    """from and the last `to` of the path of steps (from, to) that begins there; steps lead to smaller nodes."""
    steps = written(steps, "lower")
    while True:
        onward = steps.select(F.col("from").alias("to"), F.col("to").alias("onward"))
        doubled = steps.join(onward, "to", "left").select("from", F.coalesce("onward", "to").alias("to"), F.col("onward").isNotNull().alias("went_on"))
        doubled = written(doubled, "lower")
        discard(steps)
        steps = doubled
        if steps.where("went_on").isEmpty():
            return steps


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """members (key, node, ...) in units key, low, high: `parts` parts of a bucket, of which every two meet."""
    dealt = members.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")


def _by_unit(dealt: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What compare() makes of the rows of each unit, one unit at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            unit = np.stack([batch.column(x).to_numpy() for x in ("key", "low", "high")])
            cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                now = tuple(unit[:, begin].tolist())
                if held and now != key:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(begin, end - begin))
        if held:
            yield compare(pa.Table.from_batches(held))

    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(stream, schema)


def _alike(rows: pa.Table, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit, the likest first, whose sizes and sketches allow a link and whose `apart` values allow it.

    Rows with apart -1 may meet all others, and others only rows of another value.
    """
    low, part, node, n = (rows[x].to_numpy() for x in ("low", "part", "node", "n_shingles"))
    marks = _sketch_matrix(rows["sketch"])
    own = rows["high"][0].as_py() == low[0]
    left = np.flatnonzero(part == low[0])
    right = left if own else np.flatnonzero(part != low[0])
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        may = (apart[some][:, None] != apart[right]) | (apart[some][:, None] < 0)
        may &= 100 * np.minimum(n[some][:, None], n[right]) >= PERCENT * np.maximum(n[some][:, None], n[right])
        i, j = np.nonzero(may & (node[some][:, None] < node[right]) if own else may)
        x, y = some[i], right[j]
        equal = np.concatenate([(marks[x[k : k + 65_536]] == marks[y[k : k + 65_536]]).sum(axis=1) for k in range(0, max(len(x), 1), 65_536)])
        order = np.argsort(-equal, kind="stable")[: int((equal >= LEAST_EQUAL).sum())]
        yield x[order], y[order]


def _with_partners(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of members (key, node, beside, n) with a partner by sketch in their bucket; two that are beside its hub do not count."""

    def partners(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].to_numpy()
        found = [np.zeros(0, np.int64)]
        for x, y in _alike(rows, np.where(rows["beside"].to_numpy(zero_copy_only=False), 0, -1)):
            found.append(np.unique(np.concatenate([node[x], node[y]])))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)), pa.int64())], ["node"])

    dealt = _dealt(members, F.ceil(F.col("n") / UNIT_ROWS)).drop("n").join(nodes.select("node", "n_shingles", "sketch"), "node")
    return _by_unit(dealt, partners, "node long").distinct()


def _units(members: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) that join components of one bucket: of each unit a forest, not all its links.

    members: key, node, component, n and shingles (members of the bucket and the sum of their sets' sizes);
    known: node, shingles. A bucket is cut into parts of about UNIT_ROWS and UNIT_SHINGLES, and every two
    parts meet in a unit, so a bucket of any size is compared in full, in bounded memory. Pairs never leave
    the unit: those alike by sketch are confirmed on their sets there, the likest first, unless links have
    joined the two already.
    """
    parts = F.greatest(F.ceil(F.col("n") / UNIT_ROWS), F.ceil(F.col("shingles") / UNIT_SHINGLES))
    dealt = _dealt(members, parts).drop("n", "shingles")
    dealt = dealt.join(nodes.select("node", "n_shingles", "sketch"), "node").join(known, "node")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        group = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        links: list[tuple[int, int]] = []
        for x, y in _alike(rows, group):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if group[i] != group[j] and linked(sets[i], sets[j]):
                    links.append((int(node[i]), int(node[j])))
                    group[group == group[j]] = group[i]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_unit(dealt, compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    component_id is the smallest doc_id of the component; one of its rows, which has it, is kept.
    Defined cases: a text without words (null, empty, white space) has the empty set and is linked with
    nothing; texts of any length are read whole, a long one alone; a row without doc_id is linked with
    nothing, has no component and is kept; rows that repeat a doc_id belong each to the component of their
    own text, and two components whose smallest doc_id is the same one show it both; other columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    known = written(sketches(docs, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = known.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    first = F.row_number().over(Window.partitionBy("set_hash").orderBy("doc_id", "row"))
    # a class goes by the number of its first row: other classes may have its doc_id
    nodes = some.withColumn("first", first).where("first = 1").withColumnRenamed("row", "node").drop("first")
    nodes = written(nodes, "classes")
    bands = nodes.select("node", F.posexplode("sketch").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node")
    # most bands are one document's alone: only counts of them are shuffled before the others are looked at
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(bands.join(shared, "key"), "shared-bands")
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in (0, 1)]
    buckets = shared.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n"), *same)
    # bands that put the same members together are one bucket
    buckets = buckets.groupBy("hub", "n", "same0", "same1").agg(F.min("key").alias("key")).select("key", "hub")
    members = written(shared.join(buckets, "key").where("node <> hub"), "buckets")
    pairs = written(similar_by_sketch(members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes), "pairs")
    beside = pairs.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(True).alias("beside"))
    members_by = members.join(beside, ["hub", "node"], "left").select("key", "node", F.coalesce("beside", F.lit(False)).alias("beside"))
    # buckets of two or more besides the hub, some of which are not beside it
    loose = members_by.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("beside").alias("all")).where("n > 1 AND NOT all").drop("all")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    partners = _with_partners(members_by.join(loose, "key"), nodes)
    known_sets = sets_of(ends.unionByName(partners), nodes, docs, size)
    links = confirmed(pairs, known_sets)
    labels, tables = components(links)
    split = members.join(known_sets.select("node"), "node", "left_semi").join(labels, "node", "left")
    # the hub is set aside: all were held against it
    split = split.select("key", "node", F.coalesce("component", "node").alias("component")).join(nodes.select("node", "n_shingles"), "node")
    differ = (F.min("component") < F.max("component")).alias("open")
    open_ = split.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), differ).where("open").drop("open")
    split = written(split.select("key", "node", "component").join(open_, "key"), "open-buckets")
    spent = [shared, members, pairs, links, split, known_sets]
    if not split.isEmpty():
        more = written(_units(split, nodes, known_sets), "links")
        spent.append(more)
        if not more.isEmpty():
            discard(*tables)
            labels, tables = components(links.unionByName(more))
    discard(*spent)
    linked = nodes.select("set_hash", "node", "doc_id").join(labels, "node", "left")
    linked = linked.select("set_hash", "doc_id", "node", "component")
    alone = linked.where("component IS NULL").select("set_hash", F.struct("doc_id", "node").alias("first"))
    linked = linked.where("component IS NOT NULL")
    firsts = linked.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    linked = linked.select("set_hash", "component").join(firsts, "component").select("set_hash", "first").unionByName(alone)
    out = known.select("doc_id", "n_shingles", "set_hash", "row").join(linked, "set_hash", "left")
    has_id = F.col("doc_id").isNotNull()
    component = F.when(has_id, F.coalesce("first.doc_id", "doc_id")).alias("component_id")
    kept = F.when(has_id, F.coalesce(F.col("row") == F.col("first.node"), F.lit(True))).otherwise(True).alias("kept")
    out = written(out.select("doc_id", "n_shingles", component, kept), "near-duplicates")
    discard(known, nodes, *tables)
    return out


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here a row is kept if its document is its component's smallest, so that rows which repeat that one are kept all; one without an id is kept."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=4)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
