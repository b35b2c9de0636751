"""Document fingerprints: a digest of quartile codes over buckets of hashed byte triplets.

Every window of four bytes gives three triplets; tabulation hashing puts each in one of BUCKETS
buckets. The digest holds a code of the length, two ratios of the quartiles of the bucket counts,
and for each bucket the quartile (0 to 3) that its count falls in. Two digests differ by at most
MOST_DIFFERENT points, and likeness() is 1 less their share of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.scratch import table

BUCKETS = 128
HEADER = 3
LENGTH_STEP = math.log(1.15)
#: Points for two bucket codes that are 0 to 3 apart, and for the header's three numbers.
CODE_POINTS = np.array([0, 1, 2, 6])
LENGTH_POINTS = 60
RATIO_POINTS = 15
MOST_DIFFERENT = BUCKETS * int(CODE_POINTS[-1]) + LENGTH_POINTS + 2 * RATIO_POINTS
#: Random bucket numbers of each byte, one table for each place in a triplet.
_TABLES = np.random.Generator(np.random.PCG64(20240607)).integers(0, BUCKETS, (3, 256), dtype=np.uint8)
#: Offsets of each triplet in its window, and what tells the triplets of the kinds apart.
_KINDS = (((0, 1, 2), 0), ((0, 1, 3), 41), ((0, 2, 3), 86))
_SLICE = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket over the whole of data, a slice at a time."""
    counts = np.zeros(BUCKETS, np.int64)
    view = np.frombuffer(data, np.uint8)
    for begin in range(0, max(len(view) - 2, 0), _SLICE):
        part = view[begin : begin + _SLICE + 3]
        hashed = [t[part] for t in _TABLES]
        for (a, b, c), salt in _KINDS:
            n = min(len(part) - c, _SLICE)
            if n > 0:
                where = hashed[0][a : a + n] ^ hashed[1][b : b + n] ^ hashed[2][c : c + n]
                found = np.bincount(where, minlength=BUCKETS)
                counts[np.arange(BUCKETS) ^ salt] += found
    return counts


def digest(text: str | None) -> str:
    """The fingerprint as hexadecimal: length, two ratios, then two bits a bucket. Null counts as empty."""
    data = (text or "").encode()
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    length = min(255, round(math.log1p(len(data)) / LENGTH_STEP))
    ratios = (q1 * 15 // q3, q2 * 15 // q3) if q3 else (0, 0)
    return bytes([length, *ratios, *np.bitwise_or.reduce(packed, axis=1).tolist()]).hex()


def _parts(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    codes = (raw[HEADER:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return raw[:HEADER].astype(np.int64), codes.reshape(-1).astype(np.int64)


def difference(one: str, other: str) -> int:
    """0 for equal digests, MOST_DIFFERENT at most."""
    (head, codes), (head2, codes2) = _parts(one), _parts(other)
    apart = np.abs(head - head2)
    return int(
        CODE_POINTS[np.abs(codes - codes2)].sum()
        + min(4 * int(apart[0]), LENGTH_POINTS)
        + sum(min(int(x), RATIO_POINTS) for x in apart[1:])
    )


def likeness(one: str, other: str) -> float:
    return 1.0 - difference(one, other) / MOST_DIFFERENT


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FOLLOWED_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def followed_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text) and of its edit with the next text by doc_id.

    Only doc_id is sampled for the ranges; the texts are shuffled once. The first document of a range
    goes to the range before it as well, so that no task needs another's rows; the last one is
    followed by the first.

    Defined cases: a null text counts as empty; rows of one doc_id follow each other in order of
    their texts; a row without doc_id has no place in the order and is followed by itself; one
    document alone is followed by itself; a text of any length is digested whole, a slice at a time;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fractions = [k / parts for k in range(1, parts)] or [0.5]
    bounds_of = F.percentile_approx("doc_id", fractions, max(10_000, 20 * parts))
    found = docs.agg(F.min("doc_id").alias("first"), bounds_of.alias("bounds")).first()
    first = found["first"]
    bounds = sorted({x for x in found["bounds"] or [] if x > first})
    here = F.col("doc_id")
    passed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= here)) if bounds else F.lit(0)
    at = lambda part, tail, when: F.struct(part.cast("int").alias("part"), F.lit(tail).cast("boolean").alias("tail"), when.alias("is"))
    # the range of a document, and the ranges that it ends as well: the one before, of whose next range it is the first, and the last
    begins = here.isin(bounds) if bounds else F.lit(False)
    places = F.array(at(passed, False, F.lit(True)), at(passed - 1, True, begins), at(F.lit(len(bounds)), True, here == F.lit(first)))
    # documents without a place in the order are dealt by their texts
    dealt_by_text = F.pmod(F.xxhash64("text"), F.lit(len(bounds) + 1))
    places = F.when(here.isNull(), F.array(at(dealt_by_text, None, F.lit(True)))).otherwise(F.filter(places, lambda x: x["is"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOLLOWED_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows: list[tuple] = []
        held: tuple | None = None

        def row(one: tuple, following: tuple) -> tuple:
            text = edited(one[1], following[1])
            code = digest(text)
            sha = hashlib.sha256(text.encode()).hexdigest()
            return one[0], len(one[1]), sha, one[2], code, likeness(one[2], code), likeness(one[2], following[2])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        ended = False
        for batch in batches:
            for doc_id, text, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if ended and tail:
                    continue  # of rows that share the next range's first doc_id, the first alone counts
                text = text.as_py()
                one = (doc_id, text, digest(text))
                if tail is None:
                    rows.append(row(one, one))
                else:
                    if held is not None:
                        rows.append(row(held, one))
                    held, ended = one, tail
            if rows:
                yield batch_of(rows)
                rows = []

    dealt = docs.select(F.explode(places).alias("at"), "doc_id", "text").select("doc_id", "text", "at.part", "at.tail")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions(F.col("tail").asc_nulls_first(), "doc_id", "text")
    return dealt.select("doc_id", "text", "tail").mapInArrow(compare, FOLLOWED_SCHEMA)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followed_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
