"""Best-fit packing of documents into token sequences, certified by dual feasible functions.

Pieces are dealt to groups of about GROUP_PIECES, and each group is packed by best-fit decreasing. Dual
feasible functions of its lengths bound its bins from below. Of a group at its bound the emptiest bin stays
open, as the bound is rounded up, and bins with more than ROOM to spare, which pieces of other groups
may fill; of a group with a gap, all its bins. The
pieces of open bins are exchanged: dealt anew to fewer groups, twice as large from round to round, which pack again, until the open bins
meet their common bound or MOST_ROUNDS is reached. certificate() gives the bins and the bound of a result.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.scratch import discard, table, written
from jobloom.llm.tokenizing import END_ID, encoder, word_bpe_path

CAPACITY = 4096
GROUP_PIECES = 32_768
MOST_ROUNDS = 4
#: Share of a bin.
ROOM = 0.05
#: Parameters k of the functions u(k) that the bound tries.
ROUNDING = range(1, 33)

_log = logging.getLogger(__name__)

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins for counts[l] pieces of each length l, by the best of three families of dual feasible functions.

    A dual feasible function maps lengths that fit in one bin together to values that do so too, so
    the sum of the values bounds the bins of any packing. The families: the identity; U(e), which
    counts lengths above capacity - e as a whole bin and below e as nothing; and u(k), which rounds
    down to multiples of capacity / k whatever is no multiple of capacity / (k + 1).
    """
    lengths = np.arange(capacity + 1, dtype=np.int64)
    counts = np.asarray(counts, np.int64)
    weight = counts * lengths
    best = -(-int(weight.sum()) // capacity)
    pieces, weights = np.cumsum(counts), np.cumsum(weight)
    e = np.arange(1, capacity // 2 + 1)
    whole = pieces[-1] - pieces[capacity - e]
    values = whole * capacity + weights[capacity - e] - weights[e - 1]
    best = max(best, int((-(-values // capacity)).max()))
    for k in ROUNDING:
        scaled = lengths * (k + 1)
        # in units of capacity * k, so that all stays whole
        values = np.where(scaled % capacity == 0, lengths * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * values).sum()) // (capacity * k)))
    return int(best)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; a piece goes where least room is left after it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r: some bin has room for r
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            room, bin_, n = capacity, n, n + 1
        bins[k], offsets[k] = bin_, capacity - room
        if room > length:
            with_room[room - length].append(bin_)
            mask |= 1 << (room - length)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECE_SCHEMA rows of docs (doc_id, text): each document's ids and END_ID, cut only where longer than capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset.

    pieces is a written table in PIECE_SCHEMA. A group is packed in one task, and holds about group_pieces
    pieces in the first round and 2 ** (most_rounds - 1) times as many in the last.
    To the driver go the counts of the open pieces by length, capacity rows at most.
    """
    schema = f"{PIECE_SCHEMA}, sequence_id long, offset long, open boolean"

    def packed(rows: DataFrame, n: int, round_: int) -> DataFrame:
        groups = -(-n // (group_pieces << round_))

        def place(found: pa.Table) -> pa.Table:
            lengths = found["length"].to_numpy()
            group = found["group"][0].as_py()
            bins, offsets = best_fit_decreasing(lengths, capacity)
            fill = np.bincount(bins, lengths).astype(np.int64)
            gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            # full bins of a group with a gap may hold just the short pieces that its long ones lack
            open_ = np.ones(len(fill), bool)
            if not gap:
                open_ = (fill < (1 - ROOM) * capacity) | ((np.arange(len(fill)) == np.argmin(fill)) & (fill < capacity))
            # round, group and bin in one number
            sequence = (round_ << 56) + (group << 24) + bins
            out = found.select([x.split()[0] for x in PIECE_SCHEMA.split(", ")])
            for name, values in (("sequence_id", sequence), ("offset", offsets), ("open", open_[bins])):
                out = out.append_column(name, pa.array(values))
            return out

        # by the number of the row: rows may be alike in all columns
        group = F.pmod(F.xxhash64(F.lit(round_), F.monotonically_increasing_id()), F.lit(groups))
        dealt = rows.withColumn("group", group).groupBy("group").applyInArrow(place, schema)
        return written(dealt, f"packed-{round_}")

    done: list[DataFrame] = []
    rows, n = pieces, pieces.count()
    for round_ in range(max(1, most_rounds)):
        got = packed(rows, max(n, 1), round_)
        left = got.where("open")
        counts = np.zeros(capacity + 1, np.int64)
        for length, count in left.groupBy("length").count().collect():
            counts[length] = count
        bins, bound = left.where("offset = 0").count(), lower_bound(counts, capacity)
        _log.info("round %d: %d pieces in %d open bins, bound %d", round_, int(counts.sum()), bins, bound)
        if round_ == most_rounds - 1 or bins <= bound:
            done.append(got)
            break
        done.append(got.where("not open"))
        rows, n = left.select(pieces.columns), int(counts.sum())
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")


@dataclass(frozen=True)
class Certificate:
    """Bins of a packing and the fewest that any packing of its pieces could have; gap is their difference."""

    bins: int
    bound: int

    @property
    def gap(self) -> int:
        return self.bins - self.bound


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> Certificate:
    """The certificate of a packed table over all its pieces. Counts by length go to the driver, capacity rows at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return Certificate(packed.where("offset = 0").count(), lower_bound(counts, capacity) if counts.any() else 0)


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Defined cases: a null or empty text is a piece with the end id alone; rows of one doc_id are
    separate documents, dealt to groups by their own numbers however alike they are; a text of any length
    is encoded whole and cut; a null doc_id is kept; other columns are ignored; an empty table gives an
    empty result.
    """
    pieces = written(token_pieces(docs, tokenizer), "pieces")
    out = pack(pieces)
    discard(pieces)
    return out


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), word_bpe_path())
