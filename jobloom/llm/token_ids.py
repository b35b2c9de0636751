"""Token-ID / binary output: shards of Simple-8b segments in ascending doc_id order.

A shard is a range of doc_id; its segments hold whole documents, about SEGMENT_IDS ids each, as the
bytes of simple8b.encode() next to the index of their documents. Segments are rows of a Parquet table,
so Spark's commit protocol keeps half-written shards of lost executors out.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; rows of one
doc_id are separate documents, ordered by text; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import simple8b
from jobloom.llm.scratch import new_path, table
from jobloom.llm.tokenizing import END_ID, encoder, word_bpe_path

SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "shard long, segment long, first_id long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_token_file(docs: DataFrame, path: str, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of docs (doc_id, text), each document's followed by END_ID, as shards at path.

    One shuffle, of the texts by ranges of doc_id; ids are made after it and never shuffled.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        shard, held, ids, first, number = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            joined = np.concatenate(ids)
            columns = [[shard], [number], [first], [len(joined)], [held], [[len(x) for x in ids]], [simple8b.encode(joined)]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        waiting = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode(text.as_py())
                held.append(doc_id)
                ids.append(np.append(got, got.dtype.type(END_ID)))
                waiting += len(got) + 1
                if waiting >= segment_ids:
                    yield flush()
                    first, number, waiting = first + waiting, number + 1, 0
                    held.clear()
                    ids.clear()
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # the payload is packed already
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """The file's segments, as they are stored."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def segment_documents(payload: bytes, n_tokens: list[int]) -> list[np.ndarray]:
    """The ids of each document of a segment, as unsigned 32-bit integers."""
    ids = simple8b.decode(payload).astype("<u4")
    return np.split(ids, np.cumsum(n_tokens)[:-1])


def token_file_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file.

    Only one row a shard goes to the driver: the number of ids in it.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = segment_documents(row["payload"], row["n_tokens"])
                counts = np.array(row["n_tokens"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(docs), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["first_id"] + np.cumsum(counts) - counts, pa.int64()),
                        pa.array([len(x) for x in docs], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64()),
                    ],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    file = read_token_file(spark, path)
    totals = sorted(file.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for shard, n in totals:
        starts.append((shard, total))
        total += n
    shards = spark.createDataFrame(starts, "shard long, shard_start long")
    docs = file.mapInArrow(digests, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    start = (F.col("shard_start") + F.col("at")).alias("start")
    return docs.join(F.broadcast(shards), "shard").select("doc_id", start, "n_tokens", "ids_crc32")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents", "doc_id", "text"), path, word_bpe_path())
    return token_file_documents(spark, path)
