"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into blocks of BLOCK; a chunk is two blocks in a row, so chunks overlap by
half and cover the whole document. A chunk's channels are learned embeddings of its bytes and, for
each of LAGS distances, the share of its bytes that equal the byte so far before. FILTERS learned
filters over them are rectified, max-pooled over all chunks and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.scratch import table

BLOCK = 16
LAGS = 24
EMBEDDING = 6
FILTERS = 24
#: Zero blocks after each text, so that no lag reaches the text before it.
GAP_BLOCKS = 2
#: Texts are scored together up to so many bytes, and longer ones in slices of as many.
SLICE = 1 << 20
#: Training: labelled rows of each class, the smallest by hash, and the longest text among them.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 1 << 16
#: Bytes of all texts that training may collect.
SAMPLE_BYTES = 1 << 26
BATCH = 32
#: Gradient steps, over as many passes as it takes.
STEPS = 600
RATE = 0.004
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBEDDING)
    first: np.ndarray  # filters over the chunk's first block
    second: np.ndarray
    lags: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        wide = BLOCK * EMBEDDING
        return Network(
            draw(256, EMBEDDING, scale=0.5), draw(wide, FILTERS, scale=0.07), draw(wide, FILTERS, scale=0.07), draw(LAGS, FILTERS, scale=0.3),
            np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.3), np.zeros(1, np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.lags, self.bias, self.out, self.out_bias]


@dataclass
class Blocks:
    """Texts laid out in blocks: bytes (n, BLOCK), shares of equal bytes (n, LAGS), and each text's rows."""

    bytes: np.ndarray
    equal: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def layout(texts: list[bytes], skip: int = 0, drop: int = 0) -> Blocks:
    """Blocks of the texts; the first `skip` and last `drop` blocks of each are context only and no text's rows."""
    sizes = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    firsts = GAP_BLOCKS + np.cumsum(sizes + GAP_BLOCKS) - (sizes + GAP_BLOCKS)
    flat = np.zeros((int(firsts[-1] + sizes[-1]) + GAP_BLOCKS) * BLOCK, np.uint8)
    for first, text in zip(firsts, texts, strict=True):
        flat[first * BLOCK : first * BLOCK + len(text)] = np.frombuffer(text, np.uint8)
    margin = GAP_BLOCKS * BLOCK
    equal = np.zeros((len(flat) // BLOCK, LAGS), np.float32)
    present = flat[margin:] != 0
    for lag in range(1, LAGS + 1):
        same = (flat[margin:] == flat[margin - lag : -lag]) & present
        # eight bytes at once: each is 0 or 1, and the product adds them up in the top byte
        eights = (same.view(np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
        equal[GAP_BLOCKS:, lag - 1] = eights[0::2] + eights[1::2]
    equal /= 2 * BLOCK
    return Blocks(flat.reshape(-1, BLOCK), equal, firsts + skip, firsts + sizes - drop)


def activations(net: Network, blocks: Blocks) -> np.ndarray:
    """Rectified filter outputs of the chunk that begins at each block but the last."""
    embedded = net.embed[blocks.bytes].reshape(len(blocks.bytes), -1)
    out = embedded[:-1] @ net.first
    out += embedded[1:] @ net.second
    out += (blocks.equal[:-1] + blocks.equal[1:]) @ net.lags
    out += net.bias
    return np.maximum(out, 0, out=out)


def pooled(net: Network, blocks: Blocks) -> np.ndarray:
    found = activations(net, blocks)
    return np.stack([found[a:b].max(axis=0) for a, b in zip(blocks.begins, blocks.ends, strict=True)])


def _probability(net: Network, pools: np.ndarray) -> np.ndarray:
    logits = pools @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    pools = np.empty((len(texts), FILTERS), np.float32)
    waiting: list[int] = []
    size = 0

    def flush() -> None:
        if waiting:
            pools[waiting] = pooled(net, layout([texts[k] for k in waiting]))
            waiting.clear()

    for k, text in enumerate(texts):
        if len(text) > SLICE:
            lead = GAP_BLOCKS * BLOCK
            parts = []
            for at in range(0, len(text), SLICE):
                # the blocks before are there for the lags, the block after for the last chunk
                part = text[max(0, at - lead) : at + SLICE + BLOCK]
                blocks = layout([part], skip=GAP_BLOCKS if at else 0, drop=int(at + SLICE < len(text)))
                parts.append(pooled(net, blocks))
            pools[k] = np.concatenate(parts).max(axis=0)
            continue
        waiting.append(k)
        size += len(text)
        if size >= SLICE:
            flush()
            size = 0
    flush()
    return _probability(net, pools)


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """Adam on the log loss; the gradient of a pooled filter reaches only the chunk that it was largest in."""
    net = Network.new(seed)
    if len(set(labels)) < 2:
        # nothing to tell apart: the share of label 1, or one half
        net.out[:] = 0
        net.out_bias[:] = 4.0 * (np.mean(labels) - 0.5) if labels else 0.0
        return net
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    wanted = np.array(labels, np.float32)
    weight = np.where(wanted == 1, 0.5 / wanted.mean(), 0.5 / (1 - wanted.mean())).astype(np.float32)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    step = 0
    passes = -(-STEPS * BATCH // len(texts))
    total = passes * -(-len(texts) // BATCH)
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            blocks = layout([texts[k] for k in rows])
            found = activations(net, blocks)
            best = np.stack([a + found[a:b].argmax(axis=0) for a, b in zip(blocks.begins, blocks.ends, strict=True)])
            pools = np.take_along_axis(found, best, axis=0)
            wrong = ((_probability(net, pools) - wanted[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = (wrong[:, None] * net.out) * (pools > 0)
            grads = [np.zeros_like(a) for a in net.arrays()]
            where, which = best.reshape(-1), np.tile(np.arange(FILTERS), len(rows))
            flow = back.reshape(-1)
            for half, (filters, grad) in enumerate(((net.first, grads[1]), (net.second, grads[2]))):
                seen = blocks.bytes[where + half]
                np.add.at(grad.T, which, flow[:, None] * net.embed[seen].reshape(len(where), -1))
                np.add.at(grads[0], seen.reshape(-1), (flow[:, None] * filters.T[which]).reshape(-1, EMBEDDING))
            np.add.at(grads[3].T, which, flow[:, None] * (blocks.equal[where] + blocks.equal[where + 1]))
            grads[4] += back.sum(axis=0)
            grads[5] += wrong @ pools
            grads[6] += wrong.sum()
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for value, grad, (m, v) in zip(net.arrays(), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    _calibrate(net, texts, wanted, weight)
    return net


def _calibrate(net: Network, texts: list[bytes], wanted: np.ndarray, weight: np.ndarray) -> None:
    """Scales and shifts the logits to fit the labels, by Newton steps: pooled filters separate better than few steps make sure of."""
    shares = scores(net, texts)
    logits = np.log(np.clip(shares, 1e-12, 1)) - np.log(np.clip(1 - shares, 1e-12, 1))
    inputs = np.column_stack([logits, np.ones_like(logits)])
    best = np.array([1.0, 0.0])
    for _ in range(25):
        got = 1 / (1 + np.exp(-np.clip(inputs @ best, -40, 40)))
        slope = inputs.T @ (weight * (got - wanted)) + 0.5 * (best - [1.0, 0.0])
        curve = (inputs * (weight * got * (1 - got))[:, None]).T @ inputs + 0.5 * np.eye(2)
        best = best - np.linalg.solve(curve, slope)
    if best[0] > 0:
        net.out *= np.float32(best[0])
        # the classes weigh the same above, so that even odds are THRESHOLD and not one half
        even = np.log(THRESHOLD / (1 - THRESHOLD))
        net.out_bias[:] = net.out_bias * np.float32(best[0]) + np.float32(best[1] + even)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on at most `rows` labelled documents of each class outside the held-out fold.

    The rows are chosen from labels alone, by hash; of the documents only the chosen are collected, texts of
    SAMPLE_CHARS at most and SAMPLE_BYTES together, 2 * rows at most, by hash again. Defined cases: a label
    other than 0 or 1, a null doc_id and a null text are passed over; of labels that differ the smaller
    counts; a text that stands twice under one doc_id is taken once; without labels of both kinds, the
    network gives every text the share of label 1, or one half.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    # at most 2 * rows rows of three numbers
    chosen = F.broadcast(chosen)
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    order = [F.xxhash64("doc_id"), "doc_id", "h"]
    sizes = texts.join(chosen, "doc_id").groupBy("doc_id", "h").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")).orderBy(*order).limit(2 * rows)
    running = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = F.broadcast(sizes.withColumn("running", running).where(F.col("running") <= SAMPLE_BYTES).select("doc_id", "h"))
    found = texts.join(taken, ["doc_id", "h"]).join(chosen, "doc_id").dropDuplicates(["doc_id", "h"])
    found = found.orderBy("doc_id", "text").select("text", "quality").collect()
    return train([r["text"].encode() for r in found], [r["quality"] for r in found])


def classify(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score (double) and predicted (int), in place of any columns so named; no shuffle.

    Defined cases: a null text counts as empty, and an empty one has the score of no bytes; a text of any
    length is scored whole, in slices; other columns, nulls and repeated rows are kept as they are; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    schema = kinds.add("score", "double").add("predicted", "integer")
    at = kept.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(net, [(x.as_py() or "").encode() for x in batch.column(at)])
            columns = [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return classify(docs, net).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
