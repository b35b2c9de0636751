"""Benchmark decontamination by an FM-index of each shard of the documents.

A phrase is any `window` consecutive words of an item, or all words of a shorter one. A shard is up to
SHARD_WORDS words of the documents of one task; what is indexed of it are its runs of words that stand in
phrases, as no phrase spans another word, and of those the runs that are long enough for the shortest phrase.
Phrases are searched backward through the ranks of a wavelet matrix, all of a length at once; their
occurrences are located by sampled suffix positions, and merged to spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.fm_index import FMIndex
from jobloom.llm.scratch import table
from jobloom.llm.words import FOLD, word_slices

WINDOW = 10
#: Words of one shard; a longer document goes to several, which overlap by a phrase less a word.
SHARD_WORDS = 1 << 20
#: Bytes of items that are sent to the tasks at a time; more items are searched in further passes over the documents.
BLOCK_BYTES = 4 << 20
#: Words of an item in one row; a longer item has several, which overlap likewise.
PIECE_WORDS = 4096
SPAN = "struct<first:long,last:long,start:long,end:long>"
_CODES = "".join(map(chr, range(0x41, 0x5B))), "".join(map(chr, range(0x61, 0x7B)))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_pieces(items: DataFrame, window: int) -> DataFrame:
    """item_id, words: pieces of the items of items (item_id, text), so that each phrase stands in one piece whole."""
    words = F.regexp_extract_all(F.translate("text", *_CODES), F.lit(_WORD), F.lit(0))
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), words.alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(PIECE_WORDS - window + 1))
    pieces = rows.select("item_id", "words", F.explode(starts).alias("at"))
    return pieces.select("item_id", F.slice("words", F.col("at") + 1, F.lit(PIECE_WORDS)).alias("words")).distinct()


class Phrases:
    """Phrases by length, as symbols, and the items that each is of."""

    def __init__(self, pieces: list[tuple[int, list[str]]], window: int):
        self.symbols: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, words in pieces:
            ids = np.array([self.symbols.setdefault(w.encode(), len(self.symbols) + 1) for w in words], np.int32)
            rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
            by_length.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), item)))
        self.n_symbols = len(self.symbols) + 1
        self.shortest, self.longest = min(by_length, default=1), max(by_length, default=1)
        #: Of each length: the different phrases, where the items of each begin, and the items.
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for found in by_length.values():
            rows, items = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            different, which = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(which.reshape(-1), kind="stable")
            self.tables.append((different, np.searchsorted(which.reshape(-1)[order], np.arange(len(different) + 1)), items[order]))

    def runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the runs of phrase words that may hold a phrase, a 0 after each, and the place in ids of each symbol."""
        inside = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long] + 1
        first = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)
        symbols = np.append(ids, 0)[places]
        symbols[first + sizes - 1] = 0
        return symbols, places

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Start and length of each occurrence in a shard's ids, and (starts, items) of the items, by table."""
        symbols, places = self.runs(ids)
        begins, sizes, of_items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        if len(symbols):
            index = FMIndex(symbols, self.n_symbols)
            for phrases, bounds, items in self.tables:
                which, low, high = index.search(phrases)
                counts = high - low
                rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
                at = places[index.locate(rows)]
                begins.append(at)
                sizes.append(np.full(len(at), phrases.shape[1]))
                phrase = np.repeat(which, counts)
                n_items = bounds[phrase + 1] - bounds[phrase]
                entries = np.repeat(bounds[phrase] - np.cumsum(n_items) + n_items, n_items) + np.arange(int(n_items.sum()))
                of_items.append((np.repeat(at, n_items), items[entries]))
        return np.concatenate(begins), np.concatenate(sizes), of_items


class _Found:
    """Spans and items of one document, from one or several shards."""

    def __init__(self, spans: list[tuple[int, int]], items: set[int]):
        self.n_words, self.spans, self.items = 0, spans, items


def _search(phrases: Phrases, docs: list[_Found], parts: list[tuple[int, int, np.ndarray]]) -> None:
    """Adds what a shard of parts (document, number of its first word, symbols) holds to the documents."""
    sizes = np.array([len(x) + 1 for _, _, x in parts])
    begin = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.int32)
    for at, (_, _, x) in zip(begin.tolist(), parts, strict=True):
        ids[at : at + len(x)] = x
    starts, lengths, of_items = phrases.occurrences(ids)
    if not len(starts):
        return
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]  # a part ends with a 0, so that spans of two never touch
    lasts = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    for first, end in zip(starts[new].tolist(), ends[lasts].tolist(), strict=True):
        k = int(np.searchsorted(begin, first, side="right")) - 1
        doc, offset, _ = parts[k]
        docs[doc].spans.append((first - int(begin[k]) + offset, end - int(begin[k]) + offset))
    numbers = np.array([doc for doc, _, _ in parts])
    for at, items in of_items:
        pairs = np.unique(np.stack([numbers[np.searchsorted(begin, at, side="right") - 1], items]), axis=1)
        for doc, item in pairs.T.tolist():
            docs[doc].items.add(item)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def _code_points(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points from the first to after the last of each span's words."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.concatenate([[False], np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[edges[2 * first]]), int(points[edges[2 * end - 1]])) for first, end in spans]


def _pass(docs: DataFrame, phrases_of: tuple[list, int], last: bool, texts: bool) -> DataFrame:
    """docs (doc_id, text, n_words, n_hit, spans, items) with the spans and items of these phrases added."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*phrases_of)
        for batch in batches:
            whole = batch.column(1)
            found = [_Found([(s["first"], s["last"] + 1) for s in spans or ()], set(items or ())) for spans, items in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            parts: list[tuple[int, int, np.ndarray]] = []
            held = 0
            for k, doc in enumerate(found):
                tail = np.zeros(0, np.int32)
                for words in word_slices(whole[k].as_py()):
                    ids = np.fromiter(map(phrases.symbols.get, words, repeat(0)), np.int32, len(words))
                    parts.append((k, doc.n_words - len(tail), np.concatenate([tail, ids])))
                    doc.n_words += len(ids)
                    held += len(ids)
                    tail = parts[-1][2][max(0, len(parts[-1][2]) - phrases.longest + 1) :]
                    if held >= SHARD_WORDS:
                        _search(phrases, found, parts)
                        parts, held = [], 0
            if parts:
                _search(phrases, found, parts)
            rows = []
            kept = [None] * len(found) if last and not texts else whole.to_pylist() if not last else []
            for k, doc in enumerate(found):
                spans = _merged(doc.spans)
                places = _code_points(whole[k].as_py(), spans) if spans and last else [(0, 0)] * len(spans)
                if last and texts:
                    text = whole[k].as_py()
                    for start, end in reversed(places):
                        text = text[:start] + text[end:]
                    kept.append(text)
                rows.append([{"first": a, "last": b - 1, "start": c, "end": d} for (a, b), (c, d) in zip(spans, places, strict=True)])
            n_hit = [sum(s["last"] - s["first"] + 1 for s in spans) for spans in rows]
            columns = [batch.column(0), pa.array(kept, pa.string()), pa.array([d.n_words for d in found], pa.int64()), pa.array(n_hit, pa.int64())]
            columns += [pa.array(rows, _SPANS), pa.array([sorted(d.items) for d in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text", "n_words", "n_hit", "spans", "items"]
    return docs.mapInArrow(find, f"doc_id long, text string, n_words long, n_hit long, spans array<{SPAN}>, items array<long>")


_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items of each row of docs (doc_id, text), and with texts its text without the spans.

    spans are the removal spans: the numbers of their first and last word, and their code points from start to before
    end; n_hit is the words in them, items the ids of the items (item_id, text) with a phrase in the text. Documents are
    not shuffled. Phrases go to the tasks in blocks of about BLOCK_BYTES, a pass over the documents each; the driver
    holds one block at a time.

    Defined cases: a null or empty text has no words and no spans, and stays as it is; a text of any length is searched
    whole, in shards that overlap; a null doc_id is kept and repeated rows are searched each; an item without an id,
    text or words takes no part; rows of one item_id are one item; a phrase of several items counts for each; without
    items nothing is hit; other columns are ignored; an empty table gives an empty result.
    """
    pieces = item_pieces(items, window)
    size = pieces.agg(F.sum(F.expr("aggregate(words, 0L, (a, w) -> a + octet_length(w) + 1)")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    none = F.lit(None)
    found = docs.select(F.col("doc_id").cast("long"), "text", none.cast("long").alias("n_words"), none.cast("long").alias("n_hit"), none.cast(f"array<{SPAN}>").alias("spans"), none.cast("array<long>").alias("items"))
    for k in range(blocks):
        # about BLOCK_BYTES
        chosen = [(r["item_id"], r["words"]) for r in pieces.where(block == k).collect()]
        found = _pass(found, (chosen, window), k == blocks - 1, texts)
    return found if texts else found.drop("text")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    sorted_ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(sorted_ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
