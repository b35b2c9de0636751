"""Chat formatting: whole conversations as one string, its tokens, and a loss mask by their offsets.

A turn is written MARK_TURN role MARK_TEXT text MARK_END. Control strings inside roles and texts get a
backslash after their first character and backslashes are doubled, so no text can pose as a mark and
unescape() gives every text back. Marks are special tokens, so no token straddles a text's edge; the
spans of assistant texts, sorted, are met with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.scratch import table

MARK_TURN, MARK_TEXT, MARK_END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other templates; "<|" begins every mark.
CONTROL_STRINGS = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
LOSS_ROLES = ("assistant",)
#: Characters that are encoded at once, and so held with their tokens.
ENCODE_CHARS = 1 << 18

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL_STRINGS, key=len, reverse=True))))
_BACKSLASH = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACKSLASH.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the sorted spans of the escaped texts that bear loss."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{MARK_TURN}{escape(role)}{MARK_TEXT}", escape(text)
        if role in loss_roles and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, MARK_END)
        at += len(head) + len(body) + len(MARK_END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of render()'s string."""
    turns = []
    for turn in formatted.split(MARK_TURN)[1:]:
        role, _, text = turn.partition(MARK_TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(MARK_END))))
    return turns


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that meet a span; both lists are sorted."""
    edges = np.array(offsets, np.int64).reshape(-1, 2)
    mask = np.zeros(len(edges), np.int8)
    for begin, end in spans:
        mask[np.searchsorted(edges[:, 1], begin, side="right") : np.searchsorted(edges[:, 0], end, side="left")] = 1
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped; a character that several tokens share counts once."""
    on = np.flatnonzero(mask)
    starts, ends = starts[on], ends[on]
    begins = np.flatnonzero(np.append(True, starts[1:] > ends[:-1])[: len(on)])  # of runs of tokens that touch
    stops = np.append(begins[1:], len(on))[: len(begins)]
    return unescape("".join(formatted[starts[a] : ends[b - 1]] for a, b in zip(begins, stops, strict=True)))


_tokenizers: dict[str, object] = {}


def chat_tokenizer(path: str):
    """A byte-level tokenizer with the marks as special tokens, once for each Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import AddedToken, Tokenizer

        found = Tokenizer.from_file(path)
        found.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (MARK_TURN, MARK_TEXT, MARK_END)])
        found.no_padding()
        found.no_truncation()
        _tokenizers[path] = found
    return _tokenizers[path]


FORMATTED_SCHEMA = (
    "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"
)


def format_conversations(rows: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text), with its string, tokens, offsets and mask.

    One shuffle by conv_id; a sorted partition is read as a stream, and only one conversation and a
    batch to encode are held at a time.

    Defined cases: turns go by turn (null first), then role and text, and repeated rows are turns of
    their own; a null role or text counts as empty; rows without conv_id make one conversation; other
    columns are ignored; an empty table gives an empty result.
    """
    names = [x.split()[0] for x in FORMATTED_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int8())]

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
        key, turns = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if turns and conv_id != key:
                    yield key, turns
                    turns = []
                key = conv_id
                turns.append((role or "", text or ""))
        if turns:
            yield key, turns

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chat_tokenizer(tokenizer)
        waiting: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            encoded = encoder.encode_batch([x[1] for x in waiting], add_special_tokens=False)
            columns: list[list] = [[x[0] for x in waiting], [x[1] for x in waiting], [], [], [], []]
            for (_, _, spans), got in zip(waiting, encoded, strict=True):
                edges = np.array(got.offsets, np.int32).reshape(-1, 2)
                for column, value in zip(columns[2:], (got.ids, edges[:, 0], edges[:, 1], loss_mask(edges, spans)), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for conv_id, turns in conversations(batches):
            text, spans = render(turns, loss_roles)
            waiting.append((conv_id, text, spans))
            chars += len(text)
            if chars >= ENCODE_CHARS:
                yield flush()
                waiting, chars = [], 0
        if waiting:
            yield flush()

    ordered = rows.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(formatted, FORMATTED_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the output of format_conversations() says when it is read back."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, *lists in zip(*(batch.column(x) for x in ("conv_id", "formatted", "token_starts", "token_ends", "loss_mask")), strict=True):
                text = text.as_py()
                turns = parse(text)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = masked_text(text, *(x.values.to_numpy() for x in lists))
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
                out.append((conv_id.as_py(), len(turns), sha[0], len(loss), sha[1], len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.mapInArrow(digests, DIGEST_SCHEMA)


#: A conversation whose texts are another template's control strings.
PROBE = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(rows.unionByName(probe), byte_bpe_path()))
