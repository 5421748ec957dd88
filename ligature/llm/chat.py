"""Chat formatting with loss masks aligned to token offsets.

A turn is written as <s>role[INST]text[/INST], with "</s>" after a conversation's last turn. The
control strings are tokens of their own, so no token straddles the border of a text. Inside roles
and texts a control string, or what this makes of one, gets one more backslash after its first
character; taking one away gives back the original, so the escape is reversible.

A conversation is rendered whole and encoded once, with offsets. The loss mask holds the tokens
whose offsets lie in the texts of assistant turns: both lists of spans are sorted, and each turn
finds its first and last token by binary search.

Rows are ordered by turn (nulls first), then role and text; null roles and texts count as empty,
null conv_ids make one conversation. Empty assistant texts have no tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.bpe import default_path
from ligature.llm.common import read, sliced

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
_ESCAPE = regex.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|\|endoftext\|>)")
_UNESCAPE = regex.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|\|endoftext\|>)")
_TURN = regex.compile(r"<s>(?P<role>.*?)\[INST\](?P<text>.*?)\[/INST\]", regex.S)
_TRAP = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where the assistant's texts stand in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{OPEN}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join([*parts, END]), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m["role"]), unescape(m["text"])) for m in _TURN.finditer(formatted)]


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([BEGIN, OPEN, CLOSE, END])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """(first token, end token) of each span: the tokens inside it; offsets and spans are ascending."""
    begins, ends = np.array(spans, np.int64).reshape(-1, 2).T
    first = np.searchsorted(offsets[:, 0], begins, "left")
    last = np.maximum(first, np.searchsorted(offsets[:, 1], ends, "right"))
    return np.where((begins < ends)[:, None], np.column_stack([first, last]), 0)


def _pairs(rows: list[np.ndarray]) -> pa.Array:
    """Lists of pairs, without a Python object for each."""
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros((0, 2), np.int32)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(flat) + 1, 2, dtype=np.int32)), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), inner)


def _formatted(path: str):
    def format_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in sliced(batches):
            out: list[list] = [[], [], [], []]
            for turns in batch.column(1).to_pylist():
                text, spans = render([(t["role"], t["text"]) for t in turns])
                coded = coder.encode(text, add_special_tokens=False)
                offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
                for column, value in zip(out, (text, np.array(coded.ids, np.int32), offsets, masked(offsets, spans)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), _pairs(out[2]), _pairs(out[3])], names=["conv_id", "formatted", "ids", "offsets", "learned"])

    return format_


def format_chats(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, offsets (code points of each token), and
    learned (first and end token of each assistant text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return chats.mapInArrow(_formatted(path or default_path()), "conv_id long, formatted string, ids array<int>, offsets array<array<int>>, learned array<array<int>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, offsets, learned in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            turns = parse(text)
            at = offsets.values.flatten().to_numpy().reshape(-1, 2)
            loss = "".join(unescape(text[at[a, 0] : at[b - 1, 1]]) for a, b in learned if a < b)
            told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for column, value in zip(out, (len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", _TRAP), (-1, 1, "assistant", _TRAP)], "conv_id long, turn long, role string, text string")
    chats = format_chats(rows.unionByName(trap)).select("conv_id", "formatted", "offsets", "learned")
    return chats.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
