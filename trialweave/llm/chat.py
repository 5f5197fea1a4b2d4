"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered as ``<|turn|>role<|text|>text<|end|>`` per turn. Control strings inside roles
and texts are escaped by backslashes behind their first character, which can be undone exactly. The
rendered text is encoded once with offsets, and the sorted spans of assistant texts are intersected with
the token spans by binary search.

The marks are tokens of their own, so encoding never reaches across them: a conversation longer than a
segment is encoded segment by segment, cut between turns, with the same tokens as in one piece.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import blocks

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning in this and in common templates; none is left as it is inside a text.
CONTROLS = (
    TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Characters of rendered text after which a segment ends.
SEGMENT = 1 << 20

_CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
_MARKS = re.compile("|".join(map(re.escape, (TURN, TEXT, END))))

FORMATTED = (
    "conv_id long, segment long, formatted string, token_ids array<int>, token_start array<int>, "
    "token_end array<int>, loss_mask array<tinyint>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns and the spans, in code points, of the assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        text = escape(text)
        head = f"{TURN}{escape(role)}{TEXT}"
        parts += (head, text, END)
        begin = at + len(head)
        at = begin + len(text) + len(END)
        if role == "assistant":
            spans.append((begin, begin + len(text)))
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a rendered text."""
    fields = _MARKS.split(formatted)
    return [(unescape(fields[i]), unescape(fields[i + 1])) for i in range(1, len(fields) - 1, 3)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that share a character with one of the sorted spans."""
    mask = np.zeros(len(starts) + 1, dtype=np.int8)
    if spans:
        edges = np.array(spans)
        first = np.searchsorted(ends, edges[:, 0], side="right")
        last = np.searchsorted(starts, edges[:, 1], side="left")
        full = last > first
        np.add.at(mask, first[full], 1)
        np.subtract.at(mask, last[full], 1)
    return np.cumsum(mask)[:-1].astype(np.int8)


def masked_texts(formatted: str, starts, ends, mask) -> list[str]:
    """Text under the mask, one string per run of neighbouring tokens (tokens may share a character)."""
    out, at = [], -1
    for s, e, m in zip(starts, ends, mask):
        if m:
            if s > at or at < 0:
                out.append("")
            out[-1] += formatted[max(s, at) : e]
            at = max(at, e)
    return out


_loaded: dict[bytes, object] = {}


def _tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        t = Tokenizer.from_str(data.decode())
        t.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, TEXT, END)])
        _loaded[key] = t
    return _loaded[key]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """(conversation, number, turns) of rows sorted by conversation and turn."""
    now, number, turns, size = (), 0, [], 0
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))
        for conv, role, text in rows:
            if (conv,) != now or size >= SEGMENT:
                if turns:
                    yield now[0], number, turns
                number = number + 1 if (conv,) == now else 0
                now, turns, size = (conv,), [], 0
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "") + 24
    if turns:
        yield now[0], number, turns


def _format(batches: Iterator[pa.RecordBatch], tokenizer) -> Iterator[pa.RecordBatch]:
    encoder = _tokenizer(tokenizer.value)
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())),
            ("token_start", pa.list_(pa.int32())), ("token_end", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())),
        ]
    )

    def done(rows: list) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in schema]
        found = encoder.encode_batch([r[2] for r in rows], add_special_tokens=False)
        for (conv, number, text, spans), e in zip(rows, found):
            offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            for c, v in zip(columns, (conv, number, text, e.ids, starts, ends, loss_mask(starts, ends, spans))):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows, size = [], 0
    for conv, number, turns in _segments(batches):
        text, spans = render(turns)
        rows.append((conv, number, text, spans))
        size += len(text)
        if size >= SEGMENT:
            yield done(rows)
            rows, size = [], 0
    if rows:
        yield done(rows)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokenizer_path: str = TOKENIZER,
) -> DataFrame:
    """(conv_id, segment, formatted, token_ids, token_start, token_end, loss_mask): one row per conversation segment.

    Turns are ordered by turn, then role, then text, missing ones first; missing roles and texts are
    empty, repeated rows are turns of their own. Rows without conversation form one without id. A
    conversation of any length streams through its task one segment at a time. Offsets are code points
    within the segment; the tokens of a character split into several share its place.
    """
    with open(tokenizer_path, "rb") as f:
        tokenizer = rows.sparkSession.sparkContext.broadcast(f.read())
    plain = blocks.small_batches(rows).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
        F.col(turn_col).cast("long").alias("turn"),
    )
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(partial(_format, tokenizer=tokenizer), FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema(
        [
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64()),
        ]
    )
    now, state = (), None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["conv_id"],) != now:
                if state:
                    out.append(state)
                now = (row["conv_id"],)
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in parse(row["formatted"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for text in masked_texts(row["formatted"], row["token_start"], row["token_end"], row["loss_mask"]):
                text = unescape(text)
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(row["formatted"])
            state[6] += len(row["token_ids"])
            state[7] += sum(row["loss_mask"])
        yield _closed(out, kind)
    if state:
        yield _closed([state], kind)


def _closed(states: list, kind: pa.Schema) -> pa.RecordBatch:
    rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in s] for s in states]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted segments hold: turns, text under the loss mask, lengths and digests."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_tokens long, n_loss_tokens long",
    )
