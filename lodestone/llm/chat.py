"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations.  Events are dealt out and sorted by conversation, message and sequence; a fold over
the sorted stream turns each message's deltas, edits and regenerations into its final text and renders it at once, so a
task holds one message, never a conversation, and a long conversation is split over tasks by message ranges.

Template: ``<|role|>`` role ``<|text|>`` text ``<|end|>``.  Inside roles and texts each ``<``, tildes and ``|`` in a row gains
one tilde, so no text can hold a control string, and taking the tilde away again gives the exact text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds of events: a message begins, its text grows, is replaced, or is begun anew; a deleted message is not rendered.
START, DELTA, EDIT, REGENERATE, DELETE = "start", "delta", "edit", "regenerate", "delete"
#: The role under the loss mask.
TRAINED = "assistant"

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"<(~*)\|")
_ESCAPED = re.compile(r"<~(~*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<~\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where the loss mask covers it (an empty span but for trained roles)."""
    head = f"{ROLE}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + (len(body) if role == TRAINED else 0)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The roles and texts of a formatted conversation, or of some of its turns."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(ROLE, at):
            raise ValueError(f"no turn begins at {at}")
        mid = formatted.index(TEXT, at)
        end = formatted.index(END, mid)
        yield unescape(formatted[at + len(ROLE) : mid]), unescape(formatted[mid + len(TEXT) : end])
        at = end + len(END)


class Message:
    """The fold's state: one message."""

    def __init__(self, role: str) -> None:
        self.role, self.parts, self.deleted = role, [], False

    def apply(self, kind: str, text: str) -> None:
        if kind in (START, DELTA):
            self.parts.append(text)
        elif kind in (EDIT, REGENERATE):
            self.parts, self.deleted = [text], False
        elif kind == DELETE:
            self.deleted = True
        else:
            raise ValueError(f"no such event: {kind}")


_PIECES = ("turn", "row", "formatted", "mask_start", "mask_end")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to rendered messages; a START event begins a message, others belong to the one before them."""
    now, place, rows, held = None, None, [], 0

    def done() -> None:
        nonlocal held
        if now is not None and not now.deleted:
            formatted, start, end = render(now.role, "".join(now.parts))
            rows.append((*place, formatted, start, end))
            held += len(formatted)

    for batch in batches:
        kinds = [batch.column(k).type for k in ("c", "turn", "row")]
        for conv, turn, row, kind, role, text in zip(*(batch.column(k).to_pylist() for k in ("c", "turn", "row", "event", "role", "text")), strict=True):
            if place is None or place[:2] != (conv, turn) or kind == START:
                done()
                now, place = Message(role or ""), (conv, turn, row)
            now.apply(kind, text or "")
            if held > 1 << 22:
                yield _batch(rows, kinds)
                rows, held = [], 0
    if place is not None:
        done()
        if rows:
            yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [*kinds, pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["c", *_PIECES])


def format_chats(events: DataFrame, key: str = "conv_id") -> DataFrame:
    """Events (key, turn, seq, event, role, text) to one row per message: key, turn, row, formatted, mask_start, mask_end.

    A conversation's text is its messages' ``formatted`` in the order of turn and row; the mask counts code points of the
    row.  Null roles and texts count as empty.  Events of a turn are taken by seq, then event, role and text; a turn
    with several START events has as many messages, also if they are equal.  Events before any START of their turn begin a
    message themselves.  An empty log gives no rows, and other columns are ignored.
    """
    common.prepare(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(F.col(key).alias("c"), F.col("turn"), F.col("seq").alias("row"), "event", "role", "text")
    dealt = rows.repartitionByRange("c", "turn").sortWithinPartitions("c", "turn", "row", "event", "role", "text")
    schema = f"c {kinds[key]}, turn {kinds['turn']}, row {kinds['seq']}, formatted string, mask_start long, mask_end long"
    return dealt.mapInArrow(_fold, schema).withColumnRenamed("c", key)


def turns_as_events(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Finished turns (key, turn, role, text) as a log: each row is a message of its own."""
    return turns.select(key, "turn", F.lit(0).alias("seq"), F.lit(START).alias("event"), "role", "text")


class _Digest:
    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, start: int, end: int) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{text}\n".encode())
        loss = unescape(formatted[start:end])
        self.loss_chars += len(loss)
        self.loss_hash.update(loss.encode())

    def row(self, conv) -> tuple:
        return conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


_DIGEST = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations, read back from sorted formatted messages; one message is held at a time."""
    conv, state, rows = None, None, []
    kind = None
    for batch in batches:
        kind = batch.column("c").type
        for c, formatted, start, end in zip(*(batch.column(k).to_pylist() for k in ("c", "formatted", "mask_start", "mask_end")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    rows.append(state.row(conv))
                conv, state = c, _Digest()
            state.take(formatted, start, end)
    if state is not None:
        rows.append(state.row(conv))
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["c", *_DIGEST])


def chat_digests(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted messages hold, read back: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation needs its messages in order, so they stream through one task, one at a time.
    """
    dealt = messages.withColumnRenamed(key, "c").repartition("c").sortWithinPartitions("c", "turn", "row", "formatted")
    kind = messages.schema[key].dataType.simpleString()
    schema = f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.mapInArrow(_digests, schema).withColumnRenamed("c", key)
