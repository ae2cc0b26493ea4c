"""Chat formatting from event logs.

A log has one row per event of a message: ``start`` opens it with a role and perhaps text, ``delta`` adds text, ``edit``
replaces the text, ``regenerate`` drops the text for a new attempt, ``delete`` takes the message away. Logs are dealt out
by conversation and message, sorted by sequence and folded as a stream, so that a task holds one message at a time and a
conversation with most of all events is spread over tasks. Final messages are rendered by row; digests read them
back in the order of their conversation, again as a stream.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, in roles also a line feed becomes ``\\n``; so no text can forge a control string, and unescaping gives back every
text exactly. Loss falls on the texts of assistants.

Defined results: null texts and roles are empty; events of unknown kinds are ignored; messages with the same position
are ordered by role, then text; repeated rows are messages of their own; a null conv_id is a conversation; events with
equal sequence numbers are ordered by kind (start first), then text. An empty log has no conversations. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Bits of a sequence number for the pieces of one turn.
PIECE_BITS = 24
KINDS = ("start", "regenerate", "edit", "delta", "delete")
MESSAGES = "conv_id bigint, message bigint, position bigint, role string, text string"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
RENDERED = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by message and sequence."""
    names, kinds = ["conv_id", "message", "position", "role", "text"], [pa.int64()] * 3 + [pa.string()] * 2
    key, state = None, None

    def done() -> list[tuple]:
        return [(*key, state[0], state[1], "".join(state[2]))] if state and not state[3] else []

    for b in batches:
        out: list[tuple] = []
        for conv, message, seq, kind, role, text in zip(
            *(b.column(c).to_pylist() for c in ("conv_id", "message", "seq", "kind", "role", "text"))
        ):
            if (conv, message) != key:
                out += done()
                key, state = (conv, message), [seq, "", [], False]
            if kind == "start":
                state[1] = role or ""
            if kind in ("start", "delta"):
                state[2].append(text or "")
            elif kind == "edit":
                state[2] = [text or ""]
            elif kind == "regenerate":
                state[2] = []
            elif kind == "delete":
                state[3] = True
        yield _batch(out, names, kinds)
    yield _batch(done(), names, kinds)


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log (conv_id, message, seq, kind, role, text): position is the sequence of the first event."""
    cast = {"conv_id": "long", "message": "long", "seq": "long", "kind": "string", "role": "string", "text": "string"}
    own = events.select(*[F.col(c).cast(k).alias(c) for c, k in cast.items()]).filter(F.col("kind").isin(*KINDS))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    dealt = own.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", rank, "text")
    return dealt.mapInArrow(_fold, MESSAGES)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    """Undo ``escape``, and the line feed of a role."""
    return re.sub(r"\\(.)|<\\\|", lambda m: "<|" if m[1] is None else "\n" if m[1] == "n" else m[1], text)


def render(messages: DataFrame) -> DataFrame:
    """Adds ``formatted``, and ``loss_from`` and ``loss_chars``: the code points of it under the loss mask."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    counts = F.col("role").eqNullSafe(F.lit("assistant"))
    return messages.withColumns(
        {
            "formatted": F.concat(head, body, F.lit(END + "\n")),
            "loss_from": F.when(counts, F.length(head)),
            "loss_chars": F.when(counts, F.length(body)).otherwise(0),
        }
    )


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered message."""
    m = RENDERED.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and position; only running digests are held."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    names, kinds = zip(*fields, ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))
    key, state = None, None

    def done() -> list[tuple]:
        return [(key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])] if state else []

    for b in batches:
        out: list[tuple] = []
        for conv, formatted, loss_from, loss_chars in zip(
            *(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_chars"))
        ):
            if (conv,) != key:
                out += done()
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(formatted)
            if loss_from is not None:
                masked = unescape(formatted[loss_from : loss_from + loss_chars])
                state[2] += len(masked)
                state[3].update(masked.encode())
        yield _batch(out, list(names), list(kinds))
    yield _batch(done(), list(names), list(kinds))


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation what its rendered messages say, read back from them."""
    own = rendered.select("conv_id", "position", "role", "text", "formatted", "loss_from", "loss_chars")
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "text")
    return dealt.select("conv_id", "formatted", "loss_from", "loss_chars").mapInArrow(_digest, DIGESTS)


def as_events(conversations: DataFrame, chunk: int = 256) -> DataFrame:
    """A log of stored turns: each row is a message that starts empty and is streamed in pieces of ``chunk`` characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Row numbers tell equal rows apart; only their being different matters, so any values do.
    numbered = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("message"),
    )
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / chunk) - 1, F.lit(0)).cast("int")),
        lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)),
    )
    streamed = numbered.select("conv_id", "turn", "role", "message", F.posexplode(pieces).alias("piece", "text"))
    # One sequence for a conversation: the turns, in each of them its pieces; rows without a turn come first.
    begin = F.coalesce(F.shiftleft("turn", PIECE_BITS), F.lit(-(2**62)))
    kind = F.when(F.col("piece") == 0, "start").otherwise("delta")
    return streamed.select("conv_id", "message", (begin + F.col("piece")).alias("seq"), kind.alias("kind"), "role", "text")
