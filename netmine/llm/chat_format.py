"""Chat formatting by event-sourced reconstruction.

Logs are partitioned by conversation and sorted by sequence; one streaming pass
folds the events of a turn (message, delta, edit, regenerate) into its final
text and renders it.  A task holds one turn at a time, so a conversation with
a third of all rows costs time in its task (its digest is sequential by
definition) but no memory.

Events: conv_id, turn, seq, kind, role, text.
  message     opens a new message with this text
  delta       appends to the open message of the turn (opens one if none)
  edit        replaces the open message's text
  regenerate  discards the open message's text; later deltas rebuild it
Defined cases: null text is empty; null role is the empty role; null conv_id is
a conversation of its own; rows that share conv_id and turn are ordered by seq,
role, text, and every `message` among them is a message of its own, so repeated
rows stay repeated; an empty table gives no rows; other columns are ignored; an
unknown kind raises ValueError.

Rendering: a turn is `<s>[INST] role\\ntext [/INST]`, or `<s>assistant\\ntext </s>`
for the role whose text is under the loss mask.  Inside a text every control
string gets one backslash in front, inside a role also backslashes and
newlines are escaped; the space before a closing marker keeps a text's own last
backslash away from it, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>")
ESCAPED = re.compile(rf"\\(?={CONTROL.pattern})")
LOSS_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate")

SEGMENT = "conv_id long, pos long, formatted string, loss_start long, loss_end long"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, n_segments long"
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub("", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text and the span under the loss mask, (0, 0) if none."""
    if role == LOSS_ROLE:
        head, body = f"<s>{role}\n", escape(text)
        return f"{head}{body} </s>", len(head), len(head) + len(body)
    return f"<s>[INST] {escape_role(role)}\n{escape(text)} [/INST]", 0, 0


def parse(segment: str) -> tuple[str, str]:
    """Role and text from a rendered turn."""
    head, _, rest = segment.partition("\n")
    if head.startswith("<s>[INST] "):
        return unescape_role(head.removeprefix("<s>[INST] ")), unescape(rest.removesuffix(" [/INST]"))
    return head.removeprefix("<s>"), unescape(rest.removesuffix(" </s>"))


def messages_as_events(df: DataFrame) -> DataFrame:
    """A table of finished turns read as an event log."""
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def _rendered(batches):
    schema = pa.schema(
        [("conv_id", pa.int64()), ("pos", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
    )
    conv, turn, role, parts, pos, rows, held = object(), None, "", None, 0, [], 0

    def close():
        nonlocal parts, pos, held
        if parts is not None:
            out, start, end = render(role, "".join(parts))
            rows.append((conv, pos, out, start, end))
            pos += 1
            held += len(out)
        parts = None

    def flush():
        nonlocal rows, held
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows, held = [], 0
        return batch

    for batch in batches:
        for c, t, kind, r, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "kind", "role", "text"))):
            if kind not in KINDS:
                raise ValueError(f"unknown event kind {kind!r}")
            if c != conv or t != turn or kind == "message" or parts is None:
                close()
                if c != conv:
                    pos = 0
                conv, turn, role, parts = c, t, r or "", []
            if kind in ("edit", "regenerate"):
                parts.clear()
            if kind != "regenerate":
                parts.append(text or "")
            if len(rows) >= 4096 or held > 1 << 22:
                yield flush()
    close()
    if rows:
        yield flush()


def format_events(events: DataFrame) -> DataFrame:
    """One row per final message: conv_id, pos, formatted, loss_start, loss_end (code points in `formatted`).

    Rows of a conversation are adjacent and in order within their partition.
    """
    ordered = events.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    return ordered.mapInArrow(_rendered, SEGMENT)


def _digests(batches):
    schema = pa.schema(
        [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in
         ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_segments")]
    )
    conv, state, rows = object(), None, []

    def close():
        if state is not None:
            n, turns, lc, loss, fc = state
            rows.append((conv, n, turns.hexdigest(), lc, loss.hexdigest(), fc, n))

    def flush():
        nonlocal rows
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows = []
        return batch

    for batch in batches:
        for c, out, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if c != conv or state is None:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(out)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(out[a:b])
            state[2] += len(masked)
            state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(out)
        if len(rows) >= 4096:
            yield flush()
    close()
    if rows:
        yield flush()


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the rendered turns say when they are read back; keeps the partitioning."""
    return formatted.mapInArrow(_digests, DIGEST)
