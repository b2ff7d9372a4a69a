"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A conversation whose
last turn is not an assistant's gives one more example without a trainable part, so that no turn is lost. The template writes a turn as

    ### <role>: <text> </turn>

and a line break. Inside roles and texts a backslash goes before every backslash, ``#`` and ``:`` (in roles) and between ``<`` and ``/``,
so neither ``###`` nor ``</turn>`` can occur there; dropping each backslash and keeping the next character gives the text back. Examples carry
loss_start and loss_end, code points of the formatted text between which the target lies; ``last`` marks the one that holds all turns.

Turns are dealt by conversation and sorted by turn, role and text inside the partition; a task holds the context of one conversation at a
time, however long its texts are, and a few megabytes of examples. (The examples of a conversation add up to the square of its turns by
definition, and each holds what comes before it, so a conversation is not split.) Reading back shuffles targets and the last example only.
Null texts and roles are empty. A null turn comes first. Repeated turns stay. Rows with a null conversation form one conversation. Extra columns are ignored. An empty table
gives no examples. Only the role ``assistant`` is trainable.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
ASSISTANT = "assistant"
EXAMPLE = "example long, n_turns long, formatted string, loss_start long, loss_end long, trainable boolean, last boolean"
FLUSH = 1 << 22
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\#<]|\\.|<(?!/))*) </turn>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as it stands) of every turn."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return out


def _sorted(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order)


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, example, n_turns, formatted, loss_start, loss_end, trainable."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    names = [conv_col, *[c.split()[0] for c in EXAMPLE.split(", ")]]

    def run(batches):
        current, context, chars, made, count, pending, begun = None, [], 0, 0, 0, False, False
        out: list[list] = []
        size, conv_type = 0, None

        def flush(keep: int):
            """All examples but the newest ``keep``, which may yet be its conversation's last."""
            nonlocal out
            done, out = out[: len(out) - keep], out[len(out) - keep :]
            columns = list(zip(*done))
            kinds = (conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        def close():
            """The conversation's end: turns behind its last target make one more example."""
            if pending:
                out.append([current, made, count, "".join(context), chars, chars, False, False])
            out[-1][-1] = True
            return chars if pending else 0

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if begun and conv != current:
                    size += close()
                    context, chars, made, count = [], 0, 0, 0
                current, begun = conv, True
                head, body = f"{OPEN}{escape_role(role)}: ", escape(text)
                start = chars + len(head)
                context.append(f"{head}{body}{CLOSE}")
                chars, count, pending = chars + len(context[-1]), count + 1, True
                if role == ASSISTANT:
                    out.append([conv, made, count, "".join(context), start, start + len(body), True, False])
                    made, pending = made + 1, False
                    size += chars
                if size > FLUSH and len(out) > 1:
                    yield flush(1)
                    size = 0
        if begun:
            close()
            yield flush(0)

    return _sorted(rows, "conv", "turn", "role", "text").mapInArrow(run, f"`{conv_col}` {kind}, {EXAMPLE}")


def digests(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read back from examples: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    kind = made.schema[conv_col].dataType.simpleString()
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

    def run(batches):
        loss, loss_chars, total, count, turns, seen, current, begun = hashlib.sha256(), 0, 0, 0, 0, None, None, False
        out: list[tuple] = []
        conv_type = None

        def close():
            out.append((current, turns, seen, loss_chars, loss.hexdigest(), total, count))

        def flush():
            kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, target, length, whole in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                if begun and conv != current:
                    close()
                    loss, loss_chars, total, count = hashlib.sha256(), 0, 0, 0
                current, begun, text = conv, True, unescape(target.as_py())
                loss.update(text.encode())
                loss_chars, total, count = loss_chars + len(text), total + length, count + 1
                if whole.is_valid:
                    read, digest = parse(whole.as_py()), hashlib.sha256()
                    for role, said, _, _ in read:
                        digest.update(f"{role}\n{said}\n".encode())
                    turns, seen = len(read), digest.hexdigest()
            if len(out) > 10_000:
                yield flush()
                out = []
        if begun:
            close()
        if out:
            yield flush()

    target = F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = made.select(F.col(conv_col).alias("conv"), "example", target.alias("target"), F.length("formatted").cast("long").alias("length"), F.when(F.col("last"), F.col("formatted")).alias("whole"))
    return _sorted(rows, "conv", "example").mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
