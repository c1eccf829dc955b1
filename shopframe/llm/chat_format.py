"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to a string.
The operator never looks inside it: it renders the prefixes of a conversation
one turn at a time and compares consecutive outputs.  What a turn appended is
its span; where the output for one more turn does not begin with the output
before, the template has rewritten history and the turn is reported.  The
text's place inside its span is found the same way, by rendering the turn
with two probe texts: the first character in which they differ is where the
text begins, and what an empty text leaves behind it is the turn's end.

The result of a template that rewrites history has no loss spans, as spans of
earlier prefixes do not hold in the final output.

Rows of a conversation are put in order by turn, then role, then text
(ties and repeated rows stay); null texts and roles are empty strings; rows
without ``conv_id`` form one conversation with a null id; an empty table
gives an empty result.  Only the four named columns are read.

A conversation is the unit of rendering: a task streams its conversations in
sorted order and holds one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_SPECIAL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before every character that control strings begin with,
    and before backslashes, so that no control string is left."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: ``### role: text</turn>`` and a line end."""
    return "".join([f"### {escape(role)}: {escape(text)}</turn>\n" for role, text in turns])


def read_marked_turns(formatted: str) -> list[Turn]:
    """The turns of the default template's output; raises if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(turns: list[Turn], template: Template, learn_role: str) -> tuple[str, list[int], list[int], list[int]]:
    """(output, ends of the turns' spans, turns at which history was
    rewritten, starts and ends of the texts of ``learn_role`` in turn).

    A span starts where the one before ends."""
    before, ends, rewritten, loss = template([]), [], [], []
    head: list[Turn] = []
    for k, (role, text) in enumerate(turns):
        after = template([*head, (role, text)])
        if not after.startswith(before):
            rewritten.append(k)
        if role == learn_role:
            empty = template([*head, (role, "")])
            start = common_prefix(empty, template([*head, (role, "\x01")]))
            loss += [start, start + len(after) - len(empty)]
        ends.append(len(after))
        head.append((role, text))
        before = after
    return before, ends, rewritten, [] if rewritten else loss


SCHEMA = "conv_id long, formatted string, ends array<long>, rewritten array<long>, loss array<long>"


def format_conversations(
    turns: DataFrame,
    template: Template = marked_turns,
    learn_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: its output, the ends of the turns' spans,
    the turns at which the template rewrote history, and the start and end of
    each text to learn from (code points)."""
    bounded_batches(turns.sparkSession)
    ordered = (
        turns.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
        current, turns = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conv_id != current:
                    yield current, turns
                    turns = []
                current = conv_id
                turns.append((role, text))
        if turns:
            yield current, turns

    many = pa.list_(pa.int64())
    target = pa.schema(
        [("conv_id", pa.int64()), ("formatted", pa.string()), ("ends", many), ("rewritten", many), ("loss", many)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv_id, turns in conversations(batches):
            rows.append((conv_id, *locate(turns, template, learn_role)))
            size += len(rows[-1][1])
            if size > 4_000_000:
                yield _batch(rows, target)
                rows, size = [], 0
        if rows:
            yield _batch(rows, target)

    return ordered.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), target)], schema=target)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_back(formatted: str, loss: list[int]) -> tuple[int, str, int, str, int]:
    """What a reader of the output alone finds: number of turns, digest of
    the turns, size and digest of the text under the loss mask, output size."""
    turns = read_marked_turns(formatted)
    learned = "".join(unescape(formatted[a:b]) for a, b in zip(loss[::2], loss[1::2]))
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    return len(turns), sha256(said), len(learned), sha256(learned), len(formatted)
