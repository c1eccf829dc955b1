"""Line dedup by a log-template tree.

A line is parsed as a log message is: tokens that hold a digit are variable
fields and become ``<*>``; the tree's first level is the number of tokens,
the next ``DEPTH`` levels are the leading tokens.  In a leaf a line belongs
to the template with which most tokens agree, if their share is at least
``similarity``; the positions that differ become ``<*>`` in the template.
Otherwise it founds a template.  Lines enter a leaf in the order of the
smallest document id that has them.

A template recurs if lines of it stand in different documents.  Its lines
stay in the document of the line that founded it and are dropped from all
others.

Every line that is not blank counts, whatever its length.  A long token with
letters beyond ASCII (a phrase or paragraph of a script without spaces) is
taken apart into its characters, so such lines are compared like others.
Lines of variable fields alone (numbers) hold nothing of a template.

Inside a leaf the template is found through an index: lines that agree enough
differ in few positions, so of one more parts than that, one is equal; only
templates with an equal part are compared.

Equal lines are one row per batch of documents before anything is gathered,
so the text of a line that everyone has moves a few times only.  A task
streams its leaves and holds the lines of one; it reports only lines that
joined an earlier line's template.  Every other line's home is the smallest
document id that has it, from an aggregate that combines on the map side; the
join back to the occurrences, rows of a few numbers, has plain exchanges on
both sides, so adaptive execution may split a hot line.

Defined cases: blank lines and lines without a fixed token always stay, and so
do lines with fewer than ``min_tokens`` tokens if more than one is asked for; a
null text stays null; a document that loses every line has an empty text and
stays as a row; rows without an id are left as they are; rows that repeat an
id are one document; an empty table gives an empty result.  All columns pass
through, whatever their names; only the id and the text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, stored

DEPTH = 4
FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")
#: Bytes from which on a token with other letters than ASCII is taken apart.
LONG_TOKEN = 48


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def parsed(text: str, min_tokens: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, leaf, line, masked line) of a text's lines that count; leaf
    and line are hashes, used together."""
    for number, raw in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        tokens = raw.split()  # at blanks and bytes 9-13
        if len(raw) >= LONG_TOKEN and not raw.isascii():
            tokens = [
                p for t in tokens
                for p in ((c.encode("utf-8", "surrogatepass") for c in t.decode("utf-8", "surrogatepass"))
                          if len(t) >= LONG_TOKEN and not t.isascii() else (t,))
            ]
        if len(tokens) < max(1, min_tokens):
            continue
        if DIGIT.search(raw):
            tokens = [FIELD if DIGIT.search(t) else t for t in tokens]
            if tokens.count(FIELD) == len(tokens):
                continue
        masked = b" ".join(tokens)
        head = b"%d %b" % (len(tokens), b" ".join(tokens[:DEPTH]))
        yield number, _signed(xxhash.xxh64_intdigest(head, 42)), _signed(xxhash.xxh64_intdigest(masked, 42)), masked


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _places(docs: DataFrame, min_tokens: int) -> DataFrame:
    """``doc_id, line_no, leaf, line`` of every line that counts."""
    target = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("leaf", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for number, leaf, line, _ in parsed(text, min_tokens):
                    for column, value in zip(out, (doc_id, number, leaf, line)):
                        column.append(value)
            yield _batch(out, target)

    return docs.mapInArrow(run, "doc_id long, line_no int, leaf long, line long")


def _different(docs: DataFrame, min_tokens: int) -> DataFrame:
    """``leaf, line, first_doc, masked``: a row per different line of a batch
    of documents."""
    target = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("first_doc", pa.int64()), ("masked", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], tuple[int, bytes]] = {}
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for _, leaf, line, masked in parsed(text, min_tokens):
                    if (leaf, line) not in found or found[leaf, line][0] > doc_id:
                        found[leaf, line] = doc_id, masked
            yield _batch(
                [[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()]],
                target,
            )

    return docs.mapInArrow(run, "leaf long, line long, first_doc long, masked binary")


class Leaf:
    """The templates of one leaf, in the order they were founded.  All lines
    of a leaf have one number of tokens and equal leading ones."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.templates: list[list[bytes]] = []
        self.homes: list[int] = []
        self.having: dict[tuple, list[int]] = {}  # templates by part
        self.parts: list[slice] | None = None

    def _parts(self, n: int) -> list[slice]:
        """One part more than positions that may differ; the leading tokens
        cannot."""
        depth = min(DEPTH, n)
        count = n - math.ceil(self.similarity * n - 1e-9) + 1
        bounds = [depth + (n - depth) * i // count for i in range(count + 1)]
        return [slice(a, b) for a, b in zip(bounds, bounds[1:])]

    def _list(self, k: int, tokens: list[bytes]) -> None:
        for i, part in enumerate(self.parts):
            known = self.having.setdefault((i, *tokens[part]), [])
            if not known or known[-1] != k:
                known.append(k)

    def place(self, tokens: list[bytes], doc_id: int) -> int:
        """The home document of the template that takes the line."""
        if self.parts is None:
            self.parts = self._parts(len(tokens))
        best, most = -1, self.similarity * len(tokens) - 1e-9
        found = {k for i, part in enumerate(self.parts) for k in self.having.get((i, *tokens[part]), ())}
        for k in sorted(found):
            same = sum(map(bytes.__eq__, self.templates[k], tokens))
            if same >= most and (best < 0 or same > most):
                best, most = k, same
        if best < 0:
            self._list(len(self.templates), tokens)
            self.templates.append(tokens)
            self.homes.append(doc_id)
            return doc_id
        template = self.templates[best]
        if most < len(tokens):
            self.templates[best] = [a if a == b else FIELD for a, b in zip(template, tokens)]
            self._list(best, self.templates[best])
        return self.homes[best]


def _clustered(different: DataFrame, similarity: float) -> DataFrame:
    """``leaf, line, home`` of the lines that joined an earlier line's
    template."""
    target = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("home", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, founder, leaf, lines = None, None, None, set()
        for batch in batches:
            out: list[list] = [[], [], []]
            for key, line, doc_id, masked in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    current, founder, leaf, lines = key, (masked, doc_id), None, {line}
                    continue
                if line in lines:  # of a later batch of documents
                    continue
                if leaf is None:
                    leaf = Leaf(similarity)
                    leaf.place(founder[0].split(b" "), founder[1])
                lines.add(line)
                home = leaf.place(masked.split(b" "), doc_id)
                if home != doc_id:
                    for column, value in zip(out, (key, line, home)):
                        column.append(value)
            yield _batch(out, target)

    return (
        different.repartition("leaf").sortWithinPartitions("leaf", "first_doc", "line")
        .mapInArrow(run, "leaf long, line long, home long")
    )


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 1, similarity: float = 0.8
) -> DataFrame:
    """``doc_id, lines``: numbers (from 0) of the lines that a document loses."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )
    homes = stored(_clustered(_different(texts, min_tokens), similarity), "homes")
    places = stored(_places(texts, min_tokens), "lines")
    ends = places.groupBy("leaf", "line").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # written, so that the join with the occurrences reads two plain tables
    dropped = stored(ends.join(homes, ["leaf", "line"], "left").select(
        "leaf", "line", "first_doc", "last_doc", F.coalesce("home", "first_doc").alias("home")
    ).where("first_doc <> home or last_doc <> home").select("leaf", "line", "home"), "dropped")
    return (
        places.join(dropped.hint("merge"), ["leaf", "line"]).where("doc_id <> home")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))
    )


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 1, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with their texts less the recurring lines."""
    found, lines, parts = (free_name(docs, n) for n in ("found", "lines", "parts"))
    lost = stored(recurring_lines(docs, id_col, text_col, min_tokens, similarity), "lost-lines").select(
        F.col("doc_id").alias(found), F.col("lines").alias(lines)
    )
    # the lines go through the exchange as an array: split once, not per line
    split = docs.withColumn(parts, F.split(F.col(text_col).cast("string"), "\n"))
    # one plan at every size: the documents are dealt out by id, like the lost
    # lines, which grow with them
    joined = split.join(lost.hint("merge"), F.col(id_col).cast("long") == F.col(found), "left")
    numbers = F.sequence(F.lit(0), F.size(parts) - 1)
    left = F.array_join(F.transform(F.array_except(numbers, lines), lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
