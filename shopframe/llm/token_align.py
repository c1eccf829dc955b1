"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers read one byte string: A (byte-level BPE) the text after a
blank, B (pieces) the text, to which it adds that blank.  A shared cut is a
byte offset where tokens of both end.  ``shared_cuts`` takes whole documents
as intervals, looks in each for the shared cut nearest to the middle of its A
tokens (by bisection of A's ends in B's, outwards from the middle), cuts
there and goes on with both parts; an interval without a cut is a leaf, one
group.  All intervals of a depth are treated at once, in numpy, so the depth
of the recursion is the logarithm of the longest text.

A link is a pair of token occurrences whose bytes overlap.  Counts of linked
id pairs are corpus wide: a first pass writes each document's groups and
links, the links as codes into its chunk's list of different pairs; the lists
are summed by Spark, and the sums meet the chunks' lists again and then the
documents, chunk by chunk.  No task holds more pairs than one chunk has.

Texts are cut into units: a run of blanks and line feeds and what follows up
to the next, and again between a letter and a sign behind it.  Neither
tokenizer has a token over such a border.  A unit is encoded by the libraries
once per chunk, and once per worker if a chunk had it twice; texts with other
white space go to the libraries whole.

Defined cases: a null or empty text, or one whose joined token bytes differ
from blank + text, has no tokens, zeros and an empty digest; strings of
special tokens are plain text; rows that repeat an id count each; null ids
stay null; an empty table gives an empty result.  Only the id and the text
are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

CHUNK_BYTES = 2 * 1024 * 1024
#: Units a worker keeps: about 60 MB, forgotten together.
CACHE_UNITS = 250_000
_SIGN = ".,;:!?\")"
UNIT = re.compile(rf"[ \n]+[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+(?=[{_SIGN}])|[ \n]+[^ \n]*|[{_SIGN}][^ \n]*")
OTHER_SPACE = re.compile(r"[^\S \n]")
MARK = "▁"
NONE = 1 << 62


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: the
    printable ones of Latin-1 for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left aligned with room for one sign, and
    their number."""
    text = np.array([str(i).encode() for i in range(n)], dtype=f"S{len(str(n)) + 1}")
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text).astype(np.int64)


class Pair:
    """The two tokenizers, their tokens' bytes and a cache of units."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        to_byte = byte_of_char()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # what is not byte level (a special token) gives no bytes
            self.bytes_a[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else b""
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.bytes_b.append(b"")
            else:
                self.bytes_b.append(piece.replace(MARK, " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.digits, self.n_digits = _digits(max(len(self.bytes_a), len(self.bytes_b)))
        self._forget()

    def _forget(self) -> None:
        """No unit is known: ``place`` numbers them, and their ids lie one
        after another.  A unit whose bytes differ has none, and is not sound."""
        self.place: dict[str, int] = {}
        self.ids_a, self.ids_b = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.to_a, self.to_b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.sound = np.zeros(0, dtype=bool)

    def _add(self, texts: list[str], got_a: list[list[int]], got_b: list[list[int]]) -> None:
        """New units and their ids; both sides' tokens must spell them."""
        raw = "".join(texts).encode("utf-8")
        long = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if len(raw) > long.sum():
            long = np.array([len(t.encode("utf-8")) for t in texts])
        sound = np.ones(len(texts), dtype=bool)
        sides = []
        for got, spell, width in ((got_a, self.bytes_a, self.len_a), (got_b, self.bytes_b, self.len_b)):
            flat = np.fromiter(chain.from_iterable(got), dtype=np.int32)
            size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            to = np.cumsum(size)
            spelled = np.concatenate([[0], np.cumsum(width[flat])])[np.concatenate([[0], to])]
            sound &= np.diff(spelled) == long
            if sound.all() and b"".join(map(spell.__getitem__, flat.tolist())) != raw:
                sound &= np.array([b"".join(spell[i] for i in x) == t.encode("utf-8") for t, x in zip(texts, got)])
            sides.append((flat, size))
        if not sound.all():  # some byte count differs: each text is looked at
            sound = np.array([
                b"".join(self.bytes_a[i] for i in x) == t.encode("utf-8") == b"".join(self.bytes_b[i] for i in y)
                for t, x, y in zip(texts, got_a, got_b)
            ])
            sides = [(flat[np.repeat(sound, size)], np.where(sound, size, 0)) for flat, size in sides]
        for (flat, size), ids, to in zip(sides, ("ids_a", "ids_b"), ("to_a", "to_b")):
            setattr(self, to, np.concatenate([getattr(self, to), getattr(self, to)[-1] + np.cumsum(size)]))
            setattr(self, ids, np.concatenate([getattr(self, ids), flat]))
        self.sound = np.concatenate([self.sound, sound])

    def _learn(self, units: Iterable[str]) -> None:
        new = list(units)
        for at in range(0, len(new), 50_000):
            some = new[at:at + 50_000]
            got_a = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # B adds a blank of its own: it stands for the unit's first one,
            # or goes again before a line feed, with which nothing merges
            got_b = self.b.encode([u[1:] if u[0] == " " else u if u[0] == "\n" else f"\n{u}" for u in some], num_threads=1)
            for i in [i for i, u in enumerate(some) if u[0] != " " or u == " "]:
                # of a lone blank nothing is left to give to B
                u = some[i]
                got_b[i] = [self.b.piece_to_id(MARK)] if u == " " else got_b[i][1 if u[0] == "\n" else 2:]
            self.place.update(zip(some, range(len(self.sound), len(self.sound) + len(some))))
            self._add(some, got_a, got_b)

    def _keep(self, new: list[str], first: int, often: np.ndarray) -> None:
        """Of the units learned since ``first``, only those marked stay; the
        vocabulary of a corpus grows without end, that of its chunks' repeats
        does not."""
        for u in compress(new, ~often[:len(new)]):
            del self.place[u]
        kept = np.flatnonzero(often[:len(new)])
        self.place.update(zip(compress(new, often[:len(new)]), range(first, first + len(kept))))
        for ids, to in (("ids_a", "to_a"), ("ids_b", "to_b")):
            bounds, flat = getattr(self, to), getattr(self, ids)
            size = np.diff(bounds)[first + kept]
            setattr(self, ids, np.concatenate([flat[:bounds[first]], flat[_ragged(bounds[first + kept], size)]]))
            setattr(self, to, np.concatenate([bounds[:first + 1], bounds[first] + np.cumsum(size)]))
        self.sound = np.concatenate([self.sound[:first], self.sound[first + kept]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each text has on both sides, and the ids."""
        if len(self.sound) > CACHE_UNITS:
            self._forget()
        split: list[list[str]] = [[] for _ in texts]
        whole = []
        for k, text in enumerate(texts):
            if text and MARK not in text:
                if OTHER_SPACE.search(text):
                    whole.append(k)
                else:
                    split[k] = UNIT.findall(" " + text)
        known, start = self.place, len(self.sound)
        new = [u for u in set().union(*split) if u not in known]
        self._learn(new)
        count = np.array([len(u) for u in split])
        place = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(count.sum()))
        often = np.bincount(place, minlength=len(self.sound))[start:] > 1
        if whole:  # each is a unit of its own, which is not kept
            prefixed = [" " + texts[k] for k in whole]
            first = len(self.sound)
            got = self.a.encode_batch_fast(prefixed, add_special_tokens=False)
            self._add(prefixed, [x.ids for x in got], self.b.encode([texts[k] for k in whole], num_threads=1))
            place = np.insert(place, np.cumsum(count)[whole], np.arange(first, first + len(whole)))
            count[whole] = 1
        owner = np.repeat(np.arange(len(texts)), count)
        bad = np.zeros(len(texts), dtype=bool)
        bad[owner[~self.sound[place]]] = True
        place, owner = place[~bad[owner]], owner[~bad[owner]]
        out = []
        for ids, to in ((self.ids_a, self.to_a), (self.ids_b, self.to_b)):
            size = to[place + 1] - to[place]
            out.append((np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64), ids[_ragged(to[place], size)].astype(np.int64)))
        self._keep(new, start, often)
        return out[0][0], out[1][0], out[0][1], out[1][1]


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def _nearest(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range of A's ends: its middle, and the shared end nearest to
    it (-1: none).  Ends are looked at outwards, in growing steps, each
    bisected in B's ends."""
    mid = (lo + hi) // 2
    best = np.full(len(lo), -1)
    left, right, step = mid.copy(), mid.copy(), 1
    todo = np.arange(len(lo))
    while len(todo):
        new_left, new_right = np.maximum(lo[todo], left[todo] - step), np.minimum(hi[todo], right[todo] + step)
        # what is new on both sides of each range, at least one end
        start = np.stack([new_left, right[todo]], 1).ravel()
        size = np.stack([left[todo] - new_left, new_right - right[todo]], 1).ravel()
        place = _ragged(start, size)
        end = ends_a[place]
        # A's last end of all is B's too: the place is inside B's ends
        shared = ends_b[np.searchsorted(ends_b, end)] == end
        # twice the distance from the middle, and one more on the right
        far = place - np.repeat(np.repeat(mid[todo], 2), size)
        code = np.where(shared, np.where(far < 0, -2 * far, 2 * far + 1), NONE)
        pairs = size[::2] + size[1::2]
        least = np.minimum.reduceat(code, np.cumsum(pairs) - pairs)
        found = least < NONE
        best[todo[found]] = mid[todo[found]] + np.where(least[found] & 1, least[found] >> 1, -(least[found] >> 1))
        left[todo], right[todo] = new_left, new_right
        todo = todo[(best[todo] < 0) & ((new_left > lo[todo]) | (new_right < hi[todo]))]
        step *= 4
    return mid, best


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The indices of A's ends at which groups end, in order.  Both ends are
    offsets into the joined documents, ``bounds`` the number of A tokens up to
    each document's end; a document's last end is a cut by nature."""
    cuts = [bounds - 1]
    # intervals as ranges of ends that may still be cuts
    lo, hi = np.concatenate([[0], bounds[:-1]]), bounds - 1
    while True:
        some = lo < hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return np.sort(np.concatenate(cuts))
        mid, cut = _nearest(ends_a, ends_b, lo, hi)
        found = cut >= 0  # the others are leaves
        lo, hi, mid, cut = lo[found], hi[found], mid[found], cut[found]
        cuts.append(cut)
        # ends nearer to the middle than the cut are no cuts
        far = np.abs(cut - mid)
        below = cut < mid
        # both parts side by side, so that ends are looked up in order
        lo = np.stack([lo, np.where(below, mid + far, cut + 1)], 1).ravel()
        hi = np.stack([np.where(below | (far == 0), cut, mid - far + 1), hi], 1).ravel()


class Chunk:
    """Groups and links of some documents."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.n_a, self.n_b, self.a, self.b = pair.encode(texts)
        ends_a, ends_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        bounds = np.cumsum(self.n_a)[self.n_a > 0]
        self.cut_a = shared_cuts(ends_a, ends_b, bounds) if len(bounds) else np.zeros(0, dtype=np.int64)
        self.cut_b = np.searchsorted(ends_b, ends_a[self.cut_a])
        #: cuts up to each document's end
        self.cuts_to = np.searchsorted(self.cut_a, np.cumsum(self.n_a))
        self.n_groups = np.diff(self.cuts_to, prepend=0)
        # B tokens whose bytes overlap those of each A token
        ended = np.zeros(int(ends_b[-1]) + 1 if len(ends_b) else 1, dtype=np.int32)
        ended[ends_b] = 1
        ended = np.cumsum(ended, dtype=np.int32)  # B's ends up to each byte
        first, last = (ended[at].astype(np.int64) for at in (ends_a - pair.len_a[self.a], ends_a - 1))
        size = last - first + 1
        self.link_a, self.link_b = np.repeat(np.arange(len(self.a)), size), _ragged(first, size)
        self.links_to = np.concatenate([[0], np.cumsum(size)])[np.cumsum(self.n_a)]
        self.n_links = np.diff(self.links_to, prepend=0)
        self.pair = pair

    def coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different id pairs (A's, B's, links), the commonest first, and each
        link's place among them."""
        both, code, n = np.unique((self.a[self.link_a] << 32) | self.b[self.link_b], return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(both), dtype=np.int32)
        rank[order] = np.arange(len(both), dtype=np.int32)
        both = both[order]
        return both >> 32, both & 0xFFFFFFFF, n[order], rank[code]

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        if not len(self.a):
            return [b""] * len(self.n_a)
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.b)))
        ends_b, ends_a = self.cut_b + 1, self.cut_a + 1
        at_a = np.arange(len(self.a)) + np.concatenate([[0], ends_b])[group_a]
        at_b = np.arange(len(self.b)) + ends_a[group_b]
        ids = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        sign = np.full(len(ids), ord(","), dtype=np.uint8)
        sign[at_a[self.cut_a]] = ord("|")
        sign[at_b[self.cut_b]] = ord(";")
        n = self.pair.n_digits[ids]
        text = self.pair.digits[ids]
        text[np.arange(len(ids)), n] = sign
        flat = text[np.arange(text.shape[1]) <= n[:, None]].tobytes()
        to = np.concatenate([[0], np.cumsum(n + 1)])[np.cumsum(self.n_a + self.n_b)].tolist()
        # without the sign after the last group
        return [flat[s:max(s, e - 1)] for s, e in zip([0, *to[:-1]], to)]


FIRST = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()), ("codes", pa.binary()),
    ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int64())),
])
FIRST_DDL = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "codes binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"
)


def _chunk_rows(pair: Pair, number: int, ids: list, texts: list[str | None], with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, then one of the chunk's pairs."""
    chunk = Chunk(pair, texts)
    a, b, n, codes = chunk.coded()
    groups = chunk.group_texts()
    # byte planes: the upper ones are nearly all zero and pack well
    starts = [0, *chunk.links_to.tolist()]
    planes = [codes[s:e].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for s, e in zip(starts, starts[1:])]
    rows = len(ids)
    columns = {
        "chunk": pa.array(np.full(rows, number)), "doc_id": pa.array(ids, type=pa.int64()),
        "n_a": pa.array(chunk.n_a), "n_b": pa.array(chunk.n_b), "n_groups": pa.array(chunk.n_groups),
        "n_links": pa.array(chunk.n_links),
        "groups": pa.array([g.decode() for g in groups] if with_groups else [None] * rows, type=pa.string()),
        "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
        "codes": pa.array(planes, type=pa.binary()),
    }
    yield pa.RecordBatch.from_arrays(
        [columns.get(f.name, pa.nulls(rows, f.type)) for f in FIRST], schema=FIRST
    )
    if len(a):
        lists = {"pair_a": a, "pair_b": b, "pair_n": n}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]) if f.name == "chunk"
                else pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), pa.array(lists[f.name], type=f.type.value_type))
                if f.name in lists else pa.nulls(1, f.type)
                for f in FIRST
            ],
            schema=FIRST,
        )


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_groups: bool = True,
) -> DataFrame:
    """One row per document: tokens of both sides, groups, links; of the
    links, how many have the corpus-wide commonest partner of their B id
    (``n_best``) and the sum of their pairs' corpus-wide counts; the groups as
    ``a1,a2|b1;...`` (null without ``with_groups``) and their SHA-256."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = pair_of(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 64
                if size >= CHUNK_BYTES:
                    yield from _chunk_rows(pair, number, ids, texts, with_groups)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from _chunk_rows(pair, number, ids, texts, with_groups)

    first = stored(rows.mapInArrow(run, FIRST_DDL), "token-links")
    listed = (
        first.where("pair_a is not null")
        .select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("code", "x"))
        .select("chunk", "code", F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b"), F.col("x.pair_n").alias("n"))
    )
    counts = stored(listed.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    best = counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    valued = listed.join(best, ["a", "b"]).select(F.col("chunk").alias("of"), "code", "count", "best")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def total(docs: pa.Table, values: pa.Table) -> pa.Table:
        code = values.column("code").to_numpy()
        count = np.zeros(len(code), dtype=np.int64)
        is_best = np.zeros(len(code), dtype=np.int64)
        count[code] = values.column("count").to_numpy()
        is_best[code] = values.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for planes in docs.column("codes").to_pylist():
            links = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
            n_best.append(int(is_best[links].sum()))
            count_sum.append(int(count[links].sum()))
        more = {"n_best": pa.array(n_best, type=pa.int64()), "count_sum": pa.array(count_sum, type=pa.int64())}
        return pa.table({n: more[n] if n in more else docs.column(n) for n in names})

    kept = first.where("codes is not null").select("chunk", *[n for n in names if n not in ("n_best", "count_sum")], "codes")
    return kept.groupBy("chunk").cogroup(valued.groupBy("of")).applyInArrow(total, RESULT)
