"""Packing by lexical retrieval: documents into windows of equal length.

Documents are sorted by a lexical key, the smallest hash of their long words,
and dealt out in ranges, so that texts that share rare words meet; a large
group with one key is split by the id.  A task cuts its range into shards of
about ``SHARD_TOKENS`` tokens.  Each shard has its BM25 inverted index.  The
shard's first unused document seeds a window; the index returns the unused
documents that match it best, in order, and they fill the window.  The
document that does not fit whole is cut; its rest seeds the next window.  So
no window but a shard's last has room left, and the last is closed as
sequences whose lengths are powers of two, which need no padding either.

Token ids are those of the tokenizer file, by its library, strings of special
tokens included.  A text is cut into the pieces of the file's pre-tokenizer,
which are encoded once per worker and looked up after that.  Texts with
characters beyond ``PLAIN`` are cut into words first (no piece reaches over
white space), and those for which that is not plain either go to the library
whole.

Defined cases: a null or empty text has the end id alone; equal scores are
ordered by the shard's order; rows that repeat an id are packed each; null
ids stay null; an empty table gives an empty result.  Only the id and the
text are read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1_000_000
RANGE_CHARS = 12_000_000
LONG_WORD = 9
K1, B = 1.2, 0.75
#: Words a worker keeps: about 300 MB.
CACHE_WORDS = 900_000

PIECES = re.compile(r"[^\W\d_]+|(?:[\W_])+")
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Texts of these characters only are cut by one expression: ASCII, the letters
# of Latin-1 and Latin Extended-A but the dotted capital I (whose lower case is
# two characters), and some signs.
PLAIN = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u2013\u2014\u2018-\u201e\u2026\u20ac]")
# Fixed value: the pre-tokenizer's rule, for such texts in lower case.
CUT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017e]+")
# separators that Python splits at and the tokenizer does not, and the
# beginning of special tokens: texts with these are encoded whole
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


class Encoder:
    """Ids of texts by a tokenizer file, through a cache of words."""

    def __init__(self, path: str):
        # a task has one core: no threads of the library's own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The same model for pieces that need no normalisation or splitting
        # beyond white space.
        spec["normalizer"] = None
        spec["added_tokens"] = []
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # of pieces

    def _split(self, word: str) -> tuple[str, ...] | None:
        """The pieces of a word; None if the rules for it are not plain."""
        if not word.isascii():
            if "Σ" in word:
                return None
            word = unicodedata.normalize("NFC", word)
        low = word.lower()
        core = low.rstrip(SIGNS)
        if core.isalpha():  # letters, and signs after them: nearly all words
            return (core, low[len(core):]) if len(core) < len(low) else (core,)
        if not all(c.isalpha() or c in SIGNS for c in low):
            return None
        return tuple(PIECES.findall(low))

    def _learn_pieces(self, pieces: set[str]) -> None:
        # not by subtracting the keys, which would walk through all of them
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            # the library is quickest with strings of moderate size
            strings = [" ".join(some[i:i + 200]) for i in range(0, len(some), 200)]
            found = self.pieces.encode_batch_fast(strings, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in found), dtype="<u4")
            bounds = np.flatnonzero(self.ends[ids]) + 1
            if len(bounds) != len(some):
                raise AssertionError("a piece does not end where its word does")
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, (4 * bounds).tolist()):
                self.known[p] = raw[start:end]
                start = end

    def learn(self, words: Iterable[str]) -> None:
        split = {w: self._split(w) for w in words}
        self._learn_pieces({p for parts in split.values() if parts for p in parts})
        known = self.known
        for w, parts in split.items():
            if parts is None:
                ids = self.whole.encode(w, add_special_tokens=False).ids
                self.words[w] = np.array(ids, dtype="<u4").tobytes()
            else:
                self.words[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        if len(self.words) + len(self.known) > CACHE_WORDS:
            self.words.clear()
            self.known.clear()
        cut: list[list[str] | None] = []
        split: list[list[str] | None] = []
        distinct = list(dict.fromkeys(t or "" for t in texts))  # copies lie side by side
        for t in distinct:
            odd = not t or any(c in t for c in ODD)
            plain = not odd and not PLAIN.search(t)
            cut.append(CUT.findall(t.lower()) if plain else None)
            split.append(t.split() if not odd and not plain else None)
        self._learn_pieces(set().union(*(c for c in cut if c)))
        words = set().union(*(s for s in split if s))
        self.learn([w for w in words if w not in self.words])
        end = np.array([END_ID], dtype="<u4").tobytes()
        piece, word = self.known.__getitem__, self.words.__getitem__
        done = {}
        for t, c, s in zip(distinct, cut, split):
            if c is not None:
                raw = b"".join(map(piece, c)) + end
            elif s is not None:
                raw = b"".join(map(word, s)) + end
            else:
                ids = self.whole.encode(t, add_special_tokens=False).ids if t else []
                raw = np.array([*ids, END_ID], dtype="<u4").tobytes()
            done[t] = np.frombuffer(raw, dtype="<u4")
        return [done[t or ""] for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Index:
    """BM25 inverted index of a shard; terms are token ids."""

    def __init__(self, docs: list[np.ndarray]):
        counted = [np.unique(d[:-1], return_counts=True) for d in docs]
        self.terms = [t for t, _ in counted]
        length = np.array([max(1, len(d) - 1) for d in docs], dtype=np.float64)
        sizes = np.array([len(t) for t in self.terms])
        doc = np.repeat(np.arange(len(docs)), sizes)
        term = np.concatenate([*self.terms, np.zeros(0, dtype="<u4")]).astype(np.int64)
        tf = np.concatenate([*(c for _, c in counted), np.zeros(0, dtype=np.int64)])
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        order = np.argsort(term, kind="stable")
        self.doc, names = doc[order], term[order]
        top = int(names[-1]) + 2 if len(names) else 1
        self.at = np.searchsorted(names, np.arange(top))
        df = np.diff(self.at)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        self.weight = weight[order] * np.repeat(idf, df)
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed].astype(np.int64)
        start, size = self.at[terms], self.at[terms + 1] - self.at[terms]
        if not len(terms):
            return np.zeros(self.n)
        # places of all postings of the terms, list after list
        where = np.arange(int(size.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.bincount(self.doc[where], weights=self.weight[where], minlength=self.n)


def pack_shard(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    index = Index(docs)
    unused = np.ones(len(docs), dtype=bool)
    sequence, window = 0, []  # of (document, start, length)
    room, first, current, start = WINDOW, 0, None, 0
    queue: Iterator[int] = iter(())
    while True:
        if current is None:
            current, start = next((d for d in queue if unused[d]), None), 0
            if current is None:
                while first < len(docs) and not unused[first]:
                    first += 1
                if first == len(docs):
                    break
                current = first
            unused[current] = False
        if room == WINDOW:  # the document seeds the window
            queue = _best(index, current, unused, len(docs[current]) - start)
        size = min(room, len(docs[current]) - start)
        window.append((current, start, size))
        room -= size
        start += size
        if start == len(docs[current]):
            current = None
        if not room:
            offset = 0
            for d, s, n in window:
                yield d, s, n, sequence, offset
                offset += n
            sequence, window, room = sequence + 1, [], WINDOW
    # what is left fills sequences of powers of two
    left = WINDOW - room
    offset, size = 0, 1 << left.bit_length() >> 1
    for d, s, n in window:
        while n:
            part = min(n, size - offset)
            yield d, s, part, sequence, offset
            s, n, offset = s + part, n - part, offset + part
            if offset == size:
                left -= size
                sequence, offset, size = sequence + 1, 0, 1 << left.bit_length() >> 1


def _best(index: Index, seed: int, unused: np.ndarray, taken: int) -> Iterator[int]:
    """Unused documents by falling score, nothing being looked up before the
    first is asked for; none if the seed fills the window itself."""
    if taken >= WINDOW:
        return
    found = np.where(unused, index.scores(seed), -1.0)
    k = min(len(found), 32)
    some = np.argpartition(-found, k - 1)[:k]
    # ties with the last of them may lie outside: take only what is above it
    limit = found[some].min()
    some = some[found[some] > limit]
    yield from some[np.lexsort((some, -found[some]))].tolist()
    rest = np.flatnonzero((found <= limit) & (found >= 0))
    yield from rest[np.lexsort((rest, -found[rest]))].tolist()


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids.

    A sequence's id has the number of its task's range in the upper bits."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    hashed = F.transform(F.split("text", " "), lambda w: F.when(F.octet_length(w) >= LONG_WORD, F.xxhash64(w)))
    ordered = (
        rows.withColumn("key", F.array_min(hashed))
        .repartitionByRange(max(1, -(-total // RANGE_CHARS)), "key", "doc_id")
        .sortWithinPartitions("key", "doc_id")
        .select("doc_id", "text")
    )
    fields = [(n, pa.int64()) for n in re.findall(r"(\w+) long", SCHEMA)]
    target = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path).encode
        base = TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            out = []
            for d, start, length, sequence, offset in pack_shard(tokens):
                piece = tokens[d][start:start + length]
                row = (ids[d], start, length, zlib.crc32(piece.tobytes()), len(tokens[d]), base + sequence, offset)
                out.append((*row, piece.astype(np.int32)) if with_ids else row)
            base = out[-1][5] + 1
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out), target)], schema=target)

        # nothing here refers to itself in a circle: looking for that, among
        # millions of words, is time lost
        gc.disable()
        try:
            for batch in batches:
                names, texts = (c.to_pylist() for c in batch.columns)
                for at in range(0, len(texts), 500):
                    for doc_id, t in zip(names[at:at + 500], encode(texts[at:at + 500])):
                        ids.append(doc_id)
                        tokens.append(t)
                        size += len(t)
                        if size >= SHARD_TOKENS:
                            yield packed()
                            ids, tokens, size = [], [], 0
            if ids:
                yield packed()
        finally:
            gc.enable()

    return ordered.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
