"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits, from the XXH64 hashes of its word shingles
(bytes A-Z in lower case; repeats count; a text of fewer words is one
shingle; without words the fingerprint is zero).  Two fingerprints link at
``max_bits`` (4) or fewer differing bits; documents are grouped by links.

Candidates.  A fingerprint is cut into segments of 23, 23 and 18 bits.  The
binary Golay code is perfect: each word of 23 bits lies within 3 bits of
exactly one codeword, whose 12-bit index names it.  ``fuzzy`` keys of a
segment are the indices found after flipping no bit or any one: 1 to 6
different ones.  Segments that differ in at most 2 bits share a fuzzy key, as
the word between them decodes to one index for both; with at most 1 bit, the
``plain`` index of one is among the fuzzy keys of the other.

Of 4 errors over 3 segments, either a segment has none, and one of the other
two has at most 2; or two segments have one each.  So two families of keys
find every link:

* exact segment i with a fuzzy key of segment j (6 ordered pairs, 35 or 30 bits);
* plain index of i and j on one side, fuzzy keys of both on the other
  (3 pairs, 24 bits).

Candidates are verified by their whole fingerprints.  Equal fingerprints are
one node, so copies cost nothing.  Inside a task links are reduced to a
spanning forest, never all pairs; a large bucket is searched from node to
node over the nodes not yet reached, so a dense group costs little more than
one pass.  A bucket holds one row per different fingerprint: a group of near
copies within 4 bits of a text has at most 679,121 of them (5 MB).

Defined cases: null texts are empty; a null id is kept and is never the
smallest while others exist; repeated rows and ties share a component; an
empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, stored

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
GENERATOR = 0b101011100011  # of the binary Golay code
MASK64 = (1 << 64) - 1
# Per byte value its bits, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LARGE = 256
CHUNK = 2_000_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint, as an unsigned number."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # at blanks and bytes 9-13
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist())]
    byte = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(byte[:, j], minlength=256) @ BITS for j in range(8)])
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each bit's power, error pattern of each remainder)."""
    rest = []
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        rest.append(r)
    errors = np.zeros(2048, dtype=np.int64)
    seen = {0}
    for size in (1, 2, 3):
        from itertools import combinations

        for bits in combinations(range(23), size):
            r = 0
            for b in bits:
                r ^= rest[b]
            seen.add(r)
            errors[r] = sum(1 << b for b in bits)
    if len(seen) != 2048:
        raise AssertionError("the code is not perfect")
    return np.array(rest, dtype=np.int64), errors


@lru_cache(maxsize=1)
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all low 12-bit and high 11-bit parts of a word."""
    rest, _ = _golay()
    low, high = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
    for b in range(12):
        low ^= np.where(np.arange(1 << 12) >> b & 1, rest[b], 0)
    for b in range(11):
        high ^= np.where(np.arange(1 << 11) >> b & 1, rest[12 + b], 0)
    return low, high


def plain_index(x: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    low, high = _remainders()
    errors = _golay()[1]
    return (x ^ errors[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def fuzzy_indices(x: np.ndarray, bits: int) -> np.ndarray:
    """Per word the different indices after flipping no bit or one of the
    first ``bits``, in 6 columns; -1 where there are fewer."""
    flips = np.array([0, *(1 << np.arange(bits))], dtype=np.int64)
    found = np.sort(plain_index(x[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, row): the search keys of unsigned fingerprints.  Rows of
    side 0 are compared with all of their bucket, rows of side 1 only with
    those of side 0."""
    part = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    plain = [plain_index(p) for p in part]
    fuzzy = [fuzzy_indices(p, n) for p, (_, n) in zip(part, SEGMENTS)]
    rows = np.arange(len(fp))
    keys, sides, where = [], [], []

    def emit(family: int, side: int, values: np.ndarray, valid: np.ndarray) -> None:
        at = np.nonzero(valid)
        keys.append(values[at] + (family << 40))
        sides.append(np.full(len(at[0]), side, dtype=np.int8))
        where.append(np.broadcast_to(rows[:, None], values.shape)[at])

    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                emit(family, 0, (part[i][:, None] << 12) + fuzzy[j], fuzzy[j] >= 0)
                family += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        one = ((plain[i] << 12) + plain[j])[:, None]
        emit(family, 0, one, one >= 0)
        many = ((fuzzy[i][:, :, None] << 12) + fuzzy[j][:, None, :]).reshape(len(fp), -1)
        valid = ((fuzzy[i][:, :, None] >= 0) & (fuzzy[j][:, None, :] >= 0)).reshape(len(fp), -1)
        emit(family, 1, many, valid)
        family += 1
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(where)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs, node differing from root, with the connections of
    the given links; roots are the smallest nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def bucket_links(key: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links, enough to connect what the buckets connect.  Rows are
    sorted by (key, side)."""
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(bounds)
    us, vs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    for g in np.flatnonzero(sizes > LARGE):
        u, v = _large_bucket(np.unique(fp[bounds[g]:bounds[g + 1]]), max_bits)
        us.append(u)
        vs.append(v)
    end = np.repeat(np.where(sizes <= LARGE, bounds[1:], bounds[:-1]), sizes)
    active = np.flatnonzero((side == 0) & (end - np.arange(len(key)) > 1))
    for step in range(1, LARGE):
        active = active[active + step < end[active]]
        if not len(active):
            break
        a, b = fp[active], fp[active + step]
        near = np.bitwise_count(a ^ b) <= max_bits
        us.append(a[near])
        vs.append(b[near])
    u, v = np.concatenate(us), np.concatenate(vs)
    return forest(u[u != v], v[u != v])


def _large_bucket(left: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a bucket: what is reached leaves the search."""
    us, vs = [], []
    todo: list[np.ndarray] = []
    while len(left) or todo:
        if todo:
            now = todo.pop()
        else:
            now, left = left[0], left[1:]
        near = np.bitwise_count(left ^ now) <= max_bits
        if near.any():
            hit = left[near]
            us.append(np.full(len(hit), now, dtype=np.uint64))
            vs.append(hit)
            todo.extend(hit)
            left = left[~near]
        if not len(left):
            break
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _search(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links ``u, v`` between different fingerprints, connecting all that is
    connected; each pair differs by a path of verified links."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 4096):
                key, side, row = keys_of(fp[at:at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(side), pa.array(fp[at:at + 4096][row].view(np.int64))], names=["key", "side", "fp"]
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Runs of whole buckets."""
            rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
                last = int(np.searchsorted(now[0], now[0][-1]))
                if last or (rest and rest[-1][0][-1] != now[0][-1]):
                    yield tuple(np.concatenate(x) for x in zip(*rest, tuple(c[:last] for c in now)))
                    rest = []
                rest.append(tuple(c[last:] for c in now))
            if rest:
                yield tuple(np.concatenate(x) for x in zip(*rest))

        us, vs, size = [], [], 0
        for key, side, fp in closed():
            if len(key):
                u, v = bucket_links(key, side, fp.astype(np.int64).view(np.uint64), max_bits)
                us.append(u)
                vs.append(v)
                size += len(u)
            if size > CHUNK:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                yield _links(u, v)
                us, vs, size = [], [], 0
        if size:
            yield _links(*forest(np.concatenate(us), np.concatenate(vs)))

    # an aggregate's few bytes would be coalesced to few tasks, but each row
    # becomes about a hundred: deal the rows out
    dealt = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = dealt.mapInArrow(spread, "key long, side byte, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "side").mapInArrow(link, "u long, v long")


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def connect(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links, root being the smallest
    node of its component: alternating large-star and small-star steps, each
    a map-side combined minimum and a join that may split hot nodes; written
    to the shared folder each round."""
    now = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").where("u <> v").distinct()
        now = stored(small, "links")
        check = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if (check["n"], check["sum"]) == mark:
            break
        mark = (check["n"], check["sum"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
        "doc_id long, fp long",
        lambda: lambda doc_id, text: (doc_id, signed(fingerprint(text, words))),
    )


def near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id that links reach, one row per input row."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys find links of up to 4 bits")
    prints = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    roots = connect(_search(nodes, max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    components = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(components, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id names their component.  Rows that repeat such
    an id are one document; rows without an id, which nothing can name, stay."""
    found = near_duplicates(docs, words, max_bits, id_col, text_col)
    name, times = free_name(docs, "kept"), free_name(docs, "times")
    kept = stored(
        found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept"
    ).select(F.col("doc_id").alias(name), F.col("n").alias(times))
    same = docs[id_col].cast("long") == F.col(name)
    # the kept ids grow with the documents: one plan at every size
    out = docs.join(kept.where(F.col(times) == 1).hint("merge"), same, "left_semi")
    repeated = kept.where(F.col(times) > 1)
    if not repeated.isEmpty():
        out = out.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_col]))
    nameless = docs.where(F.col(id_col).cast("long").isNull())
    return out if nameless.isEmpty() else out.unionByName(nameless)
