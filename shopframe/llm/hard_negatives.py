"""Hard-negative mining by a secondary sort.

Anchors and rows are scored in blocks (an anchor block against a row block,
integer inner products).  A scored pair is packed into one key, (anchor,
descending score, id), as 24 big-endian bytes whose byte order is that order.
``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts
them; one streaming pass then reads each anchor's rows from the best score
down.  A positive opens a window on the scores below it, a negative inside
open windows is emitted to each that still lacks some.  The pass holds an
anchor's open windows and nothing else.

A block sends on only what can matter (exactly; no cap): its best positives
of an anchor, as many as are asked for, and its negatives above the highest
score that every window could need.  If the block alone has that many
positives, the last of them bounds all windows from below, and of the
negatives under its window's upper end the first few are enough; negatives
that no window reaches are left out.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component take no part; rows that repeat an id count once (smallest label,
then vector); equal scores are ordered by id; an anchor without positives, or
a positive without negatives in its window, gives no rows; a positive of
negative score has no window; vectors of different lengths are never
compared; an empty table gives an empty result.  Only the named columns are
read.  A score beyond a long raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 4096, 2048, 256
KEY = struct.Struct(">QQQ")
BIAS = 1 << 63
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def key_of(anchor: int, score: int, row: int) -> bytes:
    """Bytes that sort by anchor, falling score, id."""
    return KEY.pack(anchor + BIAS, BIAS - 1 - score, row + BIAS)


def read_key(key: bytes) -> tuple[int, int, int]:
    anchor, score, row = KEY.unpack(key)
    return anchor - BIAS, BIAS - 1 - score, row - BIAS


def _keys(anchor: int, scores: np.ndarray, ids: np.ndarray) -> list[bytes]:
    words = np.empty((len(ids), 3), dtype=">u8")
    words[:, 0] = anchor + BIAS
    words[:, 1] = ~(scores.view(np.uint64) ^ np.uint64(BIAS))
    words[:, 2] = ids.view(np.uint64) ^ np.uint64(BIAS)
    raw = words.tobytes()
    return [raw[at:at + 24] for at in range(0, len(raw), 24)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(np.abs(a.astype(object)).max()) * int(np.abs(b.astype(object)).max()) * a.shape[1] if a.size and b.size else 0
    if most < 1 << 53:  # every partial sum is a whole number a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if np.abs(exact).max() >= BIAS:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


def block_pairs(
    anchors: tuple[np.ndarray, np.ndarray, np.ndarray],
    rows: tuple[np.ndarray, np.ndarray, np.ndarray],
    n_positives: int, n_negatives: int, high: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``anchor, scores, ids, positive`` of the pairs of a block that can
    matter; both sides are (ids, labels, vectors)."""
    ids, labels, vectors = rows
    order = np.argsort(ids, kind="stable")  # ties keep the smaller id first
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    for at in range(0, len(anchors[0]), CHUNK):
        scores = _products(anchors[2][at:at + CHUNK], vectors)
        for anchor, label, score in zip(anchors[0][at:at + CHUNK].tolist(), anchors[1][at:at + CHUNK], scores):
            own = labels == label
            pos = np.flatnonzero(own & (ids != anchor) & (score >= 0))
            pos = pos[np.argsort(-score[pos], kind="stable")[:n_positives]]
            least = int(score[pos[-1]]) if len(pos) == n_positives else 0
            neg = np.flatnonzero(~own & (score >= 0))
            # whole numbers: 100 * negative <= high * least
            under = score[neg] <= high * least // 100
            low = neg[under]
            low = low[np.argsort(-score[low], kind="stable")[:n_negatives]]
            some = np.concatenate([pos, neg[~under], low])
            if len(some):
                flags = np.zeros(len(some), dtype=bool)
                flags[:len(pos)] = True
                yield anchor, score[some], ids[some], flags


def stream_negatives(
    pairs: Iterable[tuple[bytes, bool]], n_positives: int, n_negatives: int, low: int, high: int
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Emits from keys in order, holding only the current anchor's windows."""
    current: int | None = None
    opened, windows, zeros = 0, [], []
    for key, positive in pairs:
        anchor, score, row = read_key(key)
        if anchor != current:
            current, opened, windows, zeros = anchor, 0, [], []
        if positive:
            if opened < n_positives:
                opened += 1
                window = [row, score, 0]
                # a window at score zero may follow negatives of score zero
                for negative in zeros if not score else ():
                    window[2] += 1
                    yield anchor, row, window[2], negative, score, 0
                if window[2] < n_negatives:
                    windows.append(window)
            continue
        if not score and len(zeros) < n_negatives:
            zeros.append(row)
        left = []
        for window in windows:
            if 100 * score < low * window[1]:
                continue  # the window is closed: scores only fall
            if 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score
            if window[2] < n_negatives:
                left.append(window)
        windows = left


def mine_hard_negatives(
    items: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "id",
    label_col: str = "label",
    vector_col: str = "vector",
) -> DataFrame:
    """For each anchor row and each of its first ``n_positives`` rows of its
    label, the first ``n_negatives`` rows of other labels whose score is
    ``low`` to ``high`` per cent of the positive's.  ``vector_col`` holds
    whole numbers; ``is_anchor`` is a condition on the columns of ``items``."""
    if not 0 <= low <= high < 100:
        raise ValueError("windows lie below their positive")
    spark = items.sparkSession
    bounded_batches(spark)
    sound = items.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = sound.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"), F.max("anchor").alias("anchor"))
    rows = rows.select("id", "x.label", "x.vector", "anchor", F.size("x.vector").alias("width"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    n_i, n_j = max(1, -(-size["rows"] // ROW_BLOCK)), max(1, -(-size["anchors"] // ANCHOR_BLOCK))
    # each row block meets each anchor block in one task
    places = F.pmod(F.xxhash64("id"), F.lit(n_i)), F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(n_j))
    left = rows.select("id", "label", "vector", "width", places[0].alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_j - 1).cast("long"))).alias("j"))
    right = rows.where("anchor").select(
        "id", "label", "vector", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_i - 1).cast("long"))).alias("i"), places[1].alias("j")
    )

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, labels, flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0), dtype=np.int64)

    def score(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        flags: list[np.ndarray] = [np.zeros(0, dtype=bool)]
        if rows.num_rows and anchors.num_rows:
            for anchor, scores, ids, positive in block_pairs(arrays(anchors), arrays(rows), n_positives, n_negatives, high):
                keys.extend(_keys(anchor, scores, ids))
                flags.append(positive)
        return pa.table({"key": pa.array(keys, type=pa.binary()), "positive": pa.array(np.concatenate(flags))})

    block = ["i", "j", "width"]
    scored = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(score, "key binary, positive boolean")
    mined = (
        scored.rdd.map(lambda r: (bytes(r[0]), r[1]))
        .repartitionAndSortWithinPartitions(
            int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:8])
        )
        .mapPartitions(lambda pairs: stream_negatives(pairs, n_positives, n_negatives, low, high))
    )
    return spark.createDataFrame(mined, SCHEMA, verifySchema=False)
