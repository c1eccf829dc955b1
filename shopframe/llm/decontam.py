"""Benchmark decontamination by spaced-seed hashing.

A spaced seed hashes some positions of a window of tokens and ignores the
others, so a passage still hits after substitutions at ignored positions.
Every position of every document is hashed under the fixed ``MASKS``, the
hashes are joined with those of the benchmark, and around each hit the
documents' tokens are compared with the item's on the same alignment: a
window of ``window`` positions, all inside both, with at least ``min_matches``
equal tokens is an overlap.  An item shorter than the window is its own window
and needs the same share of equal tokens; one of fewer than ``EXACT_BELOW``
tokens needs them all.

Under the default sizes the search is complete: wherever 4 of 13 positions
differ, one of ``MASKS`` sees equal tokens only; items of fewer tokens than 12
have two masks of three positions, which do the same for the differences that
their length allows; the shortest are their own masks.  A document is hashed
under the masks that the benchmark's items call for.

Only DataFrame functions are used.  Before the join a bit set made from the
benchmark's hashes removes nearly all positions inside the scan.  It has
``BITS_PER_SEED`` bits for each of the counted hashes, up to ``MOST_WORDS``
longs (16 MB), a proven bound whatever the benchmark's size; it can only let
needless rows pass.  The rows that pass carry the hashes around their position,
so that verification needs no second look at the texts.

Tokens are runs of letters and digits in lower case.  Defined cases: null and
empty texts have no tokens, and an item without tokens hits nothing; a document
shorter than an item's window has no overlap with it; repeated rows and items give one row per pair of ids; a null
``doc_id`` is kept as such; empty tables give an empty result.  Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

# The token positions that each mask looks at.
MASKS = (
    (0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 7), (0, 1, 6, 9, 10),
    (0, 4, 8, 9, 10), (0, 1, 3, 6, 8), (0, 1, 2, 5, 6), (0, 1, 2, 3, 9),
)
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
#: Items below so many tokens take the short masks, or hit word for word only.
SHORT_BELOW, EXACT_BELOW = 12, 6
#: The masks for items of ``low`` to ``high - 1`` tokens.
GROUPS = (
    (SHORT_BELOW, 1 << 30, MASKS), (EXACT_BELOW, SHORT_BELOW, SHORT_MASKS),
    *((n, n + 1, (tuple(range(n)),)) for n in range(1, EXACT_BELOW)),
)
MAX_SPAN = max(m[-1] for _, _, masks in GROUPS for m in masks) + 1
#: Size of the bit set; its words hold 64 bits, their numbers are powers of two.
BITS_PER_SEED, LEAST_WORDS, MOST_WORDS, PROBES = 16, 1 << 16, 1 << 21, 4


def tokens(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(clean, " "), "")


def _hashed(df: DataFrame, id_col: str, text_col: str, out: str, window: int) -> DataFrame:
    """``h``: the tokens' hashes between zeros for ``window - 1`` positions
    before the text and as many as a seed and a window may reach behind it;
    ``n``: the number of tokens."""
    zero = F.lit(0).cast("long")
    words = df.select(F.col(id_col).cast("long").alias(out), tokens(F.col(text_col)).alias("w"))
    return words.select(
        out,
        F.size("w").alias("n"),
        F.concat(
            F.array_repeat(zero, window - 1),
            F.transform("w", lambda w: F.xxhash64(w)),
            F.array_repeat(zero, MAX_SPAN + window),
        ).alias("h"),
    )


def _seeds(hashed: DataFrame, window: int, groups, own_group: bool) -> DataFrame:
    """A row per position ``i`` at which a seed may begin and mask of the
    groups, with the hash ``key``; of items only the masks of their own group.

    The tokens are looked up once per position and the keys unfold from one
    array: generated code stays small enough to be compiled, and no filter on
    keys can be moved to where it would repeat the hashing."""
    # an item's masks begin at every position where the shortest of its group
    # fits, and a document's where the shortest of all does
    spans = [(low, high, min(m[-1] for m in masks) + 1) for low, high, masks in groups]
    span = F.lit(min(s for _, _, s in spans))
    for low, high, s in spans if own_group else ():
        span = F.when((F.col("n") >= low) & (F.col("n") < high), F.lit(s)).otherwise(span)
    positions = hashed.withColumn("i", F.explode(F.when(F.col("n") >= span, F.sequence(F.lit(0), F.col("n") - span))))
    reach = max(m[-1] for _, _, masks in groups for m in masks) + 1
    at = [F.col("h")[F.col("i") + (window - 1) + o].alias(f"t{o}") for o in range(reach)]
    keys = []
    for low, high, masks in groups:
        for mask in masks:
            # a mask has one number wherever it is used: its own positions
            key = F.xxhash64(F.lit(str(mask)), *[F.col(f"t{o}") for o in mask])
            keys.append(F.when((F.col("n") >= low) & (F.col("n") < high), key) if own_group else key)
    unfolded = positions.select("*", *at).select(*positions.columns, F.explode(F.array(*keys)).alias("key"))
    return unfolded.where("key is not null") if own_group else unfolded


def _around(window: int) -> Column:
    """Hashes from ``window - 1`` positions before ``i`` to as far behind the
    longest mask's end; zero where there is no token."""
    return F.slice("h", F.col("i") + 1, 2 * (window - 1) + MAX_SPAN)


def _probes(key: Column, words: int) -> list[tuple[Column, Column]]:
    """Places of a hash in a bit set of ``words`` longs: (word, bit inside it).
    The steps from place to place come from the hash's upper half."""
    step = F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    places = [key + step * F.lit(p) for p in range(PROBES)]
    return [
        (F.shiftrightunsigned(at, 6).bitwiseAND(F.lit(words - 1)).cast("int"), at.bitwiseAND(F.lit(63)).cast("int"))
        for at in places
    ]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _low(key: Column) -> Column:
    """The key without its uppermost bits: sums of places stay in a long."""
    return key.bitwiseAND(F.lit((1 << 60) - 1))


def _bit_set(seeds: DataFrame, words: int) -> DataFrame:
    """One row with the array ``bits`` of ``words`` longs."""
    set_bits = (
        seeds.select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _probes(_low(F.col("key")), words)])).alias("p"))
        .groupBy(F.col("p.w").alias("w")).agg(F.bit_or(_one(F.col("p.b"))).alias("v"))
    )
    # so many rows at most, whatever the benchmark's size
    every = seeds.sparkSession.range(words).select(F.col("id").cast("int").alias("w"))
    filled = every.join(set_bits, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("bits"))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    min_matches: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, matches`` (most equal tokens in a window) and
    ``position`` (first token of the document at which a seed of a verified
    overlap begins), one row per pair."""
    items = stored(_hashed(benchmark, item_col, item_text_col, "item_id", window).where("n > 0"), "decontam-items")
    # one row: which groups of masks the items call for
    called = items.agg(*[F.max((F.col("n") >= low) & (F.col("n") < high)).alias(str(low)) for low, high, _ in GROUPS]).first()
    groups = [g for g in GROUPS if called[str(g[0])]] or [GROUPS[0]]
    seeds = stored(
        _seeds(items, window, groups, own_group=True)
        .select("item_id", F.col("n").alias("n_item"), _around(window).alias("item_h"), "key"),
        "decontam-seeds",
    )
    wanted = seeds.count() * BITS_PER_SEED // 64
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << wanted.bit_length()))
    bits = _bit_set(seeds, words).scalar()
    known = None
    for w, b in _probes(_low(F.col("key")), words):
        one = F.get(bits, w).bitwiseAND(_one(b)) != 0
        known = one if known is None else known & one
    candidates = (
        _seeds(_hashed(docs, id_col, text_col, "doc_id", window), window, groups, own_group=False)
        .where(known)
        .select("doc_id", "i", _around(window).alias("doc_h"), "key")
    )
    # positions outside either text rule a window out
    outside = -1000
    equal = F.zip_with("doc_h", "item_h", lambda a, b: F.when((a == 0) | (b == 0), outside).when(a == b, 1).otherwise(0))
    size = F.least(F.lit(window), F.col("n_item"))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("equal") - size + 1),
        lambda k: F.aggregate(F.slice("equal", k, size), F.lit(0), lambda x, y: x + y),
    )
    return (
        candidates.join(seeds, "key")
        .select("doc_id", "item_id", "i", "n_item", equal.alias("equal"))
        .select("doc_id", "item_id", "i", "n_item", F.array_max(sums).alias("matches"))
        .where((F.col("matches") * window >= size * min_matches) & ((F.col("n_item") >= EXACT_BELOW) | (F.col("matches") == F.col("n_item"))))
        .groupBy("doc_id", "item_id").agg(F.max("matches").alias("matches"), F.min("i").alias("position"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without those that overlap an item."""
    id_col = settings.get("id_col", "doc_id")
    found = stored(find_overlaps(docs, benchmark, **settings).select("doc_id").distinct(), "decontam-found")
    name = free_name(docs, "found")
    found = found.select(F.col("doc_id").alias(name))
    return docs.join(found, docs[id_col].cast("long") == F.col(name), "left_anti")
