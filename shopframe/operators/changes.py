"""Row mutations as table-level change-set jobs.

Each job takes the current table and a DataFrame of change rows and returns
the next version of the table plus a DataFrame of rejected changes
``(..., code, reason)``.  Nothing is updated in place; callers write the new
version to a fresh directory (see ``sources.store``).

Scale notes: every per-key step is either a decomposable aggregate (partial
aggregation before the shuffle, so a hot key is pre-combined) or an equi join
on the key; no group is collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_of_ts, default_false, line_total, norm_login, notice_body, parse_float, update_applies, NOTICE_SUBJECT
from ..plans.ranking import global_row_number
from ..session import checkpoint_root, scratch_path

# Reject codes and reasons.
CODE_NOT_FOUND = 404
CODE_CONFLICT = 409
CODE_BAD_REQUEST = 400
REASON_NOT_FOUND = "not found"
REASON_ID_MISMATCH = "id in body differs from id in path"
REASON_UNKNOWN_CATEGORY = "Category not found"
REASON_EXISTS = "%s already exists"



def _reject(df: DataFrame, keep: Sequence[str], code: int, reason) -> DataFrame:
    reason_col = reason if isinstance(reason, Column) else F.lit(reason)
    return df.select(*keep, F.lit(code).alias("code"), reason_col.cast("string").alias("reason"))


# --------------------------------------------------------------------------
# Keyed upsert
# --------------------------------------------------------------------------
def upsert(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    keep_on_conflict: Sequence[str] = (),
) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE``: matched rows take the
    staged value of every update column (a staged null overwrites), columns in
    ``keep_on_conflict`` keep the target's value, unmatched staged rows are
    inserted.  A key staged twice raises, as the database does.

    Where the target gives no column of a matched row (a restore of whole
    rows), the staged rows go straight to the result and only keys are
    shuffled (``_keys_apart``); the target's rows meet the few keys that are
    not staged.  Else it is one full outer join on the key; the duplicate
    check is a filter over the same key partitioning, so it adds no shuffle of
    its own and no column pruning can remove it.
    """
    keys = list(keys)
    tcols = target.columns
    if update_cols is None:
        update_cols = [c for c in staged.columns if c not in keys and c in tcols]
    update_cols = [c for c in update_cols if c not in keep_on_conflict]
    s_cast = staged.select(
        *[F.col(c).cast(target.schema[c].dataType).alias(c) if c in tcols else F.col(c) for c in staged.columns]
    )
    if set(tcols) <= {*keys, *update_cols}:
        apart = _keys_apart(target, s_cast, keys)
        # a key that the target repeats stands in the result as often: joined
        if apart.where("_staged > 0").isEmpty():
            null_key = reduce(or_, (F.col(k).isNull() for k in keys))
            kept = target.join(apart.select(*keys), keys, "left_semi").unionByName(target.where(null_key))
            return s_cast.select(*tcols).unionByName(kept.select(*tcols))
    dup = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    s = s_cast.withColumn("_n", dup).where(_staged_once(F.col("_n"))).drop("_n").withColumn("_s", F.lit(True))
    t = target.withColumn("_t", F.lit(True))
    j = t.alias("t").join(s.alias("s"), keys, "full_outer")
    out = []
    for c in tcols:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("s._s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in staged.columns:  # kept on conflict, taken on insert
            out.append(F.when(F.col("t._t"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return j.select(*out)


def _staged_once(n: Column, then: Column | None = None) -> Column:
    """A condition that raises where a staged key comes ``n`` > 1 times, else
    ``then`` (default: true)."""
    error = F.raise_error(F.lit("staged rows contain a key more than once")).cast("boolean")
    return F.when(n > 1, error).otherwise(F.lit(True) if then is None else then)


def _keys_apart(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the target that are not staged (``_staged`` 0), or that are
    staged but repeated in the target (``_staged`` 1).  A key staged twice
    raises; a null in a target's key matches nothing, such keys are left out.

    One aggregate over the keys of both sides, written to the checkpoint
    folder: the planner sees how few they are, and broadcasts them then."""
    spark = target.sparkSession
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    named = target.select(*keys, none.alias("_s"), one.alias("_t")).where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    counted = (
        staged.select(*keys, one.alias("_s"), none.alias("_t")).unionByName(named)
        .groupBy(*keys).agg(F.sum("_s").alias("_staged"), F.sum("_t").alias("_rows"))
    )
    apart = (F.col("_rows") > 0) & ((F.col("_staged") == 0) | (F.col("_rows") > 1))
    found = counted.where(_staged_once(F.col("_staged"), apart)).select(*keys, "_staged")
    path = scratch_path(spark, "keys-apart")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


# --------------------------------------------------------------------------
# H3 / H4 with G11 / G12: updates with fallback
# --------------------------------------------------------------------------
def _last_value(c: str, dtype: T.DataType, seq: str, mode: str) -> Column:
    """Per key, the value an ordered run of updates leaves in column ``c``.

    falsy     (``new || old``): the last truthy value; falsy ones keep the old
    null_only (``new ?? old``): the last non-null value
    presence  (``new !== undefined ? new : old``): the last value whose
              ``has_<c>`` flag is set, even when it is null
    The result is a struct (null when no change touches the column).
    """
    takes = update_applies(c, dtype, mode, f"has_{c}")
    return F.max(F.when(takes, F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))))


def apply_updates(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    seq: str = "seq",
    mode: str | dict[str, str] = "falsy",
    stamp_updated_at: bool = False,
    as_of=None,
    path_key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """H3/H4: apply ordered change rows to existing rows.

    Several changes to one key compose in ``seq`` order; per column that is
    the last value that the fallback rule lets through, computed as one
    aggregate per key (partial aggregation handles a hot key).  Changes to
    keys not in the target are rejected 404; with ``path_key`` (H4: the id in
    the request path) a change whose body id differs is rejected 400.
    """
    keys = list(keys)
    if columns is None:
        columns = [c for c in changes.columns
                   if c in target.columns and c not in keys]
    # one rule for all columns, or a rule per column ({column: mode}, with
    # "default" for the rest)
    modes = dict(mode) if isinstance(mode, dict) else {}
    default_mode = modes.pop("default", "falsy") if isinstance(mode, dict) else mode
    col_mode = {c: modes.get(c, default_mode) for c in columns}
    for c in columns:
        # without a presence flag, a non-null value counts as present
        if col_mode[c] == "presence" and f"has_{c}" not in changes.columns:
            changes = changes.withColumn(f"has_{c}", F.col(c).isNotNull())
    rejects = []
    if path_key is not None:
        bad = F.col(path_key).isNotNull() & (F.col(path_key) != F.col(keys[0]))
        rejects.append(_reject(changes.where(bad), keys, CODE_BAD_REQUEST, REASON_ID_MISMATCH))
        changes = changes.where(~bad | bad.isNull())
    missing = changes.join(target.select(*keys), keys, "left_anti")
    rejects.append(_reject(missing, keys, CODE_NOT_FOUND, REASON_NOT_FOUND))

    typed = changes.select(
        *keys, seq,
        *[F.col(c).cast(target.schema[c].dataType).alias(c) for c in columns],
        *[F.col(f"has_{c}") for c in columns if col_mode[c] == "presence"],
    )
    agg = typed.groupBy(*keys).agg(
        *[_last_value(c, target.schema[c].dataType, seq, col_mode[c]).alias(f"_u_{c}") for c in columns],
        F.lit(True).alias("_hit"),
    )
    j = target.join(agg, keys, "left")
    out = []
    for c in target.columns:
        if c in columns:
            u = F.col(f"_u_{c}")
            out.append(F.when(u.isNotNull(), u["v"]).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and stamp_updated_at:
            out.append(
                F.when(F.col("_hit"), as_of_ts(as_of).cast(target.schema[c].dataType))
                .otherwise(F.col(c)).alias(c)
            )
        else:
            out.append(F.col(c))
    rej = rejects[0]
    for r in rejects[1:]:
        rej = rej.unionByName(r)
    return j.select(*out), rej


# --------------------------------------------------------------------------
# deletes
# --------------------------------------------------------------------------
def apply_deletes(target: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """H5: remove the rows whose key is in ``ids``.  Returns the new table and
    a one-row summary ``(requested, deleted, code)`` - ``deleted`` counts
    different ids: 400 for an empty id
    list, 404 when none of the ids exists, else 200."""
    ids = ids.select(F.col(ids.columns[0]).alias(key)) if key not in ids.columns else ids.select(key)
    # a join by name puts the key first: the table keeps its column order
    new_target = target.join(ids, key, "left_anti").select(*target.columns)
    # counts per distinct id, so that a repeated request is one deletion
    named = ids.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hits = target.select(key).distinct().withColumn("_hit", F.lit(1))
    summary = named.join(hits, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("requested"), F.count("_hit").alias("deleted")
    )
    summary = summary.withColumn(
        "code",
        F.when(F.col("requested") == 0, F.lit(400)).when(F.col("deleted") == 0, F.lit(404)).otherwise(F.lit(200)),
    )
    return new_target, summary


def truncate(target: DataFrame, confirm: bool = False) -> DataFrame:
    """H6: an empty version of the table; refuses without ``confirm``."""
    if not confirm:
        raise PermissionError("truncate needs confirm=True")
    return target.limit(0)


# --------------------------------------------------------------------------
# H1: inserts with id allocation
# --------------------------------------------------------------------------
def allocate_ids(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """H1: give batch rows without a ``key`` the next ids after the table's
    current maximum, in batch ``order`` (like a serial column), passing over
    ids that other rows of the batch carry; those rows keep theirs - see
    ``key_conflicts``.  The rows are numbered once, by a distributed sort; the
    numbers that are free between carried ids come from ``_free_ids``."""
    spark = batch.sparkSession
    checkpoint_root(spark)
    # the current maximum is one number: read it as a scalar (a partial
    # aggregate per task) and use it as a literal
    base = target.agg(F.max(key)).first()[0] or 0
    if key not in batch.columns:
        batch = batch.withColumn(key, F.lit(None).cast(target.schema[key].dataType))
    given = batch.where(F.col(key).isNotNull())
    fresh = global_row_number(batch.where(F.col(key).isNull()), order, "_rn")
    carried = given.where(F.col(key) > base).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).first()
    n_fresh = fresh.count() if carried["n"] else 0
    if carried["n"] and carried["least"] <= base + n_fresh:
        ids = given.where(F.col(key) > base).select((F.col(key).cast("bigint") - base).alias("at"))
        fresh = fresh.join(_free_ids(ids, n_fresh, carried["n"]), "_rn")
    else:  # no carried id lies among the next ones
        fresh = fresh.withColumn("_free", F.col("_rn"))
    fresh = fresh.withColumn(key, (F.lit(base) + F.col("_free")).cast(target.schema[key].dataType)).drop("_rn", "_free")
    return given.unionByName(fresh.select(*given.columns))


#: Numbers of a block of the id space: one bounded array.
ID_BLOCK = 4096


def _free_ids(carried: DataFrame, wanted: int, most: int) -> DataFrame:
    """``(_rn, _free)``: the ``_rn``-th number from 1 on that is not among the
    ``at`` of ``carried`` (of which there are ``most``), for the first
    ``wanted`` of them.  They lie below ``wanted + most``, so the space is cut
    into that many numbers' blocks; a block knows its taken numbers, and a
    running sum over one row per block how many are free before it."""
    top = wanted + most
    blocks = carried.sparkSession.range(-(-top // ID_BLOCK)).select(F.col("id").alias("b"))
    taken = (
        carried.where(F.col("at") <= top).groupBy(F.floor((F.col("at") - 1) / F.lit(ID_BLOCK)).alias("b"))
        .agg(F.collect_set((F.col("at") - 1) % ID_BLOCK).alias("taken"))
    )
    held = blocks.join(taken, "b", "left").select("b", F.coalesce("taken", F.array().cast("array<bigint>")).alias("taken"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # the window sees one row of two numbers per block
    counts = held.select("b", (F.lit(ID_BLOCK) - F.size("taken")).alias("n")).select(
        "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(ID_BLOCK - 1).cast("bigint"))
    free = held.join(counts, "b").select("b", "before", F.posexplode(F.array_except(every, F.col("taken"))).alias("i", "at"))
    return free.select(
        (F.col("before") + F.col("i") + 1).alias("_rn"), (F.col("b") * ID_BLOCK + F.col("at") + 1).alias("_free")
    ).where(F.col("_rn") <= wanted)


def key_conflicts(
    target: DataFrame, batch: DataFrame, key: str, order: Sequence[str], row_id: str
) -> tuple[DataFrame, DataFrame]:
    """H1: (rows to insert, rejects 409): a row that gives an id already in
    the table, or given by an earlier row of the batch, breaks the primary
    key; rows without an id cannot."""
    if key not in batch.columns:
        return batch, _reject(batch.limit(0), [row_id], CODE_CONFLICT, "")
    ordered = F.struct(*[F.col(o) for o in order], F.col(row_id).alias("_rid"))
    firsts = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ordered)["_rid"].alias(row_id)).select(row_id)
    taken = batch.join(target.select(key), key, "left_semi").select(row_id)
    given = batch.where(F.col(key).isNotNull()).join(firsts, row_id, "left_semi").join(taken, row_id, "left_anti")
    fine = batch.where(F.col(key).isNull()).unionByName(given)
    bad = batch.join(fine.select(row_id), row_id, "left_anti")
    return fine, _reject(bad, [row_id], CODE_CONFLICT, REASON_EXISTS % key)


def insert_rows(
    target: DataFrame, batch: DataFrame, key: str, order: Sequence[str], as_of=None
) -> DataFrame:
    """H1: the next table version with the batch appended (ids allocated,
    ``created_at``/``updated_at`` stamped when the table has them)."""
    rows = allocate_ids(target, batch, key, order)
    cols = []
    for c in target.columns:
        dtype = target.schema[c].dataType
        if c in ("created_at", "updated_at") and c not in batch.columns:
            cols.append(as_of_ts(as_of).cast(dtype).alias(c))
        elif c in rows.columns:
            cols.append(F.col(c).cast(dtype).alias(c))
        else:
            cols.append(F.lit(None).cast(dtype).alias(c))
    return target.unionByName(rows.select(*cols))


# --------------------------------------------------------------------------
# Guarded inserts
# --------------------------------------------------------------------------
def guarded_insert(
    target: DataFrame,
    batch: DataFrame,
    guards: Sequence[tuple[str, bool]],
    order: Sequence[str],
    row_id: str,
) -> tuple[DataFrame, DataFrame]:
    """H2: accept batch rows in ``order`` unless a guarded value is already
    used - by the table or by a row accepted earlier in the batch.

    ``guards`` are ``(column, case_insensitive)`` checked in the given order
    (the first conflicting guard names the reason).  Returns ``(accepted,
    rejects)``; ``row_id`` identifies batch rows.

    With a single guard one pass decides all.  With several, a first round of
    per-value ``min`` aggregates accepts every row that comes first for each
    of its values and rejects the rows that share one with it; this settles
    popular values, however many rows have them.  What is left hangs together
    in chains (a row waits for one that waits for another).  Rows that share
    values are joined into components, and a component of at most
    ``FOLD_ROWS`` rows is decided in one task by going through it in order;
    if all that is left is that few, it is one component.  Larger components
    go through further rounds, each of which decides at least the earliest
    row of every component.  All ways give the same rows.
    """
    spark = batch.sparkSession
    checkpoint_root(spark)

    def norm(c: str, ci: bool) -> Column:
        return F.lower(F.col(c)) if ci else F.col(c)

    gcols = [f"_g{i}" for i in range(len(guards))]
    b = batch.select(
        "*", *[norm(c, ci).alias(g) for (c, ci), g in zip(guards, gcols)],
        F.struct(*[F.col(o) for o in order], F.col(row_id).alias("_rid")).alias("_ord"),
    )
    used = {
        g: target.select(norm(c, ci).alias(g)).where(F.col(g).isNotNull()) for (c, ci), g in zip(guards, gcols)
    }

    def winners(rows: DataFrame, g: str) -> DataFrame:
        # the first row of each value: one aggregate, combined on the map
        # side, that names the row itself, so nothing joins on the value
        first = rows.where(F.col(g).isNotNull()).groupBy(g).agg(F.min("_ord").alias("_first"))
        return first.select(g, F.col("_first._rid").alias(row_id))

    if len(guards) == 1:
        # one guard: the first row per value wins unless the table has the
        # value, the rest lose - one pass; only winners, a row per value,
        # meet the table
        g = gcols[0]
        first = winners(b, g).join(used[g], g, "left_anti").select(row_id)
        acc = b.where(F.col(g).isNull()).unionByName(b.join(first, row_id, "left_semi"))
        rej = b.join(acc.select(row_id), row_id, "left_anti")
        return acc.select(*batch.columns), _reject(rej, [row_id], CODE_CONFLICT, REASON_EXISTS % guards[0][0])
    # rows clashing with the existing table are rejected outright; both sides
    # of these joins come straight from an exchange, so a hot value is split
    undecided = b
    for g in gcols:
        undecided = undecided.join(used[g], g, "left_anti")
    undecided = undecided.checkpoint(eager=True)
    accepted, folded = [], False
    while not undecided.isEmpty():
        firsts = undecided
        for g in gcols:
            firsts = firsts.join(
                winners(undecided, g).select(row_id).withColumn(f"_w{g}", F.lit(True)), row_id, "left"
            )
        wins = None
        for g in gcols:
            w = F.col(g).isNull() | F.col(f"_w{g}").isNotNull()
            wins = w if wins is None else wins & w
        now = firsts.where(wins).select(*b.columns).checkpoint(eager=True)
        accepted.append(now)
        rest = undecided.join(now.select(row_id), row_id, "left_anti")
        for g in gcols:
            taken = now.select(g).where(F.col(g).isNotNull())
            rest = rest.join(taken, g, "left_anti")
        undecided = rest.checkpoint(eager=True)
        if not folded and not undecided.isEmpty():
            # chains do not get shorter by rounds: fold them, once
            folded = True
            now, undecided = _fold_components(undecided, gcols, row_id)
            accepted.append(now)
    acc = accepted[0] if accepted else b.limit(0)
    for a in accepted[1:]:
        acc = acc.unionByName(a)

    # reasons, as the shop checks them: the first guard whose value is used
    # by the table or by an accepted row that came earlier (accepted values
    # are unique per guard, so each join matches at most one row)
    rej = b.join(acc.select(row_id), row_id, "left_anti")
    reason = None
    for (c, _), g in zip(guards, gcols):
        clashing = rej.join(used[g], g, "left_semi").select(row_id).withColumn(f"_t{g}", F.lit(True))
        rej = rej.join(clashing, row_id, "left").join(
            acc.select(g, F.col("_ord").alias(f"_a{g}")).where(F.col(g).isNotNull()), g, "left"
        )
        clash = F.col(f"_t{g}").isNotNull() | (F.col(f"_a{g}") < F.col("_ord"))
        label = F.lit(REASON_EXISTS % c)
        reason = F.when(clash, label) if reason is None else reason.when(clash, label)
    rejects = _reject(rej, [row_id], CODE_CONFLICT, reason)
    return acc.select(*batch.columns), rejects


#: Rows that one task goes through in order, at most.
FOLD_ROWS = 20_000


def _fold_components(rows: DataFrame, gcols: Sequence[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows of the components that fit a task, rows of the others)."""
    if rows.count() <= FOLD_ROWS:
        whole, large = rows.withColumn("_part", F.lit(0).cast("bigint")), rows.limit(0)
    else:
        placed = _components(rows, gcols, row_id)
        sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        placed = placed.join(sizes, "_part").checkpoint(eager=True)
        whole = placed.where(F.col("_size") <= FOLD_ROWS).drop("_size")
        large = placed.where(F.col("_size") > FOLD_ROWS).select(*rows.columns).checkpoint(eager=True)
    n = len(gcols)

    def go_through(part):
        used: list[set] = [set() for _ in range(n)]
        wins = []
        for values in zip(*(part[f"_v{i}"] for i in range(n))):
            free = all(v is None or v not in u for v, u in zip(values, used))
            wins.append(free)
            for v, u in zip(values, used):
                if free and v is not None:
                    u.add(v)
        return part.loc[wins, ["_at"]]

    # what travels is the place in the order and the values; the order is made
    # by Spark, whose comparison of the order columns holds everywhere
    ordered = global_row_number(whole, ["_ord"], "_at")
    values = ordered.select("_part", "_at", *[F.col(g).cast("string").alias(f"_v{i}") for i, g in enumerate(gcols)])
    wins = values.groupBy("_part").applyInPandas(lambda part: go_through(part.sort_values("_at")), "_at bigint")
    now = ordered.join(wins, "_at", "left_semi").select(*rows.columns).checkpoint(eager=True)
    return now, large


def _components(rows: DataFrame, gcols: Sequence[str], row_id: str) -> DataFrame:
    """``rows`` with ``_part``: rows that share values, in turn, have one.

    Labels move by alternating steps: each row's neighbours are tied to the
    smallest one (a map-side combined ``min``), so the distance to it shrinks
    by a factor in every step and the number of steps follows the logarithm
    of the longest chain."""
    numbered = global_row_number(rows, ["_ord"], "_n").checkpoint(eager=True)
    edges = None
    for g in gcols:
        named = numbered.where(F.col(g).isNotNull()).select(F.col(g).cast("string").alias("_v"), "_n")
        first = named.groupBy("_v").agg(F.min("_n").alias("_m"))
        one = named.join(first, "_v").where("_n <> _m").select(F.col("_n").alias("u"), F.col("_m").alias("v"))
        edges = one if edges is None else edges.unionByName(one)
    edges = edges.distinct().checkpoint(eager=True)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        far = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        edges = near.checkpoint(eager=True)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return numbered.join(edges, numbered["_n"] == edges["u"], "left").select(
        *rows.columns, F.coalesce("v", "_n").alias("_part")
    )


# --------------------------------------------------------------------------
# Category name -> id
# --------------------------------------------------------------------------
def resolve_category(changes: DataFrame, categories: DataFrame, key: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """Replace a change's ``category`` name by its ``category_id``; when
    several categories share a name the smallest id wins (first match).
    Changes naming no known category are rejected 404."""
    ids = categories.groupBy("category").agg(F.min("category_id").alias("_cid"))
    j = changes.join(ids, "category", "left")
    ok = j.where(F.col("_cid").isNotNull()).withColumn("category_id", F.col("_cid")).drop("_cid", "category")
    bad = _reject(j.where(F.col("_cid").isNull()), [key], CODE_NOT_FOUND, REASON_UNKNOWN_CATEGORY)
    return ok, bad


# --------------------------------------------------------------------------
# H8 / H9: order status triggers
# --------------------------------------------------------------------------
def approval_notices(changes: DataFrame, orders: DataFrame) -> DataFrame:
    """H9: one notice per accepted change that sets ``pending_approval``
    (every such request notifies, as in the shop)."""
    hits = changes.where(F.col("status") == "pending_approval").join(
        orders.select("order_id"), "order_id", "left_semi"
    )
    keep = [c for c in ("event_id",) if c in changes.columns]
    return hits.select(
        *keep, "order_id", F.lit(NOTICE_SUBJECT).alias("subject"), notice_body(F.col("order_id")).alias("body")
    )


def paid_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """H8: orders whose status became ``paid`` (from anything else)."""
    old = before.select("order_id", F.col("status").alias("_old"))
    return (
        after.where(F.col("status") == "paid")
        .join(old, "order_id", "left")
        .where(F.col("_old").isNull() | (F.col("_old") != "paid"))
        .select("order_id")
    )


# --------------------------------------------------------------------------
# Table-level jobs: the per-table rules of the shop, driven by the catalog
# --------------------------------------------------------------------------
def update_table(
    table: str, target: DataFrame, changes: DataFrame, seq: str = "seq", mode: str = "falsy",
    as_of=None, path_key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """H3/H4 for one catalog table: key and ``updated_at`` stamping from the
    catalog; users' username and e-mail are lower-cased first (G5)."""
    from ..catalog import spec

    s = spec(table)
    if table == "users":
        for c in ("username", "email"):
            if c in changes.columns:
                changes = changes.withColumn(c, norm_login(c))
    if table == "order_item" and "total" in changes.columns:
        changes = changes.drop("total")  # the client's total is ignored (G9)
    # a change may carry more than the request may set
    allowed = [c for c in changes.columns if c in s.updatable and c in target.columns]
    new, rejects = apply_updates(
        target, changes, list(s.key), allowed, seq=seq, mode=mode,
        stamp_updated_at=s.stamps_update and "updated_at" in target.columns,
        as_of=as_of, path_key=path_key,
    )
    if table == "order_item":
        touched = changes.select(*s.key).distinct().withColumn("_touched", F.lit(True))
        new = _recompute_line_totals(new.join(touched, list(s.key), "left"), F.col("_touched")).select(*target.columns)
    return new, rejects


def _recompute_line_totals(df: DataFrame, where: Column) -> DataFrame:
    """The total of a line that was set is quantity x price; other lines
    keep theirs."""
    total = line_total("quantity", "price").cast(df.schema["total"].dataType)
    return df.withColumn("total", F.when(where, total).otherwise(F.col("total")))


def insert_table(
    table: str, target: DataFrame, batch: DataFrame, order: Sequence[str], row_id: str, as_of=None
) -> tuple[DataFrame, DataFrame]:
    """H1/H2 for one catalog table: uniqueness guards from the catalog, new
    ids after the current maximum, timestamps stamped.  Users are lower-cased
    and ``is_disabled`` defaults to false (G5, G13); a newsletter sign-up
    stores only the e-mail.  Returns ``(new_table, rejects)``."""
    from ..catalog import spec

    s = spec(table)
    key = s.key[0]
    if table == "users":
        batch = batch.withColumn("username", norm_login("username")).withColumn("email", norm_login("email"))
        flag = F.col("is_disabled") if "is_disabled" in batch.columns else F.lit(None).cast("boolean")
        batch = batch.withColumn("is_disabled", default_false(flag))
    if table == "newsletter":
        batch = batch.select(row_id, *[c for c in order if c != row_id], "email")
    if table == "about":
        # the about text is a singleton: its row always has id 1
        batch = batch.withColumn(key, F.lit(1).cast(target.schema[key].dataType))
    if table == "order_item":
        total = line_total("quantity", "price").cast(target.schema["total"].dataType)
        batch = batch.withColumn("total", total)
    accepted, rejects = key_conflicts(target, batch, key, order, row_id)
    if s.unique_guards:
        accepted, clashes = guarded_insert(target, accepted, s.unique_guards, order, row_id)
        rejects = rejects.unionByName(clashes)
    keep = [c for c in accepted.columns if c in target.columns or c in order]
    return insert_rows(target, accepted.select(*keep), key, order, as_of=as_of), rejects


def update_products(
    products: DataFrame, categories: DataFrame, changes: DataFrame, seq: str = "seq", as_of=None
) -> tuple[DataFrame, DataFrame]:
    """H3 for products with C9: the change names its category, which must
    resolve (else 404); ``is_disabled`` follows G12 (an explicit value, even
    false or null, overwrites - give ``has_is_disabled`` to send null), the
    resolved category always applies, every other column the falsy rule."""
    if "price" in changes.columns and isinstance(changes.schema["price"].dataType, T.StringType):
        changes = changes.withColumn("price", parse_float("price"))  # G8
    resolved, unknown = resolve_category(changes, categories)
    new, rejects = update_table(
        "products", products, resolved, seq=seq, as_of=as_of,
        mode={"default": "falsy", "is_disabled": "presence", "category_id": "null_only"},
    )
    return new, unknown.unionByName(rejects)


def delete_table(table: str, target: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H5 for one catalog table (no cascade, as in the shop)."""
    from ..catalog import spec

    return apply_deletes(target, ids, spec(table).key[0])
