"""Stock checks (C5, G10) and stock decrement for paid orders.

Sequential allocation (H7): the lines of each product are taken in ``order``
(order id, line id; then quantity); a line is accepted when the stock left
after it would not be negative, otherwise it is skipped and the stock is
unchanged.  This is an order-dependent greedy fold with one meaning on every
path:

* every line gets a global rank in (product, order), its key from then on, so
  repeated line ids stay separate lines;
* a null stock or quantity counts as 0; a negative quantity is refused; a line
  of 0 is accepted unless the stock is negative.  Neither changes the stock.

A product whose whole demand fits its stock accepts every line (one sum per
product decides that).  The lines of the others are cut into blocks of
consecutive ranks, an array a block, and all products go on side by side in
passes.  A pass knows each product's remaining stock ``r`` and next block, and
the power of two ``2^k <= r < 2^(k+1)``.  As long as the remaining stock stays
at ``2^k`` or above

* lines below ``2^k`` fit, all of them;
* lines of ``2^(k+1)`` or more never fit again;
* a line in between, if it fits, leaves less than ``2^k``.

So a block's sum of the small lines, and the least stock at its beginning with
which some line in between fits, tell whether the product's stock can fall
below ``2^k`` in it.  The first such block, found by a running sum over one
row per block, is folded line by line (the built-in ``aggregate`` over one
bounded array); the blocks before it accept their small lines.  Each pass
lowers a product's ``k``, so there are at most as many passes as the largest
stock has binary digits - 31 for an INT column, whatever the lines are - and
never more than a product has blocks.  A hot product's blocks spread over all
tasks; one task holds one row per block of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_int
from ..plans.ranking import global_row_number
from ..session import checkpoint_root, scratch_path

# Outcome codes and messages of the stock operations.
CODE_OK = 200
CODE_BAD_REQUEST = 400
CODE_NOT_FOUND = 404
CODE_INSUFFICIENT = 422
ERR_ORDER = "order not found"
ERR_ITEM = "unable to fetch order item stock quantity"
ERR_PRODUCT = "unable to fetch product quantity"
ERR_INSUFFICIENT = "Insufficient stock."
ERR_NEGATIVE = "Insufficient stock"
ERR_NO_PRODUCT = "Product not found"
ERR_NO_LINES = "Order items not found"
ERR_BAD_IDS = "Invalid order ID or order Item ID"
ERR_SOME_FAILED = "Some stock updates failed"
CODE_PARTIAL_FAILURE = 500


def stock_check(
    requests: DataFrame, orders: DataFrame, order_item: DataFrame, products: DataFrame
) -> DataFrame:
    """For each request ``(order_id, order_item_id, product_id)`` look up
    the three ids independently and report ``(p_name, quantity=stock, code,
    error)``.  Priority: all ids null 400 > order missing 404 > line missing
    404 > product missing 404 > line quantity above stock 422 > 200."""
    # ids given as text (request paths) are parsed like JS parseInt: '12abc'
    # is 12, 'abc' is null (G7); typed ids pass through
    id_cols = ("order_id", "order_item_id", "product_id")
    key_types = {"order_id": orders, "order_item_id": order_item, "product_id": products}
    parsed = []
    for c in requests.columns:
        if c in id_cols and isinstance(requests.schema[c].dataType, T.StringType) and not isinstance(
            key_types[c].schema[c].dataType, T.StringType
        ):
            parsed.append(parse_int(c).cast(key_types[c].schema[c].dataType).alias(c))
        else:
            parsed.append(F.col(c))
    requests = requests.select(*parsed)
    # three independent keyed lookups, each cut down to the requested ids
    # first, so a small request moves no table.  A line id can repeat in
    # loaded data; the lookup answers one row per id: the lowest order id,
    # then quantity, by two aggregates of plain columns.
    # The hash of the id goes along as a second key, so the answers are dealt
    # out otherwise than the joins back to the requests want them: both sides
    # of those have a plain exchange, and adaptive execution can split an id
    # that a large part of the requests names.
    def requested(table: DataFrame, c: str) -> DataFrame:
        mark = F.xxhash64(F.col(c).cast("string")).alias("_h")
        wanted = requests.where(F.col(c).isNotNull()).select(c).distinct().select(c, mark)
        return table.select("*", mark).join(wanted, [c, "_h"], "left_semi")

    def once(found: DataFrame, c: str, *aggs) -> DataFrame:
        return found.groupBy(c, "_h").agg(*aggs).drop("_h")

    o = once(requested(orders, "order_id"), "order_id", F.lit(True).alias("_o"))
    i = requested(order_item, "order_item_id")
    found = F.lit(True).alias("_item_found")
    if "order_id" in order_item.columns:
        lowest = i.groupBy("order_item_id", "_h", "order_id").agg(F.min("quantity").alias("_q"))
        i = once(lowest, "order_item_id", F.min_by("_q", "order_id").alias("_item_qty"), found)
    else:
        i = once(i, "order_item_id", F.min("quantity").alias("_item_qty"), found)
    p = once(
        requested(products, "product_id"), "product_id",
        F.min("name").alias("p_name"), F.min("stock").alias("_stock"), F.lit(True).alias("_p"),
    )
    j = (
        requests.join(o, "order_id", "left")
        .join(i, "order_item_id", "left")
        .join(p, "product_id", "left")
    )
    all_null = F.col("order_id").isNull() & F.col("order_item_id").isNull() & F.col("product_id").isNull()
    item_missing = F.col("_item_found").isNull()
    insufficient = F.col("_item_qty") > F.coalesce(F.col("_stock"), F.lit(0))
    code = (
        F.when(all_null, F.lit(CODE_BAD_REQUEST))
        .when(F.col("_o").isNull(), F.lit(CODE_NOT_FOUND))
        .when(item_missing, F.lit(CODE_NOT_FOUND))
        .when(F.col("_p").isNull(), F.lit(CODE_NOT_FOUND))
        .when(insufficient, F.lit(CODE_INSUFFICIENT))
        .otherwise(F.lit(CODE_OK))
    )
    error = (
        F.when(all_null, F.lit(ERR_BAD_IDS))
        .when(F.col("_o").isNull(), F.lit(ERR_ORDER))
        .when(item_missing, F.lit(ERR_ITEM))
        .when(F.col("_p").isNull(), F.lit(ERR_PRODUCT))
        .when(insufficient, F.lit(ERR_INSUFFICIENT))
    )
    found = F.col("_p").isNotNull() & F.col("_o").isNotNull() & ~item_missing
    return j.select(
        *requests.columns,
        F.when(found, F.col("p_name")).alias("p_name"),
        F.when(found, F.col("_stock")).alias("quantity"),
        code.alias("code"),
        error.alias("error"),
    )


def paid_lines(order_item: DataFrame, orders: DataFrame, status: str = "paid") -> DataFrame:
    """Lines of orders in ``status`` (semi join: orders are never widened)."""
    wanted = orders.where(F.col("status") == status).select("order_id")
    return order_item.join(wanted, "order_id", "left_semi")


def stock_after_demand(products: DataFrame, lines: DataFrame) -> DataFrame:
    """H7 ``mode='per_product'`` + G10: a product's whole demand is applied
    at once when it fits (``stock - demand >= 0``, code 200), else the stock
    is left unchanged (code 400)."""
    demand = lines.groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("_d"))
    left = F.col("stock") - F.coalesce(F.col("_d"), F.lit(0))
    return products.select("product_id", "stock").join(demand, "product_id", "left").select(
        "product_id",
        F.when(left < 0, F.col("stock")).otherwise(left).alias("stock"),
        F.when(left < 0, F.lit(CODE_BAD_REQUEST)).otherwise(F.lit(CODE_OK)).alias("code"),
    )


# Lines of a block: one bounded array, folded by one task.
BLOCK_ROWS = 2048


def sequential_allocation(
    lines: DataFrame, products: DataFrame, order=("order_id", "order_item_id"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """H7 ``mode='sequential'`` (E4): ``(product_id, order_id, order_item_id,
    quantity, accepted, code, error)`` and further ``order`` columns for every
    line; lines of an unknown product get ``accepted = false`` and code 404.
    """
    extra = [c for c in order if c not in ("order_id", "order_item_id")]
    cols = ["product_id", "order_id", "order_item_id", "quantity", *extra]
    plain = lines.select(
        "product_id", "order_id", "order_item_id",
        F.coalesce(F.col("quantity"), F.lit(0)).cast("bigint").alias("quantity"), *extra,
    )
    # the one copy of the lines: ranked, and written to the checkpoint folder;
    # from here on, rank, product and quantity stand for a line until the end
    base = global_row_number(plain, ["product_id", *order, "quantity"], "rank")
    narrow = base.select("rank", "product_id", "quantity")
    stock = products.select("product_id", F.coalesce(F.col("stock").cast("bigint"), F.lit(0)).alias("stock"))
    positive = F.col("quantity") > 0
    demand = narrow.where(positive).groupBy("product_id").agg(F.sum("quantity").alias("_d"))
    # one row per product: small next to the lines
    cls = stock.join(demand, "product_id", "left").select(
        "product_id", "stock", (F.coalesce(F.col("_d"), F.lit(0)) > F.col("stock")).alias("contended")
    ).checkpoint(eager=True)
    # the lines meet their class once, in files that all later steps read
    classed = _written(narrow.join(cls, "product_id", "left").withColumn(
        "_contended", F.coalesce("contended", F.lit(False)) & positive
    ), "allocation-lines")
    settled = classed.where("not _contended").select(
        "rank", F.col("contended").isNull().alias("_unknown"),
        F.when(F.col("contended").isNull() | (F.col("quantity") < 0), F.lit(False))
        .when(F.col("quantity") == 0, F.col("stock") >= 0).otherwise(F.lit(True)).alias("accepted"),
    )
    work = classed.where("_contended").select("rank", "product_id", "quantity")
    spans, folded = _passes(work, cls.where("contended"), block_rows)
    if spans is None:  # nothing is contended, or no contended product has stock
        decided = work.withColumn("accepted", F.lit(False))
    else:
        block = F.floor(F.col("rank") / F.lit(block_rows))
        decided = work.join(spans, "product_id", "left").withColumn("accepted", F.coalesce(F.exists(
            "spans", lambda x: (block >= x["first"]) & (block < x["end"]) & (F.col("quantity") < x["below"])
        ), F.lit(False)))
    out = base.join(settled.unionByName(decided.select("rank", F.lit(False).alias("_unknown"), "accepted")), "rank")
    if spans is not None:
        out = out.join(folded, "rank", "left").withColumn("accepted", F.coalesce("fits", "accepted"))
    code = (
        F.when(F.col("_unknown"), F.lit(CODE_NOT_FOUND))
        .when(F.col("accepted"), F.lit(CODE_OK))
        .otherwise(F.lit(CODE_BAD_REQUEST))
    )
    error = (
        F.when(F.col("_unknown"), F.lit(ERR_NO_PRODUCT))
        .when(~F.col("accepted"), F.lit(ERR_NEGATIVE))
    )
    return out.select(*cols, "accepted", code.alias("code"), error.alias("error"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from files in the checkpoint folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _passes(work: DataFrame, contended: DataFrame, block_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Per product the ``spans`` of blocks that accept their lines ``below`` a
    bound, and ``(rank, fits)`` for the lines of folded blocks.

    The blocks are written once; a pass writes one row per product that is
    still going on: its span, the block it folded and the stock left.  Both
    lie in the shared checkpoint folder, so a pass reads files and lineage
    never grows.  A product ends with its last block, and the state of the
    next pass is a file of its own: once few products are left, the planner
    broadcasts them and the blocks stay where they are."""
    checkpoint_root(work.sparkSession)
    blocks = _written(
        work.select("product_id", F.floor(F.col("rank") / F.lit(block_rows)).alias("block"), F.struct("rank", "quantity").alias("line"))
        .groupBy("product_id", "block").agg(F.sort_array(F.collect_list("line")).alias("ls")),
        "allocation-blocks",
    )
    last = blocks.groupBy("product_id").agg(F.max("block").alias("last"))
    state = contended.where(F.col("stock") > 0).join(last, "product_id").select(
        "product_id", F.col("stock").alias("r"), F.lit(0).cast("bigint").alias("first"), "last"
    )
    done: list[DataFrame] = []
    while not state.isEmpty():
        now = _written(_pass(blocks, state), "allocation-pass")
        done.append(now)
        state = _written(now.where("left > 0 and end < last").select(
            "product_id", F.col("left").alias("r"), (F.col("end") + 1).alias("first"), "last"
        ), "allocation-state")
    if not done:
        return None, None
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    spans = every.groupBy("product_id").agg(
        F.collect_list(F.struct("first", F.coalesce("end", F.lit(1 << 62)).alias("end"), "below")).alias("spans")
    )
    folded = every.select(F.explode(F.arrays_zip("ranks", "flags")).alias("x")).select(
        F.col("x.ranks").alias("rank"), F.col("x.flags").alias("fits")
    )
    return spans, folded


def _pass(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """One row per product of ``state``: blocks ``first`` up to ``end`` accept
    their lines ``below`` the bound; block ``end`` (null: there is none) is
    folded into ``ranks``, ``flags`` and the stock ``left``."""
    # the power of two at or below r: its binary text gives the digits
    now = state.withColumn("below", F.expr("shiftleft(1L, length(bin(r)) - 1)"))

    def met(acc, x):
        small = x < F.col("below")
        between = ~small & (x - F.col("below") < F.col("below"))
        return F.struct(
            F.when(small, acc["sum"] + x).otherwise(acc["sum"]).alias("sum"),
            F.when(between, F.least(acc["need"], acc["sum"] + x)).otherwise(acc["need"]).alias("need"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(1 << 62).cast("bigint").alias("need"))
    summed = (
        blocks.select("product_id", "block", F.col("ls.quantity").alias("qs"))
        .join(now, "product_id").where(F.col("block") >= F.col("first"))
        .select("product_id", "block", "r", "below", F.aggregate("qs", start, met).alias("b"))
    )
    before = Window.partitionBy("product_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reached = summed.select(
        "product_id", "block", "below", "b",
        (F.col("r") - F.coalesce(F.sum("b.sum").over(before), F.lit(0))).alias("r"),
    ).where((F.col("r") - F.col("b.sum") < F.col("below")) | (F.col("b.need") <= F.col("r")))
    end = _written(reached.groupBy("product_id").agg(F.min(F.struct("block", "r")).alias("e")), "allocation-ends")

    def fold(acc, x):
        fits = x["quantity"] <= acc["r"]
        return F.struct(
            F.when(fits, acc["r"] - x["quantity"]).otherwise(acc["r"]).alias("r"),
            F.array_append(acc["flags"], fits).alias("flags"),
        )

    folded = (
        blocks.join(end.select("product_id", F.col("e.block").alias("block"), F.col("e.r").alias("r")), ["product_id", "block"])
        .select(
            "product_id", F.col("block").alias("end"), F.col("ls.rank").alias("ranks"),
            F.aggregate("ls", F.struct(F.col("r").alias("r"), F.array().cast("array<boolean>").alias("flags")), fold).alias("f"),
        )
        .select("product_id", "end", "ranks", F.col("f.flags").alias("flags"), F.col("f.r").alias("left"))
    )
    return now.join(folded, "product_id", "left").select("product_id", "first", "end", "last", "below", "left", "ranks", "flags")


def allocation_outcome(paid_orders: DataFrame, allocation: DataFrame, keys=("order_id",)) -> DataFrame:
    """H7 per order (or per request, by ``keys``): ``(*keys, code, error)`` -
    404 when the order has no lines, 500 when any of its lines was refused
    (unknown product or not enough stock; the accepted lines stay applied),
    else 200.  One aggregate per order, pre-aggregated per task."""
    keys = list(keys)
    per_order = allocation.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(F.col("code") != CODE_OK).alias("_bad")
    )
    j = paid_orders.select(*keys).join(per_order, keys, "left")
    code = (
        F.when(F.coalesce(F.col("_lines"), F.lit(0)) == 0, F.lit(CODE_NOT_FOUND))
        .when(F.col("_bad") > 0, F.lit(CODE_PARTIAL_FAILURE))
        .otherwise(F.lit(CODE_OK))
    )
    error = (
        F.when(F.coalesce(F.col("_lines"), F.lit(0)) == 0, F.lit(ERR_NO_LINES))
        .when(F.col("_bad") > 0, F.lit(ERR_SOME_FAILED))
    )
    return j.select(*keys, code.alias("code"), error.alias("error"))


def apply_allocation(products: DataFrame, allocation: DataFrame) -> DataFrame:
    """New products table after an allocation: stock minus accepted demand."""
    taken = allocation.where("accepted").groupBy("product_id").agg(F.sum("quantity").alias("_t"))
    return products.join(taken, "product_id", "left").withColumn(
        "stock", (F.col("stock") - F.coalesce(F.col("_t"), F.lit(0))).cast(products.schema["stock"].dataType)
    ).select(*products.columns)
