import datetime as dt
from decimal import Decimal
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shopframe.operators import changes as ch


def _products(spark):
    return spark.createDataFrame(
        [(1, "bolt", 1.5, 10, False), (2, "nut", 2.5, 0, True), (3, "gear", 3.5, 7, False)],
        "product_id INT, name STRING, price DOUBLE, stock INT, is_disabled BOOLEAN",
    )


def test_upsert_null_overwrites_and_inserts(spark):
    t = _products(spark)
    s = spark.createDataFrame([(1, None, 9.0), (4, "cog", 4.0)], "product_id INT, name STRING, price DOUBLE")
    got = rows(ch.upsert(t, s, ["product_id"]), "product_id", "name", "price", "stock")
    assert got == [(1, None, 9.0, 10), (2, "nut", 2.5, 0), (3, "gear", 3.5, 7), (4, "cog", 4.0, None)]


def test_upsert_keep_on_conflict_and_idempotent(spark):
    t = spark.createDataFrame([(1, "NL", "a"), (2, "DE", "b")], "delivery_id INT, country STRING, city STRING")
    s = spark.createDataFrame([(1, "FR", "z"), (3, "BE", "y")], "delivery_id INT, country STRING, city STRING")
    once = ch.upsert(t, s, ["delivery_id"], keep_on_conflict=["country"])
    assert rows(once) == [(1, "NL", "z"), (2, "DE", "b"), (3, "BE", "y")]
    twice = ch.upsert(once, s, ["delivery_id"], keep_on_conflict=["country"])
    assert rows(twice) == rows(once)


def test_upsert_duplicate_key_raises(spark):
    t = _products(spark)
    s = spark.createDataFrame([(1, "a"), (1, "b")], "product_id INT, name STRING")
    with pytest.raises(Exception, match="more than once"):
        ch.upsert(t, s, ["product_id"]).collect()


def test_apply_updates_modes(spark):
    t = _products(spark)
    c = spark.createDataFrame(
        [(1, 1, "", 0.0, 4, True, True), (1, 2, "BOLT", None, 0, True, True),
         (3, 1, None, 8.0, None, True, True), (9, 1, "x", 1.0, 1, True, True)],
        "product_id INT, seq INT, name STRING, price DOUBLE, stock INT, has_name BOOLEAN, has_price BOOLEAN",
    )
    new, rej = ch.apply_updates(t, c.drop("has_name", "has_price"), ["product_id"], ["name", "price", "stock"])
    assert rows(new, "product_id", "name", "price", "stock") == [
        (1, "BOLT", 1.5, 4), (2, "nut", 2.5, 0), (3, "gear", 8.0, 7)
    ]
    assert rows(rej) == [(9, 404, "not found")]
    new2, _ = ch.apply_updates(t, c.drop("has_name", "has_price"), ["product_id"], ["name", "price", "stock"], mode="null_only")
    assert rows(new2, "product_id", "name", "price", "stock") == [
        (1, "BOLT", 0.0, 0), (2, "nut", 2.5, 0), (3, "gear", 8.0, 7)
    ]
    new3, _ = ch.apply_updates(t, c.drop("stock"), ["product_id"], ["name", "price"], mode="presence")
    assert rows(new3, "product_id", "name", "price") == [(1, "BOLT", None), (2, "nut", 2.5), (3, None, 8.0)]


def test_apply_updates_path_mismatch_and_stamp(spark):
    t = spark.createDataFrame(
        [(1, "draft", dt.datetime(2000, 1, 1))], "order_id INT, status STRING, updated_at TIMESTAMP"
    )
    c = spark.createDataFrame([(1, 1, 1, "paid"), (1, 2, 5, "draft")], "order_id INT, seq INT, path_id INT, status STRING")
    new, rej = ch.apply_updates(t, c, ["order_id"], ["status"], path_key="path_id",
                                stamp_updated_at=True, as_of="2020-05-05 00:00:00")
    r = new.first()
    assert r.status == "paid" and r.updated_at == dt.datetime(2020, 5, 5)
    assert rows(rej) == [(1, 400, ch.REASON_ID_MISMATCH)]


def test_deletes(spark):
    t = _products(spark)
    ids = spark.createDataFrame([(1,), (42,)], "product_id INT")
    new, summary = ch.apply_deletes(t, ids, "product_id")
    assert rows(new, "product_id") == [(2,), (3,)]
    assert tuple(summary.first()) == (2, 1, 200)
    none = spark.createDataFrame([(42,)], "product_id INT")
    new2, s2 = ch.apply_deletes(t, none, "product_id")
    assert rows(new2) == rows(t) and tuple(s2.first()) == (1, 0, 404)
    _, s3 = ch.apply_deletes(t, none.limit(0), "product_id")
    assert tuple(s3.first()) == (0, 0, 400)
    with pytest.raises(PermissionError):
        ch.truncate(t)
    assert ch.truncate(t, confirm=True).count() == 0


def brute_guarded(existing, batch, guards):
    used = [set((e[i].lower() if ci else e[i]) for e in existing if e[i] is not None) for i, (_, ci) in enumerate(guards)]
    acc, rej = [], {}
    for rid, *vals in sorted(batch, key=lambda r: r[0]):
        normed = [(v.lower() if ci and v is not None else v) for v, (_, ci) in zip(vals, guards)]
        clash = [i for i, v in enumerate(normed) if v is not None and v in used[i]]
        if clash:
            rej[rid] = guards[clash[0]][0]
        else:
            acc.append(rid)
            for i, v in enumerate(normed):
                if v is not None:
                    used[i].add(v)
    return sorted(acc), rej


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_guarded_insert_matches_sequential(spark, seed):
    rnd = random.Random(seed)
    names = ["ann", "Ann", "bob", "cy", "dee", None]
    mails = ["a@x", "A@X", "b@x", "c@x", "d@x", None]
    existing = [("bob", "z@x")]
    batch = [(i, rnd.choice(names), rnd.choice(mails)) for i in range(1, 25)]
    guards = [("username", True), ("email", True)]
    t = spark.createDataFrame(existing, "username STRING, email STRING")
    b = spark.createDataFrame(batch, "rid INT, username STRING, email STRING")
    acc, rej = ch.guarded_insert(t, b, guards, ["rid"], "rid")
    want_acc, want_rej = brute_guarded(existing, batch, guards)
    assert sorted(r.rid for r in acc.collect()) == want_acc
    assert {r.rid: r.reason for r in rej.collect()} == {k: f"{v} already exists" for k, v in want_rej.items()}


def chains(n, length, rnd):
    """Rows that share a username with one neighbour and an e-mail with the
    other, in chains; the rows come in any order."""
    rows = []
    for c in range(n):
        for i in range(length):
            rows.append((f"u{c}-{i // 2}", f"e{c}-{(i + 1) // 2}"))
    rnd.shuffle(rows)
    return [(k, *r) for k, r in enumerate(rows)]


@pytest.mark.parametrize("n,length,fold_rows", [(1, 2000, 20_000), (40, 30, 100), (3, 60, 40)])
def test_chains_of_shared_values(spark, monkeypatch, n, length, fold_rows):
    # one component; many that are folded apart; some too large to be folded
    monkeypatch.setattr(ch, "FOLD_ROWS", fold_rows)
    # in the order of the chain, each row waits for the one before
    batch = chains(n, length, random.Random(n)) if n > 1 else [(i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(length)]
    batch += [(10_000 + i, "hot", f"h{i}") for i in range(50)] + [(20_000, None, None), (20_001, None, "e0"), (20_002, "u0-0", None)]
    existing = [("U5", "x"), ("y", "E7"), ("u1-3", "z")]
    guards = [("username", True), ("email", True)]
    t = spark.createDataFrame(existing, "username STRING, email STRING")
    b = spark.createDataFrame(batch, "rid INT, username STRING, email STRING").repartition(3)
    rounds = []
    fold = ch._fold_components
    monkeypatch.setattr(ch, "_fold_components", lambda *a: (rounds.append(1), fold(*a))[1])
    acc, rej = ch.guarded_insert(t, b, guards, ["rid"], "rid")
    low = lambda x: None if x is None else x.lower()
    used_u, used_e, want = {low(u) for u, _ in existing}, {low(e) for _, e in existing}, set()
    for rid, u, e in sorted(batch):
        if (u is None or low(u) not in used_u) and (e is None or low(e) not in used_e):
            want.add(rid)
            used_u.add(low(u))
            used_e.add(low(e))
    assert {r.rid for r in acc.collect()} == want
    assert {r.rid for r in rej.collect()} == {r[0] for r in batch} - want
    assert rounds == [1]


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    def checkpoints(length):
        calls, real = [], Frame.checkpoint
        with monkeypatch.context() as m:
            m.setattr(Frame, "checkpoint", lambda self, *a, **k: (calls.append(1), real(self, *a, **k))[1])
            batch = [(i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(length)]
            acc, _ = ch.guarded_insert(
                spark.createDataFrame([], "username STRING, email STRING"),
                spark.createDataFrame(batch, "rid INT, username STRING, email STRING"),
                [("username", True), ("email", True)], ["rid"], "rid",
            )
            assert acc.count() == (length + 1) // 2
        return len(calls)

    assert checkpoints(20) == checkpoints(2000)


def test_guarded_insert_case_sensitive_newsletter(spark):
    t = spark.createDataFrame([("a@x",)], "email STRING")
    b = spark.createDataFrame([(1, "A@X"), (2, "a@x"), (3, "A@X")], "rid INT, email STRING")
    acc, rej = ch.guarded_insert(t, b, [("email", False)], ["rid"], "rid")
    assert [r.rid for r in acc.collect()] == [1]
    assert rows(rej, "rid", "code") == [(2, 409), (3, 409)]


def test_allocate_and_insert(spark):
    t = spark.createDataFrame([(5, "x", None, None)], "order_id INT, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
    b = spark.createDataFrame(
        [(None, "a", 3), (None, "b", 1), (50, "c", 2), (None, "d", 2)], "order_id INT, status STRING, seq INT"
    )
    ids = rows(ch.allocate_ids(t, b, "order_id", ["seq"]), "status", "order_id")
    assert ids == [("a", 8), ("b", 6), ("c", 50), ("d", 7)]
    new = ch.insert_rows(t, b.drop("seq").withColumn("seq", F.lit(1)).drop("seq"), "order_id", ["status"], as_of="2021-01-01 00:00:00")
    got = rows(new, "order_id", "status")
    assert got == [(5, "x"), (50, "c"), (6, "a"), (7, "b"), (8, "d")]
    assert new.where("order_id = 6").first().created_at == dt.datetime(2021, 1, 1)
    empty = t.limit(0)
    assert rows(ch.allocate_ids(empty, b.where("order_id IS NULL"), "order_id", ["seq"]), "status", "order_id") == [
        ("a", 3), ("b", 1), ("d", 2)
    ]


def test_resolve_category_notices_transitions(spark):
    cats = spark.createDataFrame([(3, "Tools"), (2, "Tools"), (5, "Parts")], "category_id INT, category STRING")
    chg = spark.createDataFrame([(1, "Tools"), (2, "Nope")], "product_id INT, category STRING")
    ok, bad = ch.resolve_category(chg, cats)
    assert rows(ok) == [(1, 2)]
    assert rows(bad) == [(2, 404, "Category not found")]
    orders = spark.createDataFrame([(1, "draft"), (2, "paid"), (3, "draft")], "order_id INT, status STRING")
    changes = spark.createDataFrame(
        [(1, 1, "pending_approval"), (2, 9, "pending_approval"), (3, 1, "pending_approval")],
        "event_id INT, order_id INT, status STRING",
    )
    notes = ch.approval_notices(changes, orders).collect()
    assert sorted(n.event_id for n in notes) == [1, 3]
    assert notes[0].subject == "New Order Placed"
    after = spark.createDataFrame([(1, "paid"), (2, "paid"), (3, "draft"), (4, "paid")], "order_id INT, status STRING")
    assert rows(ch.paid_transitions(orders, after)) == [(1,), (4,)]


def test_table_level_jobs(spark):
    users = spark.createDataFrame(
        [(1, "ann", "ann@x", None, False, None, None, "customer")],
        "user_id INT, username STRING, email STRING, password STRING, is_disabled BOOLEAN, "
        "created_at TIMESTAMP, updated_at TIMESTAMP, user_type STRING",
    )
    batch = spark.createDataFrame(
        [(1, "Bob", "BOB@X", None), (2, "ANN", "new@x", True), (3, "bob", "other@x", None), (4, "Cy", "cy@x", None)],
        "rid INT, username STRING, email STRING, is_disabled BOOLEAN",
    )
    new, rej = ch.insert_table("users", users, batch, ["rid"], "rid", as_of="2022-02-02 00:00:00")
    got = rows(new, "user_id", "username", "email", "is_disabled")
    assert got == [(1, "ann", "ann@x", False), (2, "bob", "bob@x", False), (3, "cy", "cy@x", False)]
    assert rows(rej) == [(2, 409, "username already exists"), (3, 409, "username already exists")]
    upd = spark.createDataFrame([(2, 1, "ROBERT")], "user_id INT, seq INT, username STRING")
    new2, _ = ch.update_table("users", new, upd, as_of="2023-03-03 00:00:00")
    r = new2.where("user_id = 2").first()
    assert r.username == "robert" and r.updated_at == dt.datetime(2023, 3, 3)
    cats = spark.createDataFrame([(1, "Tools", False)], "category_id INT, category STRING, is_disabled BOOLEAN")
    cnew, _ = ch.update_table("categories", cats, spark.createDataFrame([(1, 1, "Kit")], "category_id INT, seq INT, category STRING"))
    assert rows(cnew) == [(1, "Kit", False)]  # categories carry no updated_at
    gone, summary = ch.delete_table("users", new, spark.createDataFrame([(1,)], "user_id INT"))
    assert gone.count() == 2 and summary.first().code == 200


def test_about_singleton(spark):
    from shopframe.operators.views import singleton

    about = spark.createDataFrame([(1, "story", "m", "v", None), (2, "x", "y", "z", None)],
                                  "about_id INT, our_story STRING, mission STRING, vision STRING, images STRING")
    assert [r.our_story for r in singleton(about).collect()] == ["story"]


def test_order_item_totals_recomputed_and_about_id(spark):
    items = spark.createDataFrame(
        [(1, 2, Decimal("3.00"), None, None, 10, Decimal("6.00"), 100)],
        "product_id INT, quantity INT, price DECIMAL(18,2), created_at TIMESTAMP, updated_at TIMESTAMP, "
        "order_id INT, total DECIMAL(18,2), order_item_id INT",
    )
    upd = spark.createDataFrame([(100, 1, 5, Decimal("999.00"))], "order_item_id INT, seq INT, quantity INT, total DECIMAL(18,2)")
    new, _ = ch.update_table("order_item", items, upd)
    assert float(new.first().total) == 15.0
    batch = spark.createDataFrame([(7, 1, 4, Decimal("2.50"), 10, Decimal("0.00"))],
                                  "rid INT, product_id INT, quantity INT, price DECIMAL(18,2), order_id INT, total DECIMAL(18,2)")
    new2, _ = ch.insert_table("order_item", items, batch, ["rid"], "rid")
    assert float(new2.where("order_item_id = 101").first().total) == 10.0
    about = spark.createDataFrame([], "about_id INT, our_story STRING, mission STRING, vision STRING, images STRING")
    a, _ = ch.insert_table("about", about, spark.createDataFrame([(1, "s")], "rid INT, our_story STRING"), ["rid"], "rid")
    assert [r.about_id for r in a.collect()] == [1]


def test_update_products_rules(spark):
    products = spark.createDataFrame(
        [(1, "bolt", 1.5, 10, True, 1, None), (2, "nut", 2.5, 3, False, 2, None)],
        "product_id INT, name STRING, price DOUBLE, stock INT, is_disabled BOOLEAN, category_id INT, updated_at TIMESTAMP",
    )
    cats = spark.createDataFrame([(1, "Tools"), (2, "Parts")], "category_id INT, category STRING")
    chg = spark.createDataFrame(
        [(1, 1, "", 0.0, 0, False, "Parts"), (2, 1, "NUT", None, 5, None, "Tools"), (3, 1, "x", 1.0, 1, True, "Nope")],
        "product_id INT, seq INT, name STRING, price DOUBLE, stock INT, is_disabled BOOLEAN, category STRING",
    )
    new, rej = ch.update_products(products, cats, chg, as_of="2024-05-05 00:00:00")
    got = rows(new, "product_id", "name", "price", "stock", "is_disabled", "category_id")
    # falsy name/price/stock keep the old values; false is_disabled overwrites; category always applies
    assert got == [(1, "bolt", 1.5, 10, False, 2), (2, "NUT", 2.5, 5, False, 1)]
    assert rows(rej) == [(3, 404, "Category not found")]


def test_upsert_duplicate_check_cannot_be_pruned(spark):
    t = _products(spark)
    s = spark.createDataFrame([(1, "a"), (1, "b")], "product_id INT, name STRING")
    for use in (lambda df: df.count(), lambda df: df.select("product_id").collect(), lambda df: df.select("stock").collect()):
        with pytest.raises(Exception, match="more than once"):
            use(ch.upsert(t, s, ["product_id"]))


def test_one_update_leaves_other_totals_alone(spark):
    items = spark.createDataFrame(
        [(1, 2, Decimal("3.00"), 10, Decimal("6.00"), 100), (1, 3, Decimal("2.22"), 10, Decimal("6.67"), 101)],
        "product_id INT, quantity INT, price DECIMAL(18,2), order_id INT, total DECIMAL(18,2), order_item_id INT",
    )
    upd = spark.createDataFrame([(100, 1, 5)], "order_item_id INT, seq INT, quantity INT")
    new, _ = ch.update_table("order_item", items, upd)
    assert rows(new, "order_item_id", "total") == [(100, Decimal("15.00")), (101, Decimal("6.67"))]
    more = spark.createDataFrame([(7, 1, 4, Decimal("2.50"), 10)], "rid INT, product_id INT, quantity INT, price DECIMAL(18,2), order_id INT")
    new2, _ = ch.insert_table("order_item", items, more, ["rid"], "rid")
    assert rows(new2, "order_item_id", "total") == [(100, Decimal("6.00")), (101, Decimal("6.67")), (102, Decimal("10.00"))]


def test_key_conflicts_are_rejected_and_ids_stay_unique(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "category_id INT, category STRING")
    b = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (3, None, "z"), (4, 3, "w")], "rid INT, category_id INT, category STRING")
    new, rej = ch.insert_table("categories", t, b, ["rid"], "rid")
    assert rows(new) == [(1, "a"), (2, "b"), (3, "y"), (4, "z")]
    assert rows(rej, "rid", "code") == [(1, 409), (4, 409)]
    about = spark.createDataFrame([(1, "s")], "about_id INT, our_story STRING")
    again, rej = ch.insert_table("about", about, spark.createDataFrame([(1, "t")], "rid INT, our_story STRING"), ["rid"], "rid")
    assert rows(again) == [(1, "s")] and rows(rej, "rid", "code") == [(1, 409)]


def test_update_sets_only_updatable_columns(spark):
    t = spark.createDataFrame([(1, 5, "draft", dt.datetime(2000, 1, 1))], "order_id INT, user_id INT, status STRING, created_at TIMESTAMP")
    c = spark.createDataFrame([(1, 1, "paid", dt.datetime(1990, 1, 1))], "order_id INT, seq INT, status STRING, created_at TIMESTAMP")
    new, _ = ch.update_table("orders", t, c)
    assert rows(new) == [(1, 5, "paid", dt.datetime(2000, 1, 1))]


def test_repeated_delete_ids_count_once(spark):
    t = _products(spark)
    _, summary = ch.apply_deletes(t, spark.createDataFrame([(1,), (1,), (1,)], "product_id INT"), "product_id")
    assert tuple(summary.first()) == (3, 1, 200)


def test_hot_guard_value_meets_the_table_once(spark):
    """A third of the sign-ups share one e-mail that the table has: with one
    guard only a row per value is joined with the table."""
    b = spark.range(60_000, numPartitions=8).select(
        F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "hot@x").otherwise(F.concat("id", F.lit("@x"))).alias("email")
    )
    t = spark.range(500).select(F.concat(F.col("id") * 7, F.lit("@x")).alias("email")).unionByName(
        spark.createDataFrame([("hot@x",)], "email STRING"))
    acc, rej = ch.guarded_insert(t, b, [("email", False)], ["rid"], "rid")
    clashing = sum(1 for i in range(500) if 7 * i % 3)  # ids that are no multiple of 3 and in the table
    assert acc.count() == 40_000 - clashing and acc.count() + rej.count() == 60_000
    plan = acc._jdf.queryExecution().optimizedPlan().toString().split("\n")
    anti = next(i for i, x in enumerate(plan) if "LeftAnti" in x)
    assert any("Aggregate" in x for x in plan[anti + 1:anti + 4])


def test_allocated_ids_pass_over_given_ones(spark):
    rnd = random.Random(4)
    t = spark.createDataFrame([(3,), (10,)], "k INT")
    given = rnd.sample(range(11, 60), 20)
    batch = [(g, i) for i, g in enumerate(given)] + [(None, 100 + i) for i in range(30)]
    got = ch.allocate_ids(t, spark.createDataFrame(batch, "k INT, seq INT"), "k", ["seq"])
    free = iter(k for k in range(11, 200) if k not in given)
    assert rows(got, "seq", "k") == sorted([(i, g) for i, g in enumerate(given)] + [(100 + i, next(free)) for i in range(30)], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("block", [4096, 4])
def test_fresh_ids_pass_over_carried_ones(spark, monkeypatch, block):
    monkeypatch.setattr(ch, "ID_BLOCK", block)
    rnd = random.Random(block)
    target = spark.createDataFrame([(5,), (9,)], "order_id INT")
    for carried in ([], [10], [11, 12, 13, 14, 15], [10, 12, 40, 41, 2_000_000_000], [9, 3], list(range(10, 60, 2)) + [10, 12]):
        batch = [(i, None) for i in range(30)] + [(100 + i, c) for i, c in enumerate(carried)]
        rnd.shuffle(batch)
        got = ch.allocate_ids(target, spark.createDataFrame(batch, "rid INT, order_id INT").repartition(3), "order_id", ["rid"])
        free = iter(n for n in range(10, 1000) if n not in carried)
        want = {i: next(free) for i in range(30)} | {100 + i: c for i, c in enumerate(carried)}
        assert {r.rid: r.order_id for r in got.collect()} == want
        assert got.schema["order_id"].dataType.simpleString() == "int"


def test_ids_take_one_global_numbering(spark, monkeypatch):
    calls = []
    number = ch.global_row_number
    monkeypatch.setattr(ch, "global_row_number", lambda *a: (calls.append(1), number(*a))[1])
    batch = spark.createDataFrame([(i, None if i % 2 else 8 + i) for i in range(50)], "rid INT, order_id INT")
    ids = [r.order_id for r in ch.allocate_ids(spark.createDataFrame([(9,)], "order_id INT"), batch, "order_id", ["rid"]).collect()]
    assert len(set(ids)) == 50 and calls == [1]


def test_upsert_shuffles_staged_rows_once_at_most(spark):
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    t = spark.createDataFrame([(1, "NL", "a"), (2, "DE", "b"), (None, "X", "c")], "k INT, country STRING, city STRING")
    s = spark.createDataFrame([(1, "FR", "z"), (3, "BE", "y"), (None, "Y", "d")], "k INT, country STRING, city STRING")
    whole = ch.upsert(t, s, ["k"])
    assert exchanges(whole) == 0  # the keys were compared, the rows stay where they are
    assert rows(whole) == [(1, "FR", "z"), (2, "DE", "b"), (3, "BE", "y"), (None, "X", "c"), (None, "Y", "d")]
    assert exchanges(ch.upsert(t, s, ["k"], keep_on_conflict=["country"])) == 2  # one a side, with the duplicate check


def test_upsert_keeps_repeated_target_rows(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e")], "k INT, v STRING")
    s = spark.createDataFrame([(1, "x"), (3, "y")], "k INT, v STRING")
    assert rows(ch.upsert(t, s, ["k"])) == [(1, "x"), (1, "x"), (2, "c"), (2, "d"), (3, "y")]
    with pytest.raises(Exception, match="more than once"):
        ch.upsert(t.limit(0), s.unionByName(s), ["k"]).count()
