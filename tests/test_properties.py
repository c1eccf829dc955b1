"""Property tests (hypothesis) with a small example budget: each example runs
Spark jobs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from shopframe.operators import changes as ch
from shopframe.operators import stock
from test_stock_prefix import brute_allocation

SETTINGS = settings(
    max_examples=6, deadline=None, derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)

line = st.tuples(st.integers(1, 4), st.integers(1, 30), st.integers(0, 15))


@SETTINGS
@given(lines=st.lists(line, min_size=1, max_size=40),
       stocks=st.dictionaries(st.integers(1, 3), st.integers(0, 40), min_size=1),
       block_rows=st.sampled_from([1, 2, 2048]))
def test_allocation_equals_sequential_fold(spark, lines, stocks, block_rows):
    data = [(p, o, f"{o}-{i}", q) for i, (p, o, q) in enumerate(lines)]
    ldf = spark.createDataFrame(data, "product_id INT, order_id INT, order_item_id STRING, quantity INT")
    pdf = spark.createDataFrame(list(stocks.items()), "product_id INT, stock INT")
    got = {(r.product_id, r.order_item_id): (r.accepted, r.code)
           for r in stock.sequential_allocation(ldf, pdf, block_rows=block_rows).collect()}
    assert got == brute_allocation(data, stocks)


@SETTINGS
@given(target=st.dictionaries(st.integers(1, 20), st.one_of(st.none(), st.text(max_size=3)), max_size=8),
       staged=st.dictionaries(st.integers(1, 20), st.one_of(st.none(), st.text(max_size=3)), max_size=8))
def test_upsert_is_idempotent_and_exact(spark, target, staged):
    t = spark.createDataFrame(list(target.items()), "k INT, v STRING")
    s = spark.createDataFrame(list(staged.items()), "k INT, v STRING")
    once = ch.upsert(t, s, ["k"])
    want = dict(target)
    want.update(staged)  # staged values win, nulls included
    assert rows(once) == rows(spark.createDataFrame(list(want.items()), "k INT, v STRING"))
    assert rows(ch.upsert(once, s, ["k"])) == rows(once)
