import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))
import __spark_entry__ as E  # noqa: E402
from shopframe.plans.queries import QUERIES as SHOP_QUERIES  # noqa: E402
from check_oracles import _rows, _spark_type  # noqa: E402
from shopframe.sources.shop_tables import TEST_TABLES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "paid", "pending_approval", "draft", "Pending"]
    assert df.count() > 0
    months = [r.month for r in df.collect()]
    assert months == sorted(months)


def test_every_shop_query_has_an_oracle():
    # the corpus operators, an optional part, bring tests of their own
    assert set(SHOP_QUERIES) <= set(E.queries()) and set(SHOP_QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SHOP_QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    otypes = {d[0]: str(d[1]) for d in res.description}
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert {c: _spark_type(sdf.schema[c].dataType) for c in sdf.columns} == otypes
    assert len(srows) == len(orows)
    assert _rows(sdf.columns, srows) == _rows(ocols, orows)
