"""Registry integrity and a sample of queries against their SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barloom.operators import attribution as at
from barloom.operators import events as ev
from barloom.plans.attribution_queries import GRID
from barloom.plans.portfolio_queries import TWO, named_returns
from compare import connect, differences

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "mom_slow", "amihud_illiq", "information_coefficient", "simulate", "covariance_constant_correlation", "dollar_volume_bars",
    "triple_barrier_labels", "combinatorial_purged_cv", "kelly_bin_edges", "clean_tick_stream", "rebalance_plan", "order_lifecycle_audit",
]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(entry.oracle_sql()[name]).fetchdf()
    d = differences(got, want)
    assert not d or d.startswith("~"), d


def test_combinatorial_folds_of_fewer_events_than_groups(spark):
    lb = pd.DataFrame([(s, t, t + 4) for s, n in (("a", 5), ("b", 9), ("c", 1)) for t in range(0, 30 * n, 30)], columns=["symbol", "t0", "t1"])
    got = ev.combinatorial_purged(spark.createDataFrame(lb)).toPandas()
    sql = entry.oracle_sql()["combinatorial_purged_cv"]
    want = duckdb.execute("WITH " + sql[sql.index("g0 AS (") :]).fetchdf()
    assert len(got) == 15 * len(lb) and differences(got[want.columns], want) is None


def test_kelly_table_and_lookup_have_ten_bins(spark):
    cells = entry.queries()["kelly_table"](spark, SF).select("p_bin", "chop_bin").collect()
    assert {r.p_bin for r in cells} == {r.chop_bin for r in cells} == set(range(10))
    got = entry.queries()["kelly_lookup"](spark, SF).agg({"p_bin": "max", "chop_bin": "max"}).first()
    assert tuple(got) == (9, 9)


def test_path_risk_grid_covers_every_strategy(spark):
    r = named_returns(spark, SF)
    got = entry.queries()["path_risk_grid"](spark, SF).toPandas()
    assert "ofi_fast" in set(got.name)
    for name in TWO:  # mom_fast has no whole period at this scale
        want = at.path_risk(r.filter(r["name"] == name), GRID, 6).orderBy("leverage").toPandas()
        part = got[got.name == name].sort_values("leverage")[want.columns]
        assert len(part) == len(want) and (abs(part.to_numpy() - want.to_numpy()) <= 1e-6).all()  # queries round


def test_path_risk_by_strategy_is_that_of_each_alone(spark):
    rows = [(n, i, 0.01 * ((i * k) % 7 - 3)) for n, k in (("a", 3), ("b", 5)) for i in range(40)]
    r = spark.createDataFrame(rows, "name string, ti int, ret double")
    got = {(x.name, x.leverage): (x.max_dd, x.ruin_share) for x in at.path_risk(r, GRID, 6, keys=["name"]).collect()}
    want = {(n, x.leverage): (x.max_dd, x.ruin_share) for n in "ab" for x in at.path_risk(r.filter(r["name"] == n), GRID, 6).collect()}
    assert len(got) == 10 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
