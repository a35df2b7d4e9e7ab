"""Operators over whole tables, where a registered query shows only a part."""

import pyarrow.parquet as pq
from oracle import compare, connect

from veduta.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_unnest_of_every_order(spark):
    con = connect(SF)
    for name in ("unnest_all", "unnest_parent_all"):
        got, want = compare(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])
        assert got == want
    items = catalogue.QUERIES["unnest_all"](spark, SF)
    orders = [int(r.order_id.removeprefix("acc:")) for r in items.select("order_id").collect()]
    assert len(orders) == pq.read_metadata(f"{SF}/lineitem.parquet").num_rows and orders == sorted(orders)
    parents = [r.l_orderkey for r in catalogue.QUERIES["unnest_parent_all"](spark, SF).collect()]
    assert parents == sorted(set(orders))
