"""Sources, row ids and sinks."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veduta.operators.engine import Engine
from veduta.sources.tables import ROW, WINDOWED_FROM, bridge, column_definitions, columnar, load, windowed, with_row_id

SF = "/root/testdata/sf0.01"


def plan(df):
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        return df._jdf.queryExecution().toString()
    finally:
        conf.unset("spark.sql.maxMetadataStringLength")


def test_row_ids_come_from_the_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    before = list(df.columns)
    p = plan(with_row_id(df).where("l_quantity > 40").select(ROW, "l_orderkey"))
    assert "FileScan parquet" in p and "ExistingRDD" not in p and "Python" not in p
    assert "GreaterThan(l_quantity,40.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,_tmp_metadata_row_index:bigint>" in p
    assert df.columns == before and df.schema.names == before


def test_requests_that_need_no_row_id_make_none(spark):
    e = Engine(spark.read.parquet(f"{SF}/lineitem.parquet"))
    for df in (e.aggregates(None, [{"id": "n", "col": "l_quantity", "fn": "sum"}]), e.distinct_values("l_returnflag"), e.chart("l_returnflag", "l_quantity"), e.matching({"quick": "x"}, ids=False)):
        assert "row_index" not in plan(df)
    assert "df" not in e.__dict__


@pytest.mark.parametrize(
    "leaf,pushed",
    [
        ({"col": "o_totalprice", "op": "gt", "value": 1000}, "GreaterThan(o_totalprice,1000.0)"),
        ({"col": "o_totalprice", "op": "in", "value": [1, 2.5]}, "In(o_totalprice, [1.0,2.5])"),
        ({"col": "o_custkey", "op": "gte", "value": "10.5"}, "GreaterThan(o_custkey,10)"),
        ({"col": "o_custkey", "op": "eq", "value": 7}, "EqualTo(o_custkey,7)"),
        ({"col": "o_orderdate", "op": "lt", "value": "1996-01-01"}, "LessThan(o_orderdate,1996-01-01T00:00)"),
        ({"col": "o_orderdate", "op": "between", "value": ["1996-01-01", "1996-02-01"]}, "LessThanOrEqual(o_orderdate,1996-02-01T00:00)"),
    ],
)
def test_filters_reach_the_scan(spark, leaf, pushed):
    e = Engine(spark.read.parquet(f"{SF}/orders.parquet"))
    assert pushed in plan(e.matching({"filters": leaf}))


def test_row_ids_of_many_files_follow_their_paths(spark, tmp_path):
    for k in range(3):
        pd.DataFrame({"v": range(k * 10, k * 10 + 10)}).to_parquet(tmp_path / f"part-{k}.parquet")
    got = with_row_id(spark.read.parquet(str(tmp_path))).collect()
    assert sorted((r.v, r[ROW]) for r in got) == [(i, i) for i in range(30)]


def test_row_ids_of_other_tables(spark):
    made = spark.createDataFrame([(i,) for i in range(50)], "v long")
    assert sorted(tuple(r) for r in with_row_id(made).collect()) == [(i, i) for i in range(50)]
    for df in (made.repartition(5), made.groupBy("v").count(), made.limit(20), made.where("v < 0")):
        ids = [r[ROW] for r in with_row_id(df).collect()]
        assert sorted(ids) == list(range(df.count()))
    by = with_row_id(made.select((F.col("v") * 37 % 50).alias("v")), ["v"])
    assert by.where(F.col("v") != F.col(ROW)).count() == 0
    assert with_row_id(by) is by


def test_load(spark, tmp_path):
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    frame.to_parquet(tmp_path / "t.parquet")
    spark.createDataFrame(frame).createOrReplaceTempView("`a``b`")

    class Polars:
        def to_arrow(self):
            return pa.Table.from_pandas(frame)

    loads = [load(spark, frame), load(spark, pa.Table.from_pandas(frame)), load(spark, Polars()), load(spark, str(tmp_path / "t.parquet")), load(spark, table="a`b"), load(spark, sql="SELECT * FROM `a``b`; ")]
    for df in loads:
        assert [r.a for r in df.orderBy("a").collect()] == [1, 2]
    assert load(spark, loads[0]) is loads[0]
    with pytest.raises(ValueError):
        load(spark)


def test_windowed_or_whole(spark):
    df = spark.range(10)
    assert not windowed(df) and windowed(df, True) and windowed(df, least=10) and not windowed(df, least=11)
    assert windowed(spark.range(WINDOWED_FROM)) and not windowed(spark.range(WINDOWED_FROM), False)


def test_columnar(spark):
    rows = [(1, float("nan"), dt.datetime(2024, 1, 2, 3, 4, 5), True, [1.0, float("inf")]), (2, 2.0, None, None, None)]
    df = spark.createDataFrame(rows, "i long, x double, t timestamp_ntz, b boolean, l array<double>")
    Engine(df).df.count()  # the caller's table is as it was
    got = columnar(df)
    assert got == {"i": [1, 2], "x": [None, 2.0], "t": ["2024-01-02T03:04:05Z", None], "b": [True, None], "l": [[1.0, None], None]}
    assert type(columnar(df, whole=True)["x"][1]) is int
    assert columnar(df.select("i"), keys=[7, "a"]) == {ROW: ["7", "a"], "i": [1, 2]}


def test_bridge(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string")
    got = bridge(df, ["k1", "k2"], read_only=("i",))
    assert got["rowKey"] == ROW and got["columnar"] == {ROW: ["k1", "k2"], "i": [1, 2], "s": ["a", "b"]}
    assert [c["edit"] for c in got["columns"]] == [False, True]
    for keys in (["k1"], ["k", "k"]):
        with pytest.raises(ValueError):
            bridge(df, keys)


def test_column_definitions(spark):
    df = spark.createDataFrame([], "i long, s string, t timestamp, b boolean")
    with pytest.warns(UserWarning, match="absent"):
        got = column_definitions(df, overlay={"s": {"title": "S"}, "absent": {}})
    assert [(c["field"], c["type"]) for c in got] == [("i", "number"), ("s", "text"), ("t", "date"), ("b", "boolean")] and got[1]["title"] == "S"
