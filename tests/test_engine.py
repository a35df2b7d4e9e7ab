"""Requests whose answers no registered query shows."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from veduta.operators import facets
from veduta.operators.engine import Engine, LazyView
from veduta.operators.quantiles import quantiles
from veduta.plans.predicates import pruned
from veduta.sources.tables import ROW

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, NAN if i % 7 == 0 else i / 2, f"Text {i}" if i % 5 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3 == 0) for i in range(60)]
    return Engine(spark.createDataFrame(rows, "i long, x double, s string, t timestamp_ntz, b boolean").coalesce(1))


def ids(df):
    return sorted(r[ROW] for r in df.collect())


@pytest.mark.parametrize("op,value,want", [
    ("gt", 10, lambda x: x > 10), ("gte", 10.5, lambda x: x >= 10.5), ("lt", 3, lambda x: x < 3), ("lte", 3, lambda x: x <= 3), ("eq", 4, lambda x: x == 4), ("in", [4, 4.5, None], lambda x: x in (4, 4.5) or x != x), ("between", [2, 5], lambda x: 2 <= x <= 5), ("notBetween", [2, 5], lambda x: not 2 <= x <= 5),
])
def test_numbers_with_nan(small, op, value, want):
    got = ids(small.matching({"filters": {"col": "x", "op": op, "value": value}}))
    assert got == [i for i in range(60) if want(NAN if i % 7 == 0 else i / 2)]


def test_whole_numbers_and_times_against_odd_values(small):
    leaf = lambda c, op, v: ids(small.matching({"filters": {"col": c, "op": op, "value": v}}))
    assert leaf("i", "gt", 57.5) == [58, 59] and leaf("i", "lte", 1.5) == [0, 1] and leaf("i", "eq", 1.5) == [] and len(leaf("i", "ne", 1.5)) == 60
    assert leaf("i", "gt", 1e300) == [] and len(leaf("i", "lt", 2.0**60)) == 60 and leaf("i", "in", [1.5, 2]) == [2]
    assert leaf("t", "eq", "2024-01-01T05:00:00Z") == [5] and leaf("t", "eq", "2024-01-01T07:00:00+02:00") == [5]
    assert leaf("t", "lt", "2024-01-01T01:00:00.000001") == [0, 1] and leaf("t", "gt", 1704067200000 + 58 * 3_600_000 + 0.0005) == [59]
    assert leaf("b", "eq", True) == list(range(0, 60, 3)) and leaf("t", "eq", "no date") == []


def test_dates(spark):
    e = Engine(spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 11)], "d date"))
    leaf = lambda op, v: e.matching({"filters": {"col": "d", "op": op, "value": v}}).count()
    assert (leaf("gt", "2024-01-03"), leaf("gte", "2024-01-03"), leaf("gt", "2024-01-03T12:00"), leaf("lte", "2024-01-03T12:00"), leaf("eq", "2024-01-03"), leaf("eq", "2024-01-03T12:00")) == (7, 8, 7, 3, 1, 0)


@pytest.mark.parametrize("pattern,n", [("(?P<x>Text 1)\\d", 8), ("(?<x>text 1)\\d", 8), ("(", 0), ("(?P=x)", 0), ("*", 0), ("1$", 6)])
def test_patterns(small, pattern, n):
    assert small.count({"filters": {"col": "s", "op": "matches", "value": pattern}}) == n


def test_counts_are_remembered_and_forgotten(small):
    q = {"filters": {"col": "i", "op": "gt", "value": 3}, "quick": "text", "sort": [{"col": "i"}]}
    assert small.count(q) == small.execute(q)["total"] == len(small.view(q))
    assert len([k for k in small._counts if '"quick"' not in k]) >= 1
    version = small.version
    small.invalidate()
    assert not small._counts and small.version == version + 1 and "df" not in small.__dict__
    assert small.count(q) > 0


def test_persisted_rows_are_let_go(spark):
    e = Engine(spark.range(50).repartition(3).groupBy("id").count())
    assert e.positions().count() == 50 and e.df.held.is_cached
    held = e.df.held
    e.invalidate()
    assert not held.is_cached and e.positions().count() == 50


def test_unknown_names(small):
    with pytest.raises(KeyError):
        small.matching({"filters": {"col": "no", "op": "eq", "value": 1}})
    with pytest.raises(ValueError):
        small.matching({"filters": {"col": "i", "op": "no", "value": 1}})


def test_pages_are_the_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "B", "b", None])) for i in range(2000)]
    e = Engine(spark.createDataFrame(rows, "i long, n int, s string").repartition(3))
    q = {"sort": [{"col": "n", "dir": "desc"}, {"col": "s"}], "filters": {"col": "i", "op": "gte", "value": 100}}
    want = [r.i for r in e.ordered(q).collect()]
    pages = e.pages(q)
    assert len(pages) == 1900
    for start, end in ((0, 10), (700, 900), (1890, 2500), (5000, 5100), (0, 1900)):
        got = pages.window(start, end).collect()
        assert [r.i for r in got] == want[start:end] and [r.ord for r in got] == list(range(start, min(end, 1900)))
    pages.close()


@pytest.mark.parametrize("fetched", [1, 50, 10**6])
def test_quantiles_are_exact(spark, fetched, monkeypatch):
    from veduta.operators import quantiles as module

    monkeypatch.setattr(module.ranked, "__defaults__", (fetched,))
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=3001), np.repeat([1.0, 5.0], [900, 100]), rng.integers(0, 5, 500).astype(float), np.array([3.0]), np.exp(rng.normal(size=2000) * 20)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        levels = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
        assert quantiles(df, F.col("x"), levels) == pytest.approx(np.quantile(values, levels).tolist(), rel=1e-12)
    assert quantiles(df.limit(0), F.col("x"), [0.5]) == [None]


def test_facets_of_constants_and_small_columns(spark):
    e = Engine(spark.createDataFrame([(5.0, "a")] * 4, "x double, s string"))
    f = e.facet("x")
    assert [b["n"] for b in f["buckets"]] == [0] * 19 + [4] and f["buckets"][-1]["hi"] == 5.0 and f["unfiltered"] == [0] * 19 + [4]
    assert facets.quantiles([1, 1, 1, 2], 9, 4) == [1, 2, 9] and facets.equal(0, 10, 2) == [0, 5, 10]
    assert facets.logarithmic(-1, 1, 2) == facets.equal(-1, 1, 2)
    assert e.profile("x")["histogram"] == [{"lo": 5.0, "hi": 5.0, "n": 4}]
    assert Engine(spark.createDataFrame([(None,)] * 2, "x double")).facet("x")["buckets"] == [{"label": "Empty", "empty": True, "n": 2}]


def test_quantile_facet_loses_no_row(spark):
    e = Engine(spark.range(30_011).select(((F.col("id") * 7919) % 30_011).cast("double").alias("x")))
    for n in (4, 20):
        f = e.facet("x", strategy="quantile", buckets=n)
        assert sum(b["n"] for b in f["buckets"]) == 30_011 and f["buckets"][-1]["hi"] == 30_010


@pytest.mark.parametrize("days,want", [(1, "hour"), (2, "day"), (100, "week"), (1000, "month"), (3000, "quarter"), (3641, "year")])
def test_granularity(days, want):
    lo = dt.datetime(2000, 1, 1)
    assert facets.granularity(lo, lo + dt.timedelta(days=days)) == want


def test_profiles(spark):
    rows = [(str(i) if i % 20 else "x", dt.datetime(2024, 1, 1 + i % 3), i % 2 == 0, float(i)) for i in range(400)]
    e = Engine(spark.createDataFrame(rows, "s string, t timestamp_ntz, b boolean, x double").coalesce(1))
    p = e.profile("s")
    assert p["numeric"] == 380 and "topValues" not in p and sum(b["n"] for b in p["histogram"]) == 380
    assert "topValues" in e.profile("s", {"filters": {"col": "s", "op": "eq", "value": "x"}})
    p = e.profile("t")
    assert (p["numeric"], p["min"], p["histogram"], p["outliers"]) == (0, None, [], 0) and len(p["topValues"]) == 3
    p = e.profile("b")
    assert p["mean"] == 0.5 and len(p["topValues"]) == 2
    p = e.profile("x")
    assert p["median"] == statistics.median(range(400)) and p["histogram"][0]["lo"] == 0 and p["histogram"][-1]["hi"] == 399


def test_views_and_state(small, spark):
    state = {"filters": {"op": "and", "conditions": [{"col": "i", "op": "lt", "value": 10}, {"col": "gone", "op": "eq", "value": 1}]}, "sort": [{"col": "i", "dir": "desc"}, {"col": "gone"}], "columns": ["i", "gone"]}
    v = small.view(state)
    assert isinstance(v, LazyView) and v.shape == (10, 5) and v.state["columns"] == ["i"]
    assert [r.i for r in v.head(3).collect()] == [9, 8, 7] and [r.i for r in v.slice(8, 20).collect()] == [1, 0]
    assert v.to_pandas()["i"].tolist() == list(range(9, -1, -1)) and [r[ROW] for r in v.positions().collect()] == list(range(9, -1, -1))
    other = v.over(small.replace(spark.createDataFrame([("a",)], "s string")))
    assert other.state["sort"] == [] and len(other) == 1
    assert pruned({"op": "not", "conditions": [{"col": "gone", "op": "blank"}]}, ["i"]) is None


def test_edits(spark):
    df = spark.createDataFrame([(1, 1.5, "a", False, dt.datetime(2020, 1, 1))] * 2, "i int, x double, s string, b boolean, t timestamp_ntz").coalesce(1)
    e = Engine(df)
    one = lambda **patch: e.edit(1, patch).df.where(F.col(ROW) == 1).drop(ROW).first()
    assert one(i="7", x="2e3", s=5, b=" Yes ", t="2024-02-03T04:05:06+02:00") == (7, 2000.0, "5", True, dt.datetime(2024, 2, 3, 2, 5, 6))
    assert one(i="x", x="x", t="x") == (1, 1.5, "a", False, dt.datetime(2020, 1, 1))
    assert one(i="2.7").i == 1 and one(i=2.7).i == 2 and one(b="no").b is False and one(b=3).b is True and one(t=86_400_000).t == dt.datetime(1970, 1, 2)
    assert tuple(one(i=None, s=None, t=None)) == (None, 1.5, None, False, None)
    assert e.edit(1, {"s": "z"}).df.where("s = 'a'").count() == 1
    assert e.mutate({"kind": "update", "key": 0, "patch": {"s": "q"}})["engine"].df.where("s = 'q'").count() == 1
    assert e.mutate({"kind": "drop"})["ok"] is False and e.mutate({"kind": "update", "key": "x"})["ok"] is False
    assert Engine(df, editable=False).mutate({"kind": "update", "key": 0, "patch": {}}) == {"ok": False, "reason": "the source is read-only"}


def test_only_a_page_of_groups_is_totalled(spark):
    e = Engine(spark.range(1000).select((F.col("id") % 100).alias("g"), F.col("id").cast("double").alias("x")))
    got = e.group_level({"groupBy": ["g"], "range": {"start": 10, "end": 13}}, [{"id": "m", "col": "x", "fn": "median"}]).orderBy("ord").collect()
    assert [(r.key, r.leafCount, r.m, r.ord) for r in got] == [(10, 10, 460.0, 10), (11, 10, 461.0, 11), (12, 10, 462.0, 12)]
    got = e.group_level({"groupBy": ["g"], "sort": [{"col": "m", "dir": "desc"}], "range": {"start": 0, "end": 1}}, [{"id": "m", "col": "x", "fn": "median"}]).collect()
    assert [(r.key, r.m) for r in got] == [(99, 549.0)] and INF > 0
