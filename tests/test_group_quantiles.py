"""Quantiles of groups that are too large for one buffer."""

import datetime as dt
import random
import shutil
import statistics

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from veduta.operators import engine, quantiles
from veduta.operators.engine import Engine
from veduta.plans import catalogue

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
NAN, INF = float("nan"), float("inf")
MEDIAN = [{"id": "n", "col": "x", "fn": "count"}, {"id": "m", "col": "x", "fn": "median"}, {"id": "r", "col": "y", "fn": "iqr"}, {"id": "p", "col": "x", "fn": "p99"}]


def at(values, p):
    s = sorted(values)
    if not s:
        return None
    h = (len(s) - 1) * p
    lo, hi = s[int(h)], s[-int(-h // 1)]
    return lo if lo == hi else (-int(-h // 1) - h) * lo + (h - int(h)) * hi


def want(rows, ids):
    """Rows a, b, x, y by every prefix of ``a, b``."""
    groups = {}
    for r in rows:
        for k in ids:
            groups.setdefault((k, *r[:k]), []).append(r)
    out = {}
    for key, own in groups.items():
        xs, ys = [r[2] for r in own if r[2] is not None and r[2] == r[2]], [r[3] for r in own if r[3] is not None]
        out[key] = (len(own), at(xs, 0.5), at(ys, 0.75) - at(ys, 0.25) if ys else None, at(xs, 0.99))
    return out


@pytest.fixture(scope="module")
def odd():
    pick, rows = random.Random(5), []
    odd = [None, NAN, INF, -INF, 0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53]
    for i in range(4000):
        a = pick.choice(["A", "A", "A", "B", None, "tiny" if i % 50 == 0 else "A"])
        x = [pick.choice(odd), pick.gauss(0, 1e5), 1.7e12 + pick.randrange(50), 1 + pick.randrange(9) * 2**-52][(0 if a is None else i) % 4]
        rows.append((a, None if i % 11 == 0 else dt.datetime(2024, 1, 1 + i % 3, 0, 0, 0, i % 2), x, None if a == "B" else i % 7))
    return rows + [(f"s{i}", None, float(i), i) for i in range(30)]


@pytest.mark.parametrize("held,most", [(40, 1000), (40, 3), (700, 3), (3999, 3)])
def test_rollup_of_large_groups(spark, odd, monkeypatch, held, most):
    monkeypatch.setattr(engine, "of_groups", lambda *a: quantiles.of_groups(*a, held=held, most=most))
    df = spark.createDataFrame(odd, "a string, b timestamp_ntz, x double, y int").repartition(5)
    got = Engine(df).rollup(None, ["a", "b"], MEDIAN).collect()
    assert got[0].__fields__ == ["k0", "k1", "g0", "g1", "level", "n", "m", "r", "p"]
    mine = {(r.level, *(r.k0, r.k1)[: r.level]): (r.n, r.m, r.r, r.p) for r in got}
    plain = want(odd, [0, 1, 2])
    assert len(got) == len(mine) == len(plain)
    for k, v in plain.items():
        assert repr([None if e is None else e + 0.0 for e in v]) == repr([None if e is None else e + 0.0 for e in mine[k]]), k


@pytest.mark.parametrize("most", [1000, 3])
def test_levels_charts_and_totals_of_large_groups(spark, odd, monkeypatch, most):
    monkeypatch.setattr(engine, "of_groups", lambda *a: quantiles.of_groups(*a, held=40, most=most))
    e = Engine(spark.createDataFrame(odd, "a string, b timestamp_ntz, x double, y int").coalesce(1))
    plain = {k[1]: v for k, v in want(odd, [1]).items()}
    for q in ({"groupBy": ["a"]}, {"groupBy": ["a"], "sort": [{"col": "m", "dir": "desc"}]}):
        got = e.group_level(q, MEDIAN[:3]).collect()
        assert {r.key: (r.n, r.m, r.r) for r in got} == {k: v[:3] for k, v in plain.items()}
    assert {r.x: r.y for r in e.chart("a", "x", fn="median").collect()} == {k: v[1] for k, v in plain.items()}
    [total] = e.group_totals({"groupBy": ["a"]}, MEDIAN[:2]).collect()
    assert (total.n, total.m) == want(odd, [0])[0,][:2]


def test_no_buffer_of_a_large_group(spark):
    df = spark.range(300_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 300_007 / 4).alias("x"))
    ask = [{"id": "m", "col": "x", "fn": "median"}]
    e, values = Engine(df), [[i * 7919 % 300_007 / 4 for i in range(k, 300_000, 2)] for k in (0, 1)]
    got = e.rollup(None, ["k"], ask)
    assert {r.k0: r.m for r in got.collect()} == {None: statistics.median(values[0] + values[1]), 0: statistics.median(values[0]), 1: statistics.median(values[1])}
    one = Engine(df.withColumn("k", F.lit(1)))
    # What a rollup makes of no rows may still be a percentile.
    for made, most in ((got, 1), (e.group_totals({"groupBy": ["k"]}, ask), 0), (one.chart("k", "x", fn="median"), 0), (one.group_level({"groupBy": ["k"]}, ask), 0)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("percentile(") <= most


@pytest.mark.parametrize("name", ["rollup_1", "rollup_2", "rollup_3_date"])
def test_registered_rollups_without_group_buffers(spark, monkeypatch, name):
    seen = []

    def searched(*a):
        seen.append(quantiles.of_groups(*a, held=1_000))
        return seen[-1]

    monkeypatch.setattr(engine, "of_groups", searched)
    got, same = compare(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLES[name])
    assert got == same and len(seen) == 1 and seen[0] is not None


def most_read(spark, run):
    """What ``run`` gives, and the most shuffle bytes one of its tasks read."""
    sc = spark.sparkContext._jsc.sc()
    store = sc.statusStore()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        every = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return {(s.stageId(), s.attemptId()): s for s in map(every.apply, range(every.size()))}

    old, got, most = stages(), run(), 0
    new = [(k, s.numTasks()) for k, s in stages().items() if k not in old and s.shuffleReadBytes()]
    for k, n in new:
        tasks = store.taskList(*k, n)
        reads = [t.taskMetrics().get().shuffleReadMetrics() for t in map(tasks.apply, range(tasks.size())) if t.taskMetrics().isDefined()]
        most = max([most, *(r.localBytesRead() + r.remoteBytesRead() for r in reads)])
    assert new
    return got, most


@pytest.mark.parametrize("name", ["rollup_2", "rollup_3_date"])
def test_no_task_reads_the_values_of_a_large_group(spark, tmp_path, name):
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(4):
        shutil.copy(f"{LARGE}/lineitem.parquet", tmp_path / "lineitem.parquet" / f"{i}.parquet")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    (got, same), most = most_read(spark, lambda: compare(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.ORACLES[name]))
    # Of buffers that hold the values a task reads 21 MB or more, 5 from each file.
    assert got == same and most < 4e6
