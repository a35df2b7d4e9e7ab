"""The registered queries of the engine and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.operators.coerce import coerced
from veduta.operators.engine import Engine
from veduta.operators.router import Router
from veduta.sources.tables import ROW
from veduta.streaming.diff import keyed_diff

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def register(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def dec(c, n: int = 4):
    return F.round(c, n)


# The tables hold no NULL, so some filters run over a column with NULLs made the same way on both sides.
ORDERS = "(SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS note, row_number() OVER () - 1 AS rid FROM orders)"


def orders(spark: SparkSession, d: str) -> Engine:
    df = read(spark, d, "orders").withColumn(ROW, F.col("_metadata.row_index"))
    k = F.col("o_orderkey")
    price = F.when(k % 11 != 0, F.col("o_totalprice"))
    note = F.when(k % 7 == 0, None).when(k % 7 == 1, "").when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return Engine(df.withColumns({"price": price, "note": note}))


def _filters():
    def one(name, where, **leaf):
        @register(name, f"SELECT o_orderkey FROM {ORDERS} WHERE {where}")
        def run(spark, d):
            return orders(spark, d).matching({"filters": leaf}).select("o_orderkey")

    f = lambda c, op, value=None, **more: {"col": c, "op": op, "value": value, **more}
    one("filter_eq_text_ci", "lower(note) = '2-high'", **f("note", "eq", "2-HIGH"))
    one("filter_eq_case", "note = '2-HIGH'", **f("note", "eq", "2-HIGH", caseSensitive=True))
    one("filter_eq_null", "price IS NULL", **f("price", "eq", None))
    one("filter_ne_null", "coalesce(lower(note) <> '2-high', true)", **f("note", "ne", "2-high"))
    one("filter_ne_number", "coalesce(o_custkey <> 7, true)", **f("o_custkey", "ne", "7"))
    one("filter_gt", "price > 100000", **f("price", "gt", 100000))
    one("filter_gte", "o_custkey >= 1000", **f("o_custkey", "gte", " 1000 "))
    one("filter_lt", "price < 50000", **f("price", "lt", 50000))
    one("filter_lte", "o_custkey <= 10", **f("o_custkey", "lte", 10))
    one("filter_lt_text", "lower(note) < '3'", **f("note", "lt", "3"))
    one("filter_gte_text", "lower(note) >= '4-NOT'", **f("note", "gte", "4-NOT") | {"value": "4-NOT"})
    ORACLES["filter_gte_text"] = ORACLES["filter_gte_text"].replace("'4-NOT'", "lower('4-NOT')")
    one("filter_between", "price BETWEEN 1000 AND 90000", **f("price", "between", [1000, 90000]))
    one("filter_between_open", "o_custkey > 10 AND o_custkey < 20", **f("o_custkey", "between", [10, 20], bounds="()"))
    one("filter_between_half", "o_custkey >= 10 AND o_custkey < 20", **f("o_custkey", "between", [10, 20], bounds="[)"))
    one("filter_not_between", "NOT coalesce(price BETWEEN 1000 AND 290000, false)", **f("price", "notBetween", [1000, 290000]))
    one("filter_in", "lower(note) IN ('1-urgent', '5-low')", **f("note", "in", ["1-URGENT", "5-low"]))
    one("filter_in_null", "price IS NULL OR o_totalprice = -1", **f("price", "in", [None, "x", -1]))
    one("filter_not_in", "NOT coalesce(lower(note) IN ('1-urgent', '5-low'), false)", **f("note", "notIn", ["1-urgent", "5-LOW"]))
    one("filter_not_in_null", "note IS NOT NULL AND lower(note) <> '5-low'", **f("note", "notIn", ["5-low", None]))
    one("filter_not_in_empty", "true", **f("note", "notIn", []))
    one("filter_contains", "contains(lower(note), 'high')", **f("note", "contains", "HIGH"))
    one("filter_contains_null", "note IS NOT NULL", **f("note", "contains", None))
    one("filter_not_contains", "NOT coalesce(contains(lower(note), 'high'), false)", **f("note", "notContains", "high"))
    one("filter_starts", "starts_with(lower(note), '1-')", **f("note", "startsWith", "1-"))
    one("filter_ends", "ends_with(lower(note), 'ent')", **f("note", "endsWith", "ENT"))
    one("filter_ends_case", "ends_with(note, 'ENT')", **f("note", "endsWith", "ENT", caseSensitive=True))
    one("filter_matches", "regexp_matches(note, '(?i)^[1-3].*h')", **f("note", "matches", "^[1-3].*h"))
    one("filter_matches_bad", "false", **f("note", "matches", "("))
    one("filter_blank", "note IS NULL OR note = ''", **f("note", "blank"))
    one("filter_not_blank", "note IS NOT NULL AND note <> ''", **f("note", "notBlank"))
    one("filter_date_gt", "o_orderdate > TIMESTAMP '1996-01-01'", **f("o_orderdate", "gt", "1996-01-01"))
    one("filter_date_epoch_ms", "o_orderdate < TIMESTAMP '1995-01-01'", **f("o_orderdate", "lt", 788918400000))
    one("filter_bad_operand", "false", **f("o_custkey", "eq", "abc"))
    one("filter_bad_operand_ne", "true", **f("o_custkey", "ne", "abc"))
    one("filter_number_contains", "contains(CAST(o_custkey AS VARCHAR), '12')", **f("o_custkey", "contains", "12"))
    hi, lo = f("price", "gt", 200000), f("note", "contains", "low")
    one("tree_and", "price > 200000 AND contains(lower(note), 'low')", op="and", conditions=[hi, lo])
    one("tree_or", "price > 200000 OR contains(lower(note), 'low')", op="or", conditions=[hi, lo])
    one("tree_not", "NOT coalesce(price > 200000 AND contains(lower(note), 'low'), false)", op="not", conditions=[hi, lo])
    one("tree_not_empty", "true", op="not", conditions=[])
    one("tree_nested", "(price > 200000 OR contains(lower(note), 'low')) AND NOT coalesce(o_custkey < 100, false)", op="and", conditions=[{"op": "or", "conditions": [hi, lo, None]}, {"op": "not", "conditions": [f("o_custkey", "lt", 100)]}])


_filters()


@register("quick_text", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'an') OR contains(CAST(n_nationkey AS VARCHAR), 'an') OR contains(CAST(n_regionkey AS VARCHAR), 'an')")
def quick_text(spark, d):
    return Engine(read(spark, d, "nation")).matching({"quick": " AN "}).select("n_nationkey")


@register("quick_number", "SELECT p_partkey FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '42') OR contains(lower(p_name), '42') OR contains(lower(p_brand), '42') OR contains(lower(p_type), '42') OR contains(CAST(p_size AS VARCHAR), '42') OR contains(regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', ''), '42')")
def quick_number(spark, d):
    return Engine(read(spark, d, "part")).matching({"quick": "42"}).select("p_partkey")


@register("quick_lines", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE contains(CAST(l_orderkey AS VARCHAR), '421') OR contains(CAST(l_partkey AS VARCHAR), '421') OR contains(CAST(l_suppkey AS VARCHAR), '421') OR contains(regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', ''), '421')")
def quick_lines(spark, d):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"]
    return Engine(read(spark, d, "lineitem").select(columns)).matching({"quick": "421"}).select("l_orderkey", "l_linenumber")


@register("distinct_lines", "SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def distinct_lines(spark, d):
    return lines(spark, d).distinct_values("l_partkey", {"filters": {"col": "l_quantity", "op": "gt", "value": 10}})


@register("quick_timestamp", "SELECT event_id FROM events WHERE contains(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '2024-01-15t1') OR contains(lower(strftime(ts, '%Y-%m-%dT%H:%M:%S')), '2024-01-15t1')")
def quick_timestamp(spark, d):
    return Engine(read(spark, d, "events").select("event_id", "ts")).matching({"quick": "2024-01-15T1"}).select("event_id")


LINES = "(SELECT *, row_number() OVER () - 1 AS rid FROM lineitem)"


def lines(spark, d) -> Engine:
    return Engine(read(spark, d, "lineitem"))


def _windows():
    def one(name, table, sql_order, where, start, end, columns, q):
        own = f"(SELECT *, row_number() OVER () - 1 AS rid FROM {table})"

        @register(name, f"SELECT {columns}, rid AS row_id, ord FROM (SELECT *, row_number() OVER (ORDER BY {sql_order}) - 1 AS ord FROM {own} WHERE {where}) WHERE ord >= {start} AND ord < {end}")
        def run(spark, d):
            got = Engine(read(spark, d, table)).numbered({**q, "range": {"start": start, "end": end}})
            return got.select(*columns.split(", "), F.col(ROW).alias("row_id"), "ord")

    one("window_unsorted", "lineitem", "rid", "l_quantity > 40", 100, 200, "l_orderkey, l_linenumber", {"filters": {"col": "l_quantity", "op": "gt", "value": 40}})
    both = {"op": "and", "conditions": [{"col": "l_quantity", "op": "gt", "value": 40}, {"col": "l_returnflag", "op": "eq", "value": "r"}]}
    one("window_sorted", "lineitem", "l_extendedprice DESC, rid", "l_quantity > 40 AND lower(l_returnflag) = 'r'", 0, 100, "l_orderkey, l_extendedprice", {"filters": both, "sort": [{"col": "l_extendedprice", "dir": "desc"}]})
    one("window_deep", "lineitem", "l_shipdate, rid", "true", 3000, 3100, "l_orderkey, l_shipdate", {"sort": [{"col": "l_shipdate", "dir": "asc"}]})
    one("sort_multi", "lineitem", "l_quantity DESC, lower(l_shipmode_) , rid".replace("lower(l_shipmode_)", "lower(l_returnflag), l_returnflag DESC"), "true", 50, 150, "l_orderkey, l_quantity, l_returnflag", {"sort": [{"col": "l_quantity", "dir": "desc"}, {"col": "l_returnflag"}]})
    one("sort_text_collation", "part", "lower(p_name), p_name DESC, rid", "true", 0, 200, "p_partkey, p_name", {"sort": [{"col": "p_name"}]})
    one("sort_text_lines", "lineitem", "lower(l_returnflag), l_returnflag DESC, l_extendedprice, rid", "true", 400, 500, "l_orderkey, l_returnflag", {"sort": [{"col": "l_returnflag"}, {"col": "l_extendedprice"}]})
    one("view_slice", "documents", "lower(lang) DESC, lang, rid", "true", 10, 60, "doc_id, lang", {"sort": [{"col": "lang", "dir": "desc"}]})


_windows()


@register("sort_nulls_first", f"SELECT o_orderkey, price, ord FROM (SELECT *, row_number() OVER (ORDER BY price DESC NULLS FIRST, rid) - 1 AS ord FROM {ORDERS}) WHERE ord < 2000")
def sort_nulls_first(spark, d):
    return orders(spark, d).numbered({"sort": [{"col": "price", "dir": "desc", "nullsFirst": True}], "range": {"start": 0, "end": 2000}}).select("o_orderkey", "price", "ord")


@register("sort_nulls_last", f"SELECT o_orderkey, note, ord FROM (SELECT *, row_number() OVER (ORDER BY lower(note) DESC NULLS LAST, note ASC NULLS LAST, rid) - 1 AS ord FROM {ORDERS}) WHERE ord < 700")
def sort_nulls_last(spark, d):
    return orders(spark, d).numbered({"sort": [{"col": "note", "dir": "desc"}], "range": {"start": 0, "end": 700}}).select("o_orderkey", "note", "ord")


@register("count_matching", "SELECT count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
def count_matching(spark, d):
    return lines(spark, d).matching({"filters": {"col": "l_discount", "op": "between", "value": [0.05, 0.07]}}).agg(F.count("*").alias("n"))


@register("positions", f"SELECT rid AS row_id FROM {LINES} WHERE l_quantity = 50")
def positions(spark, d):
    return lines(spark, d).positions({"filters": {"col": "l_quantity", "op": "eq", "value": 50}}).select(F.col(ROW).alias("row_id"))


@register("rows_at", f"SELECT l_orderkey, l_extendedprice, CASE rid WHEN 17 THEN 0 WHEN 3 THEN 1 WHEN 512 THEN 2 END AS ord FROM {LINES} WHERE rid IN (17, 3, 512)")
def rows_at(spark, d):
    return lines(spark, d).rows_at([17, 3, 512, 10**12]).select("l_orderkey", "l_extendedprice", F.col("__ord").alias("ord"))


@register("selected_rows", f"SELECT l_orderkey, rid AS row_id FROM {LINES} WHERE rid IN (5, 2)")
def selected_rows(spark, d):
    return lines(spark, d).selected([5, 2, 10**12]).select("l_orderkey", F.col(ROW).alias("row_id"))


# aggregates
_SQL = {
    "count": "count(*)", "countValues": "count({c})", "distinct": "count(DISTINCT {c})", "sum": "round(sum({c}), 2)", "sumSquares": "round(sum({c} * {c}), 0)", "avg": "round(avg({c}), 4)",
    "min": "min({c})", "max": "max({c})", "range": "round(max({c}) - min({c}), 4)", "median": "round(quantile_cont({c}, 0.5), 4)", "p25": "round(quantile_cont({c}, 0.25), 4)",
    "p75": "round(quantile_cont({c}, 0.75), 4)", "p90": "round(quantile_cont({c}, 0.9), 4)", "p95": "round(quantile_cont({c}, 0.95), 4)", "p99": "round(quantile_cont({c}, 0.99), 4)",
    "iqr": "round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4)", "variance": "round(var_samp({c}), 2)", "stddev": "round(stddev_samp({c}), 4)", "varianceP": "round(var_pop({c}), 2)", "stddevP": "round(stddev_pop({c}), 4)",
}
_ROUND = {"sum": 2, "sumSquares": 0, "variance": 2, "varianceP": 2, "min": None, "max": None, "count": None, "countValues": None, "distinct": None}


def _rounded(df: DataFrame, aggs: list[dict]) -> DataFrame:
    return df.withColumns({a["id"]: F.round(a["id"], n) for a in aggs if (n := _ROUND.get(a["fn"], 4)) is not None})


def _aggregates():
    def one(name, c, fns, where="true", q=None, table="lineitem", sql=None):
        aggs = [{"id": f, "col": c, "fn": f} for f in fns]
        ask = ", ".join(f"{(sql or {}).get(f) or _SQL[f].format(c=c)} AS {f}" for f in fns)

        @register(name, f"SELECT {ask} FROM {table} WHERE {where}")
        def run(spark, d):
            return _rounded(Engine(read(spark, d, table)).aggregates(q, aggs), aggs)

    one("agg_basic", "l_extendedprice", ["count", "countValues", "sum", "avg", "min", "max", "range", "sumSquares"])
    one("agg_filtered", "l_quantity", ["count", "sum", "avg"], "l_discount > 0.05", {"filters": {"col": "l_discount", "op": "gt", "value": 0.05}})
    one("agg_distinct", "l_partkey", ["distinct"])
    one("agg_distinct_text", "p_type", ["distinct", "countValues"], table="part")
    one("agg_quantiles", "l_extendedprice", ["median", "p25", "p75", "p90", "p95", "p99"])
    one("agg_iqr", "l_extendedprice", ["iqr"])
    one("agg_variance", "l_quantity", ["variance", "stddev", "varianceP", "stddevP"])
    one("agg_datetime_ms", "ts", ["min", "max"], table="events", sql={"min": "epoch_us(min(ts)) / 1000.0", "max": "epoch_us(max(ts)) / 1000.0"})
    one("agg_text", "p_name", ["count", "sum", "avg", "min"], table="part", sql={"sum": "CAST(NULL AS DOUBLE)", "avg": "CAST(NULL AS DOUBLE)", "min": "CAST(NULL AS DOUBLE)"})
    one("agg_empty_set", "l_quantity", ["count", "sum", "avg", "median", "distinct", "stddev"], "false", {"filters": {"col": "l_quantity", "op": "lt", "value": -1}}, sql={"sum": "0.0"})


_aggregates()
_AGG = [{"id": "n", "col": "l_quantity", "fn": "count"}, {"id": "total", "col": "l_quantity", "fn": "sum"}, {"id": "mid", "col": "l_extendedprice", "fn": "median"}]
_AGGS = "count(*) AS n, round(sum(l_quantity), 2) AS total, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid"


def _rollups():
    def one(name, keys, where="true", q=None):
        ks = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
        gs = ", ".join(f"grouping({k}) AS g{i}" for i, k in enumerate(keys))
        level = f"{len(keys)} - " + " - ".join(f"grouping({k})" for k in keys)

        @register(name, f"SELECT {ks}, {gs}, {level} AS level, {_AGGS} FROM lineitem WHERE {where} GROUP BY ROLLUP ({', '.join(keys)})")
        def run(spark, d):
            return lines(spark, d).rollup(q, keys, _AGG).withColumns({"total": F.round("total", 2), "mid": F.round("mid", 4)})

    one("rollup_1", ["l_returnflag"])
    one("rollup_2", ["l_returnflag", "l_linestatus"])
    one("rollup_3_date", ["l_returnflag", "l_linestatus", "l_linenumber"])
    one("rollup_filtered", ["l_returnflag", "l_linestatus"], "l_quantity > 45", {"filters": {"col": "l_quantity", "op": "gt", "value": 45}})


_rollups()


@register("rollup_empty", "SELECT CAST(NULL AS VARCHAR) AS k0, 1 AS g0, 0 AS level, 0 AS n, 0.0 AS total")
def rollup_empty(spark, d):
    return lines(spark, d).rollup({"filters": {"col": "l_quantity", "op": "lt", "value": -1}}, ["l_returnflag"], _AGG[:2])


@register("distinct_values", "SELECT p_brand AS value, count(*) AS n FROM part WHERE contains(lower(p_brand), '1') GROUP BY 1")
def distinct_values(spark, d):
    return Engine(read(spark, d, "part")).distinct_values("p_brand", {"filters": {"col": "p_brand", "op": "contains", "value": "1"}})


def _levels():
    base = {"groupBy": ["l_returnflag", "l_linestatus"]}

    def one(name, key, order, where, q, table="lineitem", limit=100):
        own = f"(SELECT *, row_number() OVER () - 1 AS rid FROM {table})"
        lo = (q.get("range") or {}).get("start", 0)

        @register(name, f"SELECT * FROM (SELECT key, leafCount, n, total, row_number() OVER (ORDER BY {order}) - 1 AS ord FROM (SELECT {key} AS key, count(*) AS leafCount, count(*) AS n, round(sum(l_quantity), 2) AS total, min(rid) AS first FROM {own} WHERE {where} GROUP BY 1)) WHERE ord >= {lo} AND ord < {lo + limit}")
        def run(spark, d):
            return lines(spark, d).group_level(q, _AGG[:2]).withColumn("total", F.round("total", 2))

    one("group_top", "l_returnflag", "lower(key), key DESC, first", "true", base)
    one("group_top_by_agg", "l_returnflag", "total DESC, first", "true", {**base, "sort": [{"col": "total", "dir": "desc"}]})
    one("group_inner", "l_linestatus", "lower(key), key DESC, first", "l_returnflag = 'R'", {**base, "groupValues": ["R"]})
    one("group_top_window", "l_partkey", "total DESC, first", "true", {"groupBy": ["l_partkey"], "sort": [{"col": "total", "dir": "desc"}], "range": {"start": 20, "end": 60}}, limit=40)
    one("group_key_desc", "l_suppkey", "key DESC, first", "true", {"groupBy": ["l_suppkey"], "sort": [{"col": "l_suppkey", "dir": "desc"}], "range": {"start": 0, "end": 30}}, limit=30)
    one("group_unknown_value", "l_linestatus", "first", "false", {**base, "groupValues": ["no such"]})


_levels()


@register("group_leaves", f"SELECT l_orderkey, l_extendedprice FROM {LINES} WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_extendedprice DESC, rid LIMIT 50")
def group_leaves(spark, d):
    q = {"groupBy": ["l_returnflag", "l_linestatus"], "groupValues": ["R", "F"], "sort": [{"col": "l_extendedprice", "dir": "desc"}], "range": {"start": 0, "end": 50}}
    return lines(spark, d).group_level(q, []).select("l_orderkey", "l_extendedprice")


@register("group_null_key", f"SELECT key, leafCount, row_number() OVER (ORDER BY lower(key) NULLS LAST, key DESC NULLS LAST) - 1 AS ord FROM (SELECT note AS key, count(*) AS leafCount FROM {ORDERS} GROUP BY 1)")
def group_null_key(spark, d):
    return orders(spark, d).group_level({"groupBy": ["note"]}, [])


@register("group_null_path", f"SELECT key, leafCount, row_number() OVER (ORDER BY lower(key), key DESC) - 1 AS ord FROM (SELECT o_orderstatus AS key, count(*) AS leafCount FROM {ORDERS} WHERE note IS NULL GROUP BY 1)")
def group_null_path(spark, d):
    return orders(spark, d).group_level({"groupBy": ["note", "o_orderstatus"], "groupValues": [None]}, [])


@register("group_grand", "SELECT count(*) AS matchCount, count(DISTINCT l_returnflag) AS groupCount, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_quantity > 10")
def group_grand(spark, d):
    q = {"groupBy": ["l_returnflag"], "filters": {"col": "l_quantity", "op": "gt", "value": 10}}
    return lines(spark, d).group_totals(q, _AGG[:2]).withColumn("total", F.round("total", 2))


for _name, _args, _sql in (
    ("chart_bar", {"x": "o_orderstatus", "y": "o_totalprice"}, "SELECT o_orderstatus AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1"),
    ("chart_line_series", {"x": "o_orderstatus", "y": "o_totalprice", "series": "o_orderpriority"}, "SELECT o_orderstatus AS x, o_orderpriority AS series, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2"),
    ("chart_measure_avg", {"x": "o_orderpriority", "y": "o_totalprice", "fn": "avg"}, "SELECT o_orderpriority AS x, round(avg(o_totalprice), 2) AS y FROM orders GROUP BY 1"),
):
    register(_name, _sql)(lambda spark, d, a=_args: Engine(read(spark, d, "orders")).chart(**a).withColumn("y", F.round("y", 2)))


# facets: (bucket_ix, label, lo, hi, n)
def _flat(spark, facet: dict) -> DataFrame:
    rows = [(i, b.get("label"), None if b.get("lo") is None else float(b["lo"]), None if b.get("hi") is None else float(b["hi"]), int(b["n"])) for i, b in enumerate(facet["buckets"])]
    return spark.createDataFrame(rows, "bucket_ix int, label string, lo double, hi double, n long").select("bucket_ix", "label", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


def _edges(n: int, edge: str, where: str = "true") -> str:
    """Buckets of l_extendedprice over edges given as SQL of i (0 to n), lo0 and hi0."""
    return f"""WITH b AS (SELECT min(l_extendedprice) AS lo0, max(l_extendedprice) AS hi0 FROM lineitem), i AS (SELECT unnest(range(0, {n})) AS i),
e AS (SELECT i, {edge.format(i="i")} AS lo, CASE WHEN i = {n - 1} THEN hi0 ELSE {edge.format(i="(i + 1)")} END AS hi FROM i, b)
SELECT CAST(i AS INT) AS bucket_ix, CAST(NULL AS VARCHAR) AS label, round(lo, 4) AS lo, round(hi, 4) AS hi, count(l_orderkey) AS n
FROM e LEFT JOIN lineitem ON l_extendedprice >= lo AND (l_extendedprice < hi OR i = {n - 1} AND l_extendedprice <= hi) AND ({where}) GROUP BY i, lo, hi"""


@register("facet_equal", _edges(20, "lo0 + {i} * ((hi0 - lo0) / 20)"))
def facet_equal(spark, d):
    return _flat(spark, lines(spark, d).facet("l_extendedprice"))


@register("facet_cross_filtered", _edges(20, "lo0 + {i} * ((hi0 - lo0) / 20)", "l_quantity > 25"))
def facet_cross_filtered(spark, d):
    return _flat(spark, lines(spark, d).facet("l_extendedprice", {"filters": {"col": "l_quantity", "op": "gt", "value": 25}}))


@register("facet_log", _edges(10, "CASE WHEN {i} = 0 THEN lo0 ELSE pow(10, log10(lo0) + (log10(hi0) - log10(lo0)) * {i} / 10) END"))
def facet_log(spark, d):
    return _flat(spark, lines(spark, d).facet("l_extendedprice", strategy="log", buckets=10))


@register("facet_quantile", f"""WITH c AS (SELECT count(*) AS n, max(l_extendedprice) AS top FROM lineitem), p AS (SELECT DISTINCT CAST(floor(i * greatest(1, n / 10000e0)) AS BIGINT) AS rid FROM c, (SELECT unnest(range(0, 10000)) AS i)),
s AS (SELECT list_sort(list(l_extendedprice)) AS v FROM {LINES} JOIN p USING (rid)),
e AS (SELECT min(i) AS i, lo FROM (SELECT i, v[least(len(v), CAST(floor(i / 10e0 * len(v)) AS BIGINT) + 1)] AS lo FROM s, (SELECT unnest(range(0, 10)) AS i)) GROUP BY lo),
b AS (SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS bucket_ix, lo, lead(lo) OVER (ORDER BY i) AS next FROM e)
SELECT bucket_ix, CAST(NULL AS VARCHAR) AS label, round(lo, 4) AS lo, round(coalesce(next, top), 4) AS hi, count(l_orderkey) AS n
FROM b, c LEFT JOIN lineitem ON l_extendedprice >= lo AND (l_extendedprice < next OR next IS NULL) GROUP BY bucket_ix, lo, next, top""")
def facet_quantile(spark, d):
    return _flat(spark, lines(spark, d).facet("l_extendedprice", strategy="quantile", buckets=10))


@register("facet_bool", "SELECT CAST(i AS INT) AS bucket_ix, label, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, n FROM (SELECT 0 AS i, 'false' AS label, count(*) FILTER (l_quantity <= 25) AS n FROM lineitem UNION ALL SELECT 1, 'true', count(*) FILTER (l_quantity > 25) FROM lineitem)")
def facet_bool(spark, d):
    df = read(spark, d, "lineitem").withColumn(ROW, F.col("_metadata.row_index"))
    return _flat(spark, Engine(df.withColumn("large", F.col("l_quantity") > 25)).facet("large"))


@register("facet_category", f"""WITH t AS (SELECT note, count(*) AS all_n, min(rid) AS first FROM {ORDERS} WHERE note <> '' GROUP BY note),
b AS (SELECT CAST(row_number() OVER (ORDER BY all_n DESC, first) - 1 AS INT) AS bucket_ix, note AS label FROM t),
c AS (SELECT coalesce(note, '') AS note, count(*) AS n FROM {ORDERS} WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT bucket_ix, label, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, coalesce(n, 0) AS n FROM b LEFT JOIN c ON label = note
UNION ALL SELECT (SELECT CAST(count(*) AS INT) FROM b), 'Empty', NULL, NULL, n FROM c WHERE note = ''""")
def facet_category(spark, d):
    return _flat(spark, orders(spark, d).facet("note", {"filters": {"col": "o_orderstatus", "op": "eq", "value": "O"}}))


@register("facet_category_suppressed", "SELECT count(DISTINCT p_name) > 50 AS suppressed, CASE WHEN count(DISTINCT p_name) > 50 THEN count(DISTINCT p_name) END AS cardinality FROM part")
def facet_category_suppressed(spark, d):
    f = Engine(read(spark, d, "part")).facet("p_name")
    return spark.createDataFrame([(bool(f.get("suppressed")), f.get("cardinality"))], "suppressed boolean, cardinality long")


@register("facet_remainder", f"SELECT CAST(i AS INT) AS bucket_ix, label, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, n FROM (SELECT 0 AS i, '5-LOW' AS label, count(*) FILTER (note = '5-LOW') AS n FROM {ORDERS} UNION ALL SELECT 1, NULL, count(*) FILTER (note <> '5-LOW' AND note <> '') FROM {ORDERS} UNION ALL SELECT 2, 'Empty', count(*) FILTER (note IS NULL OR note = '') FROM {ORDERS})")
def facet_remainder(spark, d):
    return _flat(spark, orders(spark, d).facet("note", bounds=[{"label": "5-LOW"}, {"remainder": True}]))


def _dates():
    for g, table, c in (("hour", "events", "ts"), ("day", "events", "ts"), ("week", "orders", "o_orderdate"), ("month", "orders", "o_orderdate"), ("quarter", "orders", "o_orderdate"), ("year", "orders", "o_orderdate")):
        sql = f"""WITH b AS (SELECT date_trunc('{g}', min({c})) AS a, max({c}) AS z FROM {table}),
e AS (SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS INT) AS bucket_ix, lo, lo + INTERVAL 1 {g} AS hi FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), z, INTERVAL 1 {g})) AS lo FROM b)),
t AS (SELECT date_trunc('{g}', {c}) AS lo, count(*) AS n FROM {table} GROUP BY 1)
SELECT bucket_ix, CAST(NULL AS VARCHAR) AS label, epoch_ms(e.lo) * 1.0 AS lo, epoch_ms(e.hi) * 1.0 AS hi, coalesce(n, 0) AS n FROM e LEFT JOIN t ON e.lo = t.lo"""

        @register(f"facet_date_{g}", sql)
        def run(spark, d, g=g, table=table, c=c):
            return _flat(spark, Engine(read(spark, d, table)).facet(c, granularity=g))


_dates()


def _profiles():
    numbers = ("rows", "present", "missing", "numeric", "distinct", "min", "max", "mean", "median", "q1", "q3", "iqr", "stddev")

    def one(name, table, c, number, distinct, engine=None, relation=None):
        src = relation or table
        sql = f"""WITH s AS (SELECT *, {number} AS x FROM {src}), q AS (SELECT count(*) AS rows, count({c}) AS present, count(*) - count({c}) AS missing, count(x) AS numeric, count(DISTINCT {distinct}) AS "distinct",
min(x) AS "min", max(x) AS "max", avg(x) AS mean, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS stddev FROM s),
o AS (SELECT count(*) AS outliers FROM s, q WHERE x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr)
""" + " UNION ALL ".join(f"SELECT '{k}' AS stat, round(CAST(\"{k}\" AS DOUBLE), 3) AS value FROM q" for k in numbers) + " UNION ALL SELECT 'outliers', round(CAST(CASE WHEN numeric > 0 THEN outliers ELSE 0 END AS DOUBLE), 3) FROM o, q"

        @register(name, sql)
        def run(spark, d):
            p = (engine(spark, d) if engine else Engine(read(spark, d, table))).profile(c)
            return spark.createDataFrame([(k, None if p.get(k) is None else float(p[k])) for k in (*numbers, "outliers")], "stat string, value double").withColumn("value", F.round("value", 3))

    one("profile_numeric", "lineitem", "l_extendedprice", "l_extendedprice", "l_extendedprice")
    one("profile_nulls", "orders", "price", "price", "price", orders, ORDERS)
    one("profile_text", "part", "p_name", "CAST(NULL AS DOUBLE)", "p_name")
    one("profile_datetime", "events", "ts", "CAST(NULL AS DOUBLE)", "ts")


_profiles()


@register("outliers", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT count(*) AS n FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def outliers(spark, d):
    return spark.createDataFrame([(int(Engine(read(spark, d, "events")).profile("value")["outliers"]),)], "n long")


@register("histogram_fd", """WITH q AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
f AS (SELECT *, greatest(mn, q1 - 1.5 * (q3 - q1)) AS lo, least(mx, q3 + 1.5 * (q3 - q1)) AS hi FROM q), b AS (SELECT *, least(20, CAST(ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0 / 3))) AS INT)) AS bins FROM f)
SELECT CAST(least(greatest(floor((l_extendedprice - lo) / ((hi - lo) / bins)), 0), bins - 1) AS INT) AS bin, count(*) AS n,
round(CASE WHEN bin = 0 THEN min(mn) ELSE min(lo + bin * ((hi - lo) / bins)) END, 4) AS lo, round(CASE WHEN bin = min(bins) - 1 THEN min(mx) ELSE min(lo + (bin + 1) * ((hi - lo) / bins)) END, 4) AS hi FROM lineitem, b GROUP BY 1""")
def histogram_fd(spark, d):
    h = lines(spark, d).profile("l_extendedprice")["histogram"]
    return spark.createDataFrame([(i, int(b["n"]), round(b["lo"], 4), round(b["hi"], 4)) for i, b in enumerate(h) if b["n"]], "bin int, n long, lo double, hi double")


@register("top_values", "SELECT p_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_values(spark, d):
    t = Engine(read(spark, d, "part")).profile("p_type")["topValues"]
    return spark.createDataFrame([(x["value"], int(x["n"]), float(x["share"])) for x in t], "value string, n long, share double").withColumn("share", F.round("share", 6))


# router
def shop(spark, d, **joins) -> Router:
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id", "labels": "doc_id", "supplier": "s_suppkey"}
    return Router({t: {"df": read(spark, d, t), "key": k, **joins.get(t, {})} for t, k in keys.items()})


def _router():
    nation = {"from": "region", "local_key": "n_regionkey", "foreign_key": "r_regionkey"}

    @register("lookup_rename", "SELECT n_nationkey, n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
    def lookup_rename(spark, d):
        return shop(spark, d, nation={"join": [{**nation, "fields": {"r_name": "region"}}]}).shaped("nation").select("n_nationkey", "n_name", "region")

    label = {"from": "labels", "on": "doc_id", "fields": ["quality", "toxic"]}

    @register("lookup_passthrough", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
    def lookup_passthrough(spark, d):
        return shop(spark, d, documents={"join": [label]}).shaped("documents").select("doc_id", "quality", "toxic")

    @register("lookup_null", "SELECT d.doc_id, l.quality AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
    def lookup_null(spark, d):
        return shop(spark, d, documents={"join": [{**label, "fields": {"quality": "n_chars"}, "missing": "null"}]}).shaped("documents").select("doc_id", "n_chars")

    @register("lookup_keep_unmatched", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
    def lookup_keep_unmatched(spark, d):
        return shop(spark, d, documents={"join": [{**label, "fields": {"quality": "n_chars"}}]}).shaped("documents").select("doc_id", "n_chars")

    @register("lookup_hold", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    def lookup_hold(spark, d):
        return shop(spark, d, documents={"join": [{**label, "missing": "hold"}]}).shaped("documents").select("doc_id", "quality")

    last = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rid DESC) AS k FROM (SELECT *, row_number() OVER () AS rid FROM orders)) WHERE k = 1)"

    @register("lookup_last_match", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {last} ON c_custkey = o_custkey")
    def lookup_last_match(spark, d):
        return shop(spark, d, customer={"join": [{"from": "orders", "localKey": "c_custkey", "foreignKey": "o_custkey", "fields": ["o_orderkey"]}]}).shaped("customer").select("c_custkey", "o_orderkey")

    child = {"from": "nation", "many": True, "local_key": "r_regionkey", "foreign_key": "n_regionkey"}
    ordered = "FROM region LEFT JOIN (SELECT *, row_number() OVER () AS rid FROM nation) ON r_regionkey = n_regionkey GROUP BY r_regionkey"

    @register("collect_values", f"SELECT r_regionkey, string_agg(n_name, '|' ORDER BY rid) AS names {ordered}")
    def collect_values(spark, d):
        out = shop(spark, d, region={"join": [{**child, "as": "names", "select": "n_name"}]}).shaped("region")
        return out.select("r_regionkey", F.array_join("names", "|").alias("names"))

    @register("collect_structs", "SELECT r_regionkey, n_nationkey AS key, n_name AS label FROM nation JOIN region ON r_regionkey = n_regionkey")
    def collect_structs(spark, d):
        out = shop(spark, d, region={"join": [{**child, "as": "nations", "select": {"n_nationkey": "key", "n_name": "label"}}]}).shaped("region")
        return out.select("r_regionkey", F.inline("nations"))

    @register("collect_distinct_sorted", "SELECT c_nationkey AS n_nationkey, string_agg(s, '|' ORDER BY s) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS s FROM customer) GROUP BY 1")
    def collect_distinct_sorted(spark, d):
        j = {"from": "customer", "many": True, "local_key": "n_nationkey", "foreign_key": "c_nationkey", "as": "segments", "select": "c_mktsegment", "distinct": True, "sort": True, "missing": "hold"}
        return shop(spark, d, nation={"join": [j]}).shaped("nation").select("n_nationkey", F.array_join("segments", "|").alias("segments"))

    def rolled(name, fn, sql, digits=None, missing=None, **agg):
        @register(name, f"SELECT c_custkey, {sql} AS v FROM customer {'JOIN' if missing else 'LEFT JOIN'} (SELECT *, row_number() OVER () AS rid FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey")
        def run(spark, d):
            j = {"from": "orders", "many": True, "local_key": "c_custkey", "foreign_key": "o_custkey", "aggregate": {"v": {"fn": fn, **agg}}} | ({"missing": missing} if missing else {})
            out = shop(spark, d, customer={"join": [j]}).shaped("customer").select("c_custkey", "v")
            return out.withColumn("v", F.round("v", digits)) if digits else out

    rolled("router_count", "count", "count(o_orderkey)")
    rolled("router_sum", "sum", "round(coalesce(sum(o_totalprice), 0.0), 2)", 2, field="o_totalprice")
    rolled("router_avg", "avg", "round(avg(o_totalprice), 7)", 7, field="o_totalprice")  # at fewer digits halves would go either way
    rolled("router_min", "min", "min(o_totalprice)", field="o_totalprice")
    rolled("router_max_text", "max", "max(o_orderpriority)", field="o_orderpriority")
    rolled("router_distinct", "distinctCount", "CASE WHEN count(o_orderkey) > 0 THEN count(DISTINCT o_orderstatus) END", field="o_orderstatus")
    rolled("router_first", "first", "arg_min(o_orderkey, (o_orderdate, rid))", field="o_orderkey", orderBy="o_orderdate")
    rolled("router_last", "last", "arg_max(o_orderkey, (o_orderdate, -rid))", field="o_orderkey", orderBy="o_orderdate")
    rolled("router_rollup_hold", "count", "count(o_orderkey)", missing="hold")

    @register("rollup_chain", "SELECT n_nationkey, count(c_custkey) AS customers, round(coalesce(sum(spent), 0.0), 2) AS spent FROM nation LEFT JOIN (SELECT c_custkey, c_nationkey, coalesce(sum(o_totalprice), 0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) ON n_nationkey = c_nationkey GROUP BY 1")
    def rollup_chain(spark, d):
        spent = {"from": "orders", "many": True, "local_key": "c_custkey", "foreign_key": "o_custkey", "aggregate": {"spent": {"fn": "sum", "field": "o_totalprice"}}}
        up = {"from": "customer", "many": True, "local_key": "n_nationkey", "foreign_key": "c_nationkey", "aggregate": {"customers": {"fn": "count"}, "spent": {"fn": "sum", "field": "spent"}}}
        return shop(spark, d, customer={"join": [spent]}, nation={"join": [up]}).shaped("nation").select("n_nationkey", "customers", F.round("spent", 2).alias("spent"))

    talks = "(SELECT * FROM conversations)"

    def conversation(spark, d, spread):
        df = read(spark, d, "conversations")
        parents = df.where("turn = 0").select("conv_id", F.col("role").alias("first_role"))
        return Router({"conv": {"df": parents, "key": "conv_id", "join": [{"from": "turns", "local_key": "conv_id", "foreign_key": "conv_id", "spread": spread}]}, "turns": {"df": df.withColumn("turn_id", F.concat_ws(":", "conv_id", "turn")), "key": "turn_id"}}).shaped("conv")

    @register("spread_basic", f"SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS assistant, arg_max(text, turn) FILTER (role = 'user') AS user_text FROM {talks} WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY 1")
    def spread_basic(spark, d):
        return conversation(spark, d, {"name": "role", "value": "text"}).select("conv_id", "assistant", F.col("user").alias("user_text"))

    @register("spread_prefix_typed", f"SELECT conv_id, CAST(max(turn) FILTER (role = 'user') AS DOUBLE) AS last_user, max(turn) FILTER (role = 'system') AS last_system FROM {talks} WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY 1")
    def spread_prefix_typed(spark, d):
        out = conversation(spark, d, {"name": "role", "value": "turn", "prefix": "last_", "include": ["user", "system"], "type": {"user": "number"}})
        return out.select("conv_id", F.col("last_user").cast("double").alias("last_user"), "last_system")

    def accounts(spark, d, **unnest):
        """Every order with its items as a list, in the order of their values."""
        acc = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_extendedprice", "l_partkey", "l_quantity"))).alias("items"))
        declared = {"path": "items", "as": "item"} | unnest
        parts = {"df": read(spark, d, "part"), "key": "p_partkey"}
        return Router({"acc": {"df": acc.withColumn(ROW, F.col("l_orderkey")), "key": "l_orderkey", "unnest": declared}, "part": parts}, {"items": "item", "acc": "acc"})

    place = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_quantity) - 1"
    items = "FROM lineitem"

    for name, key in (("unnest", "accId"), ("unnest_all", "order_id")):

        @register(name, f"SELECT 'acc:' || l_orderkey AS {key}, 'acc:' || l_orderkey || ':' || ({place}) AS row_id, l_partkey, l_quantity {items}")
        def unnest(spark, d, name=name, key=key):
            router = accounts(spark, d, **({} if name == "unnest" else {"parentKey": key}))
            return router.frame("item").orderBy("__pos").select(key, F.col("__id").alias("row_id"), "l_partkey", "l_quantity")

    @register("unnest_parent_all", "SELECT DISTINCT l_orderkey FROM lineitem")
    def unnest_parent_all(spark, d):
        return accounts(spark, d).shaped("acc")

    @register("unnest_parent", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
    def unnest_parent(spark, d):
        return accounts(spark, d, keep=True).shaped("acc").select("l_orderkey", F.size("items").cast("long").alias("n"))

    @register("unnest_join", "SELECT 'acc:' || l_orderkey AS accId, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
    def unnest_join(spark, d):
        join = {"from": "part", "local_key": "l_partkey", "foreign_key": "p_partkey", "fields": ["p_brand"], "missing": "hold"}
        return accounts(spark, d, join=join).shaped("items").select("accId", "l_partkey", "p_brand")

    @register("unnest_nested", "SELECT 'region:' || n_regionkey || ':' || (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS nationId, 'region:' || n_regionkey || ':' || (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || ':' || (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1) AS row_id, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
    def unnest_nested(spark, d):
        suppliers = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey"))).alias("suppliers"))
        nations = read(spark, d, "nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"))
        tree = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "suppliers"))).alias("nations"))
        declared = {"path": "nations", "as": "nation", "unnest": {"path": "suppliers", "as": "supplier"}}
        out = Router({"region": {"df": tree.withColumn(ROW, F.col("n_regionkey").cast("long")), "key": "n_regionkey", "unnest": declared}}).frame("supplier")
        return out.select("nationId", F.col("__id").alias("row_id"), "s_suppkey")

    @register("unnest_children", "SELECT l_orderkey, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
    def unnest_children(spark, d):
        acc = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity")).alias("items"))
        up = {"from": "item", "many": True, "foreign_key": "accId", "aggregate": {"n_items": {"fn": "count"}, "quantity": {"fn": "sum", "field": "l_quantity"}}}
        first = {"acc": {"df": acc.withColumn(ROW, F.col("l_orderkey")), "key": "l_orderkey", "join": up, "unnest": {"path": "items", "as": "item"}}}
        return Router(first).shaped("acc").select("l_orderkey", "n_items", F.round("quantity", 2).alias("quantity"))

    @register("spread_over_join", "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'system'), 'old') AS system FROM conversations GROUP BY 1 HAVING min(turn) = 0")
    def spread_over_join(spark, d):
        df = read(spark, d, "conversations")
        parents = df.where("turn = 0").select("conv_id")
        olds = parents.select("conv_id", F.lit("old").alias("system"))
        turns = df.withColumn("turn_id", F.concat_ws(":", "conv_id", "turn")).withColumn(ROW, F.col("turn"))
        joins = [{"from": "olds", "on": "conv_id", "fields": ["system"]}, {"from": "turns", "on": "conv_id", "spread": {"name": "role", "value": "text"}}]
        return Router({"conv": {"df": parents, "key": "conv_id", "join": joins}, "olds": {"df": olds, "key": "conv_id"}, "turns": {"df": turns, "key": "turn_id"}}).shaped("conv").select("conv_id", "system")

    @register("join_unknown_source", "SELECT r_regionkey, 0 AS n FROM region")
    def join_unknown_source(spark, d):
        join = {"from": "absent", "many": True, "on": "r_regionkey", "aggregate": {"n": {"fn": "count"}}}
        return shop(spark, d, region={"join": join}).shaped("region").select("r_regionkey", "n")

    @register("shaped_typed", "SELECT e.event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round(value, 6) AS amount FROM events e")
    def shaped_typed(spark, d):
        df = read(spark, d, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"), F.round("value", 6).cast("string").alias("amount"))
        spec = {"df": df, "key": "event_id", "fields": {"day": {"type": "date", "format": "dd/MM/yyyy"}}}
        return Router({"e": spec}).typed("e")

    def coercion(name, make, spec, sql, table="orders", key="o_orderkey"):
        @register(name, f"SELECT {key}, {sql} AS v FROM {table}")
        def run(spark, d):
            df = read(spark, d, table).select(key, make().alias("raw"))
            return df.select(key, coerced(F.col("raw"), df.schema["raw"].dataType, spec).alias("v"))

    coercion("coerce_number", lambda: F.concat(F.lit("EUR "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,")), {"type": "number", "decimal": ","}, "round(o_totalprice, 2)")
    coercion("coerce_integer", lambda: F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))).otherwise(F.col("o_orderkey").cast("string")), "integer", "CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS DOUBLE) END")
    coercion("coerce_expression", lambda: F.lit("2*3"), "number", "CAST(NULL AS DOUBLE)")
    coercion("coerce_bool", lambda: F.when(F.col("o_orderkey") % 3 == 0, " Yes ").when(F.col("o_orderkey") % 3 == 1, "0").otherwise("maybe"), "boolean", "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    coercion("coerce_date_pattern", lambda: F.date_format("o_orderdate", "d/M/yyyy"), {"type": "date", "format": "dd/MM/yyyy"}, "strftime(o_orderdate, '%Y-%m-%d')")
    coercion("coerce_date_overflow", lambda: F.lit("31/02/2024"), {"type": "date", "format": "dd/MM/yyyy"}, "'2024-03-02'")
    coercion("coerce_date_iso", lambda: F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), "date", "strftime(o_orderdate, '%Y-%m-%d')")
    coercion("coerce_epoch", lambda: F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"), {"type": "date", "format": "epoch-ms"}, "strftime(o_orderdate, '%Y-%m-%d')")
    coercion("coerce_nulls", lambda: F.col("o_orderpriority"), {"type": "text", "nulls": ["5-LOW"]}, "nullif(o_orderpriority, '5-LOW')")
    coercion("coerce_json", lambda: F.col("props"), "json", "replace(props, ' ', '')", "events", "event_id")


_router()


# changes
@register("append_rows", "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, NULL FROM supplier WHERE s_nationkey = 3")
def append_rows(spark, d):
    df = read(spark, d, "supplier")
    more = df.where("s_nationkey = 3").select((F.col("s_suppkey") + 100000).alias("s_suppkey"), "s_name", F.lit(1).alias("no_such_column"))
    return Engine(df).append(more).df.select("s_suppkey", "s_name", "s_acctbal")


@register("delete_rows", "SELECT n_nationkey FROM (SELECT *, row_number() OVER () - 1 AS rid FROM nation) WHERE rid NOT IN (0, 3, 7)")
def delete_rows(spark, d):
    return Engine(read(spark, d, "nation")).delete([0, 3, 7, 10**9]).df.select("n_nationkey")


@register("edit_cell", "SELECT n_nationkey, CASE WHEN rid = 4 THEN 'Atlantis' ELSE n_name END AS n_name, CASE WHEN rid = 4 THEN 2 ELSE n_regionkey END AS n_regionkey FROM (SELECT *, row_number() OVER () - 1 AS rid FROM nation)")
def edit_cell(spark, d):
    return Engine(read(spark, d, "nation")).edit(4, {"n_name": "Atlantis", "n_regionkey": "2", "absent": 1}).df.select("n_nationkey", "n_name", "n_regionkey")


@register("filter_and_quick", f"SELECT o_orderkey FROM {ORDERS} WHERE price > 100000 AND (contains(lower(note), 'low') OR contains(lower(o_orderpriority), 'low'))")
def filter_and_quick(spark, d):
    rows = orders(spark, d).df.select("o_orderkey", "price", "note", "o_orderpriority", ROW)
    return Engine(rows).matching({"filters": {"col": "price", "op": "gt", "value": 100000}, "quick": "LOW"}).select("o_orderkey")


@register("window_pages", f"SELECT l_orderkey, l_shipdate, rid AS row_id, ord FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate DESC, rid) - 1 AS ord FROM {LINES}) WHERE ord >= 2500 AND ord < 2600")
def window_pages(spark, d):
    pages = lines(spark, d).pages({"sort": [{"col": "l_shipdate", "dir": "desc"}]})
    return pages.window(2500, 2600).select("l_orderkey", "l_shipdate", F.col(ROW).alias("row_id"), "ord")


@register("group_page_totals", "SELECT l_partkey AS key, count(*) AS leafCount, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, row_number() OVER (ORDER BY l_partkey) - 1 + 5 AS ord FROM lineitem WHERE l_partkey IN (SELECT DISTINCT l_partkey FROM lineitem ORDER BY 1 LIMIT 20 OFFSET 5) GROUP BY 1")
def group_page_totals(spark, d):
    q = {"groupBy": ["l_partkey"], "range": {"start": 5, "end": 25}}
    return lines(spark, d).group_level(q, _AGG[2:]).withColumn("mid", F.round("mid", 4))


@register("keyed_diff", "SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 10 = 0 THEN 'removed' ELSE 'updated' END AS change FROM supplier WHERE s_suppkey % 10 IN (0, 1) UNION ALL SELECT CAST(s_suppkey + 100000 AS VARCHAR), 'added' FROM supplier WHERE s_suppkey % 10 = 2")
def diff(spark, d):
    old = read(spark, d, "supplier")
    new = old.where("s_suppkey % 10 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 1, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return keyed_diff(old, new.unionByName(old.where("s_suppkey % 10 = 2").withColumn("s_suppkey", F.col("s_suppkey") + 100000)), "s_suppkey")
