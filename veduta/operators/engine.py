"""Table-view requests over a DataFrame, compiled to DataFrame operations.

A request is a dict ``{filters, quick, sort, range: {start, end}, groupBy, groupValues}``.  Answers that may be large
stay lazy DataFrames; bounded ones (buckets, statistics) are lists and dicts.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType

from veduta.functions.columns import Schema, epoch_ms, kind_of, moment, plain
from veduta.operators import facets
from veduta.operators.aggregates import aggregate, levels_of
from veduta.operators.quantiles import of_groups, quantiles
from veduta.plans.ordering import keys, order
from veduta.plans.predicates import compiled, leaf, prune_state, quick
from veduta.sources.tables import ROW, with_row_id

PAGE, COUNTS = 100, 64
#: Edges that a value is compared with one by one, in generated code.
MOST_COMPARED = 64
#: Groups of a page that is broadcast.
MOST_BROADCAST = 10_000


class ReadOnly(Exception):
    """The source can't be edited."""


class Engine:
    """A table under requests.  Row ids are made when a request first needs them; aggregates, facets and counts don't."""

    def __init__(self, df: DataFrame, order_by: list[str] | None = None, editable: bool = True):
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("column names must differ")
        self.source, self.order_by, self.editable = df, order_by, editable
        self.schema = Schema(df, (ROW,))
        self.version = 0
        self._counts: dict[str, int] = {}

    @cached_property
    def df(self) -> DataFrame:
        """The table with row ids."""
        return with_row_id(self.source, self.order_by)

    # rows
    def predicate(self, q: dict | None) -> Column | None:
        q = q or {}
        own = [p for p in (compiled(q.get("filters"), self.schema), quick(q.get("quick"), self.schema)) if p is not None]
        return reduce(operator.and_, own) if own else None

    def matching(self, q: dict | None = None, ids: bool = True) -> DataFrame:
        """The rows under filters and quick search."""
        p, rows = self.predicate(q), self.df if ids else self.source
        return rows if p is None else rows.where(p)

    def ordered(self, q: dict | None = None) -> DataFrame:
        return self.matching(q).orderBy(*order((q or {}).get("sort"), self.schema, F.col(ROW)))

    def count(self, q: dict | None = None) -> int:
        """Rows under filters and quick search; the last ``COUNTS`` answers are remembered."""
        key = json.dumps([(q or {}).get("filters"), (q or {}).get("quick") or ""], default=str, sort_keys=True)
        if key not in self._counts:
            self._counts[key] = self.matching(q, ids=False).count()
            if len(self._counts) > COUNTS:
                del self._counts[next(iter(self._counts))]
        return self._counts[key]

    def invalidate(self) -> None:
        """Forgets what was remembered of the table, and lets go of rows that were persisted to be numbered."""
        self.version += 1
        self._counts.clear()
        if "df" in self.__dict__:
            if held := self.df.__dict__.get("held"):
                held.unpersist()
            del self.df

    def window(self, q: dict | None = None) -> DataFrame:
        """One range of the view's rows, in order."""
        span = (q or {}).get("range") or {}
        start = max(0, int(span.get("start", 0)))
        end = max(start, int(span.get("end", start + PAGE)))
        return self.ordered(q).offset(start).limit(end - start)

    def numbered(self, q: dict | None = None) -> DataFrame:
        """``window`` with each row's place in the view, ``ord``; only the range is numbered."""
        start = max(0, int(((q or {}).get("range") or {}).get("start", 0)))
        by = Window.orderBy(*order((q or {}).get("sort"), self.schema, F.col(ROW)))
        return self.window(q).withColumn("ord", F.row_number().over(by).cast("long") - 1 + start)

    def pages(self, q: dict | None = None) -> Pages:
        """The view in order, kept for many windows, however deep."""
        return Pages(self, q or {})

    def execute(self, q: dict | None = None) -> dict:
        return {"rows": self.window(q), "total": self.count(q)}

    def positions(self, q: dict | None = None) -> DataFrame:
        return self.ordered(q).select(ROW)

    def rows_at(self, at: list[int]) -> DataFrame:
        """The rows at the given positions, in their order; absent positions give none."""
        wanted = self.df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(at)], f"{ROW} long, __ord long")
        return self.df.join(wanted, ROW).orderBy("__ord")

    def selected(self, at: list[int]) -> DataFrame:
        """The rows at the given positions, in the table's order."""
        wanted = self.df.sparkSession.createDataFrame([(int(p),) for p in set(at)], f"{ROW} long")
        return self.df.join(wanted, ROW, "left_semi").orderBy(ROW)

    # aggregates
    def aggregates(self, q: dict | None, aggs: list[dict]) -> DataFrame:
        """One row; quantiles are found by rank, at once, the others when the row is asked for."""
        rows = self.matching(q, ids=False)
        return rows.agg(*self._whole(rows, aggs))

    def _whole(self, rows: DataFrame, aggs: list[dict]) -> list[Column]:
        """The aggregates of all of some rows; quantiles are found at once."""
        ready = {}
        for c, own in self._by_rank(aggs).items():
            wanted = sorted({p for _, levels in own for p in levels})
            got = dict(zip(wanted, quantiles(rows, self.schema[c].num, wanted), strict=True))
            for name, levels in own:
                v = [got[p] for p in levels]
                ready[name] = None if v[0] is None else v[-1] - v[0] if len(v) > 1 else v[0]
        return [F.first(F.lit(ready[a["id"]]).cast("double")).alias(a["id"]) if a["id"] in ready else self._aggs([a])[0] for a in aggs]

    def _by_rank(self, aggs: list[dict]) -> dict[str, list]:
        """Column -> (id, levels) of the aggregates that are quantiles."""
        by_col: dict[str, list] = {}
        for a in aggs:
            if levels := levels_of(a["fn"]) if a.get("col") and self.schema[a["col"]].kind != "text" else ():
                by_col.setdefault(a["col"], []).append((a["id"], levels))
        return by_col

    def _aggs(self, aggs: list[dict]) -> list[Column]:
        return [aggregate(self.schema[a["col"]] if a.get("col") else None, a["fn"]).alias(a["id"]) for a in aggs]

    def _grouped(self, rows: DataFrame, names: list[str], more: list[Column], aggs: list[dict], rolled: bool = False) -> DataFrame:
        """The groups by ``names`` with ``more`` and the aggregates; quantiles are found by rank, at once, if a group is large."""
        groups, by_col = (rows.rollup if rolled else rows.groupBy)(*names), self._by_rank(aggs)
        wanted = {c: sorted({p for _, levels in own for p in levels}) for c, own in by_col.items()}
        found = of_groups(rows, names, [(self.schema[c].num, ps) for c, ps in wanted.items()], rolled) if by_col else None
        if found is None:
            return groups.agg(*more, *self._aggs(aggs))
        values, small = found
        ready = {}
        for i, (c, own) in enumerate(by_col.items()):
            for name, levels in own:
                v = [F.col(f"__q{i}")[wanted[c].index(p)] for p in levels]
                ready[name] = v[-1] - v[0] if len(v) > 1 else v[0]
        depth = F.lit(len(names)) - reduce(operator.add, [F.grouping(n).cast("int") for n in names]) if rolled else F.lit(len(names))
        made = groups.agg(*more, depth.alias("__depth"), *self._aggs([a for a in aggs if a["id"] not in ready]))
        shown = [c for c in made.columns if c != "__depth" and c not in {a["id"] for a in aggs}]
        values = values.withColumnsRenamed({n: f"__of_{n}" for n in names})
        same = [F.col("__depth") == F.col("__level"), *[F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names]]
        both = made.join(F.broadcast(values) if small else values, reduce(operator.and_, same), "left")
        return both.select(*shown, *[(ready[a["id"]] if a["id"] in ready else plain(a["id"])).alias(a["id"]) for a in aggs])

    def rollup(self, q: dict | None, by: list[str], aggs: list[dict]) -> DataFrame:
        """Every prefix level and the grand row: k0.., g0.. (1 where rolled up), level, the aggregates."""
        names = [f"k{i}" for i in range(len(by))]
        rows = self.matching(q, ids=False).select("*", *[self.schema[c].key.alias(n) for c, n in zip(by, names, strict=True)])
        flags = [F.grouping(n).cast("int").alias(f"g{i}") for i, n in enumerate(names)]
        level = (F.lit(len(by)) - reduce(operator.add, [F.grouping(n).cast("int") for n in names])).alias("level") if by else None
        if not by:
            return rows.agg(*self._whole(rows, aggs)).withColumn("level", F.lit(0))
        levels = self._grouped(rows, names, [*flags, level], aggs, rolled=True)
        # Of no rows a rollup makes none, but the grand row is due: what the aggregates make of nothing.
        none = rows.limit(1).agg(F.count("*").alias("__n")).where("__n = 0")
        kinds = dict(levels.dtypes)
        grand = none.join(F.broadcast(rows.limit(0).agg(*self._aggs(aggs))), how="left").select(*[F.lit(None).cast(kinds[n]).alias(n) for n in names], *[F.lit(1).alias(f"g{i}") for i in range(len(by))], F.lit(0).alias("level"), *[a["id"] for a in aggs])
        return levels.unionByName(grand)

    def distinct_values(self, col: str, q: dict | None = None) -> DataFrame:
        return self.matching(q, ids=False).groupBy(self.schema[col].key.alias("value")).agg(F.count("*").alias("n"))

    def _path(self, q: dict) -> DataFrame:
        rows = self.matching(q)
        for c, v in zip(q.get("groupBy") or [], q.get("groupValues") or [], strict=False):
            view = self.schema[c]
            if view.kind == "datetime" and v is not None:
                rows = rows.where(view.num == F.lit(moment(v)))
            else:
                rows = rows.where(view.key.eqNullSafe(F.lit(v)))
        return rows

    def group_level(self, q: dict, aggs: list[dict]) -> DataFrame:
        """The groups of the next key under ``groupValues`` (key, leafCount, totals, ord), or the innermost group's rows."""
        by, opened = q.get("groupBy") or [], q.get("groupValues") or []
        span = q.get("range") or {}
        start = max(0, int(span.get("start", 0)))
        size = max(0, int(span.get("end", start + PAGE)) - start)
        rows = self._path(q)
        if len(opened) >= len(by):
            return rows.orderBy(*order(q.get("sort"), self.schema, F.col(ROW))).offset(start).limit(size)
        view, ids, by_key = self.schema[by[len(opened)]], {a["id"] for a in aggs}, []
        sorted_by = [s["col"] for s in q.get("sort") or []]
        # Only what the order needs is totalled for all groups, the rest for those of the page.
        early = [a for a in aggs if a["id"] in sorted_by]
        late = [a for a in aggs if a["id"] not in sorted_by]
        counted = F.count("*").alias("leafCount"), F.min(ROW).alias("__first")
        groups = self._grouped(rows.select("*", view.key.alias("__key")), ["__key"], list(counted), early).withColumnRenamed("__key", "key")
        key_view = type(view)("key", groups.schema["key"].dataType)
        for s in q.get("sort") or []:
            down = s.get("dir") == "desc"
            if s["col"] in ids:
                by_key.append(plain(s["col"]).desc_nulls_last() if down else plain(s["col"]).asc_nulls_last())
            elif s["col"] == view.name:
                by_key += keys(key_view, down, bool(s.get("nullsFirst")))
        by_key = [*(by_key or keys(key_view)), F.col("__first").asc()]
        page = groups.orderBy(*by_key).offset(start).limit(size)
        page = page.withColumn("ord", F.row_number().over(Window.orderBy(*by_key)).cast("long") - 1 + start).drop("__first")
        if not late:
            return page
        page = F.broadcast(page) if size <= MOST_BROADCAST else page
        there = rows.withColumn("__key", view.key).join(page.select(F.col("key").alias("__of")), F.col("__key").eqNullSafe(F.col("__of")), "left_semi")
        totals = self._grouped(there, ["__key"], [], late)
        both = page.join(totals, F.col("key").eqNullSafe(F.col("__key")))
        return both.select("key", "leafCount", *[plain(a["id"]) for a in aggs], "ord")

    def group_totals(self, q: dict, aggs: list[dict]) -> DataFrame:
        """matchCount, groupCount and the grand totals under the opened path."""
        by, opened = q.get("groupBy") or [], q.get("groupValues") or []
        rows, key = self._path(q), self.schema[by[min(len(opened), len(by) - 1)]].key
        return rows.agg(F.count("*").alias("matchCount"), (F.count_distinct(key) + F.max(F.when(key.isNull(), 1).otherwise(0))).alias("groupCount"), *self._whole(rows, aggs))

    def chart(self, x: str, y: str, series: str | None = None, fn: str = "sum", q: dict | None = None) -> DataFrame:
        if not x or not y:
            raise ValueError("a chart needs x and y")
        keys_ = {"__x": self.schema[x].key} | ({"__series": self.schema[series].key} if series else {})
        rows = self.matching(q, ids=False).select("*", *[k.alias(n) for n, k in keys_.items()])
        made = self._grouped(rows, list(keys_), [], [{"id": "__y", "col": y, "fn": fn}])
        return made.withColumnsRenamed({"__x": "x", "__series": "series", "__y": "y"})

    # facets and profile
    def facet(self, col: str, q: dict | None = None, bounds: list[dict] | None = None, buckets: int = 20, strategy: str = "equal", granularity: str | None = None) -> dict:
        """Bounds over all rows, counts under the filters."""
        v, rows = self.schema[col], self.matching(q, ids=False)
        finite = F.when(F.abs(v.num) < float("inf"), v.num)
        if v.kind == "bool":
            made, edges = {"kind": "boolean"}, None
            count = lambda some: self._booleans(v, some)
        elif v.kind == "text":
            made, edges = {"kind": "category"}, None
            labels = self._labels(v) if bounds is None else bounds
            if isinstance(labels, int):
                return made | {"suppressed": True, "cardinality": labels, "buckets": []}
            count = lambda some: self._categories(v, some, labels)
        else:
            made = {"kind": "date" if v.kind == "datetime" else "numeric", "strategy": strategy}
            if bounds:
                edges = [b["lo"] for b in bounds if "lo" in b] + [[b["hi"] for b in bounds if "hi" in b][-1]]
            else:
                r = self.source.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
                if r["lo"] is None:
                    n = rows.count()
                    return made | {"empty": True, "buckets": [{"label": "Empty", "empty": True, "n": n}] if n else []}
                if v.kind == "datetime":
                    lo, hi = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=x) for x in (r["lo"], r["hi"]))
                    made["granularity"] = granularity or facets.granularity(lo, hi, buckets)
                    edges = [moment(t) for t in facets.dates(lo, hi, made["granularity"])]
                elif strategy == "quantile" and (sample := self._sample(finite)):
                    edges = facets.quantiles(sample, r["hi"], buckets)
                else:
                    edges = (facets.logarithmic if strategy == "log" else facets.equal)(r["lo"], r["hi"], buckets)
            of_calendar = "granularity" in made
            trunc = F.unix_millis(F.date_trunc(made["granularity"], v.raw.cast("timestamp"))) if of_calendar else None
            count = lambda some: self._counted(some, finite, edges, v.kind == "datetime", trunc)
        made["buckets"] = count(rows)
        if bounds is None:
            made["unfiltered"] = [b["n"] for b in (made["buckets"] if self.predicate(q) is None else count(self.source))]
        return made

    @staticmethod
    def _booleans(v, rows: DataFrame) -> list[dict]:
        r = rows.agg(F.count_if(~v.raw).alias("f"), F.count_if(v.raw).alias("t"), F.count_if(v.missing).alias("e")).first()
        out = [{"label": "false", "n": r["f"]}, {"label": "true", "n": r["t"]}]
        return out + ([{"label": "Empty", "empty": True, "n": r["e"]}] if r["e"] else [])

    def _sample(self, x: Column) -> list[float]:
        """The values at 10,000 evenly spread positions, or at all of fewer."""
        step = max(1.0, self.count() / facets.SAMPLE)
        nth = F.ceil(F.col(ROW) / step)
        picked = (F.floor(nth * step) == F.col(ROW)) & (nth < facets.SAMPLE) if step > 1 else F.lit(True)
        return [r[0] for r in self.df.where(picked & x.isNotNull()).select(x).collect()]

    @staticmethod
    def _counted(rows: DataFrame, x: Column, edges: list[float], open_end: bool, trunc: Column | None = None) -> list[dict]:
        """Half-open buckets, the last closed unless ``open_end``; one aggregation whose size is that of the edges.

        ``trunc`` is the edge that a value lies behind, where edges are those of a calendar.
        """
        last = len(edges) - 2
        if trunc is not None:
            at, place = trunc, {e: i for i, e in enumerate(edges[:-1])}
        elif len(edges) <= MOST_COMPARED:
            at, place = reduce(operator.add, [(x >= F.lit(float(e))).cast("int") for e in edges]) - 1, None
        else:
            at, place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1, None
        if not open_end:
            at = F.when(x == F.lit(float(edges[-1])), last).otherwise(at)
        counts: dict = {}
        for r in rows.groupBy(F.when(x.isNotNull(), at).alias("at")).agg(F.count("*").alias("n")).collect():
            i = None if r["at"] is None else r["at"] if place is None else place.get(float(r["at"]), -1)
            counts[i] = counts.get(i, 0) + r["n"]
        out = [{"lo": a, "hi": b, "n": counts.get(i, 0)} for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        return out + ([{"label": "Empty", "empty": True, "n": counts[None]}] if counts.get(None) else [])

    def _labels(self, v) -> list[dict] | int:
        """The texts of a column, the commonest first, or how many there are if too many."""
        shown = F.when(~v.blank, v.txt)
        n = self.source.agg(F.count_distinct(shown)).first()[0]
        if n > facets.MOST_CATEGORIES:
            return n
        top = self.df.where(~v.blank).groupBy(shown.alias("t")).agg(F.count("*").alias("n"), F.min(ROW).alias("first"))
        return [{"label": r["t"]} for r in top.orderBy(F.desc("n"), "first").collect()]

    @staticmethod
    def _categories(v, rows: DataFrame, bounds: list[dict]) -> list[dict]:
        labels = [b["label"] for b in bounds if not b.get("remainder") and not b.get("empty")]
        place = F.when(v.blank, F.lit("e")).when(v.txt.isin(labels), F.concat(F.lit("="), v.txt)).otherwise(F.lit("r"))
        counts = {r["p"]: r["n"] for r in rows.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()}
        out = [{**b, "n": counts.get("r", 0) if b.get("remainder") else counts.get("=" + b["label"], 0)} for b in bounds if not b.get("empty")]
        return out + ([{"label": "Empty", "empty": True, "n": counts["e"]}] if counts.get("e") else [])

    def numeric_text(self, col: str, q: dict | None = None) -> bool:
        """Whether nine in ten of the first 200 present texts of the view's first 20,000 rows are finite numbers."""
        v = self.schema[col]
        first = self.matching(q).orderBy(ROW).limit(20_000).where(~v.blank).orderBy(ROW).limit(200)
        r = first.agg(F.count("*").alias("n"), F.count_if(F.abs(v.num) < float("inf")).alias("ok")).first()
        return r["n"] > 0 and r["ok"] >= 0.9 * r["n"]

    def profile(self, col: str, q: dict | None = None, top: int = 5) -> dict:
        """The statistics of a column: numeric ones of numbers, booleans and texts that are numbers; else the commonest values."""
        v, rows = self.schema[col], self.matching(q, ids=False)
        numbers = v.kind == "number" or (v.kind == "text" and self.numeric_text(col, q))
        x = F.when(F.abs(v.num) < float("inf"), v.num) if numbers or v.kind == "bool" else F.lit(None).cast("double")
        one = v.num if v.kind in ("number", "bool") else v.txt
        r = rows.agg(
            F.count("*").alias("rows"), F.count_if(~v.blank).alias("present"), F.count_if(v.blank).alias("missing"), F.count(x).alias("numeric"),
            F.count_distinct(F.when(~v.blank, one)).alias("distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"),
        ).first().asDict()
        r |= dict(zip(("q1", "median", "q3"), quantiles(rows, x, [0.25, 0.5, 0.75], r["numeric"]), strict=True))
        r |= {"iqr": None, "outliers": 0, "histogram": []}
        if r["numeric"]:
            r["iqr"] = r["q3"] - r["q1"]
            low, high = r["q1"] - 1.5 * r["iqr"], r["q3"] + 1.5 * r["iqr"]
            r["outliers"], r["histogram"] = self._histogram(x, rows, r, (x < low) | (x > high))
        if not numbers:
            best = rows.where(~v.blank).groupBy(v.txt.alias("value")).agg(F.count("*").alias("n"))
            r["topValues"] = [{"value": t["value"], "n": t["n"], "share": t["n"] / r["present"]} for t in best.orderBy(F.desc("n"), "value").limit(top).collect()]
        return r

    @staticmethod
    def _histogram(x: Column, rows: DataFrame, r: dict, outside: Column) -> tuple[int, list[dict]]:
        """How many values lie outside, and the bins; the outer ones reach to the least and the greatest value."""
        lo, step, n = facets.histogram_bins(r["numeric"], r["min"], r["max"], r["q1"], r["q3"])
        at = F.least(F.greatest(F.floor((x - lo) / step), F.lit(0)), F.lit(n - 1)) if step > 0 else F.lit(0)
        got = rows.where(x.isNotNull()).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.count_if(outside).alias("out")).collect()
        counts = {c["at"]: c["n"] for c in got}
        edges = [r["min"], *(lo + i * step for i in range(1, n)), r["max"]]
        return sum(c["out"] for c in got), [{"lo": edges[i], "hi": edges[i + 1], "n": counts.get(i, 0)} for i in range(n)]

    # changes: each gives a new engine
    def _changed(self, df: DataFrame) -> Engine:
        out = Engine(df, editable=self.editable)
        out.version = self.version + 1
        return out

    def edit(self, key: int, patch: dict) -> Engine:
        """One row's cells, cast to their columns' types; what can't be cast and unknown columns are left."""
        if not self.editable:
            raise ReadOnly("the source is read-only")
        row, new = F.col(ROW) == int(key), {}
        for c, v in patch.items():
            if c in self.schema:
                own = self.schema[c]
                made = F.lit(None).cast(own.type) if v is None else cast_edit(F.lit(_edit_text(v, own.type)), own.type, own.raw)
                new[c] = F.when(row, made).otherwise(own.raw)
        return self._changed(self.df.withColumns(new))

    def append(self, more: DataFrame) -> Engine:
        """Rows behind the last; absent columns are NULL, further ones are left out."""
        own = [c for c in self.df.columns if c != ROW]
        last = self.df.agg(F.coalesce(F.max(ROW), F.lit(-1))).first()[0] + 1
        fresh = with_row_id(more.select(*[plain(c) for c in more.columns if c in own])).withColumn(ROW, F.col(ROW) + last)
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        fresh = fresh.select(*[plain(c).cast(kinds[c]).alias(c) for c in fresh.columns])
        return self._changed(self.df.unionByName(fresh, allowMissingColumns=True))

    def delete(self, at: list[int]) -> Engine:
        gone = self.df.sparkSession.createDataFrame([(int(p),) for p in set(at)], f"{ROW} long")
        return self._changed(self.df.join(gone, ROW, "left_anti"))

    def replace(self, df: DataFrame) -> Engine:
        """Other data, perhaps of other columns; a view's state is pruned to them by ``LazyView.over``."""
        return self._changed(df)

    def mutate(self, request: dict) -> dict:
        """Answers ``{kind: "update", key, patch}`` with the changed engine, or with the reason why not."""
        if request.get("kind") != "update":
            return {"ok": False, "reason": f"unknown change {request.get('kind')!r}"}
        try:
            return {"ok": True, "engine": self.edit(request["key"], request.get("patch") or {})}
        except ReadOnly as e:
            return {"ok": False, "reason": str(e)}
        except (KeyError, TypeError, ValueError):
            return {"ok": False, "reason": f"no row {request.get('key')!r}"}

    def view(self, state: dict | None = None) -> LazyView:
        return LazyView(self, state or {})


class Pages:
    """A view's rows in ranges of its order, persisted with their places; a window reads the ranges it lies in.

    The rows are sorted once for any number of windows, and no task keeps all rows before a far one.
    """

    def __init__(self, engine: Engine, q: dict):
        by = order(q.get("sort"), engine.schema, F.col(ROW))
        ranged = engine.matching(q).repartitionByRange(*by).sortWithinPartitions(*by)
        at = F.monotonically_increasing_id()
        self.rows = ranged.withColumns({"__range": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}).persist()
        self.columns = [c for c in self.rows.columns if c not in ("__range", "__at")]
        # one row a range
        self.sizes = {r["__range"]: r["n"] for r in self.rows.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()}

    def __len__(self) -> int:
        return sum(self.sizes.values())

    def window(self, start: int, end: int) -> DataFrame:
        """The rows from ``start`` to before ``end`` with their places, ``ord``, in order."""
        at, wanted = 0, []
        for k, n in self.sizes.items():
            if at < end and at + n > start:
                wanted.append((k, at))
            at += n
        place = F.lit(None).cast("long")
        for k, first in wanted:
            place = F.when(F.col("__range") == k, F.col("__at") + first).otherwise(place)
        there = self.rows.where(F.col("__range").isin([k for k, _ in wanted]) if wanted else F.lit(False)).withColumn("ord", place)
        return there.where((F.col("ord") >= start) & (F.col("ord") < end)).select(*map(plain, self.columns), "ord").orderBy("ord")

    def close(self) -> None:
        self.rows.unpersist()


def _edit_text(v, t) -> str:
    """An edit's value as text; values that are no text are read as Python reads them."""
    if isinstance(v, str):
        return v
    if isinstance(t, BooleanType):
        return str(bool(v)).lower()
    if isinstance(t, IntegralType) and isinstance(v, float) and v == v and abs(v) < 2**63:
        v = int(v)
    return v.isoformat() if isinstance(v, dt.date) else str(int(v)) if isinstance(v, bool) and isinstance(t, NumericType) else str(v)


def cast_edit(text: Column, t, otherwise: Column) -> Column:
    """An edit's text as a column's type, or the old value where it can't be that.

    A time is milliseconds since 1970 or ISO text; one with an offset is that moment, shown in the session's zone.
    """
    k, s = kind_of(t), F.lower(F.trim(text))
    if k == "bool":
        return F.when(text.isNotNull(), s.isin("true", "1", "yes", "t")).otherwise(otherwise)
    if k == "datetime":
        number = s.rlike(r"^-?\d+(\.\d+)?([eE][+]?\d+)?$")
        made = F.when(number, F.timestamp_millis(F.round(s.try_cast("double")).cast("long"))).otherwise(F.try_to_timestamp(text))
        return F.coalesce(made.cast(t), otherwise)
    if k == "number":
        return F.coalesce(s.try_cast(t) if isinstance(t, IntegralType) else s.try_cast("double").try_cast(t), otherwise)
    return F.coalesce(text, otherwise).cast(t)


class LazyView:
    """Filters, search and sort over an engine; nothing runs before it is asked for."""

    def __init__(self, engine: Engine, state: dict):
        self.engine, self.state = engine, prune_state(state, engine.schema)

    def over(self, engine: Engine) -> LazyView:
        """The same view of other data; what names absent columns is left out."""
        return LazyView(engine, self.state)

    @property
    def columns(self) -> list[str]:
        return list(self.engine.schema)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __len__(self) -> int:
        return self.engine.count(self.state)

    def frame(self) -> DataFrame:
        return self.engine.ordered(self.state)

    def head(self, n: int = 5) -> DataFrame:
        return self.slice(0, n)

    def slice(self, start: int, end: int) -> DataFrame:
        return self.engine.window({**self.state, "range": {"start": start, "end": end}})

    def positions(self) -> DataFrame:
        return self.engine.positions(self.state)

    def to_pandas(self):
        return self.frame().drop(ROW).toPandas()


__all__ = ["Engine", "LazyView", "ReadOnly", "epoch_ms", "leaf"]
