"""Exact quantiles of a column by ranks: no task ever holds more than a bounded piece of it.

An approximate quantile on either side encloses each wanted rank; the rows between are counted.  Few enough are
fetched and the rank read off; a larger enclosure is narrowed again by its own approximate quantiles.

The ranks of large groups are searched together: rows are counted by group and bin, first of a logarithmic scale, then
of equal parts of the bins that hold a rank, until such a bin holds a single value.  Counts are all that is shuffled.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veduta.functions.columns import plain

#: Values that are fetched for one rank.
FETCHED = 200_000
_ACCURACY = 10_000
#: Values of a group that one buffer may hold; of a larger group the ranks are searched.
HELD = 200_000
#: Groups that are all searched if one has to be; of more, only those over ``HELD``.
MOST_GROUPS = 1_000
#: Bins of an octave, and of a narrower span.
_OCTAVE, _BINS = 64, 65_536


def ranked(rows: DataFrame, x: Column, ranks: list[int], n: int, fetched: int = FETCHED) -> dict[int, float]:
    """The values at the given places (from 0) of the ascending order of the ``n`` rows where ``x`` is not null."""
    values = rows.select(x.cast("double").alias("x")).where("x IS NOT NULL")
    # rank -> (lowest value, highest value, rows below the lowest, rows between)
    around = dict.fromkeys(ranks, (None, None, 0, n))
    done: dict[int, float] = {}
    while open_ := [r for r in ranks if r not in done and around[r][3] > fetched]:
        marks: dict = {}
        for r in open_:
            lo, hi, below, size = around[r]
            p, off = (r - below) / max(1, size - 1), 2 / _ACCURACY
            marks.setdefault((lo, hi), set()).update((max(0.0, p - off), min(1.0, p + off)))
        spans = {k: sorted(v) for k, v in marks.items()}
        got = values.agg(*[F.percentile_approx(_inside(F.col("x"), *k), ps, _ACCURACY) for k, ps in spans.items()]).first()
        found = {k: dict(zip(ps, got[i], strict=True)) for i, (k, ps) in enumerate(spans.items())}
        pieces = {}
        for r in open_:
            lo, hi, below, size = around[r]
            p, off, own = (r - below) / max(1, size - 1), 2 / _ACCURACY, found[lo, hi]
            pieces[r] = own[max(0.0, p - off)], own[min(1.0, p + off)]
        each = sorted(set(pieces.values()))
        c = F.col("x")
        counts = values.agg(*[y for a, b in each for y in (F.count_if(c < a), F.count_if(c == a), F.count_if(c.between(a, b)), F.count_if(c == b))]).first()
        counted = {k: tuple(counts[4 * i : 4 * i + 4]) for i, k in enumerate(each)}
        for r in open_:
            a, b = pieces[r]
            below, at_a, size, at_b = counted[a, b]
            if below <= r < below + at_a:
                done[r] = a
            elif below + size - at_b <= r < below + size:
                done[r] = b
            elif below <= r < below + size:
                around[r] = (a, b, below, size)
            else:  # the sketch was off by more than it says
                lo, hi, old, between = around[r]
                around[r] = (b, hi, below + size - at_b, between - (below + size - at_b - old)) if r >= below + size else (lo, a, old, below + at_a - old)
    spans = sorted({around[r][:2] for r in ranks if r not in done}, key=str)
    if spans:
        got = values.agg(*[F.sort_array(F.collect_list(_inside(F.col("x"), *k))) for k in spans]).first()
        held = dict(zip(spans, got, strict=True))
        done |= {r: held[around[r][:2]][r - around[r][2]] for r in ranks if r not in done}
    return done


def _inside(x: Column, lo: float | None, hi: float | None) -> Column:
    return x if lo is None and hi is None else F.when((x >= lo if lo is not None else F.lit(True)) & (x <= hi if hi is not None else F.lit(True)), x)


def quantiles(rows: DataFrame, x: Column, levels: list[float], n: int | None = None) -> list[float | None]:
    """Linearly interpolated quantiles; None of no rows."""
    n = rows.agg(F.count(x)).first()[0] if n is None else n
    if not n:
        return [None] * len(levels)
    at = [(n - 1) * p for p in levels]
    got = ranked(rows, x, sorted({f(h) for h in at for f in (math.floor, math.ceil)}), n)
    return [got[math.floor(h)] + (h - math.floor(h)) * (got[math.ceil(h)] - got[math.floor(h)]) for h in at]


def of_groups(rows: DataFrame, names: list[str], xs: list[tuple[Column, list[float]]], rolled: bool, held: int = HELD, most: int = MOST_GROUPS) -> tuple[DataFrame, bool] | None:
    """Quantiles of groups by ``names``, of every prefix and the grand row too if ``rolled``; each of ``xs`` is values and levels.

    Gives ``__level`` (how many names are set), the names and an array ``__q0``.. for each of ``xs``, and whether that
    is small enough to broadcast; None if one buffer can hold any group.  The groups are counted and the ranks found
    at once.
    """
    m, kinds = len(names), {n: rows.schema[n].dataType for n in names}
    # Zero has one sign, as bins and their ends are compared by value.
    values = rows.select(*map(plain, names), *[(x.cast("double") + F.lit(0.0)).alias(f"__x{i}") for i, (x, _) in enumerate(xs)])
    level = F.lit(m) - reduce(operator.add, [F.grouping(plain(n)).cast("int") for n in names]) if rolled else F.lit(m)
    sizes = (values.rollup if rolled else values.groupBy)(*map(plain, names)).agg(level.alias("__level"), *[F.count(f"__x{i}").alias(f"__n{i}") for i in range(len(xs))])
    chosen = sizes.limit(most + 1).collect()
    whole = len(chosen) <= most
    if not whole:
        chosen = sizes.where(reduce(operator.or_, [F.col(f"__n{i}") > held for i in range(len(xs))])).collect()
    if all(r[f"__n{i}"] <= held for r in chosen for i in range(len(xs))):
        return None

    path = lambda r, k: (k, repr([r[n] for n in names[:k]]))
    index = {path(r, r["__level"]): g for g, r in enumerate(chosen)}
    # A row belongs to the innermost chosen group that holds it; what holds a large group is itself large.
    levels = [m] if whole or not rolled else sorted({r["__level"] for r in chosen} - {0})
    tagged = values
    for k in levels:
        own = [(g, *[r[n] for n in names[:k]]) for g, r in enumerate(chosen) if r["__level"] == k]
        like = [T.StructField(f"__k{i}", kinds[n]) for i, n in enumerate(names[:k])]
        there = rows.sparkSession.createDataFrame(own, T.StructType([T.StructField(f"__g{k}", T.IntegerType()), *like]))
        same = reduce(operator.and_, [plain(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names[:k])])
        tagged = tagged.join(F.broadcast(there), same, "left").drop(*[f.name for f in like])
    grand = index.get(path(None, 0)) if rolled else None
    inner = F.coalesce(*[F.col(f"__g{k}") for k in reversed(levels)], F.lit(grand).cast("int"))
    kin = [(g, index[path(r, k)]) for g, r in enumerate(chosen) for k in (range(r["__level"] + 1) if rolled else [m])]

    answers: list[list] = []
    for i, (_, wanted) in enumerate(xs):
        at = {g: [(r[f"__n{i}"] - 1) * p for p in wanted] for g, r in enumerate(chosen) if r[f"__n{i}"]}
        ranks = sorted({(g, f(h)) for g, own in at.items() for h in own for f in (math.floor, math.ceil)})
        got = _searched(tagged.select(inner.alias("g"), F.col(f"__x{i}").alias("x")).where("g IS NOT NULL AND x IS NOT NULL"), kin, ranks)
        answers.append([[_interpolated(got[g, math.floor(h)], got[g, math.ceil(h)], h) for h in at[g]] if g in at else None for g in range(len(chosen))])
    arrays = [T.StructField(f"__q{i}", T.ArrayType(T.DoubleType())) for i in range(len(xs))]
    schema = T.StructType([T.StructField("__level", T.IntegerType()), *[T.StructField(n, kinds[n]) for n in names], *arrays])
    known = [(r["__level"], *[r[n] for n in names], *[a[g] for a in answers]) for g, r in enumerate(chosen)]
    large = rows.sparkSession.createDataFrame(known, schema)
    if whole:
        return large, True
    first = F.coalesce(*[F.when(F.col(f"__g{k}").isNotNull(), k + 1) for k in reversed(levels)], F.lit(m if not rolled else 0 if grand is None else 1))
    rest = tagged.withColumn("__first", first).where(F.col("__first") <= m).withColumn("__level", F.explode(F.sequence("__first", F.lit(m))))
    rest = rest.select("__level", *[F.when(F.col("__level") > i, plain(n)).alias(n) for i, n in enumerate(names)], *[f"__x{i}" for i in range(len(xs))])
    held_ = rest.groupBy("__level", *map(plain, names)).agg(*[F.percentile(f"__x{i}", F.array(*map(F.lit, wanted))).alias(f"__q{i}") for i, (_, wanted) in enumerate(xs)])
    return held_.unionByName(large), False


def _searched(values: DataFrame, kin: list[tuple[int, int]], ranks: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values at ranks (group, place from 0) of the rows ``g, x``; ``kin`` pairs a row's group with each that holds it."""
    spark, x = values.sparkSession, F.col("x")
    parts: dict[int, list[int]] = {}
    for g, holder in kin:
        parts.setdefault(holder, []).append(g)
    counts = F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    binned = values.groupBy("g", _octaves(x).alias("bin")).agg(*counts)
    binned = binned.join(F.broadcast(spark.createDataFrame(kin, "g int, span int")), "g")
    binned = binned.groupBy("span", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # rank -> (least value, greatest value, rows of that span before it)
    around = _bins_of(binned, [(g, t, r) for t, (g, r) in enumerate(ranks)])
    while open_ := [t for t, (lo, hi, _) in around.items() if lo < hi]:
        spans = {k: i for i, k in enumerate(sorted({(ranks[t][0], *around[t][:2]) for t in open_}))}
        pieces = spark.createDataFrame([(g, i, lo, hi) for (holder, lo, hi), i in spans.items() for g in parts[holder]], "of int, span int, a double, b double")
        near = values.where(x.between(min(k[1] for k in spans), max(k[2] for k in spans)))
        near = near.join(F.broadcast(pieces), (F.col("g") == F.col("of")) & x.between(F.col("a"), F.col("b")))
        # The least value of a span is in its first bin and the greatest in its last, so every pass narrows.
        place = F.least(F.floor((x - F.col("a")) / (F.col("b") - F.col("a")) * _BINS), F.lit(_BINS - 1))
        around |= _bins_of(near.groupBy("span", place.alias("bin")).agg(*counts), [(spans[ranks[t][0], *around[t][:2]], t, around[t][2]) for t in open_])
    return {k: around[t][0] for t, k in enumerate(ranks)}


def _bins_of(binned: DataFrame, wanted: list[tuple[int, int, int]]) -> dict[int, tuple[float, float, int]]:
    """For each wanted (span, number, place) the ends of the bin that holds it, and its place there."""
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = binned.sparkSession.createDataFrame(wanted, "of int, number int, place long")
    holds = (F.col("span") == F.col("of")) & (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
    got = binned.withColumn("upto", upto).join(F.broadcast(ranks), holds).select("number", "lo", "hi", (F.col("place") - F.col("upto") + F.col("n")).alias("place"))
    return {r["number"]: (r["lo"], r["hi"], r["place"]) for r in got.collect()}


def _octaves(x: Column) -> Column:
    """A bin that never falls as ``x`` rises; an infinity has one of its own."""
    size = F.abs(x)
    of_size = F.when(size == float("inf"), 4096 * _OCTAVE).otherwise(F.floor((F.log2(size) + 1100) * _OCTAVE))
    return F.when(x == 0, 0).when(x < 0, -of_size).otherwise(of_size)


def _interpolated(low: float, high: float, h: float) -> float:
    """The value at place ``h`` between those at the whole places around it, as ``percentile`` has it."""
    return low if low == high else (math.ceil(h) - h) * low + (h - math.floor(h)) * high
