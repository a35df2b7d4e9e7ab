"""Sources, row identity and the columnar sinks."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veduta.functions.columns import iso_text, js_text, kind_of, plain

ROW = "__row_id__"
#: Rows from which a table is answered window by window instead of being sent whole.
WINDOWED_FROM = 100_000
#: Files whose first row numbers are broadcast, 16 bytes each; those of more meet the rows by a join.
MOST_FILES = 2_000_000
_NARROW = {"Project", "SubqueryAlias", "LocalRelation", "LogicalRDD", "Range", "Filter"}


def load(spark: SparkSession, source=None, table: str | None = None, sql: str | None = None) -> DataFrame:
    """A DataFrame of whatever is given: a DataFrame, a pandas, Arrow or Polars table, a Parquet path, a table or a query."""
    if sum(x is not None for x in (source, table, sql)) != 1:
        raise ValueError("give one of source, table and sql")
    if table is not None:
        return spark.table(".".join("`" + p.replace("`", "``") + "`" for p in table.split(".")))
    if sql is not None:
        return spark.sql(sql.strip().rstrip(";"))
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return spark.read.parquet(source)
    return spark.createDataFrame(source.to_arrow() if hasattr(source, "to_arrow") else source)


def windowed(df: DataFrame, force: bool | None = None, least: int = WINDOWED_FROM) -> bool:
    """Whether a table is to be answered window by window; no more than ``least`` rows are counted."""
    return bool(force) if force is not None else df.limit(least).count() >= least


def _nodes(df: DataFrame) -> list:
    """The analysed plan's nodes from the top down, as far as each has one child."""
    plan, out = df._jdf.queryExecution().analyzed(), []
    while True:
        out.append(plan)
        below = plan.children()
        if below.size() != 1:
            return out
        plan = below.head()


def _of_parquet(nodes: list) -> bool:
    *above, last = nodes
    if last.getClass().getSimpleName() != "LogicalRelation" or any(x.getClass().getSimpleName() not in ("Project", "SubqueryAlias") for x in above):
        return False
    relation = last.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def with_row_id(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Adds the row's position, in the JVM alone.

    Of one Parquet file that is the row's index in it, which the scan gives; of several, that plus the rows of the
    files before it, by path.  Other tables are numbered partition by partition, or by ``order_by`` where that is given;
    unless their partitions are fixed already, they are persisted first, as both steps must see the same ones.
    """
    if ROW in df.columns:
        return df
    nodes = _nodes(df)
    if not order_by and _of_parquet(nodes):
        meta = df.metadataColumn("_metadata")
        files = df.inputFiles()
        if len(files) <= 1:
            return df.withColumn(ROW, meta["row_index"])
        key = F.xxhash64(meta["file_path"])
        sizes = df.groupBy(meta["file_path"].alias("path")).agg(F.count("*").alias("n"))
        before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
        starts = sizes.select(F.xxhash64("path").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
        placed = df.withColumns({"__at": meta["row_index"], "__of": key})
        both = placed.join(F.broadcast(starts) if len(files) <= MOST_FILES else starts, F.col("__of") == F.col("__file"))
        return both.select(*map(plain, df.columns), (F.col("__start") + F.col("__at")).alias(ROW))
    held = None
    if order_by:
        df = held = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).persist()
    elif any(x.getClass().getSimpleName() not in _NARROW for x in nodes):
        df = held = df.persist()
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    out = marked.join(F.broadcast(starts), part == F.col("__part")).select(*map(plain, df.columns), (F.col("__start") + within).alias(ROW))
    out.held = held  # what to let go of when the numbered table is no longer wanted
    return out


def cleaned(v, whole: bool = False):
    """A JSON-safe value: NaN and infinities are null and, if ``whole``, 2.0 is 2."""
    if isinstance(v, float):
        return None if not math.isfinite(v) else int(v) if whole and v == int(v) else v
    if isinstance(v, (list, tuple)):
        return [cleaned(x, whole) for x in v]
    return {k: cleaned(x, whole) for k, x in v.items()} if isinstance(v, dict) else v


def columnar(df: DataFrame, keys: list | None = None, whole: bool = False) -> dict[str, list]:
    """Column-major, JSON-safe values of a bounded result; dates are ISO text.  ``keys`` are put in as row ids."""
    shown = df.select(*[(iso_text(plain(f.name)) if kind_of(f.dataType) == "datetime" else plain(f.name)).alias(f.name) for f in df.schema.fields])
    out = {k: [cleaned(x, whole) for x in v] for k, v in shown.toArrow().to_pydict().items()}
    return out if keys is None else {ROW: [str(k) for k in keys]} | out


def bridge(df: DataFrame, keys: list, read_only: tuple[str, ...] = ()) -> dict:
    """What a host page takes: column definitions, the name of the row key and the columnar values; a key for each row."""
    values = columnar(df.drop(ROW))
    n = len(next(iter(values.values()), keys))
    if len(keys) != n:
        raise ValueError(f"{len(keys)} keys for {n} rows")
    if len(set(map(str, keys))) < len(keys):
        raise ValueError("row keys must differ")
    return {"columns": column_definitions(df, read_only), "rowKey": ROW, "columnar": {ROW: [str(k) for k in keys]} | values}


def column_definitions(df: DataFrame, read_only: tuple[str, ...] = (), overlay: dict[str, dict] | None = None) -> list[dict]:
    names = {"bool": "boolean", "number": "number", "datetime": "date", "text": "text"}
    for field in overlay or {}:
        if field not in df.columns:
            warnings.warn(f"no column {field!r}", stacklevel=2)
    return [{"field": f.name, "title": f.name, "type": names[kind_of(f.dataType)], "edit": f.name not in read_only} | (overlay or {}).get(f.name, {}) for f in df.schema.fields if f.name != ROW]


def key_texts(df: DataFrame, key: str) -> DataFrame:
    """The text of a key column, by which rows are known; repeated keys are an error."""
    keys = df.select(js_text(plain(key), df.schema[key].dataType).alias("key"))
    twice = keys.groupBy("key").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {key!r} isn't unique: {twice[0]['key']!r} stands in {twice[0]['count']} rows")
    return keys
