"""Keyed differences of snapshots, in batch and over a stream of snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from veduta.functions.columns import js_text, plain


def keyed_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change (added, updated, removed) of every key that differs; null keys are none.

    One full join of keys and 128-bit hashes of the rows; the rows themselves stay where they are.
    """
    columns = sorted(c for c in new.columns if c != key)

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = [F.to_json(plain(c)) if isinstance(df.schema[c].dataType, MapType) else plain(c) for c in columns]
        digest = F.struct(*[F.xxhash64(F.lit(seed), *fields, *[f.isNull() for f in fields]) for seed in (0, 1)])
        return df.select(js_text(plain(key), df.schema[key].dataType).alias("key"), digest.alias(name)).where("key IS NOT NULL")

    both = side(old, "was").join(side(new, "now"), "key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated")
    return both.select("key", change.alias("change")).where("change IS NOT NULL")


def follow(stream: DataFrame, table: DataFrame, key: str, apply: Callable[[DataFrame], None], checkpoint: str):
    """Keeps ``table`` up to date with a stream of its rows: each micro-batch is put in by key and handed to ``apply``.

    The last row of a key in a batch counts.  A batch that is handed on twice after a failure gives the same table.
    """
    held = [table]

    def batch(rows: DataFrame, _: int) -> None:
        placed = rows.select(F.struct(*map(plain, table.columns)).alias("__row"), plain(key).alias("__key"), F.monotonically_increasing_id().alias("__at"))
        last = placed.groupBy("__key").agg(F.max_by("__row", "__at").alias("__row"))
        held[0] = upsert(held[0], last.select("__row.*"), key)
        apply(held[0])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``rows`` put in by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)
