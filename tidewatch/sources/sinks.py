"""Append-only writes, made repeatable by anti-joins on each table's natural key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Natural keys of the append-only tables.
EVENT_KEY = ("scenario", "window_start")
CARD_KEY = ("drift_event_id", "policy_version")
RUN_KEY = ("card_id", "mode", "challenger_version")
APPROVAL_KEY = ("kind", "subject")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def unwritten(new: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows of ``new`` whose key is not stored; one per key, the first in ``order``.

    Keys may hold nulls, which equal each other here. Without an order repeats of a row are one,
    and a key that comes with different rows is refused: the write fails, nothing is picked.
    """
    existing = stored.select(*keys).distinct()
    fresh = new.join(existing, null_safe(new, existing, keys), "left_anti")
    rest = [c for c in new.columns if c not in keys]
    if not order:
        row = F.struct(*rest) if rest else F.struct(F.lit(0))
        content = F.xxhash64(F.to_json(row))
        one = fresh.groupBy(*keys).agg(F.first(row).alias("__row"), (F.min(content) == F.max(content)).alias("__same"))
        clash = F.concat(F.lit("different rows share the key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
        one = one.where(F.when(F.col("__same"), F.lit(True)).otherwise(F.raise_error(clash).cast("boolean")))
        return one.select(*keys, "__row.*").select(*new.columns) if rest else one.select(*keys)
    ranked = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return ranked.select(*keys, "__row.*").select(*new.columns)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``; one that does not exist yet is empty."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], like.schema)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_once(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Appends rows whose key is not on record; a stored row always wins."""
    append(unwritten(new, stored(new.sparkSession, path, new), keys, order), path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch in a folder of its own: written again it replaces itself.

    Nothing on record is read, so the cost of a batch does not grow with the history. The
    folder reads back as one table with a ``batch_id`` column.
    """
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def split_decisions(new: DataFrame, stored: DataFrame, keys: Sequence[str] = APPROVAL_KEY) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a second human decision on a subject is refused, never merged.

    Within the batch the earliest decision stands. Refused rows come once each with the
    number of ``copies`` refused, so repeats of one subject never meet in a single task.
    """
    rows = new.groupBy(*new.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(*[F.col(c) for c in ("ts", "approval_id")], *[F.col(c) for c in new.columns if c not in ("ts", "approval_id")])
    earliest = new.groupBy(*keys).agg(F.min(order).alias("__first"))
    known = stored.select(*keys).distinct().withColumn("__known", F.lit(True))
    marked = rows.join(earliest, list(keys)).join(known, list(keys), "left")
    stands = F.col("__known").isNull() & order.eqNullSafe(F.col("__first"))
    reason = F.format_string("%s: a %s decision is on record", F.col("subject"), F.lower(F.col("kind")))
    left_over = F.col("copies") - F.when(stands, F.lit(1)).otherwise(F.lit(0))
    return (
        marked.where(stands).select(*new.columns),
        marked.withColumn("copies", left_over).where("copies > 0").select(*new.columns, "copies", reason.alias("refusal")),
    )


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object per row, keys in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and an order-free sum of row hashes per table."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")).cast("string").alias("content"),
        ).select(F.lit(name).alias("table_name"), "rows", "content")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reconcile(left: DataFrame, right: DataFrame, compare: Sequence[str] = ("rows",)) -> DataFrame:
    """Tables whose counts (or fingerprints) differ between two copies, absent ones included."""
    a = left.select("table_name", *[F.col(c).alias(f"{c}_a") for c in compare])
    b = right.select("table_name", *[F.col(c).alias(f"{c}_b") for c in compare])
    both = a.join(b, "table_name", "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in compare])
    return both.withColumn("same", same)
