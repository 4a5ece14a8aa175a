"""Categories as a table: the slots of a one-hot encoding, without a list that the driver or one task holds whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.text import MISSING
from tidewatch.operators.ordering import positions
from tidewatch.session import shared_folder

BROADCAST_ROWS = 100_000  # codes of a column that are sent to every task
HOT_SHARE = 1_000  # a value of more than this part of the rows is hot: fewer than HOT_SHARE a column
SPREAD = 4_096  # keys over which rows that need no further join are laid


def category(column: str) -> Column:
    """The value as text; a null is a category of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) of all columns in one scan, added up in the map tasks."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), category(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, slot, n): 0-based slots in the order of ``columns``, then of the values.

    The table is stored below the shared folder, as long as the columns have values; only the
    number of values of each column reaches the driver.
    """
    spark = train.sparkSession
    counted = _stored(category_counts(train, columns), "category-counts")
    sizes = _sizes(counted, columns)
    starts = [F.lit(x) for i, c in enumerate(columns) for x in (c, sum(sizes[d][0] for d in columns[:i]))]
    if not any(n for n, _ in sizes.values()):
        return spark.createDataFrame([], "feature string, value string, slot bigint, n bigint")
    placed = positions(counted, "value", "value", groups=["feature"], out="__place")
    slot = (F.create_map(*starts)[F.col("feature")] + F.col("__place")).cast("bigint")
    return _stored(placed.select("feature", "value", slot.alias("slot"), "n"), "vocabulary")


def one_hot(df: DataFrame, columns: Sequence[str], known: DataFrame, out: str = "slots") -> DataFrame:
    """Adds ``out``, the row's slots in ``known`` (a ``vocabulary``) in the order of ``columns``.

    A value that ``known`` lacks has no slot, as an all-zero vector has none. The values of
    ``df`` are counted first and looked up once each; rows then meet the codes of a column, which
    are broadcast where few. Of a column with more, the hot values are broadcast and the other
    rows joined by value, so that no value's rows gather in one task.
    """
    codes = category_counts(df, columns).join(known.select("feature", "value", "slot"), ["feature", "value"], "left")
    codes = _stored(codes.select("feature", "value", "slot", "n"), "category-codes")
    sizes = _sizes(codes, columns)
    taken = []
    for i, c in enumerate(columns):
        value, slot = f"__value_{i}", f"__slot_{i}"
        values, rows = sizes[c]
        mine = codes.where(F.col("feature") == c).select(F.col("value").alias(value), F.col("slot").alias(slot), "n")
        df = df.withColumn(value, category(c))
        taken.append(slot)
        if values <= BROADCAST_ROWS:
            df = df.join(F.broadcast(mine.drop("n")), value, "left").drop(value)
            continue
        frequent = F.col("n") > F.lit(rows / HOT_SHARE)
        hot = mine.where(frequent).select(value, F.col(slot).alias("__hot"), F.lit(True).alias("__met"))
        df = df.join(F.broadcast(hot), value, "left")
        # Rows that have met their code take no value with them and are laid over keys that no code has.
        lane = F.when(F.col("__met"), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0).cast("bigint")
        df = df.withColumns({"__lane": lane, value: F.when(F.col("__met"), F.lit("")).otherwise(F.col(value))})
        rare = mine.where(~frequent).select(value, slot, F.lit(0).cast("bigint").alias("__lane"))
        df = df.join(rare, [value, "__lane"], "left").withColumn(slot, F.coalesce(slot, "__hot")).drop(value, "__lane", "__hot", "__met")
    return df.withColumn(out, F.array_compact(F.array(*taken))).drop(*taken)


def _sizes(counted: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Values and rows per column: one row a column."""
    found = {r["feature"]: (r["values"], r["rows"]) for r in counted.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()}
    return {c: found.get(c, (0, 0)) for c in columns}


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
