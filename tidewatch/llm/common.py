"""Helpers that the text operators share: written intermediates, column hygiene, checked broadcasts."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.session import shared_folder

BROADCAST_ROWS = 100_000
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MARKS = 1 << 23  # bits of the filter that picks rows by key before a join
MARKS_IN_BLOCK = 1 << 15  # bits of one of Spark's bitmaps
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class Scope:
    """Owner of the tables that ``written`` makes while it is entered, so that its caller can give them up together.

    Leaving the block deletes nothing, as a lazy result may still read the tables; ``close`` does,
    once every result that reads them is stored. Tables of other operators and callers are not touched.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self._token = _OWNER.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _OWNER.reset(self._token)

    def close(self) -> None:
        while self.paths:
            _delete(self.spark, self.paths.pop())


_OWNER: ContextVar[Scope | None] = ContextVar("owner", default=None)
_writers, _writing = 0, threading.Lock()


class _ShufflesDropped:
    """Shuffle files of the writes inside are given up at once; the session's own setting comes back with the last writer."""

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        global _writers, _before
        with _writing:
            if _writers == 0:
                _before = self.conf.get(DROP_SHUFFLES, None)
                self.conf.set(DROP_SHUFFLES, "true")
            _writers += 1

    def __exit__(self, *_: object) -> None:
        global _writers
        with _writing:
            _writers -= 1
            if _writers == 0:
                self.conf.unset(DROP_SHUFFLES) if _before is None else self.conf.set(DROP_SHUFFLES, _before)


def written(df: DataFrame, purpose: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later steps read it, a lost executor loses nothing.

    The table belongs to the ``Scope`` entered, if any, and is given up early with ``given_up``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    if _OWNER.get() is not None:
        _OWNER.get().paths.append(path)
    with _ShufflesDropped(spark):
        writer = df.write.option("compression", "zstd")
        parts = list(partition_by)
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
    stored.__dict__["_stored_at"] = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def given_up(*tables: DataFrame) -> None:
    """Deletes frames that ``written`` returned, when nothing still to be run reads them."""
    for table in tables:
        _delete(table.sparkSession, table.__dict__["_stored_at"])


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops input columns whose names (case aside) an operator is about to use."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def small_or_salted(left: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "left", salts: int = 32) -> DataFrame:
    """Joins a table of few rows per key to a large one whose keys may be hot.

    ``rows`` is the counted size of ``small``. Up to BROADCAST_ROWS it is broadcast; beyond, the
    large side's keys are salted and the small side repeated, so a hot key spreads over ``salts`` tasks.
    Null keys match null keys.
    """
    if rows <= BROADCAST_ROWS:
        on = [left[k].eqNullSafe(small[k]) for k in keys]
        condition = on[0]
        for other in on[1:]:
            condition = condition & other
        joined = left.join(F.broadcast(small), condition, how)
        for k in keys:
            joined = joined.drop(small[k])
        return joined
    plain = [F.col(f"`{c}`") for c, kind in left.dtypes if not kind.startswith(("map", "struct", "array", "variant"))]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = (salted["__salt"] == repeated["__salt"])
    for k in keys:
        on = on & salted[k].eqNullSafe(repeated[k])
    joined = salted.join(repeated, on, how)
    for k in [*keys, "__salt"]:
        joined = joined.drop(repeated[k])
    return joined.drop("__salt")


def with_fields(fields: Iterable[T.StructField], more: str) -> T.StructType:
    """A schema of ``fields`` and of those that the DDL string ``more`` names."""
    return T.StructType([*fields, *T._parse_datatype_string(more).fields])


def packed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` beside the whole row as one struct, so that an operator's outputs can't clash with the row's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *columns)


def marks_of(wanted: DataFrame, key: str) -> np.ndarray:
    """Packed bits: bit ``hash(key) mod MARKS`` is set if ``wanted`` holds the key.

    The tasks set the bits; what reaches the driver are blocks of them, one row each, MARKS bits in all however many keys there are.
    """
    found = wanted.where(F.col(key).isNotNull()).select(mark(key).alias("m")).distinct()
    bits = F.bitmap_construct_agg((F.col("m") % MARKS_IN_BLOCK).cast("bigint"))
    marks = np.zeros((MARKS // MARKS_IN_BLOCK, MARKS_IN_BLOCK // 8), np.uint8)
    for block, packed_bits in found.groupBy(F.expr(f"m div {MARKS_IN_BLOCK}")).agg(bits).collect():
        marks[block] = np.frombuffer(packed_bits, np.uint8)
    return marks.ravel()


def mark(key: str) -> Column:
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(MARKS))).cast("int")


def marked(rows: DataFrame, key: str, marks: np.ndarray, hit: bool = True) -> DataFrame:
    """The rows whose key's bit is set (a superset of the keys sought), or with ``hit`` false all others."""
    sent = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chosen(batches, sent.value, hit)

    return rows.withColumn("__mark", mark(key)).mapInArrow(run, rows.schema)


def chosen(batches: Iterator[pa.RecordBatch], marks: np.ndarray, hit: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is ``mark``, without it and cut to the rows that ``marked`` keeps."""
    for batch in batches:
        m = batch.column(batch.num_columns - 1).fill_null(-1).to_numpy(zero_copy_only=False)
        found = batch.filter(pa.array(((m >= 0) & ((marks[m >> 3] >> (m & 7)) & 1 == 1)) == hit))
        yield pa.RecordBatch.from_arrays(found.columns[:-1], schema=pa.schema(list(found.schema)[:-1]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
