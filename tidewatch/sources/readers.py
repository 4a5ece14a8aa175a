"""Reads with a stated schema, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewatch.operators.ordering import positions
from tidewatch.sources.schemas import ALIAS_MOVE, RAW_ENCOUNTER_TEXT


def read_raw_encounters(spark: SparkSession, path: str) -> DataFrame:
    """The raw CSV with every field as text, so a bad value is a finding and not a silent null."""
    return spark.read.schema(RAW_ENCOUNTER_TEXT).option("header", True).option("nullValue", "?").csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A table scan; a missing path raises ``AnalysisException``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, *, partition_column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """A database table read in parallel slices of one column, with filters pushed down."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", str(partitions))
    )
    return reader.options(**options).load()


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "frame") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df


def read_labelled(spark: SparkSession, path: str, schema: StructType, target: str) -> DataFrame:
    """An evaluation table, refused when its label column is absent."""
    return require_columns(read_table(spark, path, schema), [target], path)


def read_page(df: DataFrame, order: Sequence[str], offset: int, count: int) -> DataFrame:
    """Rows ``offset`` to ``offset + count`` in the order of the first column, ties by the others; the page itself is in order.

    Rows are placed by global positions, so a late page costs what an early one does and no task
    sorts the rows before it.
    """
    main, *ties = order
    placed = df.withColumn("__tie", F.struct(*ties)) if len(ties) > 1 else df
    tie = "__tie" if len(ties) > 1 else (ties[0] if ties else main)
    placed = positions(placed, main, tie, out="__place").where((F.col("__place") >= offset) & (F.col("__place") < offset + count))
    return placed.orderBy("__place").select(*df.columns)


def read_alias_log(spark: SparkSession, path: str) -> DataFrame:
    """The alias-move log (JSON lines); an absent log is an empty one."""
    try:
        return spark.read.schema(ALIAS_MOVE).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ALIAS_MOVE)


def stream_table(spark: SparkSession, folder: str, schema: StructType, file_glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(folder)


def as_utc_timestamps(df: DataFrame) -> DataFrame:
    """Casts zone-less timestamps to instants, which watermarks require."""
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
