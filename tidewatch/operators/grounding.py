"""Does a text quote only figures and dates it was given?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.text import STORED_DATE_PATTERN, dates, figure_decimals, figure_value, figures


def quoted_figures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, written, value, decimals, percent), one row per quantity in the whole text."""
    written = df.select(key, F.posexplode(figures(text)).alias("place", "written"))
    return written.select(
        key, "place", "written", figure_value(F.col("written")).alias("value"), figure_decimals(F.col("written")).alias("decimals"),
        F.col("written").endswith("%").alias("percent"),
    )


def quoted_dates(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(dates(text)).alias("place", "written"))


def numeric_leaves(df: DataFrame, key: str, numbers: Sequence[Column], arrays: Sequence[Column] = (), own_text: str | None = None) -> DataFrame:
    """(key, number): the figures a record states, its list lengths and those of its own sentence."""
    leaves = F.array_compact(F.array(*[n.cast("double") for n in numbers], *[F.size(a).cast("double") for a in arrays]))
    if own_text is not None:
        plain = F.filter(figures(own_text), lambda w: ~w.endswith("%"))
        leaves = F.concat(leaves, F.coalesce(F.transform(plain, figure_value), F.array().cast("array<double>")))
    return df.select(key, F.explode(F.array_distinct(leaves)).alias("number"))


def stored_dates(df: DataFrame, key: str, texts: Sequence[Column]) -> DataFrame:
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(t.cast("string"), F.lit("")), F.lit(STORED_DATE_PATTERN), F.lit(1)) for t in texts]))
    return df.select(key, F.explode(F.array_distinct(found)).alias("day"))


def _as_written(number: Column, decimals: Column) -> Column:
    """The number as text to that many places, rounded on its exact value; no negative zero."""
    pattern = F.when(decimals == 0, F.lit("0")).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), decimals)))
    return F.regexp_replace(F.call_function("format_number", number, pattern), r"^-(0(?:\.0*)?)$", "$1")


def ungrounded_figures(quoted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Quoted figures no known number rounds to, at the precision written or as a percentage.

    Known numbers are rounded once per precision their text uses and matched by equality, so
    quoted and known figures of a key are never paired all against all.
    """
    precisions = quoted.select(key, "decimals", "percent").distinct()
    shown = F.col("number") * F.when(F.col("percent"), F.lit(100.0)).otherwise(F.lit(1.0))
    offered = known.join(precisions, key).select(key, "decimals", "percent", _as_written(shown, F.col("decimals")).alias("shown")).distinct()
    asked = quoted.withColumn("shown", _as_written(F.col("value"), F.col("decimals")))
    return asked.join(offered, [key, "decimals", "percent", "shown"], "left_anti").drop("shown")


def grounding_report(df: DataFrame, key: str, text: str, known: DataFrame, known_dates: DataFrame | None = None) -> DataFrame:
    """One row per text: figures and dates checked, and how many of each are not known."""
    quoted = quoted_figures(df, key, text)
    said = quoted_dates(df, key, text)
    loose = ungrounded_figures(quoted, known, key)
    days = said.withColumnRenamed("written", "day")
    wrong = days if known_dates is None else days.join(known_dates, [key, "day"], "left_anti")

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    out = df.select(key, (F.length(F.trim(F.coalesce(text, F.lit("")))) == 0).alias("empty"))
    for rows, name in ((quoted, "numbers"), (loose, "ungrounded_numbers"), (said, "dates"), (wrong, "ungrounded_dates")):
        out = out.join(count(rows, name), key, "left")
    names = ["numbers", "ungrounded_numbers", "dates", "ungrounded_dates"]
    out = out.na.fill(0, subset=names)
    return out.withColumn("grounded", ~F.col("empty") & (F.col("ungrounded_numbers") == 0) & (F.col("ungrounded_dates") == 0)).drop("empty")


def faithfulness(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("texts"), F.avg(F.col("grounded").cast("double")).alias("faithfulness_rate"))
