"""Lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; 128 bits of it stand for it.

1. Documents come in batches. A batch's keys are counted (in how many of its documents each occurs), merge-
   anti-joined with the keys that runs on record already prove frequent, and what is left becomes a sorted run
   of level 0.
2. A level that holds ``fanout`` runs is compacted: its runs are merged, counts of equal keys added, into one
   run of the next level. So a key is rewritten once a level, and n batches leave at most fanout * log(n) runs.
3. A level is a table bucketed by hash, a run one sorted file in each of its buckets; all levels share the
   number of buckets, so merging runs or joining a batch to them shuffles no run again.
4. When all batches are in, the levels are merged downwards into one: keys found in ``least`` documents or more
   are frequent. Their places in each different text are looked up, and a text keeps its other lines.

Defined cases: lines end at \\n only; a null or empty text is one empty line; an empty key is never frequent;
each row is a document, so repeated rows count as often as they occur, with or without an id; a key that occurs
twice in a document counts once; a text whose lines all go keeps the empty text; an empty table gives an empty
result; input columns may have any names, as results are kept beside the whole row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import _delete, documents, packed, small_or_salted, written
from tidewatch.llm.registry import query
from tidewatch.session import shared_folder

LEAST, BATCHES, FANOUT = 10, 8, 4
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_PLACES = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashes(value: Column) -> tuple[Column, Column]:
    """128 bits of a text, as two numbers."""
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def key_counts(docs: DataFrame, text: str, *by: str) -> DataFrame:
    """(by, h, g, docs): the number of documents that hold each non-empty line key."""
    h, g = hashes(F.col("key"))
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), line_key))
    held = docs.select(*by, F.explode(keys).alias("key")).where("key <> ''").select(*by, h.alias("h"), g.alias("g"))
    return held.groupBy(*by, "h", "g").agg(F.count(F.lit(1)).alias("docs"))


class LineRuns:
    """Levelled runs of (h, g, docs). A level is a table bucketed by hash; a run adds one sorted file to each bucket."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, str] | None] = []  # table and path
        self.runs: list[int] = []

    def _append(self, level: int, counts: DataFrame) -> None:
        """A new run. One task writes one bucket, so a run is one file in order per bucket."""
        if level == len(self.levels):
            self.levels.append(None)
            self.runs.append(0)
        if self.levels[level] is None:
            self.levels[level] = (f"line_runs_{uuid.uuid4().hex}", shared_folder(self.spark, "line-runs"))
        name, path = self.levels[level]
        dealt = counts.select("h", "g", "docs").repartition(self.buckets, "h")
        writer = dealt.write.mode("append").format("parquet").option("compression", "zstd").option("path", path)
        writer.bucketBy(self.buckets, "h").sortBy("h", "g").saveAsTable(name)
        self.runs[level] += 1

    def _merged(self, level: int) -> DataFrame:
        """The level's runs as one: equal keys lie in the same bucket, so nothing is shuffled."""
        return self.spark.table(self.levels[level][0]).groupBy("h", "g").agg(F.sum("docs").alias("docs"))

    def _clear(self, level: int) -> None:
        name, path = self.levels[level]
        self.spark.sql(f"DROP TABLE {name}")
        _delete(self.spark, path)
        self.levels[level], self.runs[level] = None, 0

    def _push(self, level: int) -> None:
        self._append(level + 1, self._merged(level))
        self._clear(level)

    def add(self, counts: DataFrame) -> None:
        """Takes in a batch's (h, g, docs): keys that a level proves frequent need no more counting."""
        for level in (held for held in self.levels if held is not None):
            proven = self.spark.table(level[0]).where(F.col("docs") >= self.least).select("h", "g")
            counts = counts.join(proven.hint("merge"), ["h", "g"], "left_anti")
        self._append(0, counts)
        level = 0
        while self.runs[level] >= self.fanout:
            self._push(level)
            level += 1

    def frequent(self) -> DataFrame:
        """(h, g) of the keys found in ``least`` documents or more, as a written table. All levels become one run."""
        if not self.levels:
            return written(self.spark.createDataFrame([], "h bigint, g bigint"), "frequent-lines")
        for level in range(len(self.levels) - 1):
            if self.levels[level] is not None:
                self._push(level)
        found = self._merged(len(self.levels) - 1).where(F.col("docs") >= self.least)
        return written(found.select("h", "g"), "frequent-lines")

    def close(self) -> None:
        for level, held in enumerate(self.levels):
            if held is not None:
                self._clear(level)


def frequent_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h, g) of the frequent line keys of a table taken in as ``batches`` batches."""
    batch = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.length(f"`{text}`")), F.lit(batches)).cast("int")
    plain = docs.select(F.col(f"`{text}`").cast("string").alias("text"), batch.alias("batch"))
    staged = written(key_counts(plain, "text", "batch"), "line-batches", partition_by=["batch"])
    runs = LineRuns(docs.sparkSession, least, fanout)
    try:
        for b in range(batches):
            runs.add(staged.where(F.col("batch") == b).select("h", "g", "docs"))
        return runs.frequent()
    finally:
        runs.close()


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(__row, n_lines, n_dropped, kept): each row without its lines whose key is in ``frequent`` (h, g)."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = packed(docs, F.col(f"`{key}`").alias("id"), value.alias("t"))
    a, b = hashes(F.col("t"))
    rows = rows.withColumns({"a": a, "b": b})
    h, g = hashes(line_key(F.col("line")))
    places = rows.select("a", "b", F.posexplode(lines_of(F.col("t"))).alias("place", "line")).where("line <> ''").select("a", "b", "place", h.alias("h"), g.alias("g"))
    hits = small_or_salted(places, frequent, ["h", "g"], frequent.count(), how="inner")
    # Places of one text: equal texts have the same ones, so a list is no longer than the text has lines.
    gone = written(hits.groupBy("a", "b").agg(F.collect_set("place").alias("gone")), "dropped-places")
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + 8), F.lit(0))).first()[0]
    found = small_or_salted(rows, gone, ["a", "b"], 0 if size <= BROADCAST_PLACES else size)
    lines = lines_of(F.col("t"))
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(left, lambda p: F.get("lines", p)), "\n"))
    counted = found.withColumn("lines", lines)
    return counted.select(
        "__row", F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept")
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(__row, n_lines, n_dropped, kept) of all rows: lines whose key occurs in ``least`` documents or more are gone everywhere."""
    return drop_lines(docs, frequent_lines(docs, text, key, least, batches, fanout), text, key)


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT rid, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= {LEAST}),
told AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN often o ON o.key = k.key),
t AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept FROM told GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN t USING (rid)
"""


@query("op12_line_dedup", OP12_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("__row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
