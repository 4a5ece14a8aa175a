"""Quality rules with thresholds learned per language and source.

Every document gets base counts. Four rates derived from them are summarised per (language,
source) in a mergeable sketch: counts of rows per grid bin, the bins kept to three significant
digits, so two sketches merge by adding counts and a quantile is off by less than one percent.
Groups with few documents take the merged sketch of their language, and small languages the sketch
of the whole corpus.

``judge`` learns its cuts (``learned_thresholds``) from the documents that pass the base rules: median
plus an allowance of six quartile spreads or, where the quartiles are equal, up to the 99th percentile.
An allowance is at most twice that of the level above and at most ``most``, so a group with much junk
can't switch its own rule off. ``judge_fixed`` has the cuts of op6_quality_rules and its SQL, where the
constants ``least`` exceed every spread seen so far; op6_quality_rules_learned is the learned form.

Defined cases: a null text counts as empty; documents without words fail the base rules; null
language or source is a group of its own; repeated rows are judged one by one; input columns
named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import documents, small_or_salted, without, written
from tidewatch.llm.registry import query

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUT = (*COUNTS, "base_failed", "kept", "cut_level", *(f"{m}_cut" for m in ("symbols", "repeats", "dup_lines", "length")))


@dataclass(frozen=True)
class Metric:
    """A rate in whole thousandths; ``spreads`` quartile ranges above the median, at least ``least``, are allowed."""

    name: str
    top: str
    bottom: str
    spreads: int
    least: int


METRICS = (
    Metric("symbols", "n_symbols", "n_words", 6, 150),
    Metric("repeats", "n_repeat_words", "n_words", 6, 300),
    Metric("dup_lines", "n_dup_lines", "n_lines", 6, 400),
    Metric("length", "word_chars", "n_words", 6, 3000),
)
MIN_GROUP = 200


@dataclass(frozen=True)
class Learned:
    """Bounds in thousandths of a learned allowance above the median."""

    name: str
    floor: int
    most: int


LEARNED = (Learned("symbols", 10, 150), Learned("repeats", 20, 250), Learned("dup_lines", 50, 400), Learned("length", 200, 2000))
SPREADS = 6
ABOVE_PARENT = 2


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeat_words(hashes: Column) -> Column:
    """Words lying in eight-word windows that occur twice or more, from the words' hashes.

    Windows are hashed and sorted with their places; equal neighbours give the repeated places,
    and each of those covers eight words or as many as lie before the next one.
    """

    def of_windows(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: (x["w"] == F.get(s, i + 1)["w"]).eqNullSafe(True)
                | ((i > 0) & (x["w"] == F.get(s, F.greatest(i - 1, F.lit(0)))["w"])),
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(
                p, F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(8), i - a["last"])).alias("n"), i.alias("last")),
                lambda a: a["n"].cast("bigint"),
            )

        found = _bind(_bind(placed, places), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(found)

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - 7)
        return _bind(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, 8))), of_windows)

    return F.when(F.size(hashes) < 9, F.lit(0).cast("bigint")).otherwise(_bind(hashes, of_hashes))


def _bind(value: Column, use) -> Column:
    """Evaluates ``value`` once per row and hands it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with COUNTS, n_lines (lines holding a word) and base_failed."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    taken = without(docs, [*OUTPUT, "n_lines"]) if text not in OUTPUT else docs
    step = taken.withColumns({"__words": _words(body), "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    step = step.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": _repeat_words(F.transform("__words", lambda w: F.xxhash64(w))),
    }).drop("__words", "__lines")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return step.withColumn("base_failed", failed)


def _rate(m: Metric) -> Column:
    return F.when(F.col(m.bottom) > 0, F.expr(f"1000 * {m.top} div {m.bottom}"))


def _bin(value: str) -> Column:
    unit = f"cast(power(10, greatest(length(cast({value} as string)) - 3, 0)) as bigint)"
    return F.expr(f"{value} div {unit} * {unit}")


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bin, n): documents per grid bin; adding n over rows merges sketches."""
    rates = F.array(*[F.struct(F.lit(m.name).alias("metric"), _rate(m).alias("v")) for m in METRICS])
    long = counted.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(rates)).where("v is not null")
    return long.groupBy("lang", "source", "metric", _bin("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and 99th percentile per key: the first bin whose running count reaches the rank."""
    merged = sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = merged.withColumns({"cum": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(*keys))})
    at = {q: F.min(F.when(F.col("cum") * 4 >= F.col("total") * k, F.col("bin"))).alias(q) for k, q in ((1, "q1"), (2, "q2"), (3, "q3"))}
    at["top"] = F.min(F.when(F.col("cum") * 100 >= F.col("total") * 99, F.col("bin"))).alias("top")
    return run.groupBy(*keys).agg(F.max("total").alias("total"), *at.values())


def _cuts(quartiles: DataFrame, keys: list[str]) -> DataFrame:
    spread = F.create_map(*[x for m in METRICS for x in (F.lit(m.name), F.lit(m.spreads))])[F.col("metric")]
    least = F.create_map(*[x for m in METRICS for x in (F.lit(m.name), F.lit(m.least))])[F.col("metric")]
    cut = F.col("q2") + F.greatest((F.col("q3") - F.col("q1")) * spread, least)
    names = [F.max(F.when(F.col("metric") == m.name, cut)).alias(f"{m.name}_cut") for m in METRICS]
    return quartiles.groupBy(*keys).agg(F.max("total").alias("docs"), *names)


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): cuts of the group, its language or the corpus, whichever is large enough first."""
    cuts = [f"{m.name}_cut" for m in METRICS]
    own = _cuts(_quartiles(sketch, ["lang", "source", "metric"]), ["lang", "source"])
    lang = _cuts(_quartiles(sketch, ["lang", "metric"]), ["lang"]).select(F.col("lang").alias("l"), F.col("docs").alias("l_docs"), *[F.col(c).alias(f"l_{c}") for c in cuts])
    whole = _cuts(_quartiles(sketch, ["metric"]), []).select(*[F.col(c).alias(f"w_{c}") for c in cuts])
    level = F.when(F.col("docs") >= min_group, F.lit("source")).when(F.col("l_docs") >= min_group, F.lit("language")).otherwise(F.lit("corpus"))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l"]), "left").crossJoin(F.broadcast(whole)).withColumn("cut_level", level)
    pick = [F.when(F.col("cut_level") == "source", F.col(c)).when(F.col("cut_level") == "language", F.col(f"l_{c}")).otherwise(F.col(f"w_{c}")).alias(c) for c in cuts]
    return joined.select("lang", "source", "cut_level", *pick)


def _allowances(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, q2, allowance): what the group's own quantiles allow above its median."""
    bound = lambda field: F.create_map(*[x for m in LEARNED for x in (F.lit(m.name), F.lit(getattr(m, field)))])[F.col("metric")]
    own = F.when(F.col("q3") > F.col("q1"), (F.col("q3") - F.col("q1")) * SPREADS).otherwise(F.col("top") - F.col("q2"))
    return _quartiles(sketch, [*keys, "metric"]).select(*keys, "metric", "total", "q2", F.least(F.greatest(own, bound("floor")), bound("most")).alias("allowance"))


def learned_thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """As ``thresholds``, with cuts that the quantiles decide, bounded by the level above."""
    own = _allowances(sketch, ["lang", "source"])
    lang = _allowances(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("total").alias("l_total"), F.col("q2").alias("l_q2"), F.col("allowance").alias("l_own"))
    whole = _allowances(sketch, []).select(F.col("metric").alias("wm"), F.col("q2").alias("w_q2"), F.col("allowance").alias("w"))
    # One row per metric.
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["metric"] == lang["m"])).join(F.broadcast(whole), own["metric"] == whole["wm"])
    of_lang = F.least("l_own", F.col("w") * ABOVE_PARENT)
    above = F.when(F.col("l_total") >= min_group, of_lang).otherwise(F.col("w"))
    level = F.when(F.col("total") >= min_group, F.lit("source")).when(F.col("l_total") >= min_group, F.lit("language")).otherwise(F.lit("corpus"))
    cut = F.when(F.col("cut_level") == "source", F.col("q2") + F.least("allowance", above * ABOVE_PARENT)).when(F.col("cut_level") == "language", F.col("l_q2") + of_lang).otherwise(F.col("w_q2") + F.col("w"))
    rows = joined.withColumn("cut_level", level).withColumn("cut", cut)
    picks = [F.max(F.when(F.col("metric") == m.name, F.col("cut"))).alias(f"{m.name}_cut") for m in METRICS]
    return rows.groupBy("lang", "source").agg(F.max("cut_level").alias("cut_level"), *picks)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The documents with counts, learned cuts and ``kept``: base rules passed and no rate above its cut."""
    return judge_counted(with_counts(docs, text), lang, source, min_group)


def judge_counted(counts: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """As ``judge``, over what ``with_counts`` returned; it is written once, as the cuts and the verdicts both read it."""
    counted = written(counts, "quality-counts")
    return _verdicts(counted, learned_thresholds(sketches(counted.where("not base_failed"), lang, source), min_group), lang, source)


def judge_fixed(counts: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """As ``judge_counted``, with at least the constants of METRICS allowed above the median."""
    counted = written(counts, "quality-counts")
    return _verdicts(counted, thresholds(sketches(counted, lang, source), min_group), lang, source)


def _verdicts(counted: DataFrame, found: DataFrame, lang: str, source: str) -> DataFrame:
    cuts = written(found, "quality-cuts")
    cuts = cuts.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c for c in cuts.columns if c not in ("lang", "source")])
    keyed = counted.withColumns({"__lang": F.col(lang), "__source": F.col(source)})
    joined = small_or_salted(keyed, cuts, ["__lang", "__source"], cuts.count()).drop("__lang", "__source")
    above = F.lit(False)
    for m in METRICS:
        above = above | F.coalesce(_rate(m) > F.col(f"{m.name}_cut"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~above)


_METRIC_SQL = " UNION ALL ".join(
    f"SELECT lang, source, '{m.name}' AS metric, 1000 * {m.top} // {m.bottom} AS v FROM counts WHERE {m.bottom} > 0" for m in METRICS
)


def _quartile_sql(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    return (
        f"SELECT {group}metric, max(total) AS total, min(bin) FILTER (cum * 4 >= total) AS q1, min(bin) FILTER (cum * 4 >= total * 2) AS q2, "
        f"min(bin) FILTER (cum * 4 >= total * 3) AS q3 FROM (SELECT {group}metric, bin, sum(n) OVER (PARTITION BY {group}metric ORDER BY bin) AS cum, "
        f"sum(n) OVER (PARTITION BY {group}metric) AS total FROM (SELECT {group}metric, bin, count(*) AS n FROM binned GROUP BY {group}metric, bin)) GROUP BY {group}metric"
    )


def _cut_sql(source: str, keys: str) -> str:
    cut = "q2 + greatest((q3 - q1) * CASE metric {s} END, CASE metric {l} END)".format(
        s=" ".join(f"WHEN '{m.name}' THEN {m.spreads}" for m in METRICS), l=" ".join(f"WHEN '{m.name}' THEN {m.least}" for m in METRICS)
    )
    picks = ", ".join(f"max({cut}) FILTER (metric = '{m.name}') AS {m.name}_cut" for m in METRICS)
    return f"SELECT {keys + ', ' if keys else ''}max(total) AS docs, {picks} FROM {source}" + (f" GROUP BY {keys}" if keys else "")


def _picked(m: Metric) -> str:
    return f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{m.name}_cut WHEN l.docs >= {MIN_GROUP} THEN l.{m.name}_cut ELSE w.{m.name}_cut END"


OP6_SQL = f"""
WITH body AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM body),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
counts AS (SELECT d.doc_id, d.lang, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(lines)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM words d LEFT JOIN repeated r USING (doc_id)),
valued AS ({_METRIC_SQL}),
binned AS (SELECT lang, source, metric, v // u * u AS bin FROM (SELECT *, power(10, greatest(length(v::VARCHAR) - 3, 0))::BIGINT AS u FROM valued)),
own AS ({_cut_sql('(' + _quartile_sql('lang, source') + ')', 'lang, source')}),
lng AS ({_cut_sql('(' + _quartile_sql('lang') + ')', 'lang')}),
whole AS ({_cut_sql('(' + _quartile_sql('') + ')', '')}),
judged AS (SELECT c.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN o.docs >= {MIN_GROUP} THEN 'source' WHEN l.docs >= {MIN_GROUP} THEN 'language' WHEN o.docs IS NOT NULL THEN 'corpus' END AS cut_level,
  {", ".join(f"CASE WHEN o.docs IS NOT NULL THEN {_picked(m)} END AS {m.name}_cut" for m in METRICS)}
  FROM counts c LEFT JOIN own o ON c.lang IS NOT DISTINCT FROM o.lang AND c.source IS NOT DISTINCT FROM o.source
  LEFT JOIN lng l ON c.lang IS NOT DISTINCT FROM l.lang CROSS JOIN whole w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"NOT coalesce(1000 * {m.top} // nullif({m.bottom}, 0) > {m.name}_cut, false)" for m in METRICS)} AS kept, cut_level
FROM judged
"""


@query("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    counted = with_counts(docs).drop("text")
    return judge_fixed(counted).select("doc_id", *COUNTS, "base_failed", "kept", "cut_level")


def _allowance_sql(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    case = lambda field: "CASE metric " + " ".join(f"WHEN '{m.name}' THEN {getattr(m, field)}" for m in LEARNED) + " END"
    return f"""SELECT {group}metric, total, q2, least(greatest(CASE WHEN q3 > q1 THEN (q3 - q1) * {SPREADS} ELSE top - q2 END, {case("floor")}), {case("most")}) AS a FROM (
  SELECT {group}metric, max(total) AS total, min(bin) FILTER (cum * 4 >= total) AS q1, min(bin) FILTER (cum * 4 >= total * 2) AS q2,
    min(bin) FILTER (cum * 4 >= total * 3) AS q3, min(bin) FILTER (cum * 100 >= total * 99) AS top
  FROM (SELECT {group}metric, bin, sum(n) OVER (PARTITION BY {group}metric ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {group}metric) AS total
    FROM (SELECT {group}metric, bin, count(*) AS n FROM binned GROUP BY {group}metric, bin)) GROUP BY {group}metric)"""


_PASSED_SQL = _METRIC_SQL.replace(" FROM counts WHERE ", " FROM counts WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND ")
LEARNED_SQL = f"""
{OP6_SQL[:OP6_SQL.index("valued AS")].strip()}
valued AS ({_PASSED_SQL}),
binned AS (SELECT lang, source, metric, v // u * u AS bin FROM (SELECT *, power(10, greatest(length(v::VARCHAR) - 3, 0))::BIGINT AS u FROM valued)),
own AS ({_allowance_sql('lang, source')}),
whole AS ({_allowance_sql('')}),
lng AS (SELECT l.lang, l.metric, l.total, l.q2, least(l.a, {ABOVE_PARENT} * w.a) AS a FROM ({_allowance_sql('lang')}) l JOIN whole w USING (metric)),
cuts AS (SELECT o.lang, o.source, o.metric,
  CASE WHEN o.total >= {MIN_GROUP} THEN 'source' WHEN l.total >= {MIN_GROUP} THEN 'language' ELSE 'corpus' END AS cut_level,
  CASE WHEN o.total >= {MIN_GROUP} THEN o.q2 + least(o.a, {ABOVE_PARENT} * CASE WHEN l.total >= {MIN_GROUP} THEN l.a ELSE w.a END)
    WHEN l.total >= {MIN_GROUP} THEN l.q2 + l.a ELSE w.q2 + w.a END AS cut
  FROM own o JOIN lng l ON o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang JOIN whole w ON o.metric = w.metric),
wide AS (SELECT lang, source, max(cut_level) AS cut_level, {", ".join(f"max(cut) FILTER (metric = '{m.name}') AS {m.name}_cut" for m in METRICS)} FROM cuts GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {" AND ".join(f"NOT coalesce(1000 * {m.top} // nullif({m.bottom}, 0) > {m.name}_cut, false)" for m in METRICS)} AS kept,
  cut_level, {", ".join(f"{m.name}_cut" for m in METRICS)}
FROM counts c LEFT JOIN wide t ON c.lang IS NOT DISTINCT FROM t.lang AND c.source IS NOT DISTINCT FROM t.source
"""


@query("op6_quality_rules_learned", LEARNED_SQL)
def op6_quality_rules_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    counted = with_counts(docs).drop("text")
    return judge_counted(counted).select("doc_id", *COUNTS, "base_failed", "kept", "cut_level", *[f"{m.name}_cut" for m in METRICS])
