"""Validation, cleaning, splits, engineered columns and perturbations over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.numbers import payload_digest, safe_ratio
from tidewatch.functions.text import CODE_CHAPTERS, SOURCE_GROUPS, code_chapter, map_or_default
from tidewatch.operators import perturb, preparation, validation
from tidewatch.operators.ordering import sample_rows
from tidewatch.operators.validation import Expectation
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query
from tidewatch.sources.readers import read_page
from tidewatch.sources import sinks

ORDER_RULES = (
    Expectation("o_orderkey", "bigint", unique=True),
    Expectation("o_custkey", "bigint"),
    Expectation("o_orderstatus", "string", isin=("F", "O")),
    Expectation("o_totalprice", "double", between=(1000.0, 450000.0)),
    Expectation("o_orderpriority", "string", matches=r"^[1-3]-[A-Z ]+$"),
    Expectation("o_shippriority", "int", at_least=1),
)
CUSTOMER_RULES = (
    Expectation("c_custkey", "bigint", unique=True),
    Expectation("c_nationkey", "int", between=(0, 20)),
    Expectation("c_acctbal", "double", at_least=0.0),
    Expectation("c_mktsegment", "string", isin=("BUILDING", "MACHINERY", "HOUSEHOLD")),
    Expectation("c_name", "string", matches=r"^Customer#\d{9}$"),
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a text field that does not always hold a number, and a missing status now and then."""
    o = t.table(spark, sf_dir, "orders")
    return o.withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
            "o_shippriority": F.when(F.col("o_custkey") % 50 == 0, F.lit("n/a")).otherwise((F.col("o_custkey") % 4).cast("string")),
        }
    )


ORDER_ROWS = """
o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate,
             CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS status,
             CASE WHEN o_custkey % 50 = 0 THEN 'n/a' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS ship FROM orders),
od AS (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1),
flags AS (
  SELECT o_orderkey, o_totalprice, [x for x in [
    CASE WHEN status IS NULL THEN 'o_orderstatus:not_null' END,
    CASE WHEN status NOT IN ('F', 'O') THEN 'o_orderstatus:isin' END,
    CASE WHEN NOT o_totalprice BETWEEN 1000 AND 450000 THEN 'o_totalprice:between' END,
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z ]+$') THEN 'o_orderpriority:matches' END,
    CASE WHEN try_cast(ship AS INTEGER) IS NULL THEN 'o_shippriority:type' END,
    CASE WHEN try_cast(ship AS INTEGER) < 1 THEN 'o_shippriority:at_least' END,
    CASE WHEN o_orderkey IN (SELECT o_orderkey FROM od) THEN 'o_orderkey:unique' END] if x IS NOT NULL] AS v FROM o)
"""


@query(
    "validate_report",
    f"""WITH {ORDER_ROWS},
cd AS (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1),
cflags AS (
  SELECT [x for x in [
    CASE WHEN NOT c_nationkey BETWEEN 0 AND 20 THEN 'c_nationkey:between' END,
    CASE WHEN c_acctbal < 0 THEN 'c_acctbal:at_least' END,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'c_mktsegment:isin' END,
    CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{{9}}$') THEN 'c_name:matches' END,
    CASE WHEN c_custkey IN (SELECT c_custkey FROM cd) THEN 'c_custkey:unique' END] if x IS NOT NULL] AS v FROM customer),
u AS (SELECT unnest(v) AS x FROM flags UNION ALL SELECT unnest(v) FROM cflags)
SELECT split_part(x, ':', 1) AS column_name, split_part(x, ':', 2) AS rule, count(*) AS failures FROM u GROUP BY ALL""",
)
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = validation.with_violations(_orders(spark, sf_dir), ORDER_RULES)
    customers = validation.with_violations(t.table(spark, sf_dir, "customer"), CUSTOMER_RULES)
    return validation.violation_report(orders.select("violations").unionByName(customers.select("violations")))


@query(
    "validate_quarantine",
    f"WITH {ORDER_ROWS} SELECT len(v) > 0 AS quarantined, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM flags GROUP BY ALL",
)
def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validation.with_violations(_orders(spark, sf_dir), ORDER_RULES)
    good = validation.passing(checked).select(F.lit(False).alias("quarantined"), "o_totalprice")
    bad = validation.quarantined(checked).select(F.lit(True).alias("quarantined"), "o_totalprice")
    return good.unionByName(bad).groupBy("quarantined").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "null_profile",
    """
WITH r AS (SELECT avg(CAST(c_custkey % 3 = 0 AS INTEGER)) AS c_mktsegment, avg(CAST(c_acctbal < 0 AS INTEGER)) AS c_acctbal, avg(CAST(c_nationkey = 7 AS INTEGER)) AS c_nationkey FROM customer)
SELECT column_name, round(null_rate, 6) AS null_rate FROM (UNPIVOT r ON c_mktsegment, c_acctbal, c_nationkey INTO NAME column_name VALUE null_rate) WHERE null_rate > 0
""",
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "customer")
    holes = c.withColumns(
        {
            "c_mktsegment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")),
            "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
            "c_nationkey": F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")),
        }
    )
    return validation.null_profile(holes).withColumn("null_rate", F.round("null_rate", 6))


@query(
    "clean_encounters",
    """
WITH kept AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
first AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM kept)
SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing' ELSE o_orderpriority END AS payer,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT AS target
FROM first WHERE rn = 1
""",
)
def clean_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").withColumn("payer", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    cleaned = (
        o.transform(preparation.without_codes, "o_orderstatus", ["P"])
        .transform(preparation.first_per_key, "o_custkey", "o_orderkey")
        .transform(preparation.fill_missing, ["o_totalprice"], ["payer"])
        .transform(preparation.binary_target, "o_orderstatus", "F", "target")
    )
    return cleaned.select("o_custkey", "o_orderkey", "payer", F.col("target").cast("bigint").alias("target"))


@query(
    "dedup_first_per_key",
    "SELECT l_orderkey, CAST(min(key_) AS BIGINT) AS first_line, count(*) AS copies FROM (SELECT *, l_linenumber * 100000000 + l_partkey AS key_ FROM lineitem) GROUP BY l_orderkey",
)
def dedup_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")).alias("first_line"))
    kept = preparation.first_per_key(lines, "l_orderkey", "first_line")
    return kept.join(lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("copies")), "l_orderkey")


@query(
    "repeated_keys",
    "SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated, CAST(max(n) AS BIGINT) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)",
)
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.repeated_keys(t.table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "value_shares",
    "SELECT o_orderpriority, count(*) AS rows, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share FROM orders GROUP BY ALL",
)
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = preparation.value_shares(t.table(spark, sf_dir, "orders"), "o_orderpriority")
    return shares.withColumn("share", F.round("share", 6))


@query("filtered_share", "SELECT round(avg(CAST(o_orderstatus IN ('F', 'O') AS INTEGER)), 6) AS share FROM orders")
def filtered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = preparation.filtered_share(t.table(spark, sf_dir, "orders"), F.col("o_orderstatus").isin("F", "O"))
    return shares.select(F.round("share", 6).alias("share"))


SPLIT = """
WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
s AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'eval_frozen' ELSE 'future_stream' END AS split FROM p)
"""


@query("time_split_70_15_15", SPLIT + "SELECT split, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS total FROM s GROUP BY ALL")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return preparation.chronological_split(o, "o_orderkey").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("split_disjointness", SPLIT + "SELECT o_custkey, count(DISTINCT split) AS splits FROM s GROUP BY ALL HAVING count(DISTINCT split) > 1")
def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return preparation.shared_keys(preparation.chronological_split(o, "o_orderkey"), "o_custkey")


@query(
    "validation_tail",
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT pos >= floor(n * 0.85::DOUBLE) AS is_validation, count(*) AS rows, min(o_orderkey) AS first_key FROM p GROUP BY ALL""",
)
def validation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select("o_orderkey")
    return preparation.validation_tail(o, "o_orderkey").groupBy("is_validation").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


def bits_sql(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 12) AS BIGINT)"


def uniform_sql(key: str, seed: str) -> str:
    return f"(({bits_sql(key, seed)})::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE"


@query(
    "grouped_holdout",
    f"""WITH o AS (SELECT *, {bits_sql('o_custkey', '42')} % 100 < 20 AS is_test FROM orders)
SELECT is_test, count(DISTINCT o_custkey) AS customers, count(*) AS orders, false AS torn FROM o GROUP BY is_test""",
)
def grouped_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No customer is on both sides."""
    o = preparation.grouped_holdout(t.table(spark, sf_dir, "orders"), "o_custkey", portable=True)
    sides = o.groupBy("o_custkey").agg(F.min("is_test").alias("a"), F.max("is_test").alias("b"), F.count(F.lit(1)).alias("n"))
    return sides.groupBy((F.col("a") != F.col("b")).alias("torn"), F.col("a").alias("is_test")).agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"))


# --- engineered columns -------------------------------------------------------------------
@query(
    "horizontal_match_count",
    """SELECT l_orderkey, CAST(sum(CAST(l_returnflag IN ('A', 'R') AS INTEGER) + CAST(l_linestatus IN ('A', 'R') AS INTEGER)) AS BIGINT) AS matches,
       CAST(sum(CAST(l_returnflag IN ('A', 'R') AS INTEGER)) AS BIGINT) AS flagged, round(sum(l_quantity + l_discount + l_tax), 2) AS row_sum FROM lineitem GROUP BY ALL""",
)
def horizontal_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(
        F.sum(preparation.matching_columns(["l_returnflag", "l_linestatus"], ["A", "R"])).cast("bigint").alias("matches"),
        F.sum(preparation.matching_columns(["l_returnflag"], ["A", "R"])).cast("bigint").alias("flagged"),
        F.round(F.sum(F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")), 2).alias("row_sum"),
    )


@query(
    "safe_ratio",
    "SELECT p_size, count(*) AS parts, count(CASE WHEN p_partkey % 7 <> 0 THEN 1 END) AS defined, round(sum(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / (p_partkey % 7) END), 4) AS total FROM part GROUP BY ALL",
)
def safe_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.table(spark, sf_dir, "part").withColumn("ratio", safe_ratio("p_retailprice", F.col("p_partkey") % 7))
    return parts.groupBy("p_size").agg(F.count(F.lit(1)).alias("parts"), F.count("ratio").alias("defined"), F.round(F.sum("ratio"), 4).alias("total"))


def _chapter_sql() -> str:
    ranges = "\n".join(f"WHEN x BETWEEN {a} AND {b} THEN '{name}'" for a, b, name in CODE_CHAPTERS)
    return f"""
WITH codes AS (
  SELECT CASE l_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'V' || l_suppkey WHEN 2 THEN ' e' || l_suppkey WHEN 3 THEN 'x' || l_suppkey WHEN 4 THEN ' '
         ELSE CAST(l_partkey % 1005 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '.5' ELSE '' END END AS code FROM lineitem),
n AS (SELECT code, trim(code) AS c, try_cast(trim(code) AS DOUBLE) AS x FROM codes)
SELECT CASE WHEN c IS NULL OR c = '' THEN 'missing' WHEN upper(c) LIKE 'V%' THEN 'supplementary_v' WHEN upper(c) LIKE 'E%' THEN 'external_causes_e'
       WHEN x IS NULL THEN 'other_unrecognized' WHEN x >= 250 AND x < 251 THEN 'diabetes'
       {ranges} ELSE 'other_unrecognized' END AS chapter, count(*) AS rows
FROM n GROUP BY ALL"""


@query("code_range_chapter", _chapter_sql())
def code_range_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem")
    kind, supplier = F.col("l_partkey") % 11, F.col("l_suppkey").cast("string")
    half = F.when(F.col("l_linenumber") % 2 == 0, F.lit(".5")).otherwise(F.lit(""))
    code = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, F.concat(F.lit("V"), supplier))
        .when(kind == 2, F.concat(F.lit(" e"), supplier))
        .when(kind == 3, F.concat(F.lit("x"), supplier))
        .when(kind == 4, F.lit(" "))
        .otherwise(F.concat((F.col("l_partkey") % 1005).cast("string"), half))
    )
    return lines.select(code_chapter(code).alias("chapter")).groupBy("chapter").agg(F.count(F.lit(1)).alias("rows"))


def _group_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in SOURCE_GROUPS.items())
    return f"SELECT CASE p_size {cases} ELSE 'other' END AS source_group, count(*) AS parts, round(sum(p_retailprice), 2) AS total FROM part GROUP BY ALL"


@query("code_group_default", _group_sql())
def code_group_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.table(spark, sf_dir, "part").withColumn("source_group", map_or_default("p_size", SOURCE_GROUPS))
    return parts.groupBy("source_group").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(
    "payload_hash",
    """SELECT c_custkey, sha256('{"c_acctbal":' || to_json(c_acctbal) || ',"c_mktsegment":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE to_json(c_mktsegment) END || ',"c_name":' || to_json(c_name) || '}') AS digest FROM customer""",
)
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", payload_digest(["c_name", "c_acctbal", "c_mktsegment"]).alias("digest"))


# --- samples and perturbations --------------------------------------------------------------
@query(
    "hash_sample",
    f"SELECT event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (ORDER BY {bits_sql('event_id', '42')}, event_id) <= 1000",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 6).alias("value"))
    return sample_rows(events, ["event_id"], 1000, portable=True)


@query(
    "hash_fill_nulls",
    f"""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS result FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY result IS NULL ORDER BY {bits_sql('event_id', '42-rows')}, event_id) AS rn, count(*) OVER (PARTITION BY result IS NULL) AS n, {uniform_sql('event_id', '42-values')} AS u FROM e)
SELECT coalesce(result, CASE WHEN rn <= round_even(n * 0.4::DOUBLE, 0) THEN CASE WHEN u < 0.25 THEN '>7' WHEN u < 0.25 + 0.2 THEN '>8' ELSE 'Norm' END END) AS result,
       count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM r GROUP BY ALL""",
)
def hash_fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("result"))
    filled = perturb.fill_nulls(e, ["event_id"], "result", portable=True)
    return filled.groupBy("result").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query(
    "weighted_resample",
    """
WITH w AS (SELECT *, CASE WHEN user_id % 10 >= 7 THEN 4 ELSE 1 END * CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END AS wt FROM events),
c AS (SELECT *, sum(wt) OVER (ORDER BY event_id) AS upto, sum(wt) OVER () AS total, count(*) OVER () AS n FROM w),
k AS (SELECT *, CAST(floor(upto::DOUBLE / total::DOUBLE * n + 0.5::DOUBLE) - floor((upto - wt)::DOUBLE / total::DOUBLE * n + 0.5::DOUBLE) AS BIGINT) AS copies FROM c)
SELECT event_type, user_id % 10 AS user_digit, CAST(sum(copies) AS BIGINT) AS rows, round(sum(copies * value), 2) AS total FROM k WHERE copies > 0 GROUP BY ALL""",
)
def weighted_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    older = F.when(F.col("user_id") % 10 >= 7, 4).otherwise(1)
    drawn = perturb.weighted_resample(e, "event_id", older * F.when(F.col("event_type") == "purchase", 3).otherwise(1))
    return drawn.groupBy("event_type", (F.col("user_id") % 10).alias("user_digit")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "label_noise",
    f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {bits_sql('doc_id', '42-rows')}, doc_id) AS rn, count(*) OVER () AS n, avg(quality) OVER () AS rate, {uniform_sql('doc_id', '42-labels')} AS u FROM labels)
SELECT doc_id, CASE WHEN rn <= round_even(n * 0.3::DOUBLE, 0) THEN CASE WHEN u < rate THEN 1 ELSE 0 END ELSE quality END::BIGINT AS quality FROM r""",
)
def label_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return perturb.relabel_at_base_rate(labels, ["doc_id"], "quality", portable=True).select("doc_id", F.col("quality").cast("bigint").alias("quality"))


@query(
    "scale_jitter",
    f"""
WITH e AS (SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT event_id, CAST(greatest(round_even(k * 1.2::DOUBLE + sqrt(-2::DOUBLE * ln({uniform_sql('event_id', '42-k-a')})) * cos(6.283185307179586::DOUBLE * ({uniform_sql('event_id', '42-k-b')})), 0), (SELECT min(k) FROM e)) AS BIGINT) AS k FROM e""",
)
def scale_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return perturb.scale_jitter(e, ["event_id"], ["k"], portable=True)


@query(
    "score_inversion",
    "SELECT event_type, round(avg(1 - least(value, 500::DOUBLE) / 500), 6) AS mean_score, round(min(1 - least(value, 500::DOUBLE) / 500), 6) AS low FROM events GROUP BY ALL",
)
def score_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = perturb.invert_score(t.table(spark, sf_dir, "events").withColumn("score", F.least(F.col("value"), F.lit(500.0)) / 500.0), "score")
    return p.groupBy("event_type").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("low"))


# --- whole tables -----------------------------------------------------------------------------
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.table_counts({n: t.table(spark, sf_dir, n) for n in TABLES})


@query(
    "table_reconcile",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS a, count(*) {'FILTER (o_orderstatus <> $$P$$)' if n == 'orders' else ''} AS b FROM {n}" for n in TABLES)
    + ") SELECT table_name, a AS rows_a, CASE WHEN table_name <> 'nation' THEN b END AS rows_b, a IS NOT DISTINCT FROM CASE WHEN table_name <> 'nation' THEN b END AS same FROM c",
)
def table_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables against a copy that lacks one table and some rows of another."""
    ours = {n: t.table(spark, sf_dir, n) for n in TABLES}
    copy = {n: (df.where("o_orderstatus <> 'P'") if n == "orders" else df) for n, df in ours.items() if n != "nation"}
    return sinks.reconcile(sinks.table_counts(ours), sinks.table_counts(copy))


@query(
    "late_page",
    "SELECT event_id, user_id, CAST(value AS DOUBLE) AS value FROM events ORDER BY value, event_id LIMIT 50 OFFSET (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM events)",
)
def late_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page near the end of a long list, as a viewer of the table turns to it."""
    events = t.table(spark, sf_dir, "events")
    return read_page(events, ["value", "event_id"], int(events.count() * 9 // 10), 50).select("event_id", "user_id", F.col("value").cast("double").alias("value"))
