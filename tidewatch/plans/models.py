"""Grounding, attribution, encoding and training queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.text import MISSING
from tidewatch.operators import attribution, grounding, training, vocabulary
from tidewatch.plans import check_sql as c
from tidewatch.plans import tables as t
from tidewatch.plans.registry import query
from tidewatch.operators.isotonic import isotonic_steps

# --- grounding --------------------------------------------------------------------------------
# RE2 has no look-behind, so the SQL lists every place a figure may start and tests the rest of
# the text from there; a start inside an earlier figure is dropped.
FIGURES = r"""
parts AS (SELECT doc_id, n_chars, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE regexp_matches(text, '[0-9]')),
starts AS (
  SELECT doc_id, n_chars, i,
         regexp_extract(substr(text, i), '^(-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?%?)(?:$|[^\p{L}\p{N}\p{M}_\-.]|\.$|\.[^0-9])', 1) AS written
  FROM parts
  WHERE regexp_matches(substr(text, i, 2), '^(?:[0-9]|-[0-9])') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\p{L}\p{N}\p{M}_\-.]'))),
figs AS (
  SELECT doc_id, n_chars, i, written, CAST(regexp_replace(written, '[,%]', '', 'g') AS DOUBLE) AS value,
         length(regexp_extract(written, '\.([0-9]+)', 1)) AS decimals, written LIKE '%\%' ESCAPE '\' AS percent,
         max(i + length(written)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered
  FROM starts WHERE written <> ''),
found AS (SELECT * FROM figs WHERE covered IS NULL OR i >= covered),
dates AS (
  SELECT doc_id, count(*) AS dates FROM parts
  WHERE regexp_matches(substr(text, i, 11), '^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:$|[^\p{L}\p{N}\p{M}_\-])') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\p{L}\p{N}\p{M}_\-]'))
  GROUP BY ALL),
known AS (SELECT doc_id, unnest([doc_id, n_chars, doc_id % 100, doc_id % 10 + 1, 0, 1, 2, 3, 10, 100]) AS number FROM documents),
judged AS (
  SELECT f.doc_id, f.i, bool_or(round_even(k.number * CASE WHEN percent THEN 100 ELSE 1 END * pow(10::DOUBLE, decimals), 0) = round_even(f.value * pow(10::DOUBLE, decimals), 0)) AS ok
  FROM found f JOIN known k USING (doc_id) GROUP BY ALL)
"""


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    numbers = [F.col("doc_id"), F.col("n_chars"), F.col("doc_id") % 100, F.col("doc_id") % 10 + 1, *[F.lit(n) for n in (0, 1, 2, 3, 10, 100)]]
    return docs, grounding.numeric_leaves(docs, "doc_id", numbers)


@query(
    "number_grounding",
    f"""WITH {FIGURES.strip()}
SELECT d.doc_id, coalesce(j.numbers, 0) AS numbers, coalesce(j.loose, 0) AS ungrounded_numbers, coalesce(dates.dates, 0) AS dates,
       coalesce(dates.dates, 0) AS ungrounded_dates, length(trim(d.text)) > 0 AND coalesce(j.loose, 0) = 0 AND coalesce(dates.dates, 0) = 0 AS grounded
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS numbers, count(*) FILTER (NOT ok) AS loose FROM judged GROUP BY ALL) j USING (doc_id) LEFT JOIN dates USING (doc_id)""",
)
def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _known(spark, sf_dir)
    return grounding.grounding_report(docs, "doc_id", "text", known)


@query(
    "ungrounded_figures",
    f"WITH {FIGURES.strip()} SELECT f.doc_id, f.written, count(*) AS times FROM found f JOIN judged j ON j.doc_id = f.doc_id AND j.i = f.i WHERE NOT ok GROUP BY ALL",
)
def ungrounded_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _known(spark, sf_dir)
    loose = grounding.ungrounded_figures(grounding.quoted_figures(docs, "doc_id", "text"), known, "doc_id")
    return loose.groupBy("doc_id", "written").agg(F.count(F.lit(1)).alias("times"))


@query("card_text_grounding", c.with_(c.CARDS, recursive=True, select="SELECT count(*) AS texts, 1::DOUBLE AS faithfulness_rate FROM cards"))
def card_text_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card's own sentence must quote only the card's figures: all are faithful."""
    cards = t.cards(spark, sf_dir)
    trigger = "trigger."
    numbers = [
        F.col("confidence"), F.col(trigger + "max_psi"), F.col(trigger + "prediction_psi"), F.col(trigger + "consecutive_breaching_windows"),
        F.col("policy_thresholds")["psi_breach"], F.col("policy_thresholds")["psi_severe"], F.col("policy_thresholds")["auto_proceed_confidence"],
    ]
    known = grounding.numeric_leaves(cards, "card_id", numbers, [F.col(trigger + "breaching_features"), F.col(trigger + "persistent_features")])
    return grounding.faithfulness(grounding.grounding_report(cards, "card_id", "rationale", known))


# --- attribution ------------------------------------------------------------------------------
COEFFICIENTS = {"l_quantity": 0.02, "l_extendedprice": 0.00001, "l_discount": -3.0, "l_tax": 1.5}
CONTRIBUTIONS = (
    "m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem),\n"
    "a AS (SELECT row_number() OVER () AS row_id, 0.02::DOUBLE * (l_quantity - q) AS cq, 0.00001::DOUBLE * (l_extendedprice - e) AS ce, "
    "-3::DOUBLE * (l_discount - d) AS cd, 1.5::DOUBLE * (l_tax - x) AS cx FROM lineitem, m)"
)


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *COEFFICIENTS)
    return attribution.linear_contributions(lines, COEFFICIENTS)


@query(
    "attribution_rollup",
    f"""WITH {CONTRIBUTIONS},
u AS (SELECT 'l_quantity' AS feature, cq AS v FROM a UNION ALL SELECT 'l_extendedprice', ce FROM a UNION ALL SELECT 'l_discount', cd FROM a UNION ALL SELECT 'l_tax', cx FROM a)
SELECT feature, round(avg(abs(v)), 6) AS mean_abs_contribution, round(avg(v), 6) + 0.0::DOUBLE AS mean_contribution FROM u GROUP BY ALL""",
)
def attribution_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribution.global_importance(_contributions(spark, sf_dir))
    return found.select("feature", F.round("mean_abs_contribution", 6).alias("mean_abs_contribution"), (F.round("mean_contribution", 6) + 0.0).alias("mean_contribution"))


@query(
    "attribution_top_n",
    f"""WITH {CONTRIBUTIONS},
u AS (SELECT row_id, unnest([{{'f': 'l_quantity', 'v': cq}}, {{'f': 'l_extendedprice', 'v': ce}}, {{'f': 'l_discount', 'v': cd}}, {{'f': 'l_tax', 'v': cx}}]) AS s FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(s.v) DESC, s.f) AS place FROM u)
SELECT s.f AS feature, place, count(*) AS rows, round(sum(s.v), 4) AS total FROM r WHERE place <= 2 GROUP BY ALL""",
)
def attribution_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _contributions(spark, sf_dir).select(F.posexplode(attribution.without_values(attribution.top_contributions("contributions", 2))).alias("place", "c"))
    return top.groupBy(F.col("c.feature").alias("feature"), (F.col("place") + 1).cast("bigint").alias("place")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("c.contribution"), 4).alias("total")
    )


# --- encoding and training --------------------------------------------------------------------
SPEC = training.FeatureSpec(("n_chars", "words"), ("lang", "source"), {"band": ("short", "medium", "long")})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    words = F.size(F.split(F.col("text"), " "))
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").when(F.col("n_chars") < 20000, "long").otherwise("huge")
    facts = docs.select("doc_id", "n_chars", F.when(F.col("doc_id") % 10 != 3, words).alias("words"), "lang", "source", band.alias("band"))
    return t.table(spark, sf_dir, "labels").join(facts, "doc_id")


@query(
    "median_impute_encode",
    """
WITH r AS (SELECT doc_id, d.n_chars, CASE WHEN doc_id % 10 <> 3 THEN len(string_split(text, ' ')) END AS words, lang,
                  CASE WHEN d.n_chars < 500 THEN 0 WHEN d.n_chars < 2000 THEN 1 WHEN d.n_chars < 20000 THEN 2 ELSE -1 END AS band FROM labels JOIN documents d USING (doc_id))
SELECT doc_id, coalesce(words, (SELECT quantile_cont(words, 0.5) FROM r))::DOUBLE AS words, band::DOUBLE AS band, n_chars::DOUBLE AS n_chars FROM r
""",
)
def median_impute_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    prepared = training.prepare(rows, SPEC, training.medians(rows, SPEC.numeric))
    return prepared.select("doc_id", F.col("words__num").alias("words"), F.col("band__ord").alias("band"), F.col("n_chars__num").alias("n_chars"))


SLOTS = f"""
r AS (SELECT event_id, ts < TIMESTAMP '{t.REFERENCE_END}' AS taught,
             unnest([{{'i': 0, 'v': CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '{MISSING}' END}}, {{'i': 1, 'v': CAST(user_id AS VARCHAR)}}]) AS s FROM events),
vocab AS (SELECT s.i AS i, s.v AS v, count(*) AS n, row_number() OVER (ORDER BY s.i, s.v) - 1 AS slot FROM r WHERE taught GROUP BY s.i, s.v)
"""


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events")
    return events.select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind"), "user_id")


@query("category_vocabulary", f"WITH {SLOTS.strip()} SELECT CASE i WHEN 0 THEN 'kind' ELSE 'user_id' END AS feature, v AS value, slot, n FROM vocab")
def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category of the reference days, users among them, with its place in the encoded vector."""
    return vocabulary.vocabulary(_categories(spark, sf_dir).where(F.col("ts") < t.REFERENCE_END), ["kind", "user_id"])


@query(
    "one_hot_slots",
    f"""WITH {SLOTS.strip()}
SELECT event_id, coalesce(string_agg(CAST(slot AS VARCHAR), ',' ORDER BY i), '') AS slots, count(slot) AS known
FROM r LEFT JOIN vocab ON vocab.i = r.s.i AND vocab.v = r.s.v GROUP BY event_id""",
)
def one_hot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events encoded with what the reference days taught; nulls are a category, later users have no slot."""
    rows = _categories(spark, sf_dir)
    known = vocabulary.vocabulary(rows.where(F.col("ts") < t.REFERENCE_END), ["kind", "user_id"])
    encoded = vocabulary.one_hot(rows, ["kind", "user_id"], known)
    return encoded.select("event_id", F.concat_ws(",", F.col("slots").cast("array<string>")).alias("slots"), F.size("slots").cast("bigint").alias("known"))


@query("gbt_isotonic_score")
def gbt_isotonic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on the first labelled documents and scores all of them with both models."""
    rows = t.written_once(spark, sf_dir, "labelled_documents", lambda: _labelled(spark, sf_dir))
    (encoder, base), calibrated, _ = training.train_models(rows, SPEC, "quality", "doc_id")
    scored = calibrated.score(training.score(rows, encoder, base, "raw"), "calibrated")
    return scored.select("doc_id", "quality", F.round("raw", 6).alias("raw"), F.round("calibrated", 6).alias("calibrated"))


@query("logistic_baseline_score")
def logistic_baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.written_once(spark, sf_dir, "labelled_documents", lambda: _labelled(spark, sf_dir))
    encoder, model = training.fit_logistic(rows, SPEC, "quality")
    return training.score(rows, encoder, model).select("doc_id", "quality", F.round("p", 6).alias("p"))


@query(
    "training_metadata",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels)
SELECT count(*) FILTER (pos < floor(n * 0.85::DOUBLE)) AS train_rows, round(avg(quality) FILTER (pos < floor(n * 0.85::DOUBLE)), 6) AS train_positive_rate,
       count(*) FILTER (pos >= floor(n * 0.85::DOUBLE)) AS eval_rows, round(avg(quality) FILTER (pos >= floor(n * 0.85::DOUBLE)), 6) AS eval_positive_rate FROM r""",
)
def training_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.preparation import validation_tail

    tagged = validation_tail(t.table(spark, sf_dir, "labels"), "doc_id")
    return training.training_metadata(tagged.where("NOT is_validation"), tagged.where("is_validation"), "quality", 25).drop("trees")


@query("external_model_score", "SELECT doc_id, round(1 / (1 + exp(-(CAST(n_chars AS DOUBLE) / 1000 - 1))), 6) AS p FROM documents")
def external_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted logistic curve as a column expression, inside the scan's own stage."""
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(1 / (1 + F.exp(-(F.col("n_chars").cast("double") / 1000 - 1))), 6).alias("p"))


@query(
    "isotonic_fit",
    c.with_(
        c.SCORED,
        "d AS (SELECT p_v2 AS x, count(*) AS w, sum(y) AS s FROM scored GROUP BY p_v2)",
        "n AS (SELECT x, w, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS uw, sum(s) OVER (ORDER BY x) AS us, sum(w) OVER (ORDER BY x) - w AS bw, sum(s) OVER (ORDER BY x) - s AS bs FROM d)",
        "runs AS (SELECT a.i AS a, b.i AS b, (b.us - a.bs) / (b.uw - a.bw)::DOUBLE AS m FROM n a JOIN n b ON a.i <= b.i)",
        "least_ AS (SELECT r.a, n.i, min(r.m) AS m FROM n JOIN runs r ON r.a <= n.i AND r.b >= n.i GROUP BY r.a, n.i)",
        "fitted AS (SELECT n.x, n.w, max(l.m) AS v FROM n JOIN least_ l ON l.i = n.i GROUP BY n.x, n.w)",
        select="SELECT round(min(x), 6) AS lo, round(max(x), 6) AS hi, CAST(sum(w) AS BIGINT) AS rows, round(v, 6) AS value FROM fitted GROUP BY round(v, 6)",
    ),
)
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration curve of a model over its labelled rows, as steps."""
    steps = isotonic_steps(t.scored(spark, sf_dir), "p_v2", "y")
    return steps.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.col("weight").cast("bigint").alias("rows"), F.round("value", 6).alias("value"))
