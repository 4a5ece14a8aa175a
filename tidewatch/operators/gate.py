"""The non-inferiority gate as a long table of checks, for many cards and challengers at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.functions.numbers import short_digest
from tidewatch.functions.text import fixed
from tidewatch.operators.decisions import AUTO, ESCALATE, RETRAIN_ACTIONS

PASS, BLOCK = "PASS", "BLOCK"
# Check names in reporting order.
COVERAGE, AUROC, RECALL = "evaluation_set_present", "auroc_non_inferiority", "recall_at_top_decile"
BRIER, ECE, SUBGROUP = "brier_score", "calibration_ece", "subgroup_non_regression"
CHECK_ORDER = (COVERAGE, AUROC, RECALL, BRIER, ECE, SUBGROUP)
THRESHOLDS = ("auroc_non_inferiority_margin", "recall_top_decile_min_ratio", "max_brier_increase", "max_ece", "max_subgroup_auroc_drop")
# The shipped criteria.
CRITERIA: Mapping = {
    "criteria_version": "gate-v1",
    "auroc_non_inferiority_margin": 0.005,
    "recall_top_decile_min_ratio": 1.0,
    "max_brier_increase": 0.005,
    "max_ece": 0.05,
    "max_subgroup_auroc_drop": 0.01,
    "evaluation_sets": ["frozen_holdout", "recent_labeled_window"],
    "require_all_sets": True,
}
CRITERIA_SCHEMA = T.StructType(
    [
        T.StructField("criteria_version", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in THRESHOLDS],
        T.StructField("evaluation_sets", T.ArrayType(T.StringType())),
        T.StructField("require_all_sets", T.BooleanType()),
    ]
)
METRICS = ("roc_auc", "recall_at_top_decile", "brier_score", "expected_calibration_error")


def criteria_table(spark: SparkSession, criteria: Mapping = CRITERIA) -> DataFrame:
    return spark.createDataFrame([tuple(criteria[f.name] for f in CRITERIA_SCHEMA.fields)], CRITERIA_SCHEMA)


def pinned_criteria(cards: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each card's own recorded thresholds, under the shared protocol, with a key of the numbers."""
    protocol = criteria.select("evaluation_sets", "require_all_sets")
    pinned = cards.select("card_id", *[F.try_element_at("acceptance_criteria", F.lit(t)).alias(t) for t in THRESHOLDS])
    return pinned.withColumn("criteria_version", F.concat_ws("/", *[F.col(t).cast("string") for t in THRESHOLDS])).join(F.broadcast(protocol))


def gate_cards(
    cards: DataFrame, pairs: DataFrame, champion: DataFrame, challenger: DataFrame, champion_groups: DataFrame, challenger_groups: DataFrame, criteria: DataFrame,
) -> DataFrame:
    """Each named pair's verdict under the thresholds its card pinned; ``pairs`` is (card_id, challenger).

    A verdict depends on the pinned numbers, not on the card, so checks are made once per
    distinct set of numbers and then handed to the cards that pinned it.
    """
    pinned = pinned_criteria(cards, criteria)
    bars = pinned.drop("card_id").distinct()
    names = bars.select("criteria_version")
    judged = gate_checks(
        champion, challenger.join(names), champion_groups, challenger_groups.join(names), bars, ["criteria_version", "challenger"]
    )
    verdicts = gate_verdicts(judged, ["criteria_version", "challenger"])
    named = pinned.select("card_id", "criteria_version").join(pairs.select("card_id", "challenger").distinct(), "card_id")
    return named.join(verdicts, ["criteria_version", "challenger"]).withColumn("criteria_version", F.concat(F.lit("card:"), F.col("card_id")))


def on_own_windows(cards: DataFrame, fixed_sets: DataFrame, windows: DataFrame, window_set: str) -> DataFrame:
    """Metric rows per card: those of the sets all cards share, and those of the card's own window as ``window_set``.

    ``windows`` has one row per stream and window (and group), measured once however many cards
    ask for it: metrics are handed to cards, the rows behind them are never repeated.
    """
    own = cards.select("card_id", "scenario", "window_start")
    mine = own.join(windows, ["scenario", "window_start"]).drop("scenario", "window_start").withColumn("eval_set", F.lit(window_set))
    shared = own.select("card_id").join(fixed_sets)
    return shared.unionByName(mine.select(*shared.columns))


def gate_own_windows(
    cards: DataFrame, pairs: DataFrame, frozen: tuple[DataFrame, DataFrame], windows: tuple[DataFrame, DataFrame], criteria: DataFrame, *,
    champion: str, window_set: str = "recent_labeled_window",
) -> DataFrame:
    """Each named pair's verdict under its card's own thresholds, on the frozen sets and on the window the card is about.

    ``frozen`` and ``windows`` are (metrics, subgroup metrics) by model and eval_set, or by model, scenario and
    window_start. A window that could not be measured fails its coverage check.
    """
    pinned = pinned_criteria(cards, criteria)
    metrics, groups = (on_own_windows(cards, f, w, window_set) for f, w in zip(frozen, windows))
    named = pairs.select("card_id", "challenger").distinct()
    ours = lambda df: df.where(F.col("model") == champion).drop("model")
    theirs = lambda df: df.withColumnRenamed("model", "challenger").join(named, ["card_id", "challenger"])
    checks = gate_checks(ours(metrics), theirs(metrics), ours(groups), theirs(groups), pinned, ["card_id", "challenger"], ["card_id"])
    return gate_verdicts(checks, ["card_id", "challenger"])


def _at_least(observed: Column, required: Column) -> Column:
    return F.round(observed - required, 9) >= 0


def _at_most(observed: Column, required: Column) -> Column:
    return F.round(required - observed, 9) >= 0


def _check(name: str, passed: Column, observed: Column | None, required: Column | None, detail: Column, subgroup: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(CHECK_ORDER.index(name)).alias("check_order"),
        F.lit(name).alias("criterion"),
        passed.alias("passed"),
        (none if observed is None else observed.cast("double")).alias("observed"),
        (none if required is None else F.round(required, 9)).alias("required"),
        (F.lit(None).cast("string") if subgroup is None else subgroup).alias("subgroup"),
        detail.alias("detail"),
    )


def gate_checks(
    champion: DataFrame, challenger: DataFrame, champion_groups: DataFrame, challenger_groups: DataFrame, criteria: DataFrame,
    keys: Sequence[str] = ("challenger",), champion_keys: Sequence[str] = (),
) -> DataFrame:
    """One row per check.

    ``champion`` and its groups are keyed by eval_set and by those of the ``keys`` that
    ``champion_keys`` names, the challenger's by ``keys`` and eval_set. ``criteria`` is one row for all, or one per key (card-pinned thresholds). A set
    that either side lacks fails its coverage check when all sets are required.
    """
    keys = list(keys)
    shared = [k for k in keys if k in criteria.columns]
    metrics = ("rows", *METRICS)
    shared_set = ["eval_set", *champion_keys]
    ours = champion.select(*shared_set, *[F.col(m).alias(f"a_{m}") for m in metrics], F.lit(True).alias("has_a"))
    theirs = challenger.select(*keys, "eval_set", *[F.col(m).alias(f"b_{m}") for m in metrics], F.lit(True).alias("has_b"))
    subjects = challenger.select(*keys).distinct()
    wanted = subjects.join(criteria, shared) if shared else subjects.join(F.broadcast(criteria))
    wanted = wanted.select("*", F.posexplode("evaluation_sets").alias("set_order", "eval_set")).drop("evaluation_sets")
    paired = wanted.join(theirs, [*keys, "eval_set"], "left").join(ours, shared_set, "left")

    present = F.coalesce(F.col("has_a"), F.lit(False)) & F.coalesce(F.col("has_b"), F.lit(False))
    absent = F.when(F.col("has_a").isNull(), F.lit("champion")).otherwise(F.lit("challenger"))

    def six(c: Column) -> Column:
        return fixed(c, 6)

    def num(c: str) -> Column:
        return six(F.col(c))

    def plain(c: str) -> Column:
        return F.col(c).cast("string")

    floor_auc = F.col("a_roc_auc") - F.col("auroc_non_inferiority_margin")
    floor_recall = F.col("a_recall_at_top_decile") * F.col("recall_top_decile_min_ratio")
    top_brier = F.col("a_brier_score") + F.col("max_brier_increase")
    def against(name: str, metric: str, bound: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name} "), num(f"b_{metric}"), F.lit(", champion "), num(f"a_{metric}"), F.lit(f", {bound} "), six(value))

    checks = F.array(
        F.when(present, _check(COVERAGE, F.lit(True), F.col("b_rows"), None, F.concat(F.col("eval_set"), F.lit(" measured on "), F.col("b_rows").cast("string"), F.lit(" rows")))).otherwise(
            _check(COVERAGE, ~F.col("require_all_sets"), None, None, F.concat(F.col("eval_set"), F.lit(" lacks the "), absent, F.lit("'s metrics")))
        ),
        F.when(present, _check(AUROC, _at_least(F.col("b_roc_auc"), floor_auc), F.col("b_roc_auc"), floor_auc, against("AUROC", "roc_auc", "at least", floor_auc))),
        F.when(
            present,
            _check(RECALL, _at_least(F.col("b_recall_at_top_decile"), floor_recall), F.col("b_recall_at_top_decile"), floor_recall, against("top-decile recall", "recall_at_top_decile", "at least", floor_recall)),
        ),
        F.when(present, _check(BRIER, _at_most(F.col("b_brier_score"), top_brier), F.col("b_brier_score"), top_brier, against("Brier", "brier_score", "at most", top_brier))),
        F.when(
            present,
            _check(ECE, _at_most(F.col("b_expected_calibration_error"), F.col("max_ece")), F.col("b_expected_calibration_error"), F.col("max_ece"),
                   F.concat(F.lit("calibration error "), num("b_expected_calibration_error"), F.lit(", at most "), plain("max_ece"))),
        ),
    )
    base = [c for c in ("criteria_version", "set_order", "eval_set") if c not in keys]
    overall = paired.select(*keys, *base, F.inline(F.filter(checks, lambda c: c.isNotNull())))

    # Subgroups of every set both sides have: a union of both sides' groups, one row each.
    both = paired.where(present).select(*keys, *base, "max_subgroup_auroc_drop")
    group = ["eval_set", "column_name", "group_value"]
    before = both.join(champion_groups.select(*group, *champion_keys, F.col("roc_auc").alias("before")), shared_set).select(*keys, *group, "before", F.lit(None).cast("double").alias("after"))
    after = challenger_groups.select(*keys, *group, F.lit(None).cast("double").alias("before"), F.col("roc_auc").alias("after"))
    sides = before.unionByName(after).groupBy(*keys, *group).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    matched = both.join(sides, [*keys, "eval_set"])
    label = F.concat_ws("=", "column_name", "group_value")
    comparable = F.col("before").isNotNull() & F.col("after").isNotNull()
    floor_group = F.col("before") - F.col("max_subgroup_auroc_drop")
    side = F.when(F.col("before").isNull(), F.lit("champion")).otherwise(F.lit("challenger"))
    check = _check(
        SUBGROUP,
        ~comparable | _at_least(F.col("after"), floor_group),
        F.col("after"),
        floor_group,
        F.when(comparable, F.concat(label, F.lit(": AUROC "), num("after"), F.lit(", champion "), num("before"), F.lit(", at least "), six(floor_group))).otherwise(
            F.concat(label, F.lit(": the "), side, F.lit(" has no AUROC here, left out"))
        ),
        label,
    )
    by_group = matched.select(*keys, *base, F.inline(F.array(check)))
    return overall.unionByName(by_group)


def gate_verdicts(checks: DataFrame, keys: Sequence[str] = ("challenger",)) -> DataFrame:
    """BLOCK when any check fails, with the failed checks' reasons in reporting order."""
    reason = F.concat(F.col("criterion"), F.lit(" ["), F.col("eval_set"), F.lit("]: "), F.col("detail"))
    ordered = F.struct("set_order", "check_order", F.coalesce("subgroup", F.lit("")).alias("s"), reason.alias("reason"))
    version = [] if "criteria_version" in keys else ["criteria_version"]
    return checks.groupBy(*keys, *version).agg(
        F.when(F.bool_and("passed"), F.lit(PASS)).otherwise(F.lit(BLOCK)).alias("outcome"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed_criteria_count"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), ordered))), lambda r: r["reason"]).alias("reasons"),
    )


def worst_subgroup(champion_groups: DataFrame, challenger_groups: DataFrame, keys: Sequence[str] = ("challenger",)) -> DataFrame:
    """Largest subgroup AUC drop per set; the larger label wins a tie."""
    group = ["eval_set", "column_name", "group_value"]
    joined = challenger_groups.select(*keys, *group, F.col("roc_auc").alias("after")).join(champion_groups.select(*group, F.col("roc_auc").alias("before")), group)
    drop = F.struct(F.round(F.col("before") - F.col("after"), 6).alias("auroc_drop"), F.concat_ws("=", "column_name", "group_value").alias("subgroup"))
    usable = joined.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    return usable.groupBy(*keys, "eval_set").agg(F.max(drop).alias("w")).select(*keys, "eval_set", "w.subgroup", "w.auroc_drop")


def run_id(card: Column, mode: Column, challenger: Column) -> Column:
    text = F.concat_ws("|", card, mode, F.coalesce(challenger, F.lit("None")))
    return F.concat(F.lit("rr-"), F.regexp_replace(card, "^dc-", ""), F.lit("-"), short_digest(text))


def retrain_rows(cards: DataFrame, verdicts: DataFrame, *, join_on: Sequence[str], mode: str, champion_version: Column, created_at: Column) -> DataFrame:
    """One run per (card, challenger): the verdict projected onto its audit row."""
    joined = cards.join(verdicts, list(join_on))
    return joined.select(
        run_id(F.col("card_id"), F.lit(mode), F.col("challenger")).alias("run_id"),
        created_at.alias("created_at"),
        "card_id", "scenario", "policy_version", "action",
        F.lit(mode).alias("mode"),
        champion_version.alias("champion_version"),
        F.col("challenger").alias("challenger_version"),
        "outcome", "criteria_version", "failed_criteria_count",
        (F.col("outcome") == PASS).alias("shadow_alias_moved"),
        "reasons",
    )


def authorisation(cards: DataFrame, approvals: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Whether each card may be retrained now, and whose name would be recorded.

    ``named`` optionally gives (card_id, authorized_by) supplied by a caller. A recorded
    rejection is final.
    """
    decided = approvals.where("kind = 'RETRAIN'").select(F.col("subject").alias("card_id"), F.col("decision").alias("__decision"), F.col("approver").alias("__approver"))
    out = cards.join(decided, "card_id", "left")
    out = out.join(named.select("card_id", F.col("authorized_by").alias("__named")), "card_id", "left") if named is not None else out.withColumn("__named", F.lit(None).cast("string"))
    escalated = F.col("disposition") == ESCALATE
    person = F.when(escalated, F.coalesce(F.col("__named"), F.when(F.col("__decision") == "APPROVE", F.col("__approver")))).otherwise(F.col("__named"))
    status = (
        F.when(~F.col("action").isin(*RETRAIN_ACTIONS), F.lit("not a retrain card"))
        .when(escalated & (F.col("__decision") == "REJECT"), F.lit("rejected"))
        .when(F.col("disposition") == AUTO, F.lit("authorised"))
        .when(escalated & person.isNotNull(), F.lit("authorised"))
        .when(escalated, F.lit("needs authorisation"))
        .otherwise(F.lit("disposition authorises nothing"))
    )
    return out.withColumns({"authorisation": status, "authorized_by": F.when(status == "authorised", person)}).drop("__decision", "__approver", "__named")


def pinned_version_status(cards: DataFrame, present: DataFrame, pinned: str = "candidate_data_version") -> DataFrame:
    """ok, missing or mismatch between the data a card pinned and the data now present.

    ``present`` is one row per scenario with the data version on hand.
    """
    joined = cards.join(present.select("scenario", F.col("data_version").alias("present_version")), "scenario", "left")
    status = (
        F.when(F.col(pinned).isNull(), F.lit("ok"))
        .when(F.col("present_version").isNull(), F.lit("missing"))
        .when(F.col(pinned) != F.col("present_version"), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return joined.withColumn("version_status", status)


def approval_id(kind: Column, subject: Column) -> Column:
    return F.concat(F.lit("ap-"), F.lower(kind), F.lit("-"), subject)
