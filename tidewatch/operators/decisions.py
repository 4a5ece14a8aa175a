"""From drift events to decision cards: run lengths, confidence and the rule table.

Windows are decided as a set. A card depends on the windows before its own, which are read
with a bounded frame; nothing is decided in a loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidewatch.functions.numbers import digest_id
from tidewatch.functions.text import fixed
from tidewatch.operators.ordering import running_totals

NO_OP, ALERT_ONLY = "NO_OP", "ALERT_ONLY"
INCREMENTAL, FULL = "INCREMENTAL_RETRAIN", "FULL_RETRAIN"
RETRAIN_ACTIONS = (INCREMENTAL, FULL)
NO_DISPOSITION, AUTO, ESCALATE = "NONE", "AUTO_PROCEED_SHADOW", "ESCALATE_HUMAN"

POLICY_SCHEMA = T.StructType(
    [
        T.StructField("policy_version", T.StringType()),
        *[
            T.StructField(c, T.DoubleType())
            for c in (
                "psi_breach", "psi_severe", "auto_proceed_confidence", "matured_auroc_drop", "retrain_cooldown_days",
                "w_severity", "w_breadth", "w_persistence", "w_evidence", "severity_scale", "persistence_scale",
                "ev_matured", "ev_leading",
            )
        ],
        *[T.StructField(c, T.IntegerType()) for c in ("consecutive_windows", "alert_only_max_features", "retrain_budget")],
        T.StructField("precedence", T.ArrayType(T.IntegerType())),
        T.StructField("uncovered_action", T.StringType()),
        T.StructField("acceptance_criteria", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

# The two shipped policies. They differ in the breach threshold only.
_SHARED = dict(
    psi_severe=0.25, auto_proceed_confidence=0.75, matured_auroc_drop=0.03, retrain_cooldown_days=7.0,
    w_severity=0.35, w_breadth=0.20, w_persistence=0.20, w_evidence=0.25, severity_scale=0.5, persistence_scale=3.0,
    ev_matured=1.0, ev_leading=0.5, consecutive_windows=2, alert_only_max_features=2, retrain_budget=1,
    precedence=[5, 4, 3, 2, 1], uncovered_action=ALERT_ONLY,
    acceptance_criteria={
        "auroc_non_inferiority_margin": 0.005,
        "recall_top_decile_min_ratio": 1.0,
        "max_brier_increase": 0.005,
        "max_ece": 0.05,
        "max_subgroup_auroc_drop": 0.01,
    },
)
POLICIES: tuple[Mapping, ...] = (
    dict(policy_version="policy-v1", psi_breach=0.10, **_SHARED),
    dict(policy_version="policy-v2", psi_breach=0.20, **_SHARED),
)


def policy_table(spark: SparkSession, policies: Sequence[Mapping] = POLICIES) -> DataFrame:
    """One row per policy version; a handful of rows, so it is always broadcast."""
    return spark.createDataFrame([tuple(p[f.name] for f in POLICY_SCHEMA.fields) for p in policies], POLICY_SCHEMA)


# --- history ----------------------------------------------------------------------------
def breaching_names(stats: Column, threshold: Column) -> Column:
    hit = F.filter(stats, lambda s: s["feature"].isNotNull() & (s["psi"] >= threshold))
    return F.transform(hit, lambda s: s["feature"])


def breach_list(stats: Column, threshold: Column) -> Column:
    """Breaching features with their statistics, worst first, then by name."""
    hit = F.filter(stats, lambda s: s["feature"].isNotNull() & (s["psi"] >= threshold))
    keyed = F.transform(hit, lambda s: F.struct((-s["psi"]).alias("order"), s["feature"].alias("feature"), s["psi"].alias("psi"), s["ks_p_value"].alias("ks_p")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["feature"].alias("feature"), s["psi"].alias("psi"), s["ks_p"].alias("ks_p")))


STREAKS = "policy_version string, scenario string, feature string, run bigint"


def _feature_streaks(named: DataFrame, stream: Sequence[str], start: str, carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stream, feature, __at, __base) of starts at which all rows breach a feature, and the numbered starts.

    ``__at`` numbers a stream's starts and ``__rows`` counts the rows before a start. A streak is
    a run of numbers without a gap; ``__base`` is the count of rows before its first start. A
    streak that begins with the frame goes on from the ``carried`` one: its base lies before the frame.
    """
    starts = named.groupBy(*stream, start).agg(F.count(F.lit(1)).alias("__n"), F.first(F.lit(1)).alias("__one"))
    placed = running_totals(starts, stream, start, ["__n", "__one"])
    placed = placed.select(*stream, start, "__n", F.col("__one_before").alias("__at"), F.col("__n_before").alias("__rows"))
    hits = named.select(*stream, start, F.explode(F.array_distinct("breaching")).alias("feature")).groupBy(*stream, start, "feature").agg(F.count(F.lit(1)).alias("__hits"))
    held = hits.join(placed, [*stream, start]).where("__hits = __n").withColumn("__one", F.lit(1))
    held = running_totals(held, [*stream, "feature"], start, ["__one"]).withColumn("__streak", F.col("__at") - F.col("__one_before"))
    base = held.groupBy(*stream, "feature", "__streak").agg(F.min("__rows").alias("__base"))
    if carried is not None:
        base = base.join(carried, [*stream, "feature"], "left").withColumn("__base", F.when(F.col("__base") == 0, -F.coalesce("run", F.lit(0))).otherwise(F.col("__base"))).drop("run")
    return held.join(base, [*stream, "feature", "__streak"]).select(*stream, "feature", "__at", "__base"), placed


def breach_runs(events: DataFrame, policies: DataFrame, limit: int | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Events x policies with the breaching names, run length and persistent features.

    A run is the longest unbroken row of windows, up to this one, in which one feature breaches; the
    features that hold it are persistent. It is found per feature, as streaks of consecutive window
    starts, so no window gathers its past. Rows that share a start are not each other's past; all
    count for later ones, for which a feature holds if all of them breach it. ``limit`` looks back
    over at most so many rows. ``carried`` (``STREAKS``) holds the streaks that were open before
    the first event, as ``streaks_after`` returns them.
    """
    stream = ["policy_version", "scenario"]
    crossed = events.join(F.broadcast(policies))
    named = crossed.withColumn("breaching", breaching_names(F.col("feature_stats"), F.col("psi_breach")))
    streaks, placed = _feature_streaks(named, stream, "window_start", carried)
    past = streaks.withColumn("__at", F.col("__at") + 1).withColumnRenamed("__base", "__before")
    if carried is not None:
        past = past.unionByName(carried.select(*stream, "feature", F.lit(0).cast("bigint").alias("__at"), (-F.col("run")).alias("__before")))
    own = named.select(*stream, "event_id", "window_start", F.explode(F.array_distinct("breaching")).alias("feature"))
    own = own.join(placed.select(*stream, "window_start", "__at", "__rows"), [*stream, "window_start"]).join(past, [*stream, "feature", "__at"], "left")
    run = F.coalesce(F.col("__rows") - F.col("__before"), F.lit(0)) + 1
    run = run if limit is None else F.least(run, F.lit(limit + 1))
    runs = own.select(*stream, "event_id", "window_start", "feature", run.cast("int").alias("__run"))
    longest = runs.groupBy(*stream, "event_id", "window_start").agg(
        F.max("__run").alias("__longest"), F.collect_set(F.struct("__run", "feature")).alias("__each")  # one per monitored feature
    )
    kept = F.array_sort(F.transform(F.filter("__each", lambda x: x["__run"] == F.col("__longest")), lambda x: x["feature"]))
    found = longest.select(*stream, "event_id", "window_start", F.col("__longest").alias("consecutive_breaching_windows"), kept.alias("persistent_features"))
    none = F.array().cast("array<string>")
    return named.join(found, [*stream, "event_id", "window_start"], "left").withColumns(
        {"consecutive_breaching_windows": F.coalesce("consecutive_breaching_windows", F.lit(0)), "persistent_features": F.coalesce("persistent_features", none)}
    )


def streaks_after(events: DataFrame, policies: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """The streaks (``STREAKS``) open after the last window of each stream, to carry to the events that follow.

    Streams without a new event keep what they carried. The result has at most one row per
    policy, stream and feature, however long the history is.
    """
    stream = ["policy_version", "scenario"]
    named = events.join(F.broadcast(policies)).withColumn("breaching", breaching_names(F.col("feature_stats"), F.col("psi_breach")))
    streaks, placed = _feature_streaks(named, stream, "window_start", carried)
    last = placed.groupBy(*stream).agg(F.max("__at").alias("__at"), F.sum("__n").alias("__all"))
    now = streaks.join(last, [*stream, "__at"]).select(*stream, "feature", (F.col("__all") - F.col("__base")).cast("bigint").alias("run"))
    if carried is None:
        return now
    return now.unionByName(carried.join(last, stream, "left_anti").select(*stream, "feature", "run"))


# --- evidence and confidence --------------------------------------------------------------
def evidence(
    events: DataFrame, policies: DataFrame, *, retrains: DataFrame | None = None, matured: DataFrame | None = None, carried: DataFrame | None = None
) -> DataFrame:
    """Everything the rule table reads. Retrain history, matured labels and carried streaks are off by default."""
    runs = breach_runs(events, policies, carried=carried)
    if retrains is None:
        runs = runs.withColumns({"days_since_last_retrain": F.lit(None).cast("double"), "retrains_in_cooldown": F.lit(0).cast("bigint")})
    else:
        runs = runs.join(retrains, ["scenario", "window_start"], "left").na.fill({"retrains_in_cooldown": 0})
    if matured is None:
        runs = runs.withColumns({"labels_matured": F.lit(False), "matured_auroc_drop_seen": F.lit(None).cast("double")})
    else:
        runs = runs.join(matured, ["scenario", "window_start"], "left").na.fill({"labels_matured": False})
    stats_max = F.array_max(F.transform("feature_stats", lambda s: s["psi"]))
    monitored = F.when(F.col("policy_thresholds.monitored_features") > 0, F.col("policy_thresholds.monitored_features")).otherwise(F.size("feature_stats"))
    return runs.withColumns(
        {
            "observed_max_psi": F.coalesce(F.col("max_psi"), stats_max, F.lit(0.0)),
            "monitored_feature_count": monitored,
            "breach_count": F.size("breaching"),
        }
    )


def _capped(x: Column, scale: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(0.0)) / scale, F.lit(1.0))


def with_confidence(df: DataFrame) -> DataFrame:
    """Four terms, each rounded for the record; their weighted sum is taken before rounding."""
    monitored = F.col("monitored_feature_count")
    breadth = F.when(monitored <= 0, F.lit(0.0)).otherwise(
        F.least(F.try_divide(F.greatest(F.col("breach_count"), F.lit(0)).cast("double"), monitored.cast("double")), F.lit(1.0))
    )
    terms = {
        "severity": _capped(F.col("observed_max_psi"), F.col("severity_scale")),
        "breadth": breadth,
        "persistence": _capped(F.col("consecutive_breaching_windows"), F.col("persistence_scale")),
        "evidence": F.when(F.col("labels_matured"), F.col("ev_matured")).otherwise(F.col("ev_leading")),
    }
    total = sum((F.col(f"w_{name}") * term for name, term in terms.items()), F.lit(0.0))
    return df.withColumns({**{name: F.round(t, 6) for name, t in terms.items()}, "confidence": F.round(total, 6)})


def confidence_ceiling(policies: DataFrame, matured: bool = False) -> DataFrame:
    top = F.col("ev_matured") if matured else F.col("ev_leading")
    total = F.col("w_severity") + F.col("w_breadth") + F.col("w_persistence") + F.col("w_evidence") * top
    return policies.select("policy_version", F.round(total, 6).alias("ceiling"))


# --- the rule table -----------------------------------------------------------------------
def _outcome(rule: str, action: Column | str, disposition: Column | str, rationale: Column) -> Column:
    def c(x: Column | str) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(F.lit(rule).alias("rule_id"), c(action).alias("action"), c(disposition).alias("disposition"), rationale.alias("rationale"))


def _text(number: Column) -> Column:
    return number.cast("string")


def apply_rules(df: DataFrame) -> DataFrame:
    """Adds rule_id, action, disposition, rationale and downgraded_from.

    Every rule yields its outcome or null; the first non-null one in the policy's precedence
    stands. The cooldown and budget downgrade is applied to whatever stands.
    """
    n, drift = F.col("breach_count"), F.col("prediction_drift")
    worst = F.get(F.col("breaches"), 0)
    top = F.array_max(F.transform("breaches", lambda b: b["psi"]))
    run = F.col("consecutive_breaching_windows")
    severe = F.coalesce(top >= F.col("psi_severe"), F.lit(False))
    enough = F.col("confidence") >= F.col("auto_proceed_confidence")
    breach, conf = F.col("psi_breach"), F.col("confidence")

    quiet = F.when(
        (n == 0) & ~drift,
        _outcome("1", NO_OP, NO_DISPOSITION, F.concat(F.lit("quiet window: all features stay below PSI "), _text(breach), F.lit(", scores steady"))),
    )
    mild = F.when(
        (n >= 1) & ~drift & (n <= F.col("alert_only_max_features")) & ~severe & (run < F.col("consecutive_windows")),
        _outcome("2", ALERT_ONLY, NO_DISPOSITION, F.concat(_text(n), F.lit(" mild breach(es) in PSI ["), _text(breach), F.lit(", "), _text(F.col("psi_severe")), F.lit("), not yet repeated: alert"))),
    )
    persistent = F.when(
        (run >= F.col("consecutive_windows")) & (F.size("persistent_features") > 0),
        _outcome("3", INCREMENTAL, AUTO, F.concat(F.lit("over the limit "), _text(run), F.lit(" windows in a row: "), F.array_join("persistent_features", ", "))),
    )
    trigger = F.when(severe, F.concat(worst["feature"], F.lit(" severe at PSI "), fixed(worst["psi"], 4))).otherwise(
        F.concat(F.lit("scores moved, PSI "), F.coalesce(fixed(F.col("prediction_psi"), 4), F.lit("unknown")))
    )
    strong = F.when(
        severe | drift,
        _outcome(
            "4", FULL, F.when(enough, F.lit(AUTO)).otherwise(F.lit(ESCALATE)),
            F.concat(trigger, F.lit("; confidence "), fixed(conf, 4), F.when(enough, F.lit(" reaches ")).otherwise(F.lit(" misses ")), _text(F.col("auto_proceed_confidence"))),
        ),
    )
    regressed = F.when(
        F.col("labels_matured") & (F.col("matured_auroc_drop_seen") > F.col("matured_auroc_drop")),
        _outcome("5", FULL, ESCALATE, F.concat(F.lit("labels are in: AUROC lost "), fixed(F.col("matured_auroc_drop_seen"), 4), F.lit(", allowed "), _text(F.col("matured_auroc_drop")))),
    )
    fallback = _outcome(
        "uncovered", F.col("uncovered_action"), NO_DISPOSITION,
        F.concat(_text(n), F.lit(" breach(es) of PSI "), _text(breach), F.lit(" fit no rule of "), F.col("policy_version"), F.lit(": "), F.col("uncovered_action")),
    )
    df = df.withColumn("breaches", breach_list(F.col("feature_stats"), F.col("psi_breach")))
    df = df.withColumn("__rules", F.array(quiet, mild, persistent, strong, regressed))
    by_precedence = F.transform("precedence", lambda r: F.get(F.col("__rules"), r - 1))
    df = df.withColumn("__picked", F.coalesce(F.get(F.filter(by_precedence, lambda o: o.isNotNull()), 0), fallback))

    retrain = F.col("__picked.action").isin(*RETRAIN_ACTIONS)
    recent = F.coalesce(F.col("days_since_last_retrain") < F.col("retrain_cooldown_days"), F.lit(False))
    spent = F.col("retrains_in_cooldown") >= F.col("retrain_budget")
    why = F.when(
        recent, F.concat(F.lit("last retrain "), fixed(F.col("days_since_last_retrain"), 2), F.lit(" days ago, cooldown "), _text(F.col("retrain_cooldown_days").cast("int")))
    ).otherwise(F.concat(F.lit("retrains used "), _text(F.col("retrains_in_cooldown")), F.lit(" of "), _text(F.col("retrain_budget"))))
    downgraded = F.when(
        retrain & (recent | spent), _outcome("6", ALERT_ONLY, ESCALATE, F.concat(F.col("__picked.action"), F.lit(" held back, "), why))
    )
    final = F.coalesce(downgraded, F.col("__picked"))
    return df.withColumn("__final", final).withColumns(
        {
            "rule_id": F.col("__final.rule_id"),
            "action": F.col("__final.action"),
            "disposition": F.col("__final.disposition"),
            "rationale": F.col("__final.rationale"),
            "downgraded_from": F.when(downgraded.isNotNull(), F.col("__picked.action")),
        }
    ).drop("__final", "__picked", "__rules")


def card_id(event: Column, policy: Column, window_start: Column) -> Column:
    return digest_id("dc", F.date_format(window_start, "yyyy-MM-dd"), F.concat_ws("|", event, policy))


def decide(events: DataFrame, policies: DataFrame, *, created_at: Column | None = None, candidate_data_version: str | None = None, **history: DataFrame) -> DataFrame:
    """Decision cards for every event under every policy, in one plan."""
    ruled = apply_rules(with_confidence(evidence(events, policies, **history)))
    thresholds = F.create_map(
        *[x for c in ("psi_breach", "psi_severe", "auto_proceed_confidence", "matured_auroc_drop", "retrain_cooldown_days") for x in (F.lit(c), F.col(c))]
    )
    status = F.when(F.col("action").isin(*RETRAIN_ACTIONS), F.lit("OPEN")).otherwise(F.lit("CLOSED"))
    return ruled.select(
        card_id(F.col("event_id"), F.col("policy_version"), F.col("window_start")).alias("card_id"),
        (created_at if created_at is not None else F.col("created_at")).alias("created_at"),
        "policy_version",
        F.col("event_id").alias("drift_event_id"),
        "scenario", "window_start", "window_end", "action", "disposition", "rule_id", "rationale", "downgraded_from",
        "confidence",
        F.struct("severity", "breadth", "persistence", "evidence").alias("confidence_breakdown"),
        F.struct(
            F.col("event_id").alias("drift_event_id"), "scenario", "window_start", "window_end",
            F.col("breaches").alias("breaching_features"), "prediction_drift", "prediction_psi",
            F.col("observed_max_psi").alias("max_psi"), "monitored_feature_count", "consecutive_breaching_windows",
            "persistent_features", F.when(F.col("labels_matured"), F.lit("matured")).otherwise(F.lit("leading_indicators")).alias("label_maturity"),
            F.col("matured_auroc_drop_seen").alias("matured_auroc_drop"), F.col("policy_thresholds").alias("measured_thresholds"),
        ).alias("trigger"),
        F.col("prediction_drift"), F.lit(candidate_data_version).cast("string").alias("candidate_data_version"),
        "model_version", "data_version", "acceptance_criteria", thresholds.alias("policy_thresholds"), status.alias("status"),
    )


def undecided(events: DataFrame, cards: DataFrame, policy: str, *, scenario: str | None = None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Windows a policy has not decided yet, oldest first."""
    done = cards.where(F.col("policy_version") == policy).select(F.col("drift_event_id").alias("event_id"))
    waiting = events.join(done, "event_id", "left_anti")
    if scenario is not None:
        waiting = waiting.where(F.col("scenario") == scenario)
    if since is not None:
        waiting = waiting.where(F.col("window_start") >= since)
    waiting = waiting.orderBy("scenario", "window_start", "event_id")
    return waiting.limit(limit) if limit is not None else waiting


def retrain_history(windows: DataFrame, runs: DataFrame, cooldown_days: float) -> DataFrame:
    """Per window: days since the stream's last retrain and retrains within the cooldown.

    Runs and windows are merged into one ordered stream of running totals (how many runs so
    far), so the last run before a window is found by its number, without a range join.
    """
    micros = 86_400.0 * 1_000_000
    w = windows.select("scenario", F.unix_micros("window_start").alias("t")).distinct()
    r = runs.groupBy("scenario", F.unix_micros("created_at").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    edges = w.select("scenario", (F.col("t") - F.lit(int(cooldown_days * micros))).alias("t"))
    grid = (
        r.select("scenario", "t", "n").unionByName(w.withColumn("n", F.lit(0).cast("bigint"))).unionByName(edges.withColumn("n", F.lit(0).cast("bigint")))
        .groupBy("scenario", "t").agg(F.sum("n").alias("n"))
    )
    counted = running_totals(grid, ["scenario"], "t", ["n"])
    last = counted.where("n > 0").select("scenario", F.col("n_upto").alias("k"), F.col("t").alias("last_run"))
    at = counted.select("scenario", "t", F.col("n_before").alias("before"))
    placed = w.join(at, ["scenario", "t"]).withColumn("edge", F.col("t") - F.lit(int(cooldown_days * micros)))
    early = at.select("scenario", F.col("t").alias("edge"), F.col("before").alias("before_edge"))
    joined = placed.join(early, ["scenario", "edge"]).withColumnRenamed("before", "k").join(last, ["scenario", "k"], "left")
    return joined.select(
        "scenario",
        F.timestamp_micros("t").alias("window_start"),
        ((F.col("t") - F.col("last_run")) / micros).alias("days_since_last_retrain"),
        (F.col("k") - F.col("before_edge")).alias("retrains_in_cooldown"),
    )
