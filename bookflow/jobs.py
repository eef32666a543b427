"""Analyses as jobs: named plans over one canonical frame, checks of their results, JSON and text sinks.

A stage is a dictionary of small DataFrames. Plans run when a sink writes them, but for what needs the small
matrix of signals on the driver (components, variance inflation, clusters, stationarity). Every plan is over all
rows unless `first_rows` was asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import advice, correlation, distribution, generalization, labels, overview, predictive, quality, regimes, temporal
from .operators.frames import long_form
from .schema import LABELS

Stage = dict[str, DataFrame]

#: What a session for large inputs should have; lags, folds and ranks are bounded by parameters of the operators.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The earliest rows by the global order: a sampling operator."""
    return df.where(F.col("gidx") < n)


def label_stage(df: DataFrame, signals: list[str], max_lag: int = 100) -> Stage:
    series = df.select(F.lit("label").alias("signal"), "gidx", F.col("label").cast("double").alias("value"))
    return {
        "distribution": quality.label_distribution(df),
        "autocorrelation": labels.autocorrelation(series, max_lag),
        "transitions": labels.transitions(df),
        "regimes": labels.regime_label_stats(df, signals[0]),
        "correlations": labels.signal_label_correlations(long_form(df, signals)),
    }


def overview_stage(df: DataFrame, signals: list[str]) -> Stage:
    long = long_form(df, signals)
    splits = {"splits": overview.overview(df, signals)} if "split" in df.columns else {}
    return splits | {
        "days": labels.day_statistics(df),
        "quality": quality.data_quality(long),
        "label_distribution": quality.label_distribution(df),
        "column_stats": quality.column_stats(long),
        "size": df.agg(F.count("*").alias("n_samples"), F.count_distinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date")),
    }


def signal_stage(df: DataFrame, signals: list[str], redundant: float = 0.7) -> Stage:
    long, matrix = long_form(df, signals), correlation.correlation_matrix(df, signals)
    return {
        "distribution": distribution.distribution_stats(long),
        "stationarity": distribution.stationarity(long),
        "rolling": distribution.rolling_stats(long),
        "matrix": matrix,
        "redundant_pairs": correlation.redundant_pairs(matrix, redundant),
        "components": correlation.pca(df, signals),
        "variance_inflation": correlation.vif(df, signals),
        "clusters": correlation.clusters(matrix, signals),
    }


def predictive_stage(df: DataFrame, signals: list[str], expected: dict[str, str] | None = None, top: int = 4) -> Stage:
    """Bins are of the `top` signals of the greatest r, its sign included."""
    long = long_form(df, signals)
    metrics = predictive.signal_metrics(long, expected)
    best = metrics.orderBy(F.desc("pearson_r"), "signal").limit(top).select("signal")
    return {
        "metrics": metrics.orderBy(F.desc(F.abs("pearson_r")), "signal"),
        "groups": predictive.predictive_groups(metrics),
        "bins": predictive.binned_probabilities(long).join(F.broadcast(best), "signal", "left_semi"),
    }


def temporal_stage(df: DataFrame, signals: list[str], max_acf_lag: int = 100, max_lag: int = 20) -> Stage:
    long = long_form(df, signals)
    out = {
        "persistence": temporal.persistence(long, max_acf_lag),
        "lead_lag": temporal.lead_lag(temporal.cross_correlation(df, signals, max_lag)),
        "decays": temporal.decay_summary(temporal.predictive_decay(long)),
        "level_vs_change": temporal.level_vs_change(long),
    }
    facts = advice.temporal_facts(out["persistence"], out["decays"], out["lead_lag"])
    justified, back = advice.sequence_model(max_acf_lag)
    why = [advice.value(f).alias(f) for f in ("mean_half_life", "persistent_predictors", "leading_pairs")]
    return out | {"facts": facts, "summary": advice.one_row(facts).select(justified.alias("sequence_model_justified"), back.alias("optimal_lookback"), *why)}


def generalization_stage(df: DataFrame, signals: list[str]) -> Stage:
    """Stability of all signals; the first is the one that predicts."""
    long = long_form(df, signals)
    facts = advice.generalization_facts(long, signals[0])
    days = generalization.per_day(long)
    return {
        "days": labels.day_statistics(df),
        "signal_days": days,
        "stability": generalization.day_stability(days),
        "walk_forward": generalization.walk_forward(long, signals[0]),
        "facts": facts,
        "summary": advice.generalization(facts),
        "advice": advice.generalization_advice(facts),
    }


def regime_stage(df: DataFrame, signals: list[str], expected: dict[str, str] | None = None) -> Stage:
    stats, by = regimes.regime_stats(df), regimes.regime_correlations(long_form(df, signals), expected)
    season, importance = regimes.seasonality(by), regimes.regime_importance(by)
    facts = advice.regime_facts(stats, season, importance)
    return {"regimes": stats, "correlations": by, "seasonality": season, "importance": importance, "facts": facts, "advice": advice.decide(facts, advice.regime_rules())}


def analyze(df: DataFrame, signals: list[str], expected: dict[str, str] | None = None) -> dict[str, Stage]:
    """All stages, and the advice that follows from their facts."""
    out = {
        "overview": overview_stage(df, signals),
        "labels": label_stage(df, signals),
        "signals": signal_stage(df, signals),
        "predictive": predictive_stage(df, signals, expected),
        "temporal": temporal_stage(df, signals),
        "generalization": generalization_stage(df, signals),
        "regimes": regime_stage(df, signals, expected),
    }
    facts = training_facts(df, signals, expected)
    return out | {"training": {"facts": facts, "advice": advice.training_advice(facts)}}


def training_facts(df: DataFrame, signals: list[str], expected: dict[str, str] | None = None, redundant: float = 0.7) -> DataFrame:
    """The facts that advice on training needs, from the cheapest plans that give them: no ranks, no information.

    About twenty plans read the frame, so it is computed once and kept by the executors (in memory or on their disks).
    """
    df = df.persist()
    long, r = long_form(df, signals), F.col("r")
    sign = F.lit(None).cast("string")
    for name, e in (expected or {}).items():
        sign = F.when(F.col("signal") == name, e).otherwise(sign)
    own = correlation.finite_correlation(long, ("signal",)).select("signal", r.alias("pearson_r"), F.when(sign == "+", r > 0).when(sign == "-", r < 0).alias("sign_consistent"))
    temporal_ = temporal.decay_summary(temporal.predictive_decay(long)), temporal.lead_lag(temporal.cross_correlation(df, signals, 20))
    by = regimes.regime_correlations(long)
    return advice.together(
        advice.label_facts(quality.label_distribution(df), quality.data_quality(long)),
        advice.signal_facts(correlation.pca(df, signals), correlation.redundant_pairs(correlation.correlation_matrix(df, signals), redundant), predictive.predictive_groups(own)),
        advice.temporal_facts(temporal.persistence(long), *temporal_),
        advice.generalization_facts(long, signals[0]),
        advice.regime_facts(regimes.regime_stats(df), regimes.seasonality(by), regimes.regime_importance(by)),
    )


def save_json(stages: dict[str, Stage], path: str) -> None:
    """A folder of JSON lines per result: path/stage/result. The stages' own results are small; the writing is Spark's."""
    for stage, results in stages.items():
        for name, df in results.items():
            df.write.mode("overwrite").json(f"{path.rstrip('/')}/{stage}/{name}")


def read_json(spark: SparkSession, stages: dict[str, Stage], path: str) -> dict[str, Stage]:
    """What save_json wrote, with the schemas of the plans, so that a report or further rules need not compute it again."""
    return {s: {n: spark.read.schema(df.schema).json(f"{path.rstrip('/')}/{s}/{n}") for n, df in results.items()} for s, results in stages.items()}


def report(stages: dict[str, Stage], most: int = 20) -> str:
    """The stages as text: each result a table of its first `most` rows (a report's limit, nothing is computed from it)."""
    lines = []
    for stage, results in stages.items():
        lines += [stage.upper(), "=" * len(stage)]
        for name, df in results.items():
            rows = df.limit(most + 1).collect()
            lines += ["", name, "-" * len(name)]
            cells = [df.columns, *[[_cell(v) for v in r] for r in rows[:most]]]
            wide = [max(map(len, c)) for c in zip(*cells)]
            lines += ["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in cells]
            lines += ["..."] * (len(rows) > most)
        lines.append("")
    return "\n".join(lines)


def _cell(v: object) -> str:
    if isinstance(v, float):
        return f"{v:.4f}" if 1e-3 <= abs(v) < 1e6 or v == 0 else f"{v:.3e}"
    return "[" + ", ".join(map(_cell, v)) + "]" if isinstance(v, list) else str(v)


def save_report(spark: SparkSession, stages: dict[str, Stage], path: str, most: int = 20) -> None:
    """The report as a text file in the folder `path`."""
    spark.createDataFrame([(report(stages, most),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _within(c: str, lo: float, hi: float) -> Column:
    return F.bool_and(F.col(c).isNull() | F.col(c).between(lo - 1e-9, hi + 1e-9))


def _states_add_up() -> Column:
    each = [F.coalesce(F.sum(F.when(F.col("from_label") == k, F.col("probability"))), F.lit(0.0)) for k in LABELS]
    return reduce(lambda a, b: a & b, [(F.abs(p - 1) < 1e-9) | (p == 0) for p in each])


def checks() -> list[tuple[str, str, str, Column]]:
    """(stage, result, name, aggregate that is true if the check holds, null if it says nothing): what must hold of any results."""
    counted = F.col("down_count") + F.col("stable_count") + F.col("up_count")
    share = F.abs(F.col("p_up") + F.col("p_down") + F.col("p_stable") - 1) < 1e-6
    return [
        ("overview", "label_distribution", "labels are known", F.bool_and(counted == F.col("total"))),
        ("overview", "quality", "finite, NaN and infinite values are all values", F.bool_and(F.col("finite_count") + F.col("nan_count") + F.col("inf_count") == F.col("total_values"))),
        ("overview", "column_stats", "means lie between least and greatest", F.bool_and(F.col("mean").between(F.col("min") - 1e-6 * F.abs("min"), F.col("max") + 1e-6 * F.abs("max")) | (F.col("n") == 0))),
        ("labels", "autocorrelation", "a series equals itself", F.bool_and((F.col("lag") != 0) | (F.abs(F.col("acf") - 1) < 1e-9))),
        ("labels", "transitions", "transitions add up", _states_add_up()),
        ("labels", "transitions", "states are labels", F.bool_and(F.col("from_label").isin([*LABELS]) & F.col("to_label").isin([*LABELS]))),
        ("signals", "matrix", "correlations are within one", _within("r", -1, 1)),
        ("signals", "variance_inflation", "variance inflation is at least one", F.bool_and(F.col("vif") >= 1 - 1e-9)),
        ("signals", "components", "components explain all", F.abs(F.sum("explained") - 1) < 1e-6),
        ("signals", "stationarity", "unit-root p is a probability", _within("p_value", 0, 1)),
        ("predictive", "metrics", "AUC up is a probability", _within("auc_up", 0, 1)),
        ("predictive", "metrics", "AUC down is a probability", _within("auc_down", 0, 1)),
        ("predictive", "metrics", "information is not negative", F.bool_and(F.col("mi_nats").isNull() | (F.col("mi_nats") >= 0))),
        ("predictive", "bins", "bins' shares add up", F.bool_and(share)),
        ("temporal", "persistence", "half-lives are positive", F.bool_and(F.col("half_life") > 0)),
        ("temporal", "lead_lag", "lagged correlations are within one", _within("max_correlation", -1, 1)),
        ("generalization", "walk_forward", "accuracy is a share", _within("accuracy", 0, 1)),
        ("regimes", "correlations", "correlations by regime are within one", _within("correlation", -1, 1)),
    ]


_DAYS_HOLD_ALL = "days hold all samples"


def validate(stages: dict[str, Stage]) -> DataFrame:
    """(name, passed): the checks over results that are there. An empty result passes what it says nothing about."""
    one = [stages[s][r].agg(F.coalesce(holds, F.lit(True)).alias("passed")).select(F.lit(name).alias("name"), "passed") for s, r, name, holds in checks() if r in stages.get(s, {})]
    if {"days", "size"} <= set(stages.get("overview", {})):
        days, size = stages["overview"]["days"].agg(F.sum("n_samples").alias("n")), stages["overview"]["size"]
        both = days.join(size, days["n"] == size["n_samples"], "left").agg(F.bool_and(F.col("n_samples").isNotNull()).alias("passed"))
        one.append(both.select(F.lit(_DAYS_HOLD_ALL).alias("name"), F.coalesce("passed", F.lit(True)).alias("passed")))
    return advice.together(*one)


def save_checked(stages: dict[str, Stage], path: str) -> list[str]:
    """save_json() with the checks as metrics observed on each write, so that no result is computed or read again for them. The names of the checks that fail."""
    failed, samples = [], {}
    for stage, results in stages.items():
        for result, df in results.items():
            own = {name: F.coalesce(holds, F.lit(True)).alias(name) for s, r, name, holds in checks() if (s, r) == (stage, result)}
            if stage == "overview" and result in ("days", "size"):
                own["n"] = F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n")
            seen = Observation(f"{stage}/{result}") if own else None
            (df.observe(seen, *own.values()) if seen else df).write.mode("overwrite").json(f"{path.rstrip('/')}/{stage}/{result}")
            got = seen.get if seen else {}
            if "n" in got:
                samples[result] = got.pop("n")
            failed += [name for name, passed in got.items() if not passed]
    if len(set(samples.values())) > 1:
        failed.append(_DAYS_HOLD_ALL)
    return failed
