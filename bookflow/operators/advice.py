"""Advice: rules over facts, the few numbers that analyses come down to.

A fact is a row (fact, value, names); a rule holds or not for the facts at hand. A fact that is missing or null
makes no rule hold. Everything stays a plan: facts are aggregates of the operators' results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generalization import day_stability, per_day, walk_forward
from .regimes import regime_name


def fact(df: DataFrame, name: str, value: Column, names: Column | None = None) -> DataFrame:
    """One row from an aggregate: a number, and names that go with it."""
    return df.agg(value.cast("double").alias("value"), (F.lit(None) if names is None else names).cast("string").alias("names")).select(F.lit(name).alias("fact"), "value", "names")


def together(*facts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, facts)


def one_row(facts: DataFrame) -> DataFrame:
    """(value, names): all facts as two maps; there are as many as rules ask for."""
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("fact", c)))
    return facts.agg(entries("value").alias("value"), entries("names").alias("names"))


def value(name: str) -> Column:
    return F.try_element_at("value", F.lit(name))


def names(name: str) -> Column:
    return F.try_element_at("names", F.lit(name))


def decide(facts: DataFrame, rules: list[tuple[str, str, Column, Column | str]]) -> DataFrame:
    """(topic, code, detail) of the rules (topic, code, condition, detail) that hold."""
    cells = [F.when(holds, F.struct(F.lit(topic).alias("topic"), F.lit(code).alias("code"), (F.lit(said) if isinstance(said, str) else said).cast("string").alias("detail"))) for topic, code, holds, said in rules]
    return one_row(facts).select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")


def first_names(c: Column, holds: Column, many: int = 3) -> Column:
    """The first names, in order, of the rows for which something holds."""
    return F.array_join(F.slice(F.sort_array(F.collect_set(F.when(holds, c))), 1, many), ", ")


def regime_facts(stats: DataFrame, season: DataFrame, importance: DataFrame) -> DataFrame:
    """From regime statistics, signals' seasonality and the regimes' importance."""
    dependent = F.col("is_regime_dependent")
    return together(
        fact(importance, "importance_ratio", F.max("importance") / (F.min("importance") + 1e-10), regime_name(F.min_by("regime", F.struct(-F.col("importance"), "regime")))),
        fact(season, "regime_dependent_signals", F.count_if(dependent), first_names(F.col("signal"), dependent)),
        fact(stats, "label_deviation_ratio", F.max("label_std") / (F.min("label_std") + 1e-10), regime_name(F.min_by("regime", F.struct(-F.col("label_std"), "regime")))),
        fact(stats, "closed_samples", F.coalesce(F.sum(F.when(F.col("regime") == 4, F.col("n_samples"))), F.lit(0))),
    )


def regime_rules() -> list[tuple[str, str, Column, Column | str]]:
    topic, ratio = "training", value("importance_ratio")
    return [
        (topic, "regime_matters", ratio > 2, F.concat(F.lit("signals predict best in "), names("importance_ratio"))),
        (topic, "regime_stable", ratio <= 2, "signals predict alike in all regimes"),
        (topic, "regime_dependent_signals", value("regime_dependent_signals") > 0, names("regime_dependent_signals")),
        (topic, "label_deviation_varies", value("label_deviation_ratio") > 1.5, F.concat(F.lit("labels vary most in "), names("label_deviation_ratio"))),
        (topic, "closed_samples", value("closed_samples") > 0, F.concat(value("closed_samples").cast("long").cast("string"), F.lit(" samples are outside market hours"))),
    ]


def regime_advice(stats: DataFrame, season: DataFrame, importance: DataFrame) -> DataFrame:
    return decide(regime_facts(stats, season, importance), regime_rules())


def generalization_facts(long: DataFrame, signal: str) -> DataFrame:
    """Stability over days of all signals, walk-forward accuracy of one. No fold: accuracy 0."""
    days = per_day(long)
    each = day_stability(days)
    signs = days.groupBy("signal").agg((F.bool_or(F.col("r") > 0) & F.bool_or(F.col("r") < 0)).alias("flips"))
    return together(
        fact(days, "n_days", F.count_distinct("date")),
        fact(each, "stability_score", F.avg("stability_score")),
        fact(each, "unstable_signals", F.count_if(~F.col("is_stable")), first_names(F.col("signal"), ~F.col("is_stable"))),
        fact(signs, "flipping_signals", F.count_if("flips"), first_names(F.col("signal"), F.col("flips"))),
        fact(walk_forward(long, signal), "walk_forward_accuracy", F.coalesce(F.avg("accuracy"), F.lit(0.0))),
    )


def assessment(stability: Column, accuracy: Column) -> Column:
    """How well signals carry over between days."""
    return F.when((stability > 2) & (accuracy > 0.35), "GOOD").when((stability > 1) | (accuracy > 0.35), "MODERATE").otherwise("POOR")


def generalization(facts: DataFrame) -> DataFrame:
    """One row (n_days, overall_stability_score, walk_forward_avg_accuracy, generalization_assessment); below three days there is none."""
    s, a = value("stability_score"), value("walk_forward_accuracy")
    one = one_row(facts).where(value("n_days") >= 3)
    return one.select(value("n_days").cast("long").alias("n_days"), s.alias("overall_stability_score"), a.alias("walk_forward_avg_accuracy"), assessment(s, a).alias("generalization_assessment"))


def generalization_advice(facts: DataFrame) -> DataFrame:
    topic, enough = "generalization", value("n_days") >= 3
    return decide(
        facts,
        [
            (topic, "normalize_by_day", enough & (value("stability_score") < 1.5), "signals change from day to day; normalize by day or adapt the model"),
            (topic, "unstable_signals", enough & (value("unstable_signals") > 0), names("unstable_signals")),
            (topic, "low_walk_forward_accuracy", enough & (value("walk_forward_accuracy") < 0.35), "a threshold on one signal does not predict"),
            (topic, "flipping_signals", enough & (value("flipping_signals") > 0), names("flipping_signals")),
            (topic, "few_days", enough & (value("n_days") < 10), F.concat(value("n_days").cast("long").cast("string"), F.lit(" days are few"))),
        ],
    )


def label_facts(distribution: DataFrame, quality: DataFrame) -> DataFrame:
    return together(fact(distribution, "stable_pct", F.max("stable_pct")), fact(quality, "is_clean", F.max(F.col("is_clean").cast("int"))))


def signal_facts(components: DataFrame, redundant: DataFrame, groups: DataFrame, share: float = 0.9) -> DataFrame:
    """From principal components, redundant pairs and predictive groups."""
    own = lambda g: fact(groups, f"{g}_signals", F.count_if(F.col("group") == g), first_names(F.col("signal"), F.col("group") == g))
    return together(
        fact(components, "components_for_90", F.min(F.when(F.col("cumulative") >= share - 1e-12, F.col("component") + 1))),
        fact(components, "n_signals", F.max(F.size("loadings"))),
        fact(redundant, "redundant_pairs", F.count("*")),
        own("primary"),
        own("low_priority"),
    )


def temporal_facts(persistence: DataFrame, decays: DataFrame, leads: DataFrame) -> DataFrame:
    return together(
        fact(persistence, "mean_half_life", F.avg("half_life")),
        fact(decays, "persistent_predictors", F.count_if(F.col("half_life") > 10)),
        fact(leads, "leading_pairs", F.count_if("is_significant")),
    )


def sequence_model(max_acf_lag: int = 100) -> tuple[Column, Column]:
    """Whether a sequence model is justified, and the look-back: twice the mean half-life between 50 and the lags looked at."""
    half = value("mean_half_life")
    return (half > 10) | (value("persistent_predictors") > 0) | (value("leading_pairs") > 0), F.greatest(F.lit(50), F.least((half * 2).cast("int"), F.lit(max_acf_lag)))


def training_advice(facts: DataFrame, max_acf_lag: int = 100) -> DataFrame:
    """(topic, code, detail) for data, features, model and training, and what to do first, from the facts of all analyses."""
    stable, clean, pairs = value("stable_pct"), value("is_clean"), value("redundant_pairs")
    score, accuracy = value("stability_score"), value("walk_forward_accuracy")
    justified, back = sequence_model(max_acf_lag)
    number = lambda c, d=2: F.format_number(c, d)
    return decide(
        facts,
        [
            ("data", "imbalanced_labels", stable > 80, F.concat(number(stable, 1), F.lit("% of the labels are Stable; weight or resample the others"))),
            ("data", "clean", clean == 1, "no NaN or infinite values"),
            ("data", "not_clean", clean == 0, "there are NaN or infinite values"),
            ("features", "few_components", value("components_for_90") < value("n_signals") * 0.6, F.concat(number(value("components_for_90"), 0), F.lit(" components hold 90% of the variance"))),
            ("features", "redundant_pairs", pairs > 3, F.concat(number(pairs, 0), F.lit(" pairs of signals are redundant"))),
            ("features", "primary_signals", value("primary_signals") > 0, names("primary_signals")),
            ("features", "low_priority_signals", value("low_priority_signals") > 0, names("low_priority_signals")),
            ("model", "sequence_model", justified, F.concat(F.lit("look back "), back.cast("string"), F.lit(" samples"))),
            ("model", "tabular_model", ~justified, "there is little structure in time"),
            ("training", "low_stability", score < 0.5, "regularize and validate across days"),
            ("training", "good_stability", score > 0.8, "signals carry over between days"),
            ("training", "predictive_baseline", accuracy > 0.4, F.concat(F.lit("a threshold alone is right in "), number(accuracy * 100, 1), F.lit("%"))),
            *regime_rules(),
            ("first", "balance_labels", stable > 80, "before training"),
            ("first", "reduce_signals", pairs > 5, "select signals or use components"),
            ("first", "regularize", score < 0.5, "stop early, too"),
        ],
    )
