"""Findings, value, counterfactuals and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Weights of the fixed linear value model.
WEIGHTS = {"hp": 0.6, "gold": 0.25, "level": 3.0, "xp": 0.05}


def state_value(weights: dict[str, float] | None = None) -> Column:
    """Value of a state as a linear expression over its player; missing parts count 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"player.{k}").cast("double"), F.lit(0.0)) * F.lit(w) for k, w in (weights or WEIGHTS).items()])


def vector_value(vector: str, weights: list[float]) -> Column:
    """Dot product of an encoded state with the weights of a learned model."""
    return F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, weights)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def rule_findings(states: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Findings of all rules (category, title, condition, severity) in one pass over the states."""
    each = [F.when(when, F.struct(F.lit(category).alias("category"), F.lit(title).alias("title"), severity.alias("severity"))) for category, title, when, severity in rules]
    hits = states.select("state_id", "match_id", "confidence", F.explode(F.array_compact(F.array(*each))).alias("f"))
    return hits.select(F.concat("state_id", F.lit(":"), "f.category").alias("finding_id"), "match_id", "f.category", "f.title", "f.severity", "confidence", F.lit("rule").alias("evidence_type"))


def state_statistics(states: DataFrame, by: str = "phase") -> DataFrame:
    """Descriptive statistics of gold and hp."""
    parts = [F.count(F.lit(1)).alias("n_states")]
    for c in ("gold", "hp"):
        x = F.col(f"player.{c}")
        x = F.when(x >= 0, x)
        parts += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"avg_{c}"), F.stddev_samp(x).alias(f"sd_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    return states.groupBy(by).agg(*parts)


def report(findings: DataFrame) -> DataFrame:
    """Findings by match and severity, with subtotals by match and a grand total (level: grouping id)."""
    return findings.rollup("match_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"), F.grouping_id().cast("bigint").alias("level"))


def expected_values(model: DataFrame, values: DataFrame, state: str, action: str, following: str) -> DataFrame:
    """Expected value of each (state, action): the model's next states weighted by probability."""
    joined = model.join(values.withColumnRenamed(state, following), following)
    return joined.groupBy(state, action).agg(F.sum(F.col("probability") * F.col("value")).alias("expected"))


def counterfactual_gaps(expected: DataFrame, state: str, action: str) -> DataFrame:
    """How far each action's expectation stays behind the best action of its state."""
    best = expected.groupBy(state).agg(F.max("expected").alias("best"))
    return expected.join(best, state).select(state, action, "expected", (F.col("best") - F.col("expected")).alias("gap"))


def actual_gaps(samples: DataFrame, expected: DataFrame, values: DataFrame, action: str, state: str, following: str) -> DataFrame:
    """Expected value of the action that was taken, less the value of the state that in fact followed: how much better or worse it could be expected to go."""
    taken = samples.join(expected.select(state, action, "expected"), [state, action])
    return taken.join(values.select(F.col(state).alias(following), F.col("value").alias("actual")), following).withColumn("gap", F.col("expected") - F.col("actual"))


def percentiles(states: DataFrame, by: str, shares: list[float]) -> DataFrame:
    """Exact percentiles of gold and hp by group."""
    made = [F.percentile(F.when(F.col(f"player.{c}") >= 0, F.col(f"player.{c}")), float(q)).alias(f"{c}_p{round(q * 100)}") for c in ("gold", "hp") for q in shares]
    return states.groupBy(by).agg(*made)


def advise(current: DataFrame, findings: DataFrame, enabled: bool) -> DataFrame:
    """One suggested action for the current state of each match; nothing unless the realtime switch is on. It reads and never writes."""
    worst = findings.groupBy("match_id").agg(F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "major", 1).otherwise(0)).alias("urgency"))
    rows = current.join(worst, "match_id", "left")
    gold, level = F.coalesce("player.gold", F.lit(0)), F.coalesce("player.level", F.lit(0))
    action = F.when(F.coalesce("urgency", F.lit(0)) >= 2, "stabilize").when((gold >= 50) & (level < 8), "level_to").when(gold < 20, "hold_economy").otherwise("roll_to_gold")
    return rows.where(F.lit(enabled)).select("match_id", "state_id", action.alias("action_type"))
