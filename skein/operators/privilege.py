"""Capability flow: declared(agent, capability), invocations(agent, capability), flows(sender, receiver, capability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import config


def laundering(flows: DataFrame, declared: DataFrame) -> DataFrame:
    """Flows of a capability that its sender declares and its receiver doesn't; repeated flows stay."""
    own = declared.select(F.col("agent").alias("sender"), "capability")
    other = declared.select(F.col("agent").alias("receiver"), "capability")
    return flows.join(own, ["sender", "capability"], "left_semi").join(other, ["receiver", "capability"], "left_anti")


def violations(invocations: DataFrame, declared: DataFrame) -> DataFrame:
    """Invocations beyond a declaration, per agent that declares anything."""
    return invocations.join(declared.select("agent").distinct(), "agent", "left_semi").join(declared, ["agent", "capability"], "left_anti")


def concentration(usage: DataFrame, key: str) -> DataFrame:
    """Of (key, agent, n): the reference form, which is never above 0, and the standard Gini coefficient."""
    w = Window.partitionBy(key)
    rows = usage.select(key, "n", F.row_number().over(w.orderBy("n", "agent")).alias("i"), F.count(F.lit(1)).over(w).alias("k"))
    g = F.sum((2 * F.col("i") - F.col("k") - 1) * F.col("n")) / (F.max("k") * F.sum("n"))
    return rows.groupBy(key).agg(F.greatest(F.lit(0.0), -g).alias("gini_reference"), F.coalesce(g, F.lit(0.0)).alias("gini_standard"))


def safety_class(capabilities: Column) -> Column:
    has = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), capabilities)) == 0
    pair = has(config.ESCALATION_PAIRS[0])
    for p in config.ESCALATION_PAIRS[1:]:
        pair = pair | has(p)
    many = F.size(F.array_intersect(F.array(*map(F.lit, config.HIGH_RISK)), capabilities)) >= config.HIGH_RISK_THRESHOLD
    return F.when(many, "HIGH_RISK").when(pair, "RESTRICTED").otherwise("STANDARD")


def risk(laundered: Column, beyond: Column, capabilities: Column, members: Column) -> Column:
    """The concentration term of the known behaviour is always 0 and left out."""
    return F.least(F.lit(0.4), 0.15 * laundered) + F.least(F.lit(0.3), 0.1 * beyond) + F.when(capabilities / members > 3, 0.15).otherwise(0.0)
