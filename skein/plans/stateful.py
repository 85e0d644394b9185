"""Queries over the replay: no SQL, since a gate is a fold over its messages. The tests hold them against goldens and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import config
from skein.operators import trail
from skein.plans import scenarios
from skein.plans.catalogue import DAY, _messages, _round, query
from skein.streaming import replay

WIDE = config.Settings(team_window=DAY)


def _judged(spark, d):
    return replay.judged(_messages(spark, d), WIDE)


@query()
def gate_replay_verdicts(spark, d):
    return _round(_judged(spark, d))


@query()
def gate_replay_trail(spark, d):
    return trail.validate(replay.trail(replay.replay(_messages(spark, d), WIDE))).select("gate_id", "valid", "first_bad")


@query()
def team_fold_with_expiry(spark, d):
    """Teams as they formed and who joined, in a window that expires."""
    events = replay.teams(_messages(spark, d), WIDE)
    return events.groupBy("gate_id", "team_id").agg(F.count_if(F.col("event_type") == "MEMBER_JOINED").alias("n_joined"), F.min("ts").alias("formed_at"), F.max("manifest_version").alias("version"))


@query()
def verdict_counts(spark, d):
    return _judged(spark, d).groupBy("gate_id", "verdict", "safety_class").agg(F.count(F.lit(1)).alias("n"))


@query()
def conformance_report(spark, d):
    """The scenarios, both ways, each with a gate of its own; a scenario passes if its positive reaches the least verdict and its negative is let through."""
    return scenarios.report(spark)
