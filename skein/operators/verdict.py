"""Composite risk, bands, severities and the token bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import config


def composite(scores: list[Column], weight: float = config.WEIGHT) -> Column:
    """1 minus the product of what each family leaves."""
    left = F.lit(1.0)
    for s in scores:
        left = left * (1 - weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    return 1 - left


def band(score: Column) -> Column:
    out = F.when(score < config.BANDS[0][0], config.BANDS[0][1])
    for upto, name in config.BANDS[1:]:
        out = out.when(score < upto, name)
    return out.otherwise("TERMINATE")


def severity(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, config.VERDICTS)), verdict).cast("int") - 1


def worst(verdicts: list[Column]) -> Column:
    return F.element_at(F.array(*map(F.lit, config.VERDICTS)), F.greatest(*map(severity, verdicts)) + 1)


def token_bucket(m: DataFrame, capacity: float = config.THROTTLE_CAPACITY, refill: float = config.THROTTLE_REFILL) -> DataFrame:
    """Per edge, in arrival order: messages let through and refused. A fold over each edge's sorted times."""
    start = F.struct(F.lit(capacity).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("passed"))

    def step(a, x):
        tokens = F.least(F.lit(capacity), a["tokens"] + F.greatest(F.lit(0.0), x["ts"] - F.coalesce(a["last"], x["ts"])) * refill)
        ok = tokens >= 1
        return F.struct((tokens - ok.cast("double")).alias("tokens"), x["ts"].alias("last"), (a["passed"] + ok.cast("int")).alias("passed"))

    g = m.groupBy("sender", "receiver").agg(F.array_sort(F.collect_list(F.struct("seq", "ts"))).alias("x"))
    passed = F.aggregate("x", start, step)["passed"]
    return g.select("sender", "receiver", passed.alias("passed"), (F.size("x") - passed).alias("refused"))


def policy(capabilities: Column, scores: dict[str, Column], policies: list[dict]) -> Column:
    """The most severe of what active policies ask for: ISOLATE where a blocked capability is held, a family's minimum where its score is over
    a half. Policies are configuration: they become literals of the plan."""
    asked = [F.lit("ALLOW")]
    for p in policies:
        if not p.get("active", True):
            continue
        if p.get("blocked_capabilities"):
            held = F.arrays_overlap(capabilities, F.array(*map(F.lit, p["blocked_capabilities"])))
            asked.append(F.when(F.coalesce(held, F.lit(False)), "ISOLATE").otherwise("ALLOW"))
        for family, least in (p.get("signal_minimums") or {}).items():
            if family in scores:
                asked.append(F.when(scores[family] > 0.5, least).otherwise("ALLOW"))
    return worst(asked) if len(asked) > 1 else asked[0]


def safety_minimum(safety: Column) -> Column:
    return F.when(safety == "HIGH_RISK", "THROTTLE").when(safety == "RESTRICTED", "WARN").otherwise("ALLOW")
