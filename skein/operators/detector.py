"""Bidirectional pairs inside a sliding window, and the teams that they form."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import config


def pair_hits(m: DataFrame, window: float = config.TEAM_WINDOW) -> DataFrame:
    """Messages that complete a pair: gate_id, a < b, seq, ts. The latest message the other way arrived under ``window`` seconds ago.

    One shuffle by pair and one pass in arrival order; no self-join.
    """
    rows = m.filter("sender != receiver").select(
        "gate_id", F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b"), (F.col("sender") < F.col("receiver")).alias("up"), "seq", "ts"
    )
    w = Window.partitionBy("gate_id", "a", "b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda up: F.last(F.when(F.col("up") == up, F.col("ts")), ignorenulls=True).over(w)
    rows = rows.withColumn("other", F.when(F.col("up"), last(F.lit(False))).otherwise(last(F.lit(True))))
    return rows.filter(F.col("ts") - F.col("other") < window).select("gate_id", "a", "b", "seq", "ts")


def bidirectional_pairs(m: DataFrame, window: float = config.TEAM_WINDOW) -> DataFrame:
    return pair_hits(m, window).groupBy("gate_id", "a", "b").agg(F.min("ts").alias("formed_at"), F.count(F.lit(1)).alias("n_hits"))


def alive_intervals(m: DataFrame, window: float = config.TEAM_WINDOW) -> DataFrame:
    """Stretches in which a pair is kept alive: hits under ``window`` seconds apart."""
    w = Window.partitionBy("gate_id", "a", "b").orderBy("seq")
    hits = pair_hits(m, window).withColumn("new", F.coalesce(F.col("ts") - F.lag("ts").over(w) >= window, F.lit(True)).cast("int"))
    return (
        hits.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("gate_id", "a", "b", "island")
        .agg(F.min("ts").alias("starts"), (F.max("ts") + window).alias("ends"), F.count(F.lit(1)).alias("n_hits"))
    )


def teams(pairs: DataFrame) -> DataFrame:
    """gate_id, agent, team: components of the pairs, named by their least agent. Labels spread by joins until none changes; each
    round is cut from its lineage by a checkpoint in the shared folder."""
    spark = pairs.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))  # local mode: one machine
    both = pairs.select("gate_id", F.col("a").alias("agent"), F.col("b").alias("peer")).unionByName(pairs.select("gate_id", F.col("b").alias("agent"), F.col("a").alias("peer")))
    both = both.checkpoint()
    labels = both.groupBy("gate_id", "agent").agg(F.least("agent", F.min("peer")).alias("team")).checkpoint()
    while True:
        seen = both.join(labels.select("gate_id", F.col("agent").alias("peer"), F.col("team").alias("t")), ["gate_id", "peer"]).groupBy("gate_id", "agent").agg(F.min("t").alias("t"))
        spread = labels.join(seen, ["gate_id", "agent"]).select("gate_id", "agent", F.least("team", "t").alias("team"), (F.col("t") < F.col("team")).alias("moved")).checkpoint()
        labels = spread.drop("moved")
        if spread.filter("moved").isEmpty():
            return labels


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the value of the latest row of ``right`` of its key at or before it: both sides in one order per key, no range join."""
    w = Window.partitionBy(key).orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = right.select(key, at, value, F.lit(0).alias("kind")).unionByName(left.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("kind = 1").drop("kind")
