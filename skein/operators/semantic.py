"""Text convergence: normalised text, trigrams, terms and what members share. ``m`` holds team keys, sender, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topology import KEYS


def normalize(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " ")


def trigrams(text: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))
    return F.when(F.length(text) >= 3, grams).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: F.length(x) >= 2)


def counted(m: DataFrame, kind: str) -> DataFrame:
    """gate_id, team, agent, gram, c. A payload that an agent sends again is taken apart once, and the payloads' shuffle serves every use in a plan."""
    of = trigrams if kind == "trigram" else terms
    said = m.groupBy(*KEYS, F.col("sender").alias("agent"), "payload").agg(F.count(F.lit(1)).alias("n"))
    rows = said.select(*KEYS, "agent", "n", F.explode(of(normalize(F.col("payload")))).alias("gram"))
    return rows.groupBy(*KEYS, "agent", "gram").agg(F.sum("n").alias("c"))


def cosine_pairs(m: DataFrame) -> DataFrame:
    """Trigram cosine of each pair of members, zero pairs included."""
    g = counted(m, "trigram")
    norm = g.groupBy(*KEYS, "agent").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    side = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in df.columns if c not in (*KEYS, "gram")})
    dot = side(g, "a").join(side(g, "b"), [*KEYS, "gram"]).filter("agent_a < agent_b").groupBy(*KEYS, "agent_a", "agent_b").agg(F.sum(F.col("c_a") * F.col("c_b")).alias("dot"))
    pairs = side(norm, "a").join(side(norm, "b"), KEYS).filter("agent_a < agent_b")
    met = pairs.join(dot, [*KEYS, "agent_a", "agent_b"], "left")
    return met.select(*KEYS, "agent_a", "agent_b", F.coalesce(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("cosine"))


def average_similarity(m: DataFrame) -> DataFrame:
    """The mean cosine over a team's pairs of members, without the pairs: of n unit vectors it is (the squared length of their sum, less n) over n (n - 1)."""
    g = counted(m, "trigram")
    norm = g.groupBy(*KEYS, "agent").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    total = g.join(norm, [*KEYS, "agent"]).groupBy(*KEYS, "gram").agg(F.sum(F.col("c") / F.col("norm")).alias("s")).groupBy(*KEYS).agg(F.sum(F.col("s") * F.col("s")).alias("squared"))
    n = F.col("n")
    met = total.join(norm.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS).filter("n > 1")
    return met.select(*KEYS, F.greatest(F.lit(0.0), (F.col("squared") - n) / (n * (n - 1))).alias("similarity"))


def vocabulary_overlap(m: DataFrame) -> DataFrame:
    t = counted(m, "term")
    n = t.groupBy(*KEYS).agg(F.countDistinct("agent").alias("n_members"))
    per = t.groupBy(*KEYS, "gram").agg(F.count(F.lit(1)).alias("by"))
    return per.join(n, KEYS).groupBy(*KEYS).agg((F.count_if(F.col("by") == F.col("n_members")) / F.count(F.lit(1))).alias("overlap"))


def specialized_terms(m: DataFrame, top: int = 10) -> DataFrame:
    """The first terms that two or more members use, by frequency, rarity over messages and number of members; ties by term."""
    rows = m.select("gate_id", "team", F.col("sender").alias("agent"), "seq", normalize(F.col("payload")).alias("t"))
    messages = rows.filter("t != ''").groupBy("gate_id").agg(F.count(F.lit(1)).alias("n_messages"))
    each = rows.select("gate_id", "team", "agent", "seq", F.explode(terms(F.col("t"))).alias("term"))
    df = each.select("gate_id", "seq", "term").distinct().groupBy("gate_id", "term").agg(F.count(F.lit(1)).alias("df"))
    tf = each.groupBy(*KEYS, "term").agg(F.count(F.lit(1)).alias("tf"), F.countDistinct("agent").alias("n_members")).filter("n_members >= 2")
    met = tf.join(df, ["gate_id", "term"]).join(messages, "gate_id")
    score = F.round(F.col("tf") * F.ln(F.col("n_messages") / F.col("df")) * F.col("n_members"), 6)
    w = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "term")
    return met.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*KEYS, "term", "score", "rank")


def trend(history: DataFrame, frame: int = 10) -> DataFrame:
    """Least-squares slope over the last values of a series (gate_id, x, y); 0 under three."""
    w = Window.partitionBy("gate_id").orderBy("x").rowsBetween(-(frame - 1), 0)
    slope = F.when(F.count(F.lit(1)).over(w) >= 3, F.regr_slope("y", "x").over(w)).otherwise(0.0)
    return history.select("gate_id", "x", slope.alias("trend"))


def risk(similarity: Column, overlap: Column, slope: Column, special: Column) -> Column:
    by_similarity = F.when(similarity > 0.8, 0.35).when(similarity > 0.6, 0.2).when(similarity > 0.4, 0.1).otherwise(0.0)
    by_overlap = F.when(overlap > 0.7, 0.25).when(overlap > 0.4, 0.1).otherwise(0.0)
    by_slope = F.when(slope > 0.1, 0.2).when(slope > 0.05, 0.1).otherwise(0.0)
    return by_similarity + by_overlap + by_slope + F.when(special > 5, 0.2).when(special > 2, 0.1).otherwise(0.0)
