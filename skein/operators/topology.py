"""Graph shape of each team's messages. ``m`` holds gate_id, team, sender, receiver; a team's members are the agents it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detector

KEYS = ["gate_id", "team"]


def members(m: DataFrame) -> DataFrame:
    return m.select(*KEYS, F.explode(F.array("sender", "receiver")).alias("agent")).distinct()


def density(m: DataFrame) -> DataFrame:
    """Messages over possible edges, and the distinct-edge variant."""
    n = members(m).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    e = m.groupBy(*KEYS, "sender", "receiver").agg(F.count(F.lit(1)).alias("c")).groupBy(*KEYS).agg(F.sum("c").alias("n_messages"), F.count(F.lit(1)).alias("n_edges"))
    most = F.col("n") * (F.col("n") - 1)
    ratio = lambda c: F.when(F.col("n") > 1, F.col(c) / most).otherwise(0.0)
    return e.join(n, KEYS).select(*KEYS, "n", "n_messages", ratio("n_messages").alias("density"), ratio("n_edges").alias("density_distinct"))


def degrees(m: DataFrame) -> DataFrame:
    """Per member: distinct peers in and out."""
    edges = m.select(*KEYS, "sender", "receiver").distinct()
    out = edges.groupBy(*KEYS, F.col("sender").alias("agent")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(*KEYS, F.col("receiver").alias("agent")).agg(F.count(F.lit(1)).alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return members(m).join(out, [*KEYS, "agent"], "left").join(into, [*KEYS, "agent"], "left").select(*KEYS, "agent", zero("n_out"), zero("n_in"))


def degree_stats(m: DataFrame) -> DataFrame:
    """The skew, deviation over maximum, comes from integer sums: the same in any order of rows."""
    d = degrees(m).withColumn("total", F.col("n_in") + F.col("n_out"))
    n, total, squares = F.count(F.lit(1)), F.sum("total"), F.sum(F.col("total") * F.col("total"))
    skew = F.when((n > 1) & (F.max("total") > 0), F.sqrt(n * squares - total * total) / (n * F.max("total"))).otherwise(0.0)
    return d.groupBy(*KEYS).agg(F.max("n_out").alias("max_out"), F.max("n_in").alias("max_in"), F.avg("total").alias("avg_degree"), skew.alias("degree_skew"))


def clustering(m: DataFrame) -> DataFrame:
    """Mean share of linked neighbour pairs over members, 0 under two neighbours or three members. An agent that writes to itself is a
    neighbour of its own, linked to each of the others.

    Edges point from the agent of the lesser degree to that of the greater, so a hub with all its peers makes no wedges; each triangle is found
    once and counts for its three corners.
    """
    und = m.filter("sender != receiver").select(*KEYS, F.least("sender", "receiver").alias("u"), F.greatest("sender", "receiver").alias("v")).distinct()
    k = und.select(*KEYS, F.explode(F.array("u", "v")).alias("agent")).groupBy(*KEYS, "agent").agg(F.count(F.lit(1)).alias("k"))
    loops = m.filter("sender = receiver").select(*KEYS, F.col("sender").alias("agent"), F.lit(1).alias("loop")).distinct()
    degree = lambda c: k.select(*KEYS, F.struct(F.col("k"), F.col("agent")).alias(c), F.col("agent").alias(c[1:]))
    ranked = und.join(degree("_u"), [*KEYS, "u"]).join(degree("_v"), [*KEYS, "v"])
    out = ranked.select(*KEYS, F.least("_u", "_v").alias("x"), F.greatest("_u", "_v").alias("y"))
    wedge = out.join(out.select(*KEYS, "x", F.col("y").alias("z")), [*KEYS, "x"]).filter("y < z")
    found = wedge.join(out.select(*KEYS, F.col("x").alias("y"), F.col("y").alias("z")), [*KEYS, "y", "z"])
    tri = found.select(*KEYS, F.explode(F.array("x.agent", "y.agent", "z.agent")).alias("agent")).groupBy(*KEYS, "agent").agg(F.count(F.lit(1)).alias("tri"))
    own = members(m).join(k, [*KEYS, "agent"], "left").join(loops, [*KEYS, "agent"], "left").join(tri, [*KEYS, "agent"], "left").na.fill(0, ["k", "loop", "tri"])
    n = F.col("k") + F.col("loop")
    c = F.when(n >= 2, (F.col("tri") + F.col("loop") * F.col("k")) / (n * (n - 1) / 2)).otherwise(0.0)
    return own.groupBy(*KEYS).agg(F.when(F.count(F.lit(1)) >= 3, F.avg(c)).otherwise(0.0).alias("clustering"))


def topology(m: DataFrame) -> DataFrame:
    """All measures, the class, the number of coalitions and the risk of each team."""
    t = density(m).join(degree_stats(m), KEYS).join(clustering(m), KEYS).join(coalitions(m), KEYS)
    d, s, n = F.col("density"), F.col("degree_skew"), F.col("n")
    kind = (
        F.when(n < 2, "degenerate")
        .when((s > 0.6) & (F.greatest("max_out", "max_in") >= n - 1), "star")
        .when((d > 0.7) & (s < 0.3), "mesh")
        .when((n >= 3) & F.col("avg_degree").between(1.5, 2.5) & (s < 0.2), "ring")
        .when((d > 0.3) & (d < 0.7) & (s > 0.3), "hierarchical")
        .otherwise("unclassified")
    )
    t = t.withColumn("class", kind)
    part = F.when(d > 0.85, 0.25).when((d < 0.15) & (n > 2), 0.15).otherwise(0.0)
    of_class = F.create_map(*[F.lit(x) for kv in {"star": 0.35, "hierarchical": 0.15, "mesh": 0.10, "ring": 0.05, "unclassified": 0.10, "degenerate": 0.0}.items() for x in kv])
    risk = part + s * 0.25 + of_class[F.col("class")] + F.when((F.col("clustering") > 0.8) & (n > 3), 0.15).otherwise(0.0)
    c = F.col("n_coalitions")
    risk = risk + F.when(c > 1, F.least(F.lit(0.3), 0.15 * c)).otherwise(0.0)
    return t.withColumn("risk", F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), risk)))


def coalitions(m: DataFrame) -> DataFrame:
    """Per team: components of two or more members; a single one in a team of four or more counts as two where members above its mean degree
    and the rest are two at least each; otherwise a single one counts as none."""
    edges = m.filter("sender != receiver").select(*KEYS, F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).distinct()
    name = F.to_json(F.struct(*KEYS))
    parts = detector.teams(edges.select(name.alias("gate_id"), "a", "b")).select("gate_id", "agent", F.col("team").alias("part"))
    degree = edges.select(name.alias("gate_id"), F.explode(F.array("a", "b")).alias("agent")).groupBy("gate_id", "agent").agg(F.count(F.lit(1)).alias("k"))
    loops = m.filter("sender = receiver").select(name.alias("gate_id"), F.col("sender").alias("agent"), F.lit(1).alias("loop")).distinct()
    rows = parts.join(degree, ["gate_id", "agent"]).join(loops, ["gate_id", "agent"], "left").withColumn("k", F.col("k") + F.coalesce("loop", F.lit(0)))
    part = rows.groupBy("gate_id", "part").agg(F.avg("k").alias("mean"))
    high = F.count_if(F.col("k") > F.col("mean"))
    by_part = rows.join(part, ["gate_id", "part"]).groupBy("gate_id", "part").agg(high.alias("high"), (F.count(F.lit(1)) - high).alias("low"))
    team = by_part.groupBy("gate_id").agg(F.count(F.lit(1)).alias("parts"), F.max("high").alias("high"), F.max("low").alias("low"))
    sizes = members(m).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    met = sizes.withColumn("key", name).join(team.withColumnRenamed("gate_id", "key"), "key", "left")
    split = (F.col("n") >= 4) & (F.col("high") >= 2) & (F.col("low") >= 2)
    n = F.when(F.col("n") < 3, 0).when(F.col("parts") > 1, F.col("parts")).when(split, 2).otherwise(0)
    return met.select(*KEYS, n.cast("long").alias("n_coalitions"))
