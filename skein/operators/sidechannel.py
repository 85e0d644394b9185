"""Timing, length and order of messages on directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["sender", "receiver"]  # of one gate; ``by`` names what else an edge belongs to


def delays(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by, *EDGE).orderBy("ts", "seq")
    return m.select(*by, *EDGE, "seq", "ts", (F.col("ts") - F.lag("ts").over(w)).alias("delay"))


def _spacing(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge of three or more messages: n, and its delays' mean and sample deviation. The mean is the span over n - 1: exact in any order of rows."""
    span = (F.max("ts") - F.min("ts")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    return delays(m, by).groupBy(*by, *EDGE).agg(F.count(F.lit(1)).alias("n"), span.alias("mean"), F.stddev_samp("delay").alias("sd")).filter("n >= 3")


def timing(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge of three or more messages: regularity, 1 minus the sample coefficient of variation of its delays."""
    d = _spacing(m, by)
    reg = F.when(F.col("mean") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / F.col("mean"))))
    return d.select(*by, *EDGE, "n", "mean", reg.alias("regularity"))


def parity(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge of five or more lengths: how far the even share is from a half."""
    g = m.groupBy(*by, *EDGE).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("length") % 2 == 0).cast("int")).alias("even")).filter("n >= 5")
    return g.select(*by, *EDGE, "n", (F.abs(F.col("even") - 0.5) * 2).alias("deviation"))


def modular(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge and modulus: chi-square of the lengths' remainders over n * modulus, by the identity that needs no empty cells, of integers
    with one division: the same in any order of rows."""
    rows = m.select(*by, *EDGE, "length", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8))).alias("modulus"))
    cells = rows.groupBy(*by, *EDGE, "modulus", (F.col("length") % F.col("modulus")).alias("r")).agg(F.count(F.lit(1)).alias("o"))
    g = cells.groupBy(*by, *EDGE, "modulus").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("sq")).filter("n >= 5")
    return g.select(*by, *EDGE, "modulus", "n", ((F.col("sq") * F.col("modulus") - F.col("n") * F.col("n")) / (F.col("n") * F.col("n") * F.col("modulus"))).alias("score"))


def clustering(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge of five or more lengths: the share of the most common one."""
    c = m.groupBy(*by, *EDGE, "length").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*by, *EDGE).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("share")).filter("n >= 5")


#: The length measures, and above which score each is flagged.
LENGTH_FLAGS = {"parity": 0.7, "mod3": 0.5, "mod5": 0.5, "mod8": 0.5, "clustering": 0.5}


def length_flags(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge of five or more messages, a column for each length measure: its score where that is flagged, else null."""
    p = parity(m, by).select(*by, *EDGE, F.lit("parity").alias("k"), F.col("deviation").alias("s"))
    q = modular(m, by).select(*by, *EDGE, F.concat(F.lit("mod"), F.col("modulus").cast("string")).alias("k"), F.least(F.lit(1.0), "score").alias("s"))
    c = clustering(m, by).select(*by, *EDGE, F.lit("clustering").alias("k"), F.col("share").alias("s"))
    every = p.unionByName(q).unionByName(c).groupBy(*by, *EDGE)
    return every.agg(*[F.max(F.when((F.col("k") == k) & (F.col("s") > above), F.col("s"))).alias(k) for k, above in LENGTH_FLAGS.items()])


def length_score(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge: the mean of the flagged length scores, added in a fixed order; 0 if none is flagged."""
    total, n = F.lit(0.0), F.lit(0)
    for k in LENGTH_FLAGS:
        total, n = total + F.coalesce(k, F.lit(0.0)), n + F.col(k).isNotNull().cast("int")
    return length_flags(m, by).select(*by, *EDGE, F.when(n > 0, total / n).otherwise(0.0).alias("length_score"))


def request_response(conv: DataFrame) -> DataFrame:
    """Share of message pairs (0, 1), (2, 3), ... of a conversation that answer each other."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    rows = conv.select("conv_id", (F.row_number().over(w) - 1).alias("i"), "sender", "receiver", F.lead("sender").over(w).alias("s2"), F.lead("receiver").over(w).alias("r2"))
    ok = (F.col("i") % 2 == 0) & (F.col("sender") == F.col("r2")) & (F.col("receiver") == F.col("s2"))
    g = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("mutual")).filter("n >= 4")
    return g.select("conv_id", "n", (F.col("mutual") / F.floor(F.col("n") / 2)).alias("ratio"))


def periodic_sender(conv: DataFrame) -> DataFrame:
    """The first period of 2 to 5, at most half the messages, at which over 0.8 of the senders repeat the opening ones; its ratio, or 0."""
    w = Window.partitionBy("conv_id")
    rows = conv.select("conv_id", "sender", (F.row_number().over(w.orderBy("seq")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    tried = rows.withColumn("p", F.explode(F.array(*map(F.lit, range(2, 6))))).filter("p <= n div 2")
    head = rows.filter("i < 5").select("conv_id", F.col("i").alias("k"), F.col("sender").alias("opening"))
    met = tried.withColumn("k", F.col("i") % F.col("p")).join(head, ["conv_id", "k"])
    ratio = met.groupBy("conv_id", "p").agg(F.avg((F.col("sender") == F.col("opening")).cast("int")).alias("r")).filter("r > 0.8")
    best = ratio.groupBy("conv_id").agg(F.min_by("r", "p").alias("r"), F.min("p").alias("period"))
    every = rows.filter("n >= 4").select("conv_id").distinct()
    return every.join(best, "conv_id", "left").select("conv_id", F.coalesce("r", F.lit(0.0)).alias("score"), F.coalesce("period", F.lit(0)).alias("period"))


def timing_patterns(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge of three or more messages with a pattern: their names, zero delay, high regularity (over 0.85) and fixed period (variation under 0.05)."""
    d = _spacing(m, by)
    edge, cv = F.concat(F.col("sender"), F.lit("->"), F.col("receiver")), F.col("sd") / F.col("mean")
    zero = F.when(F.col("mean") == 0, F.concat(F.lit("timing:zero_delay:"), edge))
    steady = F.when((F.col("mean") > 0) & (cv < 0.15), F.concat(F.lit("timing:high_regularity:"), edge))
    period = F.when((F.col("mean") > 0) & (cv < 0.05), F.format_string("timing:periodic:%s:period=%.3fs", edge, F.col("mean")))
    return d.select(*by, *EDGE, F.array_join(F.array_compact(F.array(zero, steady, period)), ";").alias("patterns")).filter("patterns != ''")


def ordering(conv: DataFrame) -> DataFrame:
    """Per conversation of four or more messages: the share at which senders repeat, or where they don't, three tenths of the share of answered pairs
    if that is over 0.8."""
    met = periodic_sender(conv).join(request_response(conv), "conv_id")
    answered = F.when(F.col("ratio") > 0.8, 0.3 * F.col("ratio")).otherwise(0.0)
    named = F.when(F.col("score") > 0, F.concat(F.lit("ordering:periodic_sender:period="), F.col("period").cast("string"))).when(F.col("ratio") > 0.8, "ordering:strict_request_response")
    return met.select("conv_id", F.when(F.col("score") > 0, F.col("score")).otherwise(answered).alias("ordering"), named.alias("pattern"))


def length_patterns(m: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Per edge with a flagged length measure: the names of what is flagged."""
    edge = F.concat(F.col("sender"), F.lit("->"), F.col("receiver"))
    even = m.groupBy(*by, *EDGE).agg(F.avg((F.col("length") % 2 == 0).cast("int")).alias("even"))
    names = [F.when(F.col("parity").isNotNull(), F.format_string("length:parity_bias:%s:ratio=%.2f", edge, F.col("even")))]
    names += [F.when(F.col(f"mod{k}").isNotNull(), F.concat(F.lit("length:modular:"), edge, F.lit(f":mod={k}"))) for k in (3, 5, 8)]
    names.append(F.when(F.col("clustering").isNotNull(), F.concat(F.lit("length:clustering:"), edge)))
    met = length_flags(m, by).join(even, [*by, *EDGE])
    return met.select(*by, *EDGE, F.array_join(F.array_compact(F.array(*names)), ";").alias("patterns")).filter("patterns != ''")


def team_scores(m: DataFrame) -> DataFrame:
    """Per team, over (gate_id, team, sender, receiver, seq, ts, length): the mean regularity of its edges, the mean of all flagged length scores, the
    ordering score, and the family's risk."""
    keys = ["gate_id", "team"]
    team = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_messages"))
    time = timing(m, keys).groupBy(*keys).agg(F.avg("regularity").alias("timing"))
    flags = length_flags(m, keys).select(*keys, F.explode(F.array_compact(F.array(*LENGTH_FLAGS))).alias("s")).groupBy(*keys).agg(F.avg("s").alias("length"))
    turns = ordering(m.select(F.struct(*keys).alias("conv_id"), "seq", "sender", "receiver")).select("conv_id.*", "ordering")
    met = team.join(time, keys, "left").join(flags, keys, "left").join(turns, keys, "left").na.fill(0.0, ["timing", "length", "ordering"])
    scores = [F.round(c, 6) for c in ("timing", "length", "ordering")]  # means of floats, which come in any order
    return met.select(*keys, *[c.alias(n) for c, n in zip(scores, ("timing", "length", "ordering"), strict=True)], risk(*scores).alias("risk"))


def risk(regularity: Column, lengths: Column, order: Column) -> Column:
    by_time = F.when(regularity > 0.9, 0.4).when(regularity > 0.7, 0.25).when(regularity > 0.5, 0.1).otherwise(0.0)
    by_length = F.when(lengths > 0.7, 0.35).when(lengths > 0.4, 0.2).when(lengths > 0.2, 0.1).otherwise(0.0)
    return by_time + by_length + F.when(order > 0.7, 0.25).when(order > 0.4, 0.15).otherwise(0.0)
