"""The trail of a replay whose gates have read many different words."""

import time

from pyspark.sql import functions as F

from skein import config
from skein.operators import trail
from skein.streaming import replay


def test_trail_of_many_messages_holds(spark):
    """30,000 messages with a word of their own each in one team: the terms of all members were counted anew at each."""
    i = F.col("id")
    m = spark.range(30_000).select(F.lit("g").alias("gate_id"), i.alias("seq"), F.when(i % 2 == 0, "a").otherwise("b").alias("sender"), F.when(i % 2 == 0, "b").otherwise("a").alias("receiver"), i.cast("double").alias("ts"), F.concat(F.lit("word"), i).alias("payload"))
    began = time.time()
    found = replay.trail(replay.replay(m, config.Settings(team_window=1e9)))
    (got,) = trail.validate(found).collect()
    assert got.valid and got.first_bad == -1 and time.time() - began < 30
