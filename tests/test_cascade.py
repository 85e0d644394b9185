"""Greedy chains over arrays: the same as the gate's running state finds, in a time that follows the hops, and with nulls."""

import random
import time

import numpy as np
import pytest

from skein.operators import cascade
from skein.streaming.signals import Cascade

NAMES = "gate_id string, team string, seq int, sender string, receiver string, ts double, safety_label string, transforms int, derived boolean, injected boolean"


def plain(hops):
    found, who = Cascade(), set()
    for _, _, _, s, r, ts, label, moved, derived, injected in hops:
        found.hop(s, r, ts, label, moved, derived)
        if injected:
            found.injected[s] += 1
        who |= {s, r}
    met = list(found.chains(who))
    return len(met), sum(found.deceptive(a, h) for a, h in met), max((len(h) for _, h in met), default=0), found.score(who)


@pytest.mark.parametrize("looks", [0, 1, 8])
def test_chains_equal_the_running_state(spark, monkeypatch, looks):
    monkeypatch.setattr(cascade, "LOOKS", looks)
    rnd, hops, want = random.Random(looks), [], {}
    for k, agents in enumerate(("ab", "abc", "abcdef", "abcdefghijklmnop")):
        mine = []
        for i in range(150):
            s, r = rnd.choice(agents), rnd.choice(agents[: rnd.choice([2, len(agents)])])
            mine.append(("g", f"t{k}", i, s, r, float(rnd.randrange(60)), rnd.choice(["safe"] * 9 + ["bad"]), rnd.choice([0, 0, 1, 3]), i % 9 == 0, rnd.random() < 0.02))
        hops += mine
        want[f"t{k}"] = plain(mine)
    rnd.shuffle(hops)
    got = {r.team: (r.n_chains, r.n_deceptive, r.max_length, r.score) for r in cascade.chains(spark.createDataFrame(hops, NAMES)).collect()}
    assert got == want


def test_many_hops_of_a_small_team_take_a_time_that_follows_their_number():
    """Once a chain has met all three agents there is nothing left to follow: looking for it hop by hop took hours for a million."""
    n = 300_000
    rnd = np.random.default_rng(1)
    sender = rnd.integers(0, 3, n)
    receiver = (sender + rnd.integers(1, 3, n)) % 3
    began = time.time()
    found, _, longest = cascade._Team(sender, receiver, np.arange(n) * 1.0, np.ones(n, bool), np.zeros(n, int), np.zeros(3, bool)).counted()
    assert longest == 2 and n - 100 < found <= n and time.time() - began < 30


def test_chains_of_nulls(spark):
    hops = [
        ("g", "t", 0, "a", "b", 1.0, "safe", 6, True, None), ("g", "t", 1, "b", "c", None, "safe", 1, False, False), ("g", "t", 2, "b", "d", 2.0, "safe", None, None, False),
        ("g", "t", 3, "d", None, 3.0, None, 1, True, False), (None, None, 0, None, "a", None, None, None, None, None),
    ]
    got = {r.team: (r.n_chains, r.n_deceptive, r.max_length) for r in cascade.chains(spark.createDataFrame(hops, NAMES)).collect()}
    assert got == {"t": (1, 1, 2), None: (0, 0, 0)}


def test_cascade_risk_of_a_large_team(spark, tmp_path):
    """60,000 hops among six agents of one gate."""
    from pyspark.sql import functions as F

    from skein.plans import catalogue, derived  # noqa: F401

    i = F.col("id")
    events = spark.range(60_000).select((i * 4).alias("event_id"), F.timestamp_seconds(i * 7).cast("timestamp_ntz").alias("ts"), (i * 31 % 6).alias("user_id"), F.lit("view").alias("event_type"), (i * 37 % 200).cast("double").alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    began = time.time()
    (got,) = catalogue.QUERIES["cascade_risk"](spark, str(tmp_path)).collect()
    assert (got.gate_id, got.team) == ("g0", "t0") and 0 < got.risk <= 1 and time.time() - began < 20
