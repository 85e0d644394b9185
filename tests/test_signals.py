"""The running state of the gate against plain versions over all messages, and a cost that doesn't grow with what was read."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from skein import config
from skein.streaming import replay, signals
from skein.streaming.gate import Detector, Gate
from skein.streaming.signals import Semantic, SideChannel, Topology


@pytest.mark.parametrize("room", [1, signals.ROOM])
def test_scores_of_changing_members_equal_plain_ones(monkeypatch, room):
    monkeypatch.setattr(signals, "ROOM", room)
    rnd, said, agents = random.Random(11), [], "abcdefg"
    topology, semantic, side = Topology(), Semantic(), SideChannel()
    for i in range(400):
        s, r = rnd.choice(agents[:6]), rnd.choice(agents)
        text = " ".join(rnd.choice(("alpha", "beta", "gamma", f"w{rnd.randrange(60)}")) for _ in range(rnd.randrange(4)))
        said.append((s, r, text))
        topology.message(s, r)
        semantic.message(s, text)
        side.message(s, r, float(rnd.randrange(90)), len(text))
        members = frozenset(rnd.sample(agents, rnd.choice([2, 3, 6])))
        whole = Topology(), Semantic(), SideChannel()
        whole[1].history = semantic.history.copy()
        for k, (a, b, t) in enumerate(said if i % 8 == 0 else ()):
            whole[0].message(a, b)
            whole[1].message(a, t)
            whole[2].message(a, b, k, 1)
        if i % 8 == 0:
            assert whole[1].score(members) == semantic.score(members) and whole[0].score(members) == topology.score(members)
            assert whole[2].ordering("t", members) == side.ordering("u", members)
            inside = [(a, b) for a, b, _ in said if {a, b} <= members]
            assert side.ordering("t", members) == next((x for p in range(2, min(len(inside) // 2, 5) + 1) if (x := sum(a == inside[n % p][0] for n, (a, _) in enumerate(inside)) / len(inside)) > 0.8), 0.0) or len(inside) < 4
            words = {a: {t for b, _, text in said if b == a for t in text.split()} for a in members}
            used = [sum(t in w for w in words.values() if w) for t in set().union(*words.values())]
            kept = semantic.vocabularies.get(frozenset(members & semantic.seen))
            assert kept is None or (len(kept.by), kept.two) == (len(used), sum(c >= 2 for c in used))


def test_a_message_costs_the_same_whatever_was_read():
    """The terms of all members were counted anew at each message: 40,000 messages with a word of their own each took minutes."""
    g, began = Gate("g", config.Settings(team_window=1e9)), time.time()
    for i in range(40_000):
        (*_, last) = g.row(i, "message", *("ab" if i % 2 else "ba"), float(i), f"word{i}", None)
    assert last[9] == "STANDARD" and time.time() - began < 25


def test_few_gates_are_dealt_to_partitions_of_their_own(spark):
    """g1 and g3 hash to one partition of 4 or 8."""
    rows = spark.range(4000).select(F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("gate_id"), F.col("id").alias("seq"))
    at = replay._in_order(rows).select("gate_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == len({r.gate_id for r in at}) == len({r.p for r in at}) == 4


def test_bodies_are_json_with_sorted_keys():
    g = Gate("g\"é")
    for team, edge, payload, risk, now in (("t", ("a\\", " \""), "x", 0.1 + 0.2, 1e300), ("\n", None, "", 0.0, math.inf)):
        g.now = now
        body = g.entry(3, "FORMED", team, 7, "WARN", risk, edge, payload)[16]
        assert body == json.dumps(json.loads(body), sort_keys=True, separators=(",", ":")) and json.loads(body)["affected_edges"] == ([list(edge)] if edge else [])


def test_edges_expire_as_in_a_scan_of_all():
    rnd, d, last, now = random.Random(2), Detector(30.0, 2), {}, 0.0
    for i in range(6000):
        now += rnd.choice([-5.0, 0.0, 0.5, 1.0, 4.0])
        s, r = rnd.sample("abcdefgh", 2)
        last = {e: t for e, t in last.items() if t > now - 30.0} | {(s, r): now}
        d.edge(s, r, now, str(i))
        if i % 500 == 499:
            d.remove("c")
            last = {e: t for e, t in last.items() if "c" not in e}
        assert d.last == last and len(d.ages) <= 2 * len(last) + 1100


def test_teams_without_signals_are_those_of_the_trail(spark):
    rows, rnd = [], random.Random(4)
    for i in range(600):
        kind = rnd.choice(["message"] * 30 + ["post", "disconnect", "agent", "shutdown"])
        rows.append((rnd.choice("xy"), i, kind, rnd.choice("abcdef"), rnd.choice("abcdef"), float(i), f"m{i % 7}", '{"capabilities": ["code-exec"]}' if kind == "agent" else None))
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in replay.INPUT.items()))
    cols = ["gate_id", "seq", "event_type", "team_id", "ts", "manifest_version"]
    pick = lambda x: sorted(tuple(r) for r in x.select(cols).collect())
    settings = config.Settings(team_window=20.0)
    want = replay.replay(df, settings).filter("entry IS NOT NULL AND event_type != 'GATE_VERDICT'")
    found = pick(replay.teams(df, settings))
    assert found == pick(want) and len(found) > 100
    whole, alone = (sorted(tuple(str(x) for x in r) for r in f.collect()) for f in (replay.verdicts(replay.replay(df, settings)), replay.judged(df, settings)))
    assert whole == alone and len(whole) > 400
