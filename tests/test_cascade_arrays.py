"""Chains over arrays: agents as bits, few steps for chains that have met everybody, teams read by the hash of their names."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skein.operators import cascade
from tests.test_cascade import NAMES, plain


@pytest.mark.parametrize("bits", [0, 63])
def test_agents_as_bits_or_in_rows(spark, monkeypatch, bits):
    """Teams of 2, 63 and 64 agents, with equal times, null sequence numbers and hops of an agent to itself."""
    monkeypatch.setattr(cascade, "BITS", bits)
    rnd, hops, want = random.Random(bits), [], {}
    for k in (2, 63, 64):
        agents = [f"a{i:02}" for i in range(k)]
        who = agents + [rnd.choice(agents) for _ in range(200)]
        mine = [("g", f"t{k}", i, s, rnd.choice(agents), float(rnd.randrange(90)), rnd.choice(["safe"] * 9 + ["bad"]), rnd.choice([0, 1, 3]), i % 9 == 0, i % 50 == 7) for i, s in enumerate(who)]
        hops += mine
        want[f"t{k}"] = plain(mine)
    rnd.shuffle(hops)
    got = {r.team: (r.n_chains, r.n_deceptive, r.max_length, r.score) for r in cascade.chains(spark.createDataFrame(hops, NAMES)).collect()}
    assert got == want


def test_a_chain_that_met_everybody_is_followed_no_further(monkeypatch):
    """Two agents write to each other: no chain goes on, so no hop is looked for."""
    looked = []
    has = getattr(cascade._Team, "has", lambda *a: None)
    monkeypatch.setattr(cascade._Team, "has", lambda self, met, agents: looked.append(len(agents)) or has(self, met, agents), raising=False)
    n, i = 1000, np.arange(1000)
    team = cascade._Team(i % 2, 1 - i % 2, i * 1.0, np.ones(n, bool), np.zeros(n, int), np.zeros(2, bool))
    assert team.counted() == (0, 0, 0) and team.bits and not sum(looked)


def test_teams_whose_hashes_clash_are_read_apart():
    rows = pa.RecordBatch.from_pydict({"gate_id": ["g", None, "g", "g", None], "team": ["x", "x", None, "x", "x"], "seq": [0, 1, 2, 3, 4]})
    assert {k: p.column("seq").to_pylist() for k, p in cascade._apart(rows)} == {("g", "x"): [0, 3], (None, "x"): [1, 4], ("g", None): [2]}


def test_rows_are_sorted_by_one_number(spark):
    """The hash of gate and team, a radix sort, and not by their names, the time and the sequence number; a team's own order is made from its arrays."""
    plan = cascade.chains(spark.createDataFrame([("g", "t", 0, "a", "b", 1.0, "safe", 1, False, False)], NAMES))._jdf.queryExecution().executedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "Sort [" in x]
    assert line.count("ASC") == 1
