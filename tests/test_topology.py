"""The risk of a team against the replay's, which has the sub-coalition term of the reference."""

import math

from skein.operators import topology
from skein.plans import catalogue
from skein.streaming import signals

SF = "/root/testdata/sf0.001"


def by_replay(rows):
    """(gate, team) -> risk, coalitions"""
    out = {}
    for key in {(r.gate_id, r.team) for r in rows}:
        own = [r for r in rows if (r.gate_id, r.team) == key]
        t, members = signals.Topology(), {a for r in own for a in (r.sender, r.receiver)}
        for r in own:
            t.message(r.sender, r.receiver)
        out[key] = (t.score(members), t.coalitions(members) if len(members) > 2 else 0)
    return out


def test_risk_counts_coalitions(spark):
    m = catalogue._messages(spark, SF)
    want = by_replay(m.collect())
    assert any(n > 1 for _, n in want.values())
    got = {(r.gate_id, r.team): r for r in topology.topology(m).collect()}
    assert set(got) == set(want)
    for key, (risk, n) in want.items():
        assert math.isclose(got[key].risk, risk, abs_tol=1e-9) and (got[key].n_coalitions > 1) == (n > 1)
    for q, c in (("topology_risk", "risk"), ("team_verdict_snapshot", "topology")):
        assert {(r.gate_id, r.team): r[c] for r in catalogue.QUERIES[q](spark, SF).collect()} == {k: round(x, 6) for k, (x, _) in want.items()}


def test_two_parts_and_many(spark):
    """Two pairs add 0.3; so do three, as the term ends there."""
    rows = [("g", f"t{k}", f"a{i}", f"b{i}") for k in (1, 2, 3) for i in range(k)]
    df = spark.createDataFrame(rows, "gate_id string, team string, sender string, receiver string")
    got = {r.team: (r.n_coalitions, r.risk) for r in topology.topology(df).collect()}
    assert {k: x[0] for k, x in got.items()} == {"t1": 0, "t2": 2, "t3": 3}
    base = {"t2": 0.1, "t3": 0.25}  # density 2/12 and 3/30 of unclassified shapes: the second under 0.15
    skew = {"t2": 0.0, "t3": 0.0}
    assert all(math.isclose(got[k][1], base[k] + 0.25 * skew[k] + 0.3, abs_tol=1e-9) for k in base)
