"""The stateful gate: goldens of its parts, invariants of whole replays, and batch against stream."""

import random

import pytest
from pyspark.sql import functions as F

from skein import config
from skein.operators import cascade, trail
from skein.plans import catalogue, scenarios
from skein.streaming import replay
from skein.streaming.gate import Detector, Gate, Interventions, Manifest, band
from skein.streaming.signals import Cascade, Privilege, Semantic, SideChannel, Topology

SF = "/root/testdata/sf0.001"


def gate(**settings):
    return Gate("g", config.Settings(**settings))


def send(g, *edges, at=1000.0, text="hello there"):
    return [x for i, (s, r) in enumerate(edges) for x in g.row(g.n * 1000 + i, "message", s, r, at + i, text, None)]


def detector(window=600.0):
    d = Detector(window, 2)
    return d, lambda s, r, t: d.edge(s, r, t, f"{s}{r}{t}")


def test_bands():
    for verdict, scores in {"ALLOW": (0, 0.2, 0.39), "WARN": (0.4, 0.5, 0.64), "THROTTLE": (0.65, 0.75), "ISOLATE": (0.8, 0.9), "TERMINATE": (0.92, 0.99, 1.0)}.items():
        assert {band(x) for x in scores} == {verdict}
    assert band(0.5, ((0.5, "ALLOW"),)) == "TERMINATE"


def test_pairs_expire_with_the_window():
    d, edge = detector(10.0)
    edge("A", "B", 1000)
    assert edge("B", "A", 1005) and d.pairs
    edge("C", "D", 1020)
    assert not d.pairs and not d.teams
    d, edge = detector(10.0)
    edge("A", "B", 1000)
    assert edge("B", "A", 1015) is None


def test_teams_merge_into_the_oldest_and_never_split():
    d, edge = detector()
    for s, r in ("AB", "BA", "CD", "DC", "BC", "CB"):
        edge(s, r, 1000)
    (team,) = d.teams.values()
    assert team.members == set("ABCD") and len(team.pairs) == 3
    d._drop(("B", "C"))
    assert [t.members for t in d.teams.values()] == [set("ABCD")]


def test_many_pairs_and_removal():
    d, edge = detector()
    for i in range(50):
        edge(f"a{i}", f"b{i}", 1000)
        edge(f"b{i}", f"a{i}", 1000)
    assert len(d.teams) == 50
    assert len(d.remove("a0")) == 1 and len(d.teams) == 49 and d.remove("nobody") == []
    assert edge("a", "a", 1000) is None


def test_safety_class_state_and_versions():
    for caps, safety in ((["code-exec", "net-egress"], "RESTRICTED"), (["read-untrusted", "code-exec", "memory-write"], "HIGH_RISK"), (["code-exec"], "STANDARD")):
        m = Manifest("t")
        m.add("a", {"capabilities": caps})
        m.add("b", {"capabilities": []})
        assert (m.safety, m.state, m.version) == (safety, "ACTIVE", 3)
    m.enter("TERMINATED")
    with pytest.raises(ValueError):
        m.enter("ACTIVE")
    m.enter("DISSOLVED")
    with pytest.raises(ValueError):
        m.enter("ACTIVE")


def test_topology_goldens():
    t = Topology()
    for a in "abcd":
        for b in "abcd":
            if a != b:
                t.message(a, b)
    assert t.clustering(set("abcd")) == 1.0 and t.coalitions(set("abcd")) == 0
    assert t.score(set("abcd")) == pytest.approx(0.25 + 0.10 + 0.15)
    pair = Topology()
    pair.message("a", "b")
    pair.message("b", "a")
    assert pair.score({"a", "b"}) == pytest.approx(0.35)


def test_privilege_goldens():
    p = Privilege()
    p.declared["A"] |= {"code-exec", "net-egress"}
    p.declared["B"] |= {"write-trusted"}
    p.flows["A"]["B", "code-exec"] += 2
    assert p.laundered({"A", "B"}) == 2 and p.score({"A", "B"}) == pytest.approx(0.3)
    p.declared["B"] |= {"code-exec"}
    assert p.score({"A", "B"}) == 0


def test_incremental_cosine_and_timing_equal_plain_ones():
    rnd, s, texts = random.Random(3), Semantic(), {}
    for _ in range(60):
        a, t = rnd.choice("abc"), "".join(rnd.choice("xyz wv") for _ in range(rnd.randrange(12)))
        s.message(a, t)
        texts.setdefault(a, []).append(t)
    from collections import Counter
    import re

    grams = {a: Counter(n[i : i + 3] for t in ts for n in [re.sub(r"\W+", " ", t.lower().strip())] for i in range(len(n) - 2)) for a, ts in texts.items()}
    for a in "abc":
        assert s.squares[a] == sum(c * c for c in grams[a].values())
        for b in "abc":
            if a != b:
                assert s.dots[a].get(b, 0) == sum(c * grams[b][g] for g, c in grams[a].items())
    import statistics

    c, times = SideChannel(), []
    for _ in range(40):
        times.append(rnd.uniform(0, 1000))
        c.message("a", "b", times[-1], 7)
    delays = [y - x for x, y in zip(sorted(times), sorted(times)[1:])]
    assert c.edges["a"]["b"].regularity() == pytest.approx(max(0, 1 - statistics.stdev(delays) / statistics.mean(delays)), abs=1e-9)


def test_ordering_is_the_same_however_often_it_is_asked():
    rnd, often, once = random.Random(5), SideChannel(), SideChannel()
    for i in range(80):
        s, r = rnd.sample("abcd", 2)
        often.message(s, r, i, 5)
        once.message(s, r, i, 5)
        often.ordering("t", frozenset("abc"))
    assert often.ordering("t", frozenset("abc")) == once.ordering("t", frozenset("abc"))
    steady = SideChannel()
    for i in range(8):
        steady.message(*("ab" if i % 2 == 0 else "ba"), i, 5)
    assert steady.ordering("t", frozenset("ab")) == 1.0


def test_cascade_goldens():
    c = Cascade()
    for i, (a, b) in enumerate(zip("abcdefg", "bcdefgh")):
        c.hop(a, b, i, "safe", 2, False)
    assert max(len(h) for _, h in c.chains(set("abcdefgh"))) == 7 and c.score(set("abcdefgh")) > 0.5
    c = Cascade()
    c.hop("a", "b", 0, "safe", 3, False)
    c.hop("b", "c", 1, "unsafe", 3, False)
    assert not any(c.deceptive(*x) for x in c.chains(set("abc")))


def test_interventions():
    i = Interventions(config.Settings())
    i.apply("ISOLATE", ("A", "B"), "t", 1, 100.0)
    assert i.check(("A", "B"), "t", 101) == "ISOLATE" and i.check(("B", "A"), "t", 101) is None
    assert not i.release(("A", "B"), 101) and i.check(("A", "B"), "t", 161) is None
    i.apply("THROTTLE", ("A", "C"), "t", 1, 200.0, risk=0.75)
    assert [i.check(("A", "C"), "t", 200.0) for _ in range(3)] == [None, None, "THROTTLE"]
    i.apply("TERMINATE", ("A", "D"), "t", 1, 300.0)
    assert i.check(("X", "Y"), "t", 9e9) == "TERMINATE" and not i.release(("A", "D"), 9e9, force=True)


def test_policy_hooks_and_shutdown():
    g = gate()
    g.row(0, "agent", "a", None, 1, None, '{"capabilities": ["code-exec"]}')
    g.row(1, "policy", None, None, 1, None, '{"policy_id": "p", "blocked_capabilities": ["code-exec"]}')
    out = send(g, ("a", "b"), ("b", "a"))
    assert out[-1][8] == "ISOLATE" and "policy_binding" in out[-1][15]
    assert [x[3] for x in g.row(5, "post", "a", "b", 1002, "x", None)] == ["GATE_VERDICT"]
    assert [x[3] for x in g.row(6, "disconnect", "a", None, 1003, None, None)] == ["MEMBER_LEFT"]
    send(g, ("c", "d"), ("d", "c"), at=1004)
    assert [x[3] for x in g.row(9, "shutdown", None, None, 1010, None, None)] == ["DISSOLVED"]
    assert g.row(10, "message", None, None, None, None, None)[0][8] == "ALLOW" and g.row(11, "nonsense", "a", "b", 1, "", "{broken") == []


def test_settings_layers(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"team_window": 5, "min_team_size": 3, "unknown": 1}')
    s = config.Settings.resolve({"cooldown_interval": 1}, str(f), {"SKEIN_TEAM_WINDOW": "7"})
    assert (s.team_window, s.min_team_size, s.cooldown_interval, s.throttle_refill) == (7.0, 3, 1.0, 1.0)


def test_scenarios(spark):
    rows = {r.scenario: r for r in scenarios.report(spark).collect()}
    assert len(rows) == 15 and {r.negative for r in rows.values()} == {"ALLOW"}
    assert {n for n, r in rows.items() if r.passed} == {"capability_laundering", "privilege_aggregation"}


def test_replay_holds_and_equals_one_gate_after_another(spark):
    m = catalogue._messages(spark, SF)
    found = replay.replay(m, config.Settings(team_window=86400.0)).cache()
    assert {r.valid for r in trail.validate(replay.trail(found)).collect()} == {True}
    assert replay.verdicts(found).count() == m.count()
    low, high = found.agg(F.min("r_team"), F.max("r_team")).first()
    assert 0 <= low <= high <= 1 - 0.8**5 + 1e-9
    gates, want = {}, {}
    for r in sorted(replay.rows(m).collect(), key=lambda r: r.seq):
        g = gates.setdefault(r.gate_id, Gate(r.gate_id, config.Settings(team_window=86400.0)))
        for x in g.row(r.seq, r.kind, r.sender, r.receiver, r.ts, r.payload, r.detail):
            if x[2] is not None:
                want[x[0], x[2]] = x[-1]
    assert {(r.gate_id, r.seq): r.entry_hash for r in replay.trail(found).collect()} == want


def test_replay_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "gate_id string, seq bigint, extra int")
    assert replay.replay(empty).count() == 0
    rows = [(None, None, None, None), ("g", 1, "a", float("nan")), ("g", 2, None, 1.0)]
    got = replay.replay(spark.createDataFrame(rows, "gate_id string, seq bigint, sender string, ts double"))
    assert sorted(r.verdict for r in got.collect()) == ["ALLOW"] * 3


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    m = replay.rows(catalogue._messages(spark, SF).filter("seq < 400"))
    for lo in (0, 200):
        m.filter(F.col("seq").between(lo, lo + 199)).coalesce(1).write.mode("append").parquet(src)
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = replay.stream(spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(src), config.Settings(team_window=86400.0))
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
    want = replay.replay(m, config.Settings(team_window=86400.0))
    pick = lambda df: sorted((r.gate_id, r.entry, r.entry_hash) for r in df.filter("entry IS NOT NULL").collect())
    assert pick(spark.read.parquet(out)) == pick(want)


def test_greedy_chains_equal_a_plain_version(spark):
    rnd = random.Random(7)
    hops = [("g", "t", i, *rnd.sample("abcde", 2), float(rnd.randrange(40)), rnd.choice(["safe", "safe", "bad"]), rnd.randrange(4), False, i == 11) for i in range(60)]
    names = "gate_id string, team string, seq int, sender string, receiver string, ts double, safety_label string, transforms int, derived boolean, injected boolean"
    (got,) = cascade.chains(spark.createDataFrame(hops, names)).collect()
    bad = hops[11][3]
    n = lies = longest = 0
    for h in hops:
        chain, met = [h], [h[3], h[4]]
        while len(chain) < 10:
            on = [x for x in hops if x[3] == met[-1] and x[5] >= chain[-1][5] and x[4] not in met]
            if not on:
                break
            chain.append(min(on, key=lambda x: (x[5], x[2])))
            met.append(chain[-1][4])
        if len(chain) > 1:
            moved = sum(x[7] for x in chain)
            n, longest = n + 1, max(longest, len(chain))
            lies += all(x[6] == "safe" for x in chain) and (moved > 5 or bad in met or (len(chain) >= 4 and moved >= len(chain)))
    assert (got.n_chains, got.n_deceptive, got.max_length) == (n, lies, longest)
