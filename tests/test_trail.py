"""Chains over every message of a gate, against brute force."""

import hashlib

import pytest

from skein.operators import trail
from skein.plans import catalogue

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def chains(rows):
    """gate -> [(seq, body, prev_hash, entry_hash)]"""
    out = {}
    for gate, seq, body in sorted(rows):
        own = out.setdefault(gate, [])
        prev = own[-1][3] if own else sha("skein-genesis")
        own.append((seq, body, prev, sha(f"{prev}|{body}")))
    return out


@pytest.fixture(scope="module")
def want(spark):
    m = catalogue._messages(spark, SF).collect()
    return chains([(r.gate_id, r.seq, f"{r.event_type}:{r.sender}:{r.receiver}") for r in m])


def test_chain_holds_every_message(spark, want):
    got = {}
    for r in catalogue.trail_build_chain(spark, SF).collect():
        got.setdefault(r.gate_id, []).append(tuple(r)[1:])
    assert {g: sorted(x) for g, x in got.items()} == want
    assert sum(map(len, want.values())) == catalogue._messages(spark, SF).count()
    last = {r.gate_id: (r.n, r.last_hash) for r in catalogue.trail_last_hash(spark, SF).collect()}
    assert last == {g: (len(x), x[-1][3]) for g, x in want.items()}


def test_validation_and_import_see_every_message(spark, want):
    bad = {g: next((i for i, r in enumerate(x) if g in ("g1", "g2") and 100 <= r[0] <= 200), -1) for g, x in want.items()}
    assert {r.gate_id: (r.valid, r.first_bad) for r in catalogue.trail_validate_chain(spark, SF).collect()} == {g: (k < 0, k) for g, k in bad.items()}
    n = {g: next((i for i, r in enumerate(x) if g == "g1" and r[0] >= 300), len(x)) for g, x in want.items()}
    assert {r.gate_id: r.n for r in catalogue.trail_import_prefix(spark, SF).collect()} == n


def test_chain_across_batches(spark):
    rows = [(g, i, f"b{i % 7}") for g in ("x", "y") for i in range(30_000)]
    df = spark.createDataFrame(rows, "gate_id string, seq long, body string").repartition(7)
    got = trail.build(df).groupBy("gate_id").agg({"seq": "count"}).collect()
    assert {tuple(r) for r in got} == {("x", 30_000), ("y", 30_000)}
    want = chains(rows)
    last = {r.gate_id: r.entry_hash for r in trail.build(df).filter("seq = 29999").collect()}
    assert last == {g: x[-1][3] for g, x in want.items()}
