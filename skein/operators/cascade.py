"""Multi-hop chains: each hop goes on with the earliest later hop from where it arrived."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.streaming.signals import Cascade, cascade_score


def next_hop(hops: DataFrame) -> DataFrame:
    """seq, next_seq: the earliest hop sent by the receiver at or after a hop, ties by seq. As-of by one shuffle on the agent: arrivals and
    departures in one order, the next departure carried back; no join."""
    keys = ["gate_id", "agent"]
    arrive = hops.select("gate_id", F.col("receiver").alias("agent"), "ts", F.lit(0).alias("kind"), "seq")
    leave = hops.select("gate_id", F.col("sender").alias("agent"), "ts", F.lit(1).alias("kind"), "seq")
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("kind"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = arrive.unionByName(leave).withColumn("next_seq", F.last(F.when(F.col("kind") == 1, F.col("seq")), ignorenulls=True).over(w))
    return rows.filter("kind = 0").select("seq", "next_seq")


def goal_drift(hops: DataFrame) -> DataFrame:
    """Per team: derivations that land on it, a tenth each, at most 1."""
    return hops.groupBy("gate_id", "team").agg(F.least(F.lit(1.0), F.count_if(F.col("derived")) / 10).alias("goal_drift"))


CHAINS = "gate_id string, team string, n_chains bigint, n_deceptive bigint, max_length bigint, score double"
#: Hops that are looked at one by one before a chain asks for the next hop to each receiver, and chains that are followed at once.
LOOKS, BLOCK = 8, 1 << 18
#: Agents of a team whose chains keep whom they met in one number; of more agents, in a row of their own.
BITS = 63


class _Team:
    """A team's hops in order of time as arrays, and where to find the next one: every chain goes on by one hop at a time, all chains together."""

    def __init__(self, sender: np.ndarray, receiver: np.ndarray, ts: np.ndarray, safe: np.ndarray, moved: np.ndarray, hurt: np.ndarray):
        n = self.n = len(sender)
        self.sender, self.receiver, self.safe, self.moved, self.hurt = sender, receiver, safe, moved, hurt
        self.since = np.searchsorted(ts, ts, "left")  # the first hop that is no earlier
        self.base = n + 1
        self.by_sender = np.argsort(sender, kind="stable")
        self.sent = sender[self.by_sender] * self.base + self.by_sender
        agents = max(int(sender.max(initial=0)), int(receiver.max(initial=0))) + 1
        self.bits = agents <= BITS
        edges, edge = np.unique(sender * agents + receiver, return_inverse=True)
        self.by_edge = np.argsort(edge, kind="stable")
        self.went = edge[self.by_edge] * self.base + self.by_edge
        self.to = edges % agents
        if self.bits:
            self.sends = np.zeros(agents, np.int64)  # to whom at all
            np.bitwise_or.at(self.sends, edges // agents, 1 << self.to)
        self.first = np.searchsorted(edges, np.arange(agents + 1) * agents)  # the edges of an agent: first[a] up to first[a + 1]

    def add(self, met: np.ndarray, agents: np.ndarray) -> np.ndarray:
        return met | (1 << agents) if self.bits else np.concatenate([met, agents[:, None]], axis=1)

    def has(self, met: np.ndarray, agents: np.ndarray) -> np.ndarray:
        return (met >> agents & 1).astype(bool) if self.bits else (met == agents[:, None]).any(axis=1)

    def follow(self, at: np.ndarray, met: np.ndarray) -> np.ndarray:
        """For the chains that arrived by the hops ``at`` and met those agents: the earliest later hop to an agent not met, -1 for none."""
        found, agent, since = np.full(len(at), -1), self.receiver[at], self.since[at]
        todo = np.flatnonzero(self.sends[agent] & ~met) if self.bits else np.arange(len(at))
        i = np.searchsorted(self.sent, agent[todo] * self.base + since[todo])
        for _ in range(LOOKS):
            hop = self.by_sender[np.minimum(i, self.n - 1)]
            on = (i < self.n) & (self.sender[hop] == agent[todo])
            fresh = on & ~self.has(met[todo], self.receiver[hop])
            found[todo[fresh]] = hop[fresh]
            todo, i = todo[on & ~fresh], i[on & ~fresh] + 1
            if not len(todo):
                return found
        best, left = np.full(len(todo), self.n), todo
        e, last, k = self.first[agent[left]], self.first[agent[left] + 1], np.arange(len(left))
        while len(k):
            j = np.minimum(np.searchsorted(self.went, e * self.base + since[left]), self.n - 1)
            hop = self.by_edge[j]
            ok = (self.went[j] >= e * self.base + since[left]) & (self.went[j] < (e + 1) * self.base) & ~self.has(met[left], self.to[e])
            best[k[ok]] = np.minimum(best[k[ok]], hop[ok])
            e = e + 1
            more = e < last
            e, last, left, k = e[more], last[more], left[more], k[more]
        found[todo] = np.where(best < self.n, best, -1)
        return found

    def counted(self) -> tuple[int, int, int]:
        """Chains of two hops or more, deceptive ones, and the hops of the longest."""
        n = lies = longest = 0
        for start in range(0, self.n, BLOCK):
            at = np.arange(start, min(self.n, start + BLOCK))
            s, r = self.sender[at], self.receiver[at]
            met = self.add(1 << s if self.bits else s[:, None], r)
            moved, safe, hurt = self.moved[at], self.safe[at], self.hurt[s] | self.hurt[r]
            for length in range(1, Cascade.DEPTH + 1):
                on = self.follow(at, met) if length < Cascade.DEPTH else np.full(len(at), -1)
                if length > 1:
                    over = on < 0
                    n, longest = n + int(over.sum()), max(longest, length if over.any() else 0)
                    lies += int((over & safe & ((moved > 5) | hurt | ((length >= 4) & (moved >= length)))).sum())
                going = on >= 0
                if not going.any():
                    break
                at = on[going]
                met = self.add(met[going], self.receiver[at])
                moved, safe, hurt = moved[going] + self.moved[at], safe[going] & self.safe[at], hurt[going] | self.hurt[self.receiver[at]]
        return n, lies, longest


def chains(hops: DataFrame) -> DataFrame:
    """Per team, over (gate_id, team, seq, sender, receiver, ts, safety_label, transforms, derived, injected): greedy chains, deceptive ones, the
    longest, and the family's score. Who was met decides where a chain goes on, so a team's hops (and no more) are one task's state. A hop without
    a time or an agent is in no chain; what else is null counts as unsafe, none or false."""
    schema = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[kind]) for name, kind in (c.split() for c in CHAINS.split(", "))])
    no = F.lit(False)
    cols = [*(F.col(c).cast("string").alias(c) for c in ("gate_id", "team", "sender", "receiver")), F.col("ts").cast("double").alias("ts"), F.coalesce(F.col("safety_label") == "safe", no).alias("safe")]
    cols += [F.coalesce(F.col("transforms").cast("long"), F.lit(0)).alias("transforms"), F.coalesce("derived", no).alias("derived"), F.coalesce("injected", no).alias("injected")]
    cols += [F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), F.xxhash64("gate_id", "team").alias("h")]

    def close(key, parts):
        get = lambda c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
        named = pa.concat_arrays([p.column(c) for c in ("sender", "receiver") for p in parts]).dictionary_encode()
        agent, who = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(named.dictionary)
        s, r = np.split(agent, 2)
        ts, injected = get("ts"), get("injected")
        hurt = np.zeros(who, bool)
        hurt[s[injected & (s >= 0)]] = True
        known = np.flatnonzero(~np.isnan(ts) & (s >= 0) & (r >= 0))
        known = known[np.lexsort((get("seq")[known], ts[known]))]
        n, lies, longest = _Team(*[x[known] for x in (s, r, ts, get("safe"), get("transforms"))], hurt).counted()
        score = cascade_score(n, lies, longest, int(injected.sum()), int(get("derived").sum())) if who > 1 else 0.0
        return (*key, n, lies, longest, score)

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, teams = None, {}  # the teams of the hash that is read: one, but for a clash
        for rows in batches:
            h, out = rows.column("h").to_numpy(), []
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else []
            for lo, hi in zip(starts, [*starts[1:], len(h)]):
                if h[lo] != last:
                    out += [close(*x) for x in teams.items()]
                    last, teams = h[lo], {}
                part = rows.slice(lo, hi - lo)
                for key, mine in _apart(part):
                    teams.setdefault(key, []).append(mine)
            if out:
                yield batch(out)
        if teams:
            yield batch([close(*x) for x in teams.items()])

    n = int(hops.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that many teams aren't put into one task again: a hop costs more than its bytes
    return hops.select(*cols).repartition(n, "gate_id", "team").sortWithinPartitions("h").mapInArrow(fold, CHAINS)


def _apart(rows: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each (gate_id, team), which are one unless their hashes clash."""
    first = tuple(rows.column(c)[0].as_py() for c in ("gate_id", "team"))
    codes = [rows.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in ("gate_id", "team")]
    other = (codes[0] != codes[0][0]) | (codes[1] != codes[1][0])
    if not other.any():
        yield first, rows
        return
    yield first, rows.filter(pa.array(~other))
    yield from _apart(rows.filter(pa.array(other)))


def risk(deceptive: Column, longest: Column, injections: Column, drift: Column, n: Column) -> Column:
    by_length = F.when(longest >= 5, 0.2).when(longest >= 3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.least(F.lit(0.5), 0.2 * deceptive) + by_length + F.least(F.lit(0.3), 0.15 * injections) + 0.2 * drift + F.when(n > 5, 0.1).otherwise(0.0))
