"""The gate, message by message: teams that form, merge and expire, their manifests, interventions and the hash-chained trail.

One ``Gate`` is the state of one gate_id; rows come in order of seq, and the time of a row is the clock of everything (detection, cooldowns, trail).
A row's ``kind`` says what it is; ``detail`` is a JSON object with what the kind needs besides sender, receiver, ts and payload:

=========== ==========================================================================================
message     sender sends payload to receiver: the only kind with a verdict
post        the message was delivered: one more ALLOW entry if the edge is in a team
agent       sender registers: provider, model_class, capabilities
declare     capabilities of sender, added to what it declares
flow        capability that goes from sender to receiver
invocation  capability that sender uses
hop         sender to receiver: content_hash, safety_label, transforms, input_hash
injection   an injection pattern was seen at sender
policy      policy_id, blocked_capabilities, signal_minimums, active; an equal policy_id replaces
drop_policy policy_id
release     the edge is let go, or not: force
disconnect  sender leaves all teams
shutdown    all teams end
=========== ==========================================================================================

A null payload is empty, null ids are ``unknown``, a null time is the latest so far; an unknown kind or broken detail is a row without effect.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from json.encoder import encode_basestring_ascii as quoted
from sys import intern

from skein import config
from skein.streaming.signals import Cascade, Privilege, SideChannel, Semantic, Topology

FIELDS = ("gate_id", "seq", "entry", "event_type", "team_id", "ts", "manifest_version", "r_team", "verdict", "safety_class", *config.FAMILIES, "reasons", "body", "prev_hash", "entry_hash")
SCHEMA = (
    "gate_id string, seq bigint, entry bigint, event_type string, team_id string, ts double, manifest_version int, r_team double, verdict string, safety_class string, "
    "topology double, semantic double, privilege double, sidechannel double, cascade double, reasons string, body string, prev_hash string, entry_hash string"
)
RANK = {v: i for i, v in enumerate(config.VERDICTS)}
BY_SAFETY = {"HIGH_RISK": "THROTTLE", "RESTRICTED": "WARN"}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_short = lru_cache(maxsize=4096)(sha)  # for short payloads, which come again


def number(x: float) -> str:
    return repr(x) if math.isfinite(x) else json.dumps(x)


def band(score: float, bands=config.BANDS) -> str:
    for upto, name in bands:
        if score < upto:
            return name
    return "TERMINATE"


class Team:
    def __init__(self, team_id: str, ts: float):
        self.team_id, self.formed_at, self.members, self.pairs = team_id, ts, set(), set()


class Detector:
    """Two agents that wrote to each other within the window are a pair; pairs that share agents are a team. A team that falls apart stays one."""

    def __init__(self, window: float, least: int):
        self.window, self.least = window, least
        self.last, self.pairs, self.teams = {}, {}, {}  # edge -> time; pair -> team; id -> live team, oldest first
        self.ages = []  # heap of (time, edge); an entry whose time is no longer the edge's is passed over

    def _drop(self, pair: tuple) -> Team:
        team = self.pairs.pop(pair)
        team.pairs.discard(pair)
        team.members = {a for p in team.pairs for a in p}
        if len(team.members) < self.least:
            self.teams.pop(team.team_id, None)
        return team

    def _expire(self, now: float) -> None:
        cutoff = now - self.window
        gone = []
        while self.ages and self.ages[0][0] <= cutoff:
            t, e = heappop(self.ages)
            if self.last.get(e) == t:
                del self.last[e]
                gone.append(e)
        if gone:
            for pair in sorted({(min(e), max(e)) for e in gone} & self.pairs.keys()):
                self._drop(pair)

    def edge(self, s: str, r: str, ts: float, new_id: str | Callable[[], str]) -> str | None:
        """The team of the edge once it is a pair within the window; ``new_id`` may be a function, which is asked where one forms."""
        if s == r:
            return None
        self._expire(ts)
        self.last[s, r] = ts
        heappush(self.ages, (ts, (s, r)))
        if len(self.ages) > 2 * len(self.last) + 1000:
            self.ages = [(t, e) for e, t in self.last.items()]
            heapify(self.ages)
        back = self.last.get((r, s))
        if back is None or ts - back > self.window:
            return None
        pair = (s, r) if s < r else (r, s)
        team = self.pairs.get(pair)
        if team is not None:
            return team.team_id
        met = [t for t in self.teams.values() if s in t.members or r in t.members]
        if not met:
            met = [Team(new_id if isinstance(new_id, str) else new_id(), ts)]
            self.teams[met[0].team_id] = met[0]
        first = met[0]
        for other in met[1:]:
            first.members |= other.members
            first.pairs |= other.pairs
            self.pairs |= dict.fromkeys(other.pairs, first)
            del self.teams[other.team_id]
        first.members |= {s, r}
        first.pairs.add(pair)
        self.pairs[pair] = first
        return first.team_id

    def remove(self, agent: str) -> list[Team]:
        met = [t for t in self.teams.values() if agent in t.members]
        for pair in [p for p in self.pairs if agent in p]:
            self._drop(pair)
        for e in [e for e in self.last if agent in e]:
            del self.last[e]
        return met


class Manifest:
    def __init__(self, team_id: str):
        self.team_id, self.members, self.state, self.version, self.capabilities, self.safety = team_id, {}, "FORMING", 1, set(), "STANDARD"
        self.who = frozenset()

    def _changed(self) -> None:
        self.version += 1
        self.who = frozenset(self.members)
        self.capabilities = {c for m in self.members.values() for c in m["capabilities"]}
        risky = sum(c in self.capabilities for c in config.HIGH_RISK)
        pair = any(self.capabilities.issuperset(p) for p in config.ESCALATION_PAIRS)
        self.safety = "HIGH_RISK" if risky >= config.HIGH_RISK_THRESHOLD else "RESTRICTED" if pair else "STANDARD"

    def add(self, agent: str, about: dict) -> None:
        self.members[agent] = about
        self._changed()
        if self.state == "FORMING" and len(self.members) >= 2:
            self.state = "ACTIVE"

    def remove(self, agent: str, least: int) -> None:
        if self.members.pop(agent, None) is not None:
            self._changed()
            if len(self.members) < least:
                self.state = "DISSOLVED"

    def enter(self, state: str) -> None:
        if self.state == "DISSOLVED" or (self.state == "TERMINATED" and state != "DISSOLVED"):
            raise ValueError(f"no way from {self.state} to {state}")
        self.state = state
        self.version += 1


class Interventions:
    """What holds on an edge: the latest intervention, isolation, a token bucket; and the teams that ended for good."""

    def __init__(self, settings: config.Settings):
        self.settings = settings
        self.by_edge, self.isolated, self.buckets, self.ended = {}, set(), {}, set()

    def apply(self, verdict: str, edge: tuple, team: str | None, version: int | None, now: float, risk: float = 0.0) -> dict:
        final = verdict == "TERMINATE"
        state = "EXPIRED" if verdict == "ALLOW" else "PERMANENT" if final else "ACTIVE"
        until = None if state != "ACTIVE" else now + self.settings.cooldown_interval
        made = {"verdict": verdict, "edge": edge, "team_id": team, "version": version, "state": state, "applied_at": now, "until": until}
        if verdict == "THROTTLE":
            scale = max(0.1, 1.0 - risk)
            capacity = self.settings.throttle_capacity * scale
            self.buckets[edge] = [capacity, capacity, self.settings.throttle_refill * scale, now]
        if verdict in ("ISOLATE", "TERMINATE"):
            self.isolated.add(edge)
        if final and team:
            self.ended.add(team)
        self.by_edge[edge] = made
        return made

    def _consume(self, bucket: list, now: float) -> bool:
        capacity, tokens, refill, at = bucket
        if now > at:
            bucket[1], bucket[3] = min(capacity, tokens + (now - at) * refill), now
        if bucket[1] < 1.0:
            return False
        bucket[1] -= 1.0
        return True

    def check(self, edge: tuple, team: str | None, now: float) -> str | None:
        """The verdict that holds on the edge now. Asking takes a token, and lets go what has cooled down."""
        if team in self.ended:
            return "TERMINATE"
        held = self.by_edge.get(edge)
        cooled = held is not None and held["until"] is not None and now >= held["until"]
        if edge in self.isolated:
            if held is None:
                return "ISOLATE"
            if held["state"] == "PERMANENT" or (held["until"] is not None and not cooled):
                return held["verdict"]
            self.isolated.discard(edge)
            held["state"] = "EXPIRED"
            return None
        if edge in self.buckets and held is not None and held["verdict"] == "THROTTLE":
            if cooled:
                del self.buckets[edge]
                held["state"] = "EXPIRED"
            elif not self._consume(self.buckets[edge], now):
                return "THROTTLE"
        return None

    def release(self, edge: tuple, now: float, force: bool = False) -> bool:
        held = self.by_edge.get(edge)
        if held is None:
            return True
        if held["state"] == "PERMANENT" or (not force and held["until"] is not None and now < held["until"]):
            return False
        self.isolated.discard(edge)
        self.buckets.pop(edge, None)
        held["state"] = "EXPIRED"
        return True


class Gate:
    """``judges`` false: who is in which team only; verdicts change nothing of that. ``chained`` false: entries without body and hashes, on which no verdict depends."""

    def __init__(self, gate_id: str, settings: config.Settings | None = None, judges: bool = True, chained: bool = True):
        self.settings, self.judges, self.chained = settings or config.Settings(), judges, chained
        self.gate_id, self.now, self.n = gate_id, 0.0, 0
        self.detector = Detector(self.settings.team_window, self.settings.min_team_size)
        self.interventions = Interventions(self.settings)
        self.manifests, self.agents, self.policies = {}, {}, {}
        self.topology, self.semantic, self.privilege, self.sidechannel, self.cascade = Topology(), Semantic(), Privilege(), SideChannel(), Cascade()
        self.hash = sha("skein-genesis")

    def row(self, seq: int, kind: str, sender, receiver, ts, payload, detail) -> list[tuple]:
        """The trail entries that the row makes, and for a message without a team its verdict as a row without an entry."""
        self.now = self.now if ts is None or ts != ts else float(ts)
        s = intern(sender) if isinstance(sender, str) else "unknown"  # one object per name: some forty lookups by it follow
        r = intern(receiver) if isinstance(receiver, str) else "unknown"
        try:
            d = json.loads(detail) if isinstance(detail, str) and detail else {}
        except ValueError:
            return []
        do = getattr(self, f"on_{kind}", None)
        return do(seq, s, r, payload if isinstance(payload, str) else "", d) if do and isinstance(d, dict) else []

    def entry(self, seq: int, event: str, team: str, version: int, verdict: str = "ALLOW", risk: float = 0.0, edge=None, payload: str = "", scores=(), safety=None, reasons: str | None = None) -> tuple:
        if not self.chained:
            self.n += 1
            return (self.gate_id, seq, self.n - 1, event, team, self.now, version, risk, verdict, safety, *(scores or [None] * 5), reasons, None, None, None)
        hashed = (_short(payload) if len(payload) <= 256 else sha(payload)) if payload else ""
        edges = f"[[{quoted(edge[0])},{quoted(edge[1])}]]" if edge else "[]"
        body = (  # as json.dumps with sorted keys and no spaces writes it
            f'{{"affected_edges":{edges},"event_id":"{sha(f"{self.gate_id}\n{self.n}")[:32]}","event_type":"{event}","manifest_version":{version},"payload_hash":"{hashed}",'
            f'"r_team":{number(risk)},"team_id":{quoted(team)},"timestamp":{number(self.now)},"verdict":"{verdict}"}}'
        )
        prev, n = self.hash, self.n
        self.hash, self.n = sha(f"{prev}|{body}"), n + 1
        return (self.gate_id, seq, n, event, team, self.now, version, risk, verdict, safety, *(scores or [None] * 5), reasons, body, prev, self.hash)

    def on_message(self, seq: int, s: str, r: str, payload: str, d: dict) -> list[tuple]:
        team = self.detector.edge(s, r, self.now, lambda: sha(f"{self.gate_id}\n{seq}")[:16])
        out = self._joined(seq, team, s, r) if team else []
        if not self.judges:
            return out
        self.topology.message(s, r)
        self.semantic.message(s, payload)
        self.sidechannel.message(s, r, self.now, len(payload))
        manifest = self.manifests.get(team)
        if manifest is None or len(manifest.members) < 2:
            return [*out, (self.gate_id, seq, None, "VERDICT", None, self.now, None, 0.0, "ALLOW", "STANDARD", *[None] * 5, "no_team_detected", None, None, None)]
        members = manifest.who
        scores = [self.topology.score(members), self.semantic.score(members), self.privilege.score(members), self.sidechannel.score(team, members), self.cascade.score(members)]
        risk = 1 - math.prod([1 - w * x for w, x in zip(self.settings.weights, scores)])
        by_risk = band(risk, self.settings.bands)
        by_safety = BY_SAFETY.get(manifest.safety, "ALLOW")
        by_policy = self._policy(manifest, dict(zip(config.FAMILIES, scores))) if self.policies else "ALLOW"
        held = self.interventions.check((s, r), team, self.now) or "ALLOW"
        verdict = max(by_risk, by_safety, by_policy, held, key=RANK.__getitem__)
        why = [f"risk_score={risk:.4f}"] * (by_risk != "ALLOW") + [f"safety_class={manifest.safety}"] * (by_safety != "ALLOW") + ["policy_binding"] * (by_policy != "ALLOW")
        out.append(self.entry(seq, "GATE_VERDICT", team, manifest.version, verdict, risk, (s, r), payload, scores, manifest.safety, ";".join(why)))
        if verdict != "ALLOW":
            self.interventions.apply(verdict, (s, r), team, manifest.version, self.now)
        return out

    def _joined(self, seq: int, team: str, s: str, r: str) -> list[tuple]:
        out = []
        if team not in self.manifests:
            self.manifests[team] = Manifest(team)
            out.append(self.entry(seq, "FORMED", team, 1, edge=(s, r)))
        manifest = self.manifests[team]
        for agent in (s, r):
            if agent not in manifest.members:
                manifest.add(agent, {"provider": "unknown", "model_class": "unknown", "capabilities": (), "joined_ts": self.now} | self.agents.get(agent, {}))
                out.append(self.entry(seq, "MEMBER_JOINED", team, manifest.version))
        return out

    def _policy(self, manifest: Manifest, scores: dict) -> str:
        worst = "ALLOW"
        for p in self.policies.values():
            if p.get("active", True):
                asked = ["ISOLATE"] * bool(manifest.capabilities.intersection(p.get("blocked_capabilities") or ()))
                asked += [v for f, v in (p.get("signal_minimums") or {}).items() if scores.get(f, 0.0) > 0.5 and v in RANK]
                worst = max(worst, *asked, key=RANK.__getitem__) if asked else worst
        return worst

    def on_post(self, seq, s, r, payload, d):
        team = self.detector.pairs.get((min(s, r), max(s, r)))
        if team is None:
            return []
        manifest = self.manifests.get(team.team_id)
        return [self.entry(seq, "GATE_VERDICT", team.team_id, manifest.version if manifest else 0, edge=(s, r), payload=payload)]

    def on_agent(self, seq, s, r, payload, d):
        caps = sorted({str(c) for c in d.get("capabilities") or ()})
        self.agents[s] = {"provider": d.get("provider", "unknown"), "model_class": d.get("model_class", "unknown"), "capabilities": caps}
        if caps:
            self.privilege.declared[s].update(caps)
        return []

    def on_declare(self, seq, s, r, payload, d):
        self.privilege.declared[s].update(d.get("capabilities") or ())
        return []

    def on_flow(self, seq, s, r, payload, d):
        self.privilege.flows[s][r, d.get("capability")] += 1
        return []

    def on_invocation(self, seq, s, r, payload, d):
        self.privilege.used[s][d.get("capability")] += 1
        return []

    def on_hop(self, seq, s, r, payload, d):
        self.cascade.hop(s, r, self.now, d.get("safety_label", "safe"), len(d.get("transforms") or ()), bool(d.get("input_hash")))
        return []

    def on_injection(self, seq, s, r, payload, d):
        self.cascade.injected[s] += 1
        return []

    def on_policy(self, seq, s, r, payload, d):
        self.policies[d.get("policy_id")] = d
        return []

    def on_drop_policy(self, seq, s, r, payload, d):
        self.policies.pop(d.get("policy_id"), None)
        return []

    def on_release(self, seq, s, r, payload, d):
        self.interventions.release((s, r), self.now, bool(d.get("force")))
        return []

    def on_disconnect(self, seq, s, r, payload, d):
        out = []
        for team in self.detector.remove(s):
            manifest = self.manifests.get(team.team_id)
            if manifest is None:
                continue
            manifest.remove(s, self.settings.min_team_size)
            out.append(self.entry(seq, "MEMBER_LEFT", team.team_id, manifest.version))
            if team.team_id not in self.detector.teams and manifest.state != "DISSOLVED":
                manifest.enter("DISSOLVED")
                out.append(self.entry(seq, "DISSOLVED", team.team_id, manifest.version))
        return out

    def on_shutdown(self, seq, s, r, payload, d):
        out = []
        for manifest in self.manifests.values():
            if manifest.state not in ("TERMINATED", "DISSOLVED"):
                manifest.enter("DISSOLVED")
                out.append(self.entry(seq, "DISSOLVED", manifest.team_id, manifest.version))
        return out
