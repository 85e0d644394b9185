"""Queries over several operators: risks per family, teams, policies, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import cascade, detector, privilege, semantic, sidechannel, topology, verdict
from skein.plans.catalogue import BAND, CAPS, CONV, COS, DAY, HITS, MSG, NORM, TEAMS, _capability_sets, _conv, _declared, _messages, _round, _scores, query
from skein.sources import messages as src

KEYS = topology.KEYS
#: Fixed values of the demonstration: one policy of each sort, one of them asleep.
POLICIES = [
    {"policy_id": "no-code", "blocked_capabilities": ["code-exec"]},
    {"policy_id": "shape", "signal_minimums": {"topology": "THROTTLE", "semantic": "WARN"}},
    {"policy_id": "asleep", "active": False, "blocked_capabilities": ["read-untrusted"]},
]


@query("""SELECT event_id AS seq, CASE WHEN event_id & 2 = 2 THEN 'ISOLATE' WHEN (event_id % 11) / 10 > 0.5 THEN 'THROTTLE' WHEN (event_id % 7) / 6 > 0.5 THEN 'WARN' ELSE 'ALLOW' END AS verdict FROM events""")
def policy_verdict(spark, d):
    rows = _capability_sets(spark, d).join(_scores(spark, d), "seq")
    return rows.select("seq", verdict.policy(F.col("caps"), {"topology": F.col("a"), "semantic": F.col("b")}, POLICIES).alias("verdict"))


@query("""SELECT event_id AS seq, CASE WHEN (event_id & 1) + (event_id >> 1 & 1) + (event_id >> 2 & 1) + (event_id >> 3 & 1) >= 3 THEN 'THROTTLE'
 WHEN event_id & 17 = 17 OR event_id & 34 = 34 OR event_id & 12 = 12 THEN 'WARN' ELSE 'ALLOW' END AS verdict FROM events""")
def safety_minimum_verdict(spark, d):
    return _capability_sets(spark, d).select("seq", verdict.safety_minimum(privilege.safety_class(F.col("caps"))).alias("verdict"))


COMPONENTS = f"""RECURSIVE {HITS}, pairs AS (SELECT DISTINCT gate_id, a, b FROM hits), both_ways AS (SELECT gate_id, a AS x, b AS y FROM pairs UNION SELECT gate_id, b, a FROM pairs),
 reach(gate_id, x, y) AS (SELECT gate_id, x, x FROM both_ways UNION SELECT r.gate_id, r.x, e.y FROM reach r JOIN both_ways e ON e.gate_id = r.gate_id AND e.x = r.y),
 comp AS (SELECT gate_id, x AS agent, min(y) AS team FROM reach GROUP BY gate_id, x)"""


def _teams(spark, d):
    return detector.teams(detector.bidirectional_pairs(_messages(spark, d), DAY))


@query(f"WITH {COMPONENTS} SELECT agent, count(*) AS n_teams, array_to_string(list_sort(list(gate_id || '/' || team)), ',') AS teams FROM comp GROUP BY agent")
def teams_for_agent(spark, d):
    teams = F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "gate_id", "team"))), ",")
    return _teams(spark, d).groupBy("agent").agg(F.count(F.lit(1)).alias("n_teams"), teams.alias("teams"))


@query(f"WITH {COMPONENTS} SELECT gate_id, team, count(*) AS n_members FROM comp GROUP BY ALL HAVING count(*) >= 2")
def active_teams(spark, d):
    return _teams(spark, d).groupBy("gate_id", "team").agg(F.count(F.lit(1)).alias("n_members")).filter("n_members >= 2")


@query(f"WITH {COMPONENTS} SELECT p.gate_id, a, b, team FROM pairs p JOIN comp c ON c.gate_id = p.gate_id AND c.agent = p.a")
def team_for_edge(spark, d):
    pairs = detector.bidirectional_pairs(_messages(spark, d), DAY).select("gate_id", "a", "b")
    return pairs.join(_teams(spark, d).withColumnRenamed("agent", "a"), ["gate_id", "a"]).select("gate_id", "a", "b", "team")


@query(f"""WITH {MSG}, f AS (SELECT gate_id, team, agent, min(seq) AS joined FROM (SELECT gate_id, team, sender AS agent, seq FROM msg UNION ALL SELECT gate_id, team, receiver, seq FROM msg) GROUP BY ALL),
 reg AS (SELECT seq AS reg, sender AS agent, 'p' || (seq % 5) AS provider FROM msg WHERE event_type = 'signup')
 SELECT gate_id, team, f.agent, joined, coalesce(arg_max(provider, reg), 'unknown') AS provider FROM f LEFT JOIN reg ON reg.agent = f.agent AND reg <= joined GROUP BY gate_id, team, f.agent, joined""")
def manifest_member_asof(spark, d):
    """What was known of an agent when it joined: joins and registrations in one order per agent, the last registration carried on."""
    m = _messages(spark, d)
    joins = m.select(*KEYS, F.explode(F.array("sender", "receiver")).alias("agent"), "seq").groupBy(*KEYS, "agent").agg(F.min("seq").alias("joined"))
    known = m.filter("event_type = 'signup'").select(F.col("sender").alias("agent"), F.col("seq").alias("joined"), F.concat(F.lit("p"), (F.col("seq") % 5).cast("string")).alias("provider"))
    return detector.as_of(joins, known, "agent", "joined", "provider").select(*KEYS, "agent", "joined", F.coalesce("provider", F.lit("unknown")).alias("provider"))


@query("""SELECT user_id AS agent, max(event_id) AS seq, arg_max(event_type, event_id) AS model_class FROM events GROUP BY user_id""")
def agent_dimension(spark, d):
    """The latest registration of each agent."""
    e = src.read(spark, d, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("seq"), "event_type")
    return e.groupBy("agent").agg(F.max("seq").alias("seq"), F.max_by("event_type", "seq").alias("model_class"))


@query(f"WITH RECURSIVE {TEAMS} SELECT gate_id, team, n_coalitions FROM coal")
def topology_sub_coalitions(spark, d):
    return topology.coalitions(_messages(spark, d))


def _privilege(spark, d):
    m, declared = _messages(spark, d), _declared(spark, d)
    n = topology.members(m).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("members"))
    used = m.select(*KEYS, F.col("sender").alias("agent"), F.col("event_type").alias("capability"))
    kinds = used.groupBy(*KEYS).agg(F.countDistinct("capability").alias("kinds"))
    beyond = privilege.violations(used, declared).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("beyond"))
    flows = m.select(*KEYS, "sender", "receiver", F.col("event_type").alias("capability"))
    moved = privilege.laundering(flows, declared).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("laundered"))
    met = n.join(kinds, KEYS).join(beyond, KEYS, "left").join(moved, KEYS, "left").na.fill(0, ["beyond", "laundered"])
    return met.select(*KEYS, "laundered", "beyond", privilege.risk(F.col("laundered"), F.col("beyond"), F.col("kinds"), F.col("members")).alias("risk"))


PRIVILEGE = f"""{CAPS}, pmem AS (SELECT gate_id, team, count(DISTINCT agent) AS n FROM (SELECT gate_id, team, sender AS agent FROM msg UNION ALL SELECT gate_id, team, receiver FROM msg) GROUP BY ALL),
 px AS (SELECT gate_id, team, event_type, sender IN (SELECT agent FROM declared) AS any_s, EXISTS (SELECT 1 FROM declared q WHERE q.agent = sender AND q.capability = event_type) AS s,
 EXISTS (SELECT 1 FROM declared q WHERE q.agent = receiver AND q.capability = event_type) AS r FROM msg),
 pg AS (SELECT gate_id, team, count(DISTINCT event_type) AS kinds, count(*) FILTER (s AND NOT r) AS laundered, count(*) FILTER (any_s AND NOT s) AS beyond FROM px GROUP BY ALL),
 priv AS (SELECT gate_id, team, laundered, beyond, round(least(0.4, 0.15 * laundered) + least(0.3, 0.1 * beyond) + CASE WHEN kinds / n > 3 THEN 0.15 ELSE 0 END, 6) AS risk FROM pg JOIN pmem USING (gate_id, team))"""


@query(f"WITH {PRIVILEGE} SELECT gate_id, team, laundered, beyond, risk FROM priv")
def privilege_risk(spark, d):
    return _round(_privilege(spark, d))


def _semantic(spark, d):
    m = _messages(spark, d)
    mean = semantic.average_similarity(m)
    special = semantic.counted(m, "term").groupBy(*KEYS, "gram").agg(F.count(F.lit(1)).alias("k")).groupBy(*KEYS).agg(F.least(F.lit(10), F.count_if(F.col("k") >= 2)).alias("special"))
    met = mean.join(semantic.vocabulary_overlap(m), KEYS).join(special, KEYS)
    return met.select(*KEYS, "special", semantic.risk(F.round("similarity", 6), F.round("overlap", 6), F.lit(0.0), F.col("special")).alias("risk"))


SEMANTIC = f"""{COS}, sn AS (SELECT gate_id, team, count(DISTINCT agent) AS n FROM terms GROUP BY ALL), sper AS (SELECT gate_id, team, term, count(DISTINCT agent) AS k FROM terms GROUP BY ALL),
 voc AS (SELECT gate_id, team, round(count(*) FILTER (k = n) / count(*), 6) AS o, least(10, count(*) FILTER (k >= 2)) AS special FROM sper JOIN sn USING (gate_id, team) GROUP BY gate_id, team),
 sim AS (SELECT gate_id, team, round(avg(cosine), 6) AS s FROM cos GROUP BY ALL),
 sema AS (SELECT gate_id, team, special, round(CASE WHEN s > 0.8 THEN 0.35 WHEN s > 0.6 THEN 0.2 WHEN s > 0.4 THEN 0.1 ELSE 0 END + CASE WHEN o > 0.7 THEN 0.25 WHEN o > 0.4 THEN 0.1 ELSE 0 END
 + CASE WHEN special > 5 THEN 0.2 WHEN special > 2 THEN 0.1 ELSE 0 END, 6) AS risk FROM sim JOIN voc USING (gate_id, team))"""


@query(f"WITH {SEMANTIC} SELECT gate_id, team, special, risk FROM sema")
def semantic_risk(spark, d):
    """The snapshot has no history, so no trend."""
    return _round(_semantic(spark, d))


@query(f"""WITH {CONV}, ch AS (SELECT conv_id || '/' || sender AS sender, receiver, seq, seq * 1.0 AS ts FROM num),
 dl AS (SELECT sender, receiver, ts - lag(ts) OVER (PARTITION BY sender, receiver ORDER BY ts, seq) AS delay FROM ch),
 g AS (SELECT sender, receiver, avg(delay)::DOUBLE AS mean, stddev_samp(delay) AS sd FROM dl GROUP BY ALL HAVING count(*) >= 3),
 p AS (SELECT sender, receiver, concat_ws(';', CASE WHEN mean = 0 THEN 'timing:zero_delay:' || sender || '->' || receiver END, CASE WHEN mean > 0 AND sd / mean < 0.15 THEN 'timing:high_regularity:' || sender || '->' || receiver END,
 CASE WHEN mean > 0 AND sd / mean < 0.05 THEN printf('timing:periodic:%s->%s:period=%.3fs', sender, receiver, mean) END) AS patterns FROM g) SELECT * FROM p WHERE patterns <> ''""")
def sidechannel_timing_patterns(spark, d):
    turn = F.col("seq").cast("double").alias("ts")
    return sidechannel.timing_patterns(_conv(spark, d).select(F.concat_ws("/", "conv_id", "sender").alias("sender"), "receiver", "seq", turn))


def _hops(spark, d):
    m = _messages(spark, d).filter("sender != receiver")
    v = F.col("value")
    label = F.when(v > 150, "unsafe").otherwise("safe")
    return m.select(*KEYS, "seq", "sender", "receiver", "ts", label.alias("safety_label"), F.floor(v / 40).cast("int").alias("transforms"), (v > 60).alias("derived"), (v > 300).alias("injected"))


CHAINS = f"""{MSG}, hp AS MATERIALIZED (SELECT gate_id, team, seq, sender, receiver, ts, value <= 150 AS safe, CAST(floor(value / 40) AS INT) AS moved, value > 60 AS derived, value > 300 AS injected FROM msg WHERE sender <> receiver),
 walk(gate_id, team, first, agent, ts, met, n, moved, safe) AS (SELECT gate_id, team, seq, receiver, ts, [sender, receiver], 1, moved, safe FROM hp UNION ALL
 SELECT gate_id, team, first, x.receiver, x.ts, list_append(met, x.receiver), n + 1, moved + x.moved, safe AND x.safe FROM (
 SELECT w.gate_id, w.team, w.first, any_value(w.met) AS met, any_value(w.n) AS n, any_value(w.moved) AS moved, any_value(w.safe) AS safe,
 first(struct_pack(receiver := h.receiver, ts := h.ts, moved := h.moved, safe := h.safe) ORDER BY h.ts, h.seq) AS x
 FROM walk w JOIN hp h ON h.gate_id = w.gate_id AND h.team = w.team AND h.sender = w.agent AND h.ts >= w.ts AND NOT list_contains(w.met, h.receiver) WHERE w.n < 10 GROUP BY w.gate_id, w.team, w.first)),
 hurt AS (SELECT gate_id, team, list(DISTINCT sender) AS who, count(*) AS n FROM hp WHERE injected GROUP BY ALL),
 last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY gate_id, team, first ORDER BY n DESC) = 1),
 lies AS (SELECT l.gate_id, l.team, l.n, safe AND (moved > 5 OR coalesce(list_has_any(met, who), false) OR (l.n >= 4 AND moved >= l.n)) AS lie FROM last l LEFT JOIN hurt ON hurt.gate_id = l.gate_id AND hurt.team = l.team WHERE l.n >= 2),
 chained AS (SELECT gate_id, team, count(*) AS n_chains, count(*) FILTER (lie) AS n_deceptive, max(n) AS max_length FROM lies GROUP BY ALL),
 landed AS (SELECT gate_id, team, count(*) FILTER (derived) AS derived, count(DISTINCT sender) AS senders FROM hp GROUP BY ALL),
 casc AS (SELECT d.gate_id, d.team, coalesce(n_chains, 0) AS n_chains, coalesce(n_deceptive, 0) AS n_deceptive, coalesce(max_length, 0) AS max_length,
 least(1, least(0.5, 0.2 * coalesce(n_deceptive, 0)) + CASE WHEN max_length >= 5 THEN 0.2 WHEN max_length >= 3 THEN 0.1 ELSE 0 END + least(0.3, 0.15 * coalesce(hurt.n, 0)) + 0.2 * least(1, derived / 10)
 + CASE WHEN n_chains > 5 THEN 0.1 ELSE 0 END) AS score FROM landed d LEFT JOIN chained c ON c.gate_id = d.gate_id AND c.team = d.team LEFT JOIN hurt ON hurt.gate_id = d.gate_id AND hurt.team = d.team)"""


@query(f"WITH RECURSIVE {CHAINS} SELECT gate_id, team, n_chains, n_deceptive, CAST(max_length AS BIGINT) AS max_length, round(score::DOUBLE, 6) AS score FROM casc")
def cascade_greedy_chains(spark, d):
    return _round(cascade.chains(_hops(spark, d)))


@query(f"""WITH {MSG}, h AS (SELECT * FROM msg WHERE sender <> receiver AND value > 300), mem AS (SELECT DISTINCT gate_id, team, agent FROM (SELECT gate_id, team, sender AS agent FROM msg UNION ALL SELECT gate_id, team, receiver FROM msg))
 SELECT gate_id, team, count(h.seq) AS n FROM mem LEFT JOIN h ON h.gate_id = mem.gate_id AND h.team = mem.team AND h.sender = mem.agent GROUP BY mem.gate_id, mem.team""".replace("SELECT gate_id, team, count(h.seq)", "SELECT mem.gate_id AS gate_id, mem.team AS team, count(h.seq)"))
def cascade_injections(spark, d):
    m = _messages(spark, d)
    hit = _hops(spark, d).filter("injected").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return topology.members(m).select(*KEYS).distinct().join(hit, KEYS, "left").na.fill(0, ["n"])


@query(f"""WITH {MSG} SELECT seq, CASE WHEN seq % 3 = 0 THEN sender WHEN seq % 3 = 1 THEN 'caller' ELSE 'unknown' END AS sender, CASE WHEN seq % 4 < 3 THEN receiver ELSE 'unknown' END AS receiver,
 CASE WHEN seq % 5 > 0 THEN event_type WHEN seq % 4 < 3 THEN '{{"' || ['target_agent', 'receiver_id', 'to'][seq % 4 + 1] || '":"' || receiver || '"}}' ELSE '{{}}' END AS payload,
 'a2a_send' AS tool, CASE WHEN seq % 3 = 0 THEN 's' || seq END AS session_id FROM msg""")
def mcp_extract(spark, d):
    m = _messages(spark, d)
    k = F.col("seq") % 4
    args = F.struct(*[F.when(k == i, F.col("receiver")).alias(n) for i, n in enumerate(("target_agent", "receiver_id", "to"))], F.when(F.col("seq") % 5 > 0, F.col("event_type")).alias("message"))
    own = F.when(F.col("seq") % 3 == 0, F.struct(F.col("sender").alias("agent_id"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("session_id")))
    raw = F.to_json(F.struct(F.lit("a2a_send").alias("tool"), args.alias("arguments"), own.alias("context")))
    caller = F.when(F.col("seq") % 3 == 1, F.lit('{"caller_agent_id":"caller"}'))
    return m.select("seq", *src.mcp(raw, caller=caller)[:5])


@query(f"WITH {MSG} SELECT seq, event_type AS value, CASE WHEN value > 10 THEN 'WARN' ELSE 'ALLOW' END AS verdict, CASE WHEN value > 10 THEN 'high' END AS warning FROM msg")
def wrap_tool_result_json(spark, d):
    high = F.col("value") > 10
    j = src.wrap_tool_result(F.col("event_type"), F.when(high, "WARN").otherwise("ALLOW"), F.when(high, F.array(F.lit("high"))).otherwise(F.array().cast("array<string>")))
    return _messages(spark, d).select("seq", j.alias("j")).select("seq", *[F.get_json_object("j", p).alias(n) for n, p in (("value", "$.value"), ("verdict", "$._skein.verdict"), ("warning", "$._skein.warnings[0]"))])


@query(f"""WITH {MSG} SELECT seq, 'x-a2a-sender-agent-id=' || sender || ';x-a2a-receiver-agent-id=' || receiver || CASE WHEN seq % 3 = 0 THEN ';x-a2a-task-id=t' || seq ELSE '' END || ';kind=' || event_type AS headers FROM msg""")
def grpc_create_metadata(spark, d):
    task = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("t"), F.col("seq").cast("string"))).otherwise("")
    pairs = src.grpc_metadata(F.col("sender"), F.col("receiver"), task, F.create_map(F.lit("kind"), F.col("event_type")))
    return _messages(spark, d).select("seq", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"])), ";").alias("headers"))


@query(f"""WITH {NORM} SELECT gate_id, count(DISTINCT term) AS n_terms, count(*) AS n_uses FROM terms GROUP BY gate_id""")
def semantic_vocabulary(spark, d):
    t = semantic.counted(_messages(spark, d), "term")
    return t.groupBy("gate_id").agg(F.countDistinct("gram").alias("n_terms"), F.sum("c").alias("n_uses"))


def _lengths(spark, d):
    return _messages(spark, d).withColumn("length", F.length("payload"))


SIDE = f"""{MSG}, ch AS (SELECT gate_id, team, sender, receiver, seq, ts, length(payload) AS length FROM msg),
 dl AS (SELECT *, ts - lag(ts) OVER (PARTITION BY gate_id, team, sender, receiver ORDER BY ts, seq) AS delay FROM ch),
 sg AS (SELECT gate_id, team, sender, receiver, count(*) AS n, (max(ts) - min(ts)) / (count(*) - 1) AS mean, stddev_samp(delay) AS sd FROM dl GROUP BY ALL HAVING count(*) >= 3),
 reg AS (SELECT gate_id, team, avg(CASE WHEN mean = 0 THEN 1 ELSE greatest(0, least(1, 1 - sd / mean)) END) AS timing FROM sg GROUP BY ALL),
 tot AS (SELECT gate_id, team, sender, receiver, count(*) AS n, abs(avg((length % 2 = 0)::INT) - 0.5) * 2 AS par FROM ch GROUP BY ALL HAVING count(*) >= 5),
 cells AS (SELECT gate_id, team, sender, receiver, modulus, length % modulus AS r, count(*) AS o FROM ch, (VALUES (3), (5), (8)) t(modulus) GROUP BY ALL),
 modu AS (SELECT gate_id, team, sender, receiver, modulus, (CAST(sum(o * o) AS BIGINT) * modulus - sum(o) * sum(o)) / (sum(o) * sum(o) * modulus) AS s FROM cells GROUP BY gate_id, team, sender, receiver, modulus HAVING sum(o) >= 5),
 cl AS (SELECT gate_id, team, sender, receiver, max(c) / sum(c) AS s FROM (SELECT gate_id, team, sender, receiver, length, count(*) AS c FROM ch GROUP BY ALL) GROUP BY ALL HAVING sum(c) >= 5),
 fl AS (SELECT gate_id, team, par AS s FROM tot WHERE par > 0.7 UNION ALL SELECT gate_id, team, least(1, s) FROM modu WHERE s > 0.5 UNION ALL SELECT gate_id, team, s FROM cl WHERE s > 0.5),
 len AS (SELECT gate_id, team, avg(s) AS length FROM fl GROUP BY ALL),
 num AS (SELECT gate_id, team, sender, receiver, seq, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY gate_id, team) AS n, lead(sender) OVER w AS s2, lead(receiver) OVER w AS r2 FROM ch WINDOW w AS (PARTITION BY gate_id, team ORDER BY seq)),
 tr AS (SELECT a.gate_id, a.team, p, avg((a.sender = b.sender)::INT) AS r FROM num a JOIN (VALUES (2), (3), (4), (5)) t(p) ON p <= a.n // 2 JOIN num b ON b.gate_id = a.gate_id AND b.team = a.team AND b.i = a.i % p GROUP BY ALL),
 best AS (SELECT gate_id, team, arg_min(r, p) AS r FROM tr WHERE r > 0.8 GROUP BY ALL),
 ans AS (SELECT gate_id, team, count(*) FILTER (i % 2 = 0 AND sender = r2 AND receiver = s2) / (any_value(n) // 2) AS ratio FROM num WHERE n >= 4 GROUP BY ALL),
 ord AS (SELECT gate_id, team, coalesce(r, CASE WHEN ratio > 0.8 THEN 0.3 * ratio ELSE 0 END) AS ordering FROM ans LEFT JOIN best USING (gate_id, team)),
 ss AS (SELECT gate_id, team, round(coalesce(timing, 0), 6) AS timing, round(coalesce(length, 0), 6) AS length, round(coalesce(ordering, 0), 6) AS ordering
 FROM (SELECT DISTINCT gate_id, team FROM msg) LEFT JOIN reg USING (gate_id, team) LEFT JOIN len USING (gate_id, team) LEFT JOIN ord USING (gate_id, team)),
 side AS (SELECT *, CASE WHEN timing > 0.9 THEN 0.4 WHEN timing > 0.7 THEN 0.25 WHEN timing > 0.5 THEN 0.1 ELSE 0 END + CASE WHEN length > 0.7 THEN 0.35 WHEN length > 0.4 THEN 0.2 WHEN length > 0.2 THEN 0.1 ELSE 0 END
 + CASE WHEN ordering > 0.7 THEN 0.25 WHEN ordering > 0.4 THEN 0.15 ELSE 0 END AS risk FROM ss)"""


@query(f"WITH {SIDE} SELECT gate_id, team, timing, length, ordering, round(risk::DOUBLE, 6) AS risk FROM side")
def sidechannel_risk(spark, d):
    """The whole family of each team: regularity and length scores over its edges, order of its messages."""
    return _round(sidechannel.team_scores(_lengths(spark, d)))


@query(f"WITH RECURSIVE {CHAINS} SELECT gate_id, team, round(score::DOUBLE, 6) AS risk FROM casc")
def cascade_risk(spark, d):
    return _round(cascade.chains(_hops(spark, d)).select(*KEYS, F.col("score").alias("risk")))


#: Fixed values of the demonstration: the capabilities that agents declare, by their numbers.
DECLARED = ("read-untrusted", "code-exec", "memory-write", "identity-assumption", "write-trusted", "net-egress")


def _manifest(m):
    """Per team the union of its members' declared capabilities: agent i declares name (i div 6 + i mod 3) mod 8 of the list, if there is one."""
    i = F.substr("agent", F.lit(2)).cast("int")
    name = F.get(F.array(*map(F.lit, DECLARED)), (F.floor(i / 6) + i % 3).cast("int") % 8)
    return topology.members(m).groupBy(*KEYS).agg(F.array_sort(F.collect_set(name)).alias("caps"))


def _verdicts(spark, d):
    m = _messages(spark, d)
    found = topology.topology(m).select(*KEYS, F.round("risk", 6).alias("topology"))
    families = {
        "semantic": _semantic(spark, d), "privilege": _privilege(spark, d), "sidechannel": sidechannel.team_scores(_lengths(spark, d)), "cascade": cascade.chains(_hops(spark, d)).withColumnRenamed("score", "risk"),
    }
    for name, df in families.items():
        found = found.join(df.select(*KEYS, F.round("risk", 6).alias(name)), KEYS, "left")
    found = found.na.fill(0.0, list(families)).join(_manifest(m), KEYS)
    scores = {name: F.col(name) for name in ("topology", *families)}
    found = found.withColumn("r_team", verdict.composite(list(scores.values()))).withColumn("safety_class", privilege.safety_class(F.col("caps")))
    asked = verdict.policy(F.col("caps"), scores, POLICIES)
    return found.select(*KEYS, *scores, "r_team", "safety_class", verdict.worst([verdict.band(F.col("r_team")), verdict.safety_minimum(F.col("safety_class")), asked]).alias("verdict"))


def _without(sql: str, first: str) -> str:
    """SQL of CTEs without the ones that another text has already."""
    return sql.removeprefix(first + ", ")


VERDICTS = f"""{TEAMS}, {_without(NORM, MSG)}, {_without(COS, NORM)}, {_without(SEMANTIC, COS)}, {_without(PRIVILEGE, MSG)}, {_without(SIDE, MSG)}, {_without(CHAINS, MSG)},
 dcl AS (SELECT gate_id, team, list_sort(list_distinct(list(['read-untrusted', 'code-exec', 'memory-write', 'identity-assumption', 'write-trusted', 'net-egress'][1 + (i // 6 + i % 3) % 8]))) AS caps
 FROM (SELECT gate_id, team, CAST(substr(agent, 2) AS INT) AS i FROM mem) GROUP BY ALL),
 fam AS (SELECT t.gate_id, t.team, round(t.risk::DOUBLE, 6) AS topology, round(coalesce(s.risk, 0)::DOUBLE, 6) AS semantic, round(coalesce(p.risk, 0)::DOUBLE, 6) AS privilege, round(coalesce(x.risk, 0)::DOUBLE, 6) AS sidechannel,
 round(coalesce(c.score, 0)::DOUBLE, 6) AS cascade, caps FROM risks t LEFT JOIN sema s ON s.gate_id = t.gate_id AND s.team = t.team LEFT JOIN priv p ON p.gate_id = t.gate_id AND p.team = t.team
 LEFT JOIN side x ON x.gate_id = t.gate_id AND x.team = t.team LEFT JOIN casc c ON c.gate_id = t.gate_id AND c.team = t.team JOIN dcl d ON d.gate_id = t.gate_id AND d.team = t.team),
 rt AS (SELECT *, 1 - (1 - 0.2 * topology) * (1 - 0.2 * semantic) * (1 - 0.2 * privilege) * (1 - 0.2 * sidechannel) * (1 - 0.2 * cascade) AS r,
 CASE WHEN len(list_intersect(caps, ['read-untrusted', 'code-exec', 'memory-write', 'identity-assumption'])) >= 3 THEN 'HIGH_RISK' WHEN list_has_all(caps, ['read-untrusted', 'write-trusted']) OR list_has_all(caps, ['code-exec', 'net-egress'])
 OR list_has_all(caps, ['memory-write', 'identity-assumption']) THEN 'RESTRICTED' ELSE 'STANDARD' END AS safety_class FROM fam),
 said AS (SELECT *, {BAND} AS by_risk, CASE safety_class WHEN 'HIGH_RISK' THEN 'THROTTLE' WHEN 'RESTRICTED' THEN 'WARN' ELSE 'ALLOW' END AS by_safety,
 CASE WHEN list_contains(caps, 'code-exec') THEN 'ISOLATE' WHEN topology > 0.5 THEN 'THROTTLE' WHEN semantic > 0.5 THEN 'WARN' ELSE 'ALLOW' END AS by_policy FROM rt),
 vo AS (SELECT ['ALLOW', 'WARN', 'THROTTLE', 'ISOLATE', 'TERMINATE'] AS o)"""


@query(f"""WITH RECURSIVE {VERDICTS} SELECT gate_id, team, topology, semantic, privilege, sidechannel, cascade, r AS r_team, safety_class,
 o[greatest(list_position(o, by_risk), list_position(o, by_safety), list_position(o, by_policy))] AS verdict FROM said, vo""")
def team_verdict_snapshot(spark, d):
    """Messages to teams, to the risks of all five families, to the composite risk, and the worst of its band, the safety class and the policies."""
    return _verdicts(spark, d)


@query(f"WITH {CONV}, " + """nx AS (SELECT *, lead(sender) OVER w AS s2, lead(receiver) OVER w AS r2 FROM num WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
 rr AS (SELECT conv_id, count(*) FILTER (i % 2 = 0 AND sender = r2 AND receiver = s2) / (any_value(n) // 2) AS ratio FROM nx WHERE n >= 4 GROUP BY conv_id),
 tr AS (SELECT a.conv_id, p, avg((a.sender = b.sender)::INT) AS r FROM num a JOIN (VALUES (2), (3), (4), (5)) t(p) ON p <= a.n // 2 JOIN num b ON b.conv_id = a.conv_id AND b.i = a.i % p GROUP BY ALL),
 best AS (SELECT conv_id, arg_min(r, p) AS r, min(p) AS period FROM tr WHERE r > 0.8 GROUP BY conv_id)
 SELECT conv_id, coalesce(r, CASE WHEN ratio > 0.8 THEN 0.3::DOUBLE * ratio ELSE 0 END) AS ordering,
 CASE WHEN r IS NOT NULL THEN 'ordering:periodic_sender:period=' || period WHEN ratio > 0.8 THEN 'ordering:strict_request_response' END AS pattern FROM rr LEFT JOIN best USING (conv_id)""")
def sidechannel_ordering(spark, d):
    return sidechannel.ordering(_conv(spark, d))
