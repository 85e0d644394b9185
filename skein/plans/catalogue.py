"""The registered queries: each operator over the driver's tables, and the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import config
from skein.operators import cascade, detector, privilege, semantic, sidechannel, topology, trail, verdict
from skein.sources import messages as src

DAY = 86400.0
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return src.messages(src.read(spark, d, "events"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """For what is a sum of floats, which come in any order: both engines compare rounded. Where a plan computes from integers with one division,
    or in a fixed order, nothing is rounded: a tie would round differently in two engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MSG = """msg AS (SELECT event_id AS seq, 'g' || (event_id % 4) AS gate_id, 't' || (user_id % 150 - user_id % 150 % 6) AS team, 'a' || (user_id % 150) AS sender,
 'a' || CASE WHEN event_id % 97 = 0 THEN user_id % 150 ELSE user_id % 150 - user_id % 150 % 6 + (user_id % 150 % 6 + 1 + event_id % 5) % 6 END AS receiver,
 epoch_us(ts) / 1e6 AS ts, event_type || ' ' || props AS payload, event_type, value FROM events)"""
HITS = f"""{MSG}, dirs AS (SELECT gate_id, least(sender, receiver) AS a, greatest(sender, receiver) AS b, sender < receiver AS up, seq, ts FROM msg WHERE sender <> receiver),
 prior AS (SELECT *, last_value(CASE WHEN up THEN ts END IGNORE NULLS) OVER w AS lu, last_value(CASE WHEN NOT up THEN ts END IGNORE NULLS) OVER w AS ld FROM dirs
 WINDOW w AS (PARTITION BY gate_id, a, b ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 hits AS (SELECT gate_id, a, b, seq, ts FROM prior WHERE ts - CASE WHEN up THEN ld ELSE lu END < 86400)"""


@query(f"WITH {MSG} SELECT seq, sender, receiver, payload, ts FROM msg")
def edge_normalize(spark, d):
    return src.normalized(_messages(spark, d))


@query(f"WITH {MSG} SELECT gate_id, count(*) AS n FROM msg WHERE sender <> receiver GROUP BY gate_id")
def self_loop_filter(spark, d):
    return _messages(spark, d).filter("sender != receiver").groupBy("gate_id").agg(F.count(F.lit(1)).alias("n"))


def _envelopes(spark, d):
    """JSON-RPC texts with ids in three places, missing ids, and broken ones."""
    m = _messages(spark, d)
    part = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text")))
    kind = F.col("seq") % 4
    whole = F.to_json(F.struct(F.lit("message/send").alias("method"), F.struct(
        F.when(kind == 0, F.struct(F.col("sender").alias("sender_agent_id"), F.col("receiver").alias("receiver_agent_id"))).alias("metadata"),
        F.when(kind == 1, F.col("sender")).alias("from"), F.when(kind == 1, F.col("receiver")).alias("to"),
        F.struct(part(F.col("event_type")).alias("parts")).alias("message")).alias("params")))
    return m.withColumn("raw", F.when(kind == 3, F.concat(F.lit("{broken "), F.col("event_type"))).otherwise(whole))


@query(f"""WITH {MSG} SELECT seq, CASE WHEN seq % 4 < 2 THEN sender ELSE 'unknown' END AS sender, CASE WHEN seq % 4 < 2 THEN receiver ELSE 'unknown' END AS receiver,
 CASE WHEN seq % 4 = 3 THEN '{{broken ' || event_type ELSE event_type || ' end' END AS payload, CASE WHEN seq % 4 < 3 THEN 'message/send' END AS method, seq % 4 = 3 AS parse_error FROM msg""")
def jsonrpc_extract(spark, d):
    return _envelopes(spark, d).select("seq", *src.jsonrpc(F.col("raw"))[:5])


@query(f"""WITH {MSG} SELECT seq, CASE WHEN seq % 8 = 0 THEN event_type || ' bare' WHEN seq % 8 = 1 THEN 'bare ' || event_type WHEN seq % 8 = 2 THEN '{{}}' WHEN seq % 8 = 3 THEN '{{"parts":[{{"type":"data"}}]}}'
 WHEN seq % 8 = 4 THEN event_type WHEN seq % 8 = 5 THEN '{{}}' WHEN seq % 8 = 6 THEN ' end' ELSE '[' || seq END AS payload,
 CASE WHEN seq % 8 = 7 THEN 'x-skein-parse-error=true' ELSE CASE WHEN seq % 8 = 0 THEN 'x-a2a-method=message/send;' ELSE '' END || 'x-a2a-protocol=a2a-0.3.0' || CASE WHEN seq % 8 IN (0, 1) THEN ';x-a2a-rpc-id=r' || seq ELSE '' END
 || CASE WHEN seq % 8 = 2 THEN ';x-a2a-task-id=t' || seq ELSE '' END || ';x-a2a-transport=json-rpc' END AS headers FROM msg""")
def jsonrpc_shapes(spark, d):
    """Messages of text parts, bare strings, other parts, no parts, plain text and none at all, and what each puts into the headers."""
    k, kind = F.col("seq").cast("string"), F.col("seq") % 8
    raws = [
        F.concat(F.lit('{"method":"message/send","id":"r'), k, F.lit('","params":{"message":{"parts":[{"type":"text","text":"'), F.col("event_type"), F.lit('"},"bare",{"type":"data"}]}}}')),
        F.concat(F.lit('{"id":"r'), k, F.lit('","params":{"message":{"parts":["bare",{"type":"text","text":"'), F.col("event_type"), F.lit('"}]}}}')),
        F.concat(F.lit('{"params":{"id":"t'), k, F.lit('"}}')),
        F.lit('{"params":{"message":{"parts":[{"type":"data"}]}}}'),
        F.concat(F.lit('{"params":{"message":"'), F.col("event_type"), F.lit('"}}')),
        F.lit('{"method":"","id":"","params":{"message":{}}}'),
        F.lit('{"params":{"message":{"parts":[{"type":"text"},{"type":"text","text":"end"},7]}}}'),
        F.concat(F.lit("["), k),
    ]
    raw = F.coalesce(*[F.when(kind == i, x) for i, x in enumerate(raws)])
    found = src.jsonrpc(raw)
    return _messages(spark, d).select("seq", found[2], src.listed(found[5]).alias("headers"))


@query(f"""WITH {MSG} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE sender END AS sender, receiver, CASE WHEN seq % 5 = 0 THEN '<binary:2bytes>' ELSE payload END AS payload,
 CASE WHEN seq % 3 = 0 THEN 3 ELSE 4 END AS n_headers FROM msg""")
def grpc_extract(spark, d):
    m = _messages(spark, d)
    headers = F.map_filter(F.create_map(F.lit("X-A2A-Receiver-Agent-Id"), F.col("receiver"), F.lit("x-a2a-sender-agent-id"), F.when(F.col("seq") % 3 != 0, F.col("sender")), F.lit("other"), F.lit("1")), lambda k, v: v.isNotNull())
    payload = F.when(F.col("seq") % 5 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.encode("payload", "UTF-8"))
    s, r, p, h = src.grpc(payload, F.map_entries(headers))
    return m.select("seq", s, r, p, F.size(h).alias("n_headers"))


@query(f"""WITH {MSG} SELECT seq, CASE WHEN seq % 4 = 3 THEN 'unknown' WHEN seq % 4 = 1 THEN 'late' ELSE sender END AS sender, CASE WHEN seq % 4 = 3 THEN 'unknown' ELSE receiver END AS receiver,
 CASE WHEN seq % 4 = 3 THEN 'x-a2a-protocol=a2a-0.3.0;x-a2a-transport=grpc' ELSE 'x-a2a-protocol=' || CASE WHEN seq % 4 = 2 THEN 'own' ELSE 'a2a-0.3.0' END || ';x-a2a-receiver-agent-id=' || receiver || ';x-a2a-sender-agent-id='
 || CASE WHEN seq % 4 = 1 THEN 'late' ELSE sender END || ';x-a2a-transport=grpc' END AS headers FROM msg""")
def grpc_pairs(spark, d):
    """Metadata as a list of pairs: names that differ in case only (the last counts), a pair that overrides a header of the protocol, and no metadata."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    base = [pair("X-A2A-Sender-Agent-Id", F.col("sender")), pair("x-a2a-receiver-agent-id", F.col("receiver")), pair("kind", F.col("event_type"))]
    kind = F.col("seq") % 4
    pairs = F.when(kind == 0, F.array(*base)).when(kind == 1, F.array(*base, pair("x-a2a-sender-agent-id", F.lit("late")))).when(kind == 2, F.array(*base, pair("x-a2a-protocol", F.lit("own"))))
    s, r, _, h = src.grpc(F.encode("payload", "UTF-8"), pairs)
    return _messages(spark, d).select("seq", s, r, src.listed(h).alias("headers"))


@query("""SELECT event_id AS seq, lower(CASE event_type WHEN 'click' THEN 'A2A_Send' WHEN 'error' THEN 'delegate_task' ELSE event_type END) IN
 ('a2a_send', 'a2a_delegate', 'a2a_query', 'a2a_respond', 'agent_send', 'agent_delegate', 'send_to_agent', 'delegate_task', 'signup') AS carries FROM events""")
def mcp_tool_filter(spark, d):
    e = src.read(spark, d, "events")
    tool = F.when(F.col("event_type") == "click", "A2A_Send").when(F.col("event_type") == "error", "delegate_task").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), src.carries_messages(tool, ("Signup",)).alias("carries"))


@query(f"WITH {MSG} SELECT seq, event_type AS value, CASE WHEN value > 10 THEN 'WARN' ELSE 'ALLOW' END AS verdict FROM msg")
def wrap_response_json(spark, d):
    v = F.when(F.col("value") > 10, "WARN").otherwise("ALLOW")
    m = _messages(spark, d).select("seq", src.wrap_response(F.col("seq"), F.col("event_type"), v).alias("j"))
    return m.select("seq", F.get_json_object("j", "$.result.value").alias("value"), F.get_json_object("j", "$.result.metadata.verdict").alias("verdict"))


@query(f"WITH {MSG} SELECT gate_id, count(*) AS n FROM msg GROUP BY gate_id")
def message_count(spark, d):
    return _messages(spark, d).groupBy("gate_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HITS} SELECT gate_id, a, b, min(ts) AS formed_at, count(*) AS n_hits FROM hits GROUP BY ALL")
def bidirectional_pairs(spark, d):
    return detector.bidirectional_pairs(_messages(spark, d), DAY)


@query(f"""WITH {HITS}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 86400 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY gate_id, a, b ORDER BY seq)),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY gate_id, a, b ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked)
 SELECT gate_id, a, b, CAST(island AS BIGINT) AS island, min(ts) AS starts, max(ts) + 86400 AS ends, count(*) AS n_hits FROM numbered GROUP BY gate_id, a, b, island""")
def pair_alive_intervals(spark, d):
    return detector.alive_intervals(_messages(spark, d), DAY)


@query(f"""WITH RECURSIVE {HITS}, pairs AS (SELECT DISTINCT gate_id, a, b FROM hits), both_ways AS (SELECT gate_id, a AS x, b AS y FROM pairs UNION SELECT gate_id, b, a FROM pairs),
 reach(gate_id, x, y) AS (SELECT gate_id, x, x FROM both_ways UNION SELECT r.gate_id, r.x, e.y FROM reach r JOIN both_ways e ON e.gate_id = r.gate_id AND e.x = r.y)
 SELECT gate_id, x AS agent, min(y) AS team FROM reach GROUP BY gate_id, x""")
def team_components(spark, d):
    return detector.teams(detector.bidirectional_pairs(_messages(spark, d), DAY))


TEAMS = f"""{MSG}, mem AS (SELECT DISTINCT gate_id, team, agent FROM (SELECT gate_id, team, sender AS agent FROM msg UNION ALL SELECT gate_id, team, receiver FROM msg)),
 sizes AS (SELECT gate_id, team, count(*) AS n FROM mem GROUP BY ALL), edges AS (SELECT DISTINCT gate_id, team, sender, receiver FROM msg),
 dens AS (SELECT m.gate_id, m.team, n, n_messages, CASE WHEN n > 1 THEN n_messages / (n * (n - 1)) ELSE 0 END AS density, CASE WHEN n > 1 THEN n_edges / (n * (n - 1)) ELSE 0 END AS density_distinct
 FROM (SELECT gate_id, team, count(*) AS n_messages, count(DISTINCT sender || '>' || receiver) AS n_edges FROM msg GROUP BY ALL) m JOIN sizes USING (gate_id, team)),
 degs AS (SELECT gate_id, team, agent, (SELECT count(*) FROM edges e WHERE e.gate_id = mem.gate_id AND e.team = mem.team AND e.sender = agent) AS n_out,
 (SELECT count(*) FROM edges e WHERE e.gate_id = mem.gate_id AND e.team = mem.team AND e.receiver = agent) AS n_in FROM mem),
 stats AS (SELECT gate_id, team, max(n_out) AS max_out, max(n_in) AS max_in, avg(n_in + n_out) AS avg_degree,
 CASE WHEN count(*) > 1 AND max(n_in + n_out) > 0 THEN sqrt((count(*) * sum((n_in + n_out) * (n_in + n_out)) - sum(n_in + n_out) * sum(n_in + n_out))::DOUBLE) / (count(*) * max(n_in + n_out)) ELSE 0 END AS degree_skew FROM degs GROUP BY ALL),
 und AS (SELECT DISTINCT gate_id, team, least(sender, receiver) AS u, greatest(sender, receiver) AS v FROM msg WHERE sender <> receiver),
 bothw AS (SELECT gate_id, team, u, v FROM und UNION ALL SELECT gate_id, team, v, u FROM und),
 deg AS (SELECT gate_id, team, u AS agent, count(*) AS k FROM bothw GROUP BY ALL),
 tri AS (SELECT e.gate_id, e.team, e.u AS agent, count(*) AS tri FROM bothw e JOIN bothw f ON e.gate_id = f.gate_id AND e.team = f.team AND e.u = f.u AND e.v < f.v
 JOIN und g ON g.gate_id = e.gate_id AND g.team = e.team AND g.u = e.v AND g.v = f.v GROUP BY ALL),
 loops AS (SELECT DISTINCT gate_id, team, sender AS agent, 1 AS loop FROM msg WHERE sender = receiver),
 near AS (SELECT gate_id, team, agent, coalesce(k, 0) + coalesce(loop, 0) AS k, coalesce(tri, 0) + coalesce(loop, 0) * coalesce(k, 0) AS tri
 FROM mem LEFT JOIN deg USING (gate_id, team, agent) LEFT JOIN loops USING (gate_id, team, agent) LEFT JOIN tri USING (gate_id, team, agent)),
 clus AS (SELECT gate_id, team, CASE WHEN count(*) >= 3 THEN avg(CASE WHEN k >= 2 THEN tri / (k * (k - 1) / 2) ELSE 0 END) ELSE 0 END AS clustering FROM near GROUP BY ALL),
 creach(gate_id, team, x, y) AS (SELECT gate_id, team, u, u FROM bothw UNION SELECT r.gate_id, r.team, r.x, e.v FROM creach r JOIN bothw e ON e.gate_id = r.gate_id AND e.team = r.team AND e.u = r.y),
 cpart AS (SELECT gate_id, team, x AS agent, min(y) AS part FROM creach GROUP BY ALL),
 cmean AS (SELECT *, avg(k) OVER (PARTITION BY gate_id, team, part) AS mean FROM cpart JOIN near USING (gate_id, team, agent)),
 cbyp AS (SELECT gate_id, team, part, count(*) FILTER (k > mean) AS high, count(*) FILTER (k <= mean) AS low FROM cmean GROUP BY ALL),
 cbyt AS (SELECT gate_id, team, count(*) AS parts, max(high) AS high, max(low) AS low FROM cbyp GROUP BY ALL),
 coal AS (SELECT gate_id, team, CAST(CASE WHEN n < 3 THEN 0 WHEN parts > 1 THEN parts WHEN n >= 4 AND high >= 2 AND low >= 2 THEN 2 ELSE 0 END AS BIGINT) AS n_coalitions FROM sizes LEFT JOIN cbyt USING (gate_id, team)),
 shape AS (SELECT *, CASE WHEN n < 2 THEN 'degenerate' WHEN degree_skew > 0.6 AND greatest(max_out, max_in) >= n - 1 THEN 'star' WHEN density > 0.7 AND degree_skew < 0.3 THEN 'mesh'
 WHEN n >= 3 AND avg_degree BETWEEN 1.5 AND 2.5 AND degree_skew < 0.2 THEN 'ring' WHEN density > 0.3 AND density < 0.7 AND degree_skew > 0.3 THEN 'hierarchical' ELSE 'unclassified' END AS class
 FROM dens JOIN stats USING (gate_id, team) JOIN clus USING (gate_id, team) JOIN coal USING (gate_id, team)),
 risks AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE least(1, CASE WHEN density > 0.85 THEN 0.25 WHEN density < 0.15 AND n > 2 THEN 0.15 ELSE 0 END + degree_skew * 0.25
 + CASE class WHEN 'star' THEN 0.35 WHEN 'hierarchical' THEN 0.15 WHEN 'mesh' THEN 0.1 WHEN 'ring' THEN 0.05 WHEN 'unclassified' THEN 0.1 ELSE 0 END
 + CASE WHEN n_coalitions > 1 THEN least(0.3, 0.15 * n_coalitions) ELSE 0 END + CASE WHEN clustering > 0.8 AND n > 3 THEN 0.15 ELSE 0 END) END AS risk FROM shape)"""


@query(f"WITH RECURSIVE {TEAMS} SELECT gate_id, team, n, n_messages, density::DOUBLE AS density, density_distinct::DOUBLE AS density_distinct FROM dens")
def topology_edge_density(spark, d):
    return topology.density(_messages(spark, d))


@query(f"WITH RECURSIVE {TEAMS} SELECT * FROM degs")
def topology_degrees(spark, d):
    return topology.degrees(_messages(spark, d))


@query(f"WITH RECURSIVE {TEAMS} SELECT gate_id, team, max_out, max_in, avg_degree, degree_skew::DOUBLE AS degree_skew FROM stats")
def topology_degree_stats(spark, d):
    return topology.degree_stats(_messages(spark, d))


@query(f"WITH RECURSIVE {TEAMS} SELECT gate_id, team, round(clustering, 6) AS clustering FROM clus")
def topology_clustering(spark, d):
    return _round(topology.clustering(_messages(spark, d)))


@query(f"WITH RECURSIVE {TEAMS} SELECT gate_id, team, class, round(risk, 6) AS risk FROM risks")
def topology_risk(spark, d):
    return _round(topology.topology(_messages(spark, d)).select("gate_id", "team", "class", "risk"))


BAND = "CASE WHEN r < 0.4 THEN 'ALLOW' WHEN r < 0.65 THEN 'WARN' WHEN r < 0.8 THEN 'THROTTLE' WHEN r < 0.92 THEN 'ISOLATE' ELSE 'TERMINATE' END"


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g') AS normalized FROM documents")
def text_normalize(spark, d):
    return src.read(spark, d, "documents").select("doc_id", semantic.normalize(F.col("text")).alias("normalized"))


NORM = rf"""{MSG}, norm AS (SELECT gate_id, team, sender AS agent, seq, regexp_replace(regexp_replace(lower(payload), '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') AS t FROM msg),
 terms AS (SELECT gate_id, team, agent, seq, term FROM (SELECT *, unnest(string_split(t, ' ')) AS term FROM norm) WHERE length(term) >= 2),
 grams AS (SELECT gate_id, team, agent, gram, count(*) AS c FROM (SELECT gate_id, team, agent, substr(t, i, 3) AS gram FROM (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM norm)) GROUP BY ALL)"""


@query(f"WITH {NORM} SELECT gate_id, team, agent, gram, c FROM grams")
def text_trigrams(spark, d):
    return semantic.counted(_messages(spark, d), "trigram")


@query(f"WITH {NORM} SELECT gate_id, team, agent, term AS gram, count(*) AS c FROM terms GROUP BY ALL")
def text_terms(spark, d):
    return semantic.counted(_messages(spark, d), "term")


COS = f"""{NORM}, ns AS (SELECT gate_id, team, agent, sqrt(sum(c * c)) AS norm FROM grams GROUP BY ALL),
 dots AS (SELECT x.gate_id, x.team, x.agent AS agent_a, y.agent AS agent_b, sum(x.c * y.c) AS dot FROM grams x JOIN grams y ON x.gate_id = y.gate_id AND x.team = y.team AND x.gram = y.gram AND x.agent < y.agent GROUP BY ALL),
 cos AS (SELECT p.gate_id, p.team, p.agent AS agent_a, q.agent AS agent_b, coalesce(dot / (p.norm * q.norm), 0) AS cosine FROM ns p JOIN ns q ON p.gate_id = q.gate_id AND p.team = q.team AND p.agent < q.agent
 LEFT JOIN dots ON dots.gate_id = p.gate_id AND dots.team = p.team AND agent_a = p.agent AND agent_b = q.agent)"""


@query(f"WITH {COS} SELECT gate_id, team, agent_a, agent_b, cosine::DOUBLE AS cosine FROM cos")
def semantic_cosine_pairs(spark, d):
    return semantic.cosine_pairs(_messages(spark, d))


@query(f"WITH {COS} SELECT gate_id, team, round(avg(cosine), 6) AS similarity FROM cos GROUP BY ALL")
def semantic_avg_similarity(spark, d):
    return _round(semantic.average_similarity(_messages(spark, d)))


@query(f"""WITH {NORM}, n AS (SELECT gate_id, team, count(DISTINCT agent) AS n FROM terms GROUP BY ALL), per AS (SELECT gate_id, team, term, count(DISTINCT agent) AS k FROM terms GROUP BY ALL)
 SELECT gate_id, team, count(*) FILTER (k = n) / count(*) AS overlap FROM per JOIN n USING (gate_id, team) GROUP BY gate_id, team""")
def semantic_vocab_overlap(spark, d):
    return semantic.vocabulary_overlap(_messages(spark, d))


@query(f"""WITH {NORM}, nm AS (SELECT gate_id, count(*) AS n FROM norm WHERE t <> '' GROUP BY ALL), df AS (SELECT gate_id, term, count(DISTINCT seq) AS df FROM terms GROUP BY ALL),
 tf AS (SELECT gate_id, team, term, count(*) AS tf, count(DISTINCT agent) AS k FROM terms GROUP BY ALL HAVING count(DISTINCT agent) >= 2),
 sc AS (SELECT gate_id, team, term, round(tf * ln(n / df) * k, 6) AS score FROM tf JOIN df USING (gate_id, term) JOIN nm USING (gate_id)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY gate_id, team ORDER BY score DESC, term) AS rank FROM sc) SELECT gate_id, team, term, score, rank FROM rk WHERE rank <= 10""")
def semantic_specialized_terms(spark, d):
    return semantic.specialized_terms(_messages(spark, d))


DAYS = f"""{MSG}, days AS (SELECT gate_id, CAST(floor(ts / 86400) AS BIGINT) AS x, round(avg(value), 6) AS y FROM msg GROUP BY ALL)"""


@query(f"""WITH {DAYS} SELECT gate_id, x, round(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(y, x) OVER w ELSE 0 END, 4) AS trend FROM days
 WINDOW w AS (PARTITION BY gate_id ORDER BY x ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def semantic_trend(spark, d):
    m = _messages(spark, d)
    days = m.groupBy("gate_id", F.floor(F.col("ts") / 86400).alias("x")).agg(F.round(F.avg("value"), 6).alias("y"))
    return _round(semantic.trend(days), 4)


CAPS = f"""{MSG}, used AS (SELECT sender AS agent, event_type AS capability, count(*) AS n FROM msg GROUP BY ALL), declared AS (SELECT agent, capability FROM used WHERE n % 3 <> 0)"""


def _declared(spark, d):
    return src.member_capabilities(src.read(spark, d, "events")).filter("n % 3 != 0").select("agent", "capability")


@query(f"""WITH {CAPS} SELECT seq, sender, receiver, event_type AS capability FROM msg m WHERE EXISTS (SELECT 1 FROM declared x WHERE x.agent = sender AND x.capability = event_type)
 AND NOT EXISTS (SELECT 1 FROM declared x WHERE x.agent = receiver AND x.capability = event_type)""")
def privilege_laundering(spark, d):
    flows = _messages(spark, d).select("seq", "sender", "receiver", F.col("event_type").alias("capability"))
    return privilege.laundering(flows, _declared(spark, d)).select("seq", "sender", "receiver", "capability")


@query(f"""WITH {CAPS} SELECT sender AS agent, count(*) AS n FROM msg WHERE sender IN (SELECT agent FROM declared) AND NOT EXISTS (SELECT 1 FROM declared x WHERE x.agent = sender AND x.capability = event_type) GROUP BY sender""")
def privilege_boundary_violations(spark, d):
    used = _messages(spark, d).select(F.col("sender").alias("agent"), F.col("event_type").alias("capability"))
    return privilege.violations(used, _declared(spark, d)).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CAPS} SELECT team, count(DISTINCT event_type) AS n FROM msg GROUP BY team")
def privilege_unique_caps(spark, d):
    return _messages(spark, d).groupBy("team").agg(F.countDistinct("event_type").alias("n"))


@query(f"""WITH {MSG}, u AS (SELECT team, sender AS agent, count(*) AS n FROM msg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n, agent) AS i, count(*) OVER (PARTITION BY team) AS k FROM u)
 SELECT team, 0.0::DOUBLE AS gini_reference, sum((2 * i - k - 1) * n) / (max(k) * sum(n)) AS gini_standard FROM r GROUP BY team""")
def privilege_gini(spark, d):
    usage = _messages(spark, d).groupBy("team", F.col("sender").alias("agent")).agg(F.count(F.lit(1)).alias("n"))
    return privilege.concentration(usage, "team")


CHANNEL = "ch AS (SELECT event_id AS seq, 'a' || user_id AS sender, event_type AS receiver, epoch_us(ts) / 1e6 AS ts, CAST(floor(value * 100) AS BIGINT) AS length FROM events)"


def _channel(spark, d):
    e = src.read(spark, d, "events")
    ts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("sender"), F.col("event_type").alias("receiver"), ts.alias("ts"), F.floor(F.col("value") * 100).alias("length"))


@query(f"WITH {CHANNEL} SELECT sender, receiver, seq, ts, ts - lag(ts) OVER (PARTITION BY sender, receiver ORDER BY ts, seq) AS delay FROM ch")
def sidechannel_delays(spark, d):
    return sidechannel.delays(_channel(spark, d))


@query(f"""WITH {CHANNEL}, dl AS (SELECT sender, receiver, ts, ts - lag(ts) OVER (PARTITION BY sender, receiver ORDER BY ts, seq) AS delay FROM ch),
 g AS (SELECT sender, receiver, count(*) AS n, (max(ts) - min(ts)) / (count(*) - 1) AS mean, stddev_samp(delay) AS sd FROM dl GROUP BY ALL HAVING count(*) >= 3)
 SELECT sender, receiver, n, mean, round(CASE WHEN mean = 0 THEN 1 ELSE greatest(0, least(1, 1 - sd / mean)) END, 6) AS regularity FROM g""")
def sidechannel_timing(spark, d):
    return sidechannel.timing(_channel(spark, d)).select("sender", "receiver", "n", "mean", F.round("regularity", 6).alias("regularity"))


@query(f"WITH {CHANNEL} SELECT sender, receiver, count(*) AS n, abs(avg((length % 2 = 0)::INT) - 0.5) * 2 AS deviation FROM ch GROUP BY ALL HAVING count(*) >= 5")
def sidechannel_parity(spark, d):
    return sidechannel.parity(_channel(spark, d))


MODULAR = """cells AS (SELECT sender, receiver, modulus, length % modulus AS r, count(*) AS o FROM ch, (VALUES (3), (5), (8)) t(modulus) GROUP BY ALL),
 tot AS (SELECT sender, receiver, count(*) AS n FROM ch GROUP BY ALL HAVING count(*) >= 5),
 modu AS (SELECT sender, receiver, modulus, n, (CAST(sum(o * o) AS BIGINT) * modulus - n * n) / (n * n * modulus) AS score FROM cells JOIN tot USING (sender, receiver) GROUP BY sender, receiver, modulus, n)"""


@query(f"WITH {CHANNEL}, {MODULAR} SELECT sender, receiver, modulus, n, score FROM modu")
def sidechannel_modular(spark, d):
    return sidechannel.modular(_channel(spark, d))


CLUSTER = "cl AS (SELECT sender, receiver, sum(c) AS n, max(c) / sum(c) AS share FROM (SELECT sender, receiver, length, count(*) AS c FROM ch GROUP BY ALL) GROUP BY ALL HAVING sum(c) >= 5)"


@query(f"WITH {CHANNEL}, {CLUSTER} SELECT sender, receiver, CAST(n AS BIGINT) AS n, share FROM cl")
def sidechannel_clustering(spark, d):
    return sidechannel.clustering(_channel(spark, d))


FLAGS = """fl AS (SELECT sender, receiver, 'parity' AS k, abs(avg((length % 2 = 0)::INT) - 0.5) * 2 AS s FROM ch GROUP BY sender, receiver HAVING count(*) >= 5 AND s > 0.7
 UNION ALL SELECT sender, receiver, 'mod' || modulus, least(1, score) FROM modu WHERE score > 0.5 UNION ALL SELECT sender, receiver, 'clustering', share FROM cl WHERE share > 0.5),
 per AS (SELECT sender, receiver, count(s) AS flagged, coalesce(max(s) FILTER (k = 'parity'), 0) + coalesce(max(s) FILTER (k = 'mod3'), 0) + coalesce(max(s) FILTER (k = 'mod5'), 0)
 + coalesce(max(s) FILTER (k = 'mod8'), 0) + coalesce(max(s) FILTER (k = 'clustering'), 0) AS total FROM tot LEFT JOIN fl USING (sender, receiver) GROUP BY sender, receiver)"""


@query(f"""WITH {CHANNEL}, {MODULAR}, {CLUSTER}, {FLAGS} SELECT sender, receiver, CASE WHEN flagged > 0 THEN total / flagged ELSE 0.0::DOUBLE END AS length_score FROM per""")
def sidechannel_length_score(spark, d):
    return sidechannel.length_score(_channel(spark, d))


CONV = """cv AS (SELECT conv_id, turn AS seq, role AS sender, coalesce(lead(role) OVER w, lag(role) OVER w) AS receiver FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM cv)"""


def _conv(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return src.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("sender"), F.coalesce(F.lead("role").over(w), F.lag("role").over(w)).alias("receiver"))


@query(f"""WITH {CONV}, nx AS (SELECT *, lead(sender) OVER w AS s2, lead(receiver) OVER w AS r2 FROM num WINDOW w AS (PARTITION BY conv_id ORDER BY seq))
 SELECT conv_id, n, count(*) FILTER (i % 2 = 0 AND sender = r2 AND receiver = s2) / (n // 2) AS ratio FROM nx WHERE n >= 4 GROUP BY conv_id, n""")
def sidechannel_request_response(spark, d):
    return sidechannel.request_response(_conv(spark, d))


@query(f"""WITH {CONV}, tr AS (SELECT a.conv_id, p, avg((a.sender = b.sender)::INT) AS r FROM num a JOIN (VALUES (2), (3), (4), (5)) t(p) ON p <= a.n // 2 JOIN num b ON b.conv_id = a.conv_id AND b.i = a.i % p GROUP BY ALL),
 best AS (SELECT conv_id, arg_min(r, p) AS r, min(p) AS period FROM tr WHERE r > 0.8 GROUP BY conv_id)
 SELECT DISTINCT conv_id, coalesce(r, 0) AS score, coalesce(period, 0) AS period FROM num LEFT JOIN best USING (conv_id) WHERE n >= 4""")
def sidechannel_periodic_sender(spark, d):
    return sidechannel.periodic_sender(_conv(spark, d))


@query(f"""WITH {MSG}, h AS (SELECT * FROM msg WHERE sender <> receiver), j AS (SELECT x.seq, y.seq AS nxt, row_number() OVER (PARTITION BY x.seq ORDER BY y.ts, y.seq) AS k
 FROM h x LEFT JOIN h y ON y.gate_id = x.gate_id AND y.sender = x.receiver AND y.ts >= x.ts) SELECT seq, nxt AS next_seq FROM j WHERE k = 1""")
def cascade_next_hop(spark, d):
    return cascade.next_hop(_messages(spark, d).filter("sender != receiver"))


@query(f"WITH {MSG} SELECT gate_id, team, least(1, count(*) FILTER (value > 30) / 10) AS goal_drift FROM msg GROUP BY ALL")
def cascade_goal_drift(spark, d):
    return cascade.goal_drift(_messages(spark, d).withColumn("derived", F.col("value") > 30))


SCORES = "s AS (SELECT event_id AS seq, (event_id % 11) / 10 AS a, (event_id % 7) / 6 AS b, (event_id % 5) / 4 AS c, (event_id % 3) / 2 AS d, (event_id % 13) / 12 AS e FROM events)"
RISK = "1 - (1 - 0.2 * a) * (1 - 0.2 * b) * (1 - 0.2 * c) * (1 - 0.2 * d) * (1 - 0.2 * e)"


def _scores(spark, d):
    k = F.col("event_id")
    return src.read(spark, d, "events").select(k.alias("seq"), *[((k % n) / (n - 1)).alias(x) for n, x in ((11, "a"), (7, "b"), (5, "c"), (3, "d"), (13, "e"))])


@query(f"WITH {SCORES} SELECT seq, {RISK} AS r FROM s")
def composite_risk(spark, d):
    return _scores(spark, d).select("seq", verdict.composite([F.col(x) for x in "abcde"]).alias("r"))


@query(f"WITH {SCORES}, q AS (SELECT seq, (seq % 101) / 100 AS r FROM s) SELECT seq, {BAND} AS verdict FROM q")
def verdict_bands(spark, d):
    return _scores(spark, d).select("seq", verdict.band((F.col("seq") % 101) / 100).alias("verdict"))


@query(f"""WITH {SCORES}, q AS (SELECT seq, (seq % 101) / 100 AS r, seq % 3 AS k FROM s), v AS (SELECT seq, {BAND} AS x, ['ALLOW', 'WARN', 'THROTTLE'][k + 1] AS y FROM q),
 o AS (SELECT ['ALLOW', 'WARN', 'THROTTLE', 'ISOLATE', 'TERMINATE'] AS o) SELECT seq, o[greatest(list_position(o, x), list_position(o, y))] AS verdict FROM v, o""")
def compound_verdict(spark, d):
    floor = F.when(F.col("seq") % 3 == 0, "ALLOW").when(F.col("seq") % 3 == 1, "WARN").otherwise("THROTTLE")
    return _scores(spark, d).select("seq", verdict.worst([verdict.band((F.col("seq") % 101) / 100), floor]).alias("verdict"))


def _capability_sets(spark, d):
    names = [*config.HIGH_RISK, "write-trusted", "net-egress"]
    k = F.col("event_id")
    return src.read(spark, d, "events").select(k.alias("seq"), F.array_compact(F.array(*[F.when(F.floor(k / 2**i) % 2 == 1, n) for i, n in enumerate(names)])).alias("caps"))


@query("""SELECT event_id AS seq, CASE WHEN (event_id & 1) + (event_id >> 1 & 1) + (event_id >> 2 & 1) + (event_id >> 3 & 1) >= 3 THEN 'HIGH_RISK'
 WHEN event_id & 17 = 17 OR event_id & 34 = 34 OR event_id & 12 = 12 THEN 'RESTRICTED' ELSE 'STANDARD' END AS safety_class FROM events""")
def manifest_safety_class(spark, d):
    return _capability_sets(spark, d).select("seq", privilege.safety_class(F.col("caps")).alias("safety_class"))


@query(f"WITH {MSG} SELECT gate_id, team, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS capabilities FROM msg GROUP BY ALL")
def manifest_aggregate_caps(spark, d):
    return _messages(spark, d).groupBy("gate_id", "team").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("capabilities"))


@query(f"""WITH {MSG}, f AS (SELECT gate_id, team, agent, min(seq) AS seq FROM (SELECT gate_id, team, sender AS agent, seq FROM msg UNION ALL SELECT gate_id, team, receiver, seq FROM msg) GROUP BY ALL)
 SELECT gate_id, team, agent, row_number() OVER (PARTITION BY gate_id, team ORDER BY seq, agent) + 1 AS version FROM f""")
def manifest_versions(spark, d):
    from pyspark.sql import Window

    m = _messages(spark, d)
    first = m.select("gate_id", "team", F.explode(F.array("sender", "receiver")).alias("agent"), "seq").groupBy("gate_id", "team", "agent").agg(F.min("seq").alias("seq"))
    return first.select("gate_id", "team", "agent", (F.row_number().over(Window.partitionBy("gate_id", "team").orderBy("seq", "agent")) + 1).alias("version"))


@query(f"""WITH RECURSIVE {CHANNEL}, num AS (SELECT *, row_number() OVER (PARTITION BY sender, receiver ORDER BY seq) AS i FROM ch),
 b(sender, receiver, i, ts, tokens, ok) AS (SELECT sender, receiver, i, ts, 9.0::DOUBLE, 1 FROM num WHERE i = 1 UNION ALL
 SELECT n.sender, n.receiver, n.i, n.ts, t - (t >= 1)::INT, (t >= 1)::INT FROM (SELECT n.*, least(10, b.tokens + greatest(0, n.ts - b.ts) * 0.001) AS t FROM b JOIN num n ON n.sender = b.sender AND n.receiver = b.receiver AND n.i = b.i + 1) n)
 SELECT sender, receiver, CAST(sum(ok) AS BIGINT) AS passed, count(*) - CAST(sum(ok) AS BIGINT) AS refused FROM b GROUP BY sender, receiver""")
def throttle_token_bucket(spark, d):
    got = verdict.token_bucket(_channel(spark, d), refill=0.001)
    return got.select("sender", "receiver", F.col("passed").cast("long").alias("passed"), F.col("refused").cast("long").alias("refused"))


def _entries(spark, d):
    """One trail entry per message of each gate."""
    return _messages(spark, d).select("gate_id", "seq", F.concat_ws(":", "event_type", "sender", "receiver").alias("body"))


CHAIN = f"""{MSG}, ent AS MATERIALIZED (SELECT gate_id, seq, event_type || ':' || sender || ':' || receiver AS body, row_number() OVER (PARTITION BY gate_id ORDER BY seq) AS i FROM msg),
 chain(gate_id, i, seq, body, prev_hash, entry_hash) AS (SELECT gate_id, i, seq, body, sha256('skein-genesis'), sha256(sha256('skein-genesis') || '|' || body) FROM ent WHERE i = 1
 UNION ALL SELECT e.gate_id, e.i, e.seq, e.body, c.entry_hash, sha256(c.entry_hash || '|' || e.body) FROM chain c JOIN ent e ON e.gate_id = c.gate_id AND e.i = c.i + 1)"""


@query(f"WITH RECURSIVE {CHAIN} SELECT gate_id, seq, body, prev_hash, entry_hash FROM chain")
def trail_build_chain(spark, d):
    return trail.build(_entries(spark, d))


def _tampered(spark, d):
    """The chain with its entries of seq 100 to 200 edited in gates g1 and g2."""
    edit = F.col("gate_id").isin("g1", "g2") & F.col("seq").between(100, 200)
    return trail.build(_entries(spark, d)).withColumn("body", F.when(edit, F.concat("body", F.lit("!"))).otherwise(F.col("body")))


@query(f"""WITH RECURSIVE {CHAIN}, bad AS (SELECT gate_id, min(CASE WHEN gate_id IN ('g1', 'g2') AND seq BETWEEN 100 AND 200 THEN i - 1 END) AS k FROM chain GROUP BY gate_id)
 SELECT gate_id, k IS NULL AS valid, coalesce(k, -1) AS first_bad FROM bad""")
def trail_validate_chain(spark, d):
    return trail.validate(_tampered(spark, d))


@query(f"""WITH RECURSIVE {CHAIN}, cut AS (SELECT gate_id, min(CASE WHEN gate_id = 'g1' AND seq >= 300 THEN i END) AS k FROM chain GROUP BY gate_id)
 SELECT gate_id, count(*) FILTER (k IS NULL OR i < k) AS n FROM chain JOIN cut USING (gate_id) GROUP BY gate_id""")
def trail_import_prefix(spark, d):
    broken = (F.col("gate_id") == "g1") & (F.col("seq") >= 300)
    chain = trail.build(_entries(spark, d)).withColumn("prev_hash", F.when(broken, F.lit("0")).otherwise(F.col("prev_hash")))
    return trail.imported(chain).groupBy("gate_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MSG} SELECT seq, gate_id, ts FROM msg WHERE event_type = 'click' AND ts >= 1704100000 AND ts < 1706000000 ORDER BY seq LIMIT 50")
def trail_query(spark, d):
    """The first 50 entries of a filter: the limit is the operator's."""
    return trail.query(_messages(spark, d), "click", 1704100000, 1706000000, 50).select("seq", "gate_id", "ts")


@query(f"WITH {MSG} SELECT gate_id, count(*) AS n FROM msg WHERE ts >= (SELECT max(ts) FROM msg) - 10 * 86400 GROUP BY gate_id")
def trail_prune(spark, d):
    m = _messages(spark, d)
    now = m.agg(F.max("ts").alias("now"))  # one row, joined in the plan
    return trail.pruned(m.join(F.broadcast(now)), F.col("now"), 10).groupBy("gate_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {CHAIN} SELECT gate_id, count(*) AS n, arg_max(entry_hash, seq) AS last_hash FROM chain GROUP BY gate_id")
def trail_last_hash(spark, d):
    return trail.build(_entries(spark, d)).groupBy("gate_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("entry_hash", "seq").alias("last_hash"))


@query(f"""WITH {MSG}, r AS (SELECT sender, receiver, seq, CASE WHEN value > 20 THEN 'ISOLATE' WHEN value > 10 THEN 'THROTTLE' ELSE 'RELEASE' END AS verdict, row_number() OVER (PARTITION BY sender, receiver ORDER BY seq DESC) AS k FROM msg)
 SELECT sender, receiver, seq, verdict FROM r WHERE k = 1 AND verdict <> 'RELEASE'""")
def intervention_latest_active(spark, d):
    kind = F.when(F.col("value") > 20, "ISOLATE").when(F.col("value") > 10, "THROTTLE").otherwise("RELEASE")
    last = _messages(spark, d).groupBy("sender", "receiver").agg(F.max_by(F.struct("seq", kind.alias("verdict")), "seq").alias("x"))
    return last.select("sender", "receiver", "x.seq", "x.verdict").filter("verdict != 'RELEASE'")
