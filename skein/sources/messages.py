"""Messages, envelopes and capability facts from the driver's tables. Every rule is local to a row, so scans stay parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GATES, AGENTS, TEAM = 4, 150, 6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(events: DataFrame) -> DataFrame:
    """seq, gate_id, sender, receiver, ts (epoch seconds), payload, event_type, team: agents talk inside teams of TEAM."""
    agent = F.col("user_id") % AGENTS
    base = agent - agent % TEAM
    to = F.when(F.col("event_id") % 97 == 0, agent).otherwise(base + (agent % TEAM + 1 + F.col("event_id") % (TEAM - 1)) % TEAM)
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("g"), (F.col("event_id") % GATES).cast("string")).alias("gate_id"),
        F.concat(F.lit("t"), base.cast("string")).alias("team"),
        F.concat(F.lit("a"), agent.cast("string")).alias("sender"),
        F.concat(F.lit("a"), to.cast("string")).alias("receiver"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("payload"),
        "event_type",
        "value",
    )


def normalized(df: DataFrame) -> DataFrame:
    """The generic envelope: missing ids are ``unknown``, a missing payload is empty."""
    pick = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return df.select("seq", pick("sender"), pick("receiver"), F.coalesce("payload", F.lit("")).alias("payload"), "ts")


def _at(v: Column, path: str) -> Column:
    """A scalar of a JSON text, missing where empty."""
    return F.nullif(F.get_json_object(v, path), F.lit(""))


#: The protocol header of every envelope.
PROTOCOL = "a2a-0.3.0"


def _headers(*pairs: tuple[Column, Column]) -> Column:
    """A map of the pairs whose value isn't null; of equal names the last stays."""
    return last_of(F.filter(F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in pairs]), lambda p: p["value"].isNotNull()))


def last_of(pairs: Column) -> Column:
    """A map of (key, value) pairs; of equal keys the last one's value."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def jsonrpc(raw: Column, sender: str = "unknown", receiver: str = "unknown") -> list[Column]:
    """sender, receiver, payload, method, parse error and headers of a JSON-RPC envelope. The payload is the text parts and bare strings among the
    parts; without any, the message as JSON ({} if there is none), or itself where it isn't an object."""
    bad = F.try_parse_json(raw).isNull()
    get = lambda p: F.get_json_object(raw, p)
    ids = lambda side, short, other: F.coalesce(
        _at(raw, f"$.params.metadata.{side}_agent_id"),
        F.nullif(F.coalesce(get(f"$.params.{side}_id"), get(f"$.params.{short}")), F.lit("")),
        _at(raw, f"$.params.message.metadata.{side}_agent_id"),
        F.lit(other),
    )
    parts = F.try_variant_get(F.try_parse_json(get("$.params.message.parts")), "$", "array<variant>")
    as_object = lambda p: F.try_variant_get(p, "$", "map<string,variant>")
    of_text = lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    text = lambda p: F.when(as_object(p).isNotNull(), of_text(p)).when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))
    texts = F.filter(F.transform(parts, text), lambda t: t.isNotNull())
    payload = F.coalesce(F.when(F.size(texts) > 0, F.array_join(texts, " ")), get("$.params.message"), F.lit("{}"))
    lit = F.lit
    headers = _headers(
        (lit("x-a2a-method"), F.nullif(get("$.method"), lit(""))), (lit("x-a2a-rpc-id"), F.nullif(F.nullif(get("$.id"), lit("")), lit("0"))), (lit("x-a2a-task-id"), F.nullif(F.nullif(get("$.params.id"), lit("")), lit("0"))),
        (lit("x-a2a-protocol"), lit(PROTOCOL)), (lit("x-a2a-transport"), lit("json-rpc")),
    )
    return [
        F.when(bad, F.lit(sender)).otherwise(ids("sender", "from", sender)).alias("sender"),
        F.when(bad, F.lit(receiver)).otherwise(ids("receiver", "to", receiver)).alias("receiver"),
        F.when(bad, raw).otherwise(payload).alias("payload"),
        F.when(~bad, get("$.method")).alias("method"),
        bad.alias("parse_error"),
        F.when(bad, F.create_map(lit("x-skein-parse-error"), lit("true"))).otherwise(headers).alias("headers"),
    ]


def grpc(payload: Column, metadata: Column) -> list[Column]:
    """sender, receiver, payload text (or its size where it isn't UTF-8) and the transport's headers: the protocol's own, then what the metadata
    names. ``metadata`` is an array of (key, value) pairs (``F.map_entries`` of a map); names count in lower case, and the last of equal ones."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    low = F.transform(F.coalesce(metadata, none), lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value")))
    known = last_of(low)
    own = F.filter(low, lambda p: p["key"].startswith("x-a2a-"))
    base = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("x-a2a-protocol", PROTOCOL), ("x-a2a-transport", "grpc"))])
    pick = lambda k: F.coalesce(known[k], F.lit("unknown"))
    text = F.when(F.is_valid_utf8(payload.cast("string")), payload.cast("string")).otherwise(F.concat(F.lit("<binary:"), F.octet_length(payload).cast("string"), F.lit("bytes>")))
    return [pick("x-a2a-sender-agent-id").alias("sender"), pick("x-a2a-receiver-agent-id").alias("receiver"), text.alias("payload"), last_of(F.concat(base, own)).alias("headers")]


def listed(headers: Column) -> Column:
    """A map as text, in order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda p: F.concat_ws("=", p["key"], p["value"])), ";")


def carries_messages(tool: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a tool's name is one of those that carry messages, or of ``more``, in any case."""
    return F.lower(tool).isin(*TOOLS, *[x.lower() for x in more])


#: The tool names that carry messages between agents.
TOOLS = ("a2a_send", "a2a_delegate", "a2a_query", "a2a_respond", "agent_send", "agent_delegate", "send_to_agent", "delegate_task")


def wrap_response(rpc_id: Column, result: Column, verdict: Column) -> Column:
    """A JSON-RPC response with the verdict among its metadata."""
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), rpc_id.alias("id"), F.struct(result.alias("value"), F.struct(verdict.alias("verdict")).alias("metadata")).alias("result")))


def wrap_tool_result(result: Column, verdict: Column, warnings: Column) -> Column:
    """A tool's result with the verdict beside it; no warnings, no field."""
    about = F.struct(verdict.alias("verdict"), F.when(F.size(warnings) > 0, warnings).alias("warnings"))
    return F.to_json(F.struct(result.alias("value"), about.alias("_skein")))


def mcp(raw: Column, sender: str = "unknown", receiver: str = "unknown", caller: Column | None = None) -> list[Column]:
    """sender, receiver, payload, tool, session and task of a tool call. A call's own context hides the caller's."""
    context = F.coalesce(F.get_json_object(raw, "$.context"), caller if caller is not None else F.lit(None).cast("string"), F.lit("{}"))
    arguments = F.coalesce(F.get_json_object(raw, "$.arguments"), F.lit("{}"))
    first = lambda of, names: [_at(of, f"$.{n}") for n in names]
    return [
        F.coalesce(*first(context, ("caller_agent_id", "agent_id", "sender_id")), *first(arguments, ("sender_id",)), F.lit(sender)).alias("sender"),
        F.coalesce(*first(arguments, ("target_agent", "target_agent_id", "receiver_id", "to", "agent_id")), F.lit(receiver)).alias("receiver"),
        F.coalesce(*first(arguments, ("message", "content", "payload", "text")), arguments).alias("payload"),
        F.coalesce(F.get_json_object(raw, "$.tool"), F.lit("")).alias("tool"),
        _at(context, "$.session_id").alias("session_id"),
        _at(arguments, "$.task_id").alias("task_id"),
    ]


def grpc_metadata(sender: Column, receiver: Column, task_id: Column, extra: Column) -> Column:
    """The header pairs of a message, in order: ids, the task where there is one, then others."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    task = F.when(F.coalesce(task_id, F.lit("")) != "", F.array(pair(F.lit("x-a2a-task-id"), task_id)))
    none = F.array().cast("array<struct<key:string,value:string>>")
    ids = F.array(pair(F.lit("x-a2a-sender-agent-id"), sender), pair(F.lit("x-a2a-receiver-agent-id"), receiver))
    return F.concat(ids, F.coalesce(task, none), F.coalesce(F.map_entries(extra), none))


def member_capabilities(events: DataFrame, least: int = 1) -> DataFrame:
    """agent, capability, n: event types stand for capabilities."""
    m = messages(events)
    return m.groupBy(F.col("sender").alias("agent"), F.col("event_type").alias("capability")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
