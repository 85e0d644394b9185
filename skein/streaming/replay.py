"""The gate over a table or a stream of rows (gate_id, seq, kind, sender, receiver, ts, payload, detail).

A gate's hash chain, similarity history and merging teams make it sequential, so work is dealt out by gate_id alone. A batch sorts each
partition and folds it batch by batch: a task holds one gate's state, never its rows. A stream keeps the state in the state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from skein import config
from skein.streaming.gate import FIELDS, SCHEMA, Gate

INPUT = {"gate_id": "string", "seq": "bigint", "kind": "string", "sender": "string", "receiver": "string", "ts": "double", "payload": "string", "detail": "string"}


def rows(df: DataFrame) -> DataFrame:
    """The columns of a replay; what is missing is null, a row without a kind is a message, and a null seq is -1."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in INPUT.items()]
    return df.select(*cols).withColumns({"kind": F.coalesce("kind", F.lit("message")), "seq": F.coalesce("seq", F.lit(-1))})


def _feed(gate: Gate, chunk: pd.DataFrame) -> list[tuple]:
    return [out for x in chunk.itertuples(index=False) for out in gate.row(x.seq, x.kind, x.sender, x.receiver, x.ts, x.payload, x.detail)]


def _table(found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=list(FIELDS))
    return out.astype({"entry": "Int64", "manifest_version": "Int32", "seq": "Int64"}) if found else out


def _in_order(df: DataFrame) -> DataFrame:
    """The rows of a gate in one partition, one after another. By ranges, more than there are tasks at once: few gates that are hashed to partitions often meet in one."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small rows aren't put into one task again: a message costs far more than its bytes
    return rows(df).repartitionByRange(n, "gate_id").sortWithinPartitions("gate_id", "seq", "kind", "sender", "receiver", "payload")


def _folded(df: DataFrame, settings: config.Settings | None, **how: bool) -> DataFrame:
    names, types = zip(*(c.split() for c in SCHEMA.split(", ")))
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, at = None, object()
        for batch in batches:
            found = []
            for gid, *row in zip(*(batch.column(c).to_pylist() for c in INPUT)):
                if gate is None or gid != at:
                    gate, at = Gate(gid, settings, **how), gid
                found += gate.row(*row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t], from_pandas=True) for c, t in zip(zip(*found), types)], list(names))

    return _in_order(df).mapInArrow(fold, SCHEMA)


def replay(df: DataFrame, settings: config.Settings | None = None) -> DataFrame:
    """Verdicts and trail entries. Ties of seq go by kind, sender, receiver, payload; a null gate_id is a gate of its own."""
    return _folded(df, settings)


def judged(df: DataFrame, settings: config.Settings | None = None) -> DataFrame:
    """The ``verdicts`` of a replay whose trail nobody asks for: the same fold, without bodies and hashes."""
    return verdicts(_folded(df, settings, chained=False))


def teams(df: DataFrame, settings: config.Settings | None = None) -> DataFrame:
    """What the trail says of teams: those that formed and ended, who joined and left. The same detector and manifests, without the signals."""
    found = _folded(df, settings, judges=False, chained=False).filter("entry IS NOT NULL AND event_type != 'GATE_VERDICT'")
    return found.select("gate_id", "seq", "event_type", "team_id", "ts", "manifest_version")


class _Keeper(StatefulProcessor):
    def __init__(self, settings):
        self.settings = settings

    def init(self, handle) -> None:
        self.kept = handle.getValueState("gate", "gate binary")

    def handleInputRows(self, key, chunks, timers) -> Iterator[pd.DataFrame]:
        gate = pickle.loads(self.kept.get()[0]) if self.kept.exists() else Gate(key[0], self.settings)
        part = pd.concat(list(chunks)).sort_values(["seq", "kind", "sender", "receiver", "payload"], kind="stable", na_position="first")
        found = _feed(gate, part)
        self.kept.update((pickle.dumps(gate),))
        yield _table(found)

    def close(self) -> None:
        pass


def stream(df: DataFrame, settings: config.Settings | None = None) -> DataFrame:
    """The same over a stream. Rows of one micro-batch are put in order of seq; a row that comes in a later one counts as arrived later. Needs the
    RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    return rows(df).groupBy("gate_id").transformWithStateInPandas(_Keeper(settings), outputStructType=SCHEMA, outputMode="Append", timeMode="None")


def verdicts(found: DataFrame) -> DataFrame:
    """One row per message: what the gate said of it. Entries of deliveries carry no scores and are not verdicts."""
    said = (F.col("event_type") == "VERDICT") | ((F.col("event_type") == "GATE_VERDICT") & F.col("safety_class").isNotNull())
    return found.filter(said).select("gate_id", "seq", "ts", "team_id", "manifest_version", "verdict", "r_team", "safety_class", *config.FAMILIES, "reasons")


def trail(found: DataFrame) -> DataFrame:
    """The hash-chained entries, in the columns of ``operators.trail`` (seq is the entry's number in its chain)."""
    return found.filter("entry IS NOT NULL").select("gate_id", F.col("entry").alias("seq"), "event_type", "team_id", "ts", "manifest_version", "r_team", "verdict", "body", "prev_hash", "entry_hash")
