"""The hash-chained audit trail: one chain per gate, entries in order of seq."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "skein-genesis"


def genesis() -> Column:
    return F.sha2(F.lit(GENESIS), 256)


def entry_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, body), 256)


def build(entries: DataFrame) -> DataFrame:
    """gate_id, seq, body, prev_hash, entry_hash. A chain is sequential by nature: one pass over each gate's sorted entries, which holds the last
    hash only (a fold that appends to an array copies the chain for every entry)."""
    first = hashlib.sha256(GENESIS.encode()).hexdigest()

    def run(batches):
        gate, last, begun = None, first, False
        for part in batches:
            gates, before, after = part.column("gate_id").to_pylist(), [], []
            for g, body in zip(gates, part.column("body").to_pylist(), strict=True):
                if not begun or g != gate:
                    gate, last, begun = g, first, True
                before.append(last)
                last = hashlib.sha256((last if body is None else f"{last}|{body}").encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*part.schema.names, "prev_hash", "entry_hash"])

    rows = entries.select(F.col("gate_id").cast("string").alias("gate_id"), F.col("seq").cast("long").alias("seq"), F.col("body").cast("string").alias("body"))
    in_order = rows.repartition("gate_id").sortWithinPartitions("gate_id", "seq", "body")
    return in_order.mapInArrow(run, "gate_id string, seq long, body string, prev_hash string, entry_hash string")


def validate(chain: DataFrame) -> DataFrame:
    """Per gate: whether the chain holds, and the index of the first broken entry (-1 for none). An entry's own hash is checked where it lies; only
    the links are checked in order, without the bodies."""
    w = Window.partitionBy("gate_id").orderBy("seq")
    own = F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("body"))
    known = chain.select("gate_id", "seq", "prev_hash", "entry_hash", own.alias("own"))
    rows = known.select("*", (F.row_number().over(w) - 1).alias("i"), F.coalesce(F.lag("entry_hash").over(w), genesis()).alias("want"))
    bad = (F.col("prev_hash") != F.col("want")) | F.col("own")
    first = F.coalesce(F.min(F.when(bad, F.col("i"))), F.lit(-1))
    return rows.groupBy("gate_id").agg((first < 0).alias("valid"), first.alias("first_bad"))


def imported(chain: DataFrame) -> DataFrame:
    """The entries up to the first whose prev_hash doesn't link; hashes aren't recomputed."""
    w = Window.partitionBy("gate_id").orderBy("seq")
    rows = chain.withColumn("broken", (F.col("prev_hash") != F.coalesce(F.lag("entry_hash").over(w), genesis())).cast("int"))
    return rows.withColumn("b", F.max("broken").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("b = 0").drop("broken", "b")


def query(trail: DataFrame, kind: str | None = None, since: float = 0, until: float = 0, limit: int = 0) -> DataFrame:
    """Conjunctive filters (a false argument filters nothing), in order, the first ``limit``."""
    for given, c in ((kind, F.col("event_type") == kind), (since, F.col("ts") >= since), (until, F.col("ts") < until)):
        trail = trail.filter(c) if given else trail
    return trail.orderBy("seq").limit(limit) if limit else trail


def pruned(trail: DataFrame, now: Column, days: float) -> DataFrame:
    return trail.filter(F.col("ts") >= now - days * 86400)
