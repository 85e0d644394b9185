"""Benchmark decontamination: a broadcast set of normalised test n-grams against every document's token windows.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``n`` consecutive words of
an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window; items with the same
id and different texts each add their windows to that id; a null item id is left out of the item list but its windows still
count as hits; repeated document rows each get their own row; an empty table on either side gives no hits; further columns of
``docs`` pass through ``remove_contaminated`` untouched and are ignored by ``contamination``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 10
MAX_BROADCAST_WORDS = 1_000_000  # words of all items: at most some 100 MB in a worker. Windows of more meet the documents' in a shuffle
GRAM_ROWS = 100_000  # windows of texts in one batch of that shuffle
_JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of the items by length, as word ids: rolling hashes find, the ids themselves verify."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.words: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words(text)]
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                owners = windows.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set())
                if item is not None:
                    owners.add(item)
        self.by_length = []
        for k, found in sorted(windows.items()):
            keys = np.array(list(found), np.int64).reshape(len(found), k)
            h = self._hash(keys.reshape(-1), k)[::k] if k > 1 else keys[:, 0].astype(np.uint64)
            order = np.argsort(h, kind="stable")
            self.by_length.append((k, h[order], keys[order], [sorted(found[tuple(x)]) for x in keys[order].tolist()]))

    @staticmethod
    def _hash(ids: np.ndarray, k: int) -> np.ndarray:
        """Of the k ids from each position on."""
        if k == 1 or len(ids) < k:
            return ids[: len(ids) if k == 1 else 0].astype(np.uint64)
        h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - k + 1 + j].astype(np.uint64)
        return h

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the ids of the items whose windows occur."""
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        for k, known, keys, owners in self.by_length:
            h = self._hash(ids, k)
            if not len(h):
                continue
            at = np.searchsorted(known, h)
            near = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
            for p in near.tolist():
                j = int(at[p])
                while j < len(known) and known[j] == h[p]:
                    if (keys[j] == ids[p : p + k]).all():
                        hit[p] += 1
                        hit[p + k] -= 1
                        items.update(owners[j])
                    j += 1
        return np.cumsum(hit[:-1]) > 0, sorted(items)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(common.WORD_TABLE).split()


def _scan(windows: WindowSet, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in common.chunks(batches):
        found = []
        for text in common.encoded(part.column("text")):
            w = text.translate(common.WORD_TABLE).split()
            ids = np.fromiter((windows.words.get(x, 0) for x in w), np.int64, len(w))
            # only stretches of known words can hold a window
            hit, items = windows.hits(ids) if ids.any() else (np.zeros(len(w), bool), [])
            found.append((len(w), hit, items))
        yield part, found


def _items(benchmark: DataFrame) -> list[tuple[str | None, str | None]] | None:
    """The items, or None where they hold more than MAX_BROADCAST_WORDS words. Words are counted on the executors, so no more than that comes here."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = benchmark.agg(F.sum(F.regexp_count(text, F.lit(_JAVA_WORD))).alias("n")).first()["n"]
    if (n or 0) > MAX_BROADCAST_WORDS:
        return None
    return [(None if r[0] is None else str(r[0]), r[1]) for r in benchmark.select("item_id", "text").toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted), spans of hit words.

    The items go to the executors as one broadcast while they hold at most MAX_BROADCAST_WORDS words; the windows of more meet the documents'
    in a shuffle (``_joined``), with the same rows.
    """
    schema = "doc_id long, n_words long, items array<string>, spans array<struct<start:long,stop:long>>"
    items = _items(benchmark)
    if items is None:
        return _joined(docs, benchmark, n)
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def run(batches):
        for part, found in _scan(shared.value, batches):
            spans = []
            for _, hit, _ in found:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                spans.append([{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ],
                ["doc_id", "n_words", "items", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(run), schema)


def _grams(df: DataFrame, keep: list[str], sizes: list[int] | None, n: int) -> DataFrame:
    """keep, at, size, gram: the windows of each text; of sizes 1 to n for documents (``sizes``), of the item's own size for items (None)."""

    def run(batches):
        for part in common.chunks(batches):
            at, size, gram, row = [], [], [], []

            def out(part=part, at=at, size=size, gram=gram, row=row):
                take = pa.array(row, pa.int64())
                made = pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in keep], pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(gram, pa.binary())], [*keep, "at", "size", "gram"])
                for x in (at, size, gram, row):
                    x.clear()
                return made

            for i, t in enumerate(common.encoded(part.column("text"))):
                w = t.translate(common.WORD_TABLE).split()
                for k in sizes or ([min(n, len(w))] if w else []):
                    for p in range(len(w) - k + 1):
                        row.append(i)
                        at.append(p)
                        size.append(k)
                        gram.append(b" ".join(w[p : p + k]))
                        if len(row) >= GRAM_ROWS:
                            yield out()
            yield out()

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*keep, "text").mapInArrow(common.tidy(run), ", ".join([*[f"{c} {kinds[c]}" for c in keep], "at long, size long, gram binary"]))


def _found(rows: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """rid, at, size, items: the windows of ``rows`` (rid, text) that are some item's. A window's items are one row before the join, and a window that
    many documents hold meets one such row, so the join is a plain shuffle whose hot windows AQE can split."""
    items = _grams(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), ["item"], None, n)
    known = common.cut(items.groupBy("gram", "size").agg(F.array_sort(F.collect_set("item")).alias("items")))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # n numbers at most
    return _grams(rows, ["rid"], sizes or [n], n).join(known.hint("merge"), ["gram", "size"]).select("rid", "at", "size", "items")


def _joined(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """``contamination`` for a benchmark of any size."""
    rows = common.with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    hits = _found(rows.select("rid", "text"), benchmark, n).groupBy("rid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop")))).alias("spans"),
    ).withColumn("spans", _merged())

    def count(batches):
        for part in common.chunks(batches):
            n_words = [len(t.translate(common.WORD_TABLE).split()) for t in common.encoded(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(n_words, pa.int64())], ["rid", "doc_id", "n_words"])

    counted = rows.mapInArrow(common.tidy(count), "rid long, doc_id long, n_words long")
    none = lambda c: F.coalesce(F.col(c), F.expr(f"cast(array() as {hits.schema[c].dataType.simpleString()})")).alias(c)
    return counted.join(hits, "rid", "left").select("doc_id", "n_words", none("items"), none("spans"))


def _merged():
    """Sorted spans with overlapping and touching ones joined."""
    return F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).stop >= x.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop)))), "
        "concat(a, array(x))))"
    )


def digest(found: DataFrame) -> DataFrame:
    """The report columns of ``contamination``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of ``benchmark``, with their columns as they are."""
    items = _items(benchmark)
    if items is None:
        clashing = {"rid": "__rid"} if "rid" in docs.columns else {}
        rows = common.with_row_id(docs.withColumnsRenamed(clashing))
        hit = _found(rows.select("rid", "text"), benchmark, n).select("rid").distinct()
        return rows.join(hit, "rid", "left_anti").drop("rid").withColumnsRenamed({v: k for k, v in clashing.items()})
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def run(batches):
        for part, found in _scan(shared.value, batches):
            yield part.filter(pa.array([not hit.any() for _, hit, _ in found], pa.bool_()))

    return docs.mapInArrow(common.tidy(run), docs.schema)


def brute(docs: list[tuple], items: list[tuple], n: int = N) -> list[tuple]:
    """The report by plain comparison of every window, for tests."""
    out = []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for item, t in items:
            x = words(t)
            k = min(n, len(x))
            for i in range(len(x) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[i : i + k]:
                        hit.update(range(p, p + k))
                        owners |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return out
