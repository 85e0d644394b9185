"""Suffix-array dedup: bytes covered by a string of ``width`` bytes that also starts anywhere else go.

Sorting every suffix would exchange a few hundred bytes for each byte of text, so the array is sparse. Every window of
``width`` bytes chooses one anchor by its own content alone (the rightmost least hash of its ``gram``-byte grams), so equal windows
choose anchors at equal places, and a window can only repeat where its anchor's gram repeats. Grams are counted first; the
suffixes at repeated anchors, each with the bytes before it that its windows need, are sorted in each task into a run, and the runs
are exchanged front-coded: the length of the common prefix with the one before, and the rest. A loser tree merges the runs of a
bucket with the known common prefixes: an entry is compared from the prefix it shares with the last winner on, never before it.
Neighbours with a common gram form a group. How far a window's right part agrees with another's is the least of the common prefixes
between them, which the merge has found already; its left parts are compared among those that agree on the right.

Positions are bytes of UTF-8; matches never cross documents; strings are judged on the input, not on what is left. Defined cases:
a null text is empty; texts shorter than ``width`` hold no repeat; repeated rows are documents of their own, so all of a long
repeated row goes; an empty table gives an empty result; further columns pass through ``deduplicated`` untouched, but for n_chars,
which follows the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 200
GRAM = 64
CHUNK = 1 << 19
RUN = 50_000  # entries that a task sorts into one run
BUCKET_BYTES = 64 << 20  # input for each bucket of grams


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(v)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    shaped = padded.reshape(blocks, w)
    head = np.minimum.accumulate(shaped, 1).reshape(-1)
    tail = np.minimum.accumulate(shaped[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(raw: np.ndarray, firsts: np.ndarray, lens: np.ndarray, width: int, gram: int):
    """Of the texts raw[first : first + len]: for each anchor its text, gram hash, place, and the first and last start that chooses it."""
    starts = np.maximum(lens - width + 1, 0)
    total = int(starts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 5
    p, inverse = common.powers(len(raw) + 1)
    sums = common.rolling(raw, p)
    with np.errstate(over="ignore"):
        h = sums[gram:] - sums[:-gram]
        h *= inverse[: len(h)]
        h = common.mix(h)
    del sums
    low = np.uint64(0xFFFFFFFF)
    best = h & ~low
    best |= low - np.arange(len(h), dtype=np.uint64)
    best = sliding_least(best, width - gram + 1)
    chosen_at = (low - (best & low)).astype(np.uint32)
    del best
    text = np.repeat(np.arange(len(lens)), starts)
    at = np.arange(total) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(firsts, starts)
    chosen = chosen_at[at].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(new[1:], total) - 1
    own = text[new]
    where = chosen[new]
    return own, h[where], where - firsts[own], at[new] - firsts[own], at[last] - firsts[own]


def _pieces(ids: list, texts: list[bytes], width: int) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Texts in groups of about CHUNK bytes; a longer text in overlapping parts, whose starts don't overlap."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for rid, text in zip(ids, texts, strict=True):
        for begin in range(0, max(len(text), 1), CHUNK):
            part = text[begin : begin + CHUNK + width - 1]
            if size and size + len(part) > CHUNK:
                yield held
                held, size = ([], [], []), 0
            for to, x in zip(held, (rid, begin, part), strict=True):
                to.append(x)
            size += len(part)
    if held[0]:
        yield held


def _anchor_rows(buckets: int, width: int, gram: int):
    def run(batches):
        for part in common.chunks(batches, size=CHUNK):
            for ids, begins, texts in _pieces(part.column("rid").to_pylist(), common.encoded(part.column("text")), width):
                lens = np.array([len(t) for t in texts], np.int64)
                raw = np.frombuffer(b"".join(texts), np.uint8)
                if len(raw) < width:
                    continue
                own, h, p, lo, hi = anchors(raw, np.cumsum(lens) - lens, lens, width, gram)
                if not len(own):
                    continue
                bucket = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                rid, begin = np.array(ids, np.int64)[own][order], np.array(begins, np.int64)[own][order]
                key = (h[order] >> np.uint64(32)).astype(np.uint32)
                p, lo, hi = p[order] + begin, (p - lo)[order].astype(np.uint16), (p - hi)[order].astype(np.uint16)
                edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
                blobs = [common.packed(key[a:b], rid[a:b], p[a:b].astype(np.uint32), lo[a:b], hi[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _repeated(table):
    """The anchors of a bucket whose gram occurs twice or more, by document."""
    parts = [common.unpacked(x, 5) for x in table.column("blob").to_pylist()]
    kinds = (np.uint32, np.int64, np.uint32, np.uint16, np.uint16)
    key, rid, p, lo, hi = (np.concatenate([np.frombuffer(x[i], k) for x in parts]) for i, k in enumerate(kinds))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(times[inverse.reshape(-1)] > 1)
    keep = keep[np.lexsort((p[keep], rid[keep]))]
    rid, entry = rid[keep], np.empty(len(keep), [("p", "<u4"), ("lo", "<u2"), ("hi", "<u2")])
    entry["p"], entry["lo"], entry["hi"] = p[keep], lo[keep], hi[keep]
    edge = np.append(np.flatnonzero(np.diff(rid, prepend=-1)), len(rid)).tolist()
    return pa.table(
        {"rid": pa.array(rid[edge[:-1]], pa.int64()), "marks": pa.array([entry[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())}
    )


ENTRY = np.dtype([("p", "<u4"), ("lo", "<u2"), ("hi", "<u2")])


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of sorted strings: common prefixes with the one before, the rests, and the rests' lengths."""
    lens = np.array([len(s) for s in strings], np.int64)
    longest = max(1, int(lens.max()))
    raw = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in strings), np.uint8).reshape(len(strings), longest)
    common_to = np.zeros(len(strings), np.int64)
    for i in range(1, len(strings), 8192):
        j = min(i + 8192, len(strings))
        differs = raw[i:j] != raw[i - 1 : j - 1]
        at = np.where(differs.any(1), differs.argmax(1), longest)
        common_to[i:j] = np.minimum(at, np.minimum(lens[i:j], lens[i - 1 : j - 1]))
    return common_to, b"".join([s[c:] for s, c in zip(strings, common_to.tolist(), strict=True)]), lens - common_to


def _run_rows(buckets: int, width: int, gram: int):
    """Sorted, front-coded runs of suffixes for each bucket of grams. An entry is its suffix followed by the reversed bytes before it."""

    def run(batches):
        held, n = {}, 0

        def out():
            rows = []
            for bucket, entries in sorted(held.items()):
                entries.sort()
                prefix, rest, sizes = front_coded([e[0] for e in entries])
                meta = [np.array([e[i] for e in entries], k) for i, k in ((1, np.int64), (2, np.uint32), (3, np.uint16), (4, np.uint16))]
                rows.append((bucket, common.packed(prefix.astype(np.uint16), sizes.astype(np.uint16), *meta, rest)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for part in common.chunks(batches, size=CHUNK):
            for rid, text, marks in zip(part.column("rid").to_pylist(), common.encoded(part.column("text")), part.column("marks").to_pylist(), strict=True):
                for p, lo, hi in np.frombuffer(b"".join(marks), ENTRY).tolist():
                    head = text[p : p + gram]
                    entry = text[p : p - hi + width] + text[p - lo : p][::-1]
                    held.setdefault(zlib.crc32(head) % buckets, []).append((entry, rid, p, lo, hi))
                    n += 1
                    if n >= RUN:
                        yield out()
                        n = 0
        if held:
            yield out()

    return run


def decoded(blob: bytes) -> Iterator[tuple]:
    """(common prefix with the one before, entry, rid, p, lo, hi) of a run."""
    prefix, sizes, rid, p, lo, hi, rest = common.unpacked(blob, 7)
    rest, at, last = bytes(rest), 0, b""
    columns = (np.frombuffer(x, k).tolist() for x, k in ((prefix, np.uint16), (sizes, np.uint16), (rid, np.int64), (p, np.uint32), (lo, np.uint16), (hi, np.uint16)))
    for c, size, *meta in zip(*columns, strict=True):
        last = last[:c] + rest[at : at + size]
        at += size
        yield (c, last, *meta)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes needn't be looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "little") ^ int.from_bytes(b[known:n], "little")
    return known + ((x & -x).bit_length() - 1 >> 3)


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The runs' entries in order, each with its common prefix with the one before.

    A loser tree: every head knows its common prefix with the last winner. The head that shares more is the lesser; only equal
    ones are compared, from that prefix on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size

    def beats(i, j):
        """Whether head i goes before head j; the loser learns its common prefix with the winner."""
        if heads[i] is None or heads[j] is None:
            return heads[j] is None
        if known[i] != known[j]:
            return known[i] > known[j]
        a, b = heads[i][1], heads[j][1]
        m = shared_prefix(a, b, known[i])
        first = (i < j if m == len(a) == len(b) else m == len(a) or (m < len(b) and a[m] < b[m]))
        known[j if first else i] = m
        return first

    losers = [0] * size

    def play(node):
        if node >= size:
            return node - size
        i, j = play(2 * node), play(2 * node + 1)
        if beats(i, j):
            losers[node] = j
            return i
        losers[node] = i
        return j

    winner = play(1)
    while heads[winner] is not None:
        yield (known[winner], *heads[winner][1:])
        nxt = next(runs[winner], None)
        heads[winner] = nxt
        known[winner] = nxt[0] if nxt else 0
        node = (winner + size) >> 1
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node >>= 1


def resolved(group: list[tuple], width: int) -> Iterator[tuple[int, int, int]]:
    """(rid, first start, last start) of the windows of a gram's entries that occur twice or more. group: the merge's rows, in order.

    A window of entry (suffix and bytes before it, place p) starts d bytes before p, hi <= d <= lo, and is the d bytes before and
    width - d bytes of the suffix. Two windows agree on the right where no common prefix between them, as the merge gave it, is under
    width - d: so entries in order fall into runs. Windows of one run whose d bytes before agree are equal.
    """
    contexts: list[tuple] = []  # (common prefix with the one before, bytes before, lo, hi, places); equal neighbours are one
    last = None
    for known, entry, rid, p, lo, hi in group:
        if last == (len(entry), lo, hi) and known == len(entry):
            contexts[-1][4].append((rid, p))
        else:
            contexts.append((known, entry[width - hi :], lo, hi, [(rid, p)]))
        last = (len(entry), lo, hi)
    if len(contexts) == 1:
        _, _, lo, hi, places = contexts[0]
        if len(places) > 1:
            for rid, p in places:
                yield rid, p - lo, p - hi
        return
    valid: list[list[int]] = [[] for _ in contexts]
    nearest = 0 if any(len(c[4]) > 1 for c in contexts) else width - max(c[0] for c in contexts[1:])  # under it no two agree on the right
    for d in range(max(nearest, min(c[3] for c in contexts)), max(c[2] for c in contexts) + 1):
        seen: dict[bytes, int] = {}
        found: set[int] = set()
        for i, (known, before, lo, hi, places) in enumerate(contexts):
            if known < width - d:
                seen = {}  # a new run
            if hi <= d <= lo:
                j = seen.setdefault(before[:d], i)
                if j != i:
                    found |= {i, j}
                elif len(places) > 1:
                    found.add(i)
        for i in found:
            valid[i].append(d)
    for ds, (_, _, _, _, places) in zip(valid, contexts, strict=True):
        begin = 0
        for i in range(1, len(ds) + 1):
            if i == len(ds) or ds[i] != ds[i - 1] + 1:
                for rid, p in places:
                    yield rid, p - ds[i - 1], p - ds[begin]
                begin = i


def _spans(width: int, gram: int):
    def run(table):
        found: dict[int, list] = {}

        def close(group):
            if len(group) > 1:
                for rid, first, last in resolved(group, width):
                    found.setdefault(rid, []).append((first, last + width))

        group: list[tuple] = []
        for e in merged([decoded(x) for x in table.column("blob").to_pylist()]):
            if group and e[0] < gram:
                close(group)
                group = []
            group.append(e)
        close(group)
        rids = sorted(found)
        return pa.table({"rid": pa.array(rids, pa.int64()), "covered": pa.array([np.array(found[r], "<i8").tobytes() for r in rids], pa.binary())})

    return run


def removed_spans(parts: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(source: DataFrame, width: int, gram: int) -> DataFrame:
    """``source`` (with rid and text) and ``covered``: packed spans of repeated bytes, null for none."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET_BYTES), 1 << 20))
    found = source.select("rid", "text").mapInArrow(common.tidy(_anchor_rows(buckets, width, gram)), "bucket long, blob binary")
    marks = found.groupBy("bucket").applyInArrow(_repeated, "rid long, marks binary").groupBy("rid").agg(F.collect_list("marks").alias("marks"))
    runs = source.join(marks, "rid").select("rid", "text", "marks").mapInArrow(common.tidy(_run_rows(buckets, width, gram)), "bucket long, blob binary")
    spans = runs.groupBy("bucket").applyInArrow(_spans(width, gram), "rid long, covered binary").groupBy("rid").agg(F.collect_list("covered").alias("covered"))
    return source.join(spans, "rid", "left")


def _kept(text: bytes, parts: list[bytes] | None) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of runs."""
    spans = removed_spans(parts) if parts else []
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), sum(b - a for a, b in spans), len(spans)


def report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    source = common.with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches):
        for part in common.chunks(batches):
            texts = common.encoded(part.column("text"))
            got = [_kept(t, c) for t, c in zip(texts, part.column("covered").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([x[1] for x in got], pa.int64()),
                    pa.array([x[2] for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    found = covered(source, width, gram).select("doc_id", "text", "covered")
    return found.mapInArrow(common.tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut from text (parts of a cut character go too), and n_chars, where there is one, counted anew."""
    clashing = [c for c in docs.columns if c in ("rid", "covered", "marks")]
    source = common.with_row_id(docs.withColumnsRenamed({c: "__" + c for c in clashing}))
    schema = source.drop("rid").schema

    def run(batches):
        for part in common.chunks(batches):
            texts = [
                None if t is None else t.encode() if not c else _kept(t.encode(), c)[0]
                for t, c in zip(part.column("text").to_pylist(), part.column("covered").to_pylist(), strict=True)
            ]
            texts = [None if t is None else t.decode("utf-8", "ignore") for t in texts]
            columns = []
            for name in schema.names:
                if name == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif name == "n_chars" and pa.types.is_integer(part.column(name).type):
                    columns.append(pa.array([None if t is None else len(t) for t in texts], part.column(name).type))
                else:
                    columns.append(part.column(name))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = covered(source, width, gram).select(*schema.names, "covered").mapInArrow(common.tidy(run), schema)
    return out.withColumnsRenamed({"__" + c: c for c in clashing})


def brute(rows: list[tuple], width: int) -> list[tuple]:
    """The report by looking at every string of ``width`` bytes, for tests."""
    from collections import Counter

    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, np.int64)
        for i in range(len(t) - width + 1):
            if times[t[i : i + width]] > 1:
                gone[i + 1] += 1
                gone[i + 1 + width] -= 1 if i + 1 + width < len(gone) else 0
        hit = np.cumsum(gone)[1 : len(t) + 1] > 0
        out.append((doc, len(t), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(t, hit, strict=True) if not x)).hexdigest()))
    return out
