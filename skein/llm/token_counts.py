"""Token counts without token ids: each distinct pre-token's pieces are counted once, then joined to pre-token frequencies.

The pre-tokenizer is vectorised over code points (``PreTokenizer``): it gives the same pieces as the byte-level pattern of
the vocabulary file. Documents are read in blocks; a block sends its distinct pre-tokens with postings (the documents'
places in the block and their frequencies, two bytes each). The postings meet the pre-token's count in a join, go back to
their block, and a weighted bincount sums them. Blocks meet pre-tokens by hash bucket, in packed rows: a row for each
(block, pre-token) was tried and took over twice the input on disk. No row carries token ids.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings of the vocabulary inside a text are one token
each, as is the library's default; repeated rows each get their own row; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_CHARS = 12 << 20  # text of one block
BLOCK_ROWS = 50_000
SHORT = 64  # pre-tokens of more code points are compared as strings, not by hash

OTHER, LETTER, NUMBER, SPACE, APOSTROPHE = range(5)
#: The endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the library's own regular expressions see it."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    text, points = "".join(map(chr, points)), np.array(points)
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        mine = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            mine[a:b] = False
        out[points[mine]] = kind
    return out


def spans(codes: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the texts that begin at ``firsts`` in ``codes`` (each text not empty)."""
    n = len(codes)
    kind = table[codes]
    head = np.zeros(n + 1, bool)
    head[firsts] = True
    head[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= head[:n]
    start = change.copy()
    space = kind == SPACE
    # the last of a run of white space goes on its own, or with what follows if it is a blank, unless the text ends there
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~head[1:]
    start |= last
    with_next = last & (codes == 32)
    start[1:] &= ~with_next[:-1]
    # endings: an apostrophe that begins a pre-token takes them along
    mark = np.flatnonzero((codes == 39) & start)
    if len(mark):
        padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
        ends_1 = head[np.minimum(mark + 1, n)]
        ends_2 = head[np.minimum(mark + 2, n)]
        for e in ENDINGS:
            ok = (padded[mark + 1] == ord(e[0])) & ~ends_1
            if len(e) == 2:
                ok &= (padded[np.minimum(mark + 2, n + 1)] == ord(e[1])) & ~ends_2
            at = mark[ok]
            start[at + 1] = False
            after = at + 1 + len(e)
            start[after[after < n]] = True
    return np.flatnonzero(start)


class PreTokenizer:
    """Pre-tokens of many texts at once; ``special`` strings are pre-tokens of their own.

    The table of classes is made once, on the driver; executors get it with the broadcast pre-tokenizer.
    """

    def __init__(self, special: tuple[str, ...] = ()):
        import regex

        self.table = classes()
        self.special = frozenset(special)
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pre-tokens, each occurrence's place among them in order, and each text's first occurrence (one more at the end)."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            for x in self.pattern.split(t) if self.pattern and any(s in t for s in self.special) else (t,):
                if x:
                    parts.append(x)
                    owner.append(i)
        if not parts:
            return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        firsts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=firsts[1:])
        start = spans(codes, firsts[:-1], self.table)
        if self.special:
            whole = [i for i, x in enumerate(parts) if x in self.special]
            if whole:
                keep = np.ones(len(start), bool)
                for i in whole:
                    a, b = np.searchsorted(start, firsts[i : i + 2])
                    keep[a + 1 : b] = False
                start = start[keep]
        end = np.append(start[1:], len(codes))
        long = np.flatnonzero(end - start > SHORT)
        h = common.span_hashes(codes, start, end)
        if len(long):
            seen: dict[str, int] = {}
            h[long] = [seen.setdefault(joined[a:b], len(seen)) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        distinct = [joined[a:b] for a, b in zip(start[index].tolist(), end[index].tolist(), strict=True)]
        text_of = np.array(owner)[np.searchsorted(firsts, start, side="right") - 1]
        return distinct, inverse.reshape(-1), np.searchsorted(text_of, np.arange(len(texts) + 1))


@lru_cache(4)
def vocabulary(path: str):
    """The library's tokenizer and its special strings."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, tuple(x.content for x in t.get_added_tokens_decoder().values())


@lru_cache(4)
def merger(path: str):
    """A fast encoder of single pre-tokens by the same merges, or None if the file's ids don't follow its merges; and the special strings.

    The library's own tokenizer, some 40 MB, is loaded in a worker only where a pre-token needs it.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, special = file["model"], frozenset(x["content"] for x in file.get("added_tokens") or ())
    # fixed values: the byte-level alphabet, printable bytes as themselves and the others from code point 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab["".join(m)] for m in merges]
    singles = [vocab.get(c, -1) for c in alphabet]
    if order != sorted(set(order)) or min(singles) < 0 or max(singles) > order[0] or model.get("ignore_merges"):
        return None, special
    kept = {*order, *singles}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i in kept}
    return tiktoken.Encoding("merger", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), special


def pieces(path: str, pretokens: list[str]) -> list[list[int]]:
    """The ids of each pre-token: by the merger where it is exact and fast, by the library itself for special and very long ones."""
    fast, special = merger(path)
    out: list = [None] * len(pretokens)
    slow = []
    for i, x in enumerate(pretokens):
        if fast is None or len(x) > 400 or x in special:
            slow.append(i)
        else:
            out[i] = fast.encode_ordinary(x)
    for i in range(0, len(slow), 10_000):
        some = slow[i : i + 10_000]
        for j, e in zip(some, vocabulary(path)[0].encode_batch([pretokens[j] for j in some], add_special_tokens=False), strict=True):
            out[j] = e.ids
    return out


def piece_counts(path: str, pretokens: list[str]) -> list[int]:
    return list(map(len, pieces(path, pretokens)))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of many chunks each."""
    held, total, n = [], 0, 0
    for part in common.chunks(batches):
        if held and (total + part.nbytes > size or n + part.num_rows > rows):
            yield held
            held, total, n = [], 0, 0
        held.append(part)
        total += part.nbytes
        n += part.num_rows
    if held:
        yield held


def _runs(place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pre-token, text, frequency) of sorted occurrences."""
    key = place.astype(np.int64) << 32 | text
    key.sort(kind="stable")
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.diff(np.append(at, len(key)))


def _entries(place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and numbers as 16-bit arrays, a number above 65535 as several entries; and how many entries each takes."""
    times = np.maximum(-(-number // 65535), 1)
    many = np.repeat(np.arange(len(number)), times)
    last = np.zeros(len(many), bool)
    last[np.cumsum(times) - 1] = True
    return place[many].astype(np.uint16), np.where(last, number[many] - (times[many] - 1) * 65535, 65535).astype(np.uint16), times


HEADS = "bucket long, block long, blob binary, ids array<long>, sizes array<long>"


def _postings(shared, buckets: int):
    """Per block: a head row with its documents, and for each bucket its distinct pre-tokens with their postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter, part_id = shared.value, TaskContext.get().partitionId()
        for number, held in enumerate(_blocks(batches, BLOCK_ROWS, BLOCK_CHARS)):
            block = (part_id << 24) | number
            known: dict[str, int] = {}
            token, text, freq, ids, sizes, row = [], [], [], [], [], 0
            for part in held:
                ids += part.column("doc_id").to_pylist()
                raw = common.encoded(part.column("text"))
                sizes += map(len, raw)
                distinct, inverse, first = cutter.split([x.decode() for x in raw])
                at = np.array([known.setdefault(x, len(known)) for x in distinct], np.int64)
                who = np.repeat(np.arange(row, row + len(raw)), np.diff(first))
                for to, x in zip((token, text, freq), _runs(at[inverse] if len(at) else inverse, who), strict=True):
                    to.append(x)
                row += len(raw)
            token, text, freq = (np.concatenate(x) for x in (token, text, freq))
            names = [x.encode() for x in known]
            bucket = np.array([zlib.crc32(x) for x in names], np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            token = rank[token]
            by = np.argsort(token, kind="stable")
            place, number_of, times = _entries(text[by], freq[by])
            upto = np.concatenate(([0], np.cumsum(times)))[np.searchsorted(token[by], np.arange(len(names) + 1))]
            made = [(block % buckets, None, ids, sizes)]
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = [names[i] for i in order[a:b].tolist()]
                lens, counts = np.array([len(x) for x in mine], np.uint32), np.diff(upto[a : b + 1]).astype(np.uint32)
                p, q = int(upto[a]), int(upto[b])
                made.append((int(bucket[order[a]]), common.packed(lens, counts, place[p:q], number_of[p:q], b"".join(mine)), None, None))
            for i in range(0, len(made), 64):
                some = list(zip(*made[i : i + 64], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some[0], pa.int64()),
                        pa.array([block] * len(some[0]), pa.int64()),
                        pa.array(some[1], pa.binary()),
                        pa.array(some[2], pa.list_(pa.int64())),
                        pa.array(some[3], pa.list_(pa.int64())),
                    ],
                    ["bucket", "block", "blob", "ids", "sizes"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A pre-token belongs to one bucket, so its pieces are counted once. There are as many buckets as shuffle partitions; a bucket
    holds its share of all postings, of which one very common pre-token has at most one per document.
    """
    spark = docs.sparkSession
    _, special = vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(PreTokenizer(special))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def join(table):
        out, counts = [], {}
        for r in table.to_pylist():
            if r["blob"] is None:
                out.append(r)
                continue
            lens, entries, place, freq, text = common.unpacked(r["blob"], 5)
            ends = np.cumsum(np.frombuffer(lens, np.uint32), dtype=np.int64)
            names = [bytes(text[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            new = [x for x in names if x not in counts]
            counts.update(zip(new, piece_counts(vocabulary_path, [x.decode() for x in new]), strict=True))
            weight = np.repeat(np.array([counts[x] for x in names], np.int64), np.frombuffer(entries, np.uint32))
            sums = np.bincount(np.frombuffer(place, np.uint16), weight * np.frombuffer(freq, np.uint16)).astype(np.int64)
            has = np.flatnonzero(sums)
            at, number, _ = _entries(has, sums[has])
            out.append(r | {"blob": common.packed(at, number)})
        return pa.Table.from_pylist(out, table.schema)

    def total(table):
        head = table.filter(table.column("blob").is_null()).to_pylist()[0]
        sums = np.zeros(len(head["ids"]), np.int64)
        for r in table.column("blob").to_pylist():
            if r is not None:
                at, number = (np.frombuffer(x, np.uint16) for x in common.unpacked(r, 2))
                sums += np.bincount(at, number, len(sums)).astype(np.int64)
        return pa.table(
            {"doc_id": pa.array(head["ids"], pa.int64()), "n_bytes": pa.array(head["sizes"], pa.int64()), "n_tokens": sums, "over_limit": sums > limit}
        )

    postings = rows.mapInArrow(common.tidy(_postings(shared, buckets)), HEADS)
    met = postings.groupBy("bucket").applyInArrow(join, HEADS)
    return met.groupBy("block").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
