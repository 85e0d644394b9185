"""Shared pieces: the shared folder, chunked Arrow batches, and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20  # text handled at once inside a Python worker

_KEEP = {0x30 + i for i in range(10)} | {0x61 + i for i in range(26)} | set(range(0x80, 0x100))
_TABLE = np.array([b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
WORD_TABLE = _TABLE.tobytes()

_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_OWN: list[str] = []  # the folder of a local session without one
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session in local mode, whose one process all is, gets
    a folder of its own; on a cluster a folder of one machine would be none that executors share, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="skein-"))
    return _OWN[0]


def tidy(run):
    """``run`` over batches, with what the allocators hold on to given back at its end: workers are reused by later stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return tidied


def _trim() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(
            jvm.org.apache.hadoop.fs.Path(path), True
        )
    except Exception:  # the JVM may have ended already
        return


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most ``size`` bytes of ``text`` (a longer text is a slice of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lens = np.array(pa.compute.binary_length(column).fill_null(0), np.int64)
        total, begin = 0, 0
        for i in range(n):
            if total and total + lens[i] > size:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += lens[i]
        yield batch.slice(begin, n - begin)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64. Kept for ordinary chunks; for a longer text they are made and go."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    keep = n <= CHUNK_BYTES + (1 << 17)
    size = CHUNK_BYTES + (1 << 17) if keep else n
    made = []
    for base in (_B, _BINV):
        table = np.full(size, base, np.uint64)
        table[0] = np.uint64(1)
        with np.errstate(over="ignore"):
            made.append(np.multiply.accumulate(table, out=table))
    if keep:
        _POWERS[:] = [(made[0], made[1])]
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def rolling(values: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Running sums of (value + 1) times the powers p, with a 0 in front."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.add(values, np.uint64(1), out=total[1:], dtype=np.uint64, casting="unsafe")
        total[1:] *= p[: len(values)]
        np.cumsum(total[1:], out=total[1:])
    return total


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for each span."""
    p, inverse = powers(len(values) + 1)
    total = rolling(values, p)
    with np.errstate(over="ignore"):
        h = total[ends]
        h -= total[starts]
        h *= inverse[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased words of all texts: the joined bytes, starts, ends, and each text's first word (one more at the end)."""
    data = (b"\n".join(texts) + b"\n").translate(WORD_TABLE)
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return raw, starts, ends, np.searchsorted(starts, offsets)


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, and the first shingle of each text (one more at the end).

    A text of fewer words, but not none, is one shingle.
    """
    raw, starts, ends, first = word_spans(texts)
    w = span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(per, out=out_first[1:])
    total = int(out_first[-1])
    at = np.arange(total) - np.repeat(out_first[:-1], per) + np.repeat(first[:-1], per)
    stop = np.repeat(first[1:], per)
    h = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            here = at + k
            ok = here < stop
            got = w[np.minimum(here, max(len(w) - 1, 0))] if len(w) else np.zeros(total, np.uint64)
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, got, np.uint64(0x1234567))
    return mix(h), out_first


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and bytes in one compressed row value."""
    import zstandard

    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.compress(np.array([len(x) for x in raw], np.int64).tobytes() + b"".join(raw), 1)


def unpacked(blob: bytes, n: int) -> list[memoryview]:
    import zstandard

    raw = memoryview(zstandard.decompress(blob))
    at = np.concatenate(([8 * n], 8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], np.int64)))).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def with_row_id(docs: DataFrame) -> DataFrame:
    """``docs`` with a row id ``rid`` that is the same in every evaluation.

    Rows of files keep their partition and place, whatever columns are read. Any other plan could deal its rows out anew, so it is
    written once to the shared folder first.
    """
    from pyspark.sql import functions as F

    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()}
    if not nodes <= {"Project", "Filter", "Relation"}:
        docs = cut(docs)
    return docs.withColumn("rid", F.monotonically_increasing_id())
