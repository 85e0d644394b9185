"""N-gram Jaccard join: MinHash banding finds candidates, the full n-gram sets verify them.

A document's n-grams are its ``N``-word shingles (a text of fewer words is one shingle). Documents with equal sets are one class
from the start; only its representative goes on. Bands and rows are chosen for the target recall at the threshold
(``banding``). The shuffle is on band hashes, and pairs are verified bucket by bucket on the full sets, each at the first band that its
two sides share, so links are counted once and nothing is compared that shares no band. A bucket with the members of an earlier
one is dropped. A bucket is split into blocks of at most ``BLOCK`` sets and ``BLOCK_BYTES``, and each pair of blocks is a group of its own
that tasks share out: every pair inside a bucket is compared, whatever its size, and only link counts and a spanning forest leave the
task. Classes are the connected components of the verified links.

Defined cases: a null or wordless text has no n-grams, no links and a class of its own; a null doc_id takes part, and a class is
named by its least doc_id that isn't null; repeated rows are copies; an empty table gives an empty result; further columns pass
through ``deduplicated`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK = 256
BLOCK_BYTES = 4 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with the target recall in at most ``most`` hashes."""
    found = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            found = (bands, rows)
    return found


def signatures(texts: list[bytes], n: int, bands: int, rows: int) -> tuple[list, list, list]:
    """Per text: its set's digest (16 bytes, or None), its band hashes (or None) and its number of distinct n-grams."""
    h, first = common.shingles(texts, n)
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) for _ in range(2))
    x = (h >> np.uint64(32)).astype(np.uint32)
    has = np.flatnonzero(np.diff(first))
    at = first[:-1][has]
    least = np.empty((bands * rows, len(has)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(bands * rows if len(has) else 0):
            least[k] = np.minimum.reduceat((x ^ b[k]) * (a[k] | np.uint32(1)), at)
        band = np.empty((len(has), bands), np.uint64)
        for i in range(bands):
            v = np.full(len(has), i + 1, np.uint64)
            for k in range(rows):
                v = common.mix(v * np.uint64(0x9E3779B97F4A7C15) + least[i * rows + k])
            band[:, i] = v
    digest, out, size = [None] * len(texts), [None] * len(texts), [0] * len(texts)
    for j, i in enumerate(has.tolist()):
        own = np.unique(h[first[i] : first[i + 1]])
        with np.errstate(over="ignore"):
            digest[i] = np.array([own.sum(), common.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()
        out[i], size[i] = band[j].view(np.int64), len(own)
    return digest, out, size


def linked(sets: list[np.ndarray], left: list[int], right: list[int] | None, threshold: float, bands: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links among ``left``, or between ``left`` and ``right``: each set's number of links, and the edges of a spanning forest. Pairs that share
    one of ``bands`` (set, band) are left out."""
    n = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = place[column[use]], owner[use]
    width = int(shared.sum())
    a = np.array(left)
    b = a if right is None else np.array(right)
    both = np.zeros((len(a), len(b)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for begin in range(0, width, 8192):
        p, q = np.searchsorted(column, [begin, begin + 8192])
        m = np.zeros((len(sets), min(8192, width - begin)), np.float32)
        m[owner[p:q], column[p:q] - begin] = 1
        both += m[a] @ m[b].T
    link = both * (1 + threshold) >= threshold * (n[a][:, None] + n[b][None, :]) - 1e-9
    for k in range(0 if bands is None else bands.shape[1]):
        link &= bands[a, k][:, None] != bands[b, k][None, :]
    if right is None:
        np.fill_diagonal(link, False)
    counts = np.zeros(len(sets), np.int64)
    counts[a] += link.sum(1)
    if right is not None:
        counts[b] += link.sum(0)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i in range(len(a)):
        for j in np.flatnonzero(link[i]).tolist():
            u, v = root(int(a[i])), root(int(b[j]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                forest.append((int(a[i]), int(b[j])))
    return counts, forest


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, from sorted partitions."""
    held, last = [], None
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(r)
    if held:
        yield held


def joined(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, class_id, n_links (other sets within the threshold), n_copies (rows of the same set), n_grams."""
    bands, rows = banding(threshold, recall)
    source = common.with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _joined(source, n, threshold, bands, rows)


def _joined(source: DataFrame, n: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """``joined`` of rows with rid, doc_id and text."""
    signed, named = _classes(source, n, threshold, bands, rows)
    return signed.join(named, "digest", "left").select(
        "rid",
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        "n_grams",
    )


def _classes(source: DataFrame, n: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their digests, and the digests with their classes: class_id, keeper (the rid of the class's least (doc_id, rid), null ids last), n_links, n_copies."""

    def sign(batches):
        for part in common.chunks(batches):
            digest, band, size = signatures(common.encoded(part.column("text")), n, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(size, pa.int64())],
                ["rid", "doc_id", "digest", "bands", "n_grams"],
            )

    signed = common.cut(source.mapInArrow(common.tidy(sign), "rid long, doc_id long, digest binary, bands array<long>, n_grams long"))
    # classes of equal sets; made before the shuffle, so many copies cost one row per task
    least = F.min(F.struct("rid", "bands", "n_grams")).alias("least")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    classes = signed.filter("digest is not null").groupBy("digest").agg(least, first, F.count(F.lit(1)).alias("n_copies"))
    classes = common.cut(classes.select("digest", F.col("least.rid").alias("rep"), F.col("least.bands").alias("bands"), F.col("least.n_grams").alias("n_grams"), "first", "n_copies"))
    places = classes.select("rep", "n_grams", F.posexplode("bands").alias("band", "h"))
    mark = F.xxhash64("rep")
    buckets = places.groupBy("h", "band").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y"), F.sum("n_grams").alias("grams")).filter("m > 1")
    # buckets of equal members: the first band's stays
    buckets = buckets.groupBy("m", "x", "y", "grams").agg(F.min(F.struct("band", "h")).alias("b")).select(
        F.col("b.h").alias("h"), F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(8 * F.col("grams") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    member = places.join(buckets, "h").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    member = member.groupBy("rep").agg(F.collect_list(F.struct("h", "band", "block", "blocks")).alias("at")).join(classes.select("rep", "bands"), "rep")  # a band each at most

    def sets(batches):
        for part in common.chunks(batches):
            h, first = common.shingles(common.encoded(part.column("text")), n)
            own = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rep", "bands", "at")], pa.array(own, pa.binary())], ["rep", "bands", "at", "grams"])

    # one plan at every size: texts move once, whether or not the members would fit a broadcast today
    with_sets = source.select("rid", "text").hint("merge").join(member, F.col("rid") == F.col("rep")).select("rep", "bands", "at", "text")
    with_sets = with_sets.mapInArrow(common.tidy(sets), "rep long, bands array<long>, at array<struct<h:long,band:int,block:int,blocks:int>>, grams binary")
    pairs = with_sets.select("rep", F.explode("at").alias("p"), "bands", "grams").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    before = F.slice("bands", F.lit(1), F.col("p.band"))  # the bands at which a pair would have met already
    pairs = pairs.select(F.col("p.h").alias("h"), F.least("p.block", "other").alias("i"), F.greatest("p.block", "other").alias("j"), F.col("p.block").alias("block"), "rep", before.alias("before"), "grams")
    keys = ["h", "i", "j"]

    def verify(batches):
        rep, root, links = [], [], []

        def out():
            made = pa.RecordBatch.from_pydict({"rep": pa.array(rep, pa.int64()), "other": pa.array(root, pa.int64()), "links": pa.array(links, pa.int64())})
            for x in (rep, root, links):
                x.clear()
            return made

        for own in _groups(batches, keys):
            own.sort(key=lambda r: r["rep"])
            if len(own) < 2:
                continue
            got = [np.frombuffer(r["grams"], np.uint64) for r in own]
            earlier = np.array([r["before"] for r in own], np.int64)
            first = own[0]["i"]
            left = [k for k, r in enumerate(own) if r["block"] == first]
            right = [k for k, r in enumerate(own) if r["block"] != first]
            if first != own[0]["j"]:
                if not left or not right:
                    continue
                counts, forest = linked(got, left, right, threshold, earlier)
            else:
                counts, forest = linked(got, left, None, threshold, earlier)
            for k in np.flatnonzero(counts).tolist():
                rep.append(own[k]["rep"])
                root.append(own[k]["rep"])
                links.append(int(counts[k]))
            for a, b in forest:
                rep.append(own[a]["rep"])
                root.append(own[b]["rep"])
                links.append(0)
            if len(rep) > 10_000:
                yield out()
        yield out()

    spread = pairs.repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    verified = common.cut(spread.mapInArrow(common.tidy(verify), "rep long, other long, links long"))
    counts = verified.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(verified.filter("links = 0").select(F.col("rep").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("rep"), "root")
    named = classes.select("digest", "rep", "first", "n_copies").join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ids = named.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("keeper"))
    named = named.drop("first").join(ids, "root").select("digest", "rep", "class_id", "keeper", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.drop("bands"), named


def deduplicated(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one of each class: its least doc_id's first row, or its first row where no row has a doc_id. Rows without n-grams all stay."""
    docs = common.with_row_id(docs.withColumnRenamed("rid", "__rid") if "rid" in docs.columns else docs)
    signed, named = _classes(docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text"), n, threshold, *banding(threshold))
    keep = signed.filter("digest is null").select("rid").unionByName(named.select(F.col("keeper").alias("rid")).distinct())
    return docs.join(keep, "rid", "left_semi").drop("rid").withColumnRenamed("__rid", "rid")
