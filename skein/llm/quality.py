"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is the bucket counts of a measure on a fixed grid with a relative error of ``ACCURACY``: sketches of any parts of the
data merge by adding counts, in any order, with the same result. The counts are made before the shuffle, so a source with a
third of all rows costs one row per bucket and task. Each (language, source) has a fence for each measure: its median plus ``SPREAD``
times the distance to its upper quartile (what the sketch can't tell apart counts as distance), both from its own sketch, or from its language's or the whole table's where it has fewer than
``min_rows`` documents. A source whose spread is nil would lose every row that isn't like its median, so no fence lies under the
``GUARD`` quantile of its language (of the whole table, for a rare language). No threshold is a fixed value. A document stays while
it lies in the fence's bucket or below: ties at the fence stay. Rows join their thresholds and are filtered.

Base measures: words are the runs of ``[^\\x20\\x09-\\x0D]``; see ``measures``. A text fails at base if it has under 10 words or
more than a fifth of its words lie in repeated 5-word windows. Defined cases: a null text has no words (base_failed); null lang
and source are groups like any other; repeated rows each get a verdict; empty tables give empty results; further columns pass
through ``filtered`` and are ignored by ``judged``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ACCURACY = 0.005
MIN_ROWS = 50
SPREAD = 8.0  # fence: median + SPREAD * (upper quartile - median), and no less than the language's guard
QUANTILES = {"q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
#: The quantile of its language under which no measure is a reason to reject.
GUARD = {"symbol_share": "q90", "dup_line_share": "q99", "word_length": "q95"}

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
#: Continuation bytes and white space: what isn't the first byte of a code point of a word.
_NOT_WORD = bytes(range(0x80, 0xC0)) + _SPACES


def repeat_words(words: list, n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + n - max(i, until)
            until = i + n
    return covered


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()  # of bytes: exactly the white space of the rule
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_WORD)),
        len(text.translate(None, _NOT_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (without text) with the measures of each whole text."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in MEASURES.split(",")]
        for part in common.chunks(batches):
            found = list(zip(*map(measures, common.encoded(part.column("text"))), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x, pa.int64()) for x in found], keep + names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(common.tidy(run), ", ".join([*fields, MEASURES]))


def _shares() -> dict:
    return {
        "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    }


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure: bucket counts on the grid gamma**bucket; bucket null holds zeros."""
    log_gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _shares().items()]))
    bucket = F.when(F.col("p.value") > 0, F.ceil(F.log("p.value") / log_gamma).cast("int"))
    return (
        rows.select(*keys, pairs.alias("p"))
        .select(*keys, F.col("p.measure").alias("measure"), bucket.alias("bucket"))
        .groupBy(*keys, "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Per group and measure: n_rows and the named quantiles of merged sketches. Sorting is by bucket: a few hundred rows a group."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    w = Window.partitionBy(*keys, "measure")
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(gamma), F.col("bucket")) * (2 / (gamma + 1)))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("n_rows"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value)).alias(name) for name, q in at.items()]
    )


def thresholds(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source, and an upper fence for each measure."""
    own = sketches(rows, ["lang", "source"])
    fine, by_lang, all_rows = (quantiles(own, keys, QUANTILES) for keys in (["lang", "source"], ["lang"], []))
    names = ("n_rows", *QUANTILES)
    as_ = lambda df, p: df.select(*[c for c in ("lang", "measure") if c in df.columns], *[F.col(n).alias(p + n) for n in names])
    lang = as_(by_lang, "l_").withColumnsRenamed({"lang": "l_lang", "measure": "l_measure"})
    whole = as_(all_rows, "a_")
    joined = fine.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(whole, "measure")
    wide = lambda n: F.when(F.col("l_n_rows") >= min_rows, F.col("l_" + n)).otherwise(F.col("a_" + n))
    pick = lambda n: F.when(F.col("n_rows") >= min_rows, F.col(n)).otherwise(wide(n))
    guard = F.coalesce(*[F.when(F.col("measure") == k, wide(q)) for k, q in GUARD.items()])
    spread = F.greatest(pick("q75") - pick("q50"), 2 * ACCURACY * pick("q50"))
    fence = F.greatest(guard, pick("q50") + SPREAD * spread) / (1 - ACCURACY)  # the upper end of a bucket
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, fence)).alias("max_" + k) for k in GUARD])


def _judge(rows: DataFrame, min_rows: int) -> DataFrame:
    """``rows`` with their measures, and base_failed, kept, and the fences applied."""
    limits = thresholds(rows, min_rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    met = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for name, share in _shares().items():
        inside = inside & (share <= F.col("max_" + name))
    return met.withColumn("base_failed", base).withColumn("kept", ~base & F.coalesce(inside, F.lit(True))).drop("t_lang", "t_source")


def judged(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed, kept, and the fences applied."""
    return _judge(common.cut(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text"))), min_rows)


def filtered(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    clashing = {"rid": "__rid"} if "rid" in docs.columns else {}
    docs = common.with_row_id(docs.withColumnsRenamed(clashing))
    rows = common.cut(measured(docs.select("rid", "lang", "source", "text")))
    keep = _judge(rows, min_rows).filter("kept").select("rid")
    return docs.join(keep, "rid", "left_semi").drop("rid").withColumnsRenamed({v: k for k, v in clashing.items()})


def report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
