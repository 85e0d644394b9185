"""DuckDB SQL for the corpus operators that SQL can express."""

import math

from . import quality

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS (
    SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM places CROSS JOIN sizes WHERE i + size - 1 <= len(w)
),
found AS (SELECT g.rid, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid),
listed AS (
    SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
    sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.rid = h.rid LEFT JOIN listed l ON d.rid = l.rid
"""

_GAMMA = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)


def _wide(q: str) -> str:
    """A quantile of the language, or of the whole table where the language is rare."""
    return f"CASE WHEN l.n_rows >= {quality.MIN_ROWS} THEN l.{q} ELSE a.{q} END"


_GUARD = " ".join(f"WHEN '{k}' THEN {_wide(q)}" for k, q in quality.GUARD.items())


def _fences(name: str, keys: str) -> str:
    """Quantiles of the grid buckets of each group and measure."""
    return f"""
{name} AS (
    SELECT {keys} measure, max(total) AS n_rows, {', '.join(f'min(CASE WHEN upto >= ceil(total * {q!r}::DOUBLE) THEN v END) AS {name}' for name, q in quality.QUANTILES.items())}
    FROM (
        SELECT {keys} measure, CASE WHEN bucket IS NULL THEN 0.0::DOUBLE ELSE pow({_GAMMA!r}::DOUBLE, bucket) * {2 / (_GAMMA + 1)!r}::DOUBLE END AS v,
            sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS total
        FROM (SELECT {keys} measure, bucket, count(*) AS n FROM buckets GROUP BY {keys} measure, bucket)
    ) GROUP BY {keys} measure
)"""


QUALITY = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
),
grams AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid),
measured AS (
    SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM docs d LEFT JOIN repeats r ON d.rid = r.rid
),
shares AS (
    SELECT rid, lang, source, 'symbol_share' AS measure, n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE) AS x FROM measured
    UNION ALL SELECT rid, lang, source, 'dup_line_share', n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) FROM measured
    UNION ALL SELECT rid, lang, source, 'word_length', word_chars / CAST(greatest(n_words, 1) AS DOUBLE) FROM measured
),
buckets AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {math.log(_GAMMA)!r}::DOUBLE) AS INT) END AS bucket FROM shares),
{_fences("fine", "lang, source,")}, {_fences("by_lang", "lang,")}, {_fences("whole", "")},
picked AS (
    SELECT f.lang, f.source, f.measure, CASE f.measure {_GUARD} END AS guard,
        CASE WHEN f.n_rows >= {quality.MIN_ROWS} THEN f.q50 ELSE {_wide("q50")} END AS q50, CASE WHEN f.n_rows >= {quality.MIN_ROWS} THEN f.q75 ELSE {_wide("q75")} END AS q75
    FROM fine f JOIN by_lang l ON f.lang IS NOT DISTINCT FROM l.lang AND f.measure = l.measure JOIN whole a ON f.measure = a.measure
),
verdict AS (
    SELECT s.rid, bool_and(s.x <= greatest(p.guard, p.q50 + {quality.SPREAD!r}::DOUBLE * greatest(p.q75 - p.q50, {2 * quality.ACCURACY!r}::DOUBLE * p.q50)) / {1 - quality.ACCURACY!r}::DOUBLE) AS inside
    FROM shares s JOIN picked p ON s.measure = p.measure AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source GROUP BY s.rid
),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND v.inside AS kept
FROM based b JOIN verdict v ON b.rid = v.rid
"""
