"""The pipeline against its stages' brute-force versions, on a small fixture."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from skein.llm import common, decontaminate, suffix_dedup
from skein.llm import token_counts as T
from skein.llm.queries import VOCABULARY
from tests.llm.test_ngram_join import brute as near

WORDS = {"en": "the and of to in that was with for is hill house water over under light", "de": "der die und das nicht mit ein ist auf sich haus berg wasser über licht dem"}


def fixture():
    rng = np.random.default_rng(4)
    rows, passages = [], {}
    for lang, w in WORDS.items():
        w = w.split()
        passages[lang] = " ".join(rng.choice(w, 70))
        for _ in range(60):
            rows.append([len(rows), " ".join(rng.choice(w, int(rng.integers(40, 90)))), lang, "s", 0])
        for _ in range(6):
            rows.append([len(rows), " ".join([*rng.choice(w, 30), passages[lang], *rng.choice(w, 30)]), lang, "s", 0])
    near_copy = rows[3][1].split()
    near_copy[5] = "changed"
    rows += [[500, rows[0][1], "en", "s", 0], [501, " ".join(near_copy), "en", "s", 0], [502, None, "en", "s", 0], [503, "12 34", None, "s", 0], [504, rows[9][1] + " item one two three four five six seven eight nine ten", "en", "s", 0]]
    return rows, [(1, "One two three four five six seven eight nine ten")]


def test_pipeline(spark, tmp_path):
    rows, items = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    first = {r[0]: r[1] for r in rows}
    assert seen[0] == {k: v for k, v in first.items() if k not in (502, 503)}
    classes = {r[0]: r[1] for r in near(sorted(seen[0].items()))}
    assert seen[1] == {k: v for k, v in seen[0].items() if classes[k] == k} and not {500, 501} & set(seen[1])
    want = {r[0]: r[4] for r in suffix_dedup.brute(sorted(seen[1].items()), suffix_dedup.WIDTH)}
    import hashlib

    assert {k: hashlib.sha256(v.encode()).hexdigest() for k, v in seen[2].items()} == want and seen[2] != seen[1]
    clean = {r[0] for r in decontaminate.brute(sorted(seen[2].items()), items) if not r[5]}
    assert seen[3] == {k: v for k, v in seen[2].items() if k in clean} and 504 not in clean
    got, sequences = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    t, _ = T.vocabulary(VOCABULARY)
    assert {k: sum(r.length for r in v) for k, v in got.items()} == {k: len(t.encode(v, add_special_tokens=False).ids) + 1 for k, v in seen[3].items()}
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sequences.values())
