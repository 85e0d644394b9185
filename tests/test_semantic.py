"""Counts of trigrams and terms: every message counts, and a payload that is sent again is taken apart once."""

from collections import Counter

from skein.operators import semantic


def test_counts_of_repeated_and_null_payloads(spark):
    texts = ["to be or not", "to be or not", None, "", "To  be!", "or not to be"] * 3
    m = spark.createDataFrame([("g", "t", "ab"[i % 2], "c", i, x) for i, x in enumerate(texts)], "gate_id string, team string, sender string, receiver string, seq int, payload string")
    words = Counter(("ab"[i % 2], w) for i, x in enumerate(texts) for w in (x or "").lower().replace("!", " ").split() if len(w) > 1)
    terms = semantic.counted(m, "term")
    assert {(r.agent, r.gram): r.c for r in terms.collect()} == words and dict(terms.dtypes)["c"] == "bigint"
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [gate_id" in plan[plan.index("Generate") :], plan
