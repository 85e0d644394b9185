from skein.llm import decontaminate as D

ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Short item"), (10, "Short item"), (3, None), (4, "--"), (5, "é café 漢字"), (None, "zz yy")]
TEXTS = [
    (0, "x one TWO three, four five six seven eight nine ten y"), (1, "one two three four five six seven eight nine eleven"), (2, "a short-item! short item short"),
    (3, None), (4, ""), (5, "É é CAFÉ é café 漢字 zz yy"), (None, "short item"), (2, "a short-item! short item short"), (7, "q " * 30000 + "two three four five six seven eight nine ten eleven " * 3),
]
key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def test_against_every_window(spark, monkeypatch):
    docs = spark.createDataFrame([(a, b, 1, "q") for a, b in TEXTS], "doc_id long, text string, n_hit int, item_id string")
    items = spark.createDataFrame([(a, b, 3) for a, b in ITEMS], "item_id long, text string, doc_id int")
    want = sorted(D.brute([(a, (b or "")) for a, b in TEXTS], ITEMS), key=key)
    assert sorted(map(tuple, D.digest(D.contamination(docs, items)).collect()), key=key) == want
    kept = D.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [r[0] for r in want if not r[5]]
    assert sorted(r.doc_id for r in kept.collect()) == clean
    monkeypatch.setattr(D, "MAX_BROADCAST_WORDS", 4)  # the shuffle gives the same
    monkeypatch.setattr(D, "GRAM_ROWS", 50)
    assert sorted(map(tuple, D.digest(D.contamination(docs, items)).collect()), key=key) == want
    assert sorted(r.doc_id for r in D.remove_contaminated(docs, items).collect()) == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.digest(D.contamination(docs, none)).collect()] == [(1, 2, 0, 0)]
    assert D.digest(D.contamination(docs.limit(0), none)).collect() == []
    assert D.remove_contaminated(docs, none).count() == 1 and D.remove_contaminated(docs.limit(0), none).count() == 0


def test_shuffle_with_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_BROADCAST_WORDS", -1)
    test_empty_tables(spark)
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, "c", "z")], "doc_id long, text string, rid string")
    items = spark.createDataFrame([(7, "A b!")], "item_id long, text string")
    kept = D.remove_contaminated(docs, items)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [(2, "c", "z")]
    assert sorted(tuple(r)[:4] for r in D.digest(D.contamination(docs, items)).collect()) == [(1, 2, 2, 1), (1, 2, 2, 1), (2, 1, 0, 0)]
