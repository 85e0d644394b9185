import itertools
import re
from collections import Counter

import numpy as np

from skein.llm import ngram_join as J
from skein.llm.components import components


def grams(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=sorted)
    near = {s: {u for u in distinct if u != s and len(s & u) >= t * len(s | u) - 1e-9} for s in distinct}
    root = {s: s for s in distinct}
    for s in distinct:
        todo, seen = [s], {s}
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        root[s] = frozenset(seen)
    name = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            name[root[s]] = min(doc, name.get(root[s], doc))
    copies = Counter(sets)
    return sorted(
        ((doc, name.get(root[s]) if s else doc, len(near[s]) if s else 0, copies[s] if s else 1, len(s)) for (doc, _), s in zip(rows, sets, strict=True)),
        key=lambda r: tuple((x is None, x or 0) for x in r),
    )


def fixture():
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(25):
        base = list(rng.choice(vocab, int(rng.integers(6, 120))))
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            rows.append((doc, " ".join(w)))
            doc += 1
    base = list(rng.choice(vocab, 150))
    for _ in range(90):  # one large group of near copies
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        rows.append((doc, " ".join(w)))
        doc += 1
    rows += [(doc + i, "The same exact text, of seven words here!") for i in range(40)]
    rows += [(9000, None), (9001, ""), (9002, "--"), (9003, "short one"), (9004, "SHORT, one"), (None, rows[0][1]), (3, rows[3][1]), (None, "no id at all for this text"), (9005, "x " * 20000)]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, class_id int, rid string").repartition(3)
    monkeypatch.setattr(J, "BLOCK", 16)  # several blocks
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r)[1:] for r in J.joined(df).collect()), key=key)
    assert got == brute(rows)
    kept = J.deduplicated(df)
    assert kept.columns == df.columns
    want = sorted({(r[1] is None, r[1] or 0) for r in got if r[4]}) + [(False, i) for i in (9000, 9001, 9002)]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want)
    assert J.joined(df.limit(0)).collect() == []


def test_banding_reaches_the_recall():
    bands, rows = J.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _, (a, b) in itertools.product(range(70), edges):
        if a != b:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_row_of_each_class_whatever_its_ids(spark):
    text = lambda k: " ".join(f"x{k}y{i}" for i in range(12))
    rows = [(7, text(k), k) for k in range(20)] + [(7, text(3), 20), (8, text(4), 21)]  # one id for many texts
    rows += [(None, text(50), 30), (None, text(50), 31), (None, text(51), 32), (9, text(51), 33)]  # copies without an id
    rows += [(7, None, 40), (7, "--", 41), (None, "", 42)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").coalesce(1)
    assert sorted(r.n for r in J.deduplicated(df).collect()) == [*range(20), 30, 33, 40, 41, 42]
