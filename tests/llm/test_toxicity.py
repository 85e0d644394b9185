import numpy as np

from skein.llm import toxicity as X


def test_gradients_match_differences():
    net = X.Network(["a", "b", "c"], np.zeros(3, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    found = ["a", "b", "zz", "c"]
    at = np.zeros((3, 5), np.int64)
    at[0], at[1, :2], at[2, :3] = [1, 2, 3, 4, 1], [3, 3], [4, 2, 4]
    d = np.array([0.5, -1.0, 2.0])

    def value():
        x, extra = net.inputs(found)
        logit, cache = net.run(x.astype(np.float64), at, keep=True)
        return float(logit @ d), cache, extra

    _, cache, extra = value()
    g = net.gradients(cache, extra, d)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        flat = np.flatnonzero(np.abs(g[k]).ravel() > 1e-3)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            old = v.ravel()[i]
            v.ravel()[i] = old + 1e-2
            up = value()[0]
            v.ravel()[i] = old - 1e-2
            down = value()[0]
            v.ravel()[i] = old
            assert abs((up - down) / 2e-2 - g[k].ravel()[i]) < 2e-2 * max(1, abs(g[k].ravel()[i])), k


def test_windows_cover_every_word():
    for n in range(0, 200):
        got = X.windows(n)
        assert {i for s in got for i in range(s, min(n, s + X.WINDOW))} == set(range(n)) and all(s < n for s in got)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aeiorstnl"), 5)) for _ in range(300)]
    rows = []
    for i in range(900):
        w = list(rng.choice(plain, int(rng.integers(5, 120))))
        if i % 3 == 0:
            w.insert(int(rng.integers(len(w))), str(rng.choice(["idiot", "scum", "moron"])))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    odd = [(5000, None), (5001, ""), (5002, "!!"), (None, "you idiot"), (5003, " ".join(plain) * 20), (3, rows[3][1])]
    docs = spark.createDataFrame([(a, b, 0) for a, b, _ in rows] + [(*r, 1) for r in odd], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(a, c, 1) for a, _, c in rows] + [(3, 1, 0), (None, 1, 0), (5001, None, 0)], "doc_id long, toxic int, score int")
    got = X.scored(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score == by[5002].score == 0 and by[None].predicted == 1
    held = [(by[a].predicted, c) for a, _, c in rows if by[a].held_out]
    assert len(held) > 150 and np.mean([p == c for p, c in held]) > 0.95
    assert X.scored(docs.limit(0), labels).collect() == []
    assert {r.score for r in X.scored(docs, labels.filter("toxic = 0")).collect()} == {0.0}


def test_the_sample_is_bounded_and_takes_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    got = X.shortened(long).split()
    assert len(got) <= X.SAMPLE_WORDS and got[0] == "w0" and got[-1] == "w19999" and X.shortened("a b") == "a b" and X.shortened(None) is None
    docs = spark.createDataFrame([(i % 8, long if i % 2 else f"text {i}") for i in range(64)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = X.sample(docs, labels)
    assert len(rows) <= 8 and any(y == 1 and len(t) > 1000 for t, y in rows) and all(len(t.split()) <= X.SAMPLE_WORDS for t, _ in rows)
