import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import suffix_dedup as S

key = lambda r: tuple((x is None, x or 0) for x in r)


def fixture():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdeé漢"), int(rng.integers(1, 6))))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(int(rng.integers(3, 30))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(6))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist())
            parts += [p[a:b] if rng.random() < 0.5 else p, text(int(rng.integers(0, 12)))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(20)] + [(300, None), (301, ""), (302, "a" * 900), (303, "ab" * 700), (304, "x" + "ab" * 40), (None, rows[7][1]), (8, rows[8][1])]
    rows += [(400 + i, f"{i} " + passages[0] + f" {i}" + "tail") for i in range(40)] + [(500, text(30) + "\0\0" + passages[1])]
    return rows


@pytest.mark.parametrize(("width", "gram"), [(24, 8), (40, 12)])
def test_against_every_string(spark, width, gram, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1500)  # long texts come in parts
    monkeypatch.setattr(S, "RUN", 300)
    rows = fixture()
    df = spark.createDataFrame([(a, b, 7, "m") for a, b in rows], "doc_id long, text string, n_bytes int, marks string").repartition(3)
    want = sorted(S.brute(rows, width), key=key)
    got = sorted(map(tuple, S.report(df, width, gram).collect()), key=key)
    assert got == want and sum(r[2] for r in want) > 3000
    assert S.report(df.limit(0), width, gram).collect() == []


def test_texts_after(spark):
    line = "a passage that is shared by two documents, é and all"
    df = spark.createDataFrame([(1, "one " + line + " end", 5, "x", 3), (2, "two " + line + " fin", 5, "y", 3), (3, None, None, "z", 3)], "doc_id long, text string, n_chars long, rid string, covered int")
    got = S.deduplicated(df, 24, 8)
    assert got.schema == df.schema
    assert sorted((r.doc_id, r.text, r.n_chars, r.rid) for r in got.collect()) == [(1, "oneend", 6, "x"), (2, "twofin", 6, "y"), (3, None, None, "z")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=6), max_size=12), min_size=1, max_size=6))
def test_merge_of_front_coded_runs(runs):
    runs = [sorted(r) for r in runs if r] or [[b""]]
    coded = []
    for r in runs:
        prefix, rest, sizes = S.front_coded(r)
        n = len(r)
        blob = S.common.packed(prefix.astype(np.uint16), sizes.astype(np.uint16), np.arange(n), np.zeros(n, np.uint32), np.zeros(n, np.uint16), np.zeros(n, np.uint16), rest)
        coded.append(S.decoded(blob))
    got = list(S.merged(coded))
    assert [e[1] for e in got] == sorted(x for r in runs for x in r)
    for a, b in zip(got, got[1:], strict=False):
        assert b[0] == S.shared_prefix(a[1], b[1])


def test_windows_of_equal_content_choose_equal_anchors():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, 300).astype(np.uint8) for _ in range(4)]
    raw, lens = np.concatenate(texts), np.array([300] * 4)
    own, h, p, lo, hi = S.anchors(raw, np.cumsum(lens) - lens, lens, 20, 6)
    chosen = {}
    for t, a, first, last in zip(own, p, lo, hi, strict=True):
        for i in range(first, last + 1):
            assert chosen.setdefault(texts[t][i : i + 20].tobytes(), a - i) == a - i
    assert sum(hi - lo + 1) == 4 * 281
