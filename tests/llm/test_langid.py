import math

import numpy as np
import public_tokenizers
import pytest

from skein.llm import langid as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(w):
    if not w:
        yield []
    for k in range(1, len(w) + 1):
        for rest in segmentations(w[k:]):
            yield [w[:k], *rest]


def by_hand(pieces, prob, w):
    index = {x: i for i, x in enumerate(pieces.names, 1)}
    total, uses = 0.0, {}
    for s in segmentations("▁" + w):
        if all(x in index or len(x) == 1 for x in s):
            p = math.prod(prob[index[x]] if x in index else L.UNKNOWN for x in s)
            total += p
            for x in s:
                uses[x] = uses.get(x, 0) + p
    return total, uses


def test_forward_and_expectation_sum_all_segmentations():
    pieces = L.Pieces(["▁", "▁a", "a", "b", "ab", "bab", "▁ab", "c", "aa"])
    rng = np.random.default_rng(0)
    prob = np.concatenate(([[0, 0]], rng.random((len(pieces.names), 2))))
    some = ["abab", "c", "xabq", "aaaa", "é", "babab"]
    got = L.log_probs(pieces, prob, some)
    for w, row in zip(some, got, strict=True):
        for k in range(2):
            assert math.isclose(math.exp(row[k]), by_hand(pieces, prob[:, k], w)[0], rel_tol=1e-9)
    uses = L.expected(pieces, prob[:, 0], some, np.arange(1.0, 7.0))
    for i, name in enumerate(pieces.names, 1):
        want = sum(n * by_hand(pieces, prob[:, 0], w)[1].get(name, 0) / by_hand(pieces, prob[:, 0], w)[0] for n, w in enumerate(some, 1))
        assert math.isclose(uses[i], want, rel_tol=1e-9, abs_tol=1e-12)
    long = "ab" * 30
    index = {x: i for i, x in enumerate(pieces.names, 1)}
    short = "ab" * 15
    assert np.allclose(L._long(index, prob, "▁" + short, pieces.longest), L.log_probs(pieces, prob, [short])[0])
    assert np.isfinite(L.log_probs(pieces, prob, [long, "q" * 5000])).all()


def test_every_piece_is_found():
    pieces = L.Pieces(L.vocabulary(PATH))
    assert pieces.longest > 8 and pieces.names == sorted({x for x in L.vocabulary(PATH) if x == x.lower()})
    for name in pieces.names[::97]:
        codes = np.array([[ord(c) for c in name]], np.uint64)
        who, found = pieces.lattice(codes)[0][len(name) - 1]
        assert pieces.names[int(found[0]) - 1] == name


def test_long_pieces_take_part():
    pieces = L.Pieces(["▁", "i", "n", "f", "o", "r", "m", "a", "t", "▁information"])
    prob = np.concatenate(([0], np.full(len(pieces.names), 0.01)))
    total = by_hand(pieces, prob, "information")[0]
    assert math.isclose(math.exp(L.log_probs(pieces, prob[:, None], ["information"])[0, 0]), total, rel_tol=1e-9) and total > 0.0099


@pytest.fixture(scope="module")
def rows():
    texts = {"en": "the house is on the hill and we went there with them", "de": "das haus ist auf dem berg und wir gingen mit ihnen dorthin", "fr": "la maison est sur la colline et nous sommes avec eux"}
    out = []
    for i in range(240):
        lang = list(texts)[i % 3]
        w = texts[lang].split()
        out.append((i, " ".join(w[(i * 7 + j * 3) % len(w)] for j in range(8)), lang))
    return out


def test_predictions(spark, rows):
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 ²³ %%", "fr"), (1003, "the house", None), (None, "das haus und der berg", "de"), (5, rows[5][1], "en"), (1004, "the " * 30000, "en"), (1005, "漢" * 300, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id long, text string, lang string, held_out int, score string")
    got = L.identified(df, PATH).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "en" and by[None].lang_pred == "de" and by[1004].lang_pred == "en"
    assert all(by[i].lang_pred == lang for i, _, lang in rows if by[i].held_out) and 30 < sum(r.held_out for r in got) < 90
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.accepted(df, PATH)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
    assert L.identified(df.limit(0), PATH).collect() == []
    assert {r.lang_pred for r in L.identified(df.withColumn("lang", df.lang.substr(9, 9)).filter("lang != ''"), PATH).collect()} == set()


def test_expectation_counts_long_words(monkeypatch):
    pieces = L.Pieces(["▁", "▁a", "a", "b", "ab", "bab", "▁ab", "c", "aa"])
    prob = np.concatenate(([0], np.random.default_rng(1).random(len(pieces.names))))
    some, times = ["abab", "ab", "xabqc", "babab", "c"], np.arange(1.0, 6.0)
    want = L.expected(pieces, prob, some, times)
    monkeypatch.setattr(L, "BATCHED_WORD", 2)
    assert np.allclose(L.expected(pieces, prob, some, times), want, rtol=1e-9)
    got = L.expected(pieces, prob, ["ab" * 150], np.array([3.0]))
    assert math.isclose(sum(n * len(x) for n, x in zip(got[1:], pieces.names, strict=True)), 3 * 301, rel_tol=1e-9)


def test_short_words_do_not_underflow():
    pieces = L.Pieces(["▁", "漢", "字", "漢字"])
    prob = np.array([0, 1e-10, 1e-11, 1e-10, 1e-30])
    for n in (7, 8, 9, 15, 16, 17, L.BATCHED_WORD):
        w = ("漢字" * n)[:n]
        long = L._long({x: i for i, x in enumerate(pieces.names, 1)}, prob[:, None], "▁" + w, pieces.longest)
        assert np.allclose(L.log_probs(pieces, prob[:, None], [w])[0], long, rtol=1e-12)
        got = L.expected(pieces, prob, [w], np.array([2.0]))
        assert math.isclose(sum(k * len(x) for k, x in zip(got[1:], pieces.names, strict=True)), 2 * (n + 1), rel_tol=1e-9)
