import sys

import public_tokenizers
import pytest

from skein.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", "a \n b", "\n\n x", "x\n", "it's we're I'll 's ' s ''s 's's 'sx \n's don't'd 'r 've", "1 23 a1b2  %% %'s ,'s",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> 's", "<|endoftext", "x" * 300 + " " * 90 + "y" * 70, "é ü ß 漢字 🙂🙂  　 ​ x", "\x1c\x1d \x85\x00a", "'" * 5 + "s",
]


def whole(texts):
    t, _ = T.vocabulary(PATH)
    return [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def split(texts):
    _, special = T.vocabulary(PATH)
    distinct, inverse, first = T.PreTokenizer(special).split(texts)
    return [[distinct[j] for j in inverse[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]


def test_pretokens_join_to_the_text_and_match_the_library():
    got = split(ODD)
    assert ["".join(x) for x in got] == ODD
    t, _ = T.vocabulary(PATH)
    for text, parts in zip(ODD, got, strict=True):
        if "<|" not in text:
            assert [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)] == parts
    assert [sum(T.piece_counts(PATH, x)) for x in got] == whole(ODD)


def test_every_code_point_has_the_librarys_class():
    t, _ = T.vocabulary(PATH)
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    wrong = 0
    for i in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}." for c in points[i : i + 4096])
        got = split([text])[0]
        want = [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]
        wrong += got != want
    assert wrong == 0


def test_counts(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(99, None), (None, "a b"), (3, "a  b"), (7, "the " * 70_000)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, token string, block int")
    got = T.token_counts(df, PATH, limit=10).collect()
    want = whole([b or "" for _, b in rows])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((a, len((b or "").encode()), n, n > 10) for (a, b), n in zip(rows, want, strict=True)), key=key)


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_partitions_of_empty_texts_only(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, T.token_counts(df, PATH).collect())) == [(1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False)]
