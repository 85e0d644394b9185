import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\x85\xa0é漢🙂#% ", max_size=80))
def test_measures(text):
    assert Q.measures(text.encode()) == brute(text)


def test_verdicts(spark):
    clean = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi word{}"
    rows = [(i, clean.format(i), "en", "s1") for i in range(80)]
    rows += [(100, clean.format(1).replace(" ", "%%% "), "en", "s1"), (101, None, "en", "s1"), (102, "", None, None), (103, "a b c d e " * 9, "en", "s1")]
    rows += [(104, clean.format(104), None, None), (104, clean.format(104), None, None), (None, clean.format(5), "en", "rare")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    got = {r.doc_id: r for r in Q.report(df).collect()}
    assert Q.report(df).count() == len(rows)
    assert all(got[i].kept and not got[i].base_failed for i in [*range(80), 104, None])
    assert not got[100].base_failed and not got[100].kept
    assert all(got[i].base_failed and not got[i].kept for i in (101, 102, 103))
    assert Q.report(df.limit(0)).collect() == []


def test_merged_sketches_give_quantiles_within_the_accuracy(spark):
    rows = [(i, i, 0, i % 7, 1) for i in range(1, 2001)]
    df = spark.createDataFrame([(1, r[0], 0, 1, 0, 0, "x", "y") for r in rows], "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, lang string, source string")
    a, b = Q.sketches(df.filter("word_chars % 3 = 0"), ["lang"]), Q.sketches(df.filter("word_chars % 3 != 0"), ["lang"])
    r = Q.quantiles(a.unionByName(b), ["lang"], {"m": 0.5, "u": 0.75}).filter("measure = 'word_length'").first()
    assert abs(r.m - 1000) <= 0.02 * 1000 + 1 and abs(r.u - 1500) <= 0.02 * 1500 + 1


def test_fences_follow_their_source(spark):
    """Two sources of one language with other habits: each is judged by its own fence, and ties at a fence stay."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi number{}"
    code = "if a{} & b then c & d else e & f or g & h and i | j or k | l plus m * n"
    odd = "overlongwordswithoutanyspaces" * 2
    rows = [(i, text.format(i) + " tail" * (i % 4 == 0), "en", "prose") for i in range(100)] + [(200 + i, code.format(i), "en", "code") for i in range(100)]
    rows += [(500, code.format(7), "en", "prose"), (501, " ".join(f"{odd}{i}" for i in range(12)), "en", "prose"), (502, None, None, "prose"), (503, text.format(1) * 20_000, "en", "prose")]
    df = spark.createDataFrame([(*r, "r") for r in rows], "doc_id long, text string, lang string, source string, rid string")
    fences = {r.source: r for r in Q.thresholds(Q.measured(df.filter("lang = 'en'"))).collect()}
    assert fences["code"].max_word_length != fences["prose"].max_word_length
    got = {r.doc_id: r.kept for r in Q.report(df).collect()}
    assert all(got[i] for i in range(100)) and all(got[200 + i] for i in range(100)) and not got[501] and not got[502] and not got[503]
    kept = Q.filtered(df)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}
    assert Q.filtered(df.limit(0)).collect() == []


def test_no_fixed_threshold_decides(spark):
    """On the small tables the sketches set every fence, and labelled clean documents stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.judged(docs).join(labels, "doc_id").filter("not base_failed").select("quality", "kept", "max_word_length").collect()
    assert len({r.max_word_length for r in rows}) >= 4  # its sources are rare here: a fence for each language
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.2
