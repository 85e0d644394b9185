"""Every pipeline stage on empty tables, repeated rows, nulls in any column, very long texts, and extra columns with clashing names."""

import random

import pytest

import corpus_pipeline

BASE = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("rid", "covered", "marks", "n_links", "class_id", "score", "lang_pred", "digest", "bands", "grams", "at", "item", "items", "spans", "kept", "bucket", "blob")
WORDS = "the and of to in that was with for is hill house water over under light".split()


def prose(k, n=60):
    return " ".join(random.Random(k).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows():
    out = [(i, prose(i), "en", "s", 1) for i in range(30)]
    out += [(3, prose(3), "en", "s", 1)] * 2  # repeated rows
    out += [(None, prose(40), None, None, None), (None, prose(41), "en", None, None), (50, None, None, None, None), (51, "", "en", "s", 0)]
    out += [(60, " ".join(prose(1000 + k) for k in range(400)), "en", "s", 1), (61, prose(500) + " one two three four five six seven eight nine ten", "en", "s", 1)]
    return out


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, folder, name, stage):
    schema = BASE + "".join(f", {c} string" for c in EXTRA)
    docs = spark.createDataFrame([(*r, *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(rows())], schema).repartition(3)
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    found = got.collect()
    by = {int(r.rid[3:]): r for r in found}  # the first extra column counts the rows
    assert len(by) == len(found) and all(r[c] == f"{c}{i}" for i, r in by.items() for c in EXTRA)
    n, ids = len(rows()), {i: r[0] for i, r in enumerate(rows())}
    gone = {ids[i] for i in range(n) if i not in by}
    if name == "language ID":
        assert gone == {50, 51}
    elif name == "n-gram Jaccard join":
        assert gone == {3} and sum(ids[i] == 3 for i in by) == 1
    elif name == "suffix-array dedup":
        assert not gone and by[0].text == rows()[0][1] and by[3].text == "" == by[30].text  # all of a repeated row is a repeat
        assert all(by[i].text is None for i in by if rows()[i][1] is None)
    else:
        assert gone == {61}
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.collect() == []


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], BASE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from skein.llm import common

    session = lambda master, found: Fake(conf=Fake(get=lambda key, default: found), sparkContext=Fake(master=master))
    assert common.shared_dir(session("spark://a:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(session(master, None))
    assert common.shared_dir(session("local[4]", None)).startswith("file:///")
