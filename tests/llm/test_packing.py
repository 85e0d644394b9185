from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from skein.llm import packing as P
from skein.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_rebuild_every_document(spark):
    texts = [(i, "The quick brown fox's 12 jumps.\n\n " * (i % 9) + f"doc {i} <|endoftext|> é漢🙂") for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "word " * 20000), (5, texts[5][1]), (None, "no id")]
    df = spark.createDataFrame([(a, b, "x") for a, b in texts], "doc_id long, text string, ids string").repartition(5)
    rows = P.packed(df, PATH, capacity=64, open_windows=4).collect()
    t, _ = T.vocabulary(PATH)
    want = sorted(tuple([*t.encode(b or "", add_special_tokens=False).ids, 0]) for _, b in texts)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert len({(r.doc_id, r.start) for r in rows if r.doc_id != 5}) == len([r for r in rows if r.doc_id != 5])
    got = []
    for doc, own in docs.items():
        if doc == 5:
            continue
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == own[0].doc_tokens
        got.append(tuple(np.frombuffer(b"".join(r.ids for r in own), np.uint32).tolist()))
    assert sorted(got + [x for x in want if x == tuple([*t.encode(texts[5][1], add_special_tokens=False).ids, 0])]) == want
    assert sum(r.length for r in docs[5]) == 2 * docs[5][0].doc_tokens
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        total = sum(r.length for r in own)
        assert total <= 64 and total & (total - 1) == 0
    assert P.digest(P.packed(df.limit(0), PATH)).collect() == []
    assert P.digest(P.packed(df.filter("doc_id = 1001"), PATH)).select("length", F.col("ids_crc32")).first() == (1, 0x2144DF1C)
