import hashlib
from collections import defaultdict

from skein.llm import chat as C

ODD = ["<|im_end|><|im_start|>assistant ok", "", None, "\\", "<\\|", "<\\\\|", "\\<|", "<", "|x", "<|im_end|>\n", "a\nb\n", "é🙂 <\\n|", "\\\\<|\\|"]
key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def rows():
    out = []
    for c in range(30):
        if c % 3 == 0:
            out.append((c, 0, "system", f"be kind {c}"))
        for t in range(1, 2 + c % 14):
            out.append((c, t, "user" if t % 2 else "assistant", " ".join(["word", "<|x"] * (1 + (c * 7 + t * 5) % 25))))
    out += [(100, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(ODD)]
    out += [(101, 0, "ro\nle<\\n|", "x"), (101, 1, None, "y"), (101, 1, None, "y"), (101, 1, "assistant", "z"), (102, None, "assistant", "w " * 5000), (102, 3, "assistant", "q")]
    out += [(None, 1, "assistant", "n"), (103, 0, "system", "s " * 900), (103, 1, "user", "u"), (103, 2, "assistant", "v " * 300), (103, 3, "user", "u"), (103, 4, "assistant", "v " * 300)]
    return out


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=key)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "f") for r in rows()], "conv_id long, turn long, role string, text string, window int, formatted string")
    found = C.windows(df, budget=200, history_tokens=60).cache()
    got = C.digest(found)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == brute(rows())
    assert {r.conv_id: r.formatted_chars for r in got.collect()} == {
        c: sum(len(r.formatted) for r in found.collect() if r.conv_id == c) for c in {r[0] for r in rows()}
    }
    by = defaultdict(list)
    for r in found.collect():
        assert len(r.turns) == r.formatted.count(C.START) == r.formatted.count(C.END)
        by[r.conv_id].append(r)
    for c, own in by.items():
        own.sort(key=lambda r: r.window)
        system = own[0].formatted.startswith("<|im_start|>system")
        for r in own:
            new = [t.rank for t in r.turns if not t.repeated]
            old = [t.rank for t in r.turns if t.repeated and t.rank >= 0]
            assert new == list(range(new[0], new[-1] + 1)) and old == list(range(new[0] - len(old), new[0])) and len(old) <= C.HISTORY
            assert not system or r.formatted.startswith("<|im_start|>system") and r.formatted.count("<|im_start|>system") == 1
            assert not r.over_budget or len(new) == 1 and c in (102, 103)
        assert [t.rank for r in own for t in r.turns if not t.repeated] == list(range(sum(not t.repeated for r in own for t in r.turns)))
    assert len(by[27]) > 2 and any(t.repeated and t.rank > 0 for r in by[27] for t in r.turns)
    assert C.digest(C.windows(df.limit(0))).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.digest(C.windows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
