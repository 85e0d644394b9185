"""What a replay is spared: work that nothing asks for, with the same results."""

import random

from skein.operators import trail
from skein.streaming.gate import Detector
from skein.streaming.signals import RISING, Semantic, step


def test_links_are_checked_without_the_bodies(spark):
    """An entry's own hash is checked before its gate's entries are put in order, so that bodies are not dealt out again."""
    chain = trail.build(spark.createDataFrame([("g", i, f"body {i}") for i in range(5)], "gate_id string, seq long, body string"))
    checked = trail.validate(spark.createDataFrame(chain.collect(), chain.schema))
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(gate_id") < plan.index("sha2(")
    assert [tuple(r) for r in checked.collect()] == [("g", True, -1)]


def test_a_team_is_named_where_it_forms_only():
    d, asked = Detector(600.0, 2), []
    for i, (s, r) in enumerate([*("ab", "ba"), *("ab", "ba") * 20, "cd", "dc"]):
        d.edge(s, r, 1000.0 + i, lambda i=i: asked.append(i) or f"t{i}")
    assert asked == [1, 43] and list(d.teams) == ["t1", "t43"]


def test_the_trend_falls_on_the_side_of_its_steps_where_it_fell():
    rnd, s, sides = random.Random(9), Semantic(), set()
    for _ in range(3000):
        n, slope = rnd.randrange(3, 11), rnd.choice([0.05, 0.1]) + rnd.choice([0.0, 1e-17, 1e-15, -1e-15, 1e-8, -1e-8])
        s.history.clear()
        s.history.extend(0.1 + slope * i for i in range(n))
        ys, mx = list(s.history), (n - 1) / 2
        my = sum(ys) / n
        plain = sum([(i - mx) * (y - my) for i, y in enumerate(ys)]) / sum([(i - mx) ** 2 for i in range(n)])
        assert step(s.trend(), *RISING) == step(plain, *RISING)
        sides.add(step(plain, *RISING))
    assert sides == {0.0, 0.1, 0.2}
