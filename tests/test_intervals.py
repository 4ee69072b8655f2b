"""Points and ranges against every pair."""

import random

from storylake.operators import intervals


def test_within_equals_every_pair(spark):
    rnd = random.Random(3)
    points = [(rnd.choice("ab"), rnd.randrange(-400, 5_000), i) for i in range(300)] + [("a", None, 300), (None, 5, 301), ("c", 1, 302)]
    ranges = []
    for i in range(150):
        low = rnd.randrange(-400, 5_000)
        ranges.append((rnd.choice("ab"), low, low + rnd.choice([-1, 0, 1, 15, 16, 17, 100, 5_000, 10**6, 2**40]), i))
    ranges += [("a", None, 5, 150), ("a", 5, None, 151), (None, 0, 9, 152), ("d", 0, 9, 153)]
    found = intervals.within(spark.createDataFrame(points, "k string, x long, p int"), spark.createDataFrame(ranges, "k string, lo long, hi long, r int"), ["k"], "x", "lo", "hi")
    want = sorted((p[2], r[3]) for p in points for r in ranges if None not in (*p, *r) and p[0] == r[0] and r[1] <= p[1] <= r[2])
    assert sorted((f.p, f.r) for f in found.collect()) == want and found.columns == ["k", "x", "p", "lo", "hi", "r"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_ranges(spark):
    points = spark.createDataFrame([("a", 1)], "k string, x long")
    assert intervals.within(points, spark.createDataFrame([], "k string, lo long, hi long"), ["k"], "x", "lo", "hi").count() == 0
