import random

from pyspark.sql import functions as F

from corpuscle.operators import history as hs
from corpuscle.operators import ordering as od


def test_running_sums_over_ranges(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", i, rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v long")
    got = od.running_before(df, ["k"], [F.col("i")], F.floor(F.col("i") / 7), {"s": F.col("v"), "n": F.lit(1).cast("long")})
    sums, counts = {}, {}
    want = {}
    for k, i, v in data:
        want[i] = (sums.get(k, 0), counts.get(k, 0))
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
    assert {r.i: (r.s, r.n) for r in got.collect()} == want


def test_top_k_and_first(spark):
    df = spark.createDataFrame([("a", i, -i) for i in range(20)] + [("b", 1, 5)], "k string, i int, s int")
    assert sorted((r.k, r.i, r["rank"]) for r in od.top_k(df, ["k"], [F.desc("s")], 2).collect()) == [("a", 0, 0), ("a", 1, 1), ("b", 1, 0)]
    assert "WindowGroupLimit" in od.top_k(df, ["k"], [F.desc("s")], 2)._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.s) for r in od.first_appearance(df, ["k"], "i").collect()) == [("a", 0), ("b", 5)]


def test_history(spark):
    turns = spark.createDataFrame([("c", t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(30)], "conv_id string, turn int, role string, text string")
    assert sorted(r.turn for r in hs.recent_turns(turns, 2, 2).collect()) == [26, 27, 28, 29]
    assert sorted(r.turn for r in hs.recent_turns(turns).collect()) == list(range(10, 30))  # ten pairs
    got = {r.turn: r.last_text for r in hs.with_last_turn(turns, bucket=5).collect()}
    assert got[0] is None and got[1] is None and all(got[t] == f"t{t - 2}" for t in range(2, 30))
    pairs = spark.createDataFrame([([["q1", "a1"], ["q2", "a2", "x"], [None, "a3"], [None, None]],), (None,)], "h array<array<string>>")
    assert [r[0] for r in pairs.select(hs.trim_history("h", 3, 1)).collect()] == [[["q", "a"], ["a"]], []]
