import random

from evidra.operators.sessions import sessions


def brute(rows, gap):
    events = {}
    for k, t, i in rows:
        if k is not None and t is not None:
            events.setdefault(k, set()).add((t, i))
    out = set()
    for k, found in events.items():
        start = last = None
        n = 0
        for t, _ in sorted(found, key=lambda x: x[0]):
            if last is not None and t - last > gap:
                out.add((k, start, last, n))
                start, n = None, 0
            start = t if start is None else start
            last, n = t, n + 1
        out.add((k, start, last, n))
    return out


def run(spark, rows, gap, bucket):
    df = spark.createDataFrame(rows, "k string, t long, id long, b int, first string, n string")
    return {tuple(r) for r in sessions(df, "k", "t", "id", gap, bucket).collect()}


def test_against_brute_force_with_hot_key_and_small_buckets(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"c{rng.randrange(6)}", rng.choice([None, rng.randrange(3000)]) if rng.random() < 0.1 else rng.randrange(3000), rng.randrange(400)) for _ in range(900)]
    rows = [(k if rng.random() > 0.03 else None, t, i, 1, "x", None) for k, t, i in rows] + [(None, 5, 1, None, None, None)]
    rows += rows[:60]
    for gap, bucket in ((10, 20), (3, 50), (10, 80)):
        got = run(spark, rows, gap, bucket)
        assert got == brute([r[:3] for r in rows], gap)
        assert len(got) > 20


def test_gap_is_inclusive_ties_count_and_edges_join(spark):
    rows = [("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("a", 20, 4), ("a", 31, 5), ("b", -25, 1), ("b", -20, 2), ("c", 7, None), ("c", 7, None)]
    rows = [(*r, 0, "", "") for r in rows]
    assert run(spark, rows, 10, 10) == {("a", 0, 20, 4), ("a", 31, 31, 1), ("b", -25, -20, 2), ("c", 7, 7, 1)}


def test_empty_table(spark):
    assert run(spark, [], 10, None) == set()
    assert run(spark, [(None, None, None, None, None, None)], 10, None) == set()


def test_a_dense_key_stays_linear(spark):
    df = spark.range(200_000).selectExpr("'k' as k", "id * 100 as t", "id")
    assert [tuple(r) for r in sessions(df, "k", "t", "id", 10**9).collect()] == [("k", 0, 19_999_900, 200_000)]
