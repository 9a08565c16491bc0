import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidra.llm.runs import agglomerate, event_reading, event_runs, similarity, timeline_runs
from evidra.llm.tokens import VOCABULARY, decode_corpus, encode_corpus, read_ranks, words_of


def brute(rows, gap=None):
    seen, out, last = set(), [], None
    for e, t, i, x in sorted((r for r in rows if None not in r[:3]), key=lambda r: r[:3]):
        if (e, t, i) in seen:
            continue
        seen.add((e, t, i))
        x = x or ""
        if last and last[0] == e and last[2] == x and (gap is None or t - last[1] <= gap):
            out[-1][2] += 1
        else:
            out.append([e, i, 1])
        last = (e, t, x)
    return sorted(map(tuple, out))


def test_runs_like_brute_force_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(500), rng.randrange(900), rng.choice(["x", "y", None, "x"])) for _ in range(1500)]
    rows += [(None, 1, 1, "x"), ("a", None, 1, "x"), ("a", 1, None, "x"), *rows[:40]]
    by_key = {}
    for r in rows:
        by_key.setdefault(r[:3], r)
    rows = [*by_key.values()] * 2
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "host string, t long, id long, text string, at int, entity string")
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        for gap in (None, 1):
            got = event_runs(df, "host", "t", "id", "text", gap=gap).collect()
            assert sorted((r["entity"], r["first_event_id"], r["n_events"]) for r in got) == brute(rows, gap)
    finally:
        for k, v in zip(("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"), old):
            spark.conf.set(k, v)
    one = spark.createDataFrame([("h", i, i, "same") for i in range(300)], "host string, t long, id long, text string").repartition(7)
    assert [tuple(r)[:3] for r in event_runs(one, "host", "t", "id", "text").collect()] == [("h", 0, 300)]
    assert event_runs(df.limit(0), "host", "t", "id", "text").collect() == []


def test_near_identical_neighbours_merge(spark):
    run = lambda i, x: ["e", i, 1, i, i, x, x]
    out = agglomerate([run(0, "a b c d"), run(1, "a b c e"), run(2, "q"), run(3, "q"), run(9, "q")], 0.5, 2)
    assert [(r[1], r[2]) for r in out] == [(0, 2), (2, 2), (9, 1)]
    assert similarity("", "") == 1 and similarity("a", "b") == 0 and 0.3 < similarity("a b", "b c") < 0.34


def test_readings(spark):
    same = [("Run: A.exe [pid=3]", "run:  a.EXE [PID=44]"), ("~WRL0001.tmp", "~WRL9999.tmp"), ("~DFA563.tmp", "~DF0E3F.TMP "), ("x, session 12", "x, session 9f8e7d6c5b4a"), ("t {A805F31E-002B-B0C4-5275-4F093FA6AF92}", "t {a805f31e-002b-b0c4-5275-4f093fa6af93}"), ("p - process 1, thread 2", "p - process 3, thread 44"), ("h handle 0x2c", "h handle 0xffa"), (None, ""), ("a, attempt 3", "a, attempt 4")]
    other = [("Evtx: ID 4624", "Evtx: ID 4625"), ("Ticket 1", "Ticket 2"), ("x_v1.docx", "x_v2.docx"), ("GET /a (200)", "GET /a (404)"), ("a", "b")]
    df = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, same boolean")
    assert df.where((event_reading(F.lit("S "), F.col("a")) == event_reading(F.lit("s"), F.col("b"))) != F.col("same")).collect() == []


def test_undated_and_hostless_events(spark):
    rows = [(1, "2026-01-05", "10:00:00", "H", "x"), (2, "2026/01/05", "10:00:00.5", " h ", "X"), (3, None, None, "H", "x"), (4, "1970-01-01", "00:00:00", "H", "x"), (5, "2026-01-05", "11:00:00", "-", "x"), (6, "2026-01-05", "11:00:00", None, "x"), (7, "05.01.2026", "09:00:00.0000001", "H", "y")]
    df = spark.createDataFrame(rows, "event_id long, date string, time string, host string, short string").withColumn("sourcetype", F.lit("S"))
    assert sorted((r["first_event_id"], r["n_events"]) for r in timeline_runs(df).collect()) == [(1, 2), (7, 1)]


TEXTS = ["", None, " ", "Hello world's  end\n\n  x", "'ll 're 123abc...\t", "ünï ñ 診断メモ 🙂🙂  　 x", "<|endoftext|> a", "word " * 20_000, "=" * 3000, "a​b é", "\x01\x1c\x85 y", "don't DON'T '"]


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")
def test_ids_like_the_tokenizer_itself_on_both_paths(spark):
    import tiktoken

    from evidra.llm.tokens import WORDS

    coder = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=read_ranks(), special_tokens={})
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "null id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, ids int")
    want = sorted((str(i), coder.encode_ordinary(t or "")) for i, t, _, _ in rows)
    for most in (1_000_000, 5, 0):
        got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encode_corpus(df, "doc_id", "text", most_words=most).collect())
        assert got == want, most
    assert encode_corpus(df.limit(0), "doc_id", "text").collect() == []


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")
def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = decode_corpus(encode_corpus(df, "doc_id", "text"), "doc_id", "ids")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert df.where(F.array_join(words_of(F.col("text")), "") != F.col("text")).count() == 0


def naive(rows, least, gap):
    """Of one entity: look at all neighbours, merge the most similar, and again."""
    runs = [(i, 1, t, t, x, x, {*x.split()}) for t, i, x in sorted(rows)]

    def like(a, b):
        one = lambda x, y: 1.0 if x == y else len(x & y) / len(x | y) * 0.999999 if x or y else 0.0
        ends = 1.0 if a[5] == b[4] else one(frozenset(a[5].split()), frozenset(b[4].split())) * (1 if {*a[5].split()} != {*b[4].split()} else 0.999999)
        return min(ends, one(a[6], b[6])) if b[2] - a[3] <= gap else -1

    while len(runs) > 1:
        best, j = max((like(runs[j - 1], runs[j]), -j) for j in range(1, len(runs)))
        if best < least:
            break
        a, b = runs[-j - 1], runs[-j]
        runs[-j - 1 : -j + 1] = [(a[0], a[1] + b[1], a[2], b[3], a[4], b[5], a[6] & b[6])]
    return [(r[0], r[1]) for r in runs]


def test_near_runs_do_not_depend_on_where_tasks_and_batches_end(spark):
    rng = random.Random(5)
    rows, text = [], ["a", "b", "c", "d", "e"]
    for i in range(700):
        if rng.random() < 0.5:
            text = [*text]
            text[rng.randrange(5)] = rng.choice("abcdefgh")
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("xy"), i * 2 + rng.choice([0, 0, 0, 9]), i, " ".join(text)))
    want = sorted((e, *r) for e in {r[0] for r in rows} for r in naive([x[1:] for x in rows if x[0] == e], 0.6, 12))
    df = spark.createDataFrame(rows, "host string, t long, id long, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for batch, parts in ((10_000, 1), (13, 9), (5, 40)):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = event_runs(df, "host", "t", "id", "text", least=0.6, gap=12).collect()
            assert sorted((r["entity"], r["first_event_id"], r["n_events"]) for r in got) == want, (batch, parts)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_similarity_is_computed_again_after_a_merge():
    run = lambda i, x: ["e", i, 1, i, i, x, x]
    drift = [run(0, "a b c d"), run(1, "b c d e"), run(2, "c d e f"), run(3, "d e f g")]
    # all neighbours are alike, but once two have merged, what they have in common is less like the next
    assert [(r[1], r[2]) for r in agglomerate(drift, 0.55, None)] == [(0, 2), (2, 2)]
    # the most similar pair goes first, wherever it stands
    order = [run(0, "a b c x"), run(1, "a b c y"), run(2, "a b c y z")]
    assert [(r[1], r[2]) for r in agglomerate(order, 0.6, None)] == [(0, 1), (1, 2)]
