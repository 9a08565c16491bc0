import datetime
import random

from pyspark.sql import functions as F

from evidra.operators.sequences import preceded
from evidra.streaming.sequences import counts_stream, preceded_stream, sessions_stream

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "e string, at timestamp, s long, f boolean, g boolean"


def rows(n):
    rng = random.Random(3)
    out, t = [], 0
    for s in range(n):
        t += rng.choice([0, 5, 40, 121])
        out.append((rng.choice("ab"), START + datetime.timedelta(seconds=t), s, rng.random() < 0.4, rng.random() < 0.4))
    return out, t


def run(spark, tmp_path, parts, build, name):
    folder = str(tmp_path / name)
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    made, last = rows(200)
    end = [("z", START + datetime.timedelta(seconds=last + 100_000), 9999, True, False)]
    parts = [made[i : i + 50] for i in range(0, 200, 50)] + [end, end]
    got = run(spark, tmp_path, parts, lambda s: preceded_stream(s, "e", "at", "s", F.col("f"), F.col("g")), "sequences")
    df = spark.createDataFrame(made, SCHEMA).withColumn("us", F.unix_micros("at"))
    want = preceded(df, "us", "s", F.col("f"), F.col("g"), "e")
    assert sorted(tuple(r) for r in got.collect()) == sorted((r["e"], r["s"], r["first_seq"]) for r in want.collect()) and want.count() > 20


def test_windows_and_sessions(spark, tmp_path):
    made, last = rows(60)
    end = [("z", START + datetime.timedelta(seconds=last + 100_000), 9999, True, False)]
    counts = run(spark, tmp_path, [made, end, end], lambda s: counts_stream(s, "at", ["e"]), "counts")
    assert counts.agg(F.sum("n")).first()[0] == 60
    found = run(spark, tmp_path, [made, end, end], lambda s: sessions_stream(s, "at", "e", "1 minute"), "visits")
    assert found.agg(F.sum("n")).first()[0] == 60
