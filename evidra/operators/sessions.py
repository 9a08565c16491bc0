"""Sessions of activity by start-end pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import materialize

GAP_US = 30 * 60 * 1_000_000


def sessions(df: DataFrame, key: str, time_us: str, event_id: str, gap_us: int = GAP_US, bucket_us: int | None = None) -> DataFrame:
    """Sessions of each `key`: one ends when the next event comes more than `gap_us` later.

    Method: every key is split into buckets of time no wider than the gap (`bucket_us`, at most and by default `gap_us`),
    so that the events of a bucket lie in one session and only its first and last can start or end one. Events are
    distinct by an exchange on all that tells them apart, and buckets are counted on the map side before the second
    exchange, so that no key and no bucket, however hot, meets in one task. RANGE frames over the buckets of a key, all
    growing and none sliding, find the firsts without a predecessor (starts) and the lasts without a successor (ends)
    within the gap; both are numbered separately, equal numbers are joined, and the running counts of events before the
    start and up to the end give the number between. What is gathered per key is one row per bucket, bounded by the span
    of time.

    Result: `key`, start_us, end_us, n_events. Rows with a null key or time are in no session. Events are distinct
    by (key, time, event_id), a null id counting as one event per moment; events of one moment belong to one session.
    An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    width = max(1, min(bucket_us or gap_us, gap_us))
    events = df.select(F.col(key).alias("k"), F.col(time_us).cast("long").alias("t"), F.col(event_id).alias("id"))
    events = events.where("k is not null and t is not null").repartition("k", "t", "id").dropDuplicates(["k", "t", "id"])
    buckets = events.groupBy("k", F.floor(F.col("t") / width).alias("b")).agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))

    earlier = Window.partitionBy("k").orderBy("low").rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("k").orderBy(F.desc("high")).rangeBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("k").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.max("high").over(earlier), F.min("low").over(later)
    bounds = buckets.select(
        "k", "low", "high", "n", F.sum("n").over(so_far).alias("upto"),
        (before.isNull() | (F.col("low") - before > gap_us)).alias("first"),
        (after.isNull() | (after - F.col("high") > gap_us)).alias("last"),
    ).where("first or last")
    bounds = materialize(bounds, "session-bounds")

    number = F.row_number().over(Window.partitionBy("k").orderBy("low")).alias("i")
    starts = bounds.where("first").select("k", number, F.col("low").alias("start_us"), (F.col("upto") - F.col("n")).alias("rank_before"))
    ends = bounds.where("last").select("k", number, F.col("high").alias("end_us"), F.col("upto").alias("rank_upto"))
    return starts.join(ends, ["k", "i"]).select(F.col("k").alias(key), "start_us", "end_us", (F.col("rank_upto") - F.col("rank_before")).alias("n_events"))
