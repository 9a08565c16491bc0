"""Ordered event sequences within two minutes, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how far apart the two events of a pattern may be, inclusive.
WITHIN_US = 120_000_000


#: Width of the time buckets into which each entity is split, in lengths of the pattern.
BUCKET = 64


def _marked(events: DataFrame, entity: str | None, at_us: str, first: Column, second: Column, within_us: int, forward: bool) -> DataFrame:
    """The rows of either kind, each in its bucket of time and, near an edge, as a neighbour in the next one that can need it."""
    rows = events.where(F.col(at_us).isNotNull()).withColumn("_first", F.coalesce(first, F.lit(False))).withColumn("_second", F.coalesce(second, F.lit(False)))
    width = BUCKET * max(1, within_us)
    own = F.floor(F.col(at_us) / width)
    shift = F.lit(-within_us if forward else within_us)
    buckets = F.array_distinct(F.array(own, F.floor((F.col(at_us) + shift) / width)))
    return rows.where("_first or _second").withColumn("_entity", F.col(entity) if entity else F.lit(0)).withColumn("_own", own).withColumn("_bucket", F.explode(buckets))


def preceded(events: DataFrame, at_us: str, seq: str, first: Column, second: Column, entity: str | None = None, within_us: int = WITHIN_US, consume: bool = True) -> DataFrame:
    """Second events whose last first event lies at most `within_us` before: their columns, and first_seq, first_at.

    A first event is used up by the next second event in order if `consume`. Rows are cut down to the two kinds before
    the window and split by entity and time: only events at most `within_us` apart matter to each other, so a bucket of
    time needs no more than those just before it, and no entity meets in one task. An event without time takes no part.
    """
    order = Window.partitionBy("_entity", "_bucket").orderBy(at_us, seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = _marked(events, entity, at_us, first, second, within_us, False)
    place = F.struct(F.col(at_us).alias("t"), F.col(seq).alias("s"))
    rows = rows.withColumns({"_f": F.last(F.when(F.col("_first"), place), ignorenulls=True).over(order), "_p": F.last(F.when(F.col("_second"), place), ignorenulls=True).over(order)})
    fires = F.col("_second") & F.col("_f").isNotNull() & (F.col(at_us) - F.col("_f.t") <= within_us)
    if consume:
        # an event of both kinds is a first event after it has been looked at as the second
        fresh = F.col("_p").isNull() | (F.col("_f") > F.col("_p")) | (F.col("_f") == F.col("_p"))
        fires &= fresh
    return rows.where(fires & (F.col("_own") == F.col("_bucket"))).select(*events.columns, F.col("_f.s").alias("first_seq"), F.col("_f.t").alias("first_at"))


def followed(events: DataFrame, at_us: str, seq: str, first: Column, second: Column, entity: str | None = None, within_us: int = WITHIN_US) -> DataFrame:
    """First events with the next second event (themselves included) at most `within_us` later: their columns, and second_seq, second_at.

    The frame grows backwards from the end of a bucket, so each row costs the same however many share its bucket.
    """
    order = Window.partitionBy("_entity", "_bucket").orderBy(F.desc(at_us), F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    rows = _marked(events, entity, at_us, first, second, within_us, True)
    place = F.struct(F.col(at_us).alias("t"), F.col(seq).alias("s"))
    rows = rows.withColumn("_n", F.last(F.when(F.col("_second"), place), ignorenulls=True).over(order))
    return rows.where((F.col("_own") == F.col("_bucket")) & F.col("_first") & F.col("_n").isNotNull() & (F.col("_n.t") - F.col(at_us) <= within_us)).select(*events.columns, F.col("_n.s").alias("second_seq"), F.col("_n.t").alias("second_at"))
