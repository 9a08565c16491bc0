"""The sequence patterns and counts over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidra.operators.sequences import WITHIN_US


def preceded_stream(events: DataFrame, entity: str, at: str, seq: str, first: Column, second: Column, within_us: int = WITHIN_US, late: str = "2 minutes") -> DataFrame:
    """`preceded` over a stream: entity, seq and first_seq of each second event at most `within_us` after a first event that no second event came between.

    Events are held until the watermark (`late` behind the latest) has passed them, then taken in order of time and seq, so
    that the result is that of the batch operator; later ones are dropped. The state of an entity is the events held and
    its last first event, forgotten once it is too old to count.
    """
    rows = events.where(F.col(at).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.col(at).cast("timestamp").alias("at"), F.col(seq).cast("long").alias("seq"), F.coalesce(first, F.lit(False)).alias("f"), F.coalesce(second, F.lit(False)).alias("g"))
    rows = rows.where("f or g").withWatermark("at", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, open_first = json.loads(state.get[0]) if state.exists else ([], None)
        for batch in batches:
            us = batch["at"].astype("int64") // (1000 if batch["at"].dtype.name.startswith("datetime64[ns") else 1)
            held += [[int(t), int(s), bool(f), bool(g)] for t, s, f, g in zip(us, batch["seq"], batch["f"], batch["g"])]
        mark = state.getCurrentWatermarkMs() * 1000
        held.sort()
        out = []
        while held and (held[0][0] < mark or (state.hasTimedOut and held[0][0] <= mark)):
            t, s, f, g = held.pop(0)
            if g:
                if open_first and t - open_first[0] <= within_us:
                    out.append((key[0], s, open_first[1]))
                open_first = None
            if f:
                open_first = [t, s]
        if open_first and not held and mark - open_first[0] > within_us:
            open_first = None
        if held or open_first:
            state.update((json.dumps([held, open_first]),))
            soonest = held[0][0] if held else open_first[0] + within_us
            state.setTimeoutTimestamp(max(soonest // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["entity", "seq", "first_seq"])

    return rows.groupBy("entity").applyInPandasWithState(step, "entity string, seq long, first_seq long", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def counts_stream(events: DataFrame, at: str, keys: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by keys and window of time: window_start, window_end, keys, n. Late events beyond `late` are dropped."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    by = F.window("_at", window, slide) if slide else F.window("_at", window)
    return rows.groupBy(by.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions_stream(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream: key, session_start, session_end (the last event), n."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n"), F.min("_at").alias("session_start"), F.max("_at").alias("session_end")).select(key, "session_start", "session_end", "n")
