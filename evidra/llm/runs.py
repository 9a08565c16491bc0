"""Runs of repeated consecutive events, by adjacent agglomeration."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import bare, let, squeeze
from evidra.functions.times import day_number, nanos_of_day
from evidra.session import materialize

_RUNS = "part int, seq long, island int, entity string, first_event_id long, n_events long, first_at long, last_at long, reads string, edge boolean"
_MERGED = "entity string, first_event_id long, n_events long, first_at long, last_at long"
NANOS_A_DAY = 86_400_000_000_000


def similarity(a: str, b: str) -> float:
    """Share of the words that two descriptions have in common, 1 if they are equal."""
    return 1.0 if a == b else _shared(frozenset(a.split()), frozenset(b.split()))


def _shared(x: frozenset, y: frozenset) -> float:
    return len(x & y) / len(x | y) * 0.999999 if x or y else 0.0


def touch(a: list, b: list, least: float, gap: int | None) -> bool:
    """Whether the last event of a run and the first of the next are of one entity, near enough and alike: no two runs that don't touch ever merge, so whatever lies between two such places can be looked at by itself."""
    return a[0] == b[0] and (gap is None or b[3] - a[4] <= gap) and (a[6] == b[5] or (least < 1 and similarity(a[6], b[5]) >= least))


def agglomerate(runs: list[list], least: float, gap: int | None) -> list[list]:
    """Merge the most similar neighbouring runs until no two neighbours meet both limits.

    A run is [entity, first_event_id, n_events, first_at, last_at, left, right]: its first and last moments, and how its
    first and last events read. Runs are a linked list; a priority queue holds the pairs of neighbours that touch (see
    `touch`), the most similar first, of equals the first in order. Two runs are as similar as the words that all events of
    the one have in common and those of the other; a merged run has in common only what both had, so that it is
    compared with its neighbours anew, and a slow drift from one text to another doesn't become one run.
    """
    n = len(runs)
    runs = runs[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    common: list = [frozenset(r[5].split()) if least < 1 else r[5] for r in runs]
    queue: list[tuple] = []

    def offer(i: int, j: int) -> None:
        if touch(runs[i], runs[j], least, gap):
            like = 1.0 if common[i] == common[j] else _shared(common[i], common[j]) if least < 1 else 0.0
            if runs[i][6] != runs[j][5]:
                like = min(like, similarity(runs[i][6], runs[j][5]))
            if like >= least:
                queue.append((-like, j, len(queue), common[i], common[j]))

    for j in range(1, n):
        offer(j - 1, j)
    heapq.heapify(queue)
    gone = bytearray(n)
    while queue:
        _, j, _, x, y = heapq.heappop(queue)
        i = before[j]
        if gone[j] or common[i] != x or common[j] != y:
            continue  # one of the two has changed since, and the pair was offered anew
        a, b = runs[i], runs[j]
        runs[i] = [a[0], a[1], a[2] + b[2], a[3], b[4], a[5], b[6]]
        both = common[i] & common[j] if least < 1 else common[i]
        changed = both != common[i] or both != common[j]
        common[i] = both
        gone[j] = 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        if changed:
            held, queue = queue, []
            if before[i] >= 0:
                offer(before[i], i)
            if k < n:
                offer(i, k)
            for pair in queue:
                heapq.heappush(held, (pair[0], pair[1], len(held) + n, *pair[3:]))
            queue = held
    return [r for r, g in zip(runs, gone) if not g]


def event_runs(events: DataFrame, entity: str, at: str, event_id: str, reads: str | Column, least: float = 1.0, gap: int | None = None, using: tuple[str, ...] = ()) -> DataFrame:
    """Each run of like events of an entity as one row: entity, first_event_id, n_events, first_at, last_at.

    Events are range-partitioned and sorted by (entity, at, event_id), so a hot entity spreads over as many tasks as
    its rows need. Each task agglomerates its stretch batch by batch, by linked list and priority queue, carrying along what
    may still grow: the runs since the last two neighbours that don't touch, equal ones merged. Only the first and the last
    such stretch of a task can go on in another; these are put together by the same limits afterwards. With
    `least` 1 each is a single run; with a lower one it has a run for each change of text between two pauses or breaks.
    Neighbours are merged if their texts `reads` (a column, or an expression of the columns `using`, computed after the
    exchange and so only once) are at least `least` alike (1: equal) and at most `gap` apart.

    Rows with a null entity, time or id are in no run; a null text reads as empty; rows repeated with the same entity,
    time and id count once; of equal times the lesser id is first. An empty table gives no rows; other columns are ignored.
    """
    carried = (reads,) if isinstance(reads, str) else using
    rows = events.select(F.col(entity).alias("_entity"), F.col(at).cast("long").alias("_at"), F.col(event_id).cast("long").alias("_id"), *carried)
    # written first: the ranges are chosen by a look at the rows, which would compute them twice
    rows = materialize(rows.where("_entity is not null and _at is not null and _id is not null"), "dated-events")
    rows = rows.repartitionByRange("_entity", "_at", "_id").sortWithinPartitions("_entity", "_at", "_id")
    text = F.coalesce(F.col(reads) if isinstance(reads, str) else reads, F.lit(""))
    rows = rows.select(F.col("_entity").alias("entity"), F.col("_at").alias("at"), F.col("_id").alias("id"), text.alias("reads"))

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, first_is_out = TaskContext.get().partitionId(), 0, False
        held: list[list] = []
        last = (None, None, None)

        def show(runs: list[list], island: int, edge: bool) -> pd.DataFrame:
            nonlocal seq
            out = [(part, seq + i, island, r[0], r[1], r[2], r[3], r[4], r[5], edge) for i, r in enumerate(runs)]
            seq += len(out)
            return pd.DataFrame(out, columns=["part", "seq", "island", "entity", "first_event_id", "n_events", "first_at", "last_at", "reads", "edge"])

        for batch in batches:
            runs = held
            for e, t, i, x in zip(batch["entity"].tolist(), batch["at"].tolist(), batch["id"].tolist(), batch["reads"].tolist()):
                if (e, t, i) != last:
                    runs.append([e, i, 1, t, t, x, x])
                    last = (e, t, i)
            if not first_is_out:
                cut = next((j for j in range(1, len(runs)) if not touch(runs[j - 1], runs[j], least, gap)), None)
                if cut is None:
                    held = agglomerate(runs, 1.0, gap)
                    continue
                yield show(agglomerate(runs[:cut], 1.0, gap), 0, True)
                runs, first_is_out = runs[cut:], True
            cut = next((j for j in range(len(runs) - 1, 0, -1) if not touch(runs[j - 1], runs[j], least, gap)), 0)
            if cut:
                yield show(agglomerate(runs[:cut], least, gap), 1, False)
            held = agglomerate(runs[cut:], 1.0, gap)
        if held:
            yield show(held, 2 if first_is_out else 0, True)

    runs = materialize(rows.mapInPandas(collapse, _RUNS), "event-runs")
    order = Window.partitionBy("entity").orderBy("part", "seq")
    like = F.udf(lambda a, b: a is not None and b is not None and similarity(a, b) >= least, "boolean") if least < 1 else (lambda a, b: a == b)
    edges = runs.where("edge").withColumns({x: F.lag(y).over(order) for x, y in (("p", "part"), ("s", "island"), ("r", "reads"), ("t", "last_at"))})
    joined = like(F.col("r"), F.col("reads"))
    if gap is not None:
        joined &= F.col("first_at") - F.col("t") <= gap
    joined = ((F.col("p") == F.col("part")) & (F.col("s") == F.col("island"))) | ((F.col("p") != F.col("part")) & joined)
    edges = edges.withColumn("stretch", F.sum(F.when(joined, 0).otherwise(1)).over(order))
    columns = ["entity", "first_event_id", "n_events", "first_at", "last_at"]
    if least < 1:

        def finish(some: pd.DataFrame) -> pd.DataFrame:
            some = some.sort_values(["part", "seq"])
            whole = [[r.entity, r.first_event_id, r.n_events, r.first_at, r.last_at, r.reads, r.reads] for r in some.itertuples()]
            return pd.DataFrame([r[:5] for r in agglomerate(whole, least, gap)], columns=columns)

        stitched = edges.select("part", "seq", "reads", "stretch", *columns).groupBy("entity", "stretch").applyInPandas(finish, _MERGED)
    else:
        stitched = edges.groupBy("entity", "stretch").agg(
            F.min_by("first_event_id", F.struct("part", "seq")).alias("first_event_id"), F.sum("n_events").alias("n_events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
        )
    return runs.where("not edge").select(*columns).unionByName(stitched.select(*columns))


def masked(sign: str, pattern: str, to: str) -> Callable[[Column], Column]:
    """Replaces a pattern in texts that show a sign of it."""
    return lambda t: F.when(t.rlike(sign), F.regexp_replace(t, pattern, to)).otherwise(t)


def event_reading(sourcetype: Column, short: Column) -> Column:
    """How an event reads: type and description without letter case, blanks and numbers that only tell instances apart."""
    number = r"(?:0x[0-9a-f]+|[0-9a-f]*\d[0-9a-f]*|[0-9a-f]{12})\b"
    text = squeeze(F.coalesce(short, F.lit("")))
    # each pattern is tried only where a cheaper look finds what it needs
    for sign, pattern, to in (
        (r"-[0-9a-f]{12}", r"\{?\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b\}?", "#"),
        (r"pid|tid|process|thread|handle|session|attempt", rf"\b(pid|tid|process|thread|handle|session|attempt)( ?id| ?no\.?| ?number)?([ =:#]*){number}", "$1 #"),
        (r"\.tmp", r"(~[a-z]*?|\btmp)[0-9a-f]{4}(?=\.tmp\b)", "$1#"),
        (r"\.tmp", r"\d+(?=\.tmp\b)", "#"),
    ):
        text = let(text, masked(sign, pattern, to))
    return F.concat_ws("\x1f", squeeze(F.coalesce(sourcetype, F.lit(""))), text)


def timeline_runs(timeline: DataFrame, least: float = 1.0, gap: int | None = None) -> DataFrame:
    """The runs of the supertimeline (of events at least so alike and at most so many nanoseconds apart), per host without letter case and outer blanks; undated events (null or 1970-01-01) and events without host are in none."""
    day = day_number(F.col("date"))
    at = F.when(day != 0, day * NANOS_A_DAY + F.coalesce(nanos_of_day(F.col("time")), F.lit(0)))
    rows = timeline.select(F.lower(bare(F.col("host"))).alias("entity"), at.alias("at"), "event_id", "sourcetype", "short")
    return event_runs(rows, "entity", "at", "event_id", event_reading(F.col("sourcetype"), F.col("short")), least=least, gap=gap, using=("sourcetype", "short"))
