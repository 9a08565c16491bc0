"""Filtered, searched, sorted and paged views of the timeline and of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that a text search of the timeline looks at.
SEARCHED = ("source", "sourcetype", "type", "user_name", "host", "short", "descr", "filename", "inode", "notes", "format", "extra")
TIMELINE_PAGE, TIMELINE_MOST = 100, 1000
ARTIFACT_PAGE, ARTIFACT_MOST = 200, 2000
SEARCH_ROWS, SEARCH_LEAST = 50, 2


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


@dataclass(frozen=True)
class TimelineQuery:
    """Filters of the timeline; empty ones let all rows pass. `like` reads % and _ in q as wildcards."""

    type: str = ""
    source: str = ""
    macb: str = ""
    start: str = ""
    end: str = ""
    q: str = ""
    like: bool = False

    def condition(self) -> Column:
        """All filters as one Column over the timeline's columns, for Catalyst to push down."""
        parts = [F.lit(True)]
        if self.type:
            parts.append(F.col("type") == self.type)
        if self.source:
            parts.append(F.col("source") == self.source)
        if self.macb:
            parts.append(_any([F.contains(F.lower("macb"), F.lit(x)) for x in self.macb.lower() if x != "."]))
        moment = lambda x, closing: x.replace("T", " ") + (closing if len(x) == 16 else "")
        if self.start:
            parts.append(F.col("datetime") >= moment(self.start, ":00"))
        if self.end:
            # the whole last second, or of a minute its last
            parts.append(F.col("datetime") < F.concat(F.lit(moment(self.end, ":59")), F.lit("\x7f")))
        if self.q:
            each = [_text(c) for c in SEARCHED]
            parts.append(_any([c.ilike(f"%{self.q}%") for c in each] if self.like else [F.contains(F.lower(c), F.lit(self.q.lower())) for c in each]))
        return reduce(lambda a, b: a & b, parts)


def timeline_rows(timeline: DataFrame, query: TimelineQuery) -> DataFrame:
    """The rows that pass."""
    return timeline.where(query.condition())


def timeline_page(timeline: DataFrame, query: TimelineQuery, limit: int = TIMELINE_PAGE, offset: int = 0, ascending: bool = False, tie: str = "event_id") -> DataFrame:
    """One page in order of time, the latest first unless `ascending`; the limit is at most TIMELINE_MOST."""
    order = (F.asc if ascending else F.desc)("datetime")
    return timeline_rows(timeline, query).orderBy(order, F.asc(tie)).offset(max(0, offset)).limit(min(max(1, limit), TIMELINE_MOST))


def facets(timeline: DataFrame) -> DataFrame:
    """The values of type and source that the filters offer: facet, value, n. Both are counted in one pass."""
    pair = lambda x: F.struct(F.lit(x).alias("facet"), F.col(x).alias("value"))
    return timeline.select(F.explode(F.array(pair("type"), pair("source"))).alias("f")).select("f.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class ArtifactQuery:
    """Filters of any table: exact values of one column (without letter case), and a text in any cell."""

    column: str = ""
    values: tuple[str, ...] = ()
    q: str = ""

    def condition(self, columns: Sequence[str]) -> Column:
        """The filters as one Column."""
        parts = [F.lit(True)]
        if self.column and self.values:
            parts.append(F.lower(_text(self.column)).isin([v.strip().lower() for v in self.values]))
        if self.q:
            parts.append(_any([F.contains(F.lower(_text(c)), F.lit(self.q.lower())) for c in columns]))
        return reduce(lambda a, b: a & b, parts)


def mixed_order(column: str, ascending: bool = True) -> list[Column]:
    """Sort keys of a column that mixes numbers and text: numbers first, by value, then text without letter case."""
    number = _text(column).try_cast("double")
    way = F.asc if ascending else F.desc
    return [F.asc(number.isNull().cast("int")) if ascending else F.desc(number.isNull().cast("int")), way(number), way(F.lower(_text(column)))]


def artifact_page(table: DataFrame, query: ArtifactQuery, sort: str = "", ascending: bool = True, limit: int = ARTIFACT_PAGE, offset: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """One page of a table, sorted by a column and then by `tie`; the limit is at most ARTIFACT_MOST."""
    rows = table.where(query.condition(table.columns))
    keys = ([*mixed_order(sort, ascending)] if sort else []) + [F.asc(x) for x in tie]
    return (rows.orderBy(*keys) if keys else rows).offset(max(0, offset)).limit(min(max(1, limit), ARTIFACT_MOST))


def folder_label(folder: Column) -> Column:
    """A folder's name for reading."""
    return F.when(folder == "", "Root").when((folder == "mft") | folder.startswith("mft_"), "File System").otherwise(F.initcap(F.replace(folder, F.lit("_"), F.lit(" "))))


def search_all(tables: Mapping[str, DataFrame], q: str, keys: Mapping[str, str], rows: int = SEARCH_ROWS) -> DataFrame:
    """Rows of all tables with a text in any cell: artifact, total, place (by the table's key), row (a map of its cells).

    At most `rows` of each table are returned, beside the exact total of all, the tables with most hits first, then by
    name. Each table is scanned for its total, with partial aggregation, and again for its first rows, by a limited sort
    that keeps no more than these per task; never by a window over all hits.
    """
    if len(q) < SEARCH_LEAST:
        raise ValueError(f"a search needs at least {SEARCH_LEAST} characters")
    parts = []
    for name, df in tables.items():
        found = df.where(ArtifactQuery(q=q).condition(df.columns))
        total = found.agg(F.count("*").alias("total")).where("total > 0")
        cells = F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*map(_text, df.columns)))
        first = found.orderBy(keys[name]).limit(rows).select(F.lit(name).alias("artifact"), F.col(keys[name]).cast("long").alias("place"), cells.alias("row"))
        parts.append(first.crossJoin(total).select("artifact", "total", "place", "row"))  # the total is one row
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("total"), "artifact", "place")


def search_totals(tables: Mapping[str, DataFrame], q: str) -> DataFrame:
    """How many rows of each table hold a text: artifact, total; tables without hits are left out."""
    parts = [df.where(ArtifactQuery(q=q).condition(df.columns)).agg(F.count("*").alias("total")).select(F.lit(name).alias("artifact"), "total") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).where("total > 0")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The number of rows of each table: artifact, n."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n") for name, df in tables.items()])


def trigram_index(rows: DataFrame, key: str, text: Sequence[str]) -> DataFrame:
    """An index for literal searches of three characters or more: each distinct three characters of a row, with the row's key."""
    joined = F.lower(F.concat_ws("\x1f", *map(_text, text)))
    grams = F.when(F.length("t") >= 3, F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))
    return rows.select(F.col(key), joined.alias("t")).select(key, F.explode(F.array_distinct(grams)).alias("gram"))


def store_trigram_index(index: DataFrame, path: str) -> None:
    """The index as a table sorted by its trigrams, so that a search reads only the row groups that hold its own."""
    index.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def trigram_search(index: DataFrame, rows: DataFrame, key: str, text: Sequence[str], q: str) -> DataFrame:
    """The rows that hold a literal text, by the index: keys that have all of its trigrams, then a check of the text itself."""
    low = q.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    check = _any([F.contains(F.lower(_text(c)), F.lit(low)) for c in text])
    if not grams:
        return rows.where(check)
    place = F.array_position(F.array(*map(F.lit, grams)), F.col("gram")) - 1
    # which of the trigrams a key has, as sets of bits, so that keys are aggregated before they are exchanged
    bit = F.array(*(F.lit(1 << i).cast("long") for i in range(60)))
    words = [F.bit_or(F.coalesce(F.get(bit, (place - a).cast("int")), F.lit(0))).alias(f"w{a}") for a in range(0, len(grams), 60)]
    whole = reduce(lambda x, y: x & y, [F.col(f"w{a}") == (1 << min(60, len(grams) - a)) - 1 for a in range(0, len(grams), 60)])
    keys = index.where(F.col("gram").isin(grams)).groupBy(key).agg(*words).where(whole).select(key)
    return rows.join(keys, key, "left_semi").where(check)
