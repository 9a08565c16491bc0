"""Deeply nested records as related flat tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.text import fence
from evidra.session import materialize
from evidra.sources.xml_records import DEEPEST, elements_below, xml_to_json


def merged_schema(depth: int) -> T.StructType:
    """The schema that holds every element down to `depth`: one struct per level, its parts optional, with an array of the next."""
    fields = [T.StructField("n", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType()), T.StructField("a", T.MapType(T.StringType(), T.StringType()))]
    if depth > 1:
        fields.append(T.StructField("c", T.ArrayType(merged_schema(depth - 1))))
    return T.StructType(fields)


_ELEMENT = ["key", "level", "node_id", "parent_id", "path", "same_id", "text", "attributes"]


def _below(texts: DataFrame) -> DataFrame:
    """The elements below DEEPEST levels of the texts `x` as flat rows, straight from the parser."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, x in zip(batch["key"].tolist(), batch["x"]):
                for some in elements_below(x):
                    yield pd.DataFrame([(key, *e) for e in some], columns=_ELEMENT)

    rows = texts.mapInPandas(read, f"key {dict(texts.dtypes)['key']}, level int, node_id string, parent_id string, path string, same_id string, text string, attributes string")
    return rows.withColumn("attributes", F.from_json("attributes", "map<string,string>"))


def elements(records: DataFrame, key: str, text: str) -> DataFrame | None:
    """Every element of the XML texts as a flat row: key, level (from 1), node_id, parent_id, path, same_id, text, attributes; None without readable texts.

    Method: every record is parsed once; the merged schema of all of them is inferred (one struct per level, as deep as
    the deepest record, at most DEEPEST); each array level is exploded in turn, one after the other, an element going
    along with its children, so that the work grows with depth and rows and no level is exploded twice. What is nested
    deeper comes as flat rows from the parser, read once more for such records. node_id and parent_id are surrogate keys:
    the array ordinals (from 1 among all element children of a parent) from the root down, joined by points; path has the
    names likewise, by slashes, same_id the places among siblings of one name.
    """
    once = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(text).alias("x"))
    deep = F.when(F.col("v.depth") >= DEEPEST, F.col("x")).alias("x")
    parsed = fence(once, v=xml_to_json(F.col("x"))).select("key", "v.json", "v.depth", deep).where("json is not null")
    parsed = materialize(parsed, "xml-records")
    depth = parsed.agg(F.max("depth")).first()[0] or 0
    if not depth:
        return None
    kids = F.col("e.c") if depth > 1 else F.lit(None)
    same = lambda e: F.coalesce(F.col(f"{e}.k"), F.lit(1)).cast("string")
    rows = fence(parsed.select("key", "json"), e=F.from_json("json", merged_schema(depth)))
    rows = rows.select("key", F.lit(1).alias("level"), F.lit("1").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("e.n").alias("path"), same("e").alias("same_id"), F.col("e.t").alias("text"), F.col("e.a").alias("attributes"), kids.alias("kids"))
    for i in range(2, depth + 1):
        itself = F.array(F.lit(None).cast(merged_schema(depth - i + 1)))
        rows = rows.select("*", F.posexplode(F.coalesce(F.concat(itself, "kids"), itself)).alias("place", "e"))
        own = F.col("place") == 0
        rows = rows.select(
            "key", F.when(own, F.col("level")).otherwise(i).alias("level"),
            F.when(own, F.col("node_id")).otherwise(F.concat_ws(".", "node_id", "place")).alias("node_id"),
            F.when(own, F.col("parent_id")).otherwise(F.col("node_id")).alias("parent_id"),
            F.when(own, F.col("path")).otherwise(F.concat_ws("/", "path", "e.n")).alias("path"),
            F.when(own, F.col("same_id")).otherwise(F.concat_ws(".", "same_id", same("e"))).alias("same_id"),
            F.when(own, F.col("text")).otherwise(F.col("e.t")).alias("text"),
            F.when(own, F.col("attributes")).otherwise(F.col("e.a")).alias("attributes"),
            *([F.col("e.c").alias("kids")] if i < depth else []),
        )
    rows = rows.select(*_ELEMENT)
    return rows.unionByName(_below(parsed.where("x is not null").select("key", "x"))) if depth >= DEEPEST else rows


def level_tables(records: DataFrame, key: str, text: str) -> list[DataFrame]:
    """One flat table for each level of nesting of the XML texts, the roots first, and one of all elements below DEEPEST levels.

    The rows of `elements`, written once by level. Columns: the key, node_id, parent_id, ordinal (from 1 among all element
    children of the parent), same_name_ordinal, name, text, attributes, and `trail`, the name and ordinals of each
    element from the root down. Texts that are null, empty or not well-formed give no rows; a table without readable
    texts gives no tables. Of repeated rows with one key one counts (the least text). Other columns are ignored.
    """
    found = elements(records, key, text)
    if found is None:
        return []
    found = materialize(found, "elements", by="level")
    deepest = found.agg(F.max("level")).first()[0]
    part = lambda c, by: F.split(c, by)
    zipped = F.arrays_zip(part("path", "/").alias("name"), part("node_id", r"\.").alias("ordinal"), part("same_id", r"\.").alias("same"))
    trail = F.transform(zipped, lambda x: F.struct(x["name"].alias("name"), x["ordinal"].cast("int").alias("ordinal"), x["same"].cast("int").alias("same")))
    last = F.element_at("trail", -1)
    none = F.create_map().cast("map<string,string>")
    shown = [F.col("key").alias(key), "node_id", "parent_id", last["ordinal"].alias("ordinal"), last["same"].alias("same_name_ordinal"), last["name"].alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("attributes", none).alias("attributes"), "trail"]
    tables = [found.where(F.col("level") == i) for i in range(1, min(deepest, DEEPEST) + 1)] + ([found.where(F.col("level") > DEEPEST)] if deepest > DEEPEST else [])
    return [t.withColumn("trail", trail).select(*shown) for t in tables]


#: Fixed names: the sections of a task and what a row of each is called.
SECTIONS = {"Triggers": "trigger", "Actions": "action", "Principals": "principal"}


def task_items(records: DataFrame, key: str, text: str) -> DataFrame:
    """The parts of exported tasks as flat rows that name their parent: key, task_no, section, parent_position, position, item."""
    found = elements(records, key, text)
    if found is None:
        return records.sparkSession.createDataFrame([], f"{key} {dict(records.dtypes)[key]}, task_no int, section string, parent_position int, position int, item string")
    rows = found.where(F.col("path").rlike(rf"^(?:Tasks/)?Task/(?:{'|'.join(SECTIONS)})/(?:[^/]+$|.*/(?:DaysOfWeek|RequiredPrivileges)/[^/]+$)"))
    # where the task stands in the path: first, or second under Tasks
    rows = fence(rows, at=F.when(F.col("path").startswith("Tasks/"), 2).otherwise(1), names=F.split("path", "/"), ids=F.split("node_id", r"\."))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair)), F.expr("get(names, at)"))
    holder, deep = F.expr("get(names, level - 2)"), F.expr("level - at")
    section = (
        F.when(deep == 2, kind)
        .when((kind == "trigger") & (holder == "DaysOfWeek") & (deep > 3), "day")
        .when((kind == "principal") & (holder == "RequiredPrivileges") & (deep == 4), "privilege")
    )
    rows = rows.withColumn("section", section).where("section is not null")
    item = F.when(F.col("section") == "principal", F.element_at("attributes", "id")).when(F.col("section") == "privilege", F.coalesce("text", F.lit(""))).otherwise(F.element_at("names", -1))
    parent = F.when(deep == 2, 0).otherwise(F.expr("get(ids, at + 1)").cast("int"))
    task_no = F.when(F.col("at") == 1, 1).otherwise(F.split_part("same_id", F.lit("."), F.lit(2)).cast("int"))
    return rows.select(F.col("key").alias(key), task_no.alias("task_no"), "section", parent.alias("parent_position"), F.element_at("ids", -1).cast("int").alias("position"), item.alias("item"))
