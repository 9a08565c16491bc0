"""Where results go: tables, exports, bundles and manifests."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.integrity import manifest_lines
from evidra.operators.rules import ordered
from evidra.operators.triage import csv_safe


def write_timeline(timeline: DataFrame, path: str) -> None:
    """The timeline as a table partitioned by day and sorted inside, so that a range of time reads few files; a day, however busy, is spread over several."""
    rows = timeline.withColumn("day", F.substring("datetime", 1, 10))
    rows.repartitionByRange("day", "datetime").sortWithinPartitions("day", "datetime").write.mode("overwrite").partitionBy("day").parquet(path)


def write_table(table: DataFrame, path: str, by: str | None = None) -> None:
    """A table, in place of an earlier one."""
    writer = table.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def export_csv(table: DataFrame, path: str) -> None:
    """A table as CSV for a spreadsheet; cells that it could take for formulas are quoted here and nowhere else."""
    cells = [csv_safe(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in table.dtypes]
    table.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits in their total order, as CSV."""
    export_csv(ordered(hits), path)


def write_stix(objects: DataFrame, path: str, bundle_id: str) -> None:
    """STIX objects (one JSON text each) as bundles: every file is a whole one, with an array of its objects and an id that follows from `bundle_id` and the file's number; the objects stay distributed."""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{bundle_id}/{TaskContext.get().partitionId()}")
        before = f'{{"type":"bundle","id":"bundle--{own}","objects":['
        for batch in batches:
            if len(batch):
                lines = batch["object"].tolist()
                yield pd.DataFrame({"value": [before + lines[0], *("," + x for x in lines[1:])]})
                before = ","
        yield pd.DataFrame({"value": ["]}" if before == "," else before + "]}"]})

    objects.select("object").mapInPandas(wrap, "value string").write.mode("overwrite").text(path)


def write_manifest(files: DataFrame, path: str) -> None:
    """`<sha256>  <path>` lines in order of path."""
    manifest_lines(files).write.mode("overwrite").text(path)


def read_tags(path: str) -> list[dict]:
    """An analyst's tags; none without a file."""
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return json.load(f)


def write_tags(tags: list[dict], path: str) -> None:
    """An analyst's tags, in place of the earlier ones."""
    keep = [{k: str(t.get(k, "")) for k in ("id", "event_data", "note")} for t in tags]
    with open(f"{path}.new", "w") as f:
        json.dump(keep, f, indent=1)
    os.replace(f"{path}.new", path)
