"""A case: a folder of evidence, its tables, timeline, hits and integrity."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import integrity, search
from evidra.operators.rules import Rule, evaluate, ordered
from evidra.operators.timeline import build_timeline, in_order, with_alerts
from evidra.session import materialize
from evidra.sources import files, rule_files, sinks


class Case:
    """Evidence tables below a folder as CSV (or Parquet), each by the name of its file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def tables(self, strict: bool = True) -> dict[str, DataFrame]:
        """All tables: strict for rules and the timeline, else with short rows for searches and pages."""
        return files.artifact_tables(self.spark, self.root, strict)

    def register(self) -> None:
        """Make each table a view of its name for SQL."""
        for name, df in self.tables(strict=False).items():
            df.createOrReplaceTempView(name.replace("/", "_"))

    def timeline(self, as_of: str | None = None) -> DataFrame:
        """The supertimeline of the tables that adapters read."""
        tables = self.tables()
        by_base = {name.rpartition("/")[2]: df for name, df in tables.items()}
        channels = [df for name, df in tables.items() if name.startswith("evtx/")]
        for df in channels:
            by_base["evtx"] = by_base["evtx"].unionByName(df, allowMissingColumns=True) if "evtx" in by_base else df
        return build_timeline(by_base, as_of)

    def hits(self, rules: list[Rule]) -> DataFrame:
        """The hits of rules, in order; a rule's patterns name files below the case."""
        tables = {s: df for r in rules for s in r.sources if (df := files.read_source(self.spark, self.root, [s])) is not None}
        return ordered(evaluate(rules, tables)) if tables else evaluate(rules, {"": self.spark.createDataFrame([], "x string")})

    def analyze(self, out: str, rules_folder: str = "", as_of: str | None = None) -> dict:
        """Timeline and hits as tables below `out`, and a summary of the run."""
        rules, warnings = rule_files.load_rules(rules_folder) if rules_folder else ([], [])
        hits = materialize(self.hits(rules), "hits")
        sinks.write_hits(hits, os.path.join(out, "behavior_hits"))
        sinks.write_timeline(in_order(with_alerts(self.timeline(as_of), hits)), os.path.join(out, "timeline"))
        summary = {"tables": {r["artifact"]: r["n"] for r in search.row_counts(self.tables(strict=False)).collect()}, "hits": hits.count(), "warnings": warnings}
        with open(os.path.join(out, "analyzer_result.json"), "w") as f:
            json.dump(summary, f, indent=1)
        return summary

    def hashes(self) -> DataFrame:
        """Every file of the case with its size and hash."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        return integrity.file_hashes(found, self.root)

    def verify(self, manifest: str) -> DataFrame:
        """The files beside a manifest."""
        return integrity.reconcile(integrity.parse_manifest(self.spark.read.text(manifest)), self.hashes().where(F.col("path") != os.path.relpath(manifest, self.root)))
