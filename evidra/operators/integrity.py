"""Hash manifests and their reconciliation with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed list: files written after the manifest that don't count as tampering.
DERIVED = ("manifest.sha256", "manifest.json", "analyzer_result.json", "tags.json")
DERIVED_FOLDERS = ("lab_report/",)


def file_hashes(df: DataFrame, root: str = "") -> DataFrame:
    """path, size, sha256 of files read by the binaryFile source; paths are relative to `root`."""
    path = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{root.strip('/')}/", "") if root else F.col("path")
    return df.select(path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """path, sha256 of manifest lines `<hash>  <path>`; other lines are left out."""
    form = r"^([0-9a-fA-F]{64}) [ *](.+)$"
    rows = lines.where(F.col(column).rlike(form))
    return rows.select(F.regexp_extract(column, form, 2).alias("path"), F.lower(F.regexp_extract(column, form, 1)).alias("sha256"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """The lines of a manifest, in order of path."""
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def reconcile(manifest: DataFrame, files: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """What the manifest and the files disagree on, or not: path, expected, actual, status (ok, mismatch, missing, extra). One full outer join on the path; derived files that are not in the manifest are left out."""
    m = manifest.select(F.col(key).alias("path"), F.lower(digest).alias("expected"))
    f = files.select(F.col(key).alias("path"), F.lower(digest).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") == F.col("actual"), "ok").otherwise("mismatch")
    rows = m.join(f, "path", "full_outer").withColumn("status", status)
    derived = F.regexp_extract(F.col("path").cast("string"), "([^/]*)$", 1).isin(*DERIVED)
    for x in DERIVED_FOLDERS:
        derived = derived | F.startswith(F.col("path").cast("string"), F.lit(x))
    return rows.where(~((F.col("status") == "extra") & derived))


def verdict(reconciled: DataFrame) -> DataFrame:
    """One row: the number of files in each state, and the overall status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return reconciled.agg(n("ok").alias("ok"), n("mismatch").alias("mismatch"), n("missing").alias("missing"), n("extra").alias("extra")).withColumn("status", F.when(F.col("mismatch") + F.col("missing") + F.col("extra") > 0, "failed").otherwise("ok"))
