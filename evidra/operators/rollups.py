"""Roll-ups of a run, the list of its tables, and single files of it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.search import folder_label

#: Fixed list: event logs in the order in which an analyst reaches for them.
FIRST_CHANNELS = (
    "Security", "Microsoft-Windows-PowerShell_Operational", "Windows PowerShell", "Microsoft-Windows-Sysmon_Operational", "System", "Microsoft-Windows-TaskScheduler_Operational", "Microsoft-Windows-TaskScheduler_Maintenance",
    "Microsoft-Windows-WinRM_Operational", "Microsoft-Windows-WMI-Activity_Operational", "Microsoft-Windows-TerminalServices-LocalSessionManager_Operational", "Microsoft-Windows-TerminalServices-RemoteConnectionManager_Operational",
    "Microsoft-Windows-RemoteDesktopServices-RdpCoreTS_Operational", "Microsoft-Windows-SMBServer_Security", "Microsoft-Windows-SmbClient_Security", "Microsoft-Windows-Bits-Client_Operational", "Microsoft-Windows-Windows Defender_Operational", "Application",
)
#: Fixed value: how much of a stored file is shown.
SHOWN = 1 << 20


def listed(counts: DataFrame, name: str = "artifact", rows: str = "n") -> DataFrame:
    """Tables in the order of the list: by folder; the curated event logs first, the other ones by rows, all else by name. Adds the folder's label."""
    folder = F.when(F.col(name).contains("/"), F.substring_index(name, "/", 1)).otherwise("")
    base = F.lower(F.regexp_extract(name, r"([^/]*?)(?:\.csv)?$", 1))
    place = F.array_position(F.array(*(F.lit(x.lower()) for x in FIRST_CHANNELS)), base)
    log = F.lower(folder) == "evtx"
    curated = F.when(log, F.when(place == 0, len(FIRST_CHANNELS) + 1).otherwise(place)).otherwise(0)
    busy = F.when(log & (place == 0), -F.col(rows)).otherwise(0)
    return counts.withColumn("label", folder_label(folder)).orderBy(folder, curated, busy, F.lower(name))


def findings(results: DataFrame) -> DataFrame:
    """One row over the modules of a run (status, and findings as an array of structs with a severity): how many of each severity, and the worst status."""
    n = lambda s: F.coalesce(F.sum(F.size(F.filter("findings", lambda x: F.lower(x["severity"]) == s))), F.lit(0))
    any_of = lambda *s: F.coalesce(F.bool_or(F.lower("status").isin(*s)), F.lit(False))
    status = F.when(any_of("failed", "timed_out"), "degraded").when(any_of("partial"), "partial").otherwise("success")
    return results.agg(n("info").alias("info"), n("warning").alias("warning"), n("critical").alias("critical"), status.alias("status"))


def opened(processes: DataFrame, column: str = "open_result") -> DataFrame:
    """One row: how many processes could be opened, were denied, were skipped, and all."""
    n = lambda s: F.count_if(F.startswith(F.coalesce(F.col(column), F.lit("")), F.lit(s)))
    return processes.agg(F.count("*").alias("total"), n("opened").alias("opened"), n("denied").alias("denied"), n("skipped").alias("skipped"))


def verify_status(verdict: DataFrame) -> DataFrame:
    """The outcome of a reconciliation as one JSON text: status, filesChecked, mismatches, missing, extra."""
    checked = F.col("ok") + F.col("mismatch") + F.col("missing")
    body = F.struct("status", checked.alias("filesChecked"), F.col("mismatch").alias("mismatches"), "missing", "extra")
    return verdict.select(F.to_json(body).alias("json"))


def stored_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The head of one file below a folder: path, length, content (at most SHOWN bytes). A path that leads out of the folder is an error."""
    inside, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath((inside, full)) != inside:
        raise ValueError(f"{path} is not below {root}")
    found = spark.read.format("binaryFile").load(full)
    return found.select(F.lit(path).alias("path"), "length", F.substring("content", 1, SHOWN).alias("content"))
