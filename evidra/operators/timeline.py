"""The supertimeline: adapters from parsed evidence, their union, order, and alerts laid into it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.rules import render

COLUMNS = ("datetime", "timezone", "macb", "source", "sourcetype", "type", "user_name", "host", "short", "descr", "version", "filename", "inode", "notes", "format", "extra")
#: The time of undated events, and of alerts, which sort last.
UNDATED, ALERT_TIME = "1970-01-01 00:00:00.000000", "9999-12-31 23:59:59.999999"


def text(df: DataFrame, name: str) -> Column:
    """A column by name, in any case; empty where it is null or absent."""
    known = {c.lower(): c for c in df.columns}
    return F.coalesce(F.col(f"`{known[name.lower()]}`").cast("string"), F.lit("")) if name.lower() in known else F.lit("")


def moment(df: DataFrame, name: str) -> Column:
    """A time column as a timestamp in UTC, from text in any accepted form or from a timestamp; null if it is none."""
    known = {c.lower(): c for c in df.columns}
    if name.lower() not in known:
        return F.lit(None).cast("timestamp")
    c = F.col(f"`{known[name.lower()]}`")
    return c.cast("timestamp") if dict(df.dtypes)[known[name.lower()]].startswith("timestamp") else F.try_to_timestamp(c)


def shown(ts: Column) -> Column:
    """A timestamp as the timeline writes it."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def base_name(path: Column) -> Column:
    """The last part of a path, with either kind of slash."""
    return F.regexp_extract(path, r"([^\\/]*)[\\/]*$", 1)


def uri_base(stem: Column) -> Column:
    """The last segment of a request path, without trailing slashes."""
    return F.regexp_extract(F.regexp_replace(stem, "/+$", ""), "([^/]*)$", 1)


def events(df: DataFrame, ts: Column, keep_undated: bool = False, **cols: Column | str) -> DataFrame:
    """Rows of the timeline: columns by name, absent ones empty; rows without a time are dropped or get UNDATED."""
    rows = df.withColumn("_ts", ts)
    if not keep_undated:
        rows = rows.where("_ts is not null")
    made = {"timezone": "UTC", "version": "2", "format": "safe"} | cols | {"datetime": F.coalesce(shown(F.col("_ts")), F.lit(UNDATED))}
    return rows.select(*(F.coalesce(x if isinstance(x := made.get(c, ""), Column) else F.lit(x), F.lit("")).alias(c) for c in COLUMNS))


def said(df: DataFrame, template: str, **more: Column) -> Column:
    """A text with the columns named in braces filled in, absent and null ones empty."""
    return render(template, df.columns, more)


def userassist(df: DataFrame) -> DataFrame:
    """Programs run from the shell."""
    return events(df, moment(df, "last_run_utc"), macb="..C.", source="Registry", sourcetype="UserAssist", type="Last Run", user_name=text(df, "sid"), short=said(df, "Run: {base}", base=base_name(text(df, "decoded_path"))),
                  descr=said(df, "UserAssist run of {decoded_path} (RunCount: {run_count}, FocusTime: {focus_time_ms}ms)"), filename="NTUSER.DAT", extra=said(df, "run_count={run_count};focus_time_ms={focus_time_ms}"))


def prefetch(df: DataFrame) -> DataFrame:
    """Executions with their run times."""
    return events(df, moment(df, "run_time_utc"), macb="M...", source="Prefetch", sourcetype="Prefetch", type="Last Run", short=said(df, "Run: {executable}"),
                  descr=said(df, "Prefetch run of {executable} from {path} (RunCount: {run_count}, PrefetchFile: {prefetch_filename})"), filename=text(df, "prefetch_filename"), extra=said(df, "run_count={run_count};is_baseline={is_baseline}"))


def bam(df: DataFrame) -> DataFrame:
    """Background-activity records; the source column names the kind."""
    return events(df, moment(df, "last_execution_utc"), macb="M...", source="Registry", sourcetype=text(df, "source"), type="Last Run", user_name=text(df, "sid"), short=said(df, "Run: {base}", base=base_name(text(df, "normalized_path"))),
                  descr=said(df, "BAM/DAM execution trace of {normalized_path}"), filename="SYSTEM")


def shimcache(df: DataFrame) -> DataFrame:
    """Compatibility-cache entries."""
    return events(df, moment(df, "last_modified_utc"), macb="M...", source="Registry", sourcetype="ShimCache", type="Last Modified", short=said(df, "ShimCache: {base}", base=base_name(text(df, "path"))),
                  descr=said(df, "ShimCache entry for {path} (ExecutionFlag: {execution_flag})"), filename="SYSTEM", extra=said(df, "execution_flag={execution_flag}"))


def shellbags(df: DataFrame) -> DataFrame:
    """Folders that a user opened."""
    return events(df, moment(df, "last_write_utc"), macb="M...", source="Registry", sourcetype="ShellBags", type="Folder Accessed", user_name=text(df, "sid"), short=said(df, "Access Folder: {base}", base=base_name(text(df, "folder_path"))),
                  descr=said(df, "User browsed folder {folder_path} (MRU: {mru_path})"), filename=text(df, "source_hive"))


def unpivot_times(df: DataFrame, times: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row for each named time column that has a time: the row's columns, and ts, macb, kind. One scan, whatever the number of columns."""
    each = [F.struct(moment(df, c).alias("ts"), F.lit(macb).alias("macb"), F.lit(kind).alias("kind")) for c, (macb, kind) in times.items() if c.lower() in {x.lower() for x in df.columns}]
    return df.select("*", F.explode(F.array(*each)).alias("_e")).select(*df.columns, "_e.*").where("ts is not null")


def jump_lists(df: DataFrame) -> DataFrame:
    """Recent documents: up to four times of one entry become four events."""
    times = {"last_accessed_utc": ("..C.", "Accessed"), "lnk_created_utc": ("...B", "Created"), "lnk_modified_utc": ("M...", "Modified"), "lnk_accessed_utc": (".A..", "Link Accessed")}
    command = F.concat(text(df, "path"), F.when(text(df, "arguments") != "", F.concat(F.lit(" "), text(df, "arguments"))).otherwise(""))
    return events(unpivot_times(df, times), F.col("ts"), macb=F.col("macb"), source="File", sourcetype="JumpList", type=F.col("kind"), user_name=text(df, "sid"), short=said(df, "JumpList: {base}", base=base_name(text(df, "path"))),
                  descr=said(df, "JumpList entry ({type}) appID {app_id} targets: {command}", command=command), filename=said(df, "{type} DestList"), extra=said(df, "app_id={app_id};type={type}"))


def browser_history(df: DataFrame) -> DataFrame:
    """Visits."""
    return events(df, moment(df, "last_visit_utc"), macb="..C.", source="Browser", sourcetype=said(df, "{browser} History"), type="Visit", user_name=text(df, "sid"), short=said(df, "Visited: {title}"),
                  descr=said(df, "User visited URL {url} (Browser: {browser}, Profile: {profile}, VisitCount: {visit_count})"), filename=said(df, "{browser} History DB"), extra=said(df, "browser={browser};profile={profile};visit_count={visit_count}"))


def browser_downloads(df: DataFrame) -> DataFrame:
    """Downloads."""
    return events(df, moment(df, "start_time_utc"), macb="...B", source="Browser", sourcetype=said(df, "{browser} Downloads"), type="Downloaded", user_name=text(df, "sid"), short=said(df, "Download: {base}", base=base_name(text(df, "target_path"))),
                  descr=said(df, "Downloaded {target_path} from {url} (Browser: {browser}, Profile: {profile}, Size: {total_bytes} bytes)"), filename=said(df, "{browser} History DB"), extra=said(df, "browser={browser};profile={profile};total_bytes={total_bytes}"))


def json_text(json: Column, key: str) -> Column:
    """A member of a JSON object if it is a string, else empty; broken JSON has none."""
    v = F.try_parse_json(json)
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))


def short_channel(channel: Column) -> Column:
    """A channel name without its vendor prefix."""
    return F.regexp_replace(channel, "^Microsoft-(Windows-)?", "")


def event_log(df: DataFrame) -> DataFrame:
    """Event-log rows; the user is the first of the target's and the subject's name that is a person's."""
    rows = df.withColumn("_json", F.coalesce(F.col("event_data"), F.lit("")))
    person = lambda k: F.when(~(u := json_text(F.col("_json"), k)).isin("", "-", "SYSTEM") & ~u.endswith("$"), u)
    user = F.coalesce(person("TargetUserName"), person("SubjectUserName"), F.lit(""))
    return events(rows, moment(df, "time_created_utc"), macb="..C.", source="EventLog", sourcetype=short_channel(text(df, "channel")), type=said(df, "EventID: {event_id}"), user_name=user, host=text(df, "computer"), short=said(df, "Evtx: ID {event_id} ({provider})"),
                  descr=said(df, "Provider: {provider}, EventData: {event_data}"), filename=F.concat(F.replace(text(df, "channel"), F.lit("/"), F.lit("_")), F.lit(".csv")), extra=said(df, "event_id={event_id};provider={provider}"))


def amcache(df: DataFrame) -> DataFrame:
    """Files first seen; a file id is the hash behind four zeros."""
    sha1 = F.regexp_replace(text(df, "file_id"), "^0000", "")
    part = lambda label, v: F.when(v != "", F.concat(F.lit(f"{label}: "), v))
    return events(df, moment(df, "last_write_utc"), macb="..C.", source="Registry", sourcetype="Amcache", type="First Seen", short=said(df, "Amcache: {name}"),
                  descr=F.concat_ws(", ", said(df, "Amcache first-seen entry for {path}"), part("Publisher", text(df, "publisher")), part("Version", text(df, "version")), part("SHA1", sha1)),
                  filename="Amcache.hve", extra=said(df, "is_os_component={is_os_component};sha1={sha1}", sha1=sha1))


def scheduled_tasks(df: DataFrame, as_of: str) -> DataFrame:
    """Tasks of the two upper tiers, at the time of the analysis."""
    tier = F.upper(F.trim(text(df, "tier")))
    command = F.concat(text(df, "command"), F.when(text(df, "arguments") != "", F.concat(F.lit(" "), text(df, "arguments"))).otherwise(""))
    description = F.when(text(df, "description") != "", F.concat(F.lit(" | Description: "), text(df, "description"))).otherwise("")
    return events(df.where(tier.isin("HIGH", "NOTABLE")), F.lit(as_of).cast("timestamp"), macb="...B", source="File", sourcetype="ScheduledTasks", type=F.concat(F.initcap(tier), F.lit(" Task")), user_name=text(df, "user_id"),
                  short=said(df, "Task: {base}", base=base_name(text(df, "task_name"))), descr=said(df, "ScheduledTask {task_name} | Cmd: {command} | Enabled: {enabled} | Flags: {flags}{rest}", command=command, rest=description),
                  filename="tasks.csv", extra=said(df, "tier={tier};enabled={enabled}"))


def master_file_table(df: DataFrame) -> DataFrame:
    """Files: up to four times of one record become four events, all marked modified."""
    times = {"creation_time": ("M...", "File Creation"), "modified_time": ("M...", "File Modified"), "mft_modified_time": ("M...", "MFT Record Modified"), "accessed_time": ("M...", "File Accessed")}
    return events(unpivot_times(df, times), F.col("ts"), macb=F.col("macb"), source="FILE", sourcetype="mft_timeline.csv", type=F.col("kind"), user_name="-", host="-", short=text(df, "filename"), descr=said(df, "$MFT Record: {filename}"), format="")


def change_journal(df: DataFrame) -> DataFrame:
    """Change-journal records: deleted before created before modified."""
    reason = text(df, "reason")
    kind = F.when(reason.contains("FILE_DELETE"), "File Deleted").when(reason.contains("FILE_CREATE"), "File Created").otherwise("File Modified")
    return events(df, moment(df, "timestamp"), macb="M...", source="USN", sourcetype="usn.csv", type=kind, user_name="-", host="-", short=text(df, "filename"), descr=said(df, "USN Record: {filename} ({reason})"), format="")


def shell_access(requests: DataFrame, flagged: DataFrame, name: str = "filename") -> DataFrame:
    """Requests to flagged files: a left semi join on the base name in lower case. The flagged names are few by nature, but no hint says so: the optimizer chooses by their size."""
    names = flagged.select(F.lower(F.col(name)).alias("_base")).where("_base <> ''").distinct()
    rows = requests.withColumn("_base", F.lower(uri_base(text(requests, "uri_stem")))).join(names, "_base", "left_semi")
    return events(rows, moment(requests, "datetime_utc"), macb="..C.", source="IIS", sourcetype="WebShellAccess", type=text(requests, "method"), user_name=text(requests, "client_ip"), host=text(requests, "host"),
                  short=said(requests, "Web shell hit: {method} {uri_stem} ({protocol_status})"), descr=said(requests, "Request to flagged script {uri_stem} from {client_ip} (status {protocol_status}, query: {uri_query}, UA: {user_agent})"),
                  filename=text(requests, "source_log"), extra=said(requests, "client_ip={client_ip};status={protocol_status}"))


#: The table that each adapter reads.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "userassist": userassist, "prefetch": prefetch, "bam_dam": bam, "shimcache": shimcache, "shellbags": shellbags, "jump_lists": jump_lists, "history": browser_history,
    "downloads": browser_downloads, "evtx": event_log, "amcache_files": amcache, "mft_full": master_file_table, "usn": change_journal,
}


def build_timeline(tables: Mapping[str, DataFrame], as_of: str | None = None) -> DataFrame:
    """The bag union of all adapters whose table exists. Tables that lack a column that an adapter needs give no rows there."""
    parts = [ADAPTERS[name](df) for name, df in tables.items() if name in ADAPTERS]
    if "tasks" in tables and as_of:
        parts.append(scheduled_tasks(tables["tasks"], as_of))
    if "iis_requests" in tables and "web_files" in tables:
        flagged = tables["web_files"].where(F.upper("triage").isin("HIGH", "NOTABLE"))
        parts.append(shell_access(tables["iis_requests"], flagged))
    if not parts:
        raise ValueError("no table that an adapter reads")
    return reduce(DataFrame.unionByName, parts)


def in_order(timeline: DataFrame) -> DataFrame:
    """The timeline sorted by time, with all other columns breaking ties. Range-partitioned, so no task sorts it all."""
    return timeline.orderBy("datetime", "source", "sourcetype", "short", "descr", "host", "user_name")


def with_alerts(timeline: DataFrame, hits: DataFrame) -> DataFrame:
    """The timeline and, after all dated events, one row for each hit."""
    made = {
        "datetime": ALERT_TIME, "timezone": "UTC", "macb": "....", "source": "Behavior", "sourcetype": "DetectionEngine", "type": "ALERT", "user_name": "SYSTEM", "version": "2", "format": "safe",
        "short": said(hits, "[{severity}] {title} ({rule_id})"), "descr": said(hits, "Evidence: {evidence_detail} | Source: {evidence_source} | MITRE: {mitre_technique}"),
    }
    rows = hits.select(*((v if isinstance(v := made.get(c, ""), Column) else F.lit(v)).alias(c) for c in COLUMNS))
    return timeline.unionByName(rows)
