"""Queries of the timeline, detections, indicators and views, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.times import micros
from evidra.operators import correlate, integrity, ioc, search, sequences, tasks, triage
from evidra.operators import timeline as tl
from evidra.operators.rules import Rule, evaluate
from evidra.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of its name, with its SQL if it has one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- the timeline -------------------------------------------------------------------------------------------------

_TEXTS = ("timezone", "macb", "source", "sourcetype", "type", "user_name", "host", "short", "descr", "version", "filename", "inode", "notes", "format", "extra")


def stored_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline table with its date and time in one column, nulls as empty."""
    t = read_table(spark, sf, "timeline")
    moment = F.concat_ws(" ", F.coalesce("date", F.lit("1970-01-01")), F.coalesce("time", F.lit("00:00:00.000000")))
    return t.select("event_id", moment.alias("datetime"), *(F.coalesce(c, F.lit("")).alias(c) for c in _TEXTS))


_T = "(SELECT event_id, coalesce(date, '1970-01-01') || ' ' || coalesce(time, '00:00:00.000000') AS datetime, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXTS) + " FROM timeline) t"
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_PERSON = "CASE WHEN json_type(j, '$.{0}') = 'VARCHAR' AND (j->>'$.{0}') NOT IN ('', '-', 'SYSTEM') AND NOT ends_with(j->>'$.{0}', '$') THEN j->>'$.{0}' END"
_EVTX_WHEN = """SELECT {when} AS datetime, 'UTC' AS timezone, '..C.' AS macb, 'EventLog' AS source, regexp_replace(coalesce(channel, ''), '^Microsoft-(Windows-)?', '') AS sourcetype,
 'EventID: ' || coalesce(event_id, '') AS type, coalesce({target}, {subject}, '') AS user_name, coalesce(computer, '') AS host, 'Evtx: ID ' || coalesce(event_id, '') || ' (' || coalesce(provider, '') || ')' AS short,
 'Provider: ' || coalesce(provider, '') || ', EventData: ' || coalesce(event_data, '') AS descr, '2' AS version, replace(coalesce(channel, ''), '/', '_') || '.csv' AS filename, '' AS inode, '' AS notes, 'safe' AS format,
 'event_id=' || coalesce(event_id, '') || ';provider=' || coalesce(provider, '') AS extra FROM (SELECT *, TRY_CAST(event_data AS JSON) AS j FROM evtx_rows) e"""
_EVTX = _EVTX_WHEN.format(when=_STAMP.format("time_created_utc"), target=_PERSON.format("TargetUserName"), subject=_PERSON.format("SubjectUserName")) + " WHERE time_created_utc IS NOT NULL"
_BASE = "regexp_extract(regexp_replace({0}, '/+$', ''), '([^/]*)$', 1)"
_SHELLS = f"(SELECT DISTINCT lower({_BASE.format('uri_stem')}) AS name FROM iis_requests WHERE starts_with(uri_stem, '/upload/') AND upper(method) = 'POST' AND {_BASE.format('uri_stem')} <> '')"
_STATUS = "coalesce(CAST(protocol_status AS VARCHAR), '')"
_SHELL_EVENTS = f"""SELECT {_STAMP.format('datetime_utc')} AS datetime, 'UTC' AS timezone, '..C.' AS macb, 'IIS' AS source, 'WebShellAccess' AS sourcetype, coalesce(method, '') AS type, coalesce(client_ip, '') AS user_name, coalesce(host, '') AS host,
 'Web shell hit: ' || coalesce(method, '') || ' ' || coalesce(uri_stem, '') || ' (' || {_STATUS} || ')' AS short, 'Request to flagged script ' || coalesce(uri_stem, '') || ' from ' || coalesce(client_ip, '') || ' (status ' || {_STATUS} || ', query: ' || coalesce(uri_query, '') || ', UA: ' || coalesce(user_agent, '') || ')' AS descr,
 '2' AS version, coalesce(source_log, '') AS filename, '' AS inode, '' AS notes, 'safe' AS format, 'client_ip=' || coalesce(client_ip, '') || ';status=' || {_STATUS} AS extra
 FROM iis_requests WHERE datetime_utc IS NOT NULL AND lower({_BASE.format("coalesce(uri_stem, '')")}) IN (SELECT name FROM {_SHELLS})"""


@query(_EVTX)
def timeline_evtx(spark: SparkSession, sf: str) -> DataFrame:
    """Event-log rows as events."""
    return tl.event_log(read_table(spark, sf, "evtx_rows"))


def _shells(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "iis_requests").where("startswith(uri_stem, '/upload/') and upper(method) = 'POST'")
    return r.select(tl.uri_base(F.col("uri_stem")).alias("filename")).distinct()


@query(_SHELL_EVENTS)
def timeline_shell_access(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to files that were posted to the upload folder, as events."""
    return tl.shell_access(read_table(spark, sf, "iis_requests"), _shells(spark, sf))


@query(f"{_EVTX} UNION ALL {_SHELL_EVENTS}")
def timeline_union_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Several adapters in one timeline, in order of time."""
    return tl.in_order(timeline_evtx(spark, sf).unionByName(timeline_shell_access(spark, sf)))


@query(_EVTX_WHEN.format(when=f"coalesce({_STAMP.format('time_created_utc')}, '1970-01-01 00:00:00.000000')", target="''", subject="''"))
def timeline_default_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Events without a time at the epoch."""
    e = read_table(spark, sf, "evtx_rows")
    return tl.events(e, tl.moment(e, "time_created_utc"), keep_undated=True, macb="..C.", source="EventLog", sourcetype=tl.short_channel(tl.text(e, "channel")), type=tl.said(e, "EventID: {event_id}"), host=tl.text(e, "computer"), short=tl.said(e, "Evtx: ID {event_id} ({provider})"),
                     descr=tl.said(e, "Provider: {provider}, EventData: {event_data}"), filename=F.concat(F.replace(tl.text(e, "channel"), F.lit("/"), F.lit("_")), F.lit(".csv")), extra=tl.said(e, "event_id={event_id};provider={provider}"))


@query("""SELECT l_orderkey, l_linenumber, strftime(u.ts, '%Y-%m-%d %H:%M:%S.%f') AS datetime, u.macb, u.kind FROM (SELECT l.*, o_orderdate FROM lineitem l JOIN orders ON o_orderkey = l_orderkey) x,
 LATERAL (SELECT o_orderdate AS ts, '...B' AS macb, 'Ordered' AS kind UNION ALL SELECT l_shipdate, 'M...', 'Shipped') u WHERE u.ts IS NOT NULL""")
def timeline_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Two times of one row as two events."""
    rows = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = tl.unpivot_times(rows.select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate"), {"o_orderdate": ("...B", "Ordered"), "l_shipdate": ("M...", "Shipped")})
    return rows.select("l_orderkey", "l_linenumber", tl.shown(F.col("ts")).alias("datetime"), "macb", "kind")


def _timeline_filter(name: str, where: str, **filters: object) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.timeline_rows(stored_timeline(spark, sf), search.TimelineQuery(**filters))

    run.__name__ = name
    run.__doc__ = f"The timeline filtered by {', '.join(filters)}."
    query(f"SELECT * FROM {_T} WHERE {where}")(run)


_like = lambda f: " OR ".join(f.format(c) for c in search.SEARCHED)
_timeline_filter("timeline_filter_type", "type = 'Last Run'", type="Last Run")
_timeline_filter("timeline_filter_source", "source = 'EventLog'", source="EventLog")
_timeline_filter("timeline_filter_macb", "contains(lower(macb), 'b') OR contains(lower(macb), 'a')", macb="AB")
_timeline_filter("timeline_filter_range", "datetime >= '2026-01-06 08:00:00' AND datetime < '2026-01-07 12:30:59' || chr(127)", start="2026-01-06T08:00", end="2026-01-07T12:30")
_timeline_filter("timeline_search_substring", _like("contains(lower({0}), 'powershell')"), q="PowerShell")
_timeline_filter("timeline_search_wildcard", _like("{0} ILIKE '%_run%.exe%'"), q="_run%.exe", like=True)
_timeline_filter("timeline_filter_all", "source = 'Registry' AND contains(lower(macb), 'c') AND datetime >= '2026-01-05 00:00:00' AND (" + _like("contains(lower({0}), 'exe')") + ")", source="Registry", macb="C", start="2026-01-05T00:00", q="EXE")


@query(f"SELECT * FROM {_T} WHERE source = 'Registry' ORDER BY datetime DESC, event_id LIMIT 100 OFFSET 200")
def timeline_page_desc(spark: SparkSession, sf: str) -> DataFrame:
    """The third page, the latest first."""
    return search.timeline_page(stored_timeline(spark, sf), search.TimelineQuery(source="Registry"), offset=200)


@query(f"SELECT * FROM {_T} ORDER BY datetime, event_id LIMIT 1000")
def timeline_page_asc(spark: SparkSession, sf: str) -> DataFrame:
    """The first page, the earliest first, as long as pages may be."""
    return search.timeline_page(stored_timeline(spark, sf), search.TimelineQuery(), limit=5000, ascending=True)


@query(f"SELECT 'type' AS facet, type AS value, count(*) AS n FROM {_T} WHERE type <> '' GROUP BY type UNION ALL SELECT 'source', source, count(*) FROM {_T} WHERE source <> '' GROUP BY source")
def timeline_facets(spark: SparkSession, sf: str) -> DataFrame:
    """The values of the filters."""
    return search.facets(stored_timeline(spark, sf))


@query(f"SELECT count(*) AS n FROM {_T} WHERE {_like(chr(99) + 'ontains(lower({0}), ' + chr(39) + 'ticket' + chr(39) + ')')}")
def timeline_count(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a search finds."""
    return search.timeline_rows(stored_timeline(spark, sf), search.TimelineQuery(q="ticket")).agg(F.count("*").alias("n"))


@query(f"SELECT * FROM {_T} WHERE {_like(chr(99) + 'ontains(lower({0}), ' + chr(39) + 'schtasks' + chr(39) + ')')}")
def timeline_trigram_search(spark: SparkSession, sf: str) -> DataFrame:
    """A literal search through the trigram index."""
    t = stored_timeline(spark, sf)
    return search.trigram_search(search.trigram_index(t, "event_id", search.SEARCHED), t, "event_id", search.SEARCHED, "SchTasks")


@query(f"""SELECT * FROM ({_EVTX}) UNION ALL SELECT '9999-12-31 23:59:59.999999', 'UTC', '....', 'Behavior', 'DetectionEngine', 'ALERT', 'SYSTEM', '', '[HIGH] Log cleared (L-1)', 'Evidence: ' || coalesce(event_id, '') || ' on ' || coalesce(computer, '') || ' | Source: evtx_rows | MITRE: T1070', '2', '', '', '', 'safe', ''
 FROM evtx_rows WHERE event_id = '1102'""")
def alerts_injected(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline with its alerts at the end."""
    e = read_table(spark, sf, "evtx_rows")
    rule = Rule("L-1", "Log cleared", "HIGH", "T1070", ("evtx_rows",), {"field": "event_id", "equals": "1102"}, "{event_id} on {computer}", timeline_key="{computer}")
    return tl.with_alerts(tl.event_log(e), evaluate([rule], {"evtx_rows": e}))


# Adapters read the event-log rows under the names of their own columns; each value is told by its name in braces.
_LAST_PART = "regexp_extract({0}, '([^\\\\/]*)[\\\\/]*$', 1)"


def _adapter(name: str, adapter: Callable[[DataFrame], DataFrame], columns: dict[str, str], extra_times: dict[str, tuple[str, str]] | None = None, **shown: str) -> None:
    """Register an adapter: `columns` maps its columns to those of evtx_rows, `shown` its results to texts with these in braces (and base:x, the last part of x)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = read_table(spark, sf, "evtx_rows")
        return adapter(rows.select(*(F.col(old).alias(new) for new, old in columns.items())))

    def told(text: str) -> str:
        parts = re.split(r"\{([^{}]*)\}", text)
        value = lambda x: f"coalesce(CAST({columns[x]} AS VARCHAR), '')"
        filled = [_LAST_PART.format(value(x[5:])) if x.startswith("base:") else value(x) for x in parts[1::2]]
        texts = ["'" + x.replace("'", "''") + "'" for x in parts[::2]]
        return " || ".join(x for pair in zip(texts, [*filled, "''"]) for x in pair if x != "''") or "''"

    fixed = {"timezone": "UTC", "version": "2", "format": "safe"}
    selects = []
    for time, (macb, kind) in (extra_times or {"": (shown.get("macb", ""), shown.get("type", ""))}).items():
        at = columns[time] if time else next(old for new, old in columns.items() if new.endswith(("_utc", "timestamp")))
        cells = fixed | shown | {"macb": macb, "type": kind}
        made = [f"{told(cells.get(c, ''))} AS {c}" for c in tl.COLUMNS if c != "datetime"]
        selects.append(f"SELECT {_STAMP.format(at)} AS datetime, {', '.join(made)} FROM evtx_rows WHERE {at} IS NOT NULL")
    run.__name__ = name
    run.__doc__ = f"Events of the adapter {adapter.__name__}."
    query(" UNION ALL ".join(selects))(run)


_adapter("timeline_userassist", tl.userassist, {"last_run_utc": "time_created_utc", "decoded_path": "channel", "sid": "computer", "run_count": "event_id", "focus_time_ms": "record_id"},
         macb="..C.", source="Registry", sourcetype="UserAssist", type="Last Run", user_name="{sid}", short="Run: {base:decoded_path}", descr="UserAssist run of {decoded_path} (RunCount: {run_count}, FocusTime: {focus_time_ms}ms)", filename="NTUSER.DAT", extra="run_count={run_count};focus_time_ms={focus_time_ms}")
_adapter("timeline_prefetch", tl.prefetch, {"run_time_utc": "time_created_utc", "executable": "provider", "path": "channel", "run_count": "event_id", "prefetch_filename": "computer", "is_baseline": "level"},
         macb="M...", source="Prefetch", sourcetype="Prefetch", type="Last Run", short="Run: {executable}", descr="Prefetch run of {executable} from {path} (RunCount: {run_count}, PrefetchFile: {prefetch_filename})", filename="{prefetch_filename}", extra="run_count={run_count};is_baseline={is_baseline}")
_adapter("timeline_bam", tl.bam, {"last_execution_utc": "time_created_utc", "normalized_path": "channel", "sid": "computer", "source": "level"},
         macb="M...", source="Registry", sourcetype="{source}", type="Last Run", user_name="{sid}", short="Run: {base:normalized_path}", descr="BAM/DAM execution trace of {normalized_path}", filename="SYSTEM")
_adapter("timeline_shimcache", tl.shimcache, {"last_modified_utc": "time_created_utc", "path": "channel", "execution_flag": "level"},
         macb="M...", source="Registry", sourcetype="ShimCache", type="Last Modified", short="ShimCache: {base:path}", descr="ShimCache entry for {path} (ExecutionFlag: {execution_flag})", filename="SYSTEM", extra="execution_flag={execution_flag}")
_adapter("timeline_shellbags", tl.shellbags, {"last_write_utc": "time_created_utc", "folder_path": "channel", "sid": "computer", "mru_path": "event_id", "source_hive": "level"},
         macb="M...", source="Registry", sourcetype="ShellBags", type="Folder Accessed", user_name="{sid}", short="Access Folder: {base:folder_path}", descr="User browsed folder {folder_path} (MRU: {mru_path})", filename="{source_hive}")
_adapter("timeline_history", tl.browser_history, {"last_visit_utc": "time_created_utc", "browser": "level", "sid": "computer", "title": "provider", "url": "channel", "profile": "event_id", "visit_count": "record_id"},
         macb="..C.", source="Browser", sourcetype="{browser} History", type="Visit", user_name="{sid}", short="Visited: {title}", descr="User visited URL {url} (Browser: {browser}, Profile: {profile}, VisitCount: {visit_count})", filename="{browser} History DB", extra="browser={browser};profile={profile};visit_count={visit_count}")
_adapter("timeline_downloads", tl.browser_downloads, {"start_time_utc": "time_created_utc", "browser": "level", "sid": "computer", "target_path": "channel", "url": "provider", "profile": "event_id", "total_bytes": "record_id"},
         macb="...B", source="Browser", sourcetype="{browser} Downloads", type="Downloaded", user_name="{sid}", short="Download: {base:target_path}", descr="Downloaded {target_path} from {url} (Browser: {browser}, Profile: {profile}, Size: {total_bytes} bytes)", filename="{browser} History DB", extra="browser={browser};profile={profile};total_bytes={total_bytes}")
_adapter("timeline_jump_lists", tl.jump_lists, {"last_accessed_utc": "time_created_utc", "lnk_modified_utc": "time_created_utc", "path": "channel", "sid": "computer", "type": "level", "app_id": "event_id"},
         {"last_accessed_utc": ("..C.", "Accessed"), "lnk_modified_utc": ("M...", "Modified")}, source="File", sourcetype="JumpList", user_name="{sid}", short="JumpList: {base:path}", descr="JumpList entry ({type}) appID {app_id} targets: {path}", filename="{type} DestList", extra="app_id={app_id};type={type}")
_adapter("timeline_master_file_table", tl.master_file_table, {"creation_time": "time_created_utc", "accessed_time": "time_created_utc", "filename": "provider"},
         {"creation_time": ("M...", "File Creation"), "accessed_time": ("M...", "File Accessed")}, source="FILE", sourcetype="mft_timeline.csv", user_name="-", host="-", short="{filename}", descr="$MFT Record: {filename}", format="")
_adapter("timeline_change_journal", tl.change_journal, {"timestamp": "time_created_utc", "filename": "provider", "reason": "channel"},
         macb="M...", source="USN", sourcetype="usn.csv", type="File Modified", user_name="-", host="-", short="{filename}", descr="USN Record: {filename} ({reason})", format="")


# --- detections ---------------------------------------------------------------------------------------------------

_SCALAR = "trim(regexp_replace(regexp_extract(coalesce(event_data, ''), '\"{0}\":\\s*(\"[^\"]*\"|[^\",}}][^,}}]*)', 1), '^\"|\"$', '', 'g'))"
_V4 = "regexp_full_match({0}, '(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){{3}}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)')"
_OUTSIDE = f"({_V4.format('ip')} AND NOT regexp_matches(ip, '^(?:10|127)\\.|^172\\.(?:1[6-9]|2\\d|3[01])\\.|^192\\.168\\.|^169\\.254\\.|^0\\.0\\.0\\.0$'))"


@query(f"""WITH f AS (SELECT {_SCALAR.format('IpAddress')} AS ip, lower({_SCALAR.format('TargetUserName')}) AS account FROM evtx_rows WHERE event_id = '4625'),
 a AS (SELECT ip, count(*) AS n, ip NOT IN ('', '-') AS named, {_OUTSIDE} AS outside FROM f GROUP BY ip),
 o AS (SELECT *, row_number() OVER (ORDER BY n DESC, ip) AS place FROM a WHERE named AND n >= 3)
 SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (named) AS n_addresses, (SELECT count(DISTINCT account) FROM f WHERE account <> '') AS n_accounts, CAST(coalesce(sum(n) FILTER (named AND outside), 0) AS BIGINT) AS external_fails,
 count(*) FILTER (named AND n >= 3) AS n_offenders, coalesce((SELECT string_agg(ip || '(' || n || CASE WHEN outside THEN ' [external]' ELSE '' END || ')', ', ' ORDER BY place) FROM o WHERE place <= 8), '') AS top,
 coalesce((SELECT ip FROM o WHERE place = 1), '') AS key, CASE WHEN coalesce(bool_or(named AND n >= 3 AND outside), FALSE) THEN 'HIGH' ELSE 'NOTABLE' END AS severity FROM a HAVING count(*) FILTER (named AND n >= 3) > 0 OR coalesce(sum(n) FILTER (named AND outside), 0) >= 50""")
def brute_force_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Failed logons in one row; three fails make an offender here."""
    return correlate.failed_logons(read_table(spark, sf, "evtx_rows"), "event_id", "event_data", per_address=3)


@query(f"""SELECT account, ip AS address, logon_type, count(*) AS n, contains(lower(account), 'admin') AS privileged FROM (SELECT {_SCALAR.format('TargetUserName')} AS account, {_SCALAR.format('IpAddress')} AS ip, {_SCALAR.format('LogonType')} AS logon_type
 FROM evtx_rows WHERE event_id = '4624') WHERE {_OUTSIDE} GROUP BY ALL""")
def success_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Successful logons from outside by three keys."""
    return correlate.external_logons(read_table(spark, sf, "evtx_rows"), "event_id", "event_data")


_SET = "coalesce(nullif(list_aggregate(list_sort(list_distinct(list({0}) FILTER (coalesce({0}, '') <> ''))), 'string_agg', ', '), ''), '-')"


@query(f"""SELECT base, 'HIGH' AS triage, count(*) AS n, {_SET.format('method')} AS methods, {_SET.format('client_ip')} AS clients, min(datetime_utc) AS first_seen, max(datetime_utc) AS last_seen
 FROM (SELECT *, {_BASE.format("coalesce(uri_stem, '')")} AS base FROM iis_requests) WHERE lower(base) IN (SELECT name FROM {_SHELLS}) GROUP BY base""")
def flagged_access(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to flagged files, by file."""
    flagged = _shells(spark, sf).select("filename", F.lit("HIGH").alias("triage"), F.lit(1).alias("seq"))
    return correlate.flagged_access(read_table(spark, sf, "iis_requests"), flagged)


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""SELECT uri_stem, count(*) AS n, {_SET.format('token')} AS tokens FROM (SELECT coalesce(uri_stem, '') AS uri_stem, unnest(list_filter({_LIST(correlate.PROGRAM_TOKENS)}, lambda t: contains(lower(uri_query), t))) AS token FROM iis_requests
 WHERE coalesce(uri_query, '') <> '' AND lower(regexp_extract({_BASE.format("coalesce(uri_stem, '')")}, '(\\.[^.]*)$', 1)) IN ({', '.join(f"'{x}'" for x in correlate.SCRIPT_EXTENSIONS)})) GROUP BY uri_stem""")
def token_pair_count(spark: SparkSession, sf: str) -> DataFrame:
    """Program names in queries, by path."""
    return correlate.program_tokens(read_table(spark, sf, "iis_requests"))


@query(f"""SELECT client_ip, count(*) AS n, {_SET.format("lower(coalesce(uri_stem, ''))")} AS stems, min(datetime_utc) AS first_seen, max(datetime_utc) AS last_seen FROM iis_requests WHERE contains(lower(coalesce(uri_stem, '')), '/admin/') AND NOT contains(lower(coalesce(uri_stem, '')), '.css')
 AND lower(coalesce(username, '')) IN ('', 'anonymous') AND lower(coalesce(client_ip, '')) NOT IN ('', '127.0.0.1', '::1') AND NOT starts_with(lower(client_ip), 'fe80') GROUP BY client_ip""")
def anon_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Anonymous requests to one endpoint, by client."""
    return correlate.anonymous_access(read_table(spark, sf, "iis_requests"), "/admin/", ".css")


@query("""SELECT CASE WHEN coalesce(client_ip, '') = '' THEN '-' ELSE client_ip END AS client, count(*) AS n, arg_min(uri_query, request_id) AS sample, min(datetime_utc) AS first_seen, max(datetime_utc) AS last_seen
 FROM iis_requests WHERE contains(lower(coalesce(uri_stem, '')), '.as') AND (contains(lower(coalesce(uri_query, '')), 'page=') OR contains(lower(coalesce(uri_query, '')), 'v=b')) GROUP BY 1""")
def first_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with tokens, by client, with the first query."""
    return correlate.first_sample(read_table(spark, sf, "iis_requests"), ".as", ("page=", "v=b"))


@query(f"""SELECT uri_stem, segment, count(*) AS n FROM (SELECT uri_stem, list_filter({_LIST(correlate.UPLOAD_SEGMENTS)}, lambda s: contains(lower(uri_stem), '/' || s || '/') OR starts_with(lower(uri_stem), s || '/'))[1] AS segment FROM iis_requests) WHERE segment IS NOT NULL GROUP BY ALL""")
def upload_dir_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """Files below an upload folder, with the segment that says so."""
    rows = read_table(spark, sf, "iis_requests").select("uri_stem", correlate.upload_segment(F.col("uri_stem")).alias("segment")).where("segment is not null")
    return rows.groupBy("uri_stem", "segment").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT lower(p_name) AS low, min(p_partkey) AS seq, arg_min(p_name, p_partkey) AS name FROM part WHERE p_name <> '' GROUP BY 1)
 SELECT min(a.name) AS name, arg_min(b.name, b.seq) AS twin FROM n a JOIN n b ON a.low <> b.low AND (levenshtein(a.low, b.low) = 1 OR (starts_with(a.low, b.low) AND length(a.low) - length(b.low) BETWEEN 1 AND 2) OR (starts_with(b.low, a.low) AND length(b.low) - length(a.low) BETWEEN 1 AND 2)) GROUP BY a.low""")
def lookalike_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that could be taken for another."""
    return correlate.lookalikes(read_table(spark, sf, "part"), "p_name", "p_partkey")


@query("""SELECT c_custkey AS key, 'no orders' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_orderkey, 'no customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT o_orderkey, 'bound' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of either table without partner, and those with one."""
    filters = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.lit("q").alias("query"))
    orders = read_table(spark, sf, "orders")
    bindings = orders.select(F.col("o_custkey").cast("string").alias("filter_name"), F.lit("Order").alias("consumer_class"), F.col("o_orderkey").cast("string").alias("consumer_name"))
    consumers = orders.select(F.lit("ORDER").alias("class"), F.col("o_orderkey").cast("string").alias("name"), F.lit("a").alias("action"))
    rows = correlate.bound_consumers(filters, bindings, consumers)
    state = F.when(F.col("state") == "orphan filter", "no orders").when(F.col("state") == "orphan consumer", "unbound").when(F.col("query").isNull(), "no customer").otherwise("bound")
    return rows.select(F.when(F.col("state") == "orphan filter", F.col("filter_name")).otherwise(F.col("consumer_name")).cast("long").alias("key"), state.alias("state"))


@query("""SELECT u.clsid, u.wow64, u.module_path, m.module_path AS machine_path, m.clsid IS NOT NULL AS in_machine, m.clsid IS NULL OR lower(trim(u.module_path)) <> lower(trim(m.module_path)) AS differs FROM (SELECT 'k' || l_orderkey AS clsid, l_linestatus AS wow64, l_returnflag AS module_path FROM lineitem) u
 LEFT JOIN (SELECT 'K' || o_orderkey AS clsid, 'F' AS wow64, o_orderstatus AS module_path FROM orders) m ON upper(u.clsid) = m.clsid AND u.wow64 = m.wow64""")
def shadow_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows beside the rows that they shadow."""
    user = read_table(spark, sf, "lineitem").select(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("clsid"), F.col("l_linestatus").alias("wow64"), F.col("l_returnflag").alias("module_path"))
    machine = read_table(spark, sf, "orders").select(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("clsid"), F.lit("F").alias("wow64"), F.col("o_orderstatus").alias("module_path"))
    return correlate.shadowed_servers(user, machine)


@query("""SELECT o_orderkey, o_custkey, coalesce((SELECT l_returnflag FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber, l_returnflag LIMIT 1), '') AS first_flag FROM orders""")
def chain_first(spark: SparkSession, sf: str) -> DataFrame:
    """Each parent with the value at its least index."""
    chain = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_returnflag").alias("i"), F.col("l_returnflag").alias("first_flag"))
    return correlate.first_of_chain(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), chain, "o_orderkey", "i", "first_flag")


# --- sequences ----------------------------------------------------------------------------------------------------

_EV = "(SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL)"
_PLACE = "CASE WHEN event_type = '{0}' THEN us END"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select("user_id", "event_id", "event_type", micros(e, "ts").alias("us"))


@query(f"""SELECT user_id, event_id, f_id AS first_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN us END IGNORE NULLS) OVER w AS f, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS f_id,
 last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS p_id, last_value(CASE WHEN event_type = 'error' THEN us END IGNORE NULLS) OVER w AS p FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 WHERE event_type = 'error' AND f IS NOT NULL AND us - f <= 36000000000 AND (p IS NULL OR f > p OR (f = p AND f_id > p_id))""")
def seq_backward_consume(spark: SparkSession, sf: str) -> DataFrame:
    """Errors within ten hours of a click that no error came before."""
    found = sequences.preceded(_events(spark, sf), "us", "event_id", F.col("event_type") == "click", F.col("event_type") == "error", "user_id", 36_000_000_000)
    return found.select("user_id", "event_id", F.col("first_seq").alias("first_id"))


@query(f"""SELECT user_id, event_id, n_id AS next_id FROM (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN us END IGNORE NULLS) OVER w AS n, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS n_id
 FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE event_type = 'error' AND n IS NOT NULL AND n - us <= 36000000000""")
def seq_forward_consume(spark: SparkSession, sf: str) -> DataFrame:
    """Errors with a purchase within the next ten hours."""
    found = sequences.followed(_events(spark, sf), "us", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase", "user_id", 36_000_000_000)
    return found.select("user_id", "event_id", F.col("second_seq").alias("next_id"))


# --- scalars ------------------------------------------------------------------------------------------------------


@query(f"SELECT record_id, {_SCALAR.format('LogonType')} AS scalar, coalesce(CASE WHEN json_type(j, '$.LogonType') = 'VARCHAR' THEN j->>'$.LogonType' END, '') AS text FROM (SELECT *, TRY_CAST(event_data AS JSON) AS j FROM evtx_rows)")
def event_json_field(spark: SparkSession, sf: str) -> DataFrame:
    """A member of event data, read as text and as JSON."""
    data = F.coalesce("event_data", F.lit(""))
    return read_table(spark, sf, "evtx_rows").select("record_id", correlate.json_scalar(data, "LogonType").alias("scalar"), tl.json_text(data, "LogonType").alias("text"))


_TOKENS = lambda xs: f"list_filter({_LIST(xs)}, lambda t: contains(lower(coalesce(text, '')), t))"
_STRONG, _WEAK = ("mshta.exe", "regsvr32.exe"), ("curl.exe", "powershell.exe", "hash")


@query(f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS strong, CAST(len(w) AS INTEGER) AS weak, coalesce(list_aggregate(list_concat(s, w), 'string_agg', '|'), '') AS indicators, CASE WHEN len(s) > 0 THEN 'HIGH' WHEN len(w) > 1 THEN 'NOTABLE' ELSE 'INFO' END AS triage
 FROM (SELECT doc_id, {_TOKENS(_STRONG)} AS s, {_TOKENS(_WEAK)} AS w FROM documents)""")
def triage_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Texts triaged by strong and weak tokens."""
    return triage.web_file_triage(read_table(spark, sf, "documents").select("doc_id", "text"), "text", _STRONG, _WEAK).select("doc_id", "strong", "weak", "indicators", "triage")


_BITS = ", ".join(f"CASE WHEN (m & {bit}) <> 0 THEN '{name}' END" for bit, name in triage.USN_REASONS.items())
_REST = 0xFFFFFFFF & ~reduce(lambda a, b: a | b, triage.USN_REASONS)


@query(f"SELECT o_orderkey, concat_ws('|', {_BITS}, CASE WHEN (m & {_REST}) <> 0 THEN 'UNKNOWN(0x' || to_hex(m & {_REST}) || ')' END) AS reason FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS m FROM orders)")
def usn_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    """Masks as the names of their bits."""
    return read_table(spark, sf, "orders").select("o_orderkey", triage.usn_reasons(F.expr("o_orderkey * 2654435761L % 4294967296L")).alias("reason"))


@query("""SELECT event_id, CASE WHEN regexp_matches(coalesce(short, ''), '^[=+\\-@\\t\\r]') THEN '''' || short ELSE coalesce(short, '') END AS csv, translate(coalesce(filename, ''), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS turned,
 regexp_extract(coalesce(descr, ''), '([^\\\\/]*)[\\\\/]*$', 1) AS base, regexp_replace(coalesce(filename, ''), '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM timeline""")
def string_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Cells for export, turned letters, base names, safe names."""
    t = read_table(spark, sf, "timeline")
    text = lambda c: F.coalesce(c, F.lit(""))
    return t.select("event_id", triage.csv_safe(text("short")).alias("csv"), triage.rot13(text("filename")).alias("turned"), tl.base_name(text("descr")).alias("base"), triage.safe_name(text("filename")).alias("safe"))


@query(f"SELECT request_id, {_BASE.format(chr(99) + 'oalesce(uri_stem, ' + chr(39) * 2 + ')')} AS base, lower(regexp_extract({_BASE.format(chr(99) + 'oalesce(uri_stem, ' + chr(39) * 2 + ')')}, '(\\.[^.]*)$', 1)) AS extension FROM iis_requests")
def uri_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Base names and extensions of request paths."""
    base = tl.uri_base(F.coalesce("uri_stem", F.lit("")))
    return read_table(spark, sf, "iis_requests").select("request_id", base.alias("base"), F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)).alias("extension"))


@query("SELECT o_orderkey, make_timestamp((130000000000000000 + o_orderkey * 12345678901) // 10 - 11644473600000000) AS from_filetime, make_timestamp(13000000000000000 + o_orderkey * 1234567 - 11644473600000000) AS from_webkit FROM orders")
def time_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Times that count from 1601."""
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", triage.filetime(F.expr("130000000000000000L + o_orderkey * 12345678901L")).cast("timestamp_ntz").alias("from_filetime"), triage.webkit_time(F.expr("13000000000000000L + o_orderkey * 1234567L")).cast("timestamp_ntz").alias("from_webkit"))


# --- indicators ---------------------------------------------------------------------------------------------------

_REFANG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)hxxps://', 'https://', 'g'), '(?i)hxxp://', 'http://', 'g'), '\\[\\.\\]|\\(\\.\\)', '.', 'g'), '\\[at\\]|\\(at\\)', '@', 'g')"


@query(f"SELECT doc_id, {_REFANG} AS text FROM documents")
def refang(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their addresses made whole."""
    return read_table(spark, sf, "documents").select("doc_id", ioc.refang(F.coalesce("text", F.lit(""))).alias("text"))


def _indicator(name: str, column: Callable, sql: str, where: str = "TRUE") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return read_table(spark, sf, "documents").select("doc_id", F.explode(column(ioc.refang(F.coalesce("text", F.lit(""))))).alias("value"))

    run.__name__ = name
    run.__doc__ = "Indicators of one kind, wherever they stand."
    query(f"SELECT doc_id, value FROM (SELECT doc_id, unnest({sql}) AS value FROM (SELECT doc_id, {_REFANG} AS t FROM documents)) WHERE {where}")(run)


_quoted = lambda p: "'" + p.replace("'", "''") + "'"
_indicator("ioc_url", ioc.urls, f"list_transform(regexp_extract_all(t, {_quoted(ioc.URL)}), lambda x: lower(regexp_replace(x, {_quoted(chr(91) + chr(34) + chr(39) + ').>,]+$')}, '')))")
_indicator("ioc_ipv4", ioc.addresses, f"regexp_extract_all(t, {_quoted(ioc.DOTTED)})", f"{_V4.format('value')} AND NOT regexp_matches(value, '^(?:10|127)\\.|^172\\.(?:1[6-9]|2\\d|3[01])\\.|^192\\.168\\.|^169\\.254\\.|^0\\.0\\.0\\.0$|^255\\.255\\.255\\.255$')")
for _n in (32, 40, 64):
    _indicator(f"ioc_hash_{_n}", lambda t, n=_n: ioc.hashes(t, n), f"list_transform(regexp_extract_all(t, '\\b[a-fA-F0-9]{{{_n}}}\\b'), lambda x: lower(x))")
_indicator("ioc_domain", ioc.domains, f"list_transform(regexp_extract_all(t, {_quoted(ioc.DOMAIN)}), lambda x: lower(x))",
           f"regexp_extract(value, '([^.]*)$', 1) NOT IN ({', '.join(map(_quoted, ioc.NOT_DOMAINS))}) AND regexp_extract(value, '([^.]*\\.[^.]*)$', 1) NOT IN ({', '.join(map(_quoted, ioc.BENIGN_DOMAINS))})")


@query(ORACLE_SQL["ioc_ipv4"].replace("SELECT doc_id, value", "SELECT value, count(*) AS n, min(doc_id) AS first_doc", 1) + " GROUP BY value")
def ioc_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Each address once, with the first text that has it."""
    return QUERIES["ioc_ipv4"](spark, sf).groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query()
def ioc_full(spark: SparkSession, sf: str) -> DataFrame:
    """All indicators of all texts, by position and precedence."""
    return ioc.indicators(read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"), "source", "text")


@query()
def stix_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The indicators as STIX objects."""
    return ioc.stix_objects(ioc_full(spark, sf))


_EVERY = ", ".join((
    *(f"list_transform(list_transform(regexp_extract_all(t, {_quoted(p)}), lambda x: {v}), lambda x: struct_pack(type := '{k}', value := x))" for k, p, v in (
        ("url", ioc.URL, f"lower(regexp_replace(x, {_quoted(chr(91) + chr(34) + chr(39) + ').>,]+$')}, ''))"),
        *(("file", rf"\b[a-fA-F0-9]{{{n}}}\b", "lower(x)") for n in (64, 40, 32)),
    )),
    f"list_transform(list_filter(regexp_extract_all(t, {_quoted(ioc.DOTTED)}), lambda x: {_V4.format('x')} AND NOT regexp_matches(x, '^(?:10|127)\\.|^172\\.(?:1[6-9]|2\\d|3[01])\\.|^192\\.168\\.|^169\\.254\\.|^0\\.0\\.0\\.0$|^255\\.255\\.255\\.255$')), lambda x: struct_pack(type := 'ipv4-addr', value := x))",
    f"list_transform(list_filter(list_transform(regexp_extract_all(t, {_quoted(ioc.DOMAIN)}), lambda x: lower(x)), lambda x: regexp_extract(x, '([^.]*)$', 1) NOT IN ({', '.join(map(_quoted, ioc.NOT_DOMAINS))}) AND regexp_extract(x, '([^.]*\\.[^.]*)$', 1) NOT IN ({', '.join(map(_quoted, ioc.BENIGN_DOMAINS))})), lambda x: struct_pack(type := 'domain-name', value := x))",
))


@query(f"""SELECT DISTINCT d.doc_id, d.i.type AS type, d.i.value AS value FROM (SELECT doc_id, unnest(flatten([{_EVERY}])) AS i FROM (SELECT doc_id, {_REFANG} AS t FROM documents)) d
 SEMI JOIN (SELECT unnest(flatten([{_EVERY}])) AS i FROM (SELECT {_REFANG.replace('text', 'event_data')} AS t FROM evtx_rows)) p ON d.i = p.i""")
def ioc_match_any(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold an indicator of the event log, wherever it stands in either."""
    text = ioc.refang(F.coalesce("event_data", F.lit("")))
    packs = read_table(spark, sf, "evtx_rows").select(F.explode(ioc.every_indicator(text)).alias("i")).select("i.*").distinct()
    return ioc.match_evidence(read_table(spark, sf, "documents").select("doc_id", "text"), "text", packs).select("doc_id", "type", "value").distinct()


@query()
def scheduled_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The exported tasks as one flat table."""
    return tasks.scheduled_tasks(read_table(spark, sf, "task_xml"), "record_id", "xml_text")


@query()
def ioc_match(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold an indicator found in the event log."""
    packs = ioc.indicators(read_table(spark, sf, "evtx_rows").select(F.col("record_id").cast("string").alias("source"), F.col("event_data").alias("text")), "source", "text").select("type", "value")
    return ioc.match_evidence(read_table(spark, sf, "documents").select("doc_id", "text"), "text", packs).select("doc_id", "type", "value")


# --- views of any table -------------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE lower(coalesce(CAST(o_orderpriority AS VARCHAR), '')) IN ('1-urgent', '5-low') AND (" + " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), '77')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")
def artifact_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A table filtered by values of one column and a text in any cell."""
    o = read_table(spark, sf, "orders")
    q = search.ArtifactQuery("o_orderpriority", ("1-URGENT ", "5-low"), "77")
    return o.where(q.condition(o.columns))


@query("""SELECT record_id, event_id, level, computer FROM evtx_rows ORDER BY CASE WHEN TRY_CAST(coalesce(event_data, '') AS DOUBLE) IS NULL THEN 1 ELSE 0 END, TRY_CAST(coalesce(event_data, '') AS DOUBLE), lower(coalesce(event_data, '')), record_id LIMIT 200 OFFSET 400""")
def artifact_sort_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a table sorted by a column of any text."""
    page = search.artifact_page(read_table(spark, sf, "evtx_rows"), search.ArtifactQuery(), "event_data", offset=400, tie=("record_id",))
    return page.select("record_id", "event_id", "level", "computer")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {x: read_table(spark, sf, x) for x in ("customer", "supplier", "part", "nation", "region", "timeline", "evtx_rows", "documents")}


_SEARCH_COLUMNS = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "region": ("r_regionkey", "r_name"),
    "timeline": ("event_id", "date", "time", *_TEXTS), "evtx_rows": ("record_id", "time_created_utc", "event_id", "provider", "channel", "computer", "level", "event_data"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars", "collected_at"),
}
_KEYS = {t: columns[0] for t, columns in _SEARCH_COLUMNS.items()}
_HAS = {t: " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), 'ma')" for c in cols) for t, cols in _SEARCH_COLUMNS.items()}


@query(" UNION ALL ".join(f"SELECT '{t}' AS artifact, total, place FROM (SELECT CAST({_KEYS[t]} AS BIGINT) AS place, count(*) OVER () AS total, row_number() OVER (ORDER BY {_KEYS[t]}) AS i FROM {t} WHERE {has}) WHERE i <= 50" for t, has in _HAS.items()) + " ORDER BY total DESC, artifact, place")
def search_all_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A text in all tables: the first rows of each, and how many there are."""
    return search.search_all(_tables(spark, sf), "MA", _KEYS).select("artifact", "total", "place")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS artifact, count(*) AS total FROM {t} WHERE {has}" for t, has in _HAS.items()) + ") WHERE total > 0")
def search_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How often a text comes in each table."""
    return search.search_totals(_tables(spark, sf), "ma")


@query(" UNION ALL ".join(f"SELECT '{t}' AS artifact, count(*) AS n FROM {t}" for t in ("customer", "supplier", "part", "nation", "region", "timeline", "evtx_rows", "documents")))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each table."""
    return search.row_counts(_tables(spark, sf))


@query("SELECT DISTINCT source, CASE WHEN source = '' THEN 'Root' WHEN source = 'mft' OR starts_with(source, 'mft_') THEN 'File System' ELSE array_to_string(list_transform(string_split(replace(source, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label FROM documents WHERE source IS NOT NULL")
def folder_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Folder names for reading."""
    return read_table(spark, sf, "documents").where("source is not null").select("source", search.folder_label(F.col("source")).alias("label")).distinct()


@query("""SELECT coalesce(m.path, f.path) AS path, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' WHEN expected = actual THEN 'ok' ELSE 'mismatch' END AS status
 FROM (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS expected FROM documents WHERE lang IS NOT NULL) m FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(replace(coalesce(text, ''), chr(10) || chr(10), chr(10))) AS actual FROM documents WHERE n_chars > 0) f ON m.path = f.path""")
def manifest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest beside what is there."""
    d = read_table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    manifest = d.where("lang is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2(text, 256).alias("sha256"))
    files = d.where("n_chars > 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.replace(text, F.lit("\n\n"), F.lit("\n")), 256).alias("sha256"))
    return integrity.reconcile(manifest, files)


@query("SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'failed' ELSE 'ok' END AS status FROM (" + ORACLE_SQL["manifest_reconcile"] + ")")
def manifest_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of the reconciliation."""
    return integrity.verdict(manifest_reconcile(spark, sf))


@query("SELECT upper(trim(o_orderpriority)) AS tier, count(*) AS n FROM orders GROUP BY 1")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each tier."""
    return triage.tier_counts(read_table(spark, sf, "orders"), "o_orderpriority")
