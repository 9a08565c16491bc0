"""Queries of the general data problems (p1, p2, p4, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.net import canonical_address
from evidra.functions.times import micros, show_seconds
from evidra.operators.drift import layout_changes, union_rows, union_schema
from evidra.operators.malformed import checked_lines
from evidra.operators.nested import task_items
from evidra.operators.packed import unpack
from evidra.operators.sessions import sessions
from evidra.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of the log layout: site, source_log, line_no, field, change."""
    return layout_changes(read_table(spark, sf_dir, "iis_log_lines"))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loadable log lines as one table with the columns of iis_requests, line_no and the fields that layouts add."""
    return union_rows(checked_lines(read_table(spark, sf_dir, "iis_log_lines")).where("reason is null"))


def p1_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union schema of each site's layouts: site, field, form, type, n_layouts."""
    return union_schema(read_table(spark, sf_dir, "iis_log_lines"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data lines that fail to parse: site, source_log, line_no, reason."""
    return checked_lines(read_table(spark, sf_dir, "iis_log_lines")).where("reason is not null").select("site", "source_log", "line_no", "reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of exported tasks: record_id, task_no, section, parent_position, position, item."""
    return task_items(read_table(spark, sf_dir, "task_xml"), "record_id", "xml_text")


#: Fixed names: the packed members of event data; only group names hold blanks.
PACKED_MEMBERS = ("PrivilegeList", "AccessList", "UserAccountControl", "Hashes", "GroupMembership")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each packed value in a row of its own: origin, row_id, field, position, value. Of rows with one id one counts (the greatest text)."""
    extra = read_table(spark, sf_dir, "timeline").select(F.lit("timeline").alias("origin"), F.col("event_id").alias("row_id"), F.lit("extra").alias("field"), F.col("extra").alias("text"))
    events = read_table(spark, sf_dir, "evtx_rows").select("record_id", F.try_parse_json("event_data").alias("v"))
    member = [F.struct(F.lit(x).alias("field"), F.try_variant_get("v", f"$.{x}", "string").alias("text")) for x in PACKED_MEMBERS]
    members = events.where("v is not null").select(F.lit("evtx_rows").alias("origin"), F.col("record_id").alias("row_id"), F.explode(F.array(*member)).alias("m")).select("origin", "row_id", "m.*")
    packed = extra.unionByName(members).where("row_id is not null and text is not null and trim(text) not in ('', '-')")
    packed = packed.groupBy("origin", "row_id", "field").agg(F.max("text").alias("text"))
    blanks = (F.col("origin") != "timeline") & (F.col("field") != "GroupMembership")
    return unpack(packed.withColumn("blanks", blanks), "text", "blanks")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each client: client_ip, session_start, session_end, n_requests."""
    requests = read_table(spark, sf_dir, "iis_requests")
    requests = requests.select(canonical_address(F.col("client_ip")).alias("client_ip"), micros(requests, "datetime_utc").alias("us"), "request_id")
    found = sessions(requests, "client_ip", "us", "request_id")
    return found.select("client_ip", show_seconds("start_us").alias("session_start"), show_seconds("end_us").alias("session_end"), F.col("n_events").alias("n_requests"))


QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p1_schema": p1_schema, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found, "p5_found": p5_found}

# --- the same in SQL, as far as SQL can say it; addresses as the test tables spell them ------------------------------

_FIRST = r"regexp_replace(split_part(client_ip, ',', 1), '^\s+|\s+$', '', 'g')"
_CLIENT = rf"""nullif(nullif(regexp_replace(lower(CASE WHEN regexp_matches({_FIRST}, '^\[.*\](:\d+)?$') THEN regexp_extract({_FIRST}, '^\[(.*)\]', 1) WHEN regexp_matches({_FIRST}, '^[0-9.]+:\d+$') THEN split_part({_FIRST}, ':', 1) ELSE {_FIRST} END), '^::ffff:(\d+\.\d+\.\d+\.\d+)$', '\1'), ''), '-')"""
_PLAIN = r"CASE WHEN contains(x, ':') THEN regexp_replace(x, '(^|:)0+([0-9a-f])', '\1\2', 'g') ELSE x END"
_RUN = "(?:^|:)0(?::0){{{0}}}(?::|$)"
_SHORT = "CASE WHEN NOT contains(y, ':') OR contains(y, '::') THEN y " + " ".join(f"WHEN regexp_matches(y, '{_RUN.format(k)}') THEN regexp_replace(y, '^(.*?){_RUN.format(k)}(.*)$', '\\1::\\2')" for k in range(7, 0, -1)) + " ELSE y END"


def _pieces(text: str, delimiters: str) -> str:
    """The values of a packed text as a list."""
    cells = rf"""regexp_extract_all({text}, '(?:"(?:[^"]|"")*"|[^{delimiters}"])+')"""
    bare = r"""trim(replace(replace(replace(regexp_replace(trim(c, ' '), '(^|=)""$', '\1'), '""', chr(1)), '"', ''), chr(1), '"'), ' ')"""
    return f"list_filter(list_transform({cells}, lambda c: {bare}), lambda c: c <> '')"


_DELIMITERS = r";,|\t\r\n"
_MEMBERS = " UNION ALL ".join(
    f"SELECT 'evtx_rows' AS origin, record_id AS row_id, '{x}' AS field, {_pieces('text', _DELIMITERS + ('' if x == 'GroupMembership' else ' '))} AS vs FROM (SELECT record_id, max(j->>'$.{x}') AS text FROM e GROUP BY record_id) WHERE text IS NOT NULL AND trim(text) NOT IN ('', '-')" for x in PACKED_MEMBERS
)
ORACLE_SQL = {
    "p5_found": f"""WITH r AS (SELECT DISTINCT {_SHORT} AS c, t, request_id FROM (SELECT {_PLAIN} AS y, t, request_id FROM (SELECT {_CLIENT} AS x, datetime_utc AS t, request_id FROM iis_requests))), o AS (SELECT *, lag(t) OVER w AS before FROM r WHERE c IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY c ORDER BY t, request_id)),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t, request_id) AS i FROM o)
 SELECT c AS client_ip, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_requests FROM g GROUP BY c, i""",
    "p6_found": f"""WITH e AS (SELECT record_id, TRY_CAST(event_data AS JSON) AS j FROM evtx_rows WHERE TRY_CAST(event_data AS JSON) IS NOT NULL),
 p AS (SELECT 'timeline' AS origin, event_id AS row_id, 'extra' AS field, {_pieces('text', _DELIMITERS)} AS vs FROM (SELECT event_id, max(extra) AS text FROM timeline GROUP BY event_id) WHERE text IS NOT NULL AND trim(text) NOT IN ('', '-') UNION ALL {_MEMBERS})
 SELECT origin, row_id, field, CAST(unnest(range(1, len(vs) + 1)) AS INTEGER) AS position, unnest(vs) AS value FROM p""",
}
