"""Queries of the training-text problems (p3, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm.leaks import leaks
from evidra.llm.runs import timeline_runs
from evidra.llm.spam import spam_scores
from evidra.llm.tokens import encode_corpus
from evidra.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more like events: first_event_id, n_events."""
    return timeline_runs(read_table(spark, sf_dir, "timeline")).where("n_events > 1").select("first_event_id", "n_events")


def p3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more events that share most of their words, none an hour after the one before: first_event_id, n_events."""
    return timeline_runs(read_table(spark, sf_dir, "timeline"), least=0.7, gap=3600 * 10**9).where("n_events > 1").select("first_event_id", "n_events")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k: doc_id, ids."""
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation items that leaked into each document: doc_id, item_id."""
    return leaks(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that are keyword, link, tag or product spam: doc_id."""
    return spam_scores(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source").where("score > 0.5").select("doc_id")


QUERIES = {"p3_found": p3_found, "p3_near": p3_near, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
_NUMBER = r"(?:0x[0-9a-f]+|[0-9a-f]*[0-9][0-9a-f]*|[0-9a-f]{12})\b"
_SQUEEZED = r"trim(regexp_replace(lower(coalesce({0}, '')), '[\s\x{{a0}}]+', ' ', 'g'), ' ')"
_READING = _SQUEEZED.format("short")
for _pattern, _to in ((r"\{?\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b\}?", "#"), (rf"\b(pid|tid|process|thread|handle|session|attempt)( ?id| ?no\.?| ?number)?([ =:#]*){_NUMBER}", r"\1 #"), (r"(~[a-z]*?|\btmp)[0-9a-f]{4}(\.tmp\b)", r"\1#\2"), (r"\d+(\.tmp\b)", r"#\1")):
    _READING = f"regexp_replace({_READING}, '{_pattern}', '{_to}', 'g')"
_HOST = r"lower(regexp_replace(host, '^\s+|\s+$', '', 'g'))"
_DAY = "replace(date, '/', '-')"

#: Queries that SQL can say as well.
ORACLE_SQL: dict[str, str] = {
    "p3_found": f"""WITH t AS (SELECT DISTINCT event_id, {_HOST} AS h, {_DAY} AS d, rpad(replace(time, '.', ''), 20, '0') AS m, {_SQUEEZED.format("sourcetype")} || chr(31) || {_READING} AS reads FROM timeline
 WHERE host IS NOT NULL AND {_HOST} NOT IN ('', '-') AND date IS NOT NULL AND {_DAY} <> '1970-01-01'), o AS (SELECT *, lag(reads) OVER w AS before FROM t WINDOW w AS (PARTITION BY h ORDER BY d, m, event_id)),
 g AS (SELECT *, sum(CASE WHEN before = reads THEN 0 ELSE 1 END) OVER (PARTITION BY h ORDER BY d, m, event_id) AS i FROM o)
 SELECT arg_min(event_id, (d, m, event_id)) AS first_event_id, count(*) AS n_events FROM g GROUP BY h, i HAVING count(*) > 1""",
}
