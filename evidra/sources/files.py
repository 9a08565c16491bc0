"""Text, CSV, JSON and SQLite evidence as DataFrames."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BROKEN = "_broken"
#: A mark that no cell has, so that empty cells are not read as null.
_NO_NULL = "\x01"


def _broken_lines(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether a line of the files has an odd number of quotes, as lines have whose cells hold line breaks."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text([*paths]).where(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, paths: str | Sequence[str], strict: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV files as strings by the names of their headers, missing cells empty.

    Rows shorter than the header are left out if `strict` (rules and the timeline) and kept otherwise (search and
    pages); longer ones are cut. Quotes are doubled inside quotes. Files with other headers than the first are put below
    it by name. Cells may hold line breaks: if a look at the lines finds any (or `multi_line` says so) a file is read by
    one task; otherwise large files are split.
    """
    some = [paths] if isinstance(paths, str) else [*paths]
    multi_line = _broken_lines(spark, some) if multi_line is None else multi_line
    headers: dict[tuple[str, ...], list[str]] = {}
    for p in some:
        headers.setdefault(tuple(spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(p).columns), []).append(p)
    parts = [_read_alike(spark, own, header, strict, multi_line) for header, own in headers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).na.fill("") if len(parts) > 1 else parts[0]


def _read_alike(spark: SparkSession, paths: list[str], header: Sequence[str], strict: bool, multi_line: bool) -> DataFrame:
    """CSV files of one header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField(_BROKEN, T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").option("columnPruning", False)
    rows = reader.option("columnNameOfCorruptRecord", _BROKEN).option("nullValue", _NO_NULL).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths)
    if strict:
        rows = rows.where(F.col(_BROKEN).isNull() | F.col(f"`{header[-1]}`").isNotNull())
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header))


def short_rows(spark: SparkSession, path: str, multi_line: bool | None = None) -> int:
    """How many rows of a CSV file are shorter than its header."""
    return read_csv(spark, path, False, multi_line).count() - read_csv(spark, path, True, multi_line).count()


def resolve(root: str, patterns: Sequence[str]) -> list[str]:
    """The files that literal names and patterns stand for, each once and in order; absent ones are no files."""
    found = [p for x in patterns for p in (sorted(glob.glob(os.path.join(root, x))) if any(c in x for c in "*?[") else [os.path.join(root, x)]) if os.path.isfile(p)]
    return [*dict.fromkeys(found)]


def read_source(spark: SparkSession, root: str, patterns: Sequence[str], strict: bool = True) -> DataFrame | None:
    """The rows of all files of a source by column name, with their source_file; None without files."""
    parts = [read_csv(spark, p, strict).withColumn("source_file", F.lit(os.path.basename(p))) for p in resolve(root, patterns)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).na.fill("") if parts else None


def artifact_tables(spark: SparkSession, root: str, strict: bool = False) -> dict[str, DataFrame]:
    """All CSV tables below a folder, by their path without extension."""
    paths = sorted(glob.glob(os.path.join(root, "**", "*.csv"), recursive=True))
    return {os.path.relpath(p, root)[:-4].replace(os.sep, "/"): read_csv(spark, p, strict) for p in paths}


def read_lines(spark: SparkSession, files: Mapping[str, Sequence[str]]) -> DataFrame:
    """Log files as collected: site, source_log, line_no, raw_line. `files` has the paths of each site; one task reads one file, line by line."""
    rows = [(site, os.path.basename(p), p) for site, paths in files.items() for p in paths]
    if not rows:
        return spark.createDataFrame([], "site string, source_log string, line_no int, raw_line string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for site, log, path in batch.itertuples(index=False):
                with open(path, encoding="utf-8", errors="replace", newline="\n") as f:
                    held: list[str] = []
                    first = 1
                    for line in f:
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 50_000:
                            yield pd.DataFrame({"site": site, "source_log": log, "line_no": range(first, first + len(held)), "raw_line": held})
                            first, held = first + len(held), []
                    if held:
                        yield pd.DataFrame({"site": site, "source_log": log, "line_no": range(first, first + len(held)), "raw_line": held})

    return spark.createDataFrame(rows, "site string, source_log string, path string").repartition(len(rows)).mapInPandas(read, "site string, source_log string, line_no int, raw_line string")


def channel_name(path: Column) -> Column:
    """The channel that an event-log file name stands for."""
    base = F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return F.replace(base, F.lit("%4"), F.lit("_"))


def first_of_channel(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the first file (by path) of each channel; files are few, and only their names are compared."""
    first = rows.select(F.col(path).alias("_p")).distinct().groupBy(channel_name(F.col("_p"))).agg(F.min("_p").alias("_p")).select("_p")
    return rows.join(first, F.col(path) == F.col("_p"), "left_semi")


def format_list(text: Column) -> Column:
    """The records of a Format-List text as an array of maps: blank lines part records, `Key : value` names a field, indented lines go on with it."""
    records = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n\s*")
    pairs = r"(?m)^(\S[^:\n]*?)[ \t]*:[ \t]?(.*(?:\n[ \t]+\S.*)*)$"

    def record(r: Column) -> Column:
        clean = lambda v: F.trim(F.regexp_replace(v, r"\n[ \t]+", ""))
        keys = F.regexp_extract_all(r, F.lit(pairs), F.lit(1))
        values = F.transform(F.regexp_extract_all(r, F.lit(pairs), F.lit(2)), clean)
        last = F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.lit(True)))
        return F.when(F.size(keys) == F.size(F.array_distinct(keys)), last)

    return F.filter(F.transform(records, record), lambda m: m.isNotNull() & (F.size(F.map_keys(m)) > 0))


def sqlite_rows(spark: SparkSession, paths: Sequence[str], sql: str, schema: str) -> DataFrame:
    """The rows that a query gives in each SQLite file, opened read-only as it is, with the file's path. One task reads one file; a file that can't be read gives none."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
                    cursor = db.execute(sql)
                    while rows := cursor.fetchmany(20_000):
                        yield pd.DataFrame(rows, columns=names, dtype=object).assign(path=path)
                    db.close()
                except sqlite3.Error:
                    continue

    if not paths:
        return spark.createDataFrame([], f"{schema}, path string")
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(read, f"{schema}, path string")


#: Fixed queries of the browsers' files.
CHROMIUM_HISTORY = "SELECT url, title, visit_count, last_visit_time FROM urls"
FIREFOX_HISTORY = "SELECT url, title, visit_count, last_visit_date FROM moz_places WHERE visit_count > 0 OR last_visit_date IS NOT NULL"
CHROMIUM_COOKIES = "SELECT host_key, name, path, creation_utc, expires_utc, last_access_utc, is_secure, is_httponly, length(encrypted_value) > 0 FROM cookies"
FIREFOX_COOKIES = "SELECT host, name, path, creationTime, expiry, lastAccessed, isSecure, isHttpOnly, 0 FROM moz_cookies"
CHROMIUM_DOWNLOADS = "SELECT id, target_path, start_time, received_bytes, total_bytes, state FROM downloads"
CHROMIUM_CHAINS = "SELECT id, chain_index, url FROM downloads_url_chains"
FIREFOX_DOWNLOADS = """SELECT p.url, a.content, a.dateAdded, 0, 1 FROM moz_places p JOIN moz_annos a ON p.id = a.place_id JOIN moz_anno_attributes t ON a.anno_attribute_id = t.id
 WHERE t.name = 'downloads/destinationFileURI'"""
FIREFOX_OLD_DOWNLOADS = "SELECT source, target, startTime, totalBytes, state FROM moz_downloads"
_HISTORY = "url string, title string, visit_count long, at long"
_COOKIES = "host string, name string, cookie_path string, created long, expires long, accessed long, is_secure long, is_httponly long, has_encrypted_value long"


def browser_history(spark: SparkSession, chromium: Sequence[str], firefox: Sequence[str]) -> DataFrame:
    """Visits of both kinds of browser: browser, url, title, visit_count, last_visit_utc, path."""
    from evidra.operators.triage import webkit_time

    c = sqlite_rows(spark, chromium, CHROMIUM_HISTORY, _HISTORY).withColumn("last_visit_utc", F.when(F.col("at") > 0, webkit_time(F.col("at")))).withColumn("browser", F.lit("Chromium"))
    f = sqlite_rows(spark, firefox, FIREFOX_HISTORY, _HISTORY).withColumn("last_visit_utc", F.timestamp_micros("at")).withColumn("browser", F.lit("Firefox"))
    return c.unionByName(f).select("browser", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "visit_count", "last_visit_utc", "path")


def browser_cookies(spark: SparkSession, chromium: Sequence[str], firefox: Sequence[str]) -> DataFrame:
    """Cookies of both kinds of browser, their times in UTC."""
    from evidra.operators.triage import webkit_time

    times = ("created", "expires", "accessed")
    c = sqlite_rows(spark, chromium, CHROMIUM_COOKIES, _COOKIES).withColumns({x: F.when(F.col(x) > 0, webkit_time(F.col(x))) for x in times}).withColumn("browser", F.lit("Chromium"))
    f = sqlite_rows(spark, firefox, FIREFOX_COOKIES, _COOKIES).withColumns({"created": F.timestamp_micros("created"), "expires": F.timestamp_seconds("expires"), "accessed": F.timestamp_micros("accessed")}).withColumn("browser", F.lit("Firefox"))
    return c.unionByName(f).withColumn("has_encrypted_value", F.col("has_encrypted_value") == 1)


def browser_downloads(spark: SparkSession, chromium: Sequence[str], firefox: Sequence[str] = ()) -> DataFrame:
    """Downloads of both kinds of browser; of Chromium with the first address of their chain, those without chain are kept.

    Firefox keeps them as annotations of places (places.sqlite; all complete, without sizes) and formerly in a table of
    its own (downloads.sqlite); each file of `firefox` is read for both.
    """
    from evidra.operators.correlate import first_of_chain
    from evidra.operators.triage import webkit_time

    rows = sqlite_rows(spark, chromium, CHROMIUM_DOWNLOADS, "id long, target_path string, at long, received_bytes long, total_bytes long, state long")
    chain = sqlite_rows(spark, chromium, CHROMIUM_CHAINS, "id long, chain_index long, url string")
    key = F.struct("path", "id")
    joined = first_of_chain(rows.withColumn("k", key), chain.withColumn("k", key).select("k", "chain_index", "url"), "k", "chain_index", "url")
    state = F.when(F.col("state") == 1, "complete").when(F.col("state") == 2, "cancelled").when(F.col("state") == 4, "interrupted").otherwise("in progress")
    c = joined.select("target_path", "url", F.when(F.col("at") > 0, webkit_time(F.col("at"))).alias("start_time_utc"), "received_bytes", "total_bytes", state.alias("state"), "path")
    kind = "url string, target string, at long, total_bytes long, state long"
    f = sqlite_rows(spark, firefox, FIREFOX_DOWNLOADS, kind).unionByName(sqlite_rows(spark, firefox, FIREFOX_OLD_DOWNLOADS, kind))
    local = F.translate(F.regexp_replace("target", "(?i)^file:///", ""), "/", "\\")
    target = F.when(F.col("target").rlike("(?i)^file:///"), local).otherwise(F.coalesce("target", F.lit("")))
    state = F.when(F.col("state") == 0, "in progress").when(F.col("state") == 1, "complete").when(F.col("state") == 2, "cancelled").when(F.col("state") == 3, "failed").otherwise("unknown")
    f = f.select(target.alias("target_path"), F.coalesce("url", F.lit("")).alias("url"), F.when(F.col("at") > 0, F.timestamp_micros("at")).alias("start_time_utc"), F.lit(None).cast("long").alias("received_bytes"), "total_bytes", state.alias("state"), "path")
    return c.unionByName(f)


def read_stix(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The indicators of STIX bundles that have a pattern: id, name, pattern, type, value. Files that are no bundles are passed over."""
    schema = "objects array<struct<type:string,id:string,name:string,pattern:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths if isinstance(paths, str) else [*paths])
    found = rows.select(F.explode("objects").alias("o")).select("o.*").where("type = 'indicator' and coalesce(pattern, '') <> ''")
    form = r"^\[\s*([a-z0-9-]+):[^=]*=\s*'(.*)'\s*\]$"
    return found.select("id", "name", "pattern", F.regexp_extract("pattern", form, 1).alias("type"), F.regexp_extract("pattern", form, 2).alias("value"))


def read_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Threat reports as source and text, one row per file."""
    rows = spark.read.text(paths if isinstance(paths, str) else [*paths], wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("source"), F.col("value").alias("text"))


def read_json_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Case, result and summary files, a JSON object each: their members as columns, and the file's path."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(paths if isinstance(paths, str) else [*paths])
    return rows.withColumn("path", F.col("_metadata.file_path"))
