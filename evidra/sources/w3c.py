"""W3C extended logs as collected: one row per line, the layout named by the `#Fields:` line above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines per bucket of one file: a file, however long, is split into buckets of this many lines.
LINE_BUCKET = 50_000
FILE = ["site", "source_log"]
#: A line whose double quotes enclose whole fields, quotes inside being doubled. Possessive, so long lines neither recurse nor backtrack.
WELL_QUOTED = r'^[ \t]*+(?:(?:"(?:[^"]++|"")*+"|[^" \t]++)(?:[ \t]++|$))*+$'
_TOKEN = r'("(?:[^"]++|"")*+"|[^" \t]++)'
_DIRECTIVE = r"(?i)^#fields:"


def header_lines(lines: DataFrame) -> DataFrame:
    """The `#Fields:` lines: site, source_log, start (their line_no), names (in lower case), stop (the next one's line_no, null for the last)."""
    names = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw_line"), _DIRECTIVE, ""), r"\s+", " ")), " ")
    marked = F.col("raw_line").startswith("#") & F.col("raw_line").rlike(_DIRECTIVE) & F.col("site").isNotNull() & F.col("source_log").isNotNull() & F.col("line_no").isNotNull()
    found = lines.where(marked).groupBy(*FILE, "line_no").agg(F.min("raw_line").alias("raw_line"))
    order = Window.partitionBy(*FILE).orderBy("line_no")
    return found.select(*FILE, F.col("line_no").alias("start"), F.lead("line_no").over(order).alias("stop"), F.filter(names, lambda x: x != "").alias("names"))


def covers(headers: DataFrame, lines: DataFrame, bucket: int = LINE_BUCKET) -> DataFrame:
    """The layouts of `headers` (start, stop and any others) in each bucket `b` of lines that they cover."""
    last = lines.groupBy(*FILE).agg(F.max("line_no").alias("most"))
    upto = F.coalesce(F.col("stop") - 1, F.greatest("most", "start"))
    buckets = F.sequence(F.floor(F.col("start") / bucket), F.floor(upto / bucket))
    return headers.join(last, FILE).withColumn("b", F.explode(buckets)).drop("most")


def data_lines(lines: DataFrame, headers: DataFrame, bucket: int = LINE_BUCKET) -> DataFrame:
    """The distinct data lines: site, source_log, b, line_no, raw_line, start and width of the layout each belongs to (null before the first).

    Each bucket of lines is sorted once, together with the layouts that cover any of it, and every line takes the last
    one before it: neither a long file nor one with many layouts meets in one task, and no line meets more than its own
    layout. A line_no that comes more than once counts once (the least text of them; a `#Fields:` line before all);
    lines with a null site, source_log, line_no or text, lines that start with `#`, and empty lines are no data.
    """
    raw = F.col("raw_line")
    # whatever begins beyond `#` is data without a closer look
    is_data = F.when(F.ascii(raw) > ord("#"), True).otherwise(~raw.rlike(r"^(#|\s*$)"))
    whole = F.col("line_no").isNotNull() & F.col("site").isNotNull() & F.col("source_log").isNotNull()
    data = lines.where(is_data & whole).select(*FILE, F.floor(F.col("line_no") / bucket).alias("b"), "line_no", "raw_line", F.lit(None).cast("int").alias("width"))
    seeds = covers(headers, lines, bucket).select(*FILE, "b", F.col("start").alias("line_no"), F.lit(None).cast("string").alias("raw_line"), F.size("names").alias("width"))
    order = Window.partitionBy(*FILE, "b").orderBy("line_no", F.asc_nulls_first("raw_line"))
    rows = data.unionByName(seeds)
    layout = F.last(F.when(F.col("width").isNotNull(), F.struct(F.col("line_no").alias("start"), "width")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"layout": layout, "before": F.lag("line_no").over(order)})
    first = F.col("before").isNull() | (F.col("before") != F.col("line_no"))
    return rows.where(F.col("width").isNull() & first).select(*FILE, "b", "line_no", "raw_line", "layout.*")


def fields_of(line: Column) -> Column:
    """The fields of a line, without their enclosing quotes; null for null and where quotes are misplaced (see WELL_QUOTED)."""
    inner = lambda x: F.regexp_replace(x, r'^"|"$', "")
    tokens = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(1))
    quoted = F.transform(tokens, lambda x: F.when(x.startswith('"'), F.replace(inner(x), F.lit('""'), F.lit('"'))).otherwise(x))
    bare = F.btrim(line, F.lit(" \t"))
    plain = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t]+"))
    return F.when(~line.contains('"'), plain).when(line.rlike(WELL_QUOTED), quoted)
