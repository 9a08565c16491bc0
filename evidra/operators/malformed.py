"""Rows that fail to parse, apart from the rows that load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.forms import NAME
from evidra.functions.net import is_address
from evidra.functions.text import fence
from evidra.functions.times import TIME, day_in_form
from evidra.operators.drift import fold, parsed_lines
from evidra.session import materialize
from evidra.sources.w3c import FILE, covers


def checked_lines(lines: DataFrame) -> DataFrame:
    """Every data line, read permissively under the explicit schema of its layout, with `reason` null where it loads.

    Columns: site, source_log, line_no, raw_line (kept), fields, canonical, promoted, day (of the date), reason. Method:
    lines are split and written once, raw text included; the layouts are folded from what was written; then status,
    address, date and time are cast, and only rows of which a cast fails or whose fields don't fit are classified, in this
    order of precedence: `quoting`, a double quote that neither encloses a whole field nor is doubled inside a quoted one;
    `columns`, more or fewer fields than the layout, or no layout above the line; `value`, a status, address, date or
    time that is none or, of dates and times, not in the form of the layout. `-` and an absent column are never bad.
    Lines and layouts are those of `data_lines` and `layouts`, with their results for nulls and repeated lines.
    """
    headers, parsed = parsed_lines(lines)
    parsed = materialize(parsed, "parsed-lines")
    at = lambda x: F.expr(f"cast(nullif(array_position(canonical, '{x}'), 0) - 1 as int)")
    places = {"status_at": at("sc-status"), "client_at": at("c-ip"), "date_at": at("date"), "time_at": at("time")}
    known = covers(fold(headers, parsed).drop("changes"), lines).withColumns(places)
    known = known.select(*FILE, "start", "b", "canonical", "promoted", *places, F.get("forms", "date_at").alias("date_form"), F.get("forms", "time_at").alias("time_form"))
    # a table of known size: small, it goes to the lines; else a layout meets them bucket by bucket, so that a long one is spread over many tasks
    rows = parsed.join(materialize(known, "layout-states"), [*FILE, "start", "b"], "left")
    value = lambda place: F.nullif(F.nullif(F.get("fields", place), F.lit("-")), F.lit(""))
    rows = fence(rows, _status=value("status_at"), _client=value("client_at"), _date=value("date_at"), _time=value("time_at"), _fits=F.coalesce(F.col("start").isNotNull() & (F.size("fields") == F.col("width")), F.lit(False)))
    names = F.create_map(*(F.lit(x) for pair in NAME.items() for x in pair))
    written = lambda at: F.element_at(names, F.expr(f"nullif(substring(letters, {at} + 1, 1), '-')"))
    unsure = (F.col("_date_form") == "date_slash") & F.col("date_form").startswith("date_slash_")
    rows = fence(rows, _date_form=written("date_at"), _time_form=written("time_at"))
    rows = fence(rows, day=F.when(F.col("_fits"), day_in_form(F.col("_date"), F.when(unsure, F.col("date_form")).otherwise(F.col("_date_form")))))
    text = lambda x: F.col(x).isNotNull()
    good = [
        F.col("_status").rlike(r"^[1-5]\d\d$"),
        is_address(F.col("_client")),
        F.when(text("_date"), F.col("day").isNotNull()),
        F.when(F.col("date_form").startswith("date"), (F.col("_date_form") == F.col("date_form")) | unsure),
        F.col("_time").rlike(TIME),
        F.when(F.col("time_form").startswith("time") & text("_time"), F.col("_time_form") == F.col("time_form")),
    ]
    loads = F.col("_fits")
    for x in good:
        loads = loads & F.coalesce(x, F.lit(True))
    reason = F.when(~loads, F.when(F.col("fields").isNull(), "quoting").when(~F.col("_fits"), "columns").otherwise("value"))
    return rows.select(*FILE, "line_no", "raw_line", "fields", "canonical", "promoted", "day", reason.alias("reason"))
