"""Schemas that drift between and within files: one table for all, and a report of each change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.forms import NAME, ORDER, forms_of, promote
from evidra.functions.net import canonical_address
from evidra.functions.text import fence
from evidra.functions.times import nanos_of_day
from evidra.session import materialize
from evidra.sources.w3c import FILE, data_lines, fields_of, header_lines

_POINTS = "site string, source_log string, start int, names array<string>, seen array<struct<pos:int,letter:string,n:long>>, point_log string, point_start int"
_STATE = "site string, point_log string, point_start int, canonical array<string>, forms array<string>, promoted array<string>, changes array<struct<field:string,change:string>>"


def _decided(seen: dict[str, int], before: str | None) -> dict[str, int]:
    """How many values have which form; slashed dates of unknown order count to the order that is known here, or else was before."""
    out = {NAME[letter]: n for letter, n in seen.items()}
    if "date_slash" in out:
        known = [f for f in ("date_slash_dmy", "date_slash_mdy") if f in out]
        most = max(known, key=lambda f: (out[f], f == before), default=before if before in ("date_slash_dmy", "date_slash_mdy") else "date_slash_dmy")
        out[most] = out.get(most, 0) + out.pop("date_slash")
    return out


def fold_layouts(layouts: list[tuple[list[str], dict[int, dict[str, int]]]]) -> list[dict]:
    """Fold the layouts of one site, in order: what each column was first called, the form of its values, its type so far, and the changes.

    A layout is its names and, by position, how many values have which form. The form most values have counts; of
    equally many, the one the column had before, then the first of ORDER. A column without values keeps its form. The
    type of a column is promoted, layout by layout, to the least in the lattice that holds the forms of all so far.
    """
    out: list[dict] = []
    names: list[str] = []
    known: dict[str, str | None] = {}
    origin: dict[str, str] = {}
    types: dict[str, str | None] = {}
    for new, counts in layouts:
        gone = [x for x in names if x not in new]
        come = [x for x in new if x not in names]

        def form(x: str, before: str | None, new=new, counts=counts) -> str | None:
            seen = counts.get(new.index(x), {})
            most = max(seen.values(), default=0)
            best = [f for f, n in seen.items() if n == most]
            return before if before in best or not best else min(best, key=ORDER.index)

        renamed: dict[str, str] = {}
        if out:
            beside = lambda row, i: (row[i - 1] if i else "", row[i + 1] if i + 1 < len(row) else "")
            both = {*names} & {*new} | {""}
            places = {beside(names, names.index(x)): x for x in gone}
            for x in come:
                place = beside(new, new.index(x))
                old = places.get(place)
                if old is not None and {*place} <= both:
                    a, b = known.get(old), form(x, known.get(old))
                    if a is None or b is None or a == b:
                        renamed[x] = old
        changes = [(x, "renamed") for x in renamed]
        if out:
            changes += [(x, "added") for x in come if x not in renamed] + [(x, "removed") for x in gone if x not in renamed.values()]
        now, first = {}, {}
        for x in dict.fromkeys(new):
            source = renamed.get(x, x)
            before = known.get(source)
            now[x] = form(x, before)
            first[x] = origin.get(source, x)
            types[first[x]] = promote(types.get(first[x]), now[x])
            if source == x and x in names and before and now[x] and before != now[x]:
                changes.append((x, "retyped"))
        names, known, origin = new, now, first
        out.append({"canonical": [first[x] for x in new], "forms": [now[x] for x in new], "promoted": [types[first[x]] for x in new], "changes": sorted(changes)})
    return out


def _fold_site(site: pd.DataFrame) -> pd.DataFrame:
    site = site.sort_values(["source_log", "start"])
    layouts = []
    before: dict[str, str | None] = {}
    for names, seen in zip(site["names"], site["seen"]):
        counts: dict[int, dict[str, int]] = {}
        for x in seen if seen is not None else ():
            counts.setdefault(x["pos"], {})[x["letter"]] = x["n"]
        names = list(names)
        counts = {i: _decided(c, before.get(names[i])) for i, c in counts.items()}
        before |= {names[i]: max(c, key=c.get) for i, c in counts.items()}
        layouts.append((names, counts))
    folded = fold_layouts(layouts)
    result = site[["site"]].copy()
    result["point_log"], result["point_start"] = site["source_log"], site["start"]
    for x in ("canonical", "forms", "promoted"):
        result[x] = [f[x] for f in folded]
    result["changes"] = [[{"field": f, "change": c} for f, c in x["changes"]] for x in folded]
    return result


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Layouts in order, each with the last one that may have changed anything; only those keep what was seen in them."""
    last = point = None
    for batch in batches:
        logs, starts, kept = [], [], []
        for site, log, start, names, seen in zip(batch["site"], batch["source_log"], batch["start"], batch["names"], batch["seen"]):
            by_place: dict[int, list[tuple[int, str]]] = {}
            for x in seen if seen is not None else ():
                by_place.setdefault(x["pos"], []).append((x["n"], x["letter"]))
            ranked = {p: sorted(f, reverse=True) for p, f in by_place.items()}
            slashed = any(NAME[letter].startswith("date_slash_") or letter == _UNSURE for f in by_place.values() for _, letter in f)
            clear = not slashed and all(len(f) < 2 or f[0][0] > f[1][0] for f in ranked.values())
            mark = (site, tuple(names), tuple(sorted((p, f[0][1]) for p, f in ranked.items())))
            if not clear or mark != last:
                point = (log, start)
            last = mark if clear else None
            logs.append(point[0])
            starts.append(point[1])
            kept.append(seen if point == (log, start) else None)
        yield batch[["site", "source_log", "start", "names"]].assign(seen=kept, point_log=logs, point_start=starts)


_UNSURE = next(letter for letter, name in NAME.items() if name == "date_slash")


def parsed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layouts (see `header_lines`) and the data lines, read once: the columns of `data_lines`, fields (null where quotes are misplaced) and letters (the forms of the fields, one letter each)."""
    headers = materialize(header_lines(lines), "headers")
    rows = fence(data_lines(lines, headers), fields=fields_of(F.col("raw_line")))
    return headers, rows.withColumn("letters", forms_of(F.col("fields")))


def fold(headers: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each layout of each file: site, source_log, start, stop, names, canonical, forms, promoted, changes.

    Method: the forms of the values below each header are counted with partial aggregation, by the letters of whole
    lines first. Layouts are sorted by (site, source_log, start) over as many tasks as they need; one that equals the one
    before (names in the same places, clear majorities of the same forms) can change nothing and takes its result, so that
    the fold of a site, in order, through the lattice of forms, sees only the points where something may have changed,
    and the first layout of a task.
    """
    counted = parsed.where((F.size("fields") == F.col("width")) & F.col("start").isNotNull()).groupBy(*FILE, "start", "letters").agg(F.count("*").alias("n"))
    by_place = counted.select(*FILE, "start", "n", F.posexplode(F.split("letters", "")).alias("pos", "letter")).where("letter not in ('', '-')")
    seen = by_place.groupBy(*FILE, "start", "pos", "letter").agg(F.sum("n").alias("n"))
    seen = seen.groupBy(*FILE, "start").agg(F.array_sort(F.collect_list(F.struct("pos", "letter", "n"))).alias("seen"))
    found = materialize(headers.join(seen, [*FILE, "start"], "left").select(*FILE, "start", "names", "seen"), "layouts-seen")
    ordered = found.repartitionByRange(*FILE, "start").sortWithinPartitions(*FILE, "start")
    placed = materialize(ordered.mapInPandas(_points, _POINTS), "layouts")
    is_point = (F.col("point_log") == F.col("source_log")) & (F.col("point_start") == F.col("start"))
    state = placed.where(is_point).select(*FILE, "start", "names", "seen").groupBy("site").applyInPandas(_fold_site, _STATE)
    joined = placed.select(*FILE, "start", "names", "point_log", "point_start").join(state, ["site", "point_log", "point_start"])
    found = joined.select(*FILE, "start", "names", "canonical", "forms", "promoted", F.when(is_point, F.col("changes")).alias("changes"))
    return found.join(headers.select(*FILE, "start", "stop"), [*FILE, "start"])


def layouts(lines: DataFrame) -> DataFrame:
    """Each layout of each file of collected lines, folded in order; see `fold`."""
    return fold(*parsed_lines(lines))


def layout_changes(lines: DataFrame) -> DataFrame:
    """Every change of the layout: site, source_log, line_no, field, change (added, removed, renamed, retyped).

    Files without a `#Fields:` line, and an empty table, give no rows. Lines with a null site, source_log or line_no
    belong to no layout. Other columns are ignored.
    """
    change = F.explode("changes")
    return layouts(lines).select(*FILE, F.col("start").alias("line_no"), change.alias("c")).select(*FILE, "line_no", "c.field", "c.change")


#: Fixed names: the W3C field of each column of the request table.
W3C_FIELDS = {
    "server_ip": ("s-ip",), "server_port": ("s-port",), "method": ("cs-method",), "uri_stem": ("cs-uri-stem",), "uri_query": ("cs-uri-query",),
    "protocol_status": ("sc-status",), "substatus": ("sc-substatus",), "win32_status": ("sc-win32-status",), "bytes_sent": ("sc-bytes",),
    "bytes_received": ("cs-bytes",), "time_taken_ms": ("time-taken",), "client_ip": ("c-ip",), "username": ("cs-username",),
    "user_agent": ("cs(user-agent)",), "referer": ("cs(referer)",), "host": ("cs-host", "cs(host)"),
}


def field(names: tuple[str, ...]) -> Column:
    """The value of the column first called by one of `names`; null for `-`, empty and absent."""
    place = F.coalesce(*(F.expr(f"nullif(array_position(canonical, '{x}'), 0)") for x in names))
    value = F.get("fields", (place - 1).cast("int"))
    return F.when((value != "-") & (value != ""), value)


def _number(v: Column, scale: int = 1) -> Column:
    """Whole, decimal (times `scale`), hexadecimal and with unit, as a long."""
    unit = F.upper(F.regexp_extract(v, r"([A-Za-z]+)$", 1))
    times = F.when(unit.isin("K", "KB"), 1024).when(unit.isin("M", "MB"), 1024**2).when(unit.isin("G", "GB"), 1024**3).otherwise(1)
    return (
        F.when(v.rlike(r"^[-+]?\d+$"), v.try_cast("long"))
        .when(v.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(v, 3, 20), 16, 10).try_cast("long"))
        .when(v.rlike(r"^\d*\.\d+$"), F.round(v.try_cast("double") * scale).cast("long"))
        .when(v.rlike(r"^\d+(?:\.\d+)?[A-Za-z]+$"), F.round(F.regexp_extract(v, r"^([\d.]+)", 1).try_cast("double") * times).cast("long"))
    )


def union_rows(parsed: DataFrame) -> DataFrame:
    """Parsed lines of any layout (columns of `malformed.checked_lines`) as one table: the columns of the request table, line_no, and `added`.

    Fixed columns are cast to the types of the request table. Every other column of any layout is kept in `added`, by its
    first name and cast to its promoted type (see `cast_value`), so that nothing a layout adds is lost.
    """
    v = {name: field(fields) for name, fields in W3C_FIELDS.items()}
    port = F.when(F.lower(v["server_port"]) == "https", "443").when(F.lower(v["server_port"]) == "http", "80").otherwise(v["server_port"])
    us = F.floor((F.col("day") * 86_400_000_000_000 + nanos_of_day(field(("time",)))) / 1000)
    numbers = {"server_port": _number(port), "time_taken_ms": _number(v["time_taken_ms"], 1000)}
    numbers |= {x: _number(v[x]) for x in ("protocol_status", "substatus", "win32_status", "bytes_sent", "bytes_received")}
    whole = {"server_port", "protocol_status", "substatus", "win32_status"}
    cols = {"request_id": F.xxhash64("site", "source_log", "line_no"), "us": us, "site": F.col("site")}
    for name in W3C_FIELDS:
        cols[name] = numbers[name].cast("int" if name in whole else "long") if name in numbers else v[name]
    cols["client_ip"] = canonical_address(v["client_ip"])
    fixed = [x for fields in W3C_FIELDS.values() for x in fields] + ["date", "time"]
    every = F.arrays_zip(F.col("canonical").alias("name"), F.col("fields").alias("value"), F.col("promoted").alias("type"))
    other = F.filter(every, lambda x: ~x["name"].isin(fixed) & ~F.coalesce(x["value"], F.lit("-")).isin("-", ""))
    # of two columns of one name, the first
    once = F.filter(other, lambda x, i: F.array_position(F.transform(other, lambda y: y["name"]), x["name"]) == i + 1)
    added = F.map_from_entries(F.transform(once, lambda x: F.struct(x["name"], cast_value(x["value"], x["type"]))))
    cols["added"] = F.when(F.size(other) > 0, added)
    rows = parsed.select(*(c.alias(x) for x, c in cols.items()), "source_log", "line_no")
    at = F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01 00:00:00')").alias("datetime_utc")
    last = ("source_log", "line_no", "added")
    return rows.select("request_id", at, *(x for x in rows.columns if x not in ("request_id", "us", *last)), *last)


def cast_value(value: Column, form: Column) -> Column:
    """A value as its promoted type writes it: whole and decimal numbers plainly, all else as it stands; what can't be cast stands too."""
    number = F.replace(value, F.lit(","), F.lit("."))
    return F.coalesce(F.when(form == "whole", number.try_cast("decimal(38,0)").cast("string")).when(form == "decimal", number.try_cast("double").cast("string")), value)


#: Fixed names: the type of a column by its promoted form; any other is text.
TYPES = {"whole": "bigint", "decimal": "double", "date": "date"} | {x: "date" for x in ORDER if x.startswith("date")}


def union_schema(lines: DataFrame) -> DataFrame:
    """The union schema: per site and field (by its first name) the least form in the lattice that holds the values of every layout, its type, and how many layouts have it."""
    seen = layouts(lines).select("site", "source_log", "start", F.explode(F.arrays_zip("canonical", "promoted")).alias("x"))
    # promotion only rises, so the last layout has the type of all
    found = seen.groupBy("site", F.col("x.canonical").alias("field")).agg(F.max_by("x.promoted", F.struct("source_log", "start")).alias("form"), F.count("*").alias("n_layouts"))
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return found.select("site", "field", "form", F.coalesce(F.element_at(kinds, F.col("form")), F.lit("string")).alias("type"), "n_layouts")
