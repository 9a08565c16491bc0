from pyspark.sql import functions as F

from evidra.operators.drift import fold_layouts, layout_changes, union_rows, union_schema
from evidra.operators.malformed import checked_lines
from evidra.sources.w3c import WELL_QUOTED, fields_of

SCHEMA = "site string, source_log string, line_no int, raw_line string, start int, names string, b string"


def lines(spark, files, extra=()):
    rows = [(site, log, i, text, 1, "x", None) for (site, log), texts in files.items() for i, text in enumerate(texts, 1)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


FILES = {
    ("A", "1.log"): ["#Software: x", "#Fields: date time c-ip sc-status time-taken", "2026-01-05 00:00:01 10.0.0.1 200 15", "2026-01-05 00:00:02 - 404 7", "", "2026-01-05 00:00:03 10.0.0.1 20x 7"],
    ("A", "2.log"): ["#fields: date time c-ip status time-taken", "2026-01-06 00:00:01 10.0.0.1 200 0.5", "2026-01-06 00:00:01 ::1 99 0.5", "06.01.2026 00:00:01 10.0.0.1 200 0.5",
                     "#FIELDS: DATE TIME STATUS C-IP cs(User-Agent)", '2026-01-06 00:00:02 200 10.0.0.2 "a ""b"" c"', '2026-01-06 00:00:02 200 10.0.0.2 "a b', "2026-01-06 00:00:02 200", "2026-02-30 00:00:02 200 10.0.0.2 -", "2026-01-06 25:00:02 - 10.0.0.2 -"],
    ("B", "1.log"): ["stray", "#Fields: date x", "20260105 1"],
}


def test_changes(spark):
    repeated = [("A", "1.log", 3, FILES["A", "1.log"][2], 0, "", ""), (None, "1.log", 1, "#Fields: a", 0, "", ""), ("A", None, 1, "x", 0, "", ""), ("A", "1.log", None, "x", 0, "", ""), ("A", "1.log", 90, None, 0, "", "")]
    got = {tuple(r) for r in layout_changes(lines(spark, FILES, repeated)).collect()}
    assert got == {("A", "2.log", 1, "status", "renamed"), ("A", "2.log", 1, "time-taken", "retyped"), ("A", "2.log", 5, "time-taken", "removed"), ("A", "2.log", 5, "cs(user-agent)", "added")}


def test_fold_of_layouts():
    whole, word = {"whole": 3}, {"word": 3}
    out = fold_layouts([(["a", "b", "c"], {0: whole, 1: word, 2: whole}), (["a", "x", "c"], {0: whole, 1: whole, 2: whole}), (["c", "x", "a"], {0: whole, 1: {"whole": 2, "word": 2}, 2: {}}), (["c", "y", "a"], {0: whole, 1: whole, 2: word})])
    assert [x["changes"] for x in out] == [[], [("b", "removed"), ("x", "added")], [], [("a", "retyped"), ("y", "renamed")]]
    assert out[3]["canonical"] == ["c", "x", "a"] and out[2]["forms"] == ["whole", "whole", "whole"]


def test_reasons_with_precedence_and_rename(spark):
    rows = {(r["site"], r["source_log"], r["line_no"]): r["reason"] for r in checked_lines(lines(spark, FILES)).collect()}
    assert rows == {
        ("A", "1.log", 3): None, ("A", "1.log", 4): None, ("A", "1.log", 6): "value", ("A", "2.log", 2): None, ("A", "2.log", 3): "value", ("A", "2.log", 4): "value", ("A", "2.log", 6): None,
        ("A", "2.log", 7): "quoting", ("A", "2.log", 8): "columns", ("A", "2.log", 9): "value", ("A", "2.log", 10): "value", ("B", "1.log", 1): "columns", ("B", "1.log", 3): None,
    }


def test_union_table(spark):
    rows = union_rows(checked_lines(lines(spark, FILES)).where("reason is null")).orderBy("site", "source_log", "line_no").collect()
    assert [(str(r["datetime_utc"]), r["client_ip"], r["protocol_status"], r["time_taken_ms"], r["user_agent"]) for r in rows] == [
        ("2026-01-05 00:00:01", "10.0.0.1", 200, 15, None), ("2026-01-05 00:00:02", None, 404, 7, None), ("2026-01-06 00:00:01", "10.0.0.1", 200, 500, None), ("2026-01-06 00:00:02", "10.0.0.2", 200, None, 'a "b" c'), ("None", None, None, None, None),
    ]
    forms = {(r["site"], r["field"]): r["form"] for r in union_schema(lines(spark, FILES)).collect()}
    assert forms["A", "time-taken"] == "decimal" and forms["B", "date"] == "date_compact"


def test_a_long_file_is_split_into_buckets(spark, monkeypatch):
    import evidra.sources.w3c as w3c

    text = ["#Fields: a b"] + ["1 2"] * 30 + ["#Fields: a c"] + ["1 x"] * 20
    df = lines(spark, {("S", "f"): text})
    for bucket in (4, 7, 1000):
        got = w3c.data_lines(df, w3c.header_lines(df), bucket)
        assert sorted((r["line_no"], r["start"]) for r in got.collect()) == [(i, 1) for i in range(2, 32)] + [(i, 32) for i in range(33, 53)]


def test_quotes_and_very_long_lines(spark):
    good = ['"a b" c', '"a ""b"" c"', "a b", '""', "a", '"' + "x " * 200_000 + '"', "y " * 100_000]
    bad = ['a"b', '"a" b"', '"a', '"a"b', 'a "b"c d"']
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "t string, ok boolean")
    assert rows.where(F.col("t").rlike(WELL_QUOTED) != F.col("ok")).count() == 0
    assert [r[0] for r in rows.limit(4).select(fields_of(F.col("t"))).collect()] == [["a b", "c"], ['a "b" c'], ["a", "b"], [""]]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert layout_changes(empty).collect() == [] and checked_lines(empty).collect() == []
    none = lines(spark, {("S", "f"): ["a b", "#x", ""]})
    assert layout_changes(none).collect() == [] and [r["reason"] for r in checked_lines(none).collect()] == ["columns"]


def test_slashed_dates_are_read_in_the_order_of_their_layout(spark):
    def log(dates):
        return ["#Fields: date time sc-status x-forwarded-for"] + [f"{d} 00:00:0{i % 10} 200 f{i}" for i, d in enumerate(dates)]

    files = {("A", "1"): log(["26/11/2026", "01/02/2026", "5/6/2026", "31/02/2026", "12/30/2026"]), ("B", "1"): log(["11/26/2026", "01/02/2026", "26/11/2026", "12/30/2026"]), ("C", "1"): log(["1.2.2026", "01.02.2026"]), ("D", "1"): log(["2026/2/1", "2026/02/01"])}
    df = lines(spark, files)
    checked = checked_lines(df)
    bad = sorted((r["site"], r["line_no"]) for r in checked.where("reason is not null").collect())
    assert bad == [("A", 5), ("A", 6), ("B", 4)]
    rows = union_rows(checked.where("reason is null")).collect()
    days = {(r["site"], r["line_no"]): str(r["datetime_utc"])[:10] for r in rows}
    assert days == {("A", 2): "2026-11-26", ("A", 3): "2026-02-01", ("A", 4): "2026-06-05", ("B", 2): "2026-11-26", ("B", 3): "2026-01-02", ("B", 5): "2026-12-30", ("C", 2): "2026-02-01", ("C", 3): "2026-02-01", ("D", 2): "2026-02-01", ("D", 3): "2026-02-01"}
    assert all(r["added"] == {"x-forwarded-for": f"f{r['line_no'] - 2}"} for r in rows)


def test_the_lattice_types_the_union_table(spark):
    files = {("A", "1"): ["#Fields: n d m", "1 2026-01-01 5", "2 2026-01-01 -"], ("A", "2"): ["#Fields: n d m", "1.5 01.01.2026 0x1F"], ("A", "3"): ["#Fields: d n", "2026-01-01 7"]}
    df = lines(spark, files)
    got = {r["field"]: (r["form"], r["type"], r["n_layouts"]) for r in union_schema(df).collect()}
    assert got == {"n": ("decimal", "double", 3), "d": ("date", "date", 3), "m": ("word", "string", 2)}
    assert sorted(tuple(r) for r in layout_changes(df).collect()) == [("A", "2", 1, "d", "retyped"), ("A", "2", 1, "m", "retyped"), ("A", "2", 1, "n", "retyped"), ("A", "3", 1, "d", "retyped"), ("A", "3", 1, "m", "removed"), ("A", "3", 1, "n", "retyped")]


def test_many_layouts_in_one_file(spark):
    text = [x for i in range(3000) for x in ("#Fields: a b" if i % 2 else "#Fields: a c", "1 2")]
    df = lines(spark, {("S", "f"): text})
    assert layout_changes(df).count() == 2999
    assert checked_lines(df).where("reason is null").count() == 3000
