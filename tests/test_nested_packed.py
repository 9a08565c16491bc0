import random

from evidra.operators.nested import level_tables, task_items
from evidra.operators.packed import Segmenter, unpack
from evidra.sources.xml_records import parse_xml

TASKS = """﻿<?xml version="1.0" encoding="UTF-16"?>
<Tasks><Task><Triggers><BootTrigger/><!-- <LogonTrigger/> --><CalendarTrigger><ScheduleByWeek><DaysOfWeek><Monday/><Friday/></DaysOfWeek></ScheduleByWeek></CalendarTrigger></Triggers>
<Principals><Principal id="Author"><RequiredPrivileges><Privilege><![CDATA[SeOne]]></Privilege></RequiredPrivileges></Principal><Principal/></Principals></Task><Note/><Task><Actions><Exec/></Actions></Task></Tasks>"""
SCHEMA = "record_id long, xml_text string, e string, key string, trail int"


def test_items_of_tasks(spark):
    rows = [(1, TASKS), (1, TASKS), (2, '<t:Task xmlns:t="u"><t:Actions><t:ComHandler/><t:Exec/></t:Actions></t:Task>'), (3, None), (4, ""), (5, "<Task><Actions>"), (6, "<Other><Triggers><A/></Triggers></Other>"), (7, "<Task><Triggers/></Task>"), (None, TASKS)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    assert {tuple(r) for r in task_items(df, "record_id", "xml_text").collect()} == {
        (1, 1, "trigger", 0, 1, "BootTrigger"), (1, 1, "trigger", 0, 2, "CalendarTrigger"), (1, 1, "day", 2, 1, "Monday"), (1, 1, "day", 2, 2, "Friday"), (1, 1, "principal", 0, 1, "Author"), (1, 1, "principal", 0, 2, None),
        (1, 1, "privilege", 1, 1, "SeOne"), (1, 2, "action", 0, 1, "Exec"), (2, 1, "action", 0, 1, "ComHandler"), (2, 1, "action", 0, 2, "Exec"),
    }
    empty = spark.createDataFrame([], SCHEMA)
    assert task_items(empty, "record_id", "xml_text").collect() == [] and level_tables(df.where("record_id in (3, 4, 5)"), "record_id", "xml_text") == []


def test_levels_name_their_parents(spark):
    df = spark.createDataFrame([(1, "<a x='1'>t<b>u</b><c><b/></c></a>", "", "", 0)], SCHEMA)
    levels = [[(r["node_id"], r["parent_id"], r["ordinal"], r["name"], r["text"]) for r in t.orderBy("node_id").collect()] for t in level_tables(df, "record_id", "xml_text")]
    assert levels == [[("1", None, 1, "a", "t")], [("1.1", "1", 1, "b", "u"), ("1.2", "1", 2, "c", "")], [("1.2.1", "1.2", 1, "b", "")]]


def test_elements_below_the_nested_levels_are_kept(spark):
    def deep(levels, inner):
        return "<Task><Triggers><BootTrigger/><CalendarTrigger>" + "<x>" * levels + inner + "</x>" * levels + "</CalendarTrigger></Triggers></Task>"

    days = "<DaysOfWeek><Monday/><t:Friday xmlns:t='u' a='1'> é&amp;<b/>f </t:Friday></DaysOfWeek>"
    df = spark.createDataFrame([(1, deep(70, days), "", "", 0), (2, deep(2, days), "", "", 0), (3, deep(36, "<y/>"), "", "", 0)], SCHEMA)
    assert {tuple(r) for r in task_items(df, "record_id", "xml_text").collect()} == {
        *((k, 1, "trigger", 0, i, x) for k in (1, 2, 3) for i, x in ((1, "BootTrigger"), (2, "CalendarTrigger"))), *((k, 1, "day", 2, i, x) for k in (1, 2) for i, x in ((1, "Monday"), (2, "Friday")))
    }
    rows = [r for t in level_tables(df, "record_id", "xml_text") for r in t.where("record_id = 1").collect()]
    by = {r["node_id"]: r for r in rows}
    assert len(rows) == len(by) == 4 + 70 + 4 and all(r["parent_id"] in by for r in rows if r["parent_id"])
    friday = next(r for r in rows if r["name"] == "Friday")
    assert (friday["ordinal"], friday["same_name_ordinal"], friday["text"], friday["attributes"]["a"], len(friday["trail"])) == (2, 1, "é&f", "1", 3 + 70 + 2)
    assert friday["node_id"] == ".".join(str(x["ordinal"]) for x in friday["trail"]) and friday["trail"][:3] == by["1.1.2"]["trail"]
    assert len(level_tables(df.where("record_id = 3"), "record_id", "xml_text")) == 40


def test_long_and_odd_xml():
    assert parse_xml("<a>" + "<b/>" * 50_000 + "</a>")[1] == 2
    assert parse_xml("<a>" * 5000 + "</a>" * 5000)[1] == 40 and parse_xml("<a>" * 5000 + "</a>" * 4999) == (None, 0)
    assert parse_xml("<a>&undefined;</a>") == (None, 0) == parse_xml("text") == parse_xml("<a>\x01</a>")


def reference(text, blanks):
    out, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cur, i = cur + '"', i + 2
                continue
            quoted = not quoted
        elif c in ";,|\t\r\n" + " " * blanks and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return [x.strip() for x in [*out, cur] if x.strip()]


def test_segments_like_a_plain_reading_of_the_rules():
    rng = random.Random(5)
    for _ in range(3000):
        pieces = []
        for _ in range(rng.randrange(1, 6)):
            value = "".join(rng.choice('ab,;| \t"=') for _ in range(rng.randrange(0, 6)))
            pieces.append('"' + value.replace('"', '""') + '"' if rng.random() < 0.5 else value.replace('"', ""))
        text = rng.choice([";", ", ", " | ", "\t", "\r\n\t"]).join(pieces)
        for blanks in (False, True):
            assert Segmenter([]).split(text, blanks) == reference(text, blanks), text


def test_known_values_protect_their_delimiters():
    s = Segmenter(["Finance, Read Only", "Read Only; Night"])
    assert s.split("Audit, Finance, Read Only; Print Staff", False) == ["Audit", "Finance, Read Only", "Print Staff"]
    assert s.split("Finance, Read Only; Night", False) == ["Finance, Read Only", "Night"]
    assert s.split("xFinance, Read Only", False) == ["xFinance", "Read Only"]


def test_unpack_rows(spark):
    schema = "id long, text string, blanks boolean, value string, position string"
    rows = [(1, 'a=1; b="x;y"', False), (2, None, False), (3, "", True), (4, " - ", False), (5, "S1 S2\r\n\tS3", True), (6, "one", None), (7, ";;", False), (8, "v," * 50_000, False), (5, "S1", True)]
    got = unpack(spark.createDataFrame([(*r, "v", "p") for r in rows], schema), "text", "blanks")
    assert got.columns == ["id", "position", "value"]
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append((r["position"], r["value"]))
    assert len(by.pop(8)) == 50_000
    assert {k: sorted(v) for k, v in by.items()} == {1: [(1, "a=1"), (2, "b=x;y")], 5: [(1, "S1"), (1, "S1"), (2, "S2"), (3, "S3")], 6: [(1, "one")]}
    assert unpack(spark.createDataFrame([], schema), "text", "blanks").collect() == []


def test_the_whole_dictionary_counts(spark):
    hot = [(0, '"hot;x",' * 200_000, False)]
    rows = [(i, '"Finance, Read Only"; Audit', False) for i in (1, 2, 3)] + [(4, "Audit, Finance, Read Only; Print Staff", False), (5, "x; hot;x", None), (6, "y, Read Only; hot;x", False), (7, '"p q"\t"p q" "p q"', True), (8, "r p q", True)]
    expected = {4: ["Audit", "Finance, Read Only", "Print Staff"], 5: ["x", "hot;x"], 6: ["y", "Read Only", "hot;x"], 8: ["r", "p q"]}
    df = spark.createDataFrame(hot + rows, "id long, text string, blanks boolean")
    for bounds in ({}, {"most": 1}, {"most": 0}, {"most_chars": 6}):
        by = {}
        for r in unpack(df, "text", "blanks", **bounds).where("id > 3").collect():
            by.setdefault(r["id"], []).append((r["position"], r["value"]))
        assert {k: [v for _, v in sorted(by[k])] for k in expected} == expected, bounds
