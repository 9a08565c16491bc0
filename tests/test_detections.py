import datetime
import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import correlate, integrity, ioc, search, sequences, timeline, triage
from evidra.operators.rules import Rule, RuleError, compile_condition, evaluate, java_pattern, ordered, overlay, render


def test_rules_that_are_not_well_formed():
    base = {"id": "a", "title": "t", "severity": "HIGH", "source": "s"}
    bad = [{"match": {"all": []}}, {"match": {"field": "x"}}, {"match": {"equals": "x"}}, {"match": {"all": [{"field": "x", "equals": 1}], "any": [{"field": "x", "equals": 1}]}}, {"match": {"not": {"field": "x", "equals": 1}, "field": "y"}},
           {"match": {"field": "x", "regex": "("}}, {"match": {"field": "x", "regex": "(?=a)"}}, {"match": {"field": "x", "regex": r"(a)\1"}}, {"match": {"all": ["x"]}}, {"severity": "BAD"}, {"source": None}, {"more": 1}, {"id": ""}]
    for more in bad:
        with pytest.raises(RuleError):
            Rule.from_mapping(base | more)
    with pytest.raises(RuleError):
        Rule.from_mapping(base | {"enabled": False, "match": {"field": "x"}})
    assert java_pattern("(?P<n>[[:alpha:]]+)") == r"(?iu)(?<n>[\p{Alpha}]+)"


def test_overlay_keeps_order_and_ids_once():
    spec = lambda i, **x: {"id": i, "title": "t", "severity": "HIGH", "source": "s"} | x
    rules, warnings = overlay([Rule.from_mapping(spec("a")), Rule.from_mapping(spec("b"))], [spec("b", enabled=False), spec("c"), spec("a", title="new"), spec("b", title="back"), {"id": "d"}], "more.yml")
    assert [(r.id, r.title) for r in rules] == [("a", "new"), ("b", "back"), ("c", "t")] and len(warnings) == 2


def test_conditions_have_two_values_only(spark):
    df = spark.createDataFrame([(None, "X.exe"), ("", None), ("A", "ax")], "a string, B string")
    want = {"equals": ({"field": "A", "equals": "a"}, [0, 0, 1]), "absent": ({"field": "zz", "not_equals": "a"}, [1, 1, 1]), "in_none": ({"field": "a", "in": []}, [0, 0, 0]), "not_in_none": ({"field": "a", "not_in": []}, [1, 1, 1]),
            "exists": ({"field": "b", "exists": True}, [1, 1, 1]), "exists_not": ({"field": "zz", "exists": True}, [0, 0, 0]), "first_wins": ({"field": "b", "equals": "ax", "contains": "exe"}, [0, 0, 1]), "not": ({"not": {"field": "b", "contains": "X"}}, [0, 1, 0])}
    for name, (node, expected) in want.items():
        assert [int(r[0]) for r in df.select(compile_condition(node, df.columns)).collect()] == expected, name
    assert df.select(render("{b}|{}|{zz}|{", df.columns)).first()[0] == "X.exe|{}||{"


def test_order_of_hits(spark):
    df = spark.createDataFrame([("x", s) for s in ("low", "info", "High", " notable")], "k string, tier string")
    rule = Rule("r", "t", sources=("s",), severity_from="tier", timeline_key="{k}")
    assert [r["severity"] for r in ordered(evaluate([rule], {"s": df})).collect()] == ["HIGH", "NOTABLE", "INFO"]
    assert evaluate([rule], {"other": df}).collect() == [] and evaluate([rule], {"s": df.limit(0)}).collect() == []


def machine(events, within, backward):
    """The sequence rules as a state machine: (time, seq, first, second)."""
    hits, held = [], []
    for t, s, first, second in sorted(events):
        held = [h for h in held if t - h[0] <= within]
        if backward:
            if second and held:
                hits.append((s, held[-1][1]))
            if second:
                held = []
            if first:
                held.append((t, s))
        else:
            if first:
                held.append((t, s))
            if second:
                hits += [(h[1], s) for h in held]
                held = []
    return sorted(hits)


@pytest.mark.parametrize("bucket", [1, 2, 64])
def test_sequences_like_a_state_machine(spark, monkeypatch, bucket):
    monkeypatch.setattr(sequences, "BUCKET", bucket)
    rng = random.Random(9)
    rows = []
    for e in range(40):
        t = 0
        for s in range(40):
            t += rng.choice([0, 1, 30, 60, 120, 121])
            rows.append((f"e{e}", t, s, rng.random() < 0.3, rng.random() < 0.3))
    rows += [("e0", None, 99, True, True), ("e0", 5, 98, None, None)]
    df = spark.createDataFrame(rows, "e string, t long, s long, f boolean, g boolean")
    back = sequences.preceded(df, "t", "s", F.col("f"), F.col("g"), "e", 120).collect()
    forth = sequences.followed(df, "t", "s", F.col("f"), F.col("g"), "e", 120).collect()
    for e in {r[0] for r in rows}:
        mine = [(t, s, bool(f), bool(g)) for x, t, s, f, g in rows if x == e and t is not None]
        assert sorted((r["s"], r["first_seq"]) for r in back if r["e"] == e) == machine(mine, 120, True)
        assert sorted((r["s"], r["second_seq"]) for r in forth if r["e"] == e) == machine(mine, 120, False)


def test_indicators():
    text = "See hxxps://Evil[.]example/a.b, 203.0.113.9 and 10.0.0.1; bad[.]example.org x.dll www.google.com " + "a" * 64 + " " + "b" * 40 + " " + "c" * 32 + " evil[.]example/" + "d" * 32
    assert [(k, v, c) for k, v, _, c in ioc.extract(text)] == [
        ("url", "https://evil.example/a.b", 90), ("ipv4-addr", "203.0.113.9", 100), ("file", "a" * 64, 80), ("file", "b" * 40, 70), ("file", "c" * 32, 50), ("file", "d" * 32, 50), ("domain-name", "bad.example.org", 80), ("domain-name", "evil.example", 80),
    ]
    assert ioc.extract(None) == ioc.extract("") == ioc.extract("no 999.1.1.1 here") == []
    assert ioc.extract("1.2.3.4 1.2.3.4")[0][:2] == ("ipv4-addr", "1.2.3.4") and len(ioc.extract("1.2.3.4 1.2.3.4")) == 1


def test_indicators_of_rows(spark):
    docs = spark.createDataFrame([("a", "1.2.3.4"), ("b", None), ("c", "x" * 300_000), ("a", "1.2.3.4")], "source string, text string")
    assert [r["value"] for r in ioc.indicators(docs, "source", "text").collect()] == ["1.2.3.4"] * 2
    objects = ioc.stix_objects(ioc.indicators(docs, "source", "text")).collect()
    assert len(objects) == 1 and "[ipv4-addr:value = '1.2.3.4']" in objects[0][0]
    packs = spark.createDataFrame([("ipv4-addr", "1.2.3.4"), ("url", "http://x")], "type string, value string")
    assert ioc.match_evidence(docs, "text", packs).count() == 2


def test_lookalikes_and_orphans(spark):
    names = spark.createDataFrame([("admin", 1), ("Admin", 2), ("admln", 3), ("admin1x", 4), ("zzz", 5), (None, 6), ("", 7)], "n string, i long")
    assert {tuple(r) for r in correlate.lookalikes(names, "n", "i").collect()} == {("admin", "admln"), ("admln", "admin"), ("admin1x", "admin")}
    filters = spark.createDataFrame([("f1", "q"), ("f2", "q")], "name string, query string")
    consumers = spark.createDataFrame([("C", "c1", "run"), ("C", "c2", "run")], "class string, name string, action string")
    bindings = spark.createDataFrame([("f1", "c", "C1"), ("F2", "C", "none")], "filter_name string, consumer_class string, consumer_name string")
    states = sorted((r["state"], r["filter_name"], r["consumer_name"]) for r in correlate.bound_consumers(filters, bindings, consumers).collect())
    assert states == [("bound", "F2", "none"), ("bound", "f1", "C1"), ("orphan consumer", "", "c2"), ("orphan filter", "f2", "")]


def test_lookalikes_are_symmetric_and_like_all_pairs(spark):
    pair = spark.createDataFrame([("adminxx", 1), ("admin", 2)], "n string, i long")
    assert {tuple(r) for r in correlate.lookalikes(pair, "n", "i").collect()} == {("admin", "adminxx"), ("adminxx", "admin")}
    rng = random.Random(4)
    rows = [("".join(rng.choice("abA") for _ in range(rng.randrange(1, 6))), i) for i in range(60)] + [(f"user{i:03}", 100 + i) for i in range(40)]
    first = {}
    for n, i in rows:
        first.setdefault(n.lower(), (i, n))

    def edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = lambda a, b: a != b and (edit(a, b) or (abs(len(a) - len(b)) <= 2 and (a.startswith(b) or b.startswith(a))))
    want = {(first[a][1], min(first[b] for b in first if near(a, b))[1]) for a in first if any(near(a, b) for b in first)}
    assert {tuple(r) for r in correlate.lookalikes(spark.createDataFrame(rows, "n string, i long"), "n", "i").collect()} == want


def test_dense_buckets_cost_the_same_for_each_row(spark):
    df = spark.range(40_000).selectExpr("'e' as e", "id as t", "id as s", "true as f", "id = 39999 as g")
    assert sequences.followed(df, "t", "s", F.col("f"), F.col("g"), "e", 40_000).count() == 40_000


def test_brute_force_without_fails(spark):
    logons = spark.createDataFrame([("4625", '{"IpAddress":"203.0.113.9","TargetUserName":"A"}')] * 25 + [("4625", None), ("4624", "x"), (None, None)], "event_id string, event_data string")
    row = correlate.failed_logons(logons, "event_id", "event_data").collect()
    assert [(r["total"], r["n_addresses"], r["n_accounts"], r["top"], r["severity"]) for r in row] == [(26, 1, 1, "203.0.113.9(25 [external])", "HIGH")]
    assert correlate.failed_logons(logons.limit(5), "event_id", "event_data").collect() == []
    assert correlate.failed_logons(logons.limit(0), "event_id", "event_data").collect() == []


def test_adapters_take_missing_columns_and_bad_times(spark):
    tables = {
        "userassist": spark.createDataFrame([("2026-01-01T00:00:00Z", "C:\\a\\B.exe", "S-1"), ("junk", "x", "y"), (None, None, None)], "last_run_utc string, decoded_path string, sid string"),
        "jump_lists": spark.createDataFrame([("2026-01-01 00:00:01.5", None, "2026-01-02T00:00:00+02:00", "D:/x/y.doc")], "last_accessed_utc string, lnk_created_utc string, lnk_modified_utc string, path string"),
        "usn": spark.createDataFrame([("2026-01-01 00:00:00", "f", "FILE_CREATE|FILE_DELETE"), ("2026-01-01 00:00:00", "f", None)], "timestamp string, filename string, reason string"),
        "tasks": spark.createDataFrame([(" high", "\\T\\x"), ("LOW", "y")], "tier string, task_name string"),
        "prefetch": spark.createDataFrame([("a",)], "executable string"),
    }
    rows = timeline.in_order(timeline.build_timeline(tables, "2026-03-01 00:00:00")).collect()
    assert sorted((r["datetime"], r["sourcetype"], r["type"], r["short"]) for r in rows) == sorted([
        ("2026-01-01 00:00:00.000000", "UserAssist", "Last Run", "Run: B.exe"), ("2026-01-01 00:00:01.500000", "JumpList", "Accessed", "JumpList: y.doc"), ("2026-01-01 22:00:00.000000", "JumpList", "Modified", "JumpList: y.doc"),
        ("2026-01-01 00:00:00.000000", "usn.csv", "File Deleted", "f"), ("2026-01-01 00:00:00.000000", "usn.csv", "File Modified", "f"), ("2026-03-01 00:00:00.000000", "ScheduledTasks", "High Task", "Task: x"),
    ])


def test_pages_and_searches(spark):
    rows = spark.createDataFrame([(1, "10"), (2, "9"), (3, "b"), (4, "A"), (5, None)], "id long, v string")
    page = lambda **x: [r["id"] for r in search.artifact_page(rows, search.ArtifactQuery(), "v", tie=("id",), **x).collect()]
    assert page() == [2, 1, 5, 4, 3] and page(ascending=False, limit=2) == [3, 4] and page(offset=3, limit=9999) == [4, 3]
    assert [r["id"] for r in rows.where(search.ArtifactQuery("v", ("a ", "9")).condition(rows.columns)).collect()] == [2, 4]
    with pytest.raises(ValueError):
        search.search_all({"r": rows}, "x", {"r": "id"})
    found = search.search_all({"r": rows, "s": rows.limit(0)}, "10", {"r": "id", "s": "id"}).collect()
    assert [(r["artifact"], r["total"], r["place"], r["row"]["v"]) for r in found] == [("r", 1, 1, "10")]


def test_reconciliation_and_masks(spark):
    m = integrity.parse_manifest(spark.createDataFrame([("a" * 64 + "  x/y z",), ("b" * 64 + " *q",), ("junk",), (None,), ("c" * 64 + "  gone",)], "value string"))
    files = spark.createDataFrame([("x/y z", "A" * 64), ("q", "0" * 64), ("new", "1" * 64), ("manifest.json", "2" * 64), ("lab_report/z", "3" * 64)], "path string, sha256 string")
    r = integrity.reconcile(m, files)
    assert {(x["path"], x["status"]) for x in r.collect()} == {("x/y z", "ok"), ("q", "mismatch"), ("gone", "missing"), ("new", "extra")}
    assert tuple(integrity.verdict(r).first()) == (1, 1, 1, 1, "failed") and integrity.verdict(r.limit(0)).first()["status"] == "ok"
    got = spark.createDataFrame([(0x101,), (0x80000008,), (0,), (None,)], "m long").select(triage.usn_reasons(F.col("m"))).collect()
    assert [x[0] for x in got] == ["DATA_OVERWRITE|FILE_CREATE", "CLOSE|UNKNOWN(0x8)", "", ""]
    t = spark.sql("select 133485408000000000L as f").select(triage.filetime(F.col("f")).alias("t")).first()["t"]
    assert t.replace(tzinfo=None) == datetime.datetime(2024, 1, 1)


def test_tokens_anywhere_in_a_web_file(spark):
    pad = "x" * triage.WEB_FILE_HEAD
    files = spark.createDataFrame([(1, pad + " XP_cmdshell"), (2, "eval( " + pad + " $_post"), (3, pad), (4, None), (5, "popen(")], "id int, text string")
    got = lambda **head: {r["id"]: (r["strong"], r["weak"], r["triage"]) for r in triage.web_file_triage(files, "text", **head).collect()}
    assert got() == {1: (1, 0, "HIGH"), 2: (0, 2, "NOTABLE"), 3: (0, 0, "INFO"), 4: (0, 0, "INFO"), 5: (1, 0, "HIGH")}
    assert got(head=triage.WEB_FILE_HEAD) == {1: (0, 0, "INFO"), 2: (0, 1, "INFO"), 3: (0, 0, "INFO"), 4: (0, 0, "INFO"), 5: (1, 0, "HIGH")}


def test_module_extensions_and_tiers(spark):
    paths = {"C:\\a.b\\X.DLL": ".dll", "c:\\x.exe -k y.txt": ".exe", "c:\\a.b\\x": "", "": "", "x.": "."}
    df = spark.createDataFrame([(p, t) for p, t in zip(paths, ("info", "HIGH ", "odd", None, "notable"))], "p string, tier string")
    assert {r["p"]: r["e"] for r in df.select("p", correlate.module_extension(F.col("p")).alias("e")).collect()} == paths
    assert [r["tier"] for r in correlate.by_tier(df, "tier", "p").collect()] == ["HIGH ", "notable", "info", None, "odd"]


def test_stored_trigram_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "PowerShell run", None), (2, "power", "shell"), (3, None, None), (1, "PowerShell run", None), (4, "x" * 200 + "abc" * 60, "")], "id long, a string, b string")
    search.store_trigram_index(search.trigram_index(rows, "id", ("a", "b")), str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    found = lambda q: sorted(r["id"] for r in search.trigram_search(index, rows, "id", ("a", "b"), q).collect())
    assert found("powershell") == [1, 1] and found("pow") == [1, 1, 2] and found("zz") == [] and found("".join(chr(97 + i % 26) + str(i) for i in range(80))) == [] and found("x" * 100 + "abcabcabc"[:0]) == [4]
