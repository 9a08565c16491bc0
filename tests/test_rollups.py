import json

import pytest

from evidra.operators import rollups


def test_order_of_tables(spark):
    rows = [("evtx/Zeta", 5), ("evtx/Alpha", 0), ("evtx/System", 1), ("evtx/security", 9), ("evtx/Beta", 7), ("mft_full", 3), ("amcache/b", 1), ("amcache/A", 2)]
    got = rollups.listed(spark.createDataFrame(rows, "artifact string, n long")).collect()
    assert [r["artifact"] for r in got] == ["mft_full", "amcache/A", "amcache/b", "evtx/security", "evtx/System", "evtx/Beta", "evtx/Zeta", "evtx/Alpha"]
    assert [r["label"] for r in got][:2] == ["Root", "Amcache"]


def test_roll_ups(spark):
    schema = "name string, status string, findings array<struct<severity:string,message:string>>"
    rows = [("a", "success", [("INFO", "x"), ("critical", "y")]), ("b", "partial", []), ("c", None, None)]
    assert tuple(rollups.findings(spark.createDataFrame(rows, schema)).first()) == (1, 0, 1, "partial")
    assert tuple(rollups.findings(spark.createDataFrame([*rows, ("d", "Failed", None)], schema)).first()) == (1, 0, 1, "degraded")
    assert tuple(rollups.findings(spark.createDataFrame([], schema)).first()) == (0, 0, 0, "success")
    assert tuple(rollups.opened(spark.createDataFrame([("opened",), ("denied: 5",), (None,), ("skipped",)], "open_result string")).first()) == (4, 1, 1, 1)
    verdict = spark.createDataFrame([(3, 1, 0, 2, "failed")], "ok long, mismatch long, missing long, extra long, status string")
    assert json.loads(rollups.verify_status(verdict).first()[0]) == {"status": "failed", "filesChecked": 4, "mismatches": 1, "missing": 0, "extra": 2}


def test_a_stored_file(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.aspx").write_bytes(b"x" * 10)
    assert bytes(rollups.stored_file(spark, str(tmp_path / "web"), "a.aspx").first()["content"]) == b"x" * 10
    with pytest.raises(ValueError):
        rollups.stored_file(spark, str(tmp_path / "web"), "../secret")
