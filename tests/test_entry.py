import math
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def test_every_query_agrees_with_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert {*oracle} <= {*queries}
    wrong = []
    for name, sql in oracle.items():
        found = queries[name](spark, SF)
        columns = sorted(found.columns)
        cursor = db.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr) if sorted(names) == columns else None
        if sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr) != want:
            wrong.append(name)
    assert not wrong


#: Queries whose order is the feature, with the columns that tell it.
IN_ORDER = {"timeline_page_desc": ("datetime", "event_id"), "timeline_page_asc": ("datetime", "event_id"), "artifact_sort_mixed": ("record_id",), "search_all_tables": ("total", "artifact", "place")}


def test_order_where_it_is_the_feature(spark):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name, columns in IN_ORDER.items():
        cursor = db.execute(oracle[name])
        names = [d[0] for d in cursor.description]
        want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
        assert [tuple(r[c] for c in columns) for r in queries[name](spark, SF).collect()] == want, name
    at = [r["datetime"] for r in queries["timeline_union_sort"](spark, SF).collect()]
    assert at == sorted(at)


def test_queries_without_sql_give_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    oracle = entry.oracle_sql()
    for name, f in entry.queries().items():
        if name not in oracle and not name.startswith("p"):
            assert f(spark, SF).count() > 0, name
