"""python -m evidra analyze|query|verify|extract: one case at a time."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evidra")
    sub = p.add_subparsers(dest="mode", required=True)
    a = sub.add_parser("analyze", help="build timeline and hits of a case")
    a.add_argument("case")
    a.add_argument("out")
    a.add_argument("--rules", default="")
    a.add_argument("--as-of")
    q = sub.add_parser("query", help="run SQL over the tables of a case")
    q.add_argument("case")
    q.add_argument("sql")
    v = sub.add_parser("verify", help="compare a case with its manifest")
    v.add_argument("case")
    v.add_argument("manifest")
    x = sub.add_parser("extract", help="indicators of threat reports as STIX")
    x.add_argument("reports")
    x.add_argument("out")
    given = p.parse_args(args)

    from evidra.case import Case
    from evidra.operators import integrity, ioc
    from evidra.session import get_spark
    from evidra.sources import files, sinks

    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    if given.mode == "analyze":
        print(Case(spark, given.case).analyze(given.out, given.rules, given.as_of))
    elif given.mode == "query":
        Case(spark, given.case).register()
        spark.sql(given.sql).show(50, False)
    elif given.mode == "verify":
        found = Case(spark, given.case).verify(given.manifest)
        found.where(F.col("status") != "ok").show(1000, False)
        outcome = integrity.verdict(found).first()
        print(outcome.asDict())
        return int(outcome["status"] != "ok")
    else:
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        sinks.write_stix(ioc.stix_objects(ioc.indicators(files.read_report(spark, given.reports), "source", "text"), now), given.out, "report")
    return 0


if __name__ == "__main__":
    sys.exit(main())
