"""Queries of the rule language: one for each operator, and for what rules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidra.operators.rules import Rule, evaluate, ordered, overlay
from evidra.session import read_table

SOURCE = "evtx_rows"

#: name: (condition, the same in SQL over d, the event data in lower case, and e, the event id in lower case)
CONDITIONS: dict[str, tuple[dict | None, str]] = {
    "equals": ({"field": "Event_ID", "equals": "4688"}, "e = '4688'"),
    "not_equals": ({"field": "event_id", "not_equals": "4624"}, "e <> '4624'"),
    "absent_not_equals": ({"field": "no_such_column", "not_equals": "x"}, "TRUE"),
    "in": ({"field": "event_id", "in": ["4720", "4738", "1102"]}, "e IN ('4720', '4738', '1102')"),
    "not_in": ({"field": "event_id", "not_in": ["4624", "4625", "4688"]}, "e NOT IN ('4624', '4625', '4688')"),
    "contains": ({"field": "event_data", "contains": "MSHTA.exe"}, "contains(d, 'mshta.exe')"),
    "not_contains": ({"field": "event_data", "not_contains": "subject"}, "NOT contains(d, 'subject')"),
    "contains_any": ({"field": "event_data", "contains_any": ["curl.exe", "WinWord.exe"]}, "contains(d, 'curl.exe') OR contains(d, 'winword.exe')"),
    "not_contains_any": ({"field": "event_data", "not_contains_any": ["system", "ipaddress"]}, "NOT (contains(d, 'system') OR contains(d, 'ipaddress'))"),
    "starts_with": ({"field": "event_data", "starts_with": '{"Image'}, "starts_with(d, '{\"image')"),
    "regex": ({"field": "event_data", "regex": r"logontype\W+(?:3|10)\b"}, r"regexp_matches(coalesce(event_data, ''), '(?i)logontype\W+(?:3|10)\b')"),
    "exists": ({"all": [{"field": "computer", "exists": True}, {"field": "level", "equals": "4"}]}, "coalesce(lower(level), '') = '4'"),
    "all": ({"all": [{"field": "event_id", "equals": "4625"}, {"field": "event_data", "contains": "svc_"}]}, "e = '4625' AND contains(d, 'svc_')"),
    "any": ({"any": [{"field": "event_id", "equals": "7045"}, {"field": "channel", "contains": "defender"}]}, "e = '7045' OR contains(lower(coalesce(channel, '')), 'defender')"),
    "not": ({"not": {"field": "channel", "equals": "security"}}, "NOT (lower(coalesce(channel, '')) = 'security')"),
    "nested": (
        {"all": [{"field": "event_id", "equals": "4624"}, {"field": "event_data", "contains": '"LogonType":10'}, {"not": {"field": "event_data", "contains_any": ['"IpAddress":"127.0.0.1"', '"IpAddress":"::1"', '"IpAddress":"-"']}}]},
        "e = '4624' AND contains(d, '\"logontype\":10') AND NOT (contains(d, '\"ipaddress\":\"127.0.0.1\"') OR contains(d, '\"ipaddress\":\"::1\"') OR contains(d, '\"ipaddress\":\"-\"'))",
    ),
    "no_match": (None, "TRUE"),
}

_VIEW = "(SELECT *, lower(coalesce(event_data, '')) AS d, lower(coalesce(event_id, '')) AS e FROM evtx_rows)"


def _rule(name: str, match: dict | None, **more: str) -> Rule:
    values = {"id": f"R-{name}", "title": f"Rule {name}", "severity": "NOTABLE", "mitre": "T0000", "sources": (SOURCE,), "match": match, "evidence": "{event_id} on {computer}{nothing}: {event_data}", "timeline_key": "{provider}"}
    return Rule(**(values | more))


def _sql(name: str, where: str, severity: str = "'NOTABLE'", evidence: str | None = None, source: str = "'evtx_rows'") -> str:
    evidence = evidence or "coalesce(event_id, '') || ' on ' || coalesce(computer, '') || ': ' || coalesce(event_data, '')"
    return f"SELECT 'R-{name}' AS rule_id, {severity} AS severity, 'T0000' AS mitre_technique, 'Rule {name}' AS title, {source} AS evidence_source, {evidence} AS evidence_detail, coalesce(provider, '') AS timeline_search_key FROM {_VIEW} WHERE {where}"


def _query(rules: list[Rule]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: evaluate(rules, {SOURCE: read_table(spark, sf, SOURCE)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_{n}": _query([_rule(n, match)]) for n, (match, _) in CONDITIONS.items()}
ORACLE_SQL: dict[str, str] = {f"rule_{n}": _sql(n, where) for n, (_, where) in CONDITIONS.items()}

QUERIES["rule_severity_from"] = lambda spark, sf: evaluate(
    [_rule("tier", None, severity="", severity_from="tier")], {SOURCE: read_table(spark, sf, SOURCE).selectExpr("*", "case level when '1' then ' high' when '2' then 'Notable' when '3' then 'info' else 'low' end as tier")}
)
ORACLE_SQL["rule_severity_from"] = _sql("tier", "level IN ('1', '2', '3')", "CASE level WHEN '1' THEN 'HIGH' WHEN '2' THEN 'NOTABLE' ELSE 'INFO' END")

QUERIES["rule_template"] = _query([_rule("template", {"field": "event_id", "equals": "1102"}, evidence="{} {source_file}|{source_path}|{COMPUTER}|{unknown}|{open", evidence_source="log {channel}")])
ORACLE_SQL["rule_template"] = _sql("template", "e = '1102'", evidence="'{} evtx_rows|evtx_rows|' || coalesce(computer, '') || '||{open'", source="'log ' || coalesce(channel, '')")


def _by_channel(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    rows = read_table(spark, sf, SOURCE)
    return {"evtx/Security.csv": rows.where("channel = 'Security'"), "evtx/System.csv": rows.where("channel = 'System'")}


def rule_multi_source(spark: SparkSession, sf: str) -> DataFrame:
    """A rule over several sources, one of them absent."""
    rule = _rule("sources", {"field": "event_id", "in": ["1102", "7045"]}, sources=("evtx/Security.csv", "evtx/System.csv", "evtx/Absent.csv"), evidence_source="{source_file}")
    return evaluate([rule], _by_channel(spark, sf))


def rule_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Rules after an overlay: one replaced, one disabled, one new, one broken and left out."""
    base = [_rule("a", {"field": "event_id", "equals": "4624"}), _rule("b", {"field": "event_id", "equals": "4625"})]
    spec = lambda n, value, **x: {"id": f"R-{n}", "title": f"Rule {n}", "severity": "HIGH", "mitre": "T0000", "source": SOURCE, "match": {"field": "event_id", "equals": value}, "evidence": "{event_id} on {computer}: {event_data}", "timeline_key": "{provider}"} | x
    rules, _ = overlay(base, [spec("a", "4720"), spec("b", "4625", enabled=False), spec("c", "7045"), spec("d", "1", match={"field": "x"})], "overlay")
    return evaluate(rules, {SOURCE: read_table(spark, sf, SOURCE)})


def rules_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Many rules in one scan of their table."""
    return evaluate([_rule(n, match) for n, (match, _) in CONDITIONS.items() if match], {SOURCE: read_table(spark, sf, SOURCE)})


def hits_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Hits in their total order."""
    return ordered(evaluate([_rule("a", CONDITIONS["equals"][0]), _rule("b", CONDITIONS["any"][0], severity="HIGH"), _rule("c", CONDITIONS["in"][0], severity="INFO")], {SOURCE: read_table(spark, sf, SOURCE)}))


QUERIES |= {"rule_multi_source": rule_multi_source, "rule_overlay": rule_overlay, "rules_fused": rules_fused, "hits_sorted": hits_sorted}
ORACLE_SQL |= {
    "rule_multi_source": _sql("sources", "channel IN ('Security', 'System') AND e IN ('1102', '7045')", source="channel || '.csv'"),
    "rule_overlay": _sql("a", "e = '4720'", "'HIGH'") + " UNION ALL " + _sql("c", "e = '7045'", "'HIGH'"),
    "rules_fused": " UNION ALL ".join(_sql(n, where) for n, (match, where) in CONDITIONS.items() if match),
    "hits_sorted": " UNION ALL ".join((_sql("a", CONDITIONS["equals"][1]), _sql("b", CONDITIONS["any"][1], "'HIGH'"), _sql("c", CONDITIONS["in"][1], "'INFO'"))),
}
