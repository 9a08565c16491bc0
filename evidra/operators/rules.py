"""Declarative detection rules: conditions over columns, compiled to Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_COLUMNS = ("rule_id", "severity", "mitre_technique", "title", "evidence_source", "evidence_detail", "timeline_search_key")
#: Severities, the most severe first.
SEVERITIES = ("HIGH", "NOTABLE", "INFO")
_COMBINATORS = ("all", "any", "not")
#: Of several operators on one leaf the first of these counts.
_OPERATORS = ("exists", "equals", "not_equals", "in", "not_in", "contains", "not_contains", "contains_any", "not_contains_any", "starts_with", "regex")


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass(frozen=True)
class Rule:
    """One rule. `match` is a tree of all / any / not and leaves {field, operator: value}; None matches every row."""

    id: str
    title: str
    severity: str = ""
    mitre: str = ""
    sources: tuple[str, ...] = ()
    match: Mapping | None = None
    evidence: str = ""
    evidence_source: str = ""
    timeline_key: str = ""
    severity_from: str = ""
    enabled: bool = True
    origin: str = field(default="", compare=False)

    @classmethod
    def from_mapping(cls, spec: Mapping, origin: str = "") -> Rule:
        """A rule from its file form; raises RuleError if it is not well-formed, also if it is disabled."""
        if not isinstance(spec, Mapping):
            raise RuleError("a rule must be a mapping")
        known = {"id", "title", "severity", "mitre", "source", "sources", "match", "evidence", "evidence_source", "timeline_key", "severity_from", "enabled"}
        if unknown := {*spec} - known:
            raise RuleError(f"unknown keys: {', '.join(sorted(unknown))}")
        sources = tuple(dict.fromkeys([*([spec["source"]] if spec.get("source") else []), *(spec.get("sources") or [])]))
        text = lambda k: str(spec.get(k) or "")
        rule = cls(text("id"), text("title"), text("severity").upper(), text("mitre"), sources, spec.get("match"), text("evidence"), text("evidence_source"), text("timeline_key"), text("severity_from"), spec.get("enabled", True) is not False, origin)
        for name, value in (("id", rule.id), ("title", rule.title), ("sources", rule.sources)):
            if not value:
                raise RuleError(f"{rule.id or 'a rule'}: {name} is missing")
        if not rule.severity_from and rule.severity not in SEVERITIES:
            raise RuleError(f"{rule.id}: severity must be one of {', '.join(SEVERITIES)}")
        if rule.match is not None:
            check_condition(rule.match)
        return rule


def check_condition(node: Mapping) -> None:
    """Raise RuleError unless a condition tree is well-formed: one combinator, or a field with at least one operator."""
    if not isinstance(node, Mapping):
        raise RuleError("a condition must be a mapping")
    combinators = [k for k in _COMBINATORS if k in node and node[k] not in (None, [])]
    operators = [k for k in _OPERATORS if node.get(k) is not None]
    if combinators:
        if len(combinators) > 1 or node.get("field") or operators:
            raise RuleError("a condition has more than one combinator, or a combinator beside a field")
        below = node[combinators[0]]
        for x in below if combinators[0] != "not" else [below]:
            check_condition(x)
        return
    if not node.get("field"):
        raise RuleError("a condition has neither a combinator nor a field")
    if not operators:
        raise RuleError(f"{node['field']}: no operator")
    if "regex" in operators:
        java_pattern(str(node["regex"]))


def java_pattern(pattern: str) -> str:
    """A linear-time pattern in Java's spelling, ignoring case; RuleError for what only backtracking can match or what is broken."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?>|[*+?}]\+|\(\?U", pattern):
        raise RuleError(f"pattern needs backtracking: {pattern}")
    spelled = pattern.replace("(?P<", "(?<")
    for posix in ("alpha", "digit", "alnum", "upper", "lower", "punct", "xdigit"):
        java = "XDigit" if posix == "xdigit" else posix.capitalize()
        spelled = spelled.replace(f"[:{posix}:]", rf"\p{{{java}}}")
    spelled = spelled.replace("[:space:]", r"\s")
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", spelled.replace("(?<", "(?P<")))
    except re.error as e:
        raise RuleError(f"pattern is broken: {pattern}: {e}") from e
    return "(?iu)" + spelled


def _value(columns: Iterable[str], name: str) -> Column:
    """A column by its name in any case, absent and null ones as empty."""
    by_name = {c.lower(): c for c in reversed([*columns])}
    found = by_name.get(name.lower())
    return F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")) if found else F.lit("")


def compile_condition(node: Mapping | None, columns: Iterable[str]) -> Column:
    """The condition tree as one Column that is never null; a missing column reads as empty."""
    columns = [*columns]
    if node is None:
        return F.lit(True)
    for k, join in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if node.get(k):
            return reduce(join, [compile_condition(x, columns) for x in node[k]])
    if node.get("not"):
        return ~compile_condition(node["not"], columns)
    name = str(node["field"])
    op = next(k for k in _OPERATORS if node.get(k) is not None)
    want = node[op]
    raw = _value(columns, name)
    low = F.lower(raw)
    each = [str(x).lower() for x in want] if isinstance(want, (list, tuple)) else [str(want).lower()]
    if op == "exists":
        return F.lit((name.lower() in {c.lower() for c in columns}) == bool(want))
    if op in ("equals", "not_equals"):
        found = low == F.lit(each[0])
    elif op in ("in", "not_in"):
        found = low.isin(each) if each else F.lit(False)
    elif op in ("contains", "not_contains", "contains_any", "not_contains_any"):
        found = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in each], F.lit(False))
    elif op == "starts_with":
        found = F.startswith(low, F.lit(each[0]))
    else:
        found = raw.rlike(java_pattern(str(want)))
    return ~found if op.startswith("not_") else found


def render(template: str, columns: Iterable[str], extra: Mapping[str, Column] | None = None) -> Column:
    """A template with {column} tokens; unknown ones are empty, `{}` and an unmatched brace stay."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{([^{}]+)\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append((extra or {}).get(m[1]) if m[1] in (extra or {}) else _value(columns, m[1]))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def _hit(rule: Rule, columns: list[str], source: str) -> tuple[Column, Column]:
    """The condition of a rule on one source, and the hit that a matching row makes."""
    base = source.replace("\\", "/").rpartition("/")[2]
    extra = {"source_file": F.col("source_file") if "source_file" in columns else F.lit(base), "source_path": F.lit(source)}
    matched = compile_condition(rule.match, columns)
    severity = F.lit(rule.severity)
    if rule.severity_from:
        severity = F.upper(F.trim(_value(columns, rule.severity_from)))
        matched = matched & severity.isin(*SEVERITIES)
    shown = rule.evidence_source or (source if not any(x in source for x in "*?[") else "{source_file}")
    values = (F.lit(rule.id), severity, F.lit(rule.mitre), F.lit(rule.title), render(shown, columns, extra), render(rule.evidence, columns, extra), render(rule.timeline_key, columns, extra))
    return matched, F.struct(*(v.alias(n) for n, v in zip(HIT_COLUMNS, values)))


def evaluate(rules: Iterable[Rule], tables: Mapping[str, DataFrame]) -> DataFrame:
    """All hits of the enabled rules. `tables` has a DataFrame for each source name that exists.

    The rules that read one table are evaluated in one scan of it: a row is turned into an array of the hits it makes.
    A source without table gives no rows; a rule with several sources gives the hits of all of them.
    """
    by_source: dict[str, list[Rule]] = {}
    for rule in rules:
        for source in rule.sources if rule.enabled else ():
            if source in tables:
                by_source.setdefault(source, []).append(rule)
    found = []
    for source, mine in by_source.items():
        df = tables[source]
        hits = [F.when(matched, hit) for matched, hit in (_hit(r, df.columns, source) for r in mine)]
        found.append(df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h")).select("h.*"))
    if not found:
        some = next(iter(tables.values()), None)
        if some is None:
            raise RuleError("no tables to evaluate rules on")
        return some.sparkSession.createDataFrame([], ", ".join(f"{x} string" for x in HIT_COLUMNS))
    return reduce(DataFrame.unionByName, found)


def overlay(rules: Iterable[Rule], more: Iterable[Mapping], origin: str = "") -> tuple[list[Rule], list[str]]:
    """Rules with others laid over them by id, in stable order, and the warnings for those left out or replaced.

    A rule of a known id replaces it in place, a new one comes last; a disabled one takes its id out, an enabled one
    later brings it back once. A broken rule is left out with a warning.
    """
    by_id = {r.id: r for r in rules}
    warnings = []
    for spec in more:
        try:
            rule = Rule.from_mapping(spec, origin)
        except RuleError as e:
            warnings.append(f"{origin or 'rule'}: {e}")
            continue
        if rule.enabled and rule.id in by_id and by_id[rule.id].enabled:
            warnings.append(f"{origin or 'rule'}: {rule.id} replaces the rule of {by_id[rule.id].origin or 'the defaults'}")
        by_id[rule.id] = rule
    return [r for r in by_id.values() if r.enabled], warnings


def ordered(hits: DataFrame) -> DataFrame:
    """Hits in their total order: severity (unknown ones last), then rule, source, key, detail, title, technique."""
    rank = reduce(lambda acc, s: acc.when(F.col("severity") == s[1], s[0]), enumerate(SEVERITIES), F)
    return hits.orderBy(rank.otherwise(len(SEVERITIES)), "rule_id", "evidence_source", "timeline_search_key", "evidence_detail", "title", "mitre_technique")
