"""Rule files: YAML (or JSON) with a list of rules."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Mapping

from evidra.operators.rules import Rule, overlay

try:
    import yaml
except ImportError:  # then the part of YAML that rule files need is read here
    yaml = None


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1].replace("''", "'") if text[0] == "'" else json.loads(text)
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [_scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|$)""", inner)] if inner else []
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def parse_simple(text: str):
    """Block mappings and lists, flow lists, quoted and plain scalars, | and > texts, comments."""
    lines = []
    for raw in text.splitlines():
        bare = re.sub(r"""^((?:[^#"']|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')*?)(?:(?<=\s)|^)#.*$""", r"\1", raw)
        lines.append((len(raw) - len(raw.lstrip()), bare.strip(), raw))
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(lines) and not lines[at][1]:
            at += 1

    def block(indent: int):
        nonlocal at
        blank()
        if at >= len(lines) or lines[at][0] < indent:
            return None
        deep = lines[at][0]
        out = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while True:
            blank()
            if at >= len(lines) or lines[at][0] != deep:
                if at < len(lines) and lines[at][0] > deep:
                    raise ValueError(f"line {at + 1}: indentation")
                return out
            _, line, raw = lines[at]
            if isinstance(out, list):
                if not line.startswith("-"):
                    return out
                rest = line[1:].strip()
                if re.match(r"^[^\s'\"\[][^:]*:(\s|$)", rest):
                    inside = deep + len(line) - len(line[1:].lstrip())
                    lines[at] = (inside, rest, raw)
                    out.append(block(inside))
                else:
                    at += 1
                    out.append(_scalar(rest) if rest else block(deep + 1))
                continue
            m = re.match(r"""^("[^"]*"|'[^']*'|[^:]+):(?:\s+(.*))?$""", line)
            if not m:
                raise ValueError(f"line {at + 1}: {line}")
            key, rest = str(_scalar(m[1])), (m[2] or "").strip()
            at += 1
            if rest[:1] in "|>" and rest[:1]:
                held = []
                while at < len(lines) and (not lines[at][2].strip() or lines[at][0] > deep):
                    held.append(lines[at][2])
                    at += 1
                cut = min((len(x) - len(x.lstrip()) for x in held if x.strip()), default=0)
                out[key] = ("\n" if rest[0] == "|" else " ").join(x[cut:] for x in held).strip() + ("\n" if rest[0] == "|" and "-" not in rest else "")
            elif rest:
                out[key] = _scalar(rest)
            else:
                blank()
                nested = at < len(lines) and (lines[at][0] > deep or (lines[at][0] == deep and lines[at][1].startswith("- ")))
                out[key] = block(lines[at][0]) if nested else None

    return block(0)


def parse_rules(text: str) -> list[Mapping]:
    """The rules of one file; ValueError if it is not one."""
    try:
        found = yaml.safe_load(text) if yaml else (json.loads(text) if text.lstrip().startswith("{") else parse_simple(text))
    except Exception as e:
        raise ValueError(f"not a rule file: {e}") from e
    rules = found.get("rules") if isinstance(found, Mapping) else None
    if not isinstance(rules, list):
        raise ValueError("a rule file has a list of rules")
    return rules


def load_rules(folder: str, base: list[Rule] = ()) -> tuple[list[Rule], list[str]]:
    """Rules with the files of a folder laid over them in order of name, and the warnings. A malformed file is passed over with a warning."""
    rules, warnings = [*base], []
    for path in sorted(glob.glob(os.path.join(folder, "*.y*ml")) + glob.glob(os.path.join(folder, "*.json"))):
        try:
            with open(path, encoding="utf-8") as f:
                specs = parse_rules(f.read())
        except (OSError, ValueError) as e:
            warnings.append(f"{os.path.basename(path)}: {e}")
            continue
        rules, more = overlay(rules, specs, os.path.basename(path))
        warnings += more
    return rules, warnings
