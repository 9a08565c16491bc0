"""XML texts as ordered, nested records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring as _quoted
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements nested deeper than this are not part of the nested record; `elements_below` has them as flat rows.
DEEPEST = 40
_DECLARATION = re.compile(r"^<\?xml\s[^>]*\?>")


def _bare(text: str) -> str:
    return _DECLARATION.sub("", text.removeprefix("﻿"))


def parse_xml(text: str | None) -> tuple[str | None, int]:
    """A well-formed XML text as JSON, and the depth of its elements; (None, 0) for any other text.

    Each element is {n: name without prefix, k: place among the siblings of its name if not the first, t: its own text,
    a: attributes, c: element children}, without what is empty. The declaration and a byte-order mark are of no account,
    comments count for nothing, CDATA is text. Elements below DEEPEST levels are left to `elements_below`.
    """
    if not text:
        return None, 0
    text = _bare(text)
    depth = 0
    # of each open element: name, place among its name's, texts, attributes, children as JSON, how often each name came
    stack: list[tuple] = [("", 1, [], {}, [], {})]

    def start(name: str, attributes: dict) -> None:
        nonlocal depth
        name = name.rpartition(":")[2]
        counts = stack[-1][5]
        counts[name] = same = counts.get(name, 0) + 1
        if depth < len(stack) <= DEEPEST:
            depth = len(stack)
        stack.append((name, same, [], attributes, [], {}))

    def end(_: str) -> None:
        name, same, texts, attributes, children, _ = stack.pop()
        if len(stack) > DEEPEST:
            return
        own = "".join(texts).strip()
        stack[-1][4].append(
            f'{{"n":{_quoted(name)}' + (f',"k":{same}' if same > 1 else "") + (f',"t":{_quoted(own)}' if own else "")
            + (f',"a":{json.dumps(attributes, ensure_ascii=False)}' if attributes else "") + (f',"c":[{",".join(children)}]' if children else "") + "}"
        )

    def data(x: str) -> None:
        stack[-1][2].append(x)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, UnicodeEncodeError, ValueError):
        return None, 0
    return stack[0][4][0], depth


def elements_below(text: str, levels: int = DEEPEST, step: int = 256) -> Iterator[list[tuple]]:
    """The elements below so many levels of a well-formed XML text, a few at a time, in the order in which they end.

    Each is its level, node_id, parent_id, path and same_id (the names and the places among their names' from the root
    down), text, and attributes as JSON. The text is read in pieces of `step` characters, since the paths of one deep
    text may together be long.
    """
    text, out = _bare(text), []
    places: list[int] = [0]
    seen: list[dict[str, int]] = [{}]
    # of each open element: node_id, path, same_id, its texts, attributes
    stack: list[tuple] = []

    def start(name: str, attributes: dict) -> None:
        name = name.rpartition(":")[2]
        places[-1] += 1
        seen[-1][name] = same = seen[-1].get(name, 0) + 1
        node, path, sames = (f"{stack[-1][0]}.{places[-1]}", f"{stack[-1][1]}/{name}", f"{stack[-1][2]}.{same}") if stack else ("1", name, "1")
        stack.append((node, path, sames, [], attributes))
        places.append(0)
        seen.append({})

    def end(_: str) -> None:
        if len(stack) > levels:
            node, path, sames, texts, attributes = stack[-1]
            out.append((len(stack), node, stack[-2][0], path, sames, "".join(texts).strip(), json.dumps(attributes, ensure_ascii=False)))
        stack.pop()
        places.pop()
        seen.pop()

    def data(x: str) -> None:
        if len(stack) > levels:
            stack[-1][3].append(x)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    for i in range(0, len(text), step):
        parser.Parse(text[i : i + step], i + step >= len(text))
        if out:
            yield out[:]
            out.clear()


def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_xml(x) for x in texts], columns=["json", "depth"])


def xml_to_json(text: Column) -> Column:
    """A struct of json and depth; json is null for null, empty and not well-formed texts."""
    return F.pandas_udf(_parse, "json string, depth int")(text)
