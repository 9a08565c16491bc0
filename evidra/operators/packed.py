"""Several values packed in one field: dictionary-guided segmentation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.session import materialize

#: Fixed delimiters; a blank is one only where values hold none.
DELIMITERS = ";,|\t\r\n"
#: A value enters the dictionary if it is seen as a whole at least so often.
MIN_SUPPORT = 3
#: Of the dictionary, at most so many values, of so many characters together, go to every worker; the others are joined.
MOST, MOST_CHARS = 50_000, 2_000_000
_QUOTED = r'"(?:[^"]++|"")*+"'


def _cells(blanks: bool) -> str:
    """Java and Python pattern of what lies between two delimiters outside of quotes."""
    return rf'(?:{_QUOTED}|[^{DELIMITERS}{" " if blanks else ""}"]++|")++'


def known_values(packed: DataFrame, text: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """The dictionary: whole values with a delimiter inside, as they stand in quotes, in all rows of `packed`, with their counts."""
    inner = F.regexp_extract_all(F.col(text), F.lit(f"({_QUOTED})"), F.lit(1))
    values = packed.select(F.explode(inner).alias("q")).select(F.trim(F.replace(F.expr("substring(q, 2, length(q) - 2)"), F.lit('""'), F.lit('"'))).alias("value"))
    counts = values.where(F.col("value").rlike(f"[{DELIMITERS} ]")).groupBy("value").agg(F.count("*").alias("n"))
    return materialize(counts.where(F.col("n") >= min_support), "packed-values")


class Segmenter:
    """Splits a packed text into its values.

    A text is cut into cells at the delimiters outside of double quotes. An automaton of the known values finds where
    one of them, delimiters included, stands as a whole between two delimiters, outside of quotes and not beside
    others inside one cell; dynamic programming then covers the cells with the fewest values, a known one costing less
    than an unknown one, of equal covers the one with the first known value, so that a delimiter inside it is no border.
    """

    def __init__(self, known: list[str]):
        self.cells = {b: re.compile(_cells(b)) for b in (False, True)}
        self.quoted = re.compile(r'"((?:[^"]|"")*)"')
        self.automaton = None
        if known:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for x in known:
                self.automaton.add_word(x, len(x))
            self.automaton.make_automaton()

    def value(self, cell: str) -> str:
        cell = cell.strip()
        if '"' in cell:
            cell = self.quoted.sub(lambda m: m[1].replace('""', '"'), cell).strip()
        return cell

    def spans(self, text: str, blanks: bool) -> list[tuple[int, int]]:
        """Where each cell begins and ends, without the white space around it."""
        spans = []
        for m in self.cells[blanks].finditer(text):
            a, b = m.span()
            piece = m[0]
            a += len(piece) - len(piece.lstrip())
            b -= len(piece) - len(piece.rstrip())
            if a < b:
                spans.append((a, b))
        return spans

    def split(self, text: str, blanks: bool, more: Iterable[tuple[int, int]] = ()) -> list[str]:
        """`more`: the first and the last cell of known values that the automaton doesn't hold."""
        spans = self.spans(text, blanks)
        known = [*more]
        if self.automaton is not None and len(spans) > 1:
            first, last = {a: i for i, (a, _) in enumerate(spans)}, {b: i for i, (_, b) in enumerate(spans)}
            for end, size in self.automaton.iter(text):
                i, j = first.get(end + 1 - size), last.get(end + 1)
                if i is not None and j is not None and i < j:
                    known.append((i, j))
        if not known:
            out = (self.value(text[a:b]) for a, b in spans)
        else:
            by_end: dict[int, list[int]] = {}
            for i, j in known:
                by_end.setdefault(j, []).append(i)
            best: list[tuple[float, int]] = [(0.0, 0)]
            for k in range(len(spans)):
                options = [(best[k][0] + 1.0, k)] + [(best[i][0] + 0.9, i) for i in by_end.get(k, ())]
                best.append(min(options, key=lambda x: (x[0], -x[1])))
            cuts, k = [], len(spans)
            while k:
                i = best[k][1]
                cuts.append((spans[i][0], spans[k - 1][1]))
                k = i
            out = (self.value(text[a:b]) for a, b in reversed(cuts))
        return [x for x in out if x]


def stretches(rows: DataFrame, text: str, blanks: str, sizes: list[int]) -> DataFrame:
    """The stretches of two or more cells that have one of `sizes` characters: row, the first and the last cell, value."""
    shared = rows.sparkSession.sparkContext.broadcast({*sizes})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter, sizes = Segmenter([]), shared.value
        longest = max(sizes)
        frame = lambda out: pd.DataFrame(out, columns=["row", "i", "j", "value"])
        for batch in batches:
            out, held = [], 0
            for row, t, b in zip(batch["row"].tolist(), batch["t"], batch["b"]):
                spans = segmenter.spans(t, bool(b))
                for i, (a, _) in enumerate(spans):
                    for j in range(i + 1, len(spans)):
                        size = spans[j][1] - a
                        if size > longest:
                            break
                        if size in sizes:
                            out.append((row, i, j, t[a : a + size]))
                            held += size
                            if held > 1_000_000:
                                yield frame(out)
                                out, held = [], 0
            yield frame(out)

    return rows.select("row", F.col(text).alias("t"), F.coalesce(F.col(blanks), F.lit(False)).alias("b")).mapInPandas(find, "row long, i int, j int, value string")


def unpack(packed: DataFrame, text: str, blanks: str, min_support: int = MIN_SUPPORT, most: int = MOST, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each value of the column `text`: the other columns, position (from 1) and value.

    `blanks` names a boolean column: whether a blank separates values in that row. Values come without enclosing
    quotes and outer blanks; empty pieces don't count. Null, empty, blank and `-` texts give no rows; repeated rows are
    each unpacked. Columns of `packed` named position or value are dropped. The whole dictionary counts: its common
    values, as many as `most` and `most_chars` allow, go to every worker, the rest, rare by that choice, are joined with
    the stretches of cells that are as long as one of them.
    """
    keep = [x for x in packed.columns if x.lower() not in ("position", "value", text.lower(), blanks.lower())]
    rows = packed.where(F.col(text).isNotNull() & ~F.trim(F.col(text)).isin("", "-"))
    known = known_values(rows, text, min_support)
    sizes = known.select(*(F.struct(F.count_if(F.col("n") >= 2**k).alias("values"), F.sum(F.when(F.col("n") >= 2**k, F.length("value")).otherwise(0)).alias("chars")) for k in range(63))).first()
    k = next(k for k in range(63) if sizes[k]["values"] <= most and (sizes[k]["chars"] or 0) <= most_chars)
    shared = packed.sparkSession.sparkContext.broadcast(sorted(r["value"] for r in known.where(F.col("n") >= 2**k).collect()))
    joined = []
    if k:
        rows = materialize(rows.select(*keep, F.col(text).alias("_text"), F.col(blanks).alias("_blanks"), F.monotonically_increasing_id().alias("_row")), "packed-rows")
        text, blanks, rare = "_text", "_blanks", known.where(F.col("n") < 2**k).select("value")
        lengths = [r[0] for r in rare.select(F.length("value")).distinct().collect()]
        found = stretches(rows.withColumnRenamed("_row", "row"), text, blanks, lengths).join(rare, "value")
        rows = rows.join(found.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("i", "j")).alias("_more")), "_row", "left")
        joined = [F.col("_more")]

    def split(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        segmenter = Segmenter(shared.value)
        for texts, flags, *more in batches:
            spans = ([(x["i"], x["j"]) for x in m] if m is not None else () for m in more[0]) if more else repeat(())
            yield pd.Series([segmenter.split(t, bool(b), m) for t, b, m in zip(texts, flags, spans)], dtype=object)

    values = F.pandas_udf(split, "array<string>")(F.col(text), F.coalesce(F.col(blanks), F.lit(False)), *joined)
    return rows.select(*keep, F.posexplode(values).alias("position", "value")).withColumn("position", (F.col("position") + 1).cast("int"))
