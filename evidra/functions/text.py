"""Text helpers as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any white space, also no-break and other Unicode blanks.
BLANKS = r"[\s\p{Z}\x{FEFF}\x{200B}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """Lower case, blanks collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), BLANKS, " "))


def bare(c: Column) -> Column:
    """Without outer blanks; null where nothing, or only `-`, is left."""
    t = F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", "")
    return F.when((t != "") & (t != "-"), t)


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with more columns, each computed once per row: the optimizer neither copies nor moves expressions across."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("_fence")).select(*(F.col(x) for x in df.columns if x not in columns), "_fence.*")
