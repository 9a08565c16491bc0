"""Network addresses as Columns, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import BLANKS, let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_GROUPS = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"


def is_v4(c: Column) -> Column:
    """True for a dotted quad with octets from 0 to 255 and no leading zeros."""
    return c.rlike(V4)


def v4_number(c: Column) -> Column:
    """A dotted quad as a number."""
    parts = F.split(c, r"\.")
    return sum((parts[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)), parts[0].cast("long") * 256**3)


def in_cidr(number: Column, cidr: str) -> Column:
    """Whether an address, as a number, lies in an IPv4 network."""
    base, bits = cidr.split("/")
    low = sum(int(x) << (8 * (3 - i)) for i, x in enumerate(base.split("."))) & ~((1 << (32 - int(bits))) - 1)
    return number.between(low, low + (1 << (32 - int(bits))) - 1)


def _hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def _quad(high: Column, low: Column) -> Column:
    h, l = F.conv(high, 16, 10).cast("int"), F.conv(low, 16, 10).cast("int")
    return F.concat_ws(".", F.floor(h / 256), h % 256, F.floor(l / 256), l % 256)


def _shortest(groups: Column) -> Column:
    """Eight groups joined, the first of the longest runs of two or more zeros written as `::`."""
    out = F.array_join(groups, ":")
    cases = None
    for k in range(8, 1, -1):
        run = rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?::|$)(.*)$"
        cases = (F if cases is None else cases).when(out.rlike(run), F.regexp_replace(out, run, r"$1::$2"))
    return cases.otherwise(out)


def _v6(text: Column) -> Column:
    tail = r"^(.*:)(\d+)\.(\d+)\.(\d+)\.(\d+)$"
    part = lambda x, i: F.regexp_extract(x, tail, i).cast("int")

    def widen(x: Column) -> Column:
        quad = F.regexp_extract(x, r"([^:]*)$", 1)
        return F.when(
            quad.contains("."),
            F.when(is_v4(quad), F.concat(F.regexp_extract(x, tail, 1), _hex(part(x, 2) * 256 + part(x, 3)), F.lit(":"), _hex(part(x, 4) * 256 + part(x, 5)))),
        ).otherwise(x)

    def build(x: Column) -> Column:
        gap = x.contains("::")
        left, right = F.split_part(x, F.lit("::"), F.lit(1)), F.split_part(x, F.lit("::"), F.lit(2))
        list_of = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
        known = F.concat(list_of(left), list_of(right))
        well = left.rlike(_GROUPS) & right.rlike(_GROUPS) & (F.split_part(x, F.lit("::"), F.lit(3)) == "")
        well &= ~x.contains(":::") & F.when(gap, F.size(known) <= 7).otherwise(F.size(known) == 8)
        full = F.concat(list_of(left), F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(known), F.lit(0))), list_of(right))
        return F.when(well, F.transform(full, lambda g: F.regexp_replace(g, r"^0+(?=.)", "")))

    def show(groups: Column) -> Column:
        mapped = F.array_join(F.slice(groups, 1, 6), ":") == "0:0:0:0:0:ffff"
        return F.when(mapped, _quad(groups[6], groups[7])).otherwise(_shortest(groups))

    return let(let(widen(text), build), lambda g: F.when(g.isNotNull(), show(g)))


def canonical_address(c: Column) -> Column:
    """An address in its one spelling, or null for what is none.

    Of a list the first counts. Blanks, a port, brackets and a zone are dropped; IPv4 comes out dotted, also if
    mapped into IPv6, and IPv6 in its shortest lower-case form. Null, empty and `-` give null.
    """
    first = F.regexp_replace(F.split_part(c, F.lit(","), F.lit(1)), rf'^(?:{BLANKS}|")|(?:{BLANKS}|")$', "")
    plain = F.lower(F.regexp_replace(first, r"^\[([^\]]*)\](?::\d+)?$|^([^:]*):\d+$", "$1$2"))
    zoneless = F.regexp_replace(plain, r"%.*$", "")
    # most addresses are in that spelling already
    return F.when(is_v4(c), c).otherwise(let(zoneless, lambda x: F.when(x.contains(":"), _v6(x)).when(is_v4(x), x)))


def is_address(c: Column) -> Column:
    """True for an IPv4 or IPv6 address written alone: no port, brackets, zone or list."""
    return is_v4(c) | F.coalesce(c.rlike(r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$") & _v6(F.lower(c)).isNotNull(), F.lit(False))
