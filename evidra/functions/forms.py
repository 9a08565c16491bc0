"""The form of a written value, and the lattice in which forms are promoted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of the forms, the first that fits counts. Slashed dates tell day and month apart only if one of them is above 12.
FORMS = (
    ("date_ymd", r"^\d{4}-\d{2}-\d{2}$"),
    ("date_compact", r"^(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$"),
    ("date_dmy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("date_slash_ymd", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("date_slash_dmy", r"^(?:1[3-9]|[2-9]\d)/\d{1,2}/\d{4}$"),
    ("date_slash_mdy", r"^\d{1,2}/(?:1[3-9]|[2-9]\d)/\d{4}$"),
    ("date_slash", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("time_hms", r"^\d{1,2}:\d{2}:\d{2}$"),
    ("time_fraction", r"^\d{1,2}:\d{2}:\d{2}[.,]\d+$"),
    ("time_hm", r"^\d{1,2}:\d{2}$"),
    ("whole", r"^[-+]?\d+$"),
    ("decimal", r"^[-+]?\d*[.,]\d+$"),
    ("hexadecimal", r"^0[xX][0-9a-fA-F]+$"),
    ("unit", r"^[-+]?\d+(?:[.,]\d+)?\s?[a-zA-Zµ%]{1,5}$"),
)
ORDER = [name for name, _ in FORMS] + ["word"]
#: One letter for each form, so that the forms of a whole line are one short text; `-` stands for no value.
LETTER = {name: chr(ord("a") + i) for i, name in enumerate(ORDER)}
NAME = {letter: name for name, letter in LETTER.items()}
_PATTERN = dict(FORMS)
#: Above each form stand those that hold its values as well: any date a `date`, of times the longer ones, and above all `word`.
ABOVE: dict[str, tuple[str, ...]] = {name: ("date", "word") for name in ORDER if name.startswith("date")} | {
    "date_compact": ("date", "whole", "decimal", "word"), "date_slash_dmy": ("date", "word"), "date_slash_mdy": ("date", "word"), "date": ("word",),
    "time_hm": ("time_hms", "time_fraction", "word"), "time_hms": ("time_fraction", "word"), "time_fraction": ("word",),
    "whole": ("decimal", "word"), "decimal": ("word",), "hexadecimal": ("word",), "unit": ("word",), "word": (),
}


def form_letter(c: Column) -> Column:
    """The letter of a value's form, `-` for null, empty and `-`. What a value begins with and holds decides which patterns are tried."""

    def first(*names: str) -> Column:
        cases = F
        for name in names:
            cases = cases.when(c.rlike(_PATTERN[name]), LETTER[name])
        return cases.otherwise(LETTER["word"])

    whole = F.when((F.length(c) == 8) & c.rlike(_PATTERN["date_compact"]), LETTER["date_compact"]).otherwise(LETTER["whole"])
    return (
        F.when(c.isNull() | c.isin("", "-"), "-")
        .when(~F.ascii(c).between(ord("+"), ord("9")), LETTER["word"])
        .when(c.rlike(_PATTERN["whole"]), whole)
        .when(c.contains(":"), first("time_hms", "time_fraction", "time_hm"))
        .when(c.contains("/"), first("date_slash_ymd", "date_slash_dmy", "date_slash_mdy", "date_slash"))
        .when(c.rlike(r"^\d+\.\d+\.\d+\."), LETTER["word"])
        .otherwise(first("date_ymd", "date_dmy", "decimal", "hexadecimal", "unit"))
    )


def form_of(c: Column) -> Column:
    """The name of a value's form; null for null, empty and `-`."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in NAME.items() for x in pair)), form_letter(c))


def forms_of(fields: Column) -> Column:
    """The letters of the forms of a line's fields, one for each."""
    return F.array_join(F.transform(fields, form_letter), "")


def promote(a: str | None, b: str | None) -> str | None:
    """The least form that holds the values of both; null is below all."""
    if a is None or b is None or a == b:
        return a or b
    both = {a, *ABOVE[a]} & {b, *ABOVE[b]}
    return max(both, key=lambda x: len(ABOVE[x]))
