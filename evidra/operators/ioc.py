"""Indicators of compromise in free text, and their STIX form."""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.net import in_cidr, is_v4, v4_number

#: Fixed patterns and confidences of the passes.
URL = r"https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
DOTTED = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,13}\b"
CONFIDENCE = {"url": 90, "ipv4-addr": 100, 64: 80, 40: 70, 32: 50, "domain-name": 80}
#: Fixed list: file extensions that are no top-level domain.
NOT_DOMAINS = (
    "dll", "exe", "sys", "log", "txt", "json", "csv", "xml", "tmp", "bat", "ps1", "cmd", "lnk", "iso", "zip", "rar", "7z", "cab", "msi", "mui", "pdb", "manifest", "cfg", "ini", "dit", "etl", "evtx", "hive",
)
#: Fixed lists: what is harmless by itself.
BENIGN_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32", "255.255.255.255/32")
BENIGN_DOMAINS = ("google.com", "microsoft.com", "windowsupdate.com", "apple.com", "amazon.com")
CONTEXT = 100
_BENIGN = tuple(map(ipaddress.ip_network, BENIGN_NETWORKS))


def refang(text: Column) -> Column:
    """A text with its defanged addresses made whole again."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?i)hxxps://", "https://"), r"(?i)hxxp://", "http://")
    return F.regexp_replace(F.regexp_replace(t, r"\[\.\]|\(\.\)", "."), r"\[at\]|\(at\)", "@")


def _refang(text: str) -> str:
    t = re.sub(r"(?i)hxxp(s?)://", lambda m: f"http{m[1].lower()}://", text)
    return re.sub(r"\[at\]|\(at\)", "@", re.sub(r"\[\.\]|\(\.\)", ".", t))


def urls(text: Column) -> Column:
    """All URLs of a refanged text, in lower case, without closing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, r"[\"').>,]+$", "")))


def benign_address(address: Column) -> Column:
    """True for private, loopback, link-local, unspecified and broadcast IPv4 addresses."""
    number = v4_number(address)
    out = F.lit(False)
    for x in BENIGN_NETWORKS:
        out = out | in_cidr(number, x)
    return out


def addresses(text: Column) -> Column:
    """All dotted quads that are addresses and not benign, wherever they stand."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({DOTTED})"), F.lit(1)), lambda x: is_v4(x) & ~benign_address(x))


def hashes(text: Column, length: int) -> Column:
    """All words of so many hexadecimal digits, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(\b[a-fA-F0-9]{{{length}}}\b)"), F.lit(1)), lambda x: F.lower(x))


def benign_domain(domain: Column) -> Column:
    """True if the domain or its last two labels are well known."""
    return F.substring_index(F.lower(domain), ".", -2).isin(*BENIGN_DOMAINS)


def domains(text: Column) -> Column:
    """All domain names whose last label is no file extension, in lower case, wherever they stand."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({DOMAIN})"), F.lit(1)), lambda x: F.lower(x))
    return F.filter(found, lambda x: ~F.substring_index(x, ".", -1).isin(*NOT_DOMAINS) & ~benign_domain(x))


def extract(text: str | None) -> list[tuple[str, str, str, int]]:
    """The indicators of one text in six passes: type, value, context, confidence; of equal ones the first counts.

    URLs, addresses and the shorter hashes are not looked for where something was found before; domains neither, and
    they block nothing themselves; 64-digit hashes are found anywhere.
    """
    if not text:
        return []
    t = _refang(text)
    # what was found before, in order and apart from each other, save that 64-digit hashes may lie inside
    taken: list[tuple[int, int]] = []
    found: dict[tuple[str, str], tuple[str, str, str, int]] = {}

    def add(kind: str, value: str, a: int, b: int, confidence: int) -> None:
        context = t[max(0, a - CONTEXT) : b + CONTEXT].replace("\r", " ").replace("\n", " ").strip()
        found.setdefault((kind, value), (kind, value, context, confidence))

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (b, -1))
        return not i or reach[i - 1] <= a

    def merge(more: list[tuple[int, int]]) -> None:
        taken.extend(more)
        taken.sort()
        reach[:] = accumulate((y for _, y in taken), max)

    # how far what begins up to each place reaches
    reach: list[int] = []
    fresh: list[tuple[int, int]] = []
    for m in re.finditer(URL, t):
        value = m[0].rstrip("\"').>,").lower()
        fresh.append(m.span())
        add("url", value, *m.span(), CONFIDENCE["url"])
    merge(fresh)
    fresh = []
    for m in re.finditer(DOTTED, t, re.ASCII):
        try:
            address = ipaddress.IPv4Address(m[0])
        except ValueError:
            continue
        if free(*m.span()) and not any(address in n for n in _BENIGN):
            fresh.append(m.span())
            add("ipv4-addr", m[0], *m.span(), CONFIDENCE["ipv4-addr"])
    for length in (64, 40, 32):
        merge(fresh)
        fresh = []
        for m in re.finditer(rf"\b[a-fA-F0-9]{{{length}}}\b", t, re.ASCII):
            if length == 64 or free(*m.span()):
                fresh.append(m.span())
                add("file", m[0].lower(), *m.span(), CONFIDENCE[length])
    merge(fresh)
    for m in re.finditer(DOMAIN, t, re.ASCII):
        value = m[0].lower()
        last = value.rpartition(".")[2]
        if free(*m.span()) and last not in NOT_DOMAINS and ".".join(value.split(".")[-2:]) not in BENIGN_DOMAINS:
            add("domain-name", value, *m.span(), CONFIDENCE["domain-name"])
    return [*found.values()]


def indicators(docs: DataFrame, source: str, text: str) -> DataFrame:
    """The indicators of each text: source_file, type, value, context, confidence. Null and empty texts have none."""
    kind = "array<struct<type:string,value:string,context:string,confidence:int>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("type", "value", "context", "confidence")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x)) for x in extract(t)] for t in texts], dtype=object)

    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.select(F.col(source).alias("source_file"), F.explode(F.pandas_udf(run, kind)(F.col(text))).alias("i")).select("source_file", "i.*")


def stix_pattern(kind: Column, value: Column) -> Column:
    """The STIX pattern of an indicator, quotes and backslashes in its value escaped; null for what has none."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    quoted = lambda head: F.concat(F.lit(head), F.lit(" = '"), escaped, F.lit("']"))
    file = F.when(F.length(value) == 32, quoted("[file:hashes.MD5")).when(F.length(value) == 40, quoted("[file:hashes.'SHA-1'")).when(F.length(value) == 64, quoted("[file:hashes.'SHA-256'"))
    return F.when(kind == "file", file).when(kind.isin("ipv4-addr", "domain-name", "url"), F.concat(F.lit("["), kind, F.lit(":value = '"), escaped, F.lit("']")))


def stix_objects(found: DataFrame, valid_from: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """Indicators as STIX 2.1 indicator objects, one JSON text each, created and valid from a given time; ids follow from the pattern. Of equal patterns the one of the least source counts, then of the least context."""
    pattern = stix_pattern(F.col("type"), F.col("value"))
    least = F.min(F.struct("source_file", "context", "confidence", "type", "value")).alias("i")
    rows = found.withColumn("pattern", pattern).where("pattern is not null").groupBy("pattern").agg(least).select("pattern", "i.*")
    digest = F.sha2("pattern", 256)
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("4"), F.substring(digest, 14, 3)), F.concat(F.lit("a"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    times = [F.lit(valid_from).alias(x) for x in ("created", "modified", "valid_from")]
    body = F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uuid).alias("id"), *times, F.concat("type", F.lit(": "), "value").alias("name"), "pattern", F.lit("stix").alias("pattern_type"), "confidence", F.col("context").alias("description"))
    return rows.select(F.to_json(body).alias("object"))


def every_indicator(text: Column) -> Column:
    """All indicators of a refanged text with their types, wherever they stand, each once."""
    tagged = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value")))
    hashed = F.concat(hashes(text, 64), hashes(text, 40), hashes(text, 32))
    return F.array_distinct(F.concat(tagged("url", urls(text)), tagged("ipv4-addr", addresses(text)), tagged("file", hashed), tagged("domain-name", domains(text))))


def match_evidence(evidence: DataFrame, text: str, packs: DataFrame) -> DataFrame:
    """Evidence rows that hold an indicator of the packs (type, value): the row's columns, and type, value.

    The indicators of each row are extracted and joined by value, so rows are never compared with every indicator.
    """
    rows = evidence.withColumn("_i", F.explode(every_indicator(refang(F.col(text))))).select(*evidence.columns, "_i.type", "_i.value")
    return rows.join(packs.select("type", F.lower("value").alias("value")).distinct(), ["type", "value"], "left_semi")
