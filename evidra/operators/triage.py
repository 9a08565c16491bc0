"""Tiers of parsed evidence, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed lists: tokens of web files that are suspicious by themselves, and those that are in company.
STRONG_TOKENS = (
    "xp_cmdshell", "system.diagnostics.process", "processstartinfo", "wscript.shell", "shell_exec(", "passthru(", "proc_open(", "popen(", "frombase64string", "runtime.getruntime().exec", "processbuilder",
    "[reflection.assembly]", "cmd.exe /c", "cmd /c ", "powershell -", 'server.createobject("wscript',
)
WEAK_TOKENS = ("eval(", "assert(", "base64_decode(", "create_function(", "execute(", "executeglobal", "request.form", "request.querystring", "request.item", "$_post", "$_get", "$_request", "gzinflate(", "str_rot13(")
#: Fixed value: how many characters of a web file the reference looks at.
WEB_FILE_HEAD = 1 << 20
#: Fixed lists: folders of system programs, and extensions of programs.
SYSTEM_FOLDERS = ("\\windows\\system32\\", "\\windows\\syswow64\\", "\\windows\\winsxs\\", "\\windows\\servicing\\")
PROGRAM_EXTENSIONS = (".exe", ".dll", ".ps1", ".bat", ".vbs")
#: Fixed table: the bits of a change-journal reason.
USN_REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION",
    0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME",
    0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE",
    0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE", 0x200000: "STREAM_CHANGE", 0x400000: "TRANSACTED_CHANGE", 0x800000: "INTEGRITY_CHANGE", 0x80000000: "CLOSE",
}


def tokens_in(text: Column, tokens: tuple[str, ...]) -> Column:
    """Which of the tokens a text holds, without letter case, in list order."""
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))


def web_file_triage(files: DataFrame, text: str, strong: tuple[str, ...] = STRONG_TOKENS, weak: tuple[str, ...] = WEAK_TOKENS, head: int | None = None) -> DataFrame:
    """Files with strong, weak, indicators and triage: HIGH with a strong token, NOTABLE with two weak ones, INFO.

    The whole text counts, or, with `head`, so many characters of it (the reference's WEB_FILE_HEAD).
    """
    looked = F.col(text) if head is None else F.substring(F.col(text), 1, head)
    rows = files.withColumn("_s", tokens_in(looked, strong)).withColumn("_w", tokens_in(looked, weak))
    rows = rows.withColumn("strong", F.size("_s")).withColumn("weak", F.size("_w")).withColumn("indicators", F.array_join(F.concat("_s", "_w"), "|"))
    return rows.withColumn("triage", F.when(F.col("strong") > 0, "HIGH").when(F.col("weak") > 1, "NOTABLE").otherwise("INFO")).drop("_s", "_w")


def usn_reasons(mask: Column) -> Column:
    """The names of a reason mask joined by |; bits without name as UNKNOWN(0x..)."""
    m = mask.cast("long")
    names = F.array(*(F.when(m.bitwiseAND(bit) != 0, name) for bit, name in USN_REASONS.items()))
    rest = m.bitwiseAND(F.lit(0xFFFFFFFF & ~reduce(lambda a, b: a | b, USN_REASONS)))
    unknown = F.when(rest != 0, F.concat(F.lit("UNKNOWN(0x"), F.hex(rest), F.lit(")")))
    return F.array_join(F.filter(F.concat(names, F.array(unknown)), lambda x: x.isNotNull()), "|")


def sid_type(sid: Column) -> Column:
    """What kind of account a SID is."""
    known = F.when(sid == "S-1-5-18", "SYSTEM").when(sid == "S-1-5-19", "LOCAL SERVICE").when(sid == "S-1-5-20", "NETWORK SERVICE")
    for end, name in (("-500", "Administrator"), ("-501", "Guest"), ("-502", "KRBTGT"), ("-503", "DefaultAccount"), ("-504", "WDAGUtilityAccount")):
        known = known.when(sid.endswith(end), name)
    return known.otherwise("User Account")


def is_baseline(path: Column) -> Column:
    """True for programs in a system folder."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(x)) for x in SYSTEM_FOLDERS])


def is_program(name: Column) -> Column:
    """True for names of programs and scripts."""
    return reduce(lambda a, b: a | b, [F.lower(name).endswith(x) for x in PROGRAM_EXTENSIONS])


def account_class(rid: Column) -> Column:
    """Built-in accounts have ids below 1000."""
    return F.when(rid >= 1000, "local (created on host)").otherwise("built-in")


def memory_tier(writable_code: Column, images: Column, hits: Column) -> Column:
    """The tier of a memory region: writable code or an image in it, indicators in it."""
    return F.when(writable_code | (images > 0), "HIGH").when(hits > 0, "NOTABLE").otherwise("LOW")


def parser_status(outputs: Column, errors: Column) -> Column:
    """How a parser ended."""
    return F.when((F.size(errors) > 0) & (F.size(outputs) == 0), "failed").when(F.size(errors) > 0, "partial").when(F.size(outputs) == 0, "skipped").otherwise("success")


def tier_counts(rows: DataFrame, tier: str) -> DataFrame:
    """Rows of each tier: tier, n."""
    return rows.groupBy(F.upper(F.trim(tier)).alias("tier")).agg(F.count("*").alias("n"))


def rot13(c: Column) -> Column:
    """Letters turned by thirteen places."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    turned = plain[13:] + plain[:13]
    return F.translate(c, plain + plain.upper(), turned + turned.upper())


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; for export only."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def filetime(ticks: Column) -> Column:
    """A FILETIME (100 ns since 1601) as a timestamp."""
    return F.timestamp_micros(F.floor(ticks.cast("decimal(20,0)") / 10).cast("long") - F.lit(11_644_473_600_000_000))


def webkit_time(us: Column) -> Column:
    """Microseconds since 1601 as a timestamp."""
    return F.timestamp_micros((us - F.lit(11_644_473_600_000_000)).cast("long"))


def device_path(path: Column) -> Column:
    """A device path in one spelling; the number of the volume stays."""
    return F.regexp_replace(path, r"(?i)^\\device\\harddiskvolume(?=[^\\]*\\)", r"\\Device\\HarddiskVolume")


def safe_name(name: Column) -> Column:
    """A file name of plain characters."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
