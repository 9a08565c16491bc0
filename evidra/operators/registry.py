"""Evidence tables out of the flat table of registry keys and values."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.triage import account_class, filetime, rot13, sid_type
from evidra.sources.registry_names import guid_text

#: Fixed table: the categories of shell counters.
SHELL_CATEGORIES = {
    "{CEBFF5CD-ACE2-4F4F-9178-9926F41749EA}": "Executable", "{F4E57C4B-2036-45F0-A9AB-443BCFE33D9F}": "Shortcut", "{5E6AB780-7743-11CF-A12B-00AA004AE837}": "Toolbar/Taskbar Button (legacy)",
    "{75048700-EF1F-11D0-9888-006097DEACF9}": "ActiveDesktop (legacy)", "{9E04CAB2-CC14-11DF-BB8C-A2F1DED72085}": "Settings", "{B267E3AD-A825-4A09-82B9-EEC22AA3B847}": "Windows.System app",
    "{BCB48336-4DDD-48FF-BB0B-D3190DACB3E2}": "Recently used", "{CAA59E3C-4792-41A5-9909-6A6A8D32490E}": "Win8+ auxiliary (CAA59E3C)", "{F2A1CB5A-E3CC-4A2E-AF9D-505A7009D442}": "Win8+ auxiliary (F2A1CB5A)",
    "{FA99DFC7-6AC2-453A-A5E2-5E2AFF4507BD}": "Win8+ auxiliary (FA99DFC7)", "{A3D53349-6E61-4557-8FC7-0028EDCEEBF6}": "Win8+ auxiliary (A3D53349)",
}
#: Fixed table: folders of the shell by their GUID.
SHELL_FOLDERS = {
    "20D04FE0-3AEA-1069-A2D8-08002B30309D": "My Computer", "450D8FBA-AD25-11D0-98A8-0800361B1103": "My Documents", "208D2C60-3AEA-1069-A2D7-08002B30309D": "My Network Places", "871C2480-42A0-1069-A2EB-08002B30309D": "Internet Explorer",
    "F02C1A0D-BE21-4350-88B0-7367FC96EF3C": "Network", "645FF040-5081-101B-9F08-00AA002F954E": "Recycle Bin", "21EC2020-3AEA-1069-A2DD-08002B30309D": "Control Panel", "031E4825-7B94-4DC3-B131-E506E649151C": "Libraries",
    "374DE290-123F-4565-9164-39C4925E467B": "Downloads", "B4BFCC3A-DB2C-424C-B029-7FE99A87C641": "Desktop", "FDD39AD0-238F-46AF-ADB4-6C85480369C7": "Documents", "33E28130-4E1E-4676-835A-98395C3BC3BB": "Pictures",
    "4BD8D571-6D19-48D3-BE97-422220080E43": "Music", "18989B1D-99B5-455B-841C-AB7C74E4DDFC": "Videos", "1777F761-68AD-4D8A-87BD-30B759FA33DD": "Favorites", "BFB9D5E0-C6A9-404C-B2B2-AE6DB6AF4968": "Links",
    "4C5C32FF-BB9D-43B0-B5B4-2D72E54EAAA4": "Saved Games", "56784854-C6CB-462B-8169-88E350ACB882": "Contacts", "7D1D3A04-DEBB-4115-95CF-2F29DA2920DA": "Searches", "A3916023-D3B7-4825-B5B5-3DF80FD5A0B0": "OneDrive",
    "A52BBA46-E9E1-435F-B3D9-28DAA648C0F6": "OneDrive", "26EE0668-A00A-44D7-9371-BEB064C98683": "Control Panel (All Items)", "ED7BA470-8E54-465E-825C-99712043E01C": "Control Panel (All Tasks)", "D20EA4E1-3957-11D2-A40B-0C5020524153": "Administrative Tools",
    "7007ACC7-3202-11D1-AAD2-00805FC1270E": "Network Connections", "6DFD7C5C-2451-11D3-A299-00C04F8EF6AF": "Local Disk (Folder Options)", "00C6D95F-329C-409A-81D7-C46C66EA7F33": "Default Location", "9C60DE1E-E5FC-40F4-A487-460851A8D915": "AutoPlay",
    "088E3905-0323-4B02-9826-5D99428E115F": "Downloads (IE/Legacy)", "2B0F765D-C0E9-4171-908E-08A611B84FF6": "Cookies (IE/Legacy)", "F3CE0F7C-4901-4ACC-8648-D5D44B04EF8F": "Users Files Folder", "59031A47-3F72-44A7-89C5-5595FE6B30EE": "Public Desktop",
    "ED4824AF-DCE4-45A8-81E2-FC7965083634": "Public Documents", "3D644C9B-1FB8-4F30-9B45-F670235F79C0": "Public Downloads", "4DA689C0-4D6D-4A92-A086-5EA2DA9C67A0": "Common Places FS Folder",
}
#: Fixed names: the column of each value of a file, program, driver and shortcut record.
AMCACHE_TABLES = {
    "files": ("Root\\InventoryApplicationFile", {"program_id": "ProgramId", "file_id": "FileId", "path": "LowerCaseLongPath", "name": "Name", "original_file_name": "OriginalFileName", "publisher": "Publisher", "version": "Version", "bin_file_version": "BinFileVersion", "product_name": "ProductName", "product_version": "ProductVersion", "bin_product_version": "BinProductVersion", "is_os_component": "IsOsComponent", "binary_type": "BinaryType", "link_date": "LinkDate", "size": "Size", "language": "Language", "usn": "Usn"}),
    "programs": ("Root\\InventoryApplication", {"program_id": "ProgramId", "program_instance_id": "ProgramInstanceId", "name": "Name", "version": "Version", "publisher": "Publisher", "language": "Language", "source": "Source", "root_dir_path": "RootDirPath", "store_app_type": "StoreAppType", "manifest_path": "ManifestPath", "package_full_name": "PackageFullName"}),
    "drivers": ("Root\\InventoryDriverBinary", {"driver_name": "DriverName", "inf": "Inf", "driver_version": "DriverVersion", "product": "Product", "product_version": "ProductVersion", "wdf_version": "WdfVersion", "driver_company": "DriverCompany", "driver_package_strong_name": "DriverPackageStrongName", "service": "Service", "driver_in_box": "DriverInBox", "driver_signed": "DriverSigned", "driver_is_kernel_mode": "DriverIsKernelMode", "driver_id": "DriverId", "driver_last_write_time": "DriverLastWriteTime", "driver_type": "DriverType", "driver_time_stamp": "DriverTimeStamp", "driver_check_sum": "DriverCheckSum", "image_size": "ImageSize"}),
    "shortcuts": ("Root\\InventoryApplicationShortcut", {"shortcut_path": "ShortcutPath", "shortcut_target_path": "ShortcutTargetPath", "shortcut_aumid": "ShortcutAumid", "shortcut_program_id": "ShortcutProgramId"}),
}


def little(data: Column, offset: int | Column, size: int) -> Column:
    """The little-endian number of so many bytes at an offset, as text of its decimal digits; null past the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.concat(*(F.hex(F.substring(data, at + i + 1, F.lit(1))) for i in reversed(range(size))))
    return F.when(F.octet_length(data) >= at + size, F.conv(digits, 16, 10))


def value_text(kind: Column, data: Column) -> Column:
    """A value as text: strings trimmed, numbers in decimal, lists joined, short binary values in hexadecimal."""
    string = F.regexp_replace(F.decode(data, "UTF-16LE"), "\\x00+$", "")
    return (
        F.when(kind.isin(1, 2), F.trim(string))
        .when(kind == 4, little(data, 0, 4))
        .when(kind == 11, little(data, 0, 8))
        .when(kind == 7, F.array_join(F.filter(F.split(F.decode(data, "UTF-16LE"), "\\x00"), lambda x: x != ""), "; "))
        .when((kind == 3) & (F.octet_length(data) <= 64), F.lower(F.hex(data)))
        .when(kind == 3, F.concat(F.lit("(binary, len="), F.octet_length(data).cast("string"), F.lit(")")))
        .otherwise("")
    )


def owner(path: Column) -> Column:
    """The folder that a hive lies in: by custom, the SID of its user."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)


def userassist(values: DataFrame) -> DataFrame:
    """Shell counters: sid, guid, category, decoded_path, run_count, focus_count, focus_time_ms, last_run_utc."""
    form = r"(?i)\\UserAssist\\(\{[^\\]*\})\\Count$"
    rows = values.where(F.col("value_name").isNotNull() & F.col("key_path").rlike(form)).withColumn("decoded_path", rot13(F.col("value_name"))).where("not startswith(decoded_path, 'UEME_')")
    guid = F.upper(F.regexp_extract("key_path", form, 1))
    category = F.element_at(F.create_map(*(F.lit(x) for pair in SHELL_CATEGORIES.items() for x in pair)), guid)
    d = F.col("data")
    ticks = little(d, 60, 8).cast("decimal(20,0)")
    number = lambda at: F.coalesce(little(d, at, 4).cast("long"), F.lit(0))
    return rows.select(owner(F.col("path")).alias("sid"), guid.alias("guid"), F.coalesce(category, F.lit("Unknown")).alias("category"), "decoded_path", number(4).alias("run_count"), number(8).alias("focus_count"), number(12).alias("focus_time_ms"), F.when(ticks > 0, filetime(ticks)).alias("last_run_utc"))


def bam(values: DataFrame) -> DataFrame:
    """Background-activity records: control_set, source, sid, user_type, raw_path, normalized_path, last_execution_utc."""
    form = r"(?i)^(ControlSet00[12])\\(?:Services\\(Bam|Dam)\\(?:State\\)?UserSettings|Control\\Session Manager\\AppCompatCache\\BAM\\UserSettings)\\([^\\]+)$"
    ticks = little(F.col("data"), 0, 8).cast("decimal(20,0)")
    rows = values.where(F.col("key_path").rlike(form) & (F.col("value_type") == 3) & ~F.lower("value_name").isin("version", "sequencenumber") & (ticks > 0))
    part = lambda i: F.regexp_extract("key_path", form, i)
    path = F.regexp_replace("value_name", r"(?i)^\\device\\harddiskvolume", r"\\Device\\HarddiskVolume")
    return rows.select(part(1).alias("control_set"), F.when(F.upper(part(2)) == "DAM", "DAM").otherwise("BAM").alias("source"), part(3).alias("sid"), sid_type(part(3)).alias("user_type"), F.col("value_name").alias("raw_path"), path.alias("normalized_path"), filetime(ticks).alias("last_execution_utc"))


def shim_entries(data: bytes) -> list[tuple[str, int, int]]:
    """(path, ticks, flag) of each entry of a compatibility cache; an entry that is none ends the list."""
    out: list[tuple[str, int, int]] = []
    at = struct.unpack_from("<I", data)[0] if len(data) >= 12 else len(data)
    while at + 12 <= len(data) and data[at : at + 4] == b"10ts":
        size = struct.unpack_from("<I", data, at + 8)[0]
        body = data[at + 12 : at + 12 + size]
        if size < 2 or len(body) < size:
            break
        n = struct.unpack_from("<H", body)[0]
        if 2 + n > size:
            break
        ticks = struct.unpack_from("<Q", body, 2 + n)[0] if n + 10 <= size else 0
        extra = struct.unpack_from("<I", body, n + 10)[0] if n + 14 <= size else 0
        flag = struct.unpack_from("<I", body, n + 10 + extra)[0] if extra >= 4 and n + 14 + extra <= size else 0
        out.append((body[2 : 2 + n].decode("utf-16-le", "replace"), ticks, flag))
        at += 12 + size
    return out


def shimcache(values: DataFrame) -> DataFrame:
    """Compatibility-cache entries: control_set, entry_index, path, last_modified_utc, execution_flag."""
    form = r"(?i)^(ControlSet00[12])\\Control\\Session Manager\\(?:AppCompatCache|AppCompatibility\\AppCompatCache)$"
    rows = values.where(F.col("key_path").rlike(form) & (F.col("value_name") == "AppCompatCache"))

    def entries(data: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "ticks": t, "flag": f} for p, t, f in shim_entries(d)] for d in data], dtype=object)

    found = F.pandas_udf(entries, "array<struct<path:string,ticks:long,flag:long>>")("data")
    rows = rows.select(F.regexp_extract("key_path", form, 1).alias("control_set"), F.posexplode(found).alias("entry_index", "e"))
    return rows.select("control_set", "entry_index", "e.path", F.when(F.col("e.ticks") > 0, filetime(F.col("e.ticks"))).alias("last_modified_utc"), F.col("e.flag").alias("execution_flag"))


def local_accounts(values: DataFrame) -> DataFrame:
    """Accounts of the machine: username, rid (the type of the key's unnamed value), account_class."""
    form = r"(?i)^SAM\\Domains\\Account\\Users\\Names\\([^\\]+)$"
    rows = values.where(F.col("key_path").rlike(form)).groupBy("path", F.regexp_extract("key_path", form, 1).alias("username"))
    rid = F.coalesce(F.max(F.when(F.col("value_name") == "", F.col("value_type"))), F.lit(0))
    return rows.agg(rid.alias("rid")).select("username", "rid", account_class(F.col("rid")).alias("account_class"))


def amcache(values: DataFrame, table: str) -> DataFrame:
    """One of the tables of AMCACHE_TABLES: last_write_utc, its columns, source_key. One aggregate per key turns values into columns."""
    root, columns = AMCACHE_TABLES[table]
    rows = values.where(F.lower("key_path").startswith(root.lower() + "\\") & ~F.substring("key_path", len(root) + 2, 1000).contains("\\"))
    text = value_text(F.col("value_type"), F.col("data"))
    cells = [F.coalesce(F.max(F.when(F.lower("value_name") == name.lower(), text)), F.lit("")).alias(column) for column, name in columns.items()]
    made = rows.groupBy(F.col("path").alias("hive"), "key_path").agg(F.max("last_write").alias("last_write_utc"), *cells)
    if table == "files":
        made = made.where("path <> '' or name <> ''")
    return made.select("last_write_utc", *columns, F.col("key_path").alias("source_key"))


def shell_item(data: bytes) -> str:
    """The name in a shell item: a known folder, a drive, or a file entry with its long name if it has one; empty for others."""
    if len(data) < 3:
        return ""
    kind = data[2]
    if kind == 0x1F:
        guid = guid_text(data[4:20]) if len(data) >= 20 else ""
        return SHELL_FOLDERS.get(guid, f"{{{guid}}}" if guid else "RootFolder")
    if kind in (0x2E, 0x2F):
        return data[3:].split(b"\0")[0].decode("latin-1")
    if not 0x30 <= kind <= 0x39 or len(data) < 14:
        return ""
    end = data.find(b"\0", 14)
    short = data[14 : end if end >= 0 else len(data)].decode("latin-1")
    at = len(data) if end < 0 else end + 1 + (data[end + 1 : end + 2] == b"\0")
    while at + 8 <= len(data):
        size, version, mark = struct.unpack_from("<HHxxH", data, at)
        if size < 8 or at + size > len(data):
            break
        if mark == 0xBEEF:
            block = data[at : at + size]
            start = struct.unpack_from("<H", block, 16)[0] if version >= 7 and size >= 18 else 28 if version == 3 else 0
            if 0 < start < size:
                name = block[start:].decode("utf-16-le", "ignore").split("\0")[0]
                return name or short
            break
        at += size
    return short


def shellbags(values: DataFrame) -> DataFrame:
    """Folders that were opened: sid, source_hive, mru_path, folder_path, last_write_utc.

    Each numbered value names one folder below the folder that its key stands for. Names are decoded once; a path is the
    names along it, met by a join of each node with the nodes above it, as many as it is deep.
    """
    root = r"(?i)^(.*\\BagMRU)(\\.*)?$"
    rows = values.where(F.col("value_name").rlike(r"^\d+$") & F.col("key_path").rlike(root))
    size = little(F.col("data"), 0, 2).cast("int")
    name = F.pandas_udf(lambda s: pd.Series([shell_item(d) for d in s], dtype=object), "string")(F.expr("substring(data, 1, cast(conv(concat(hex(substring(data, 2, 1)), hex(substring(data, 1, 1))), 16, 10) as int))"))
    rows = rows.where((size >= 2) & (size <= F.octet_length("data")))
    nodes = rows.select("path", F.concat("key_path", F.lit("\\"), "value_name").alias("node"), F.regexp_extract("key_path", root, 1).alias("root"), name.alias("name"))
    parts = F.split(F.expr("substring(node, length(root) + 2)"), r"\\")
    prefix = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(i.alias("depth"), F.concat_ws("\\", F.col("root"), F.slice("parts", F.lit(1), i)).alias("above")))
    spread = nodes.withColumn("parts", parts).select("path", "node", F.concat_ws("\\", F.lit("BagMRU"), "parts").alias("mru_path"), F.explode(prefix).alias("p")).select("path", "node", "mru_path", "p.*")
    named = spread.join(nodes.select("path", F.col("node").alias("above"), "name"), ["path", "above"], "left")
    folder = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"] != ""), lambda x: F.regexp_replace(x["name"], r"\\$", "")), "\\")
    made = named.groupBy("path", "node", "mru_path").agg(folder.alias("folder_path"))
    written = values.where("value_name is null").select("path", F.col("key_path").alias("node"), F.col("last_write").alias("last_write_utc"))
    return made.join(written, ["path", "node"], "left").select(owner(F.col("path")).alias("sid"), F.regexp_extract("path", r"([^/\\]*)$", 1).alias("source_hive"), "mru_path", "folder_path", "last_write_utc")


def com_servers(values: DataFrame) -> DataFrame:
    """Servers of classes: path, clsid, wow64, server_type, module_path, treat_as."""
    form = r"(?i)(?:^|\\)(Wow6432Node\\)?CLSID\\(\{[^\\]+\})\\(InprocServer32|LocalServer32|InprocHandler32|TreatAs)$"
    rows = values.where(F.col("key_path").rlike(form) & (F.col("value_name") == ""))
    part = lambda i: F.regexp_extract("key_path", form, i)
    return rows.select("path", F.upper(part(2)).alias("clsid"), (part(1) != "").alias("wow64"), part(3).alias("server_type"), value_text(F.col("value_type"), F.col("data")).alias("module_path"), (F.lower(part(3)) == "treatas").alias("treat_as"))
