"""Correlations and stateful detections: group thresholds, semi, anti and self joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.net import in_cidr, is_v4, v4_number
from evidra.operators.rules import HIT_COLUMNS
from evidra.operators.timeline import uri_base

#: Thresholds of failed logons per address and from outside, and how many offenders are named.
FAILS_PER_ADDRESS, FAILS_EXTERNAL, NAMED = 20, 50, 8
#: Fixed list: extensions of files that a web server executes.
SCRIPT_EXTENSIONS = (".aspx", ".asmx", ".ashx", ".asax", ".ascx", ".cshtml", ".asp", ".php", ".php3", ".php4", ".php5", ".phtml", ".jsp", ".jspx", ".pl", ".cgi")
#: Fixed list: program names looked for in queries.
PROGRAM_TOKENS = ("cmd.exe", "powershell", "certutil", "bitsadmin", "whoami", "net user", "net localgroup", "rundll32", "regsvr32", "mshta", "wscript", "cscript", "systeminfo", "tasklist", "nltest", "vssadmin")
#: Fixed list: path segments of upload and scratch directories, the first that fits counts.
UPLOAD_SEGMENTS = ("foruploadfiles", "uploadfiles", "uploads", "upload", "temp", "tmp", "attachments", "userfiles", "fileupload")
#: Fixed list: networks that are not outside.
INTERNAL_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def json_scalar(data: Column, key: str) -> Column:
    """The scalar that follows "key": in a JSON text, read as text: a quoted value to its next quote, another one to the next comma or brace; empty if absent."""
    rest = F.regexp_extract(data, rf'"{key}":\s*("[^"]*"|[^",}}][^,}}]*)', 1)
    return F.trim(F.regexp_replace(F.coalesce(rest, F.lit("")), r'^"|"$', ""))


def is_external(address: Column) -> Column:
    """True for a routable public address: not private, loopback, link-local or unspecified, and an address at all."""
    t = F.lower(F.trim(address))
    number = v4_number(t)
    inner4 = reduce(lambda a, b: a | b, [in_cidr(number, x) for x in INTERNAL_NETWORKS])
    inner6 = t.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:(?:10|127)\..*|::ffff:192\.168\..*)$")
    return F.coalesce(F.when(is_v4(t), ~inner4).when(t.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$"), ~inner6), F.lit(False))


def failed_logons(logons: DataFrame, event_id: str, data: str, wanted: str = "4625", per_address: int = FAILS_PER_ADDRESS, external: int = FAILS_EXTERNAL) -> DataFrame:
    """Brute force over all failed logons as at most one row: total, n_addresses, n_accounts, external_fails, n_offenders, top, key, severity.

    Addresses are counted first (a partial aggregate per address), then summed up; offenders have `per_address` or more.
    No row if there are none and fewer than `external` fails come from outside. `top` names the NAMED largest.
    """
    rows = logons.where(_text(event_id) == wanted).select(json_scalar(_text(data), "IpAddress").alias("ip"), F.lower(json_scalar(_text(data), "TargetUserName")).alias("account"))
    by_address = rows.groupBy("ip").agg(F.count("*").alias("n")).withColumn("named", ~F.col("ip").isin("", "-")).withColumn("outside", is_external(F.col("ip")))
    accounts = rows.where("account <> ''").select("account").distinct().agg(F.count("*").alias("n_accounts"))
    offender = F.col("named") & (F.col("n") >= per_address)
    ranked = by_address.where(offender).orderBy(F.desc("n"), "ip").limit(NAMED)
    tag = F.concat("ip", F.lit("("), F.col("n").cast("string"), F.when(F.col("outside"), " [external]").otherwise(""), F.lit(")"))
    top = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "ip", tag.alias("tag")))), lambda x: x["tag"]), ", ").alias("top"), F.min_by("ip", F.struct(-F.col("n"), "ip")).alias("key"))
    total = by_address.agg(
        F.sum("n").alias("total"), F.count_if("named").alias("n_addresses"), F.coalesce(F.sum(F.when(F.col("named") & F.col("outside"), F.col("n"))), F.lit(0)).alias("external_fails"),
        F.count_if(offender).alias("n_offenders"), F.coalesce(F.bool_or(offender & F.col("outside")), F.lit(False)).alias("from_outside"),
    )
    one = total.crossJoin(accounts).crossJoin(top)  # three tables of one row each
    return one.where((F.col("n_offenders") > 0) | (F.col("external_fails") >= external)).select(
        "total", "n_addresses", "n_accounts", "external_fails", "n_offenders", F.coalesce("top", F.lit("")).alias("top"), F.coalesce("key", F.lit("")).alias("key"),
        F.when(F.col("from_outside"), "HIGH").otherwise("NOTABLE").alias("severity"),
    )


def external_logons(logons: DataFrame, event_id: str, data: str, wanted: str = "4624") -> DataFrame:
    """Successful logons from outside by account, address and type: account, address, logon_type, n, privileged."""
    d = _text(data)
    rows = logons.where(_text(event_id) == wanted).select(json_scalar(d, "TargetUserName").alias("account"), json_scalar(d, "IpAddress").alias("address"), json_scalar(d, "LogonType").alias("logon_type"))
    rows = rows.where(is_external(F.col("address"))).groupBy("account", "address", "logon_type").agg(F.count("*").alias("n"))
    return rows.withColumn("privileged", F.lower("account").contains("admin"))


def joined_set(c: Column) -> Column:
    """A set as sorted text, `-` if it is empty."""
    return F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(c != "", c))), ", "), F.lit("")), F.lit("-"))


def flagged_access(requests: DataFrame, flagged: DataFrame) -> DataFrame:
    """Requests to flagged files by base name: base, triage, n, methods, clients, first_seen, last_seen.

    `flagged` has filename, triage and seq; of files alike but for letter case the last (by seq) counts. Base names that
    differ in case are groups of their own. Names and addresses are distinct values of a group, aggregated on the map side.
    """
    names = flagged.where(F.upper(F.coalesce("triage", F.lit(""))).isin("HIGH", "NOTABLE")).groupBy(F.lower("filename").alias("name")).agg(F.max_by("triage", "seq").alias("triage")).where("name <> ''")
    rows = requests.withColumn("base", uri_base(_text("uri_stem"))).withColumn("name", F.lower("base")).join(names, "name")
    return rows.groupBy("base", "triage").agg(
        F.count("*").alias("n"), joined_set(_text("method")).alias("methods"), joined_set(_text("client_ip")).alias("clients"),
        F.min("datetime_utc").alias("first_seen"), F.max("datetime_utc").alias("last_seen"),
    )


def program_tokens(requests: DataFrame) -> DataFrame:
    """Requests to scripts whose query names a program, by path: uri_stem, n (pairs of request and token), tokens."""
    query = F.lower(_text("uri_query"))
    extension = F.lower(F.regexp_extract(uri_base(_text("uri_stem")), r"(\.[^.]*)$", 1))
    rows = requests.where(extension.isin(*SCRIPT_EXTENSIONS) & (query != ""))
    found = rows.select(_text("uri_stem").alias("uri_stem"), F.explode(F.filter(F.array(*map(F.lit, PROGRAM_TOKENS)), lambda t: F.contains(query, t))).alias("token"))
    return found.groupBy("uri_stem").agg(F.count("*").alias("n"), joined_set(F.col("token")).alias("tokens"))


def anonymous_access(requests: DataFrame, stem_has: str, stem_lacks: str | None = None) -> DataFrame:
    """Requests without user from other machines to paths that contain `stem_has`, by client: client_ip, n, stems, first_seen, last_seen."""
    stem, client = F.lower(_text("uri_stem")), _text("client_ip")
    wanted = stem.contains(stem_has) & F.lower(_text("username")).isin("", "anonymous")
    wanted &= ~(F.lower(client).isin("", "127.0.0.1", "::1") | F.lower(client).startswith("fe80"))
    if stem_lacks:
        wanted &= ~stem.contains(stem_lacks)
    return requests.where(wanted).groupBy("client_ip").agg(F.count("*").alias("n"), joined_set(stem).alias("stems"), F.min("datetime_utc").alias("first_seen"), F.max("datetime_utc").alias("last_seen"))


def first_sample(requests: DataFrame, stem_has: str, tokens: tuple[str, ...], order: str = "request_id") -> DataFrame:
    """Requests to a path whose query has one of the tokens, by client (`-` if none): client, n, sample (the query of the first), first_seen, last_seen."""
    query = F.lower(_text("uri_query"))
    rows = requests.where(F.lower(_text("uri_stem")).contains(stem_has) & reduce(lambda a, b: a | b, [F.contains(query, F.lit(t)) for t in tokens]))
    client = F.when(_text("client_ip") == "", "-").otherwise(_text("client_ip"))
    return rows.groupBy(client.alias("client")).agg(F.count("*").alias("n"), F.min_by("uri_query", order).alias("sample"), F.min("datetime_utc").alias("first_seen"), F.max("datetime_utc").alias("last_seen"))


def upload_segment(path: Column) -> Column:
    """The first upload segment, in list order, that is a directory of the path; null if none is."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    inside = F.filter(F.array(*map(F.lit, UPLOAD_SEGMENTS)), lambda s: F.contains(low, F.concat(F.lit("/"), s, F.lit("/"))) | F.startswith(low, F.concat(s, F.lit("/"))))
    return F.get(inside, F.lit(0))


def lookalikes(names: DataFrame, name: str, seq: str, longer: int = 2) -> DataFrame:
    """Names that differ from another by one edit, or of which one extends the other by one or two characters: name, twin (the first such by seq).

    Both names of such a pair come out, each with its own first twin. No pairs are formed: each name is filed under the
    texts with one of its characters dropped, by place, and under its shorter heads. Names filed under one text and
    place differ in that one character, so that a block has as many as there are characters, and each needs only its
    first or second; a name filed under another's whole text has that one as a twin, which needs only the first of
    those filed there. Comparison ignores letter case; equal names are one (the first). Null and empty names have no twin.
    """
    once = names.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.lower(name).alias("low")).agg(F.min(F.struct(F.col(seq).alias("seq"), F.col(name).alias("name"))).alias("own"))
    size = F.length("low")
    cut = lambda i: F.concat(F.substring(F.col("low"), F.lit(1), i - 1), F.substring(F.col("low"), i + 1, size))
    dropped = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("place"), cut(i).alias("key")))
    heads = F.transform(F.sequence(F.lit(2), F.lit(longer)), lambda k: F.struct(F.lit(0).alias("place"), F.substring(F.col("low"), F.lit(1), size - k).alias("key"))) if longer > 1 else F.array().cast("array<struct<place:int,key:string>>")
    filed = once.select("low", "own", F.explode(F.concat(dropped, heads)).alias("f")).select("low", "own", "f.*")

    block = Window.partitionBy("key", "place").orderBy("own")
    # what stands in the frame before the first row is nothing, so that one looks ahead
    near = filed.where("place > 0").withColumn("twin", F.coalesce(F.min("own").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lead("own").over(block))).select("low", "twin")
    whole = once.select(F.col("low").alias("key"), F.col("own").alias("shorter"))
    longest = filed.join(whole, "key").select("low", "key", "own", "shorter")
    near = near.unionByName(longest.select("low", F.col("shorter").alias("twin"))).unionByName(longest.groupBy(F.col("key").alias("low")).agg(F.min("own").alias("twin")))
    found = near.where("twin is not null").groupBy("low").agg(F.min("twin").alias("twin"))
    return found.join(once, "low").select(F.col("own.name").alias("name"), F.col("twin.name").alias("twin"))


def bound_consumers(filters: DataFrame, bindings: DataFrame, consumers: DataFrame) -> DataFrame:
    """Subscriptions: each binding with its filter and consumer, and the filters and consumers that none names.

    Filters: name, query. Consumers: class, name, action. Bindings: filter_name, consumer_class, consumer_name. Consumers
    match without letter case, filters with it. Columns: filter_name, query, consumer_class, consumer_name, action, state.
    """
    c = consumers.select(F.lower("class").alias("kc"), F.lower("name").alias("kn"), F.col("class").alias("c_class"), F.col("name").alias("c_name"), "action")
    f = filters.select(F.col("name").alias("f_name"), "query")
    b = bindings.withColumn("kc", F.lower("consumer_class")).withColumn("kn", F.lower("consumer_name"))
    columns = ["filter_name", "query", "consumer_class", "consumer_name", "action", "state"]
    bound = b.join(f, F.col("filter_name") == F.col("f_name"), "left").join(c, ["kc", "kn"], "left").withColumn("state", F.lit("bound")).select(*columns)
    lone_c = c.join(b, ["kc", "kn"], "left_anti").select(F.lit("").alias("filter_name"), F.lit("").alias("query"), F.col("c_class").alias("consumer_class"), F.col("c_name").alias("consumer_name"), "action", F.lit("orphan consumer").alias("state"))
    lone_f = f.join(b, F.col("f_name") == F.col("filter_name"), "left_anti").select(F.col("f_name").alias("filter_name"), "query", F.lit("").alias("consumer_class"), F.lit("").alias("consumer_name"), F.lit("").alias("action"), F.lit("orphan filter").alias("state"))
    return bound.unionByName(lone_c).unionByName(lone_f)


def normalized_path(path: Column) -> Column:
    """A module path without quotes and letter case, its environment variables expanded."""
    t = F.lower(F.trim(F.replace(path, F.lit('"'), F.lit(""))))
    for variable, value in (("%systemroot%", r"c:\windows"), ("%windir%", r"c:\windows"), ("%programfiles%", r"c:\program files"), ("%programfiles(x86)%", r"c:\program files (x86)"), ("%programdata%", r"c:\programdata")):
        t = F.replace(t, F.lit(variable), F.lit(value))
    return t


def module_extension(path: Column) -> Column:
    """The extension of a module path, in lower case, without the arguments that may follow it; empty if its last part has none."""
    return F.regexp_extract(F.lower(F.split_part(path, F.lit(" "), F.lit(1))), r"(\.[^.\\/]*)$", 1)


def by_tier(rows: DataFrame, tier: str, *then: str) -> DataFrame:
    """Rows by tier, the most severe first, and then by other columns; unknown tiers last."""
    rank = F.array_position(F.array(*map(F.lit, ("HIGH", "NOTABLE", "LOW", "INFO"))), F.upper(F.trim(_text(tier))))
    return rows.orderBy(F.when(rank > 0, rank).otherwise(9), *then)


def shadowed_servers(user: DataFrame, machine: DataFrame) -> DataFrame:
    """Per-user servers beside the machine's of the same class: clsid, wow64, module_path, machine_path, in_machine, differs (none there, or another path)."""
    m = machine.select(F.upper("clsid").alias("k"), F.col("wow64").alias("w"), F.col("module_path").alias("machine_path"))
    rows = user.join(m, (F.upper("clsid") == F.col("k")) & (F.col("wow64") == F.col("w")), "left")
    differs = F.col("machine_path").isNull() | (normalized_path(F.col("module_path")) != normalized_path(F.col("machine_path")))
    return rows.select("clsid", "wow64", "module_path", "machine_path", F.col("k").isNotNull().alias("in_machine"), F.coalesce(differs, F.lit(True)).alias("differs"))


def first_of_chain(parents: DataFrame, chain: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Each parent with the value of its least chain index, kept with an empty value where it has no chain. The correlated subquery becomes one aggregate and a left join."""
    first = chain.groupBy(key).agg(F.min_by(value, index).alias(value))
    return parents.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit("")))


def as_hits(rows: DataFrame, **values: Column | str) -> DataFrame:
    """Rows of a detection as hits."""
    return rows.select(*(F.coalesce(v if isinstance(v := values.get(c, ""), Column) else F.lit(v), F.lit("")).alias(c) for c in HIT_COLUMNS))
