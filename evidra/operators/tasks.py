"""Exported task definitions as one flat table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import fence
from evidra.operators.nested import elements

#: Fixed list: the kinds of triggers, in the order in which they are named.
TRIGGERS = ("BootTrigger", "RegistrationTrigger", "IdleTrigger", "TimeTrigger", "EventTrigger", "CalendarTrigger", "LogonTrigger", "SessionStateChangeTrigger", "WnfStateChangeTrigger")
_COLUMNS = (
    "task_no int, tier string, task_name string, enabled boolean, triggers string, action_type string, command string, arguments string, class_id string, com_data string, "
    "user_id string, group_id string, run_level string, logon_type string, author string, description string, flags string"
)


def scheduled_tasks(records: DataFrame, key: str, text: str, tier: Column | None = None, flags: Column | None = None) -> DataFrame:
    """One row for each task of the XML texts: the key, task_no, tier, task_name, enabled, triggers, action_type, command, arguments, class_id, com_data,
    user_id, group_id, run_level, logon_type, author, description, flags.

    A task is enabled unless it says otherwise; triggers are named by kind, in fixed order, `None` without any; several
    actions are joined by ` ; `, empty arguments and data left out; the first principal counts. `tier` and `flags` are what
    the caller makes of the other columns, empty if not given. The texts are read by `nested.elements`, with its results
    for null, empty, broken and repeated texts; what is gathered per task are its own parts.
    """
    found = elements(records, key, text)
    if found is None:
        return records.sparkSession.createDataFrame([], f"{key} {dict(records.dtypes)[key]}, {_COLUMNS}")
    rows = found.where(F.col("path").rlike("^(?:Tasks/)?Task(?:/|$)"))
    rows = fence(rows, at=F.when(F.col("path").startswith("Tasks/"), 2).otherwise(1), ids=F.split("node_id", r"\."), sames=F.split("same_id", r"\."))
    rows = rows.select(
        "key", F.when(F.col("at") == 1, 1).otherwise(F.get("sames", F.lit(1)).cast("int")).alias("task_no"), F.regexp_replace("path", "^(?:Tasks/)?Task/?", "").alias("part"),
        F.get("ids", F.col("at") + 1).cast("int").alias("place"), F.get("sames", F.col("at") + 1).alias("same"), F.coalesce("text", F.lit("")).alias("value"),
    )
    is_part = lambda x: F.col("part") == x
    one = lambda x: F.coalesce(F.min(F.when(is_part(x), F.col("value"))), F.lit(""))
    first = lambda x: F.coalesce(F.min(F.when(is_part(f"Principals/Principal/{x}") & (F.col("same") == "1"), F.col("value"))), F.lit(""))
    listed = lambda x: F.array_sort(F.collect_list(F.when(is_part(x), F.struct("place", "value"))))
    kinds = F.collect_set(F.when(F.col("part").rlike("^Triggers/[^/]+$"), F.substring_index("part", "/", -1)))
    rows = rows.groupBy("key", "task_no").agg(
        kinds.alias("kinds"), listed("Actions/Exec").alias("execs"), listed("Actions/Exec/Command").alias("commands"), listed("Actions/Exec/Arguments").alias("arguments"),
        listed("Actions/ComHandler").alias("handlers"), listed("Actions/ComHandler/ClassId").alias("classes"), listed("Actions/ComHandler/Data").alias("data"),
        one("RegistrationInfo/URI").alias("task_name"), one("RegistrationInfo/Author").alias("author"), one("RegistrationInfo/Description").alias("description"),
        (~F.lower(one("Settings/Enabled")).isin("false", "0")).alias("enabled"),
        first("UserId").alias("user_id"), first("GroupId").alias("group_id"), first("RunLevel").alias("run_level"), first("LogonType").alias("logon_type"),
    )

    def of_each(owners: str, parts: str) -> Column:
        """The part of each owner, empty where it has none."""
        own = lambda o: F.get(F.filter(parts, lambda x: x["place"] == o["place"]), F.lit(0))["value"]
        return F.array_join(F.transform(owners, lambda o: F.coalesce(own(o), F.lit(""))), " ; ")

    filled = lambda parts: F.array_join(F.transform(F.filter(parts, lambda x: x["value"] != ""), lambda x: x["value"]), " ; ")
    named = F.array_join(F.filter(F.array(*map(F.lit, TRIGGERS)), lambda t: F.array_contains("kinds", t)), ", ")
    runs, handles = F.size("execs") > 0, F.size("handlers") > 0
    flat = rows.select(
        F.col("key").alias(key), "task_no", "task_name", "enabled", F.when(named == "", "None").otherwise(named).alias("triggers"),
        F.when(runs & handles, "Multiple").when(runs, "Exec").when(handles, "ComHandler").otherwise("None").alias("action_type"),
        of_each("execs", "commands").alias("command"), filled("arguments").alias("arguments"), of_each("handlers", "classes").alias("class_id"), filled("data").alias("com_data"),
        "user_id", "group_id", "run_level", "logon_type", "author", "description",
    )
    empty = F.lit("")
    flat = flat.withColumns({"tier": empty if tier is None else tier, "flags": empty if flags is None else flags})
    return flat.select(key, *(x.split()[0] for x in _COLUMNS.split(", ")))
