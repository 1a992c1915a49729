"""HL7 v2 messages by built-in functions: segments, named fields, JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of fields by place (HL7 v2 chapter 2 and 3); others are field_n.
FIELD_NAMES = {
    "MSH": {3: "sending_application", 4: "sending_facility", 5: "receiving_application", 6: "receiving_facility", 7: "message_datetime", 9: "message_type", 10: "message_control_id", 11: "processing_id", 12: "version_id"},
    "PID": {1: "set_id", 3: "patient_id", 5: "patient_name", 7: "birth_date", 8: "sex", 11: "address", 13: "phone_home"},
    "PV1": {1: "set_id", 2: "patient_class", 3: "assigned_location", 7: "attending_doctor", 19: "visit_number", 44: "admit_datetime"},
}


def delimiters(message: Column | str) -> Column:
    """field, component, repetition, escape, subcomponent: the message's own, as its MSH names them, or the usual ones."""
    m = F.col(message) if isinstance(message, str) else message
    own = m.startswith("MSH")
    field_, rest = F.when(own, F.substring(m, 4, 1)).otherwise(F.lit("|")), F.substring(m, 5, 4)
    named = F.when(own, F.regexp_extract(rest, r"^[^A-Za-z0-9\s]*", 0)).otherwise(F.lit(""))
    named = F.get(F.split(named, F.concat(F.lit(r"\Q"), field_, F.lit(r"\E"))), F.lit(0))
    one = lambda at, usual: F.when(F.length(named) >= at, F.substring(named, at, 1)).otherwise(F.lit(usual))
    return F.struct(field_.alias("field"), one(1, "^").alias("component"), one(2, "~").alias("repetition"), one(3, "\\").alias("escape"), one(4, "&").alias("subcomponent"))


def _cut(text: Column, sign: Column) -> Column:
    return F.split(text, F.concat(F.lit(r"\Q"), sign, F.lit(r"\E")), F.lit(-1))


def _lines(message: Column) -> Column:
    return F.filter(F.split(message, r"[\r\n]+"), lambda x: F.trim(x) != "")


def _fields(line: Column, sep: Column) -> Column:
    """The fields of a segment; MSH's first is its separator."""
    cut = _cut(line, sep)
    rest = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.when(F.get(cut, F.lit(0)) == "MSH", F.concat(F.array(sep), rest)).otherwise(rest)


def unescaped(value: Column, d: Column) -> Column:
    """A value with \\F\\ \\S\\ \\R\\ \\T\\ \\E\\ (by the message's escape sign) as the signs that they stand for."""
    out = value
    for letter, name in (("F", "field"), ("S", "component"), ("R", "repetition"), ("T", "subcomponent"), ("E", "escape")):
        out = F.replace(out, F.concat(d["escape"], F.lit(letter), d["escape"]), d[name])
    return out


def segments(messages: DataFrame, column: str = "raw_message") -> DataFrame:
    """One row per segment: the message's columns, position, segment, fields (array of text; MSH's first is its separator)."""
    rows = messages.withColumn("_sep", delimiters(column)["field"]).select(*messages.columns, "_sep", F.posexplode(_lines(F.col(column))).alias("position", "line"))
    name = F.get(_cut(F.col("line"), F.col("_sep")), F.lit(0))
    return rows.select(*messages.columns, "position", name.alias("segment"), _fields(F.col("line"), F.col("_sep")).alias("fields"))


def field(message: Column | str, segment: str, n: int, component: int = 0, repetition: int = 0, subcomponent: int = 0) -> Column:
    """Field n of the first such segment of a message; null if missing or empty.

    A repetition, component or subcomponent (from 1) is cut out by the message's own signs and unescaped; without any, the
    field is as it stands.
    """
    m = F.col(message) if isinstance(message, str) else message
    d = delimiters(m)
    line = F.get(F.filter(_lines(m), lambda x: x.startswith(segment)), F.lit(0))
    value = F.get(_fields(line, d["field"]), F.lit(n - 1))
    for at, sign in ((repetition, "repetition"), (component, "component"), (subcomponent, "subcomponent")):
        value = F.get(_cut(value, d[sign]), F.lit(at - 1)) if at else value
    value = unescaped(value, d) if repetition or component or subcomponent else value
    return F.when(value != "", value)


def repetitions(messages: DataFrame, segment: str, n: int, column: str = "raw_message") -> DataFrame:
    """One row per repetition of a field in all segments of a name: the message's columns, position, repetition, components (array of text, unescaped)."""
    d, m = delimiters(column), F.col(column)
    rows = messages.select(*messages.columns, d.alias("_d"), F.posexplode(_lines(m)).alias("position", "_line")).filter(F.col("_line").startswith(segment))
    rows = rows.select("*", F.posexplode(_cut(F.get(_fields(F.col("_line"), F.col("_d.field")), F.lit(n - 1)), F.col("_d.repetition"))).alias("repetition", "_value"))
    parts = F.transform(_cut(F.col("_value"), F.col("_d.component")), lambda x: unescaped(x, F.col("_d")))
    return rows.filter("_value <> ''").select(*messages.columns, "position", "repetition", parts.alias("components"))


def documents(messages: DataFrame, column: str = "raw_message", names: dict[str, dict[int, str]] | None = None) -> DataFrame:
    """The message's columns with message_type, control_id, timestamp, segments (name to list of named fields), json, xml.

    names: more names of fields by segment and place, beside or instead of ``FIELD_NAMES``.
    """
    m = F.col(column)
    given = {s: FIELD_NAMES.get(s, {}) | (names or {}).get(s, {}) for s in {*FIELD_NAMES, *(names or {})}}
    known = F.create_map(*(x for s, some in sorted(given.items()) for k, v in sorted(some.items()) for x in (F.lit(f"{s}.{k}"), F.lit(v))))
    named = lambda segment, n: F.coalesce(F.try_element_at(known, F.concat_ws(".", segment, n)), F.concat(F.lit("field_"), n))
    messages_d = messages.withColumn("_d", delimiters(m))
    sep = F.col("_d.field")

    def parsed(line: Column) -> Column:
        name = F.get(_cut(line, sep), F.lit(0))
        pairs = F.transform(_fields(line, sep), lambda v, i: F.struct(named(name, i + 1).alias("key"), v.alias("value")))
        return F.struct(name.alias("name"), F.map_from_entries(F.filter(pairs, lambda p: p["value"] != "")).alias("fields"))

    every = F.transform(_lines(m), parsed)
    different = F.array_distinct(F.transform("_every", lambda s: s["name"]))
    grouped = F.map_from_entries(F.transform(different, lambda n: F.struct(n.alias("key"), F.transform(F.filter("_every", lambda s: s["name"] == n), lambda s: s["fields"]).alias("value"))))
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda k, v: F.concat(F.lit("<"), k, F.lit(">"), v, F.lit("</"), k, F.lit(">"))
    inner = lambda s: F.array_join(F.transform(F.map_entries(s["fields"]), lambda e: tag(e["key"], escape(e["value"]))), "")
    xml = F.concat(F.lit("<HL7>"), F.array_join(F.transform("_every", lambda s: tag(s["name"], inner(s))), ""), F.lit("</HL7>"))
    kind = F.array_join(_cut(field(m, "MSH", 9), F.col("_d.component")), "_")
    out = messages_d.withColumn("_every", every).withColumns({"message_type": kind, "control_id": field(m, "MSH", 10), "timestamp": field(m, "MSH", 7), "segments": grouped})
    return out.withColumns({"json": F.to_json("segments"), "xml": xml}).drop("_every", "_d")
