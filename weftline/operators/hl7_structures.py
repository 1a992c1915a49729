"""HL7 v2 messages nested by their structure: groups, repeats and optional parts of each message type.

A structure is written in the standard's own abstract syntax: ``[PD1]`` may be
missing, ``{NTE}`` repeats, ``{OBSERVATION: OBX {NTE}}`` is a group with a name. Segments
are placed in order: each goes into the innermost open group that can still take it, else
the groups about it are left one by one, and a group that repeats begins anew. What
can't be placed is listed, and so are required parts that are missing; nothing is lost.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import INPUT, EngineError
from .hl7 import FIELD_NAMES

_ADMIT = "MSH EVN PID [PD1] {ROL} {NK1} PV1 [PV2] {DB1} {OBX} {AL1} {DG1} [DRG] {PROCEDURE: PR1 {ROL}} {GT1} {INSURANCE: IN1 [IN2] {IN3}}"
_MOVE = "MSH EVN PID [PD1] {ROL} [PV1] [PV2] {DB1} {OBX} {AL1} {DG1}"
_VISIT = "[PATIENT: PID [PD1] {NTE} {NK1} [VISIT: PV1 [PV2]] {AL1}]"
_DRUG = "{RXR} {COMPONENT: RXC {NTE}}"
#: Structures by message type (HL7 v2, chapters 3, 4, 6, 7 and 10); types that share one name it.
STRUCTURES = {
    "ADT_A01": _ADMIT,
    "ADT_A02": _MOVE,
    "ADT_A03": "MSH EVN PID [PD1] {ROL} {NK1} PV1 [PV2] {DB1} {AL1} {DG1} [DRG] {PROCEDURE: PR1 {ROL}} {OBX}",
    "ADT_A04": "ADT_A01",
    "ADT_A05": _ADMIT,
    "ADT_A06": _ADMIT,
    "ADT_A08": "ADT_A01",
    "ADT_A11": _MOVE,
    "ADT_A12": _MOVE,
    "ADT_A13": "ADT_A01",
    "ORU_R01": f"MSH {{PATIENT_RESULT: {_VISIT} {{ORDER_OBSERVATION: [ORC] OBR {{NTE}} {{ROL}} {{OBSERVATION: OBX {{NTE}}}} {{SPECIMEN: SPM {{OBX}}}} {{FT1}}}}}} [DSC]",
    "ORM_O01": f"MSH {{NTE}} {_VISIT} {{ORDER: ORC [DETAIL: OBR {{NTE}} {{DG1}} {{OBSERVATION: OBX {{NTE}}}}] [ENCODED: RXE {{NTE}} {_DRUG}] {{FT1}} {{ROL}}}}",
    "ORR_O02": f"MSH MSA {{ERR}} {{NTE}} [RESPONSE: {_VISIT} {{ORDER: ORC [OBR] {{NTE}} [ENCODED: RXE {{NTE}} {_DRUG}] {{ROL}}}}]",
    "RAS_O17": f"MSH {{NTE}} {_VISIT} {{ORDER: ORC [ENCODED: RXE {{NTE}} {_DRUG}] {{ADMINISTRATION: {{RXA}} [RXR] {{OBSERVATION: OBX {{NTE}}}}}} {{ROL}}}}",
    "ACK": "MSH MSA {ERR}",
    "SIU_S12": "MSH SCH {NTE} {PATIENT: PID [PD1] [PV1] [PV2] {OBX} {DG1} {ROL}} {RESOURCES: RGS {SERVICE: AIS {NTE}} {GENERAL_RESOURCE: AIG {NTE}} {LOCATION_RESOURCE: AIL {NTE}} {PERSONNEL_RESOURCE: AIP {NTE}}}",
    "DFT_P03": "MSH EVN PID [PD1] {ROL} [PV1] [PV2] {DB1} {OBX} {FINANCIAL: FT1 {NTE} {PROCEDURE: PR1 {ROL}}} {DG1} {GT1} {INSURANCE: IN1 [IN2] {IN3}}",
}
#: Parts of composite fields by type; others are component_n.
PARTS = {
    "CE": ("identifier", "text", "coding_system", "alternate_identifier", "alternate_text", "alternate_coding_system"),
    "CX": ("id", "check_digit", "check_digit_scheme", "assigning_authority", "identifier_type"),
    "HD": ("namespace_id", "universal_id", "universal_id_type"),
    "MSG": ("message_code", "trigger_event", "message_structure"),
    "PL": ("point_of_care", "room", "bed", "facility"),
    "XAD": ("street", "other_designation", "city", "state", "postal_code", "country"),
    "XCN": ("id", "family_name", "given_name"),
    "XPN": ("family_name", "given_name", "middle_name", "suffix", "prefix"),
}
#: The type of composite fields by segment and place.
TYPES = {
    "MSH": {3: "HD", 4: "HD", 5: "HD", 6: "HD", 9: "MSG"}, "PID": {3: "CX", 5: "XPN", 11: "XAD", 18: "CX"}, "PV1": {3: "PL", 7: "XCN", 8: "XCN", 9: "XCN", 19: "CX"}, "NK1": {2: "XPN", 3: "CE", 4: "XAD"},
    "OBR": {4: "CE", 16: "XCN"}, "OBX": {3: "CE", 6: "CE"}, "AL1": {2: "CE", 3: "CE"}, "DG1": {3: "CE"}, "PR1": {3: "CE"}, "FT1": {7: "CE"}, "ORC": {12: "XCN"}, "RXE": {2: "CE"}, "RXA": {5: "CE"},
}
#: Names of fields beside those of ``hl7.FIELD_NAMES``.
NAMES = {
    "EVN": {1: "event_type", 2: "recorded_datetime", 6: "event_occurred"}, "NK1": {1: "set_id", 2: "name", 3: "relationship", 4: "address", 5: "phone"},
    "OBR": {1: "set_id", 2: "placer_order_number", 3: "filler_order_number", 4: "service", 7: "observation_datetime", 16: "ordering_provider", 25: "result_status"},
    "OBX": {1: "set_id", 2: "value_type", 3: "observation", 4: "sub_id", 5: "value", 6: "units", 7: "reference_range", 8: "abnormal_flags", 11: "result_status", 14: "observation_datetime"},
    "NTE": {1: "set_id", 2: "source", 3: "comment"}, "AL1": {1: "set_id", 2: "type", 3: "code", 4: "severity", 5: "reaction"}, "DG1": {1: "set_id", 3: "code", 4: "description", 6: "type"},
    "PR1": {1: "set_id", 3: "code", 5: "procedure_datetime"}, "ORC": {1: "order_control", 2: "placer_order_number", 3: "filler_order_number", 5: "order_status", 12: "ordering_provider"},
    "MSA": {1: "acknowledgment_code", 2: "message_control_id", 3: "text"}, "SCH": {1: "placer_appointment_id", 2: "filler_appointment_id", 6: "event_reason", 11: "timing"}, "AIS": {1: "set_id", 3: "service", 4: "start_datetime"},
    "FT1": {1: "set_id", 4: "transaction_date", 6: "transaction_type", 7: "transaction_code", 10: "quantity", 11: "amount"}, "RXE": {2: "give_code", 3: "give_amount"}, "RXR": {1: "route"}, "ROL": {3: "role", 4: "person"},
}


@dataclass
class Part:
    """A segment, or a group of parts."""

    name: str
    repeats: bool = False
    optional: bool = False
    parts: tuple[Part, ...] = ()

    def __post_init__(self):
        self.key = self.name.lower()
        #: The places of a group's parts that take a segment, in order, and the parts that it requires.
        self.places: dict[str, list[int]] = {}
        for i, p in enumerate(self.parts):
            for segment in p.places if p.parts else (p.name,):
                self.places.setdefault(segment, []).append(i)
        self.required = [(p.key, f"{self.name}.{p.name}") for p in self.parts if not p.optional]


def structure(text: str) -> Part:
    """A structure from its abstract syntax."""
    tokens = re.findall(r"[\[\]{}]|\w+:?", text)

    def many(at: int, end: str) -> tuple[list[Part], int]:
        out: list[Part] = []
        while at < len(tokens) and tokens[at] != end:
            t = tokens[at]
            if t in "[{":
                inner, at = many(at + 1, "]" if t == "[" else "}")
                one = inner[0] if len(inner) == 1 else None
                if one is None:
                    raise EngineError(INPUT, f"a bracket of {text!r} holds several parts and no name")
                out.append(Part(one.name, one.repeats or t == "{", True, one.parts))
            elif t.endswith(":"):
                inner, at = many(at + 1, end)
                out.append(Part(t[:-1], parts=tuple(inner)))
                continue
            elif t in "]}":
                raise EngineError(INPUT, f"brackets of {text!r} don't match")
            else:
                out.append(Part(t))
            at += 1
        if end and at >= len(tokens):
            raise EngineError(INPUT, f"a bracket of {text!r} is not closed")
        return out, at

    return Part("message", parts=tuple(many(0, "")[0]))


class _Open:
    """A group that takes segments: how far it has come, and what it holds so far."""

    __slots__ = ("part", "places", "at", "values")

    def __init__(self, part: Part):
        self.part, self.places, self.at, self.values = part, part.places, 0, {}


def nested(segments: list[tuple[str, dict]], part: Part) -> tuple[dict, list[str], list[str]]:
    """(the message as nested values, segments that can't be placed, required parts that are missing)."""
    top = group = _Open(part)
    path, opened, lost = [top], [top], []  # the open groups, the innermost last; every group
    for segment, value in segments:
        for depth in range(len(path) - 1, -1, -1):
            group, p = path[depth], None
            for i in group.places.get(segment, ()):  # the next place that can take it, itself or in a group that begins there
                p = group.part.parts[i]
                if i >= group.at and (p.repeats or p.key not in group.values):
                    break
                p = None
            if p is not None:
                break
        else:
            lost.append(segment)
            continue
        del path[depth + 1 :]
        while True:
            group.at = i
            inner = _Open(p) if p.parts else None
            found = inner.values if inner else value
            if not p.repeats:
                group.values[p.key] = found
            elif p.key in group.values:
                group.values[p.key].append(found)
            else:
                group.values[p.key] = [found]
            if inner is None:
                break
            path.append(inner)
            opened.append(inner)
            group, i = inner, inner.places[segment][0]  # it holds the segment, so it takes it
            p = inner.part.parts[i]
    missing = [label for o in opened for key, label in o.part.required if key not in o.values]
    return top.values, lost, missing


def _places(name: str) -> list[tuple[str, tuple[str, ...]]]:
    """Name and parts of a segment's fields, as far as any is known."""
    names, types = {**FIELD_NAMES.get(name, {}), **NAMES.get(name, {})}, TYPES.get(name, {})
    return [(names.get(n, f"field_{n}"), PARTS.get(types.get(n, ""), ())) for n in range(1, max([0, *names, *types]) + 1)]


_PLACES = {name: _places(name) for name in {*FIELD_NAMES, *NAMES, *TYPES}}
#: Lines that a reader keeps, and how long they may be: many are the same in message after message.
_LINES, _LENGTH = 4096, 256


@lru_cache(16)
def reader(signs: str) -> Callable[[str], tuple[str, dict]]:
    """Of a line, by a message's signs: (segment, its fields by name): a text, a list of repetitions, or components and subcomponents by name.

    The fields of a line may be those of an equal one before: they are not to be changed.
    """
    field, component, repetition, esc, sub = signs
    plain = {f"{esc}{k}{esc}": v for k, v in zip("FSRTE", (field, component, repetition, sub, esc))}
    escaped = re.compile("|".join(map(re.escape, plain)))
    special = re.compile("|".join(map(re.escape, (component, repetition, esc, sub)))).search
    clean = lambda v: escaped.sub(lambda m: plain[m[0]], v) if esc in v else v

    def one(v: str, parts: tuple[str, ...]):
        if component not in v and sub not in v:
            return {parts[0]: clean(v)} if parts and v else clean(v)
        out = {}
        for i, c in enumerate(v.split(component)):
            if c:
                out[parts[i] if i < len(parts) else f"component_{i + 1}"] = {f"subcomponent_{k + 1}": clean(s) for k, s in enumerate(c.split(sub)) if s} if sub in c else clean(c)
        return out

    def read(line: str) -> tuple[str, dict]:
        name, *values = line.split(field)
        places, out = _PLACES.get(name, ()), {}
        if name == "MSH":  # its first field is the separator itself, its second the other signs
            values = ["", "", *values[1:]]
        known, signed = len(places), special(line)
        for n, v in enumerate(values):
            if v:
                key, parts = places[n] if n < known else (f"field_{n + 1}", ())
                if signed and special(v):
                    found = [one(x, parts) for x in v.split(repetition)]
                    out[key] = found[0] if len(found) == 1 else found
                else:
                    out[key] = {parts[0]: v} if parts else v
        return name, out

    kept = lru_cache(_LINES)(read)
    return lambda line: kept(line) if len(line) <= _LENGTH else read(line)


def fields_of(line: str, signs: str) -> tuple[str, dict]:
    """``reader``, of one line."""
    return reader(signs)(line)


def xml_of(name: str, value, part: Part | None = None) -> str:
    """A value as elements; segments and groups in capitals, fields as they are named."""
    if isinstance(value, list):
        return "".join(xml_of(name, v, part) for v in value)
    if not isinstance(value, dict):
        return f"<{name}>{escape(value)}</{name}>"
    if part and part.parts:
        inner = "".join(xml_of(p.name, value[p.key], p) for p in part.parts if p.key in value)
    else:
        inner = "".join(xml_of(k, v) for k, v in value.items())
    return f"<{name}>{inner}</{name}>"


def _signs(message: str) -> str:
    own = re.match(r"[^A-Za-z0-9\s]*", message[3:9])[0] if message.startswith("MSH") else ""
    head = own[:1] + own[1:].split(own[:1])[0] if own else ""
    return head + "|^~\\&"[len(head) :] if len(head) < 5 else head[:5]


def structured(messages: DataFrame, column: str = "raw_message", structures: dict[str, str] | None = None, xml: bool = True) -> DataFrame:
    """The message's columns with structure (its type's name), json and xml (nested; null if not wanted), unplaced and missing (parts); one row per message.

    structures: more types, or other ones. The segments of a type that has no structure all stand at the top and
    repeat. A null or blank message gives nulls. Messages are independent: there is no shuffle.
    """
    texts = STRUCTURES | (structures or {})
    at = messages.columns.index(column)
    added = [("structure", T.StringType()), ("json", T.StringType()), ("xml", T.StringType()), ("unplaced", T.ArrayType(T.StringType())), ("missing", T.ArrayType(T.StringType()))]
    schema = T.StructType([*messages.schema.fields, *(T.StructField(*f) for f in added)])

    as_json = json.JSONEncoder(ensure_ascii=False).encode

    def parsed(message: str | None, known: dict[str, Part]):
        lines = [x for x in (message or "").replace("\n", "\r").split("\r") if x and not x.isspace()]
        if not lines:
            return (None,) * 5
        signs = _signs(lines[0].lstrip())
        read = reader(signs)
        found = [read(x.lstrip()) for x in lines]
        kind = next((v.get("message_type") for n, v in found if n == "MSH"), None) or {}
        code, event = (kind.get("message_code", ""), kind.get("trigger_event", "")) if isinstance(kind, dict) else (kind, "")
        name = f"{code}_{event}" if f"{code}_{event}" in texts else code if code in texts else f"{code}_{event}".strip("_")
        if name not in texts:
            every: dict = {}
            for n, v in found:
                every.setdefault(n.lower(), []).append(v)
            value, lost, missing = every, [], []
            part = Part("message", parts=tuple(Part(n.upper()) for n in every))
        else:
            if name not in known:
                known[name] = structure(texts.get(texts[name], texts[name]))
            part = known[name]
            value, lost, missing = nested(found, part)
        return name, as_json(value), xml_of(name or "HL7", value, part) if xml else None, lost, missing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Part] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                cols = list(zip(*(parsed(m, known) for m in b.column(at).to_pylist())))
                kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), kind) for c, kind in zip(cols, kinds))], names=schema.names)

    return messages.mapInArrow(run, schema)
