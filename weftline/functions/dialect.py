"""The dialect's spellings in a query's text, rewritten to Spark SQL before Spark parses it.

Only calls by name and a few fixed forms are replaced, outside quotes; all else
is Spark SQL and is left to Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import INPUT, EngineError

#: The layouts of dates and times that YEAR and MONTH take.
DATE_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def masked(text: str) -> tuple[str, list[str]]:
    """The text with each quoted part and comment as a mark \\x02n\\x03, and those parts."""
    parts: list[str] = []

    def put(m: re.Match) -> str:
        parts.append(m[0])
        return f"\x02{len(parts) - 1}\x03"

    return _QUOTED.sub(put, text), parts


def unmasked(text: str, parts: list[str]) -> str:
    return re.sub(r"\x02(\d+)\x03", lambda m: parts[int(m[1])], text)


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call in masked text, from the place after its bracket, and the place after the closing one."""
    out, depth, start = [], 0, at
    for i in range(at, len(text)):
        c = text[i]
        if c in "([":
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
        elif c == ")":
            last = text[start:i].strip()
            return [*out, last] if out or last else [], i + 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    raise EngineError(INPUT, "a bracket is not closed")


def _path(p: str) -> str:
    """A path from the root; a literal one stays a literal."""
    if m := re.fullmatch(r"'([^']*)'", p.strip()):
        return f"'{m[1]}'" if m[1].startswith("$") else f"'$.{m[1]}'"
    return f"CASE WHEN startswith({p}, '$') THEN {p} ELSE concat('$.', {p}) END"


def _number(x: str) -> str:
    return f"try_cast({x} AS DOUBLE)"


def _json_value(x: str, p: str) -> str:
    found = f"get_json_object({x}, {_path(p)})"
    return f"CASE WHEN startswith(trim({found}), '[') THEN get(filter(from_json({found}, 'array<string>'), x -> x IS NOT NULL), 0) ELSE {found} END"


def _to_date(x: str, layout: str = "'YYYY-MM-DD'") -> str:
    return f"date_format(try_to_timestamp(CAST({x} AS STRING), replace(replace({layout}, 'YYYY', 'yyyy'), 'DD', 'dd')), 'yyyy-MM-dd')"


def _date_diff(a: str, b: str) -> str:
    day = "try_to_timestamp(CAST({} AS STRING), 'yyyy-MM-dd')"
    return f"datediff({day.format(a)}, {day.format(b)})"


def _moment(x: str) -> str:
    """A timestamp from a date, a timestamp or text of any of the usual layouts."""
    layouts = ", ".join(f'try_to_timestamp(CAST({x} AS STRING), "{layout}")' for layout in DATE_LAYOUTS)
    return f"coalesce({layouts}, try_cast({x} AS TIMESTAMP))"


def _substr(x: str, start: str, n: str = "2147483647") -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {start} < 1 THEN '' ELSE substr({x}, {start}, {n}) END"


def _typed_json(name: str) -> Callable[..., str]:
    """A JSON call of an object (struct, map, array, variant) is one of its JSON text."""
    return lambda kinds, x, p: CALLS[name](x if kinds[0] == "string" else f"to_json({x})", p)


def _numeric(name: str) -> Callable[..., str | None]:
    """An aggregate of text is one of what is numeric in it."""
    empty = "0.0D" if name == "sum" else "NULL"
    return lambda kinds, x: f"coalesce({name}(try_cast({x} AS DOUBLE)), {empty})" if kinds[0] == "string" else None


#: Functions that Spark lacks or means otherwise: name, and what a call becomes.
CALLS: dict[str, Callable[..., str]] = {
    "JSON_EXTRACT": lambda x, p: f"get_json_object({x}, {_path(p)})",
    "JSON_EXISTS": lambda x, p: f"coalesce(try_variant_get(try_parse_json({x}), {_path(p)}, 'variant') IS NOT NULL, false)",
    "JSON_VALUE": _json_value,
    "TO_NUMBER": _number,
    "TO_DATE": _to_date,
    "DATEDIFF": _date_diff,
    "COALESCE": lambda *xs: "coalesce(" + ", ".join(f"CASE WHEN CAST({x} AS STRING) <> '' THEN {x} END" for x in xs) + ")",
    "SUBSTR": _substr,
    "CONCAT": lambda *xs: "concat(" + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in xs) + ")",
    "LENGTH": lambda x: f"octet_length({x})",
    "DIFF": lambda x: f"(max({_number(x)}) - min({_number(x)}))",
    "NOW": lambda: "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')",
    "CURRENT_TIMESTAMP": lambda: "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')",
    "CURRENT_DATE": lambda: "date_format(current_date(), 'yyyy-MM-dd')",
    "YEAR": lambda x: f"year({_moment(x)})",
    "MONTH": lambda x: f"month({_moment(x)})",
}
#: Aggregates that mean otherwise than Spark's unless a window follows: the value of the row whose JSON text, names sorted (a variant's always are), is least or greatest.
ROW_CALLS = {"FIRST": "min_by({}, to_json(parse_json(to_json(struct(*)))))", "LAST": "max_by({}, to_json(parse_json(to_json(struct(*)))))"}
#: Calls whose meaning goes by the types of their arguments: what a call becomes (None: Spark's own).
TYPED: dict[str, Callable[..., str | None]] = {
    **{n: _typed_json(n) for n in ("JSON_EXTRACT", "JSON_EXISTS", "JSON_VALUE")},
    **{n.upper(): _numeric(n) for n in ("sum", "min", "max")},
    "CONCAT": lambda kinds, *xs: None if any(k.startswith("array") for k in kinds) else CALLS["CONCAT"](*xs),
}
_MARK = "\x05"


class Types:
    """The argument types of a text's typed calls, numbered as they are met; ``asking`` writes calls that tell them to whoever reads the analysed plan."""

    def __init__(self, asking: bool = False, known: dict[int, list[str]] | None = None):
        self.asking, self.known, self.met = asking, known or {}, 0

    def call(self, name: str, args: list[str]) -> str | None:
        number, self.met = self.met, self.met + 1
        if self.asking:
            kinds = ", ".join(f"typeof({a})" for a in (args[:1] if name.startswith("JSON") else args))
            asked = f"concat('{_MARK}{number}{_MARK}', {kinds})"
            return f"max({asked})" if name in ("SUM", "MIN", "MAX") else asked
        kinds = self.known.get(number)
        if kinds is None:
            return CALLS[name](*args) if name in CALLS else None
        return TYPED[name](kinds, *args)


def told(plan) -> dict[int, list[str]]:
    """What an analysed plan tells of the calls that ``Types`` asks."""
    out: dict[int, list[str]] = {}

    def items(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def expression(e) -> None:
        below = list(items(e.children()))
        if e.getClass().getSimpleName() == "Concat" and below and below[0].toString().startswith(_MARK):
            out[int(below[0].toString().split(_MARK)[1])] = [t.children().head().dataType().simpleString() for t in below[1:]]
        for c in below:
            expression(c)

    def walk(node) -> None:
        for e in items(node.expressions()):
            expression(e)
        for group in (node.children(), node.subqueries(), node.innerChildren()):
            for c in items(group):
                walk(c)

    walk(plan)
    return out


def _like(parts: list[str]) -> Callable[[re.Match], str]:
    def put(m: re.Match) -> str:
        quoted = parts[int(m[1])]
        if not quoted.lower().startswith("'i:"):
            return m[0]
        pattern = quoted[3:-1]
        parts.append(f"'{pattern}'" if "%" in pattern or "_" in pattern else f"'%{pattern}%'")
        return f"ILIKE \x02{len(parts) - 1}\x03"

    return put


def spark_sql(text: str, types: Types | None = None) -> str:
    """A query's text as Spark SQL. types: the types of its calls' arguments as far as they are known."""
    types = types or Types()
    text, parts = masked(text)
    text = re.sub(r"(?i)\bLIKE\s+\x02(\d+)\x03", _like(parts), text)
    text = re.sub(r"(?i)\bFROM\s+dual\b", "FROM (SELECT 1 AS dummy) dual", text)
    text = re.sub(r"(?i)\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", text)
    text = re.sub(r"(?i)\bLIMIT\s+0\b", "LIMIT ALL", text)
    text = re.sub(r"(?i)(?<![\w.])(CURRENT_DATE|CURRENT_TIMESTAMP)(?![\w(]|\s*\()", r"\1()", text)
    names = "|".join({*CALLS, *ROW_CALLS, *TYPED})
    at = 0
    while m := re.compile(rf"(?i)(?<![\w.])({names})\s*\(").search(text, at):
        args, end = arguments(text, m.end())
        name = m[1].upper()
        if name in ROW_CALLS and re.match(r"(?i)\s*(OVER|IGNORE|RESPECT|FILTER)\b", text[end:]):
            at = m.end()  # Spark's own
            continue
        inner = [_rewritten(a, parts, types) for a in args]
        try:
            if name in ROW_CALLS:
                new = ROW_CALLS[name].format(*inner)
            elif name in TYPED and not re.match(r"(?i)(DISTINCT|ALL)\b|$", args[0] if args else ""):
                new = types.call(name, inner)
            else:
                new = CALLS[name](*inner) if name in CALLS else None
        except (TypeError, IndexError):
            new = None
        if new is None:  # Spark's own, with what its arguments have become
            new = f"{m[1]}({', '.join(inner)})"
        new, more = masked(new)
        shift = len(parts)
        parts += more
        new = re.sub(r"\x02(\d+)\x03", lambda x: f"\x02{int(x[1]) + shift}\x03", new)
        text, at = text[: m.start()] + new + text[end:], m.start() + len(new)
    return unmasked(text, parts)


def _rewritten(masked_text: str, parts: list[str], types: Types) -> str:
    """An argument, unmasked, with the calls in it rewritten."""
    return spark_sql(unmasked(masked_text, parts), types)
