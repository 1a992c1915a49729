"""File sources and sinks by extension or format."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import INPUT, EngineError

#: Segments about the messages of a batch.
_ENVELOPE = ("FHS", "BHS", "BTS", "FTS")
_PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("turn", pa.int32()), ("opens", pa.bool_()), ("blank", pa.bool_()), ("text", pa.string())])


def read_file(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """csv (header, all text), json (array of objects), ndjson, parquet, orc, text or hl7.

    Files are cut into many tasks' work at line ends. A csv whose quoted fields hold line ends needs
    ``multiLine="true"``, and each of its files is then one task's; so is a json array's (many objects: ndjson).
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read.options(**options)
    if kind == "csv":
        return r.csv(path, header=True, inferSchema=False, escape='"')
    if kind == "json":
        return r.option("multiLine", options.get("multiLine", "true")).json(path)
    if kind in ("ndjson", "jsonl"):
        return r.json(path)
    if kind in ("parquet", "orc"):
        return getattr(r, kind)(path)
    if kind in ("text", "txt", "log"):
        return r.text(path)
    if kind in ("hl7", "hl7_file"):
        return hl7_messages(spark, path)
    raise EngineError(INPUT, f"no reader for {kind!r}")


def regex_lines(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """A column for each <name> of the pattern, from the lines that match.

    <name> stands for the shortest text; the rest is literal.
    """
    names = re.findall(r"<(\w+)>", pattern)
    java = "^" + "".join("(.*?)" if i % 2 else re.escape(part) for i, part in enumerate(re.split(r"<(\w+)>", pattern))) + "$"
    c = F.col(column)
    return lines.filter(c.rlike(java)).select(*(F.regexp_extract(c, java, i + 1).alias(n) for i, n in enumerate(names)))


def hl7_messages(spark: SparkSession, path: str, blank_lines: bool = True) -> DataFrame:
    """raw_message, source_path: one row per message of files; segments end in carriage returns.

    A message begins at a line that starts with MSH (whatever its separator; MSH within a field is text) and, with
    ``blank_lines``, after a blank line. Headers and trailers of batches are left out. Lines end in CR, LF or both. A large file is many tasks' work: each
    task puts together the messages of its stretches of lines, in file order; only the first and
    the last piece of a stretch (which may be parts of one message) are put together in a second step, by file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    kind = "path string, start long, turn int, opens boolean, blank boolean, text string"

    def pieces(batches):
        """Runs of lines that are of one message as far as their stretch tells. opens: begins a message for certain; blank: a blank line follows; turn 0 and -1: the stretch's ends."""
        at, held, opens, turn, out = None, [], False, 0, []

        def flush(blank: bool, last: bool) -> None:
            nonlocal held, turn
            if held or blank or last:
                out.append((*at, -1 if last else turn, opens, blank, "\r".join(held)))
            held, turn = [], turn + 1

        for batch in batches:
            for line, where, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (where, start) != at:
                    if at:
                        flush(False, True)
                    at, opens, turn = (where, start), False, 0
                if not line.strip() or line.startswith(_ENVELOPE):
                    if blank_lines or line.strip():
                        flush(True, False)
                        opens = True
                    continue
                if line.startswith("MSH"):
                    if held or not opens:
                        flush(False, False)
                    opens = True
                held.append(line)
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "turn", "opens", "blank", "text"), x)) for x in out], schema=_PIECES)
            out = []
        if at:
            flush(False, True)
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "turn", "opens", "blank", "text"), x)) for x in out], schema=_PIECES)

    found = lines.mapInArrow(pieces, kind)
    whole = found.filter("opens and turn > 0").filter("text <> ''").select(F.col("text").alias("raw_message"), F.col("path").alias("source_path"))
    # of a stretch's ends: the first piece may go on with the message of the stretch before it
    order = Window.partitionBy("path").orderBy("start", F.when(F.col("turn") < 0, 2**31 - 1).otherwise(F.col("turn")))
    ends = found.filter("not opens or turn <= 0")
    new = F.col("opens") | F.coalesce(F.lag("blank").over(order), F.lit(True))
    ends = ends.withColumn("new", new.cast("int")).withColumn("message", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", F.when(F.col("turn") < 0, 2**31 - 1).otherwise(F.col("turn")).alias("turn"), "text")))
    joined = ends.groupBy("path", "message").agg(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), "\r").alias("raw_message"))
    return whole.unionByName(joined.filter("raw_message <> ''").select("raw_message", F.col("path").alias("source_path")))


def write_file(df: DataFrame, path: str, kind: str, mode: str = "append", one_file: bool = False) -> None:
    """csv with a header, json lines, json_array (each file one array), parquet or orc. ``one_file`` is for small results."""
    w = (df.coalesce(1) if one_file else df).write.mode(mode)
    if kind == "csv":
        w.csv(path, header=True)
    elif kind == "json_array":
        lines = F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("value")
        rows = (df.coalesce(1) if one_file else df).select(lines)

        def arrays(batches):
            first = True
            for b in batches:
                for part in (b.slice(k, 1024) for k in range(0, b.num_rows, 1024)):
                    yield pa.RecordBatch.from_pydict({"value": [("[" if first and not k else ",") + x for k, x in enumerate(part.column(0).to_pylist())]})
                    first = False
            yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

        rows.mapInArrow(arrays, "value string").write.mode(mode).text(path)
    elif kind in ("json", "parquet", "orc"):
        getattr(w, kind)(path)
    else:
        raise EngineError(INPUT, f"no writer for {kind!r}")
