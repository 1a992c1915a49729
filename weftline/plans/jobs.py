"""Configured jobs as DataFrame plans, and the layers of their dependencies (running them is an orchestrator's work)."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import EXECUTION, INPUT, EngineError
from ..operators import checks, etl, relational
from ..sources.files import read_file, write_file
from ..sources.storage import Store


@dataclass
class Job:
    """sources: files or DataFrames; steps run in the order normalize, mapping, aggregate, key_value, filter, format, checks, dedup.

    destinations: paths, or settings {path, kind, mode, filter, mapping} of each; every one is loaded, with the rows
    that its filter leaves. lookups: name to file or DataFrame, for lookupIn in the mapping. steps: instead of that order, a list of
    {setting: value} in an order of its own, any of them as often as wanted. letters: rejects are written as dead letters (``etl.dead_letters``) with
    these settings (wait_s, most).
    """

    sources: list
    destinations: list = field(default_factory=list)
    kind: str = "parquet"
    mode: str = "append"
    normalize: dict[str, str] = field(default_factory=dict)
    mapping: dict[str, str] = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    lookups: dict = field(default_factory=dict)
    aggregate: dict | None = None
    key_value: dict | None = None
    filter: str | None = None
    format: dict[str, str] = field(default_factory=dict)
    rules: list = field(default_factory=list)
    dedup_field: str | None = None
    max_errors: int = 10
    dry_run: bool = False
    steps: list = field(default_factory=list)
    letters: dict | None = None

    @staticmethod
    def from_config(text: str) -> Job:
        """A job from JSON (or YAML where a reader for it is installed); destination or destinations, source or sources."""
        try:
            data = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise EngineError(INPUT, "the configuration is no JSON and no YAML reader is installed") from e
            data = yaml.safe_load(text)
        one = data.pop("destination", None)
        data["destinations"] = data.pop("destinations", None) or ([one] if one else [])
        data["sources"] = data.pop("sources", None) or [data.pop("source")]
        data["rules"] = [checks.Rule(**r) for r in data.get("rules", [])]
        unknown = set(data) - set(Job.__dataclass_fields__)
        if unknown:
            raise EngineError(INPUT, f"unknown settings: {sorted(unknown)}")
        return Job(**data)


@dataclass
class Summary:
    """loaded: rows over all destinations (or of a dry run); steps: rows that left each step; rate: percent of rows rejected."""

    loaded: int
    rejected: int
    failed: bool
    steps: dict[str, int] = field(default_factory=dict)
    rate: float = 0.0


def _frame(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return source if isinstance(source, DataFrame) else read_file(spark, source)


#: Settings of a job in the order in which they are steps, unless it lists its own.
ORDER = ("normalize", "mapping", "aggregate", "key_value", "filter", "format", "rules", "dedup_field")
#: Steps that part rows from rejects.
SPLITS = ("normalize", "mapping", "format", "rules")


def steps_of(job: Job) -> list[tuple[str, object]]:
    """(kind, settings) of a job's steps in order."""
    if not job.steps:
        return [(kind, getattr(job, kind)) for kind in ORDER if getattr(job, kind)]
    out = []
    for step in job.steps:
        if len(step) != 1 or next(iter(step)) not in ORDER:
            raise EngineError(INPUT, f"a step has one of {ORDER}, not {sorted(step)}")
        kind, value = next(iter(step.items()))
        out.append((kind, [r if isinstance(r, checks.Rule) else checks.Rule(**r) for r in value] if kind == "rules" else value))
    return out


def _step(spark: SparkSession, job: Job, kind: str, value, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, rejects if the step has any) of a step."""
    if kind == "normalize":
        return etl.normalize(df, value)
    if kind == "mapping":
        return etl.map_with_lookups(df, value, job.constants, {k: _frame(spark, v) for k, v in job.lookups.items()})
    if kind == "aggregate":
        return etl.aggregate(df, value["group_by"], [tuple(m) for m in value["measures"]]), None
    if kind == "key_value":
        return etl.key_value(df, **value), None
    if kind == "filter":
        return etl.filter_rows(df, value), None
    if kind == "format":
        return etl.format_fields(df, value)
    if kind == "rules":
        good, lost = checks.split_valid(df, value)
        return good, etl.rejects(lost.drop("errors"), "checks", F.lit("a rule fails"))
    return (relational.first_per_key(df, [value], *(F.col(c) for c in df.columns)) if value in df.columns else df.distinct()), None


def plan(spark: SparkSession, job: Job, after: Callable[[str, DataFrame, bool], DataFrame] = lambda step, df, splits: df) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rejects) of a job; nothing runs yet.

    after: what to do with the rows that leave each step (its kind, with a number from the second of a kind on; whether the next step parts them),
    such as counting or keeping them.
    """
    todo = steps_of(job)
    splits = [kind in SPLITS for kind, _ in todo] + [False]
    df = after("extract", etl.multi_source(*(_frame(spark, s) for s in job.sources)), splits[0])
    dead, met = spark.createDataFrame([], etl.REJECT), Counter()
    for i, (kind, value) in enumerate(todo):
        df, lost = _step(spark, job, kind, value, df)
        met[kind] += 1
        df = after(kind if met[kind] == 1 else f"{kind}{met[kind]}", df, splits[i + 1])
        dead = dead if lost is None else dead.unionByName(lost)
    return df, dead


def fan_out(good: DataFrame | None, job: Job) -> list[tuple[DataFrame | None, str, str, str]]:
    """(rows, path, kind, mode) of each destination."""
    out = []
    for to in job.destinations:
        to = {"path": to} if isinstance(to, str) else to
        if good is None:
            out.append((None, to["path"], to.get("kind", job.kind), to.get("mode", job.mode)))
            continue
        df = etl.filter_rows(good, to["filter"]) if to.get("filter") else good
        df = etl.map_fields(df, to["mapping"], job.constants) if to.get("mapping") else df
        out.append((df, to["path"], to.get("kind", job.kind), to.get("mode", job.mode)))
    return out


def run(spark: SparkSession, job: Job, rejects_to: str | None = None, state: str | None = None, run_id: str | None = None) -> Summary:
    """Load a job's rows into all its destinations or into none.

    1. What leaves each step is counted; what a step splits into rows and rejects is kept on the executors' disks, so the sources are
       read once. Rows and rejects are written to the run's folder.
    2. A job whose rejects reach max_errors fails: its rejects are published, its rows are not.
    3. Each destination's rows are written beside it, where nothing reads them. If one fails, all are
       deleted and the error is raised.
    4. A manifest is written, whole or not at all. From then on the run is committed.
    5. The files are moved into their destinations, a marker for each destination that is done.

    With a ``state`` folder and a ``run_id``, a run that was stopped goes on where it was: before 4 from what is written, after it with the
    destinations that have no marker. A run that is done is not run again. Without them a run has a folder of its own, deleted at its end.
    """
    store, own = Store(spark), state is None or run_id is None
    run_id = run_id or uuid.uuid4().hex
    first = job.destinations[0] if job.destinations else None
    base = state or (first if isinstance(first, str) else first["path"] if first else rejects_to)
    at = f"{state}/{run_id}" if state else _beside(base, f"{run_id}-run") if base else None
    if not at:  # a dry run or a count
        good, dead = plan(spark, job)
        return _summary(good.count(), dead.count(), job, {})
    manifest = store.get(f"{at}/manifest.json")
    if manifest is None:
        try:
            manifest = _commit(spark, store, job, at, run_id, rejects_to)
        except BaseException:
            for path in [to[1] for to in fan_out(None, job)] + [rejects_to] * bool(rejects_to):
                store.delete(_beside(path, run_id))
            if own:
                store.delete(at)
            raise
    for k, to in enumerate(manifest["destinations"]):
        if not store.exists(f"{at}/done-{k}"):
            _publish(store, to)
            store.put(f"{at}/done-{k}", to["rows"])
    if own:
        store.delete(at)
    s = manifest["summary"]
    return Summary(s["loaded"], s["rejected"], s["failed"], s["steps"], s["rate"])


def _commit(spark: SparkSession, store: Store, job: Job, at: str, run_id: str, rejects_to: str | None) -> dict:
    """Everything up to the manifest."""
    staged = store.get(f"{at}/staged.json")
    if staged is None:
        staged = _staged(spark, job, at)
        store.put(f"{at}/staged.json", staged)
    good, dead = spark.read.parquet(f"{at}/good"), spark.read.schema(etl.REJECT).parquet(f"{at}/dead")
    summary = _summary(staged["good"], staged["dead"], job, staged["steps"])
    tos, out = [], []
    if rejects_to:
        letters = dead if job.letters is None else etl.dead_letters(dead, **job.letters)
        tos.append((letters, rejects_to, "parquet", "append"))
    if not summary.failed and not job.dry_run:
        tos += fan_out(good, job)
    for df, path, kind, mode in tos:
        beside = _beside(path, run_id)
        store.delete(beside)  # of an earlier start
        out.append({"path": path, "beside": beside, "mode": mode, "rows": _counted(df, lambda df, to=(beside, kind): write_file(df, *to))})
    if out[bool(rejects_to) :]:
        summary.loaded = sum(x["rows"] for x in out[bool(rejects_to) :])
    manifest = {"run": run_id, "destinations": out, "summary": asdict(summary)}
    store.put(f"{at}/manifest.json", manifest)
    return manifest


def _staged(spark: SparkSession, job: Job, at: str) -> dict:
    """Write rows and rejects to the run's folder; rows that left each step."""
    seen: dict[str, Observation] = {}
    kept: list[DataFrame] = []

    def after(step: str, df: DataFrame, splits: bool) -> DataFrame:
        seen[step] = Observation()
        df = df.observe(seen[step], F.count(F.lit(1)).alias("n"))
        if splits:
            df = df.persist(StorageLevel.DISK_ONLY)
            kept.append(df)
        return df

    good, dead = plan(spark, job, after)
    try:
        n = _counted(good, lambda df: df.write.mode("overwrite").parquet(f"{at}/good"))
        lost = _counted(dead, lambda df: df.write.mode("overwrite").parquet(f"{at}/dead"))
    finally:
        for df in kept:
            df.unpersist()
    return {"good": n, "dead": lost, "steps": {step: o.get["n"] for step, o in seen.items()}}


def _publish(store: Store, to: dict) -> None:
    """Move a destination's files to their place. May be begun again at any point: what was moved stays."""
    path, beside = to["path"], to["beside"]
    names = [n for n in store.names(beside) if not n.startswith(("_", "."))]
    old = f"{beside}-old"
    if to["mode"] == "overwrite" and not store.exists(f"{old}/_moved"):
        store.make(old)
        for n in store.names(path):
            store.rename(f"{path}/{n}", f"{old}/{n}")
        store.put(f"{old}/_moved", True)
    store.make(path)
    for n in names:
        if not store.rename(f"{beside}/{n}", f"{path}/{n}"):
            raise EngineError(EXECUTION, f"{path} takes no file {n}")
    store.delete(beside)
    store.delete(old)


def _beside(path: str, run_id: str) -> str:
    """A folder on a destination's file system that readers of its parent leave out."""
    head, _, last = path.rstrip("/").rpartition("/")
    return f"{head}/_{last}-{run_id}" if head else f"_{last}-{run_id}"


def _summary(good: int, dead: int, job: Job, steps: dict[str, int]) -> Summary:
    failed = dead >= job.max_errors > 0
    return Summary(0 if failed else good, dead, failed, steps, round(100.0 * dead / (good + dead), 6) if good + dead else 0.0)


def status(spark: SparkSession, state: str) -> DataFrame:
    """run, phase (started, staged, committed, done), destinations, published, rows, rejected of each run in a state folder."""
    store, rows = Store(spark), []
    for run_id in store.names(state):
        at = f"{state}/{run_id}"
        found, staged = store.get(f"{at}/manifest.json"), store.get(f"{at}/staged.json")
        done = sum(n.startswith("done-") for n in store.names(at))
        of = len(found["destinations"]) if found else 0
        phase = "staged" if staged and not found else "started" if not found else "done" if done == of else "committed"
        rows.append((run_id, phase, of, done, found["summary"]["loaded"] if found else None, staged["dead"] if staged else None))
    return spark.createDataFrame(rows, "run string, phase string, destinations int, published int, rows long, rejected long")


def _counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Rows that a write takes, counted by the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def layers(needs: dict[str, list[str]]) -> list[list[str]]:
    """Jobs in layers, each after what it needs; sorted within a layer. A missing or circular need is an error."""
    missing = {d for some in needs.values() for d in some} - set(needs)
    if missing:
        raise EngineError(INPUT, f"needed but not there: {sorted(missing)}")
    order = TopologicalSorter(needs)
    try:
        order.prepare()
    except CycleError as e:
        raise EngineError(INPUT, f"circular: {e.args[1]}") from e
    out = []
    while order.is_active():
        ready = sorted(order.get_ready())
        out.append(ready)
        order.done(*ready)
    return out
