"""Where the columns of a query come from, read out of the plan that Catalyst has analysed.

Names in a text say little: aliases, stars, subqueries, common table expressions
and views hide them. The analysed plan knows for every attribute the relation that
made it. Lineage follows attributes from the relations up: what an alias is computed
from, the branches of a set operation, the definition behind a reference to a
common table expression, the plans within subqueries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Base = frozenset[tuple[str, str]]


@dataclass
class Lineage:
    """tables: every relation read; columns: per output column the (table, column) that its value is made of; used: those read anywhere."""

    tables: set[str] = field(default_factory=set)
    columns: list[tuple[str, Base]] = field(default_factory=list)
    used: set[tuple[str, str]] = field(default_factory=set)


def _items(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _subquery(e) -> bool:
    """Whether an expression holds a plan."""
    return e.getClass().getClassLoader().loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(e)


def table_name(node) -> str | None:
    """The name of a relation that stands at a leaf or of a view; None for other nodes."""
    kind = _kind(node)
    if kind == "View":
        return node.desc().identifier().unquotedString()
    if kind == "LogicalRelation" and node.catalogTable().isDefined():
        return node.catalogTable().get().identifier().unquotedString()
    if kind == "HiveTableRelation":
        return node.tableMeta().identifier().unquotedString()
    if kind == "DataSourceV2Relation" and node.identifier().isDefined():
        return ".".join([*node.identifier().get().namespace(), node.identifier().get().name()])
    return None


class _Walk:
    def __init__(self, known: Callable[[str], str | None]):
        self.known, self.found = known, Lineage()
        self.definitions: dict[int, list[Base]] = {}
        self.outer: dict[int, Base] = {}

    def plan(self, node) -> dict[int, Base]:
        """The bases of a node's output attributes, by expression id."""
        kind, name = _kind(node), table_name(node)
        mine = [(a.exprId().id(), a.name()) for a in _items(node.output())]
        if kind == "WithCTE":
            for d in _items(node.cteDefs()):
                self.definitions[d.id()] = self.positions(d.child())
            return self.plan(node.plan())
        if kind == "CTERelationRef":
            return {i: b for (i, _), b in zip(mine, self.definitions.get(node.cteId(), []))}
        below: dict[int, Base] = {}
        sides = [self.positions(c, below) for c in _items(node.children())]
        label = self.known(name) if name else None
        if label:  # a view has what it reads and its own columns
            self.found.tables.add(label)
            return {i: below.get(i, frozenset()) | {(label, n)} for i, n in mine}
        if not sides:
            return {}
        if len(sides) > 1 and kind in ("Union", "Intersect", "Except", "UnionLoop"):
            return {i: frozenset().union(*(side[k] for side in sides)) for k, (i, _) in enumerate(mine)}
        made: dict[int, Base] = {}
        if kind == "Expand":  # grouping sets and UNPIVOT: a column of each projection
            rows = [[self.expression(e, below, made) for e in _items(p)] for p in _items(node.projections())]
            return {i: frozenset().union(*(r[k] for r in rows)) for k, (i, _) in enumerate(mine)}
        rest: Base = frozenset()
        for e in _items(node.expressions()):
            rest |= self.expression(e, below, made)
        return {i: made[i] if i in made else below.get(i, rest) for i, _ in mine}

    def positions(self, node, into: dict[int, Base] | None = None) -> list[Base]:
        """The bases of a node's output by position; by id as well in ``into``."""
        got = self.plan(node)
        if into is not None:
            into |= got
        return [got.get(a.exprId().id(), frozenset()) for a in _items(node.output())]

    def expression(self, e, below: dict[int, Base], made: dict[int, Base]) -> Base:
        """What an expression is made of; aliases in it are noted."""
        kind = _kind(e)
        if kind == "AttributeReference":
            i = e.exprId().id()
            found = below.get(i) or self.outer.get(i, frozenset())
            self.found.used |= found
            return found
        out: Base = frozenset()
        if _subquery(e):
            before, self.outer = self.outer, self.outer | below
            inner = frozenset().union(*self.positions(e.plan()))
            self.outer = before
            out = inner if kind != "Exists" else out
        for c in _items(e.children()):
            out |= self.expression(c, below, made)
        if kind == "Alias":
            made[e.exprId().id()] = out
        return out


def lineage(df: DataFrame, known: Callable[[str], str | None]) -> Lineage:
    """The lineage of a DataFrame. known: from a relation's name to the label it is ruled under, None for one without rules."""
    walk = _Walk(known)
    plan = df._jdf.queryExecution().analyzed()
    bases = walk.plan(plan)
    walk.found.columns = [(a.name(), bases.get(a.exprId().id(), frozenset())) for a in _items(plan.output())]
    for _, b in walk.found.columns:
        walk.found.used |= b
    return walk.found


@dataclass
class Mentioned:
    """What a statement's text names, as Spark's parser finds it: relations with their places in the text (last one included), the last parts of columns, and whether a
    star or an INSERT without columns stands for columns that it does not name."""

    relations: set[tuple[str, int, int]] = field(default_factory=set)
    columns: set[str] = field(default_factory=set)
    open: bool = False


def mentioned(spark: SparkSession, text: str) -> Mentioned:
    """The names in a statement; those of common table expressions are left out of its relations."""
    out, inner = Mentioned(), set()

    def walk(node) -> None:
        kind = _kind(node)
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                inner.add(pair.productElement(0).lower())
                walk(pair.productElement(1))
        if kind in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedIdentifier", "UnresolvedTableOrView"):
            at = node.origin()
            parts = _items(node.nameParts() if kind == "UnresolvedIdentifier" else node.multipartIdentifier())
            out.relations.add((".".join(parts), at.startIndex().get(), at.stopIndex().get()))
        if kind == "InsertIntoStatement":
            named = _items(node.userSpecifiedCols())
            out.columns.update(x.lower() for x in named)
            out.open |= not named
            walk(node.table())
        for c in _items(node.children()):
            walk(c)
        for e in _items(node.expressions()):
            expression(e)

    def expression(e) -> None:
        kind = _kind(e)
        if kind == "UnresolvedAttribute":
            out.columns.add(_items(e.nameParts())[-1].lower())
        out.open |= kind in ("UnresolvedStar", "UpdateStarAction", "InsertStarAction")
        if _subquery(e):
            walk(e.plan())
        for c in _items(e.children()):
            expression(c)

    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)  # the parser takes its settings from there
    try:
        walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    finally:
        sessions.setActiveSession(before.get()) if before.isDefined() else sessions.clearActiveSession()
    out.relations = {r for r in out.relations if r[0].lower() not in inner}
    return out
