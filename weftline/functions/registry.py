"""User functions by name: SQL expressions, pandas functions over columns, aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import REGISTRY, EngineError


class FunctionRegistry:
    """Names are upper-cased. A frozen registry takes no changes; a taken name needs ``override``.

    An expression (``register_expression``) is inlined by Catalyst and costs no
    Python; ``register`` takes a pandas function over series and
    ``register_aggregate`` one from series to a value.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.frozen = spark, False
        self.names: dict[str, str] = {}

    def _take(self, name: str, kind: str, override: bool) -> str:
        key = name.upper()
        if not key.isidentifier():
            raise EngineError(REGISTRY, f"{name!r} is no function name")
        if self.frozen:
            raise EngineError(REGISTRY, "the registry is frozen")
        if key in self.names and not override:
            raise EngineError(REGISTRY, f"{key} is registered already")
        self.names[key] = kind
        return key

    def register_expression(self, name: str, parameters: str, returns: str, body: str, override: bool = False) -> None:
        """A SQL function: its parameters ("x INT, y INT"), return type and body."""
        key = self._take(name, "expression", override)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {key}({parameters}) RETURNS {returns} RETURN {body}")

    def register(self, name: str, f: Callable, returns: str, override: bool = False) -> Callable[..., Column]:
        """A pandas function from series to a series of the type."""
        return self.spark.udf.register(self._take(name, "scalar", override), F.pandas_udf(f, returns))

    def register_aggregate(self, name: str, f: Callable, returns: str, override: bool = False) -> Callable[..., Column]:
        """A pandas function from series (hinted pd.Series -> value) to one value."""
        return self.spark.udf.register(self._take(name, "aggregate", override), F.pandas_udf(f, returns))

    def unregister(self, name: str) -> None:
        if self.frozen:
            raise EngineError(REGISTRY, "the registry is frozen")
        if self.names.pop(name.upper(), None):
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name.upper()}")

    def freeze(self) -> None:
        self.frozen = True

    def unfreeze(self) -> None:
        self.frozen = False

    def lookup(self, name: str) -> str | None:
        """The kind of a registered function, or null."""
        return self.names.get(name.upper())
