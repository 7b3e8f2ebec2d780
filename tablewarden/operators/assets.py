"""Tables made by functions of other tables: functions name their inputs, and a target's DataFrame is composed of them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewarden.operators.quality import Check, validate


class Assets:
    """A set of asset functions. ``@assets.asset()`` takes a function of DataFrames to a DataFrame: its parameters are
    the names of its upstream assets, unless ``inputs`` maps parameters to other names."""

    def __init__(self):
        self.functions: dict[str, Callable[..., DataFrame]] = {}
        self.inputs: dict[str, dict[str, str]] = {}
        self.checks: dict[str, tuple[Check, ...]] = {}

    def asset(self, name: str | None = None, inputs: dict[str, str] | None = None, checks: tuple[Check, ...] = ()):
        def register(function: Callable[..., DataFrame]):
            own = name or function.__name__
            if own in self.functions:
                raise ValueError(f"asset {own} is declared twice")
            unknown = set(inputs or {}) - set(inspect.signature(function).parameters)
            if unknown:
                raise ValueError(f"{own} has no parameters {sorted(unknown)}")
            self.functions[own], self.checks[own] = function, checks
            self.inputs[own] = {p: (inputs or {}).get(p, p) for p in inspect.signature(function).parameters}
            return function

        return register

    def compute(self, target: str, sources: dict[str, DataFrame], check: bool = True) -> DataFrame:
        """The target's DataFrame over the ``sources``; each asset on the way is composed once. Blocking checks of an
        asset run before what depends on it is composed."""
        made, path = dict(sources), []

        def make(name: str) -> DataFrame:
            if name in made:
                return made[name]
            if name not in self.functions:
                raise KeyError(f"no asset or source named {name}")
            if name in path:
                raise ValueError("assets depend on each other: " + " > ".join([*path[path.index(name) :], name]))
            path.append(name)
            out = self.functions[name](**{p: make(up) for p, up in self.inputs[name].items()})
            made[path.pop()] = validate(out, list(self.checks[name])) if check and self.checks[name] else out
            return made[name]

        return make(target)

    def edges(self, spark: SparkSession) -> DataFrame:
        """(src, dst) of the declared inputs, for the lineage questions."""
        return spark.createDataFrame([(up, name) for name, ups in self.inputs.items() for up in ups.values()], "src string, dst string")
