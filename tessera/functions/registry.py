"""Column functions by name, with described parameters, so that a table of calls can be applied and exported."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: JSON-schema names of the types that parameters may have.
TYPES = ("string", "integer", "number", "boolean", "array")


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable[..., Column]
    description: str
    parameters: dict[str, str]
    required: tuple[str, ...]


class Registry:
    """Functions by name. A parameter is ``type`` or, where it may be left out, ``type?``."""

    def __init__(self):
        self._functions: dict[str, Function] = {}

    def register(self, name: str, description: str, **parameters: str):
        kinds = {p: kind.rstrip("?") for p, kind in parameters.items()}
        if unknown := set(kinds.values()) - set(TYPES):
            raise ValueError(f"unknown types {sorted(unknown)}")

        def keep(build: Callable[..., Column]) -> Callable[..., Column]:
            if name in self._functions:
                raise ValueError(f"{name} is registered already")
            required = tuple(p for p, kind in parameters.items() if not kind.endswith("?"))
            self._functions[name] = Function(name, build, description, kinds, required)
            return build

        return keep

    def unregister(self, name: str) -> bool:
        return self._functions.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._functions)

    def call(self, name: str, **arguments) -> Column:
        """A function's column; strings are column names, other values literals, columns stay."""
        if name not in self._functions:
            raise KeyError(f"no function {name}: {self.names()}")
        function = self._functions[name]
        if missing := set(function.required) - set(arguments):
            raise ValueError(f"{name} lacks {sorted(missing)}")
        if unknown := set(arguments) - set(function.parameters):
            raise ValueError(f"{name} has no {sorted(unknown)}")
        as_column = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)
        return function.build(**{k: as_column(v) for k, v in arguments.items()})

    def applied(self, rows: DataFrame, **calls: tuple[str, dict]) -> DataFrame:
        """``rows`` with a column for each call (function, arguments), all in one projection."""
        return rows.withColumns({out: self.call(name, **arguments) for out, (name, arguments) in calls.items()})

    def schema(self, spark: SparkSession) -> DataFrame:
        """(name, description, parameters): the parameters as a JSON schema of an object."""
        def parameters(f: Function) -> str:
            return json.dumps({"type": "object", "properties": {p: {"type": kind} for p, kind in f.parameters.items()}, "required": list(f.required)})

        rows = [(f.name, f.description, parameters(f)) for f in sorted(self._functions.values(), key=lambda f: f.name)]
        return spark.createDataFrame(rows, "name string, description string, parameters string")


TEXT = Registry()


@TEXT.register("token_estimate", "Tokens of a text, a token for each four characters begun", text="string", per="integer?")
def token_estimate(text: Column, per: Column | None = None) -> Column:
    return F.ceil(F.length(text) / (F.lit(4) if per is None else per)).cast("long")


@TEXT.register("beginning", "The first characters of a text", text="string", chars="integer")
def beginning(text: Column, chars: Column) -> Column:
    return F.substring(text, F.lit(1), chars)


@TEXT.register("word_count", "Words between white space", text="string")
def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
