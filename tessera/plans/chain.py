"""A small chain builder: named steps that compose DataFrame transformations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps that a serialised chain may name.
STEPS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "filter": lambda condition: lambda df: df.filter(F.expr(condition)),
    "select": lambda columns: lambda df: df.select(*columns),
    "compute": lambda name, expression: lambda df: df.withColumn(name, F.expr(expression)),
    "top": lambda by, k: lambda df: df.orderBy(F.desc(by), *[c for c in df.columns if c != by]).limit(k),
    "count": lambda keys: lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")),
    "distinct": lambda keys: lambda df: df.dropDuplicates(list(keys)),
}


@dataclass
class Chain:
    steps: list[tuple[str, str, dict]] = field(default_factory=list)

    def step(self, name: str, kind: str, **arguments) -> Chain:
        if kind not in STEPS:
            raise ValueError(f"unknown step {kind}")
        if any(name == n for n, _, _ in self.steps):
            raise ValueError(f"step {name} is named twice")
        return Chain([*self.steps, (name, kind, arguments)])

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.steps:
            raise ValueError("the chain is empty")
        for _, kind, arguments in self.steps:
            df = df.transform(STEPS[kind](**arguments))
        return df

    def to_json(self) -> str:
        return json.dumps([{"name": n, "kind": k, "arguments": a} for n, k, a in self.steps])

    @classmethod
    def from_json(cls, text: str) -> Chain:
        out = cls()
        for step in json.loads(text):
            out = out.step(step["name"], step["kind"], **step["arguments"])
        return out
