"""Extraction of entities and relations as a table function for SQL's ``LATERAL``.

An extractor is a function of a text that gives (kind, name, target, start) rows: kind
``entity`` or ``relation``, a target for relations only. ``table_function`` makes a table
function of several named ones; where one fails, its text has no rows of it but one
``error`` row, and the others' rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

Row = tuple[str, str, str | None, int]
Extractor = Callable[[str], Iterable[Row]]

_NAME = re.compile(r"[A-Z][a-z]{3,}")
_SENTENCE = re.compile(r"[^.!?\n]+")
KINDS = ("all", "entity", "relation")


def capitalised_words(text: str) -> Iterable[Row]:
    """Entities: capitalised ASCII words of four letters or more, at each place; relations: neighbours in a sentence."""
    for part in _SENTENCE.finditer(text):
        last = None
        for m in _NAME.finditer(text, part.start(), part.end()):
            yield "entity", m.group(), None, m.start()
            if last and last != m.group():
                yield "relation", last, m.group(), m.start()
            last = m.group()


def _columns() -> StructType:
    out = StructType().add("model", StringType()).add("kind", StringType()).add("name", StringType())
    return out.add("target", StringType()).add("start", IntegerType()).add("error", StringType())


def table_function(extractors: dict[str, Extractor]):
    """A table function of a text and, if given, a constant kind (``entity`` or ``relation``) that narrows its rows and columns."""

    class Extract:
        @staticmethod
        def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError("the first argument is a text")
            wanted = "all" if kind is None else kind.value
            if wanted not in KINDS:
                raise ValueError(f"the second argument is a constant of {KINDS}")
            names = [f for f in _columns().fields if wanted != "entity" or f.name != "target"]
            return AnalyzeResult(schema=StructType(names))

        def eval(self, text: str, kind: str = "all"):
            if not text:
                return
            for model, extract in extractors.items():
                try:
                    rows = [(model, k, name, target, start, None) for k, name, target, start in extract(text) if kind in ("all", k)]
                except Exception as failed:  # an extractor is foreign code
                    rows = [(model, "error", None, None, None, f"{type(failed).__name__}: {failed}"[:200])]
                for row in rows:
                    yield row if kind != "entity" else (*row[:3], *row[4:])

    return udtf(Extract)


def extracted(spark: SparkSession, texts: DataFrame, extractors: dict[str, Extractor], kind: str = "all") -> DataFrame:
    """(id, model, kind, name[, target], start, error) of every text (id, text), by a lateral join with the table function."""
    name = "tessera_extract_" + "_".join(sorted(extractors))
    spark.udtf.register(name, table_function(extractors))
    return spark.sql(f"SELECT t.id, x.* FROM {{texts}} t, LATERAL {name}(t.text, '{kind}') x", texts=texts.select("id", "text"))


def merged_models(rows: DataFrame, least: int = 1) -> DataFrame:
    """(id, name, n_models, n, first): entities that ``least`` extractors found, the names of one text compared in lower case."""
    found = rows.filter("kind = 'entity'").groupBy("id", F.lower("name").alias("key"))
    out = found.agg(F.min_by("name", F.struct("start", "model")).alias("name"), F.count_distinct("model").alias("n_models"), F.count("*").alias("n"), F.min("start").alias("first"))
    return out.filter(F.col("n_models") >= least).drop("key")
