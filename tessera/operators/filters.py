"""Predicates as Columns, tenant scoping, key upserts and deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetadataFilter:
    """A conjunction of optional conditions; dates are inclusive, a missing source passes ``source_not_in``."""

    created_after: str | None = None
    created_before: str | None = None
    source_in: tuple = ()
    source_not_in: tuple = ()
    kind_in: tuple = ()
    tags: tuple = ()
    namespace: str | None = None

    def __post_init__(self):
        if self.created_after and self.created_before and self.created_after > self.created_before:
            raise ValueError("created_after lies behind created_before")
        if set(self.source_in) & set(self.source_not_in):
            raise ValueError("a source is both wanted and unwanted")

    def column(self, created="created_at", source="source", kind="doc_type", tags="tags", namespace="namespace_id") -> Column:
        out = F.lit(True)
        if self.created_after:
            out = out & (F.col(created) >= F.lit(self.created_after).cast("timestamp"))
        if self.created_before:
            out = out & (F.col(created) <= F.lit(self.created_before).cast("timestamp"))
        if self.source_in:
            out = out & F.col(source).isin(*self.source_in)
        if self.source_not_in:
            out = out & ~F.coalesce(F.col(source).isin(*self.source_not_in), F.lit(False))
        if self.kind_in:
            out = out & F.col(kind).isin(*self.kind_in)
        for tag in self.tags:
            out = out & F.array_contains(tags, tag)
        if self.namespace:
            out = out & (F.col(namespace) == self.namespace)
        return out

    def selectivity(self) -> float:
        """A rough share of the rows that pass, for logs; Catalyst plans by statistics."""
        share = 0.5 if self.created_after or self.created_before else 1.0
        for wanted, each in ((self.source_in, 0.3), (self.kind_in, 0.4)):
            share *= min(1.0, each * len(wanted)) if wanted else 1.0
        return max(0.01, share * 0.6 ** len(self.tags))


def scoped(rows: DataFrame, namespaces: list[str], column: str = "namespace_id", default: str | None = None) -> DataFrame:
    """Rows of the allowed namespaces only; none for an empty list; rows without one are ``default``'s."""
    if column not in rows.columns:
        raise ValueError(f"{column} is missing: rows without a namespace can't be scoped")
    own = F.coalesce(F.col(column), F.lit(default)) if default is not None else F.col(column)
    return rows.filter(own.isin(*namespaces)) if namespaces else rows.filter(F.lit(False))


def is_write(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)\b(create|merge|delete|set|remove)\b"))


def consent_status(withdrawn: Column, expires: Column, now: Column) -> Column:
    return F.when(withdrawn, "withdrawn").when(expires < now, "expired").otherwise("granted")


def access_decision(admin: Column, denied: Column, allowed: Column, limited: Column) -> Column:
    return F.when(admin, "admin").when(denied, "denied").when(allowed, "allowed").when(limited, "rate_limited").otherwise("default")


def namespace_kind(name: Column, prefixes: dict[str, str], general: tuple[str, ...] = ("default", "general")) -> Column:
    out = F.when(name.isin(*general), "general")
    for prefix, kind in prefixes.items():
        out = out.when(name.startswith(prefix), kind)
    return out.otherwise("custom")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay: those for which the condition isn't true."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def active_domains(asked: DataFrame, profiles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(profile, domain) of asked profiles (profile): their list in ``profiles`` (profile, domains), or all of ``catalogue`` (domain).

    All domains are active for a profile that is not known or whose list is ``ALL``; an empty list has none.
    """
    known = asked.select("profile").distinct().join(profiles.select("profile", "domains", F.lit(True).alias("_known")), "profile", "left")
    every = known.filter(F.col("_known").isNull() | F.array_contains("domains", "ALL")).select("profile")
    listed = known.filter(F.col("_known") & ~F.coalesce(F.array_contains("domains", "ALL"), F.lit(False)))
    rows = listed.select("profile", F.explode("domains").alias("domain"))
    # as many rows as that have to come out
    return rows.unionByName(every.crossJoin(catalogue.select("domain").filter("domain IS NOT NULL").distinct())).distinct()
