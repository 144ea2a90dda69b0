"""Catalog: list, get, filter, and the writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slateflow import schemas
from slateflow.functions.text import SKILL_DOMAIN


@dataclass(frozen=True)
class SourceFilters:
    domain: str | None = None
    trust: str | None = None
    version: str | None = None
    limit: int | None = None


def is_skill():
    return F.col("domain").eqNullSafe(SKILL_DOMAIN)


def list_sources(sources: DataFrame, include_skills: bool = False) -> DataFrame:
    out = sources if include_skills else sources.where(~is_skill())
    return out.orderBy("source_id")


def get_source(sources: DataFrame, source_id: str) -> DataFrame:
    """One row or none."""
    return sources.where(F.col("source_id") == source_id)


def filter_sources(sources: DataFrame, f: SourceFilters, include_skills: bool = False) -> DataFrame:
    """Rows that meet every given filter, in order of id; the limit comes before skills are hidden, and 0 gives none."""
    out = sources
    if f.domain is not None:
        out = out.where(F.col("domain") == f.domain)
    if f.trust is not None:
        out = out.where(F.col("trust") == f.trust)
    if f.version is not None:
        out = out.where(F.array_contains("supported_versions", f.version))
    out = out.orderBy("source_id")
    if f.limit is not None:
        out = out.limit(f.limit)
    if include_skills or f.domain == SKILL_DOMAIN:
        return out
    return out.where(~is_skill())


class DuplicateValues(ValueError):
    """An upsert repeats a child value."""


def duplicate_values(updates: DataFrame) -> DataFrame:
    """(source_id, child) of updates whose child values repeat."""
    pairs = F.array_compact(F.array(*[F.when(F.size(c) != F.size(F.array_distinct(c)), F.lit(c)) for c in schemas.CHILDREN]))
    return updates.select("source_id", F.explode(pairs).alias("child"))


def _sorted_children(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_sort(F.coalesce(c, F.array().cast("array<string>"))).alias(c) if c in schemas.CHILDREN else F.col(c) for c in schemas.SOURCE.names])


def checked(updates: DataFrame) -> DataFrame:
    """`updates` with sorted child values; raises where a child's values repeat."""
    bad = duplicate_values(updates).limit(20).collect()
    if bad:
        raise DuplicateValues("; ".join(f"{r['source_id']}: repeated value in `{r['child']}`" for r in bad))
    return _sorted_children(updates)


def upsert(sources: DataFrame, updates: DataFrame, check: bool = True) -> DataFrame:
    """`sources` with each update's row in place of the row of its id, all child values replaced."""
    updates = checked(updates) if check else _sorted_children(updates)
    return sources.join(updates.select("source_id"), "source_id", "left_anti").select(*schemas.SOURCE.names).unionByName(updates)


def replace(updates: DataFrame, position: str, check: bool = True) -> DataFrame:
    """A new catalog from rows in order of `position`; a later row of an id wins."""
    if check:
        checked(updates)
    w = Window.partitionBy("source_id").orderBy(F.desc(position))
    return _sorted_children(updates.withColumn("_n", F.row_number().over(w)).where("_n = 1"))


def seed_ignore(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert seeds whose id is not there yet."""
    return sources.unionByName(seeds.join(sources.select("source_id"), "source_id", "left_anti").select(*schemas.SOURCE.names))
