"""Filling missing fields from supplied values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.operators.assemble import apply_user_values
from modelbom.operators.registry import DATASET_REGISTRY, MODEL_REGISTRY, FieldSpec
from modelbom.operators.score import missing_specs, with_model_results, with_results


BUILT_IN = (*MODEL_REGISTRY, *DATASET_REGISTRY)


def known_values(values: DataFrame, registry: Iterable[FieldSpec] = BUILT_IN) -> DataFrame:
    """(key, value) settings cut to the registry's fields: at most one row per field, by lower-cased key.

    Of a key given several times, in whatever spelling, the value that sorts first counts.
    """
    known = [s.key.lower() for s in registry]
    rows = values.select(F.lower("key").alias("key"), "value").where(F.col("key").isin(known))
    return rows.groupBy("key").agg(F.min("value").alias("value"))


def values_map(values: DataFrame, registry: Iterable[FieldSpec] = BUILT_IN) -> DataFrame:
    """One row with a map of the supplied values, as large as the registry at most.

    ``values_map(...).scalar()`` is the column that ``enrich`` takes; it is computed inside the plan.
    """
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return known_values(values, registry).agg(F.map_from_entries(entries).alias("values"))


def enrichment_lookup(missing: DataFrame, values: DataFrame, registry: Iterable[FieldSpec] = BUILT_IN) -> DataFrame:
    """Missing field rows matched to supplied values, case-insensitively by key.

    ``values(key, value)`` is a settings table: at most one row per field of ``registry`` is of use, so
    it is cut to those before it is broadcast.
    """
    small = known_values(values, registry).withColumnRenamed("key", "_key")
    return (
        missing.withColumn("_key", F.lower("key")).join(F.broadcast(small), "_key").drop("_key")
    )


def enrich(
    components: DataFrame,
    values: Column,
    registry: list[FieldSpec] = MODEL_REGISTRY,
    required_only: bool = False,
    min_weight: float = 0.0,
) -> DataFrame:
    """Set the missing fields of component rows that a value is supplied for.

    ``values`` maps lower-cased keys to text (a literal map for one settings file, or a column
    for values per BOM). Scoring, lookup and parsing are one narrow plan.
    """
    rows = components.withColumn("_values", values)
    scored = (
        with_results(rows, registry) if registry is DATASET_REGISTRY else with_model_results(rows, registry)
    )
    missing = F.transform(missing_specs(registry, required_only, min_weight), lambda m: m["key"])
    marked = scored.select(*components.columns, "_values", missing.alias("_missing"))
    return apply_user_values(marked, F.col("_values"), registry, only=F.col("_missing")).drop(
        "_values", "_missing"
    )
