"""Readers for semi-structured values held as VARIANT (hub card data).

VARIANT casts coerce (a list read as STRING gives its JSON text), so every reader looks
at the value's own type first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelbom.functions.text import (
    col, dataset_ref_tag, normalize_strings, nz, trim, trim_nz,
)

METRICS_TYPE = "array<struct<type:string,value:string>>"
CONFIGS_TYPE = "array<struct<name:string,data_files:array<struct<split:string,path:string>>>>"


def card_variant(json_text) -> Column:
    """Card data JSON text -> VARIANT (NULL when it does not parse)."""
    return F.try_parse_json(col(json_text))


def at(v: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(col(v), path, type_)


def kind(v: Column) -> Column:
    """STRING, VOID, ARRAY<...>, OBJECT<...>, BIGINT, ... or NULL when absent."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY<"), F.lit(False))


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def string_only(v: Column) -> Column:
    """The text of a string value; NULL for any other type."""
    return F.when(is_string(v), as_string(v))


def string_from_any(v: Column) -> Column:
    """Any value as text; NULL and absent give ''."""
    return F.coalesce(as_string(v), F.lit(""))


def strings_in(v: Column) -> Column:
    """A string as one-element list, a list as its string members; NULL for other types."""
    members = F.transform(F.filter(as_list(v), is_string), as_string)
    return F.when(is_string(v), F.array(as_string(v))).when(is_list(v), members)


def string_slice_from_any(v: Column) -> Column:
    """A list as normalised text list, a scalar as one-element list; NULL when empty."""
    listed = normalize_strings(F.transform(as_list(v), string_from_any))
    single = F.array_compact(F.array(trim_nz(as_string(v))))
    out = F.when(is_list(v), listed).otherwise(single)
    return F.when(F.size(out) > 0, out)


def gated_value(json_text) -> Column:
    """Bool-or-string union as trimmed text: false -> 'false', "auto" -> 'auto'."""
    v = F.try_parse_json(col(json_text))
    k = kind(v)
    return F.when(k == "STRING", trim(as_string(v))).when(k == "BOOLEAN", as_string(v))


def first_tag_value(tags, prefix: str) -> Column:
    """Rest of the first tag with the prefix, trimmed."""
    found = F.filter(F.transform(col(tags), trim), lambda t: t.startswith(prefix))
    return trim_nz(F.substring(F.get(found, F.lit(0)), len(prefix) + 1, 1 << 30))


def extract_license(card, tags) -> Column:
    return F.coalesce(
        trim_nz(string_only(at(card, "$.license"))), first_tag_value(tags, "license:")
    )


def extract_language(card) -> Column:
    v = at(card, "$.language")
    joined = F.array_join(F.array_compact(F.transform(strings_in(v), trim_nz)), ",")
    return F.when(is_string(v), trim_nz(as_string(v))).when(is_list(v), nz(joined))


def extract_datasets(card, tags) -> Column:
    """Dataset references of card data, then of tags; distinct, order kept."""
    empty = F.array().cast("array<string>")
    tagged = F.filter(
        F.transform(F.coalesce(col(tags), empty), trim), lambda t: t.startswith("dataset:")
    )
    both = F.concat(F.coalesce(strings_in(at(card, "$.datasets")), empty), tagged)
    return F.array_distinct(F.array_compact(F.transform(both, dataset_ref_tag)))


def dataset_ids(card, readme_datasets) -> Column:
    """Plain dataset ids of card data, then of the card text; distinct, order kept."""
    empty = F.array().cast("array<string>")
    return normalize_strings(
        F.concat(
            F.coalesce(strings_in(at(card, "$.datasets")), empty),
            F.coalesce(col(readme_datasets), empty),
        )
    )


def parse_model_index(v: Column) -> Column:
    """First result of the first entry: struct(task_type, task_name, metrics)."""
    result = F.when(is_list(v) & is_list(at(v, "$[0].results")), at(v, "$[0].results[0]"))
    metrics = at(result, "$.metrics")
    pairs = F.transform(
        F.filter(as_list(metrics), lambda m: F.coalesce(kind(m).startswith("OBJECT<"), F.lit(False))),
        lambda m: F.struct(
            trim(string_from_any(at(m, "$.type"))).alias("type"),
            trim(string_from_any(at(m, "$.value"))).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["type"] != "") | (p["value"] != ""))
    return F.struct(
        trim_nz(string_from_any(at(result, "$.task.type"))).alias("task_type"),
        trim_nz(string_from_any(at(result, "$.task.name"))).alias("task_name"),
        F.when(F.size(kept) > 0, kept).cast(METRICS_TYPE).alias("metrics"),
    )


def parse_dataset_configs(v: Column) -> Column:
    """Configuration names with their (split, path) files; blank ones dropped."""

    def is_object(x):
        return F.coalesce(kind(x).startswith("OBJECT<"), F.lit(False))

    def files(cfg):
        listed = F.filter(as_list(at(cfg, "$.data_files")), is_object)
        pairs = F.transform(
            F.coalesce(listed, F.array().cast("array<variant>")),
            lambda d: F.struct(
                trim(string_from_any(at(d, "$.split"))).alias("split"),
                trim(string_from_any(at(d, "$.path"))).alias("path"),
            ),
        )
        return F.filter(pairs, lambda p: (p["split"] != "") | (p["path"] != ""))

    configs = F.transform(
        F.filter(as_list(v), is_object),
        lambda c: F.struct(
            trim(string_from_any(at(c, "$.config_name"))).alias("name"),
            files(c).alias("data_files"),
        ),
    )
    kept = F.filter(configs, lambda c: (c["name"] != "") | (F.size(c["data_files"]) > 0))
    return F.when(F.size(kept) > 0, kept).cast(CONFIGS_TYPE)
