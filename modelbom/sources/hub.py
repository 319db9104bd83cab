"""Landed hub responses: model and dataset metadata, security listings, card texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelbom import schemas as sc
from modelbom.functions.semistructured import card_variant

# Response field -> table column.
RENAMED = {
    "modelId": "model_id", "lastModified": "last_modified", "createdAt": "created_at",
    "usedStorage": "used_storage",
}


def _renamed(df: DataFrame) -> DataFrame:
    out = df
    for old, new in RENAMED.items():
        if old in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def read_hub_models(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of model responses; card data as VARIANT, the bool-or-string ``gated`` as text."""
    return decoded_models(spark.read.schema(sc.HUB_MODEL).json(path))


def decoded_models(raw: DataFrame) -> DataFrame:
    rows = _renamed(raw)
    return rows.select(
        *[c for c in rows.columns if c not in ("cardData", "config", "gated")],
        F.trim("gated").alias("gated"),
        card_variant("cardData").alias("card_data"),
        F.col("config.model_type").alias("model_type"),
        F.col("config.architectures").alias("architectures"),
    )


def read_hub_datasets(spark: SparkSession, path: str) -> DataFrame:
    return decoded_datasets(spark.read.schema(sc.HUB_DATASET).json(path))


def decoded_datasets(raw: DataFrame) -> DataFrame:
    rows = _renamed(raw)
    return rows.select(
        *[c for c in rows.columns if c not in ("cardData", "gated")],
        F.trim("gated").alias("gated"),
        card_variant("cardData").alias("card_data"),
    )


TREE_ROW = f"repo_id string, page int, {sc.SECURITY_ENTRY}"


def read_security_tree(spark: SparkSession, path: str, kind: str = "model") -> DataFrame:
    """JSON lines of listing entries with ``repo_id`` and landed ``page`` number."""
    return listed_entries(spark.read.schema(TREE_ROW).json(path), kind)


def listed_entries(raw: DataFrame, kind: str = "model") -> DataFrame:
    return raw.withColumn("kind", F.lit(kind))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (id, raw) of card texts."""
    return spark.read.schema("id string, raw string").json(path)
