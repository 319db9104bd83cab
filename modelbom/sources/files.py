"""Source trees and settings files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelbom.functions.cards import _scalar, yaml_key_positions
from modelbom.functions.text import nz
from modelbom.operators.extract import source_files


def _decoded(path: Column) -> Column:
    """File paths arrive URL-encoded, with '+' as itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` as (path, content); the path is relative to the root."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    full = _decoded(F.col("_metadata.file_path"))
    base = root.rstrip("/") + "/"
    bare = base.split("://", 1)[1] if "://" in base else base
    if bare.startswith("/"):
        relative = F.substring(full, F.instr(full, bare) + len(bare), F.length(full))
    else:
        relative = F.substring(full, F.instr(full, "/" + bare) + len(bare) + 1, F.length(full))
    return raw.select(relative.alias("path"), F.col("value").alias("content"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files worth scanning as (path, content, class). The path filters reach the file listing,
    so skipped directories and unknown classes are not opened."""
    return source_files(read_tree(spark, root))


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Flat settings file (full key: value, or key with ``- item`` lines) -> (key, value)."""
    texts = spark.read.text(path, wholetext=True)
    return settings_rows(texts.withColumnRenamed("value", "text")).select("key", "value")


def settings_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """Settings texts -> (other columns, key, value).

    Keys come out lower-cased. A list becomes its items between brackets.
    """
    keep = [c for c in texts.columns if c != text]
    lines = texts.select(
        *keep, F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n").alias("lines")
    )
    keyed = lines.select("*", yaml_key_positions("lines").alias("keys"))
    blocks = F.transform(
        "keys",
        lambda k, i: F.struct(
            k["line"].alias("line"),
            F.slice(
                F.col("lines"),
                k["pos"] + 1,
                F.coalesce(F.get(F.col("keys"), i + 1)["pos"], F.size("lines") + 1) - k["pos"] - 1,
            ).alias("inner"),
        ),
    )
    rows = keyed.select(*keep, F.inline(blocks))
    key = F.regexp_extract("line", r"\A[\"']?([^\n]*?)[\"']?[ \t]*:(?:[ \t]|\z)", 1)
    head = F.regexp_replace("line", r"\A[^\n]*?:(?:[ \t]|\z)", "")
    item = r"\A[ \t]*-(?:[ \t]|\z)"
    items = F.transform(
        F.filter("inner", lambda l: l.rlike(item)),
        lambda l: F.coalesce(_scalar(F.regexp_replace(l, item, "")), F.lit("<nil>")),
    )
    listed = F.when(F.size(items) > 0, F.concat(F.lit("["), F.array_join(items, " "), F.lit("]")))
    return rows.select(
        *keep, F.lower(key).alias("key"), F.coalesce(nz(_scalar(head)), listed).alias("value")
    ).where("value is not null")
