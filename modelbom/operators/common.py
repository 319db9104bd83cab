"""Operators shared by several areas."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelbom.functions.text import trim_nz


def stage(df: DataFrame, prefix: str, cols: dict) -> tuple[DataFrame, dict]:
    """Add computed columns in a projection of their own and give back references to them.

    Later expressions use a value several times; staged, it is planned and computed once.
    """
    named = {k: f"_{prefix}{i}" for i, k in enumerate(cols)}
    staged = df.select("*", *[c.alias(named[k]) for k, c in cols.items()])
    return staged, {k: F.col(n) for k, n in named.items()}


def first_wins(
    df: DataFrame, keys: list[str], order: list[Column | str], blank_key: str | None = None
) -> DataFrame:
    """First row per key in source order. Rows with a blank ``blank_key`` are all kept.

    ``row_number() = 1`` is cut to one row per key on the map side before the shuffle
    (Spark's window group limit), so a hot key moves at most one row per input task. Blank
    keys are spread by the values of the order columns given by name.
    """
    salt = []
    if blank_key is not None:
        blank = F.coalesce(F.col(blank_key), F.lit("")) == ""
        salt = [F.when(blank, F.struct(*[o for o in order if isinstance(o, str)])).alias("salt")]
    w = Window.partitionBy(*keys, *salt).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", most: int = 10_000
) -> DataFrame:
    """Equi join whose hot keys of ``left`` are dealt over several tasks, also where their bytes are few.

    The rows of a key that has more than ``most`` are dealt into slices by the columns ``by``; its rows of ``right`` are
    there for each slice. Only those keys, one in ``most`` rows at the most, go to all tasks.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    hot = F.broadcast(counts.select(*on, F.ceil(F.col("_rows") / most).cast("int").alias("_slices")))
    place = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_slices")), F.lit(0)).cast("int")
    dealt_left = left.join(hot, on, "left").withColumn("_slice", place).drop("_slices")
    slices = F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    dealt_right = right.join(hot, on, "left").withColumn("_slice", slices).drop("_slices")
    return dealt_left.join(dealt_right, [*on, "_slice"], how).drop("_slice")


def search_models(models: DataFrame, query: str | None, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search on the id, most downloads first."""
    limit = limit if limit > 0 else 20
    hits = models
    if query:
        hits = models.where(F.contains(F.lower("id"), F.lit(query.lower())))
    return hits.orderBy(F.desc("downloads"), "id").limit(limit)


def clean_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """Trim, drop blanks; order columns and duplicates stay."""
    return ids.withColumn(column, trim_nz(column)).where(F.col(column).isNotNull())


def cap_pages(entries: DataFrame, pages: int = 10) -> DataFrame:
    """Listing pages beyond the first ``pages`` of a repository are not part of a listing."""
    return entries.where(F.col("page") < pages)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all cores, for work that is long for the bytes of its rows.

    A number that is asked for is kept: adaptive execution would merge small partitions by their bytes, down to one task.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)


#: Seconds spent in ``stored``, for a bench that tells planning from execution.
STORED_SECONDS = [0.0]


def work_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder for intermediate tables below ``spark.checkpoint.dir``. Where that is unset, in the warehouse, but
    only on a local master: on a cluster its default is a folder of the driver's machine."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not shared:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{shared.rstrip('/')}/modelbom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Write a result that several later plans read to ``folder`` and read it from there.

    Without a folder the plan stays lazy, and each reader computes it. The folder is the caller's, on
    storage that all executors share; nothing depends on the master.
    """
    if folder is None:
        return df
    start, path = time.time(), f"{folder}/{name}"
    df.write.parquet(path)
    STORED_SECONDS[0] += time.time() - start
    return df.sparkSession.read.schema(df.schema).parquet(path)
